"""Relational operators over signal, windows and reads."""
