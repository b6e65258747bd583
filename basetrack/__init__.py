"""Per-position numeric signal over named axes, as Spark DataFrames."""
