"""Repetition coverage: how much of a text lies inside n-grams and lines that it repeats.

Rolling hashes of several n-gram lengths are taken over all words of a slice of texts at once; a
window counts as duplicated when its words occur twice or more in its own text (three times or more for windows longer than the
base rule's five).  The share of a text's word characters that duplicated windows cover (overlaps counted once) is compared with a
limit for each length; so are the shares of duplicated lines and of characters in them.

Edge cases: a null text has no words and fails the base rules; an empty table gives an empty
result; repeated rows are judged each by itself; other columns are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basetrack.llm import text as tx
from basetrack.llm.common import chunks, ship


@dataclass(frozen=True)
class RepetitionRules:
    """Limits on shares.  The longer the n-gram the lower its limit, as less of it comes by chance."""

    duplicate_ngrams: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.18), (7, 0.16), (8, 0.14), (9, 0.12), (10, 0.10))
    #: Occurrences from which a window of more than ``repeat_window`` words counts: one passage said twice is no junk, thrice is a pattern.
    duplicate_least: int = 3
    top_ngrams: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    #: Fewer occurrences than this aren't repetition: in a short text two of anything are a large share.
    top_least: int = 4
    duplicate_lines: float = 0.30
    duplicate_line_chars: float = 0.20
    #: Fewer duplicated lines than this aren't a pattern.
    duplicate_lines_least: int = 3
    least_words: int = 10
    repeat_window: int = 5
    repeat_percent: int = 20


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double, top_ngram_share array<double>, dup_ngram_share array<double>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(key: np.ndarray, differ: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, the group of each sorted key, and the size of each group.

    Neighbours with equal keys are compared by what the keys stand for (``differ`` of their places); where keys collide, the
    codes of ``exact`` take the keys' place.
    """
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    twins = np.flatnonzero(~fresh)
    if len(twins) and differ(order[twins - 1], order[twins]).any():
        return _repeated(exact(), lambda a, b: np.zeros(len(a), bool), exact)
    group = np.cumsum(fresh) - 1
    return order, group, np.bincount(group) if len(group) else np.zeros(0, np.int64)


def _repeated_windows(w: tx.Words, length: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, row, repeats) of the windows of a length; windows are equal by their words."""
    hashes, at, row = tx.window_hashes(w, length)

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = row[a] != row[b]
        for k in range(length):
            out |= w.hashes[at[a] + k] != w.hashes[at[b] + k]
        return out

    def exact() -> np.ndarray:
        return np.unique(np.stack([row.astype(np.uint64), *(w.hashes[at + k] for k in range(length))], 1), axis=0, return_inverse=True)[1].ravel()

    return at, row, _repeated(tx.keyed(hashes, row), differ, exact)


def _repeated_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among lines; lines are equal by their bytes."""

    def line(i: int) -> tuple[int, bytes]:
        return int(row[i]), data[starts[i] : ends[i]].tobytes()

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fromiter((line(i) != line(j) for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))

    def exact() -> np.ndarray:
        codes: dict[tuple[int, bytes], int] = {}
        return np.array([codes.setdefault(line(i), len(codes)) for i in range(len(starts))])

    return _repeated(tx.keyed(tx.byte_hashes(data, starts, ends), row), differ, exact)


def measure(column: pa.Array, rules: RepetitionRules = RepetitionRules()) -> dict[str, np.ndarray]:
    """All measures of each text of the column."""
    w = tx.words(column)
    n = len(column)
    rows = w.rows()
    sums = tx.characters(w.data)
    size = sums[w.ends] - sums[w.starts]
    n_words = np.diff(w.first)
    word_chars = np.bincount(rows, size, n).astype(np.int64)
    total = np.maximum(word_chars, 1)

    marks = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_SYMBOL[w.data], out=marks[1:])

    # lines: \n-split, those with a word; a line is equal by its bytes
    breaks = np.flatnonzero(w.data == 0x0A)
    starts = np.unique(np.concatenate([w.bounds[:-1], breaks + 1]))
    starts = starts[starts < len(w.data)]
    line_row = np.searchsorted(w.bounds, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(w.data)), w.bounds[line_row + 1]) if len(starts) else starts
    ends = ends - ((ends > starts) & (w.data[np.maximum(ends - 1, 0)] == 0x0A)) if len(starts) else ends
    some = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, line_row = starts[some], ends[some], line_row[some]
    if len(starts):
        order, group, sizes = _repeated_lines(w.data, starts, ends, line_row)
        first = np.full(len(sizes), len(starts))
        np.minimum.at(first, group, order)
        again = np.zeros(len(starts), bool)
        again[order] = order != first[group]
    else:
        again = np.zeros(0, bool)
    n_lines = np.bincount(line_row, minlength=n)
    n_dup_lines = np.bincount(line_row[again], minlength=n)
    dup_line_chars = np.bincount(line_row[again], (sums[ends] - sums[starts])[again], n)
    all_chars = np.maximum(sums[w.bounds[1:]] - sums[w.bounds[:-1]], 1)

    cum = np.concatenate([[0], np.cumsum(size)])
    top = np.zeros((n, len(rules.top_ngrams)))
    for k, (length, _) in enumerate(rules.top_ngrams):
        at, row, (order, group, sizes) = _repeated_windows(w, length)
        if len(at):
            weight = np.bincount(group, (cum[at + length] - cum[at])[order])
            weight[sizes < rules.top_least] = 0
            np.maximum.at(top[:, k], row[order], weight[group])
    top /= total[:, None]

    lengths = sorted({rules.repeat_window, *(k for k, _ in rules.duplicate_ngrams)})
    shares, n_repeat = {}, np.zeros(n, np.int64)
    for length in lengths:
        at, _, (order, group, sizes) = _repeated_windows(w, length)
        least = 2 if length <= rules.repeat_window else rules.duplicate_least
        twice = at[order[sizes[group] >= least]] if len(at) else at
        inside = tx.covered(twice, twice + length, len(rows))
        shares[length] = np.bincount(rows[inside], size[inside], n) / total
        if length == rules.repeat_window:
            n_repeat = np.bincount(rows[inside], minlength=n)
    dup = np.stack([shares[k] for k, _ in rules.duplicate_ngrams], 1) if rules.duplicate_ngrams else np.zeros((n, 0))

    base_failed = (n_words < rules.least_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    line_share, char_share = n_dup_lines / np.maximum(n_lines, 1), dup_line_chars / all_chars
    bad = (n_dup_lines >= rules.duplicate_lines_least) & ((line_share > rules.duplicate_lines) | (char_share > rules.duplicate_line_chars))
    bad |= (dup > np.array([x for _, x in rules.duplicate_ngrams])).any(1) | (top > np.array([x for _, x in rules.top_ngrams])).any(1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": marks[w.bounds[1:]] - marks[w.bounds[:-1]], "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & ~bad, "dup_line_share": line_share, "dup_line_char_share": char_share, "top_ngram_share": top, "dup_ngram_share": dup,
    }


def repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, shares and the verdict.  No shuffle; memory is bounded by a slice of text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            m = measure(part.column("text"), rules)
            lists = {k: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel()) for k, v in m.items() if v.ndim == 2}
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(lists.get(k) if k in lists else pa.array(v) for k, v in m.items())], names=["doc_id", *m])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, SCHEMA)
