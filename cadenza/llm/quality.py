"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find, inside each whole text, the n-grams that
came before in it; the code points of words that such n-grams cover, and those of lines
that came before, are held against limits. Everything is numpy over Arrow batches; no
row needs another, so there is no shuffle, and memory is bounded by one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.words import U64, Words, chunks, mix, roll

# N-gram length and the largest share of word characters that its repeats may
# cover, as published for web text.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
# Our own choice: largest share of word characters in lines that came before. For web text
# 0.20 is published, too little for texts that quote one notice several times.
LINE_CHARS_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LONG = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in LIMITS)]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(came before, comes twice or more) for each key."""
    before, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:]] = same
        twice = before.copy()
        twice[order[:-1]] |= same
    return before, twice


def _covered(start: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in the n-grams that begin at start."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    return np.cumsum(step)[:total] > 0


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts named in _LONG, for each text of a chunk."""
    words = Words(data, offs)
    first, n = words.first, len(words.start)
    per_text = lambda x: (c := np.concatenate(([0], np.cumsum(x, dtype=np.int64))))[first[1:]] - c[first[:-1]]
    chars = words.code_points(words.start, words.end)
    out = {"n_words": np.diff(first), "word_chars": per_text(chars)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int64)))
    out["n_symbols"] = symbols[words.offs[1:]] - symbols[words.offs[:-1]]

    owner = words.owner()
    with np.errstate(over="ignore"):
        salt = mix(owner.astype(U64) + U64(1))
    h = words.hashes()

    def repeats(length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            before, twice = _repeats(roll(h, length)[at] + salt[at])
        return at[before], at[twice]

    def inside(length: int) -> np.ndarray:
        m = n - length + 1
        return np.flatnonzero(owner[:m] == owner[length - 1 :]) if m > 0 else np.zeros(0, np.int64)

    _, twice = repeats(3, inside(3))
    out["n_repeat_words"] = per_text(_covered(twice, 3, n))
    # an n-gram can only repeat where all the shorter ones in it do
    live, shorter = np.zeros(n + 1, bool), 3
    live[twice] = True
    for length in LIMITS:
        at = inside(length)
        at = at[np.logical_and.reduce([live[at + j] for j in range(length - shorter + 1)])] if len(at) else at
        before, twice = repeats(length, at)
        out[f"dup_chars_{length}"] = per_text(chars * _covered(before, length, n))
        live[:] = False
        live[twice] = True
        shorter = length

    # lines end at \n and at the ends of texts
    cuts = np.unique(np.concatenate((words.offs, np.flatnonzero(data == 10) + 1)))
    begin, end = cuts[:-1], cuts[1:]
    of = np.searchsorted(words.offs, begin, "right") - 1
    end = end - (data[end - 1] == 10) if len(end) else end
    word_at = np.searchsorted(words.start, begin)
    full = np.searchsorted(words.start, end) > word_at
    begin, end, of, word_at = begin[full], end[full], of[full], word_at[full]
    with np.errstate(over="ignore"):
        before, _ = _repeats(words.spans_hash(begin, end) + mix(of.astype(U64) + U64(1)))
    out["n_lines"] = np.bincount(of, minlength=words.n_texts)
    out["n_dup_lines"] = np.bincount(of[before], minlength=words.n_texts)
    total = np.concatenate(([0], np.cumsum(chars)))
    line_chars = total[np.searchsorted(words.start, end)] - total[word_at]
    out["dup_line_chars"] = np.bincount(of[before], weights=line_chars[before], minlength=words.n_texts).astype(np.int64)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    good = m["dup_line_chars"] <= LINE_CHARS_LIMIT * m["word_chars"]
    for n, limit in LIMITS.items():
        good &= m[f"dup_chars_{n}"] <= limit * m["word_chars"]
    return failed, ~failed & good


def _measured(text: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    for a, b, data, offs in chunks(text):
        yield a, b, measure(data, offs)


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the counts, base_failed and kept.

    A null or empty text has no words and fails for being short; a text of any length is
    measured whole, and must fit a task some 50 times. A share that equals its limit
    passes. Repeated rows are judged each by itself; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, m in _measured(batch.column(1)):
                failed, kept = verdicts(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(m[c].astype(np.int64)) for c in _LONG), pa.array(failed), pa.array(kept)],
                    names=["doc_id", *_LONG, "base_failed", "kept"],
                )

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _LONG) + ", base_failed boolean, kept boolean"
    return documents.select(id_col, text_col).mapInArrow(run, schema)


def kept_documents(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that quality_rules keeps.

    Null, empty and short texts go, repeated rows go or stay alike, long texts are
    measured whole; an empty table gives no rows.
    """
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, m in _measured(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(verdicts(m)[1]))

    return documents.mapInArrow(run, documents.schema)
