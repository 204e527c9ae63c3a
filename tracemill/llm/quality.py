"""Quality rules by suffix-array repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text
from ._suffix import adjacent_lcp, suffix_array

MIN_TOKENS = 5
MAX_COVERED = 0.85
MAX_REPEAT = 100


def repetition(data: np.ndarray, offsets: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, tokens covered by repeats, and the longest repeat's tokens, for each text."""
    n = len(offsets) - 1
    size, covered, longest = (np.zeros(n, np.int64) for _ in range(3))
    for lo, hi in _text.chunks(offsets):
        t = _text.tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        size[lo:hi] = np.diff(t.first)
        m = len(t.hash)
        if not m:
            continue
        # a token of another document is another letter, so repeats are within documents
        key = _text.mix64(t.hash + t.row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        end = t.first[t.row + 1]
        sa, levels = suffix_array(key, end)
        lcp = adjacent_lcp(sa, levels, end)
        # an LCP interval's deepest repeat at a suffix is the larger of both neighbours' common prefixes
        best = np.empty(m, np.int64)
        best[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
        np.maximum.at(longest, t.row[best > 0] + lo, best[best > 0])
        at = np.flatnonzero(best >= min_tokens)
        change = np.zeros(m + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + best[at], -1)
        covered[lo:hi] = np.bincount(t.row[np.cumsum(change[:-1]) > 0], minlength=hi - lo)
    return size, covered, longest


def repetition_metrics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, n_tokens, covered_tokens, longest_repeat) of every row, repeated rows included.

    A maximal repeated substring is a run of tokens that occurs at least twice
    in the document; covered_tokens counts the tokens in the union of those of
    at least min_tokens tokens, each occurrence counted.  A null or empty text
    has zeros.  Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, covered, longest = repetition(*_text.buffers(b.column(1)), min_tokens)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(covered), pa.array(longest)], names=[id_col, "n_tokens", "covered_tokens", "longest_repeat"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, covered_tokens bigint, longest_repeat bigint")


def quality_filter(df: DataFrame, *, text_col: str = "text", min_tokens: int = MIN_TOKENS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows that pass both rules, with all their columns.

    A document is rejected if repeats of at least min_tokens tokens cover more
    than max_covered of its tokens, or if its longest repeat has more than
    max_repeat tokens.  Null and empty texts repeat nothing and stay; equal rows
    are judged alike; columns other than text_col are passed on unread.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, covered, longest = repetition(*_text.buffers(b.column(at)), min_tokens)
            yield b.filter(pa.array((covered <= max_covered * size) & (longest <= max_repeat)))

    return df.mapInArrow(run, df.schema)
