"""Line dedup by an exact set-similarity join.

A line's set is that of its tokens in lower case without ASCII punctuation.
Tokens are ordered by rarity: by the counts of a table of hash buckets over the
whole corpus, then by hash.  The table's size is fixed, and any one order keeps
the join exact, so buckets that tokens share cost time only.  Equal sets are
collapsed first.  The rest are posted under their prefixes; in each token's
tile, pairs are tested by lengths, by positions and by the first tokens of both
prefixes, each pair under its first common token.  The tile is then met by the
whole sets of the lines that still have a partner, and Jaccard decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text, jaccard
from ._shared import fresh, written

THRESHOLD = 0.85
BUCKET_BITS = 21
WINDOW = 16
LEAST_WINDOW = 8
#: A list of at most so many line numbers is broadcast (4 bytes each, and some 40 a text); a longer one is joined by shuffling the texts.
BROADCAST_LINES = 4_000_000
_PAIRS = 1 << 18
#: Lines that a task posts in one go, and postings that a part of the tokens has on average.
_POSTED = 1 << 16
_PART = 1 << 19
_EPS = 1e-9
_NULL = -(1 << 63)
_LINE = "doc{0} bigint, th{0} int, line{0} int"


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all lines (n + 1), and the first line of each text (m + 1)."""
    cut = np.sort(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)), kind="stable")
    # each text's first line begins at its own offset: texts that are empty have one, empty, line
    return cut, np.searchsorted(np.flatnonzero(data == 10), offsets) + np.arange(len(offsets))


def _line_tokens(col: pa.Array) -> Iterator[tuple[int, np.ndarray, _text.Tokens]]:
    data, offsets = _text.buffers(col)
    for lo, hi in _text.chunks(offsets, _text.CACHED_BYTES):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        cut, first = _lines(part, off)
        yield lo, first, _text.tokens(*_text.fold(part, cut))


def _wanted_tokens(col: pa.Array, wanted: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, _text.Tokens]]:
    """(text, line, tokens) of those lines of each text that are in wanted; the other lines aren't split into tokens."""
    data, offsets = _text.buffers(col)
    for lo, hi in _text.chunks(offsets, _text.CACHED_BYTES):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        cut, first = _lines(part, off)
        some = wanted.slice(lo, hi - lo)
        text, line = np.repeat(np.arange(hi - lo), some.value_lengths().to_numpy()), some.flatten().to_numpy()
        begin, end = cut[first[text] + line], cut[first[text] + line + 1]
        taken = b"".join([part[a:z].tobytes() for a, z in zip(begin.tolist(), end.tolist())])
        yield text + lo, line, _text.tokens(*_text.fold(np.frombuffer(taken, np.uint8), np.append(0, np.cumsum(end - begin))))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def rarity_levels(docs: DataFrame, bits: int) -> np.ndarray:
    """Four times the binary logarithm of each bucket's tokens in all texts (column 1), of the tasks' counts, each told by a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.int64)
        for b in batches:
            for _, _, t in _line_tokens(b.column(1)):
                np.add.at(count, _bucket(t.hash, bits), 1)
        chunk, raw = jaccard.packed_counts(count)
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(raw, pa.binary())], names=["chunk", "counts"])

    return jaccard.rarity_levels(docs.mapInArrow(run, "chunk int, counts binary"), bits)


def _distinct(t: _text.Tokens, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's distinct tokens in rarity order: hash, line, and the lines' first tokens (n + 1)."""
    lev = level[_bucket(t.hash, bits)]
    packed = (t.row.astype(np.uint64) << np.uint64(42)) | (lev.astype(np.uint64) << np.uint64(34)) | (t.hash & np.uint64((1 << 34) - 1))
    order = np.argsort(packed, kind="stable")
    h, p = t.hash[order], packed[order]
    if len(t.first) > 1 << 22 or np.any((p[1:] == p[:-1]) & (h[1:] != h[:-1])):
        order = np.lexsort((t.hash, t.hash & np.uint64((1 << 34) - 1), lev, t.row))  # the same order, with ties settled
        h = t.hash[order]
    row = t.row[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    h, row = h[keep], row[keep]
    return h, row, np.searchsorted(row, np.arange(len(t.first)))


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(x))
    return (total[cut[1:]] - total[cut[:-1]]).view(np.int64)


def _prefix(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - _EPS).astype(np.int64) + 1


def _least(threshold: float) -> int:
    """The size of the smallest set that a different one can be similar enough to."""
    size = 1
    while size < 1 << 20 and size < threshold * (size + 1) - _EPS:
        size += 1
    return size


def _records(docs: DataFrame, level, bits: int, threshold: float) -> DataFrame:
    """(doc, th, line, k1, k2, size, prefix, gone) of each line with a token.

    Lines that only equal ones can be similar enough to have an empty prefix.
    Of lines with one set, all but the first in an Arrow batch are gone already:
    so a line that is everywhere reaches its window once a batch at most.
    """

    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, th = b.column(0), b.column(2).to_numpy()
            parts: list[tuple] = []
            for lo, first, t in _line_tokens(b.column(1)):
                if not len(t.hash):
                    continue
                h, row, cut = _distinct(t, level.value, bits)
                size = np.diff(cut)
                lines = np.flatnonzero(size)
                if not len(lines):
                    continue
                k1, k2 = (_sums(_text.mix64(x), cut)[lines] for x in (h + np.uint64(1), h ^ np.uint64(0xA5A5A5A55A5A5A5A)))
                text = np.searchsorted(first, lines, "right") - 1
                p = np.where(size[lines] >= least, _window(size[lines], threshold), 0)
                inside = np.repeat(cut[lines] - np.cumsum(p) + p, p) + np.arange(p.sum())
                parts.append((text + lo, lines - first[text], k1, k2, size[lines], p, (h[inside] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            if not parts:
                continue
            text, line, k1, k2, size, p, ids = (np.concatenate(x) for x in zip(*parts))
            keys = k1, k2, doc.fill_null(_NULL).to_numpy()[text], th[text], line
            order = np.lexsort(keys[::-1])
            new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            gone = np.empty(len(order), bool)
            gone[order] = np.any([x[order] != x[first] for x in keys], axis=0)  # a repeated row is no copy of itself
            ends = 4 * np.append(0, np.cumsum(p)).astype(np.int32)
            names = ["doc", "th", "line", "k1", "k2", "size", "prefix", "gone"]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(text)), pa.array(th[text]), pa.array(line.astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(ends), pa.py_buffer(ids)]), pa.array(gone)], names=names)

    return docs.mapInArrow(run, f"{_LINE.format('')}, k1 bigint, k2 bigint, size int, prefix binary, gone boolean")


class _Lines:
    """Lines of one or more tiles, as the filters see them: sizes, the token's position, and the first ids.

    low: the low halves of the first WINDOW ids that tell a line; high: the high
    ones of those before the token.  A common token before the tile's is before
    it in both lines, so for these whole ids are compared; where halves decide,
    two ids that look alike weaken a filter only.
    """

    def __init__(self, size: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> None:
        self.size, self.pos, self.threshold = size.astype(np.int64), pos.astype(np.int64), threshold
        self.seen = np.minimum(_window(self.size, threshold), WINDOW)
        slot = np.arange(WINDOW)
        self.low = np.zeros((len(size), WINDOW), np.uint16)
        self.low[slot < self.seen[:, None]] = low
        self.high = np.full((len(size), WINDOW), -1, np.int32)
        self.high[slot < np.minimum(self.pos, self.seen)[:, None]] = high

    def allow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may be similar enough and have the tile's token as their first common one."""
        size, pos, t = self.size, self.pos, self.threshold
        need = np.ceil(t / (1 + t) * (size[i] + size[j]) - _EPS)
        some = np.flatnonzero((np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - _EPS) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need))
        ok = np.zeros(len(i), bool)
        for lo in range(0, len(some), _PAIRS // 8):
            at = some[lo : lo + _PAIRS // 8]
            x, y = i[at], j[at]
            same = self.low[x][:, :, None] == self.low[y][:, None, :]
            common = same.any(2) & (np.arange(WINDOW) < self.seen[x][:, None])
            most = common.sum(1) + np.maximum(size[x] - self.seen[x], size[y] - self.seen[y])
            fine = most >= need[at]
            late = np.flatnonzero(fine & (pos[x] > 0) & (pos[y] > 0))
            h = self.high[x[late]]
            fine[late] = ~(same[late] & (h[:, :, None] == self.high[y[late]][:, None, :]) & (h >= 0)[:, :, None]).any((1, 2))
            ok[at] = fine
        return ok


def _window(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many ids tell a line to the filters: its prefix's, and more of a line with a short prefix."""
    return np.maximum(_prefix(size, threshold), np.minimum(size, LEAST_WINDOW))


def _inside(count: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """count values from each first on, one run after the other; in steps, as the places take much more memory than the values."""
    out = np.empty(int(count.sum()), values.dtype)
    at = 0
    for lo in range(0, len(first), 1 << 15):
        some = count[lo : lo + (1 << 15)]
        end = at + int(some.sum())
        out[at:end] = values[np.repeat(first[lo : lo + (1 << 15)], some) + _inside(some)]
        at = end
    return out


def _near(x: np.ndarray) -> bytes:
    """Numbers of 64 bits by the first one and the differences, if these are small; else as they are."""
    d = np.diff(x)
    if len(d) and (d.min() < 0 or d.max() >= 1 << 16):
        return b"\x00" + x.tobytes()
    return b"\x01" + x[:1].tobytes() + d.astype(np.uint16).tobytes()


def _far(raw: bytes) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, np.int64, offset=1)
    return np.frombuffer(raw, np.int64, 1, 1) + np.append(0, np.cumsum(np.frombuffer(raw, np.uint16, offset=9).astype(np.int64)))


def _post(ranked: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(part, tokens, lines, sizes, low, high): each line under each token of its prefix, packed, a row for some lines of one part of the tokens.

    lines are numbers, told by their differences; a size has the position in its
    last byte (255 and more as 255, which weakens filters only).  low and high
    are the ids' halves that _Lines needs.
    """
    names = ["part", "tokens", "lines", "sizes", "low", "high"]

    def packed(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        number, size, prefix = t.column(0).to_numpy(), t.column(1).to_numpy().astype(np.int64), t.column(2).to_pylist()
        known = np.array([len(x) for x in prefix], np.int64) // 4
        first, ids = np.cumsum(known) - known, np.frombuffer(b"".join(prefix), np.int32)
        count = _prefix(size, threshold)
        row, pos = np.repeat(np.arange(len(count)), count), _inside(count)
        token = ids[first[row] + pos]
        part = ((token.view(np.uint32).astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        row, pos, token, part = row[order], pos[order], token[order], part[order]
        pos = np.minimum(pos, 255)
        lines, sizes = number[row], ((size[row] << 8) | pos).astype(np.uint32)
        seen = np.minimum(known, WINDOW)[row]
        before = np.minimum(pos, seen)
        words = ids.view(np.uint32)
        low = _gathered((words & 0xFFFF).astype(np.uint16), first[row], seen)
        high = _gathered((words >> 16).astype(np.uint16), first[row], before)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        cut = np.append(begin, len(part))
        at_low, at_high = (np.append(0, np.cumsum(x))[cut] for x in (seen, before))
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), at_low[:-1].tolist(), at_low[1:].tolist(), at_high[:-1].tolist(), at_high[1:].tolist()))
        cols = [[token[a:z].tobytes() for a, z, *_ in spans], [_near(lines[a:z]) for a, z, *_ in spans], [sizes[a:z].tobytes() for a, z, *_ in spans], [low[a:z].tobytes() for *_, a, z, _, _ in spans], [high[a:z].tobytes() for *_, a, z in spans]]
        return pa.RecordBatch.from_arrays([pa.array(part[begin]), *(pa.array(c, pa.binary()) for c in cols)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have = 0
        for b in batches:
            held.append(b)
            have += b.num_rows
            if have >= _POSTED:
                yield packed(pa.Table.from_batches(held))
                held, have = [], 0
        if have:
            yield packed(pa.Table.from_batches(held))

    return ranked.select("number", "size", "prefix").mapInArrow(run, "part int, tokens binary, lines binary, sizes binary, low binary, high binary")


def _tiles(posted: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(token, number) of the lines that have any partner in the token's tile that lengths, positions and prefixes allow.

    Only lines are told, not pairs: a tile of n copies sends n rows on, not n * n.
    """

    def partners(t: pa.Table) -> pa.RecordBatch:
        token, size, low, high = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("tokens", np.int32), ("sizes", np.uint32), ("low", np.uint16), ("high", np.uint16)))
        number = np.concatenate([_far(x) for x in t.column("lines").to_pylist()])
        size, pos = (size >> 8).astype(np.int64), (size & 255).astype(np.int64)
        seen = np.minimum(_window(size, threshold), WINDOW)
        before = np.minimum(pos, seen)
        # a token that only one line has makes no pair
        order = np.argsort(token, kind="stable")
        same = token[order[1:]] == token[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)] if len(order) > 1 else order[:0]
        order = order[np.lexsort((size[order], token[order]))]
        low = _gathered(low, (np.cumsum(seen) - seen)[order], seen[order])
        high = _gathered(high, (np.cumsum(before) - before)[order], before[order])
        token, number, size, pos = token[order], number[order], size[order], pos[order]
        n = len(token)
        lines = _Lines(size, pos, low, high, threshold)
        tile = np.cumsum(np.append(True, token[1:] != token[:-1])[:n]) << 32
        end = np.searchsorted(tile + size, tile + np.floor(size / threshold + _EPS).astype(np.int64), "right")
        # with partners of its own size or more, a token further on can't be the first common one
        far = size - np.ceil(2 * threshold / (1 + threshold) * size - _EPS).astype(np.int64)
        total = np.append(0, np.cumsum(np.where(pos <= far, np.maximum(end - np.arange(n) - 1, 0), 0)))
        marked = np.zeros(n, bool)
        for first in range(0, int(total[-1]), _PAIRS):
            x = np.arange(first, min(first + _PAIRS, int(total[-1])))
            i = np.searchsorted(total, x, "right") - 1
            j = i + 1 + x - total[i]
            ok = lines.allow(i, j)
            marked[i[ok]] = marked[j[ok]] = True
        return pa.RecordBatch.from_arrays([pa.array(token[marked]), pa.array(number[marked])], names=["token", "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield partners(pa.Table.from_batches(held))

    return posted.repartitionById(parts, F.col("part")).mapInArrow(run, "token int, number bigint")


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Lines with an earlier one of enough similarity in their tile; once one is found, the others aren't looked at."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < threshold * max(len(x), len(y)) - _EPS:
            return False
        both = np.concatenate((x, y))
        both.sort()
        overlap = int(np.count_nonzero(both[1:] == both[:-1]))
        return overlap >= threshold * (len(both) - overlap) - _EPS

    def later(token: int, ids: list[tuple], sets: list[np.ndarray]) -> list[tuple]:
        n = len(ids)
        if n <= 6:
            return [ids[j] for j in range(1, n) if any(alike(sets[i], sets[j]) for i in range(j))]
        low = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in sets]
        size = np.array([len(x) for x in sets])
        seen = np.minimum(_window(size, threshold), WINDOW)
        pos = np.array([int(np.argmax(x == token)) for x in low])
        words = [x.view(np.uint32) for x in low]
        halves = np.concatenate([(x[:k] & 0xFFFF).astype(np.uint16) for x, k in zip(words, seen.tolist())]), np.concatenate([(x[:k] >> 16).astype(np.int32) for x, k in zip(words, np.minimum(pos, seen).tolist())])
        lines = _Lines(size, pos, *halves, threshold)
        out, j = [], 1
        while j < n:
            stop = j + max(1, _PAIRS // 2 // n)
            y = np.repeat(np.arange(j, min(stop, n)), np.arange(j, min(stop, n)))
            x = np.arange(len(y)) - np.searchsorted(y, y)
            ok = lines.allow(x, y)
            found = -1
            for a, b in zip(x[ok].tolist(), y[ok].tolist()):
                if b != found and alike(sets[a], sets[b]):
                    found = b
                    out.append(ids[b])
            j = stop
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sets = None, [], []
        for b in batches:
            out: list[tuple] = []
            arrays = b.column(4)
            for i, (token, *line) in enumerate(zip(*(b.column(x).to_pylist() for x in range(4)))):
                if token != tile:
                    out += later(tile, ids, sets)
                    tile, ids, sets = token, [], []
                if not ids or ids[-1] != tuple(line):
                    ids.append(tuple(line))
                    raw = np.frombuffer(arrays[i].as_buffer(), np.uint8).reshape(-1, 6)
                    full = np.zeros((len(raw), 8), np.uint8)
                    full[:, :6] = raw
                    sets.append(full.view(np.uint64).ravel())
            yield batch(out)
        yield batch(later(tile, ids, sets))

    def batch(lines: list[tuple]) -> pa.RecordBatch:
        d, t, n = zip(*lines) if lines else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int32()), pa.array(n, pa.int32())], names=["doc", "th", "line"])

    return rows.repartition("token").sortWithinPartitions("token", "doc", "th", "line").mapInArrow(run, _LINE.format(""))


def _line_sets(docs: DataFrame, level, bits: int) -> DataFrame:
    """(doc, th, line, arr): 48 bits of each token's hash, rarest first, of those lines of (doc, text, th, lines) that are in lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th = b.column(2).to_numpy()
            for text, line, t in _wanted_tokens(b.column(1), b.column(3)):
                h, _, cut = _distinct(t, level.value, bits)
                low = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6]
                arr = [low[x:z].tobytes() for x, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(th[text]), pa.array(line), pa.array(arr, pa.binary())], names=["doc", "th", "line", "arr"])

    return docs.mapInArrow(run, f"{_LINE.format('')}, arr binary")


def repeated_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(doc, th, line) of each line, counted from 0, that has an earlier line of at least the threshold's Jaccard similarity.

    Lines are in the order of id (nulls first), text hash `th` (of 32 bits), place.
    Lines without tokens take no part.  Rows of one id and text are one document.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("th", F.hash("text"))
    level = spark.sparkContext.broadcast(rarity_levels(docs, bucket_bits))
    records = _records(docs, level, bucket_bits, threshold)
    at = F.rank().over(Window.partitionBy("k1", "k2", F.when(F.col("gone"), F.xxhash64("doc", "th", "line"))).orderBy("doc", "th", "line"))
    ranked = written(records.withColumn("n", F.when(F.col("gone"), 2).otherwise(at)).select("doc", "th", "line", "size", F.when(F.col("n") == 1, F.col("prefix")).alias("prefix"), F.monotonically_increasing_id().alias("number")), "lines")
    some = ranked.where("octet_length(prefix) > 0")
    postings = some.agg(F.sum(F.col("size") - F.ceil(threshold * F.col("size") - _EPS) + 1)).first()[0] or 0
    parts = max(1, math.ceil(postings / _PART))
    needed = written(_tiles(_post(some, threshold, parts), threshold, parts).join(some.select("number", "doc", "th", "line"), "number").select("token", "doc", "th", "line"), "needed")
    by_text = needed.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set("line").alias("lines"))
    by_text = F.broadcast(by_text) if needed.count() <= BROADCAST_LINES else by_text
    sets = _line_sets(docs.join(by_text, docs["doc"].eqNullSafe(by_text["_doc"]) & (docs["th"] == by_text["_th"])).select("doc", "text", "th", "lines"), level, bucket_bits)
    met = needed.join(sets, needed["doc"].eqNullSafe(sets["doc"]) & (needed["th"] == sets["th"]) & (needed["line"] == sets["line"]))
    found = _verify(met.select(needed["token"], needed["doc"], needed["th"], needed["line"], "arr"), threshold)
    return written(ranked.where("prefix is null").select("doc", "th", "line").union(found).distinct(), "gone")


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with its texts' repeated lines removed; a row of whose text nothing but white space is left by that goes.

    A line ends at a line feed.  It is removed if any earlier line of the corpus
    (by id, nulls first, then text hash, then place), removed itself or not, has
    a token set of at least the threshold's Jaccard similarity, however short it
    is; lines without tokens stay.  Null, empty and blank texts stay as they are;
    an empty table stays empty; repeated rows of one id and text are one document
    and stay alike; other columns stay as they are, whatever their names.
    """
    g, d, h, c = (fresh(df, x) for x in ("gone", "doc", "th", "cut"))
    gone = repeated_lines(df, id_col=id_col, text_col=text_col, threshold=threshold).groupBy("doc", "th").agg(F.collect_set("line").alias(g)).select(F.col("doc").alias(d), F.col("th").alias(h), g)
    text = F.col(text_col).cast("string")
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(g, i)), "\n")
    joined = df.join(gone, df[id_col].cast("bigint").eqNullSafe(gone[d]) & (F.hash(text) == gone[h]), "left")
    out = joined.select(*(df[x] if x != text_col else F.when(F.col(g).isNull(), text).otherwise(rest).alias(x) for x in df.columns), F.col(g).isNotNull().alias(c))
    return out.where(~F.col(c) | F.col(text_col).rlike(r"\S")).drop(c)
