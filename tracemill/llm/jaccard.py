"""N-gram Jaccard self-join of documents, and the groups of near copies that follow from it.

1. Each text becomes its set of hashed n-grams; equal sets are collapsed, so
   that thousands of exact copies cost one.
2. All n-grams have one order: by rarity, as the counts of a table of hash
   buckets over all texts tell it, then by hash.  Two sets that are similar
   enough share an n-gram of their prefixes, which are the first
   size - ceil(threshold * size) + 1 in that order.  An n-gram is an anchor of
   a set if lengths and positions allow any partner there; of anchors that the
   very same sets have, one is enough.  Prefixes are sent packed, some six bytes
   an n-gram and ten for the document, to parts of the anchors.
3. A tile holds the sets of one size band, and of the next, under one anchor,
   and of those only the ones that have a pair which isn't met in a larger tile.
   In it the lengths, and then the hashed bitmaps, bound each pair's overlap
   from above.
4. The tile is met again by the sorted hash arrays of the sets that still have
   a pair, and these are intersected: many pairs of one tile as rows of bits.
   Links are counted and groups joined there, so no pair is written.

Every step is exact, hashes of 64 bits aside: the buckets' size and the rest of
the order cost time only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import fresh, small, written

NGRAM = 3
THRESHOLD = 0.6
BUCKET_BITS = 21
#: Of a set's anchors, so many tell a tile whether a pair is met in another one; pairs that they can't tell are met again, and counted once.
POSTED = 8
#: In a tile of more sets, all are taken to have a partner.
SMALL_TILE = 64
MOST_BITS = 1 << 16
_CHUNK = 1 << 15
#: N-grams that a task posts in one go, and that a part of the anchors has on average.
_POSTINGS = 1 << 20
_PART = 1 << 21
#: Up to so many pairs of a tile are intersected one by one; more as rows of bits, of so many cells at a time.
_FEW_PAIRS = 40
_CELLS = 1 << 24


def ngram_sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, cuts) for texts one after the other: each one's sorted distinct n-gram hashes, of its tokens in lower case without ASCII punctuation."""
    data, offsets = _text.buffers(col)
    for lo, hi in _text.chunks(offsets, _text.CACHED_BYTES):
        t = _text.tokens(*_text.fold(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        row, h = _text.shingles(t, n)
        cut = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
        for a, b in zip(cut, cut[1:]):
            h[a:b].sort()
        keep = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
        h, row = h[keep], row[keep]
        yield lo, h, np.searchsorted(row, np.arange(hi - lo + 1))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(x))
    return (total[cut[1:]] - total[cut[:-1]]).view(np.int64)


def _keys(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of 64 bits for each set."""
    return _sums(_text.mix64(h + np.uint64(1)), cut), _sums(_text.mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), cut)


def _bands(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.floor(np.log(size) / math.log(1 / threshold) + 1e-9).astype(np.int64)


def _width(band: int, threshold: float) -> int:
    """Bits of the bitmaps in a band's tiles: 1.4 to 2.8 for each n-gram of its largest sets, a power of two."""
    most = threshold ** -(min(band, 200) + 1)
    return min(MOST_BITS, max(256, 1 << math.ceil(math.log2(1.4 * most))))


def packed_counts(count: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The chunks of buckets that have any count, and their counts: a byte each, eight times the binary logarithm."""
    level = np.minimum(np.round(8 * np.log2(count + 1.0)), 255).astype(np.uint8)
    full = [k for k in range(0, len(level), _CHUNK) if level[k : k + _CHUNK].any()]
    return [k // _CHUNK for k in full], [level[k : k + _CHUNK].tobytes() for k in full]


def _first_pass(docs: DataFrame, n: int, threshold: float, bucket_bits: int) -> DataFrame:
    """(id, k1, k2, size, band, bits) of each document with a token; and each task's n-gram counts by bucket as rows (chunk, counts).

    A count is told by a byte, eight times the binary logarithm: only the order depends on it.
    """
    schema = "id bigint, k1 bigint, k2 bigint, size int, band int, bits binary, chunk int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bucket_bits, np.int64)
        for b in batches:
            for lo, h, cut in ngram_sets(b.column(1), n):
                np.add.at(count, _bucket(h, bucket_bits), 1)
                some = np.flatnonzero(np.diff(cut))
                size = np.diff(cut)[some]
                k1, k2 = (k[some] for k in _keys(h, cut))
                band = _bands(size, threshold)
                at, bits = (h >> np.uint64(20)).astype(np.int64), []
                for a, z, width in zip(cut[some].tolist(), cut[some + 1].tolist(), (_width(x, threshold) for x in band.tolist())):
                    one = np.zeros(width, bool)
                    one[at[a:z] & (width - 1)] = True
                    bits.append(np.packbits(one).tobytes())
                m = len(some)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some + lo)), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int32)), pa.array(band.astype(np.int32)), pa.array(bits, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        full, raw = packed_counts(count)
        none = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(full, pa.int32()), pa.array(raw, pa.binary())], names=names)

    return docs.mapInArrow(run, schema)


def rarity_levels(counts: DataFrame, bucket_bits: int) -> np.ndarray:
    """Four times the binary logarithm of each bucket's n-grams in all texts, of rows (chunk, counts)."""
    value = np.exp2(np.arange(256) / 8) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = value[np.frombuffer(raw, np.uint8)]
                total[chunk] = total[chunk] + x if chunk in total else x
        level = [np.minimum(4 * np.log2(np.maximum(x, 1)), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(level, pa.binary())], names=["chunk", "level"])

    got = counts.repartition("chunk").mapInArrow(run, "chunk int, level binary").toArrow()
    out = np.zeros(1 << bucket_bits, np.uint8)
    for chunk, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(raw, np.uint8)[: len(out)]
    return out


def _prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _narrow(x: np.ndarray) -> bytes:
    """As few bytes a number as the largest needs, told by the first byte."""
    wide = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([wide]) + x.astype(f"<u{wide}").tobytes()


def _wide(col: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64) for x in col.to_pylist()])


def _post(docs: DataFrame, n: int, threshold: float, level, bucket_bits: int, parts: int) -> DataFrame:
    """Each document's prefix n-grams, packed: of those that belong to one of so many parts, a row for some documents each.

    (part, keys, sizes, counts, anchors, places): the key, size and number of
    n-grams of its documents, then each n-gram's low 32 bits and its place in
    the common order.  Within its part that tells an n-gram well enough: two
    that look alike cost time only.  Of equal sets in a row, one is posted.
    """
    names = ["part", "keys", "sizes", "counts", "anchors", "places"]

    def packed(k: np.ndarray, size: np.ndarray, of: np.ndarray, h: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, of, place, low = part[order], of[order], place[order], (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        new = np.append(True, (part[1:] != part[:-1]) | (of[1:] != of[:-1]))[: len(part)]
        run = np.flatnonzero(new)
        count = np.diff(np.append(run, len(part)))
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        ends, runs = np.append(begin, len(part)), np.searchsorted(run, np.append(begin, len(part)))
        keys, sizes = k[of[run]], size[of[run]]
        cols: list[list] = [[] for _ in names]
        for a, z, r, s in zip(ends[:-1].tolist(), ends[1:].tolist(), runs[:-1].tolist(), runs[1:].tolist()):
            for col, x in zip(cols, (int(part[a]), keys[r:s].tobytes(), _narrow(sizes[r:s]), _narrow(count[r:s]), low[a:z].tobytes(), _narrow(place[a:z]))):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        have = 0

        def flush() -> pa.RecordBatch:
            k, size, h, place = (np.concatenate(x) for x in zip(*held))
            once = np.zeros(len(k), bool)
            once[np.unique(k, return_index=True)[1]] = True
            of = np.repeat(np.arange(len(k)), _prefix_size(size, threshold))
            return packed(k, size, of[once[of]], h[once[of]], place[once[of]])

        for b in batches:
            for _, h, cut in ngram_sets(b.column(1), n):
                size = np.diff(cut)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                k = _keys(h, cut)[0][some]
                p = _prefix_size(size, threshold)[some]
                lev = level.value[_bucket(h, bucket_bits)]
                order = np.concatenate([np.argsort(lev[a:z], kind="stable")[:q] + a for a, z, q in zip(cut[some].tolist(), cut[some + 1].tolist(), p.tolist())])
                held.append((k, size[some], h[order], np.arange(len(order)) - np.repeat(np.cumsum(p) - p, p)))
                have += len(order)
                if have >= _POSTINGS:
                    yield flush()
                    held, have = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "part int, keys binary, sizes binary, counts binary, anchors binary, places binary")


def _allowed(posted: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(s, size, anchor, many, list): the sets that have a partner under an anchor that lengths and positions allow; list tells the sets that an anchor has left, many how many they are."""

    def partners(part: int, t: pa.Table) -> pa.RecordBatch:
        k = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("keys").to_pylist()])
        anchor = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("anchors").to_pylist()])
        # n-grams that only one set has here are of no use
        order = np.argsort(anchor, kind="stable")
        same = anchor[order[1:]] == anchor[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)] if len(order) > 1 else order[:0]
        anchor, pos = anchor[order], _wide(t.column("places"))[order]
        of = np.repeat(np.arange(len(k)), _wide(t.column("counts")))[order]
        k, size = k[of], _wide(t.column("sizes"))[of]
        order = np.lexsort((k, size, anchor))
        order = order[np.append(True, (anchor[order[1:]] != anchor[order[:-1]]) | (k[order[1:]] != k[order[:-1]]))[: len(order)]]
        k, size, anchor, pos = k[order], size[order], anchor[order], pos[order]
        n = len(k)
        tile = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])[:n]) - 1
        many = np.bincount(tile)
        marked = many[tile] > SMALL_TILE
        stop = np.where(marked, np.arange(n) + 1, np.cumsum(many)[tile])
        total = np.append(0, np.cumsum(stop - np.arange(n) - 1))
        for first in range(0, int(total[-1]), 1 << 20):
            x = np.arange(first, min(first + (1 << 20), int(total[-1])))
            i = np.searchsorted(total, x, "right") - 1
            j = i + 1 + x - total[i]
            need = threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9
            ok = (size[i] >= threshold * size[j] - 1e-9) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need)
            marked[i[ok]] = marked[j[ok]] = True
        tile, anchor, k, size = tile[marked], anchor[marked], k[marked], size[marked]
        sums = np.zeros(len(many), np.uint64)
        np.add.at(sums, tile, _text.mix64(k.view(np.uint64) + np.uint64(1)))
        left = np.bincount(tile, minlength=len(many))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(size.astype(np.int32)), pa.array(anchor.astype(np.int64) | part << 32), pa.array(left[tile].astype(np.int32)), pa.array(sums[tile].view(np.int64))], names=["s", "size", "anchor", "many", "list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            yield partners(t.column("part")[0].as_py(), t)

    return posted.repartitionById(parts, F.col("part")).mapInArrow(run, "s bigint, size int, anchor bigint, many int, list bigint")


def _anchors(raw: pa.ChunkedArray) -> np.ndarray:
    """The posted anchors of each row: the first POSTED of its set, 0 where there are no more."""
    return np.frombuffer(b"".join(raw.to_pylist()), ">i8").reshape(-1, POSTED).astype(np.int64)


def _first_common(x: np.ndarray, y: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of posted anchors have this one as their first common one, and which have none in common."""
    common = ((x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]).any(2)
    late = ~common.any(1)
    return ~late & (x[np.arange(len(x)), common.argmax(1)] == anchor), late


def _met(rows: DataFrame) -> DataFrame:
    """Of rows (anchor, s, posted), those of sets that may have a pair to be met under this anchor: it is their first common one, or can't be told to be another."""

    def marks(t: pa.Table) -> pa.RecordBatch:
        anchor, posted = t.column("anchor").to_numpy(), _anchors(t.column("posted"))
        # sets that post the same anchors have the same part in a tile
        both = np.ascontiguousarray(np.column_stack((anchor, posted)).astype(">i8")).view(f"V{8 * POSTED + 8}").ravel()
        _, first, which, times = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        a, p = anchor[first], posted[first]
        n = len(a)
        marked = (times > 1) & (p[:, 0] == a)
        total = np.append(0, np.cumsum(np.searchsorted(a, a, "right") - np.arange(n) - 1))
        for lo in range(0, int(total[-1]), 1 << 17):
            x = np.arange(lo, min(lo + (1 << 17), int(total[-1])))
            i = np.searchsorted(total, x, "right") - 1
            j = i + 1 + x - total[i]
            open_ = ~(marked[i] & marked[j])
            i, j = i[open_], j[open_]
            ok = np.logical_or(*_first_common(p[i], p[j], a[i]))
            marked[i[ok]] = marked[j[ok]] = True
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.filter(pa.array(marked[which.ravel()])).columns], names=t.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            yield marks(t)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, rows.schema)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one or more anchors (column 0), each with all its rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        anchor = b.column(0).to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last or (held and held[0].column(0)[0] != b.column(0)[0]):
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(anchor: np.ndarray, band: np.ndarray, size: np.ndarray, raw: list[bytes], posted: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, late): the pairs of each anchor's tiles that lengths and bitmaps allow, sets of one band with each other and with those of the next; under their first common one of the posted anchors only, or `late` if they have none."""
    n = len(anchor)
    place = (np.cumsum(np.append(True, anchor[1:] != anchor[:-1])[:n]) << 32) + band
    end = np.searchsorted(place, place + 1, "right")
    widths = np.array([8 * len(x) for x in raw], np.int64)
    widest = 1 << math.ceil(math.log2(1 / threshold))
    for width in np.unique(widths).tolist():
        # a bit is the hash modulo the width, so parts laid over each other make a bitmap of a narrower band's width
        able = np.flatnonzero((widths >= width) & (widths <= widest * width))
        bits = np.empty((n, width // 64), np.uint64) if len(able) == n else np.zeros((n, width // 64), np.uint64)
        for x in able.tolist():
            bits[x] = np.bitwise_or.reduce(np.frombuffer(raw[x], np.uint64).reshape(-1, width // 64), 0)
        total = np.append(0, np.cumsum(np.where(widths == width, end - np.arange(n) - 1, 0)))
        most = max(1024, (32 << 23) // width)
        for first in range(0, int(total[-1]), most):
            x = np.arange(first, min(first + most, int(total[-1])))
            i = np.searchsorted(total, x, "right") - 1
            j = i + 1 + x - total[i]
            si, sj = size[i].astype(np.int64), size[j].astype(np.int64)
            ok = np.minimum(si, sj) >= threshold * np.maximum(si, sj) - 1e-9
            i, j, s = i[ok], j[ok], (si + sj)[ok]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            ok = (s - apart) / 2 >= threshold / (1 + threshold) * s - 1e-9
            i, j = i[ok], j[ok]
            ok, late = _first_common(posted[i], posted[j], anchor[i])
            ok |= late
            if ok.any():
                yield i[ok], j[ok], late[ok]


def _tiles(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows of the sets that have a candidate pair which isn't late in their tile; and a row with l1 for each late pair."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, band, size = (t.column(c).to_numpy() for c in ("anchor", "band", "size"))
        k = np.stack([t.column("k1").to_numpy(), t.column("k2").to_numpy()], 1)
        marked = np.zeros(len(anchor), bool)
        for i, j, late in _candidates(anchor, band, size, t.column("bits").to_pylist(), _anchors(t.column("posted")), threshold):
            marked[i[~late]] = marked[j[~late]] = True
            i, j = i[late], j[late]
            if len(i):
                swap = (k[i, 0] > k[j, 0]) | ((k[i, 0] == k[j, 0]) & (k[i, 1] > k[j, 1]))
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                told = {"anchor": anchor[i], "k1": k[i, 0], "k2": k[i, 1], "l1": k[j, 0], "l2": k[j, 1]}
                yield pa.RecordBatch.from_arrays([pa.array(told[f.name]) if f.name in told else pa.nulls(len(i), f.type) for f in [*t.schema, pa.field("l1", pa.int64()), pa.field("l2", pa.int64())]], names=[*t.column_names, "l1", "l2"])
        if marked.any():
            some = t.filter(pa.array(marked))
            none = pa.nulls(some.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in some.columns), none, none], names=[*t.column_names, "l1", "l2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            yield from pairs(t)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "band").mapInArrow(run, "anchor bigint, band int, k1 bigint, k2 bigint, size int, bits binary, posted binary, n int, l1 bigint, l2 bigint")


def _dense_overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Overlaps of many pairs of few sets: each set is a row of bits, one for each hash that a pair can share."""
    used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    hashes = np.concatenate([sets[x] for x in used.tolist()])
    row = np.repeat(np.arange(len(used)), [len(sets[x]) for x in used.tolist()])
    _, h = np.unique(hashes, return_inverse=True)
    left = np.zeros(len(used), bool)
    left[i] = True
    shared = np.zeros(int(h.max(initial=-1)) + 1, bool)
    shared[h[left[row]]] = True
    shared &= np.bincount(h) > 1
    some = shared[h]
    row, column = row[some], (np.cumsum(shared) - 1)[h[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros(len(i), np.int64)
    count = int(shared.sum())
    wide = min(-(-count // 64) * 64, max(64, _CELLS // len(used) // 64 * 64))
    for first in range(0, count, max(wide, 64)):
        a, z = np.searchsorted(column, (first, first + wide))
        cells = np.zeros((len(used), wide), bool)
        cells[row[a:z], column[a:z] - first] = True
        bits = np.packbits(cells, axis=1).view(np.uint64)
        step = max(1, (1 << 20) // bits.shape[1])
        for lo in range(0, len(i), step):
            out[lo : lo + step] += np.bitwise_count(bits[i[lo : lo + step]] & bits[j[lo : lo + step]]).sum(1, dtype=np.int64)
    return out


def _overlaps(sets: list[np.ndarray], anchor: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes each pair has in common; pairs of one tile are in a row."""
    tile = anchor[i]
    cut = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(i)).tolist()
    out = np.zeros(len(i), np.int64)
    for a, z in zip(cut, cut[1:]):
        if z - a > _FEW_PAIRS:
            out[a:z] = _dense_overlaps(sets, i[a:z], j[a:z])
            continue
        for k, x, y in zip(range(a, z), i[a:z].tolist(), j[a:z].tolist()):
            both = np.concatenate((sets[x], sets[y]))
            both.sort(kind="stable")
            out[k] = np.count_nonzero(both[1:] == both[:-1])
    return out


def _similar(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, overlap) of the pairs of rows of whole tiles that meet the threshold; rows as _join tells."""
    anchor, kind, k1, k2 = (t.column(c).to_numpy() for c in ("anchor", "kind", "k1", "k2"))
    sets = [np.frombuffer(x, np.uint64) if x is not None else None for x in t.column("arr").to_pylist()]
    size = np.array([0 if x is None else len(x) for x in sets], np.int64)

    def met(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        overlap = _overlaps(sets, anchor, i, j)
        ok = overlap >= threshold * (size[i] + size[j] - overlap) - 1e-9
        return i[ok], j[ok], overlap[ok]

    same = np.append(False, (anchor[1:] == anchor[:-1]) & (kind[1:] == kind[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]))[: len(kind)]
    full = np.flatnonzero((kind == 0) & ~same)  # repeated rows of one document are the same set
    if len(full):
        some = t.take(pa.array(full))
        for i, j, late in _candidates(anchor[full], some.column("band").to_numpy(), size[full], some.column("bits").to_pylist(), _anchors(some.column("posted")), threshold):
            if not late.all():
                yield met(full[i[~late]], full[j[~late]])
    pairs = np.flatnonzero(kind == 2)
    if len(pairs):
        at = {key: x for x, key in enumerate(zip(anchor.tolist(), k1.tolist(), k2.tolist())) if kind[x] < 2}
        p = t.take(pa.array(pairs))
        a, *keys = (p.column(c).to_pylist() for c in ("anchor", "k1", "k2", "l1", "l2"))
        i = np.array([at[x] for x in zip(a, *keys[:2])])
        j = np.array([at[x] for x in zip(a, *keys[2:])])
        yield met(i, j)


def _tiled(rows: DataFrame) -> DataFrame:
    return rows.repartition("anchor").sortWithinPartitions("anchor", "kind", "band", "k1", "k2")


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Every pair of different sets that meets the threshold, once."""
    names = ["k1", "k2", "l1", "l2", "overlap", "size_a", "size_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
            size = np.array([len(x or b"") // 8 for x in t.column("arr").to_pylist()], np.int64)
            for i, j, overlap in _similar(t, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[i], k2[i], k1[j], k2[j], overlap, size[i], size[j])], names=names)

    return _tiled(rows).mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    """(k1, k2, links, r1, r2): of each set with a pair in a tile, how many documents its pairs there tie it to, and a set of its connected group there.

    A row for each set in a tile, not for each pair: a group of n near copies sends n rows on, not n * n.
    """
    names = ["k1", "k2", "links", "r1", "r2"]

    def join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                return root
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while np.any((up := root[root]) != root):
                root = up

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            k1, k2, n = (t.column(c).to_numpy() for c in ("k1", "k2", "n"))
            links, root = np.zeros(len(k1), np.int64), np.arange(len(k1))
            for i, j, _ in _similar(t, threshold):
                np.add.at(links, i, n[j].astype(np.int64))
                np.add.at(links, j, n[i].astype(np.int64))
                root = join(root, i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[some], k2[some], links[some], k1[root[some]], k2[root[some]])], names=names)

    return _tiled(rows).mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(k1, k2, arr): each document's key and its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, cut in ngram_sets(b.column(1), n):
                k1, k2 = _keys(h, cut)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array([h[x:y].tobytes() for x, y in zip(cut.tolist(), cut[1:].tolist())], pa.binary())], names=["k1", "k2", "arr"])

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, arr binary")


def _join(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Collapsed sets (k1, k2, ids, size ...), and the tiles of those that still have a pair.

    A tile's rows: its sets (kind 0), sets of late pairs (1), late pairs (2).
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    first = written(_first_pass(docs, n, threshold, BUCKET_BITS), "first")
    level = spark.sparkContext.broadcast(rarity_levels(first.where("chunk is not null").select("chunk", "counts"), BUCKET_BITS))
    some = first.where("id is not null").drop("chunk", "counts")
    sets = written(some.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"), *(F.first(c).alias(c) for c in ("size", "band", "bits"))), "sets")
    grams = some.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil((1 - threshold) * grams / _PART))
    allowed = _allowed(_post(docs, n, threshold, level, BUCKET_BITS, parts), threshold, parts)
    # anchors that the same sets have make the same tile, so one of them does; those that most sets have come first
    own = allowed.groupBy("s", "list").agg(F.min("anchor").alias("anchor"), F.first("many").alias("many"))
    own = own.groupBy("s").agg(F.array_sort(F.collect_list(F.struct((-F.col("many")).alias("many"), "anchor")))["anchor"].alias("own"))
    packed = F.unhex(F.rpad(F.array_join(F.transform(F.slice("own", 1, POSTED), lambda x: F.lpad(F.hex(x), 16, "0")), ""), 16 * POSTED, "0"))
    posted = written(_met(own.select("s", packed.alias("posted"), F.explode("own").alias("anchor")).select("anchor", "s", "posted")), "posted")
    members = F.size("ids").alias("n")
    tiles = posted.join(sets.select(F.col("k1").alias("s"), "k1", "k2", "size", "band", "bits", members), "s").drop("s")
    met = written(_tiles(tiles.select("anchor", "band", "k1", "k2", "size", "bits", "posted", "n"), threshold), "met")
    late = written(met.where("l1 IS NOT NULL").groupBy("k1", "k2", "l1", "l2").agg(F.min("anchor").alias("anchor")), "late")
    columns = {"anchor": "bigint", "kind": "int", "band": "int", "k1": "bigint", "k2": "bigint", "l1": "bigint", "l2": "bigint", "bits": "binary", "posted": "binary", "n": "int"}
    rows = lambda t, kind: t.withColumns({c: F.lit(kind) if c == "kind" else F.col(c) if c in t.columns else F.lit(None).cast(d) for c, d in columns.items()}).select(*columns)
    of_late = late.select("anchor", "k1", "k2").union(late.select("anchor", "l1", "l2")).distinct().join(sets.select("k1", "k2", members), ["k1", "k2"])
    needed = rows(met.where("l1 IS NULL"), 0).union(rows(of_late, 1))
    keys = needed.select("k1", "k2").distinct().join(sets.select("k1", "k2", F.element_at("ids", 1).alias("id")), ["k1", "k2"])
    keys = written(keys.select("id").distinct(), "keys")
    arrays = _sets(docs.join(small(keys), "id", "left_semi"), n)
    return sets, needed.join(arrays, ["k1", "k2"]).select(*columns, "arr").union(rows(late, 2).withColumn("arr", F.lit(None).cast("binary")))


def ngram_jaccard_join(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of different n-gram sets with a Jaccard similarity of at least threshold, and the documents that share a set.

    (id_a, id_b, overlap, size_a, size_b, jaccard): documents with one and the
    same set are a class, told by its smallest id.  A row of jaccard 1 ties each
    other id of a class (id_b) to the smallest (id_a); every other row is a pair
    of classes, id_a < id_b, and holds for all their documents.  No pair is in
    two rows.  So thousands of copies make thousands of rows, not millions; but
    pairs of different near copies are all told (near_copy_classes counts them).

    A text of 1 to n - 1 tokens has one shorter n-gram.  Texts that are null or
    without tokens, and rows with a null id, pair with none; an empty table has
    no pairs; repeated rows of one id are one document, and an id with two
    different texts is in a class for each, but doesn't pair with itself; if it
    is the smallest of two classes that pair, all pairs of their other documents
    are told one by one, in one row each; texts of any length count whole; other columns are not
    read, whatever their names.
    """
    sets, tiles = _join(df, id_col, text_col, n, threshold)
    one = sets.select("k1", "k2", F.element_at("ids", 1).alias("id"))
    pairs = written(_pairs(tiles, threshold), "overlaps")
    pairs = pairs.join(one.withColumnRenamed("id", "a"), ["k1", "k2"]).join(one.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("id").alias("b")), ["l1", "l2"])
    # the smallest ids stand for their classes, unless they are one and the same
    every = lambda k, x: sets.select(*(F.col(c).alias(k + c[1:]) for c in ("k1", "k2")), F.explode("ids").alias(x))
    alike = pairs.where("a = b").drop("a", "b").join(every("k", "a"), ["k1", "k2"]).join(every("l", "b"), ["l1", "l2"])
    found = pairs.where("a <> b").unionByName(alike)
    either = lambda x, y: F.when(F.col("a") <= F.col("b"), F.col(x)).otherwise(F.col(y))
    found = found.select(either("a", "b").alias("id_a"), either("b", "a").alias("id_b"), "overlap", either("size_a", "size_b").alias("size_a"), either("size_b", "size_a").alias("size_b")).where("id_a < id_b")
    size = F.col("size").cast("bigint")
    same = sets.where(F.size("ids") > 1).select(F.element_at("ids", 1).alias("id_a"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("id_b"), size.alias("overlap"), size.alias("size_a"), size.alias("size_b"))
    return found.union(same).withColumn("jaccard", F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")))


def _groups(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, root) of the ids that aren't the smallest of their connected group."""
    one = sets.select("k1", "k2", F.element_at("ids", 1).alias("id"))
    edges = linked.select("k1", "k2", "r1", "r2").where("k1 <> r1 OR k2 <> r2").join(one.withColumnRenamed("id", "u"), ["k1", "k2"]).join(one.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("id").alias("v")), ["r1", "r2"]).select("u", "v")
    same = sets.where(F.size("ids") > 1).select(F.explode("ids").alias("u"), F.element_at("ids", 1).alias("v"))
    return components(edges.union(same))


def near_copy_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, class_id, n_links) of each document: the smallest id of its connected group, and how many others have an n-gram set of at least threshold's Jaccard similarity to its own.

    All pairs of ngram_jaccard_join count, equal sets too, but none is a row: the
    result has as many rows as there are ids.  A document without a near copy is
    a class of its own.  So are texts that are null or without tokens; rows with
    a null id are left out; repeated rows of one id are one document; an id with
    several texts has the links of each, also those between them; an empty table
    has no rows; other columns are not read, whatever their names.
    """
    sets, tiles = _join(df, id_col, text_col, n, threshold)
    linked = written(_links(tiles, threshold), "links")
    count = linked.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    told = sets.join(count, ["k1", "k2"], "left").select(F.explode("ids").alias("id"), (F.coalesce("links", F.lit(0)) + F.size("ids") - 1).alias("links"))
    every = df.select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("links")).where("id is not null")
    total = every.union(told).groupBy("id").agg(F.sum("links").alias("n_links"))
    groups = written(_groups(sets, linked), "groups")
    return total.join(small(groups), total["id"] == groups["node"], "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), "n_links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node's smallest connected node, by alternating large and small stars; edges (u, v) of longs."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = written(small, "edges")
        done = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def keep_one_of_each_group(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows without near copies, and of each connected group of them the rows of the smallest id; all columns stay.

    Texts that are null or without tokens and rows with a null id are in no
    group and stay; repeated rows of one id stay or go together; an empty table
    stays empty; columns may have any names.
    """
    sets, tiles = _join(df, id_col, text_col, n, threshold)
    name = fresh(df, "gone")
    gone = written(_groups(sets, written(_links(tiles, threshold), "links")).select(F.col("node").alias(name)), "gone")
    return df.join(small(gone), df[id_col].cast("bigint") == gone[name], "left_anti")
