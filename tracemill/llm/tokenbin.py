"""Binary token files: a concatenated id array with Elias-Fano document boundaries.

A file holds one shard: a header, the documents' ends as an Elias-Fano sequence
with a select directory, the document ids (bit-packed above their least), and
all token ids in 16 or 32 bits.  Boundaries cost about 2 + log2(mean length)
bits a document instead of 64, and any document's offsets are found by two
selects, without reading the others'.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shared_dir, written

MAGIC = b"TMEF0001"
SHARD_TOKENS = 1 << 23
_SAMPLE = 256
_BYTE_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def pack(values: np.ndarray, bits: int) -> bytes:
    """The values' low bits, one after the other."""
    if bits == 0 or not len(values):
        return b""
    v = values.astype(np.uint64)
    out = np.empty((len(v), bits), np.uint8)
    for k in range(bits):
        out[:, k] = (v >> np.uint64(k)) & np.uint64(1)
    return np.packbits(out.ravel(), bitorder="little").tobytes()


def unpack(raw: np.ndarray, bits: int, first: int, count: int) -> np.ndarray:
    """Values first to first + count - 1 of a packed array; only their bytes are read."""
    if bits == 0 or count == 0:
        return np.zeros(count, np.uint64)
    lo, hi = first * bits, (first + count) * bits
    x = np.unpackbits(raw[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: count * bits].reshape(count, bits)
    out = np.zeros(count, np.uint64)
    for k in range(bits):
        out |= x[:, k].astype(np.uint64) << np.uint64(k)
    return out


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / length) bits a number."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.frombuffer(pack(values & ((1 << low_bits) - 1), low_bits), np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 8 if n else 0) // 8 * 8, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::_SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<IBxxxII", self.n, self.low_bits, len(self.low), len(self.high)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, raw: bytes | memoryview) -> tuple[EliasFano, int]:
        """The sequence, and how many bytes it took."""
        n, low_bits, low, high = struct.unpack_from("<IBxxxII", raw)
        count = -(-n // _SAMPLE)
        at = 16 + 4 * count
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low), np.frombuffer(raw, np.uint32, count, 16)), at + low + high

    def select(self, k: int) -> int:
        """Where the upper bits' k-th one (from 0) is: from its sample, by counts of bytes."""
        at = int(self.samples[k // _SAMPLE])
        left = k % _SAMPLE
        byte = at >> 3
        first = int(self.high[byte]) >> (at & 7) << (at & 7)
        while True:
            ones = int(_BYTE_ONES[first])
            if left < ones:
                for bit in range(8):
                    if first >> bit & 1:
                        if not left:
                            return byte * 8 + bit
                        left -= 1
            left -= ones
            byte += 1
            first = int(self.high[byte])

    def __getitem__(self, k: int) -> int:
        return (self.select(k) - k) << self.low_bits | int(unpack(self.low, self.low_bits, k, 1)[0])

    def __len__(self) -> int:
        return self.n

    def values(self, first: int, stop: int) -> np.ndarray:
        """Numbers first to stop - 1: one select, then a walk over the upper bits between."""
        if first >= stop:
            return np.zeros(0, np.int64)
        lo, hi = self.select(first), self.select(stop - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[lo >> 3 : (hi >> 3) + 1], bitorder="little")) + (lo >> 3 << 3)
        ones = ones[(ones >= lo) & (ones <= hi)]
        return (ones - np.arange(first, stop)) << self.low_bits | unpack(self.low, self.low_bits, first, stop - first).astype(np.int64)


def to_shard(docs: list[int | None], ends: np.ndarray, ids: np.ndarray) -> tuple[bytes, int]:
    """One shard's file, and how many bytes of it are boundaries."""
    boundaries = EliasFano.build(ends).to_bytes()
    some = [d for d in docs if d is not None]
    least = min(some, default=0)
    bits = (max(some, default=0) - least + 1).bit_length()
    packed = pack(np.array([0 if d is None else d - least + 1 for d in docs], np.uint64), bits)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = struct.pack("<8sIBBxxqQI", MAGIC, len(docs), width, bits, least, len(ids), len(packed))
    return head + boundaries + packed + ids.astype(np.uint16 if width == 2 else np.uint32).tobytes(), len(boundaries)


class Shard:
    """Reads a shard's file; documents are found by select, not by a table of offsets."""

    HEAD = struct.calcsize("<8sIBBxxqQI")

    def __init__(self, raw: bytes | memoryview) -> None:
        magic, self.n, width, self.bits, self.least, tokens, packed = struct.unpack_from("<8sIBBxxqQI", raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ends, size = EliasFano.from_buffer(memoryview(raw)[self.HEAD :])
        at = self.HEAD + size
        self.docs = np.frombuffer(raw, np.uint8, packed, at)
        self.ids = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, tokens, at + packed)

    def offsets(self, k: int) -> tuple[int, int]:
        """Document k's first id and the one after its last."""
        return self.ends[k - 1] if k else 0, self.ends[k]

    def __getitem__(self, k: int) -> np.ndarray:
        a, b = self.offsets(k)
        return self.ids[a:b]

    def cuts(self, first: int, stop: int) -> np.ndarray:
        """Where documents first to stop - 1 begin, and where the last one ends."""
        ends = self.ends.values(max(first - 1, 0), stop)
        return np.append(0, ends) if first == 0 else ends

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        return [None if x == 0 else int(x) - 1 + self.least for x in unpack(self.docs, self.bits, first, stop - first).tolist()]


def write_token_shards(df: DataFrame, path: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write each partition's ids as shards of about shard_tokens under path (a new shared folder if none is given).

    Returns the manifest (shard, documents, tokens, bytes, boundary_bits): only
    files that it lists count; those of attempts that failed are not in it.  A
    null list is written as an empty one; null ids and repeated rows are kept;
    other columns are not written.  A document is never split between shards.
    """
    path = path or shared_dir(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        docs, sizes, ids, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate(sizes)).astype(np.int64)
            raw, boundaries = to_shard(docs, ends, np.concatenate(ids))
            name = f"{uuid.uuid4().hex}.tok"
            with where.open_output_stream(f"{base}/.{name}") as f:
                f.write(raw)
            where.move(f"{base}/.{name}", f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"shard": f"{path.rstrip('/')}/{name}", "documents": len(docs), "tokens": int(ends[-1]), "bytes": len(raw), "boundary_bits": 8 * boundaries}])

        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lists = part.column(1)
                docs += part.column(0).to_pylist()
                sizes.append(lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))
                ids.append(lists.flatten().to_numpy())
                total += len(ids[-1])
                if total >= shard_tokens:
                    yield flush()
                    docs, sizes, ids, total = [], [], [], 0
        if docs:
            yield flush()

    rows = df.select(F.col(id_col).cast("bigint"), F.col(ids_col).cast("array<int>"))
    return written(rows.mapInArrow(run, "shard string, documents bigint, tokens bigint, bytes bigint, boundary_bits bigint"), "manifest")


def read_token_shards(manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, shard, place, first_token, n_ids, ids) of every document in the manifest's shards.

    Documents are read in blocks, each block's boundaries by select; no table of
    offsets is made.  An empty manifest has no documents; other columns of it
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                where, base = fs.FileSystem.from_uri(name)
                with where.open_input_file(base) as f:
                    s = Shard(f.read())
                for lo in range(0, s.n, 2000):
                    hi = min(lo + 2000, s.n)
                    cut, docs = s.cuts(lo, hi), s.doc_ids(lo, hi)
                    ids = s.ids[cut[0] : cut[-1]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([name] * (hi - lo)), pa.array(np.arange(lo, hi)), pa.array(cut[:-1]), pa.array(np.diff(cut)), pa.ListArray.from_arrays((cut - cut[0]).astype(np.int32), ids)], names=[id_col, "shard", "place", "first_token", "n_ids", "ids"])

    names = manifest.select("shard")
    return names.repartition(max(1, names.count()), "shard").mapInArrow(run, f"`{id_col}` bigint, shard string, place bigint, first_token bigint, n_ids bigint, ids array<int>")
