"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

Of any prefix of a text the encoding has one last token.  An automaton gives
the pieces that end at a place; the last token there is the one that may follow
the last token of the prefix before it, which holds if the two pieces together
encode as these two: this is told by their own merges, in order of rank.  The
ids are recovered from the end backwards.  Time is linear in the text, without a
queue of merges, and all new words of a chunk are encoded in step.

Merges can't cross from another character to a white space that follows it, nor
touch a character that is in no longer piece, if the model's pieces are so (it
is tested); texts are cut there, and each distinct part is encoded once.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _text

SPACE = "▁"
#: Each worker keeps at most so many pairs that it has told, words that it has encoded, and their ids; a longer word is encoded by itself.
PAIR_BITS, WORD_BITS, POOL_IDS, LONG_WORD = 20, 20, 1 << 23, 256
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (raw[at] & 127) << shift
            at += 1
            if raw[at - 1] < 128:
                return x, at
            shift += 7

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What encoding and decoding need of a SentencePiece BPE model with byte fallback."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    reachable: list[int] = field(default_factory=list)
    rank: dict[str, tuple[float, int]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model file; one of another type, or with other normalisation than white space escaping, is refused."""
        with open(path, "rb") as f:
            raw = f.read()
        pieces, kinds, scores, kind, fallback, prefix, extra, charsmap = [], [], [], 1, False, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(float(np.frombuffer(one.get(2, bytes(4)), "<f4")[0]))
                kinds.append(one.get(3, _NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                kind, fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                prefix, extra, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if kind != 2 or not fallback or not prefix or extra or charsmap or _USER in kinds:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation, without user-defined pieces, are supported")
        model = cls(pieces, kinds, scores)
        model.rank = {p: (-s, i) for i, (p, k, s) in enumerate(zip(pieces, kinds, scores)) if k == _NORMAL}
        model.reachable = [i for p, (_, i) in model.rank.items() if model.merge(p) == [p]]
        return model

    def last_merge(self, piece: str) -> tuple[str, str]:
        """The two symbols that make a reachable piece in the end."""
        left, right = self.merge(piece, 2)
        return left, right

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The text's pieces by merging the best pair, leftmost first, until none is a piece or so few are left."""
        parts = list(text)
        rank = self.rank
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class _Table:
    """Non-negative numbers by keys of 64 bits, none of them the largest, with open addressing; missing keys have -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        self.key = np.full(int(self.mask) + 1, np.uint64(2**64 - 1))
        self.value = np.full(int(self.mask) + 1, -1, np.int32)
        keys, left = keys.astype(np.uint64), np.arange(len(keys))
        at = self._at(keys)
        while len(left):
            free = left[self.key[at[left]] == np.uint64(2**64 - 1)]
            self.key[at[free]] = keys[free]
            done = self.key[at[left]] == keys[left]
            self.value[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        at = self._at(keys)
        seen = self.key[at]
        out = np.where(seen == keys, self.value[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            seen = self.key[at[left]]
            same = seen == keys[left]
            out[left[same]] = self.value[at[left[same]]]
            left = left[~same & (seen != np.uint64(2**64 - 1))]
        return out


class _Machine:
    """An Aho-Corasick automaton over the pieces: of many words at once, each step takes the next character of all."""

    def __init__(self, pieces: dict[str, int]) -> None:
        chars = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        child: dict[int, int] = {}
        node_of, depth = {"": 0}, [0]
        ends: dict[int, int] = {}
        for p, i in pieces.items():
            at = 0
            for k, c in enumerate(p):
                key = at * self.width + int(self.code[ord(c)])
                if key not in child:
                    child[key] = len(depth)
                    node_of[p[: k + 1]] = len(depth)
                    depth.append(k + 1)
                at = child[key]
            ends[at] = i
        self.fail = np.zeros(len(depth), np.int32)
        found: list[tuple[int, ...]] = [()] * len(depth)
        for text, at in sorted(node_of.items(), key=lambda x: len(x[0])):
            if at:
                fail = next(node_of[text[k:]] for k in range(1, len(text) + 1) if text[k:] in node_of)
                self.fail[at] = fail
                found[at] = ((ends[at],) if at in ends else ()) + found[fail]
        self.count = np.array([len(f) for f in found])
        self.first = np.cumsum(self.count) - self.count
        self.found = np.array([i for f in found for i in f], np.int32)
        self.child = _Table(np.array(list(child)), np.array(list(child.values())))
        self.root = np.array([child.get(c, 0) for c in range(self.width)], np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after another character; 0 is a character of no piece."""
        out = self.root[code]
        left = np.flatnonzero((code > 0) & (state > 0))
        now = state[left]
        while len(left):
            to = self.child.get(now.astype(np.int64) * self.width + code[left])
            found = to >= 0
            out[left[found]] = to[found]
            left, now = left[~found], self.fail[now[~found]]
            again = now > 0
            left, now = left[again], now[again]
        return out


class _Pairs:
    """Whether two pieces, one after the other, encode as themselves.

    A merge across their border joins a symbol at the end of the first one's
    merges with one at the beginning of the second's, while both are there.  The
    states of the border follow each other as the two pieces' own merges do, by
    rank; in none of them may the border's pair be a piece that comes first.
    """

    def __init__(self, model: PieceModel) -> None:
        symbols = dict.fromkeys(c for i in model.reachable for c in model.pieces[i])
        symbols |= dict.fromkeys(model.pieces[i] for i in model.reachable)
        number = {x: k for k, x in enumerate(symbols)}
        self.merge, self.pieces = model.merge, model.pieces
        rank = {x: model.rank[x][0] if x in model.rank and len(x) > 1 else -math.inf for x in symbols}
        last: dict[str, tuple[str, str]] = {}
        order = {r: k + 1 for k, r in enumerate(sorted({-math.inf, *(r for r, _ in model.rank.values())}))}
        self.sound = np.ones(len(model.pieces), bool)
        for i in model.reachable:
            x = model.pieces[i]
            if len(x) > 1:
                last[x] = model.last_merge(x)
                # a merge of a rank before its parts' own makes the order of merges another one
                self.sound[i] = all(y in number and rank[y] < rank[x] for y in last[x]) and all(self.sound[model.rank[y][1]] for y in last[x] if len(y) > 1)
        self.rank = np.array([order[rank[x]] for x in symbols], np.int64)
        self.of = np.full(len(model.pieces), -1, np.int32)
        chains: list[list[list[int]]] = [[], []]
        for i in model.reachable:
            x = model.pieces[i]
            self.of[i] = number[x]
            for side in (0, 1):
                chain, y = [number[x]], x
                while self.sound[i] and len(y) > 1:
                    y = last[y][1 - side]
                    chain.append(number[y])
                chains[side].append(chain[::-1])
        deep = max(len(c) for side in chains for c in side) + 1
        #: of each piece, the symbols at its end (0) or beginning (1) from the first character on; then -1
        self.chain = np.full((2, len(model.pieces), deep), -1, np.int32)
        for side in (0, 1):
            for i, chain in zip(model.reachable, chains[side]):
                self.chain[side, i, : len(chain)] = chain
        keys, values = [], []
        for p, (r, _) in model.rank.items():
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    keys.append(number[p[:k]] << 32 | number[p[k:]])
                    values.append(order[r])
        self.joined = _Table(np.array(keys, np.int64), np.array(values))
        self.seen = np.full(1 << PAIR_BITS, np.uint64(2**64 - 1))
        self.known = np.zeros(1 << PAIR_BITS, bool)

    def ok(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of piece numbers, with those told lately kept in a table."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        out = self.known[at]
        new = np.flatnonzero(self.seen[at] != key)
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            told = self._walk(a[new[first]], b[new[first]])
            self.seen[at[new[first]]], self.known[at[new[first]]] = key[new[first]], told
            out[new] = told[which]
        return out

    def one(self, a: int, b: int) -> bool:
        return bool(self.ok(np.array([a]), np.array([b]))[0])

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        odd = ~(self.sound[a] & self.sound[b])
        for k in np.flatnonzero(odd).tolist():
            x, y = self.pieces[int(a[k])], self.pieces[int(b[k])]
            out[k] = self.merge(x + y) == [x, y]
        left = np.flatnonzero(~odd)
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        never = np.int64(1 << 60)
        while len(left):
            x, y = self.chain[0, a[left], i], self.chain[1, b[left], j]
            px, py = self.chain[0, a[left], i + 1], self.chain[1, b[left], j + 1]
            rx, ry = np.where(px < 0, never, self.rank[px]), np.where(py < 0, never, self.rank[py])
            q = self.joined.get(x.astype(np.int64) << 32 | y)
            # of merges of one rank the leftmost comes first
            bad = (q >= 0) & (q < rx) & (q <= ry)
            out[left[bad]] = False
            go = ~bad & ((px >= 0) | (py >= 0))
            first = (rx <= ry)[go]
            left, i, j = left[go], i[go] + first, j[go] + ~first
        return out


class Encoder:
    """Encodes many texts; made once in each Python worker."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.pieces = model, model.pieces
        self.machine = _Machine({model.pieces[i]: i for i in model.reachable})
        self.pairs = _Pairs(model)
        self.length = np.array([len(p) for p in model.pieces], np.int64)
        self.bytes = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            if k == _BYTE:
                self.bytes[int(p[3:5], 16)] = i
        longer = {c for i in model.reachable for c in model.pieces[i] if len(model.pieces[i]) > 1}
        self.alone = np.array([b < 128 and chr(b) not in longer and b != 32 for b in range(256)])
        self.cuts = all(SPACE not in model.pieces[i].lstrip(SPACE) for i in model.reachable)
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(1 << WORD_BITS, np.uint64)
        self.place, self.size = np.zeros(1 << WORD_BITS, np.int32), np.zeros(1 << WORD_BITS, np.int32)
        self.pool, self.used = np.empty(POOL_IDS, np.int32), 0

    def words(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words of so many code points, none of them empty and white space escaped: all at once, character by character."""
        given = np.append(0, np.cumsum(size))
        order = np.argsort(-size, kind="stable")
        code = self.machine.code[points]
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        # of each place, the last piece before it: -1 is a character that is in no piece
        last = np.full(len(points), -1, np.int32)
        state = np.zeros(len(size), np.int32)
        for end in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -end, "right"))
            at = begin[:live] + end - 1
            state = self.machine.step(state[:live], code[at])
            count = self.machine.count[state]
            word = np.repeat(np.arange(live), count)
            if not len(word):
                continue
            piece = self.machine.found[np.repeat(self.machine.first[state] - np.cumsum(count) + count, count) + np.arange(len(word))]
            before = end - self.length[piece]
            prev = np.where(before > 0, last[begin[word] + np.maximum(before, 1) - 1], -1)
            ok = prev < 0
            some = np.flatnonzero(~ok)
            if len(some):
                ok[some] = self.pairs.ok(prev[some], piece[some])
            fit = np.flatnonzero(ok)
            word, top = np.unique(word[fit], return_index=True)
            last[at[word]] = piece[fit[top]]
        # back from the ends: where a token ends
        stop = np.zeros(len(points), bool)
        left, at = begin, begin + size - 1
        while len(at):
            stop[at] = True
            one = last[at]
            at = at - np.where(one < 0, 1, self.length[np.maximum(one, 0)])
            go = at >= left
            left, at = left[go], at[go]
        ends = np.flatnonzero(stop)
        ids = last[ends]
        raw = np.flatnonzero(ids < 0)
        each = np.ones(len(ends), np.int64)
        if len(raw):
            utf8 = [chr(c).encode() for c in points[ends[raw]].tolist()]
            each[raw] = [len(u) for u in utf8]
            out = np.repeat(ids, each)
            out[out < 0] = self.bytes[np.frombuffer(b"".join(utf8), np.uint8)]
            ids = out
        number = np.zeros(len(points) + 1, np.int64)
        number[ends + 1] = each
        total = np.cumsum(number)
        return np.diff(total[given]), ids

    def long_word(self, points: np.ndarray) -> np.ndarray:
        """The ids of one long word, by the same table, one character after the other."""
        machine, length, pairs = self.machine, self.length, self.pairs
        code = machine.code[points]
        last = [-1] * (len(points) + 1)
        state, known = np.zeros(1, np.int32), {}
        for end in range(1, len(points) + 1):
            state = machine.step(state, code[end - 1 : end])
            s = int(state[0])
            for i in machine.found[machine.first[s] : machine.first[s] + machine.count[s]].tolist():
                prev = last[end - int(length[i])] if end > length[i] else -1
                if prev >= 0 and (prev, i) not in known:
                    known[prev, i] = pairs.one(prev, i)
                if prev < 0 or known[prev, i]:
                    last[end] = i
                    break
        out: list[int] = []
        n = len(points)
        while n:
            if last[n] < 0:
                out += [int(self.bytes[x]) for x in reversed(chr(points[n - 1]).encode())]
                n -= 1
            else:
                out.append(last[n])
                n -= int(length[last[n]])
        return np.array(out[::-1], np.int32)

    def _coded(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the pool, sizes) of distinct words with their hashes; words met before aren't encoded again."""
        if self.used > POOL_IDS // 2:
            self._forget()
        slot = (key >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        place, size = self.place[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero(self.seen[slot] != key)
        if not len(new):
            return place, size
        wide = end[new] - start[new]
        raw = text[np.repeat(start[new] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())]
        try:
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            chars = np.diff(np.append(0, np.cumsum((raw & 0xC0) != 0x80))[np.append(0, np.cumsum(wide))])
        except UnicodeDecodeError:
            each = [text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist())]
            points, chars = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), np.array([len(x) for x in each])
        points = np.where(points == 32, np.uint32(ord(SPACE)), points)
        long = chars > LONG_WORD
        short = np.repeat(~long, chars)
        each, ids = self.words(points[short], chars[~long]) if not long.all() else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        at = np.cumsum(chars) - chars
        much = [self.long_word(points[at[k] : at[k] + chars[k]]) for k in np.flatnonzero(long).tolist()]
        fresh = np.concatenate((new[~long], new[long]))
        size[fresh] = np.concatenate((each, np.array([len(x) for x in much], np.int64)))
        flat = np.concatenate([ids, *much])
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(len(flat), np.int32)))
        self.pool[self.used : self.used + len(flat)] = flat
        place[fresh] = self.used + np.cumsum(size[fresh]) - size[fresh]
        self.used += len(flat)
        fresh = new[~long]
        self.seen[slot[fresh]], self.place[slot[fresh]], self.size[slot[fresh]] = key[fresh], place[fresh], size[fresh]
        return place, size

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a string array; null and empty texts have no ids."""
        data, offsets = _text.buffers(col)
        out, count = [], np.zeros(len(offsets), np.int64)
        for lo, hi in _text.chunks(offsets):
            part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if np.any(part == 0xE2) and b"\xe2\x96\x81" in part.tobytes():
                part, off = _text.buffers(pc.replace_substring(pa.array(col)[lo:hi] if not isinstance(col, pa.Array) else col.slice(lo, hi - lo).fill_null(""), SPACE, " "))
            some = np.flatnonzero(np.diff(off))
            if not len(some):
                continue
            # a space before each text
            text = np.full(len(part) + len(some), 32, np.uint8)
            given = np.ones(len(text), bool)
            begin = off[some] + np.arange(len(some))
            given[begin] = False
            text[given] = part
            cut = np.zeros(len(text) + 1, bool)
            cut[begin] = cut[-1] = True
            if self.cuts:
                space = text == 32
                cut[1:-1] |= space[1:] & ~space[:-1]
                alone = np.flatnonzero(self.alone[text])
                cut[alone] = cut[alone + 1] = True
            edge = np.flatnonzero(cut)
            start, end = edge[:-1], edge[1:]
            key, first, which = np.unique(_text.hash_spans(text, start, end), return_index=True, return_inverse=True)
            at, size = self._coded(text, start[first], end[first], key)
            each = size[which]
            total = np.cumsum(each)
            out.append(self.pool[np.repeat(at[which] - total + each, each) + np.arange(total[-1])])
            bounds = np.append(np.searchsorted(start, begin), len(start))
            count[some + lo + 1] = np.diff(np.append(0, total)[bounds])
        return np.cumsum(count), np.concatenate(out) if out else np.zeros(0, np.int32)


#: Every byte that isn't UTF-8 becomes a U+FFFD of its own.
_EACH_BYTE = "tracemill-each-byte"
codecs.register_error(_EACH_BYTE, lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Decoder:
    """Decodes ids: pieces joined, without the dummy prefix of the first one that is no control piece; a control piece is empty, the unknown piece is ' ⁇ '."""

    def __init__(self, model: PieceModel) -> None:
        text = [b"" if k == _CONTROL else bytes([int(p[3:5], 16)]) if k == _BYTE else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds)]
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.array([len(t) for t in text])
        self.at = np.cumsum(self.size) - self.size
        self.plain = np.array([k in (_NORMAL, _UNUSED) for k in model.kinds])
        self.control = np.array([k == _CONTROL for k in model.kinds])

    def column(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of ids[offsets[i]:offsets[i + 1]]; each byte that isn't UTF-8 becomes U+FFFD."""
        size = self.size[ids]
        # a text's first id that is no control piece
        seen = np.flatnonzero(~self.control[ids])
        at = np.searchsorted(seen, offsets)
        first = seen[at[:-1][np.diff(at) > 0]]
        skip = np.zeros(len(ids), np.int64)
        skip[first] = self.plain[ids[first]] & (size[first] > 0) & (self.blob[np.minimum(self.at[ids[first]], len(self.blob) - 1)] == 32)
        size = size - skip
        total = np.append(0, np.cumsum(size))
        data = self.blob[np.repeat(self.at[ids] + skip - total[:-1], size) + np.arange(total[-1])]
        ends = total[offsets]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", _EACH_BYTE) for x in out.to_pylist()], pa.string())


_ENCODERS: dict[int, tuple[Encoder, Decoder]] = {}


def coders(model: PieceModel) -> tuple[Encoder, Decoder]:
    """This worker's coders for the model."""
    key = hash((tuple(model.pieces), tuple(model.scores)))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model), Decoder(model)
    return _ENCODERS[key]


def encode(df: DataFrame, model: PieceModel, *, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_ids", decoded_col: str | None = None) -> DataFrame:
    """df with the texts' ids and their number, and without the text; with decoded_col, also what the ids decode to.

    The ids are those of the SentencePiece library.  Null and empty texts have
    an empty list; texts of any length are encoded whole; repeated rows alike;
    an empty table stays empty.  A column of df that has a new column's name is replaced.
    """
    new = [ids_col, count_col, *([decoded_col] if decoded_col else [])]
    kept = [c for c in df.columns if c not in new and c != text_col]
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), f"`{ids_col}` array<int>", f"`{count_col}` int", *([f"`{decoded_col}` string"] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                offsets, ids = encoder.column(b.column(len(kept)))
                out = [*b.columns[: len(kept)], pa.ListArray.from_arrays(offsets.astype(np.int32), ids), pa.array(np.diff(offsets).astype(np.int32))]
                if decoded_col:
                    out.append(decoder.column(offsets, ids))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, *new])

    return df.select(*kept, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, model: PieceModel, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text that each row's ids decode to; a null list decodes to a null, an empty one to an empty text."""
    kept = [c for c in df.columns if c != text_col]
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coders(shared.value)
        for b in batches:
            col = b.column(kept.index(ids_col))
            size = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
            text = decoder.column(size, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.select(kept).columns, pc.if_else(col.is_null(), pa.scalar(None, pa.string()), text)], names=[*kept, text_col])

    return df.mapInArrow(run, schema)
