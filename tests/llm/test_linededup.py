from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from tracemill.llm import _text, linededup


def tokens(line):
    return frozenset(re.sub(r"[!-/:-@\[-`{-~]", "", line).lower().split())


def brute(docs, threshold):
    seen, out = [], []
    for i, text in docs:
        rest = []
        for line in text.split("\n"):
            s = tokens(line)
            if s:
                if any(len(s & t) >= threshold * len(s | t) - 1e-9 for t in seen):
                    seen.append(s)
                    continue
                seen.append(s)
            rest.append(line)
        if len(rest) == len(text.split("\n")) or "\n".join(rest).strip():
            out.append((i, "\n".join(rest)))
    return out


def some_docs():
    random.seed(9)
    words = [f"w{int(random.paretovariate(0.6))}" for _ in range(4000)]
    lines = [" ".join(random.choices(words, k=random.randint(1, 40))) for _ in range(120)]
    docs = []
    for i in range(150):
        some = []
        for line in random.choices(lines, k=random.randint(1, 4)):
            w = line.split()
            for _ in range(random.choice([0, 0, 1, 2])):
                w[random.randrange(len(w))] = random.choice(words)
            some.append(" ".join(w))
        docs.append((i, "\n".join(some)))
    return docs


def test_equals_brute_force(spark):
    docs = some_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (0.6, 0.85):
        got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df, threshold=threshold).collect())
        want = brute(docs, threshold)
        assert got == want
        assert len(want) < len(docs)


def test_odd_rows(odd_docs, no_docs):
    got = linededup.dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns
    # 6 is all a copy of 5; both rows of 5 are one document
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 2, 3, 4, 5, 5, 7, 8, None]
    assert {r.doc_id: r.text for r in got.collect()}[7] == "日本語のテキスト 😀\n\n"
    assert linededup.dedup_lines(no_docs).collect() == []


def test_copies_with_short_lines_go_whole(spark):
    text = "Les.\nthis line has some more words\nOui, non\n--"
    rows = [(1, text), (2, text.upper()), (3, "les\nsomething else"), (4, "Oui non"), (5, "Ёлка ŁÓDŹ Ωμέγα"), (6, "ёлка łódź ωμέγα")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "--", 3: "something else", 5: "Ёлка ŁÓDŹ Ωμέγα"}
    assert sorted(got.items()) == sorted(brute(rows, 0.85))


def test_ties_of_one_id_are_settled_by_text(spark):
    rows = [(1, "a b c d e f g\nmore words that only one text has"), (1, "a b c d e f g\nother ones which nobody else has got")]
    got = [r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum("a b c" in t for t in got) == 1 and len(got) == 2


def test_one_order_with_and_without_collisions():
    """A collision of 34 bits in one line leaves the order of the others' tokens as it is in other chunks."""
    low = [(9 << 40) + 1, (5 << 40) + 2, (7 << 40) + 3]

    def ordered(*lines):
        first = np.cumsum([0] + [len(x) for x in lines])
        row = np.repeat(np.arange(len(lines)), np.diff(first))
        t = _text.Tokens(first[:-1], first[1:], row, first, np.array([h for x in lines for h in x], np.uint64), first)
        h, _, cut = linededup._distinct(t, np.zeros(1 << 4, np.uint8), 4)
        return h[cut[0] : cut[1]].tolist()

    assert ordered(low) == ordered(low, [8, 8 + (1 << 34)]) == low


def test_posting_and_pairing_take_bounded_memory():
    """Half a million postings of 16 ids each: the places of all ids at once would take 64 MB for each array of them."""
    import tracemalloc

    values, first = np.zeros(1 << 16, np.uint16), np.arange(1 << 19) % 1000
    count = np.full(1 << 19, 16)
    tracemalloc.start()
    got = linededup._gathered(values, first, count)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 << 23 and most < 48 << 20


def test_gathered_runs():
    first, count = np.array([5, 0, 7, 2]), np.array([2, 0, 1, 3])
    assert linededup._gathered(np.arange(10), first, count).tolist() == [5, 6, 7, 2, 3, 4]


def test_only_wanted_lines_are_split_into_tokens():
    col = pa.array(["", "a b\nc d e\n\nf", None, "g h\ni", "j k l"])
    [(text, line, t)] = linededup._wanted_tokens(col.slice(1), pa.array([[], [3, 0], [], [1], []], pa.list_(pa.int32())).slice(1))
    assert (text.tolist(), line.tolist()) == ([0, 0, 2], [3, 0, 1])
    want = [h for x in (b"f", b"a b", b"i") for h in _text.tokens(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hash.tolist()]
    assert t.hash.tolist() == want and np.diff(t.first).tolist() == [1, 2, 1]
