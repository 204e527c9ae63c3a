from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import _text, quality


def brute(words, least):
    n, covered, longest = len(words), set(), 0
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                covered |= set(range(i, i + k))
    return n, len(covered), longest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=6))
def test_repetition_equals_brute_force(texts):
    got = quality.repetition(*_text.buffers(pa.array([" ".join(t) for t in texts], pa.string())), 3)
    assert [tuple(int(x[i]) for x in got) for i in range(len(texts))] == [brute(t, 3) for t in texts]


def test_characters_of_scripts_without_spaces_are_tokens():
    size, covered, longest = quality.repetition(*_text.buffers(pa.array(["日本語日本語", "😀😀 x"])), 3)
    assert (size.tolist(), covered.tolist(), longest.tolist()) == ([6, 3], [6, 0], [3, 1])


def test_odd_rows(odd_docs, no_docs):
    got = quality.quality_filter(odd_docs)
    assert got.columns == odd_docs.columns
    assert got.count() == odd_docs.count() - 1  # the long text repeats itself after 10,007 words
    assert {r.doc_id for r in got.collect()} == {None, 1, 2, 3, 5, 6, 7, 8}
    assert quality.quality_filter(no_docs).collect() == []
    m = {r.doc_id: r for r in quality.repetition_metrics(odd_docs).collect()}
    assert m[1].n_tokens == m[2].n_tokens == m[3].n_tokens == 0
    assert m[4].longest_repeat == 60_000 - 10_007


def test_junk_goes_and_prose_stays(spark):
    junk, prose = "spam eggs " * 40, "one fish swam past two red boats near the old pier"
    df = spark.createDataFrame([(1, junk), (2, prose), (3, prose + " . " + prose)], "doc_id long, text string")
    assert sorted(r.doc_id for r in quality.quality_filter(df).collect()) == [2]
    assert sorted(r.doc_id for r in quality.quality_filter(df, max_covered=1.0, max_repeat=11).collect()) == [2, 3]
