from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import queries, tokenbin
from llm.conftest import SMALL


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=700))
def test_elias_fano_equals_the_numbers(gaps):
    values = np.cumsum(np.array(gaps, np.int64))
    ef, size = tokenbin.EliasFano.from_buffer(tokenbin.EliasFano.build(values).to_bytes())
    assert len(ef) == len(values) and size == len(tokenbin.EliasFano.build(values).to_bytes())
    for lo, hi in ((0, len(values)), (len(values) // 3, len(values) // 2), (len(values) - 1, len(values))):
        assert ef.values(max(lo, 0), hi).tolist() == values[max(lo, 0) : hi].tolist()
    assert [ef[k] for k in range(len(values))] == values.tolist()


def test_space_is_near_the_minimum():
    values = np.cumsum(np.random.default_rng(0).integers(0, 1000, 50_000))
    bits = 8 * len(tokenbin.EliasFano.build(values).to_bytes()) / len(values)
    assert bits < 2.3 + np.log2(values[-1] / len(values))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(1 << 62), 1 << 62)), st.lists(st.integers(0, 70_000), max_size=9)), max_size=40))
def test_shard_equals_the_documents(docs):
    ends = np.cumsum([len(x) for _, x in docs]).astype(np.int64)
    ids = np.array([i for _, x in docs for i in x], np.int32)
    s = tokenbin.Shard(tokenbin.to_shard([d for d, _ in docs], ends, ids)[0])
    assert s.doc_ids(0, s.n) == [d for d, _ in docs]
    assert [s[k].tolist() for k in range(s.n)] == [x for _, x in docs]
    lo = s.n // 2
    assert np.diff(s.cuts(lo, s.n)).tolist() == [len(x) for _, x in docs[lo:]] or lo == s.n


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op10_token_binary(spark, SMALL).collect()}
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.MODEL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert r.ids == library.encode(d.text) and r.n_ids == len(r.ids)
    starts = sorted((r.first_token, r.n_ids) for r in got.values())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_odd_rows(spark):
    rows = [(None, [1, 2]), (1, None), (2, []), (3, [70_000] * 300_000), (4, [5]), (4, [5])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").selectExpr("*", "1 AS shard", "2 AS place", "3 AS n_ids")
    for most in (1, 1 << 23):
        got = [(r.doc_id, r.ids) for r in tokenbin.read_token_shards(tokenbin.write_token_shards(df, shard_tokens=most)).collect()]
        assert sorted(got, key=str) == sorted(((i, x or []) for i, x in rows), key=str)
    assert tokenbin.read_token_shards(tokenbin.write_token_shards(df.where("false"))).collect() == []
