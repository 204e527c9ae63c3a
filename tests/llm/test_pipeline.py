from __future__ import annotations

import corpus_pipeline as cp
import duckdb
import pytest
from llm.conftest import SMALL

from tracemill.llm import queries


def test_run_equals_brute_force(spark):
    """SQL tells the first four stages; the last is told by the library."""
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    table = "documents"
    for k, sql in enumerate((queries.quality_sql, queries.linededup_sql, queries.near_copies_sql, queries.decontam_sql)):
        con.sql(f"CREATE TABLE s{k} AS {sql(table)}")
        table = f"s{k}"
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.MODEL)
    want = {i: (lang, source, n, library.encode(text)) for i, lang, source, n, text in con.sql("SELECT doc_id, lang, source, n_chars, text FROM s3").fetchall()}
    got = {r.doc_id: (r.lang, r.source, r.n_chars, r.ids) for r in cp.run(spark, SMALL).collect()}
    assert got == want and 0 < len(got) < 200


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs, least in ((odd_docs, 7), (no_docs, 0)):
        df = docs.selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")
        for k, (_, stage) in enumerate(cp.STAGES):
            df = stage(spark, df, SMALL)
            assert k == len(cp.STAGES) - 1 or df.columns == cp.COLUMNS
        assert df.count() >= least
