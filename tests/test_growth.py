"""Work that has to grow with the input and no faster: told by the plans, and by the results of the steps that were made anew."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracemill import queries, runtime_queries
from tracemill.functions import text as T
from tracemill.operators import codecs, context, lines, ranking, selection
from tracemill.streaming import replay

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_split_a_text_once(spark):
    # the number of lines was worked out from the text again for each line
    texts = ["a\nb\nc\nd", "a\nb\nc", "a\nb", "a\n", "", None, "one long line\n\ntwo\n\nthree\n\nfour\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    views = context.text_views(df, "i")
    assert len(re.findall(r"\bsplit\(", plan(views))) == 1
    got = {(r.i, r.level): r.view for r in views.collect()}
    assert [got.get((0, k)) for k in range(4)] == [None, "a\nd", "a\nc\nd", texts[0]] and got[3, 1] == "a"
    assert got[6, 1] == "one long line\nfour" and got[6, 2] == "one long line\ntwo\nthree\nfour" and {i for i, k in got if k == 3} == set(range(7))
    same = lambda x: {(r.i, r.level, r.view, r.tokens) for r in x.collect()}
    assert same(context.full_views(df, "i")) == same(views.where("level = 3"))


def test_full_plan_makes_full_views_only(spark):
    assert "Generate" not in plan(runtime_queries.planner_full(spark, SMALL))


def test_words_are_the_tokens_with_word_characters(spark):
    df = spark.createDataFrame([("Ab_1 12x é naïve ٣٤ — K x-y, _z 'q'",)], "t string")
    old = F.filter(T.tokenize(F.col("t")), lambda x: x.rlike(r"(?U)\w"))
    a, b = df.select(T.word_tokens(F.col("t")), old).first()
    assert a == b and a[:3] == ["ab_1", "12", "x"]


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning\(", df._jdf.queryExecution().sparkPlan().toString())) + len(re.findall(r"Exchange hashpartitioning\(doc_id", df._jdf.queryExecution().executedPlan().toString()))


def test_lines_are_scored_within_the_row(spark):
    # four to eight exchanges of lines or tokens before, for what is within one row; the others share the step
    for name, most in (("bm25_lines", 0), ("select_lines", 1), ("select_with_seeds", 1), ("render_skeleton", 1), ("rank_percentiles", 1), ("nucleus", 1), ("rrf_lines", 1), ("neighbour_bonus", 1), ("replay_metrics", 2), ("replay_summary", 2)):
        assert exchanges(queries.QUERIES[name](spark, SMALL)) <= most, name


def test_bm25_within_the_row_is_bm25(spark):
    texts = ["Alpha beta\nbeta, beta gamma\n\nalpha — omega 12", "none of them", "\n\n", "", None, "alpha\r\nalpha beta\x0bbeta"]
    asked = [["alpha", "beta", "beta", "12", "zeta"], ["alpha"], ["x"], ["x"], ["x"], None]
    df = spark.createDataFrame(list(zip(range(6), texts, asked)), "i int, text string, asked array<string>")
    got = {(r.i, r.line_no): (r.n_lines, r.line, r.score) for r in ranking.bm25_lines(df, "i", query="asked").collect()}
    x = lines.split_lines(df, "i").withColumn("tokens", T.word_tokens(F.col("line")))
    want = {(r.i, r.line_no): r.bm25 for r in ranking.bm25(x, df.select("i", F.col("asked").alias("tokens")), "i", "line_no").collect()}
    assert {k: v[2] for k, v in got.items()} == want and any(want.values())
    assert got[0, 3][:2] == (4, "") and got[5, 3] == (3, "beta", 0.0)


def test_seeds_within_their_window(spark):
    rows = [(1, i, 9, s, False, i in (3, 8), 4) for i, s in enumerate([9.0, 0.1, 0.0, 0.3, 8.0, 7.0, 0.2, 0.0, 0.1], 1)]
    df = spark.createDataFrame(rows, "id int, line_no int, n_lines int, score double, mandatory boolean, seed boolean, target int")
    kept = lambda x, **k: sorted(r.line_no for r in selection.select_lines(x, "id", **k).collect())
    assert kept(df) == [2, 4, 7, 9] and kept(df, window=2) == [1, 4, 5, 6] and kept(df.drop("seed")) == [1, 4, 5, 6]


def test_views_are_made_within_the_row(spark):
    # nineteen exchanges before
    assert exchanges(runtime_queries.typed_views(spark, SMALL)) == 0


def test_typed_views_of_signals(spark):
    text = "x = 1\ny\ndef f(a):\n  alpha\n" + "".join(f"line {i} {'y' * 60}\n" for i in range(40)) + "error: bad\nalpha beta\ntail"
    rows = [(1, "source", text), (2, "diff", text), (3, "generic", None), (4, "tree", ""), (5, "generic", text)]
    df = spark.createDataFrame(rows, "i int, kind string, text string")
    signals = [(1, "alpha", 1.0), (1, "alpha", 0.5), (1, "line", 9.0), (1, "the", 4.0), (5, "nowhere", 1.0)]
    got = {(r.i, r.level): r for r in codecs.typed_views(df, spark.createDataFrame(signals, "i int, term string, weight double"), "i").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 3), (3, 3), (4, 3), (5, 0), (5, 1), (5, 3)}
    head = '<context_view observation_id="1" level="{}" codec="source_structure">\nThis is a reversible view of an older tool observation. Matched signals: alpha.\n</context_view>\n'
    assert got[1, 1].content == head.format("skeleton") + "x = 1\ny\ndef f(a):\n... [context omitted lines 4-44] ...\nerror: bad\nalpha beta\ntail"
    lines_ = text.split("\n")
    assert got[1, 2].content == head.format("focused") + "\n".join([*lines_[:35], "... [context omitted lines 36-44] ...", *lines_[44:]])
    assert (got[1, 1].relevance, got[1, 2].relevance, got[1, 3].relevance) == (1.5, 3.0, 0.0) and got[3, 3].content == ""
    column = df.where("i = 1").withColumn("s", F.expr("array(named_struct('term', 'alpha', 'weight', 1.5D), named_struct('term', 'line', 'weight', 9D), named_struct('term', 'the', 'weight', 4D))"))
    assert sorted(map(str, codecs.typed_views(column, "s", "i").collect())) == sorted(str(r) for k, r in got.items() if k[0] == 1)


def test_replay_is_one_pass_over_sorted_tasks(spark, monkeypatch):
    monkeypatch.setattr(replay, "ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        turns = [(t, 5 - k, ["observation", "prompt", "action", "observation", "prompt"][4 - k]) for t in ("a", "b", None) for k in range(5)]
        df = spark.createDataFrame([(t, k, kind, None) for t, k, kind in turns], "task_id string, event_index long, type string, observation_id string")
        x = replay.replay(df)
        assert "MapInArrow" in plan(x) and "FlatMapGroups" not in plan(x)
        one = [(0, "obs-0001", "CAPTURED", "HOT", 3, False), (1, "obs-0001", "ENRICHED", "HOT", 3, False), (1, "obs-0002", "CAPTURED", "HOT", 3, False)]
        assert sorted(map(tuple, x.collect()), key=repr) == sorted(((t, *r) for t in ("a", "b", None) for r in one), key=repr)
        assert replay.replay(df.where("type = 'action' AND task_id = 'none'")).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
