from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from tracemill.operators import context, lines, metrics, ranking, selection, tensors


def test_halves_round_to_even(spark):
    got = spark.range(1).select(selection.target_lines(F.lit(5), F.lit(0.5), min_lines=2, no_prune_below=0).alias("a"), selection.target_lines(F.lit(7), F.lit(0.5), no_prune_below=0).alias("b"), selection.target_lines(F.lit(7), F.lit(0.5)).alias("c"), selection.target_lines(F.lit(100), F.lit(0.5), max_lines=3).alias("d")).first()
    assert tuple(got) == (2, 4, 7, 3)


def test_bands(spark):
    got = spark.sql("SELECT explode(array(10, 20, 21, 100, 300)) n").select(selection.length_band_ratio(F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == [1.0, 1.0, 0.7, 0.45, 0.3]


def test_mandatory_then_seeds(spark):
    rows = [(1, i, 5, s, i == 4, i == 2, 2) for i, s in enumerate([0.0, 2.0, 0.1, 1.0, 0.2], 1)]
    df = spark.createDataFrame(rows, "id int, line_no int, n_lines int, score double, mandatory boolean, seed boolean, target int")
    assert sorted(r.line_no for r in selection.select_lines(df, "id").collect()) == [2, 4]


def test_render(spark):
    kept = spark.createDataFrame([(1, 2, 4, "b"), (1, 4, 4, "d"), (2, 1, 3, "x")], "id int, line_no int, n_lines int, line string")
    got = {r.id: r.rendered for r in selection.render_skeleton(kept, "id").collect()}
    assert got == {1: "<1 lines pruned>\n     2 | b\n<1 lines pruned>\n     4 | d", 2: "     1 | x\n<2 lines pruned>"}


def test_rank_percentiles_of_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (2, 5.0), (2, 5.0)], "id int, score double")
    got = sorted((r.id, r.score, r.percentile) for r in ranking.rank_percentiles(df, "id").collect())
    assert got == [(1, 1.0, 0.0), (1, 2.0, 1.0), (1, 2.0, 1.0), (2, 5.0, 1.0), (2, 5.0, 1.0)]


def test_nucleus(spark):
    df = spark.createDataFrame([(1, 1, 0.95), (1, 2, 0.04), (2, 1, 0.0), (2, 2, 0.0), (3, 1, 0.5), (3, 2, 0.5)], "id int, line_no int, score double")
    assert sorted((r.id, r.line_no) for r in selection.nucleus(df, "id").collect()) == [(1, 1), (2, 1), (3, 1), (3, 2)]


def test_disjoint_blocks(spark):
    df = spark.createDataFrame([(1, 1, 9), (1, 2, 4), (1, 10, 12), (1, 11, 12)], "id int, start_line int, end_line int")
    assert sorted((r.start_line, r.end_line) for r in lines.disjoint_blocks(df, "id").collect()) == [(1, 9), (10, 12)]


def test_pareto(spark):
    df = spark.createDataFrame([(0.7, 1.0), (0.5, 0.9), (0.6, 0.8), (0.5, 0.9)], "cost double, gain double")
    assert sorted((r.cost, r.pareto) for r in metrics.pareto(df, "cost", "gain").collect()) == [(0.5, True), (0.5, True), (0.6, False), (0.7, True)]


def test_sample_metrics(spark):
    df = spark.createDataFrame([([2, 4], [2, 3], [2, 3], 4), ([], [], [], 0)], "kept array<int>, gold array<int>, required array<int>, n_lines int")
    a, b = metrics.sample_metrics(df).orderBy(F.desc("n_lines")).collect()
    assert (a.line_precision, a.line_recall, a.line_f1, a.required_recall, a.critical_miss, a.retention) == (0.5, 0.5, 0.5, 0.5, True, 0.5)
    assert (b.line_precision, b.critical_miss, b.retention) == (None, None, 1.0)


def test_rollout_and_greedy_deletion(spark):
    x = spark.createDataFrame([(1, 0, 0, q, k, v) for q, k, v in [(0, 0, 1.0), (1, 1, 1.0), (2, 0, 0.1), (2, 1, 0.8), (2, 2, 0.1)]], "id int, layer int, head int, query int, key int, value double")
    got = {r.token: round(r.value, 6) for r in tensors.attention_rollout(x, "id", residual=0.0).collect()}
    assert got == {0: 0.1, 1: 0.8, 2: 0.1}
    b = spark.createDataFrame([(1, 1, "x"), (1, 2, "need"), (1, 3, "y"), (1, 4, "want")], "id int, block int, text string")
    gone = tensors.greedy_deletion(b, lambda t: ("need" in t) + ("want" in t), "id", keep=2).collect()
    assert sorted((r.block, r.step) for r in gone) == [(1, 2), (3, 1)]


def test_plans(spark):
    views = spark.createDataFrame([(1, i, level, tokens, 1.0, r) for i, r in ((1, 1), (2, 0)) for level, tokens in ((0, 1), (2, 5), (3, 10))], "task int, id int, level int, tokens bigint, importance double, recency int")
    got = {r.id: r.level for r in context.greedy_plan(views, "task", id_col="id", retention=0.6).collect()}
    assert got == {1: 2, 2: 2}
    low = {r.id: (r.level, r.tokens) for r in context.minimum_views(views, "id").collect()}
    assert low == {1: (0, 1), 2: (0, 1)}


def test_boundary(spark):
    df = spark.createDataFrame([("a <output>\nraw\n</output> b", "raw"), ("x raw y", "raw"), ("raw raw", "raw"), ("none", "raw")], "content string, raw string")
    got = [(r.prefix, r.suffix) for r in context.locate_boundary(df).collect()]
    assert got == [("a <output>\n", "\n</output> b"), ("x ", " y"), (None, None), (None, None)]


def test_rules_of_the_query_and_of_trees(spark):
    from tracemill.plans import rankers

    tree = "src/\n├── app/\n│   ├── main.py\n│   └── core.py\n└── tests/\n    └── test_a.py"
    rows = [(1, "tree src", "", "where is core.py", tree), (2, "make", "", "load_config", "one\ntwo\nthree\nx = conf.load_config(1)\nfive\nsix\nseven")]
    df = spark.createDataFrame(rows, "request_id long, command string, path string, query string, text string")
    got = {(r.request_id, r.line_no): r for r in rankers.execution_scores(df).collect()}
    # worked out by the reference's rules: 'py' hits lines 3, 4 and 6; an ancestor scores once for each hit below it
    assert [round(got[1, k].score, 2) for k in range(1, 7)] == [12.01, 10.01, 19.01, 19.01, 7.01, 19.01]
    assert got[1, 4].seed and got[1, 4].reasons == ["query_symbol_match", "tree_query_hit"]
    assert got[1, 1].reasons == ["tree_shallow", "tree_ancestor"] and got[1, 1].mandatory and not got[1, 1].seed
    assert got[2, 4].mandatory and got[2, 4].reasons == ["query_symbol_match"] and round(got[2, 4].score, 2) == 9.01
    assert (2, 4) in {(r.request_id, r.line_no) for r in rankers.ir_ast_hybrid(df, no_prune_below=0, keep_ratio=0.1).collect()}


def test_axes():
    from tracemill.operators import tensors

    for selector, want in (("all", [0, 1, 2, 3]), ("first", [0]), ("last", [3]), ("first-2", [0, 1]), ("last-9", [0, 1, 2, 3]), ("0,-1,0", [0, 3]), ([2, -4], [0, 2]), (1, [1])):
        assert tensors.axis_indices(selector, 4) == want
    for selector, size in (("all", 0), ("4", 4), ([], 3), ("", 3), (-5, 4)):
        with pytest.raises(ValueError):
            tensors.axis_indices(selector, size)
    assert tensors.axis_layout(None, 2) == ("steps", "tokens") and tensors.axis_layout(None, 3, rollout=True) == ("layers", "queries", "keys")
    assert tensors.axis_layout("h, steps t", 3) == ("heads", "steps", "tokens")
    for given, ndim in ((None, 6), ("h h", 2), ("h", 2)):
        with pytest.raises(ValueError):
            tensors.axis_layout(given, ndim)


def test_rectangular_arrays_and_wall_time(spark):
    from tracemill.operators import arms, tensors

    df = spark.createDataFrame([(1, [[1.0], [2.0]], "2026-01-01T00:00:00Z", "2026-01-01T00:01:30+00:00"), (2, [[1.0], []], "2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z"), (3, [], None, "x")], "i int, r array<array<double>>, a string, b string")
    got = {r.i: (r.x, r.y) for r in df.select("i", tensors.is_rectangular(df.r).alias("x"), arms.wall_time(df.a, df.b).alias("y")).collect()}
    assert got == {1: (True, 90.0), 2: (False, 0.0), 3: (False, None)}
