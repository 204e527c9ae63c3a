from __future__ import annotations

import datetime
import json

import numpy as np
import pytest

from tracemill.sources import files


def test_requests(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join(map(json.dumps, [{"text": "a", "gold_line_numbers": [1]}, {"request": {"request_id": "x", "text": "b", "budget": {"keep_ratio": 0.2}}, "important_line_numbers": [2]}])) + "\n\n")
    a, b = sorted(files.read_requests(spark, str(p)).collect(), key=lambda r: r.text)
    assert (a.request_id, a.budget.keep_ratio, a.budget.no_prune_below, a.tool_type, a.gold) == ("row-0", 0.5, 20, "auto", [1])
    assert (b.request_id, b.budget.keep_ratio, b.gold, b.required) == ("x", 0.2, [2], [])


def test_counters(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text('# HELP x\nx_total{a="1"} 2\nx_total{a="2"} 3\ny NaN\nz 4.5\n')
    assert {r.name: r.value for r in files.read_counters(spark, str(p)).collect()} == {"x_total": 5.0, "z": 4.5}


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "a.npz", h=np.arange(6).reshape(2, 3), other=np.ones(1))
    (r,) = files.read_arrays(spark, str(tmp_path / "a.npz"), "h").collect()
    assert (r.key, r.shape, r["values"]) == ("h", [2, 3], [0, 1, 2, 3, 4, 5])


def test_trajectories(spark, tmp_path):
    d = tmp_path / "runs/base/t1"
    d.mkdir(parents=True)
    (d / "t1.traj.json").write_text(json.dumps({"info": {"exit_status": "Submitted", "model_stats": {"api_calls": 3}}, "messages": [{"role": "user", "content": "x"}]}, indent=1))
    (r,) = files.read_trajectories(spark, str(tmp_path / "runs")).collect()
    assert (r.arm, r.task, r.info.model_stats.api_calls, len(r.messages)) == ("base", "t1", 3, 1)


def test_raw_store(spark, tmp_path):
    ids = files.save_raw(spark.createDataFrame([("hello",)], "text string"), str(tmp_path / "s")).collect()
    assert files.read_raw(spark, str(tmp_path / "s"), ids[0].raw_id).first().text == "hello"
    with pytest.raises(ValueError, match="raw id"):
        files.read_raw(spark, str(tmp_path / "s"), "../x")
    store = spark.read.parquet(str(tmp_path / "s"))
    assert files.unexpired(store, datetime.datetime.now() + datetime.timedelta(hours=200)).count() == 0
    assert files.unexpired(store, datetime.datetime.now()).count() == 1


def test_training_rows(spark):
    rows = [("a", "x\ny\nz", None, "q", None, [0, 1, 1], None), ("b", None, "p\n q \nr", None, None, None, ["q", "r\n"])]
    df = spark.createDataFrame(rows, "sample_id string, code string, document string, query string, labels array<int>, line_keep_labels array<int>, kept_frags array<string>")
    got = {r.request_id: r for r in files.convert_training_rows(df).collect()}
    assert got["a"].gold == [2, 3] and got["b"].gold == [2, 3] and got["b"].text == "p\n q \nr" and got["b"].query == ""
    with pytest.raises(Exception, match="differ in number"):
        files.convert_training_rows(df.selectExpr("sample_id", "code", "document", "query", "labels", "array(1) AS line_keep_labels", "kept_frags")).collect()


def test_matrix_and_run_times(spark, tmp_path):
    for budget, kept, found in (("0.7", 0.7, 1.0), ("0.5", 0.5, 0.9), ("0.6", 0.6, 0.8), ("all", None, 1.0)):
        (tmp_path / "m" / f"keep_{budget}").mkdir(parents=True)
        (tmp_path / "m" / f"keep_{budget}" / "summary.json").write_text(json.dumps({"method": "ir", "samples": 3, "estimated_token_retention_ratio": kept, "macro_required_line_recall": found, "latency_ms": {"mean": 2.5}}, indent=1))
    files.write_matrix(spark, str(tmp_path / "m"))
    got = {r.budget: (r.pareto, r.latency_mean_ms) for r in spark.read.schema("budget string, pareto boolean, latency_mean_ms double").json(str(tmp_path / "m" / "matrix_json")).collect()}
    assert got == {"0.7": (True, 2.5), "0.5": (True, 2.5), "0.6": (False, 2.5), "all": (None, 2.5)}
    for arm, times in (("a", ("2026-01-01T00:00:00Z\n", "2026-01-01T00:00:07Z\n", "0\n")), ("b", ("2026-01-01T00:00:00Z",))):
        (tmp_path / "r" / arm).mkdir(parents=True)
        for name, text in zip(("started_at", "ended_at", "exit_code"), times):
            (tmp_path / "r" / arm / name).write_text(text)
    assert {tuple(r) for r in files.read_run_times(spark, str(tmp_path / "r")).collect()} == {("a", 0, 7.0), ("b", None, None)}


def test_rows_are_numbered_in_their_order(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"text": f"t{i}"}) + "\n" for i in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        x = files.read_requests(spark, str(tmp_path / "x.jsonl"))
        assert x.rdd.getNumPartitions() > 1
        assert {r.text: r.request_id for r in x.collect()} == {f"t{i}": f"row-{i}" for i in range(50)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rankers_by_alias():
    from tracemill.plans import rankers

    assert rankers.ranker(" AST ") is rankers.execution_ast and rankers.ranker("ir-ast-hybrid") is rankers.ir_ast_hybrid
    with pytest.raises(ValueError):
        rankers.ranker("none")
