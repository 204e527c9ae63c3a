"""File sources and sinks: requests, replay rows, trajectories, counters, arrays, results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as X

from ..functions import text as T
from ..operators.arms import wall_time
from ..operators.metrics import pareto

BUDGET = "struct<keep_ratio:double,min_lines:int,max_lines:int,no_prune_below:int,context_window:int>"
REQUEST = f"request_id string, text string, query string, tool_type string, path string, recent_context array<string>, budget {BUDGET}, metadata map<string,string>"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON lines, each plain or inside `request`, with the defaults filled in; a line that is no object fails the job."""
    names = [f.name for f in spark.createDataFrame([], REQUEST).schema]
    schema = X._parse_datatype_string(f"{REQUEST}, request struct<{_colons(REQUEST)}>, gold_line_numbers array<int>, important_line_numbers array<int>, answer_line_numbers array<int>, required_line_numbers array<int>, _bad string")
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    x = raw.withColumn("text", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit(f"{path}: not an object: "), F.col("_bad")))).otherwise(F.coalesce("request.text", "text")))
    x = x.select(*(F.col(n) if n == "text" else F.coalesce(f"request.{n}", n).alias(n) for n in names), "gold_line_numbers", "important_line_numbers", "answer_line_numbers", "required_line_numbers", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    # rows are numbered in the files' order: by what all partitions before have, and the place within
    sizes = {r["_p"]: r["n"] for r in x.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    begin = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    begun = F.element_at(F.create_map(*(F.lit(v) for kv in begin.items() for v in kv)), F.col("_p")) if begin else F.lit(0)
    x = x.withColumn("_i", begun + F.col("_m").bitwiseAND((1 << 33) - 1))
    d = F.col("budget")
    filled = F.struct(F.coalesce(d["keep_ratio"], F.lit(0.5)).alias("keep_ratio"), F.coalesce(d["min_lines"], F.lit(1)).alias("min_lines"), d["max_lines"].alias("max_lines"), F.coalesce(d["no_prune_below"], F.lit(20)).alias("no_prune_below"), F.coalesce(d["context_window"], F.lit(1)).alias("context_window"))
    none = F.array().cast("array<int>")
    return x.select(F.coalesce("request_id", F.concat(F.lit("row-"), F.col("_i").cast("string"))).alias("request_id"), "text", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("tool_type", F.lit("auto")).alias("tool_type"), "path", F.coalesce("recent_context", F.array().cast("array<string>")).alias("recent_context"), filled.alias("budget"), "metadata", F.coalesce("gold_line_numbers", "important_line_numbers", "answer_line_numbers", none).alias("gold"), F.coalesce("required_line_numbers", none).alias("required"))


def _colons(ddl: str) -> str:
    return ", ".join(f.simpleString() for f in X._parse_datatype_string(ddl).fields)


def read_trajectories(spark: SparkSession, root: str) -> DataFrame:
    """(arm, task, path, info, messages) of `*.traj.json` files below root; the arm is the first folder."""
    message = "struct<role:string,content:string>"
    schema = f"info struct<exit_status:string,model_stats:struct<api_calls:int>>, messages array<{message}>"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.traj.json").json(root)
    rest = F.regexp_extract(F.input_file_name(), r"/([^/]+)/(?:.*/)?([^/]+)\.traj\.json$", 2)
    arm = F.regexp_extract(F.input_file_name(), rf"{root.rstrip('/').rpartition('/')[2]}/([^/]+)/", 1)
    return raw.select(arm.alias("arm"), rest.alias("task"), F.input_file_name().alias("path"), "info", "messages")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a text exposition of counters: comments go, labels are summed over, values that aren't finite don't count."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    name = F.regexp_extract("value", r"^([A-Za-z_:][\w:]*)(?:\{.*\})?\s+\S+", 1)
    number = F.expr(r"try_cast(regexp_extract(value, '^[A-Za-z_:][\\w:]*(?:\\{.*\\})?\\s+(\\S+)', 1) AS double)")
    x = lines.select(name.alias("name"), number.alias("value")).where("name <> '' AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('inf')")
    return x.groupBy("name").agg(F.sum("value").alias("value"))


def read_arrays(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(path, key, shape, values) of the arrays in NumPy archives; without keys, of all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for part in parts:
            out = []
            for p, raw in zip(part["path"], part["content"]):
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    out += [(p, k, list(z[k].shape), z[k].astype("float64").ravel().tolist()) for k in z.files if not keys or k in keys]
            yield pd.DataFrame(out, columns=["path", "key", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, shape array<bigint>, values array<double>")


def write_replay(results: DataFrame, metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """Results, metrics and summary as JSON, the summary as CSV too."""
    results.write.mode("overwrite").json(f"{path}/results")
    metrics.write.mode("overwrite").json(f"{path}/per_sample_metrics")
    summary.write.mode("overwrite").json(f"{path}/summary")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary_csv")


def read_matrix(spark: SparkSession, root: str) -> DataFrame:
    """(budget, method, samples, measures ...) of the summaries in `keep_*` folders below root; the budget is the folder's."""
    names = ["retention_ratio", "estimated_token_retention_ratio", "macro_line_recall", "macro_line_f1", "macro_required_line_recall", "critical_miss_rate"]
    schema = f"method string, samples bigint, {', '.join(f'{n} double' for n in names)}, latency_ms struct<mean:double,p95:double>, model_forward_count bigint"
    raw = spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/keep_*/summary.json")
    budget = F.regexp_extract(F.input_file_name(), r"/keep_([^/]+)/", 1)
    return raw.select(budget.alias("budget"), "method", "samples", *names, F.col("latency_ms.mean").alias("latency_mean_ms"), F.col("latency_ms.p95").alias("latency_p95_ms"), "model_forward_count")


def write_matrix(spark: SparkSession, root: str) -> DataFrame:
    """The matrix with `pareto` (fewest tokens kept against most required lines found), written as JSON and CSV folders below root."""
    marked = pareto(read_matrix(spark, root), "estimated_token_retention_ratio", "macro_required_line_recall")
    marked.coalesce(1).write.mode("overwrite").json(f"{root}/matrix_json")
    marked.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/matrix_csv")
    return marked


def read_run_times(spark: SparkSession, root: str) -> DataFrame:
    """(arm, exit_code, wall_time_seconds) of the folders below root, by their files started_at, ended_at and exit_code; null without them."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/{{started_at,ended_at,exit_code}}", wholetext=True)
    parts = raw.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/([^/]+)$", 1).alias("arm"), F.regexp_extract(F.input_file_name(), r"/([^/]+)/([^/]+)$", 2).alias("what"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("value"))
    x = parts.groupBy("arm").agg(*(F.max(F.when(F.col("what") == w, F.col("value"))).alias(w) for w in ("started_at", "ended_at", "exit_code")))
    return x.select("arm", F.col("exit_code").try_cast("int").alias("exit_code"), wall_time(F.col("started_at"), F.col("ended_at")).alias("wall_time_seconds"))


def save_raw(df: DataFrame, path: str, *, text_col: str = "text", most: int = 64 << 20) -> DataFrame:
    """Append (raw_id, created_at, text) to a store; ids come from the texts, longer ones than `most` bytes fail the job."""
    size = F.octet_length(text_col)
    text = F.when(size > most, F.raise_error(F.lit("a text is too long for the store"))).otherwise(F.col(text_col))
    out = df.select(F.substring(F.sha2(text_col, 256), 1, 32).alias("raw_id"), F.current_timestamp().alias("created_at"), text.alias("text"))
    out.write.mode("append").parquet(path)
    return out.select("raw_id")


def read_raw(spark: SparkSession, path: str, raw_id: str) -> DataFrame:
    if not all(c in "0123456789abcdef" for c in raw_id) or len(raw_id) != 32:
        raise ValueError("not a raw id")
    return spark.read.parquet(path).where(F.col("raw_id") == raw_id)


def unexpired(df: DataFrame, now, hours: int = 72) -> DataFrame:
    """What the store keeps: rows of the last hours, the limit itself included."""
    return df.where(F.col("created_at") >= F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))


def convert_training_rows(df: DataFrame, *, keep_ratio: float = 0.5, no_prune_below: int = 20) -> DataFrame:
    """Replay rows of training rows (sample_id, code, document, query, labels, line_keep_labels, kept_frags).

    The text is code or, without it, document.  Gold lines are those of positive
    labels, else those equal, when trimmed, to a kept fragment's line.  As many
    labels as lines are needed; another number fails the job.
    """
    text = F.coalesce("code", "document", F.lit(""))
    lines = T.split_lines(text)
    labels = F.coalesce("line_keep_labels", "labels")
    wrong = labels.isNotNull() & (F.size(labels) != F.size(lines))
    positive = F.filter(F.transform(labels, lambda x, i: F.when(x > 0, i + 1)), lambda x: x.isNotNull())
    frags = F.filter(F.flatten(F.transform("kept_frags", lambda f: F.transform(T.split_lines(f), lambda x: F.btrim(x)))), lambda x: x != "")
    matched = F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains(frags, F.btrim(x)), i + 1)), lambda x: x.isNotNull())
    gold = F.when(wrong, F.raise_error(F.lit("labels and lines differ in number"))).otherwise(F.coalesce(positive, matched, F.array().cast("array<int>")))
    budget = F.struct(F.lit(keep_ratio).alias("keep_ratio"), F.lit(1).alias("min_lines"), F.lit(None).cast("int").alias("max_lines"), F.lit(no_prune_below).alias("no_prune_below"), F.lit(1).alias("context_window"))
    return df.select(F.col("sample_id").alias("request_id"), text.alias("text"), F.coalesce("query", F.lit("")).alias("query"), budget.alias("budget"), gold.alias("gold"))
