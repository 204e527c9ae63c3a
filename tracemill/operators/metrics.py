"""Evaluation: per-sample metrics, summaries, matrices, Pareto frontiers and comparisons with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import ratio, safe_divide


def sample_metrics(df: DataFrame) -> DataFrame:
    """Adds the metrics of kept, gold and required line numbers (arrays); those without gold or required lines are null."""
    hit = F.size(F.array_intersect("kept", "gold")).cast("double")
    p, r = safe_divide(hit, F.size("kept").cast("double")), safe_divide(hit, F.size("gold").cast("double"))
    has = F.size("gold") > 0
    need = F.size("required") > 0
    found = F.size(F.array_intersect("kept", "required"))
    return df.withColumns({
        "line_precision": F.when(has, p),
        "line_recall": F.when(has, r),
        "line_f1": F.when(has, safe_divide(2 * p * r, p + r)),
        "required_recall": F.when(need, found / F.size("required")),
        "critical_miss": F.when(need, found < F.size("required")),
        "retention": F.when(F.col("n_lines") == 0, 1.0).otherwise(F.size("kept") / F.col("n_lines")),
    })


def summarize(metrics: DataFrame, by: str) -> DataFrame:
    """(by, is_total, ...) of all samples and of each group, in one pass: micro sums and macro means, undefined ones left out."""
    kept, total = F.sum(F.size("kept")), F.sum("n_lines")
    return metrics.groupingSets([[], [F.col(by)]], F.col(by)).agg(
        (F.grouping_id() == 1).alias("is_total"),
        F.count("*").alias("samples"),
        F.coalesce(kept / F.nullif(total, F.lit(0)), F.lit(1.0)).alias("retention_ratio"),
        F.avg("line_precision").alias("macro_precision"),
        F.avg("line_recall").alias("macro_recall"),
        F.avg("line_f1").alias("macro_f1"),
        F.avg("required_recall").alias("macro_required_recall"),
        (F.count_if("critical_miss") / F.nullif(F.count("critical_miss"), F.lit(0))).alias("critical_miss_rate"),
    )


def pareto(df: DataFrame, cost: str, gain: str) -> DataFrame:
    """`pareto`: whether no other row has at most the cost and at least the gain, and one of them strictly; null where either is.

    Sorted by cost, a row is dominated if an earlier cost has at least its gain
    or an equal cost has more.  The distinct costs are cut into ranges, so that
    no task has to sort them all: each range needs the best gain of those before
    it, and a window within.
    """
    by_cost = df.where(F.col(cost).isNotNull() & F.col(gain).isNotNull()).groupBy(cost).agg(F.max(gain).alias("_best"))
    bounds = df.select(F.col(cost).cast("double").alias("_c")).approxQuantile("_c", [k / 64 for k in range(1, 64)], 0.005)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col(cost).cast("double"))) if bounds else F.lit(0)
    by_cost = by_cost.withColumn("_part", part)
    tops = by_cost.groupBy("_part").agg(F.max("_best").alias("_top"))
    before = tops.select("_part").join(tops.select(F.col("_part").alias("_p"), "_top"), F.col("_p") < F.col("_part")).groupBy("_part").agg(F.max("_top").alias("_before"))
    own = F.max("_best").over(Window.partitionBy("_part").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    best = by_cost.join(F.broadcast(before), "_part", "left").select(cost, "_best", F.greatest(own, "_before").alias("_cheaper"))
    x = df.join(best, cost, "left")
    fine = (F.col(gain) >= F.col("_best")) & (F.col("_cheaper").isNull() | (F.col("_cheaper") < F.col(gain)))
    return x.withColumn("pareto", F.when(F.col(cost).isNotNull() & F.col(gain).isNotNull(), fine)).drop("_best", "_cheaper")


def percentiles(df: DataFrame, by: str, value: str, qs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation; 0 for none."""
    return df.groupBy(by).agg(*(F.coalesce(F.percentile(value, F.lit(q)), F.lit(0.0)).alias(n) for n, q in qs.items()))


def against_baseline(arms: DataFrame, baseline: str, measures: list[str], *, key: str = "arm", count: str = "trajectories") -> DataFrame:
    """Each arm's measures as differences and ratios to the baseline arm's; null unless both have as many trajectories, more than 0."""
    base = arms.where(F.col(key) == baseline).select(F.col(count).alias("_n"), *(F.col(m).alias(f"_{m}") for m in measures))
    x = arms.join(F.broadcast(base.limit(1)), F.lit(True), "left")
    fair = (F.col(count) == F.col("_n")) & (F.col("_n") > 0)
    out = {"comparable": F.coalesce(fair, F.lit(False))}
    for m in measures:
        out[f"{m}_delta"] = F.when(fair, F.col(m) - F.col(f"_{m}"))
        out[f"{m}_ratio"] = F.when(fair, ratio(F.col(m).cast("double"), F.col(f"_{m}").cast("double")))
    return x.withColumns(out).drop("_n", *(f"_{m}" for m in measures))


def counter_deltas(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, delta): after minus before of counters (keys, name, value); null if one is missing or it fell."""
    x = before.withColumnRenamed("value", "_b").join(after.withColumnRenamed("value", "_a"), [*keys, "name"], "full")
    return x.select(*keys, "name", F.when(F.col("_a") >= F.col("_b"), F.col("_a") - F.col("_b")).alias("delta"))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where("_r = 1").drop("_r")
