"""Summaries of agent runs: arms, token use, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def arm_summary(turns: DataFrame) -> DataFrame:
    """(arm, trajectories, calls, tokens ...) of turns (arm, task, turn, role, text, status, saved).

    Calls are counted by trajectory first; savings count compacted turns only.
    """
    one = turns.withColumn("tokens", T.token_estimate_counted(F.coalesce("text", F.lit("")))).groupBy("arm", "task").agg(
        F.count_if(F.col("role") == "assistant").alias("calls"),
        F.sum(F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0)).alias("completion"),
        F.sum(F.when(F.col("role") != "assistant", F.col("tokens")).otherwise(0)).alias("prompt"),
        F.sum(F.when(F.col("status") == "compacted", F.col("saved")).otherwise(0)).alias("saved"),
        F.count_if(F.col("status") == "compacted").alias("compacted"),
        F.max("turn").alias("last_turn"),
    )
    return one.groupBy("arm").agg(
        F.count("*").alias("trajectories"),
        F.sum("calls").alias("api_calls"),
        F.sum("prompt").alias("prompt_tokens"),
        F.sum("completion").alias("completion_tokens"),
        F.sum("saved").alias("tokens_saved"),
        F.sum("compacted").alias("compactions"),
        F.avg("last_turn").alias("mean_last_turn"),
        F.array_sort(F.collect_set("task")).alias("tasks"),
    )


def task_sets_equal(arms: DataFrame) -> DataFrame:
    """`same_tasks`: whether each arm has just the tasks of the first arm by name."""
    first = arms.agg(F.min_by("tasks", "arm").alias("_t"))
    return arms.crossJoin(F.broadcast(first)).withColumn("same_tasks", F.col("tasks") == F.col("_t")).drop("_t")


def histogram(df: DataFrame, *by: str, value: str) -> DataFrame:
    """(by, value, n)."""
    return df.groupBy(*by, value).agg(F.count("*").alias("n"))


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(id, n) of ids that are there more than once."""
    return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
