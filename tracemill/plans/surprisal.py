"""Ranking by a conditional scorer, blocks first and then lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import checked
from ..operators import lines, ranking
from .rankers import prune


def word_overlap_scorer():
    """A deterministic scorer for tests: the share of the continuation's words that are in the context."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for context, continuation in parts:
            yield pd.Series([len(set(c.lower().split()) & (w := set(t.lower().split()))) / max(1, len(w)) for c, t in zip(context, continuation)], dtype="float64")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return run


def conditional_surprisal(requests: DataFrame, scorer, *, max_lines: int = 24, fraction: float = 0.5, before: int = 2, **budget) -> DataFrame:
    """The kept lines of (request_id, text, query): blocks' scores given the query, then those of the best blocks' lines given the lines before them.

    A line of a block in the top fraction (at least one) or with an anchor gets
    0.35 of the block's and 0.65 of its own score, others 0.35 of the block's.
    Lines with errors or structure have to stay.  scorer works on batches of
    (context, continuation) and is made once in each worker.
    """
    score = F.pandas_udf(scorer, "double")
    x = lines.split_lines(requests, "request_id", "query").withColumn("n_lines", F.count("*").over(Window.partitionBy("request_id")))
    x = x.withColumn("anchor", F.col("line").rlike(T.A_ERROR) | F.col("line").rlike(T.A_STRUCTURE))
    blocks = lines.paragraph_blocks(x.select("request_id", "line_no", "line"), "request_id", max_lines=max_lines)
    inside = blocks.select("request_id", "block", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    y = x.join(inside, ["request_id", "line_no"], "left")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    coarse = y.where("block IS NOT NULL").groupBy("request_id", "query", "block").agg(text.alias("text"), F.max("anchor").alias("anchored")).withColumn("coarse", checked(score("query", "text")))
    by = Window.partitionBy("request_id")
    order = by.orderBy(F.round("coarse", 9).desc(), "block")
    coarse = coarse.withColumn("top", (F.row_number().over(order) <= F.greatest(F.lit(1), F.ceil(F.count("*").over(by) * fraction))) | F.col("anchored"))
    near = by.orderBy("line_no").rowsBetween(-before, -1)
    z = y.withColumn("_c", F.concat_ws("\n", "query", F.array_join(F.collect_list("line").over(near), "\n"))).join(coarse.select("request_id", "block", "coarse", "top"), ["request_id", "block"], "left")
    fine = z.where("top").select("request_id", "line_no", checked(score("_c", "line")).alias("fine"))
    z = z.join(fine, ["request_id", "line_no"], "left")
    total = 0.35 * F.coalesce("coarse", F.lit(0.0)) + 0.65 * F.coalesce("fine", F.lit(0.0))
    return prune(z.select("request_id", "line_no", "n_lines", "line", F.round(total, 9).alias("score"), F.col("anchor").alias("mandatory"), F.lit(False).alias("seed")), **budget)


def hybrid_scores(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """Two score tables (request_id, line_no, score) as one of weighted rank percentiles."""
    p = ranking.rank_percentiles(a, "request_id").select("request_id", "line_no", F.col("percentile").alias("a"))
    q = ranking.rank_percentiles(b, "request_id").select("request_id", "line_no", F.col("percentile").alias("b"))
    return p.join(q, ["request_id", "line_no"]).select("request_id", "line_no", (weight * F.col("a") + (1 - weight) * F.col("b")).alias("score"))
