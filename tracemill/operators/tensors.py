"""Hidden-state similarity and attention reductions in long form: one row a number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from . import selection


def pool_vectors(df: DataFrame, *by: str, vector: str, how: str = "mean") -> DataFrame:
    """(by, vector): the mean or maximum of each group's vectors, dimension by dimension."""
    agg = F.avg if how == "mean" else F.max
    each = df.select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("_d", "_v")).groupBy(*by, "_d").agg(agg("_v").alias("_v"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_d", "_v")))["_v"].alias("vector"))


def map_tokens(tokens: DataFrame, *id_cols: str) -> DataFrame:
    """Tokens (ids, token, line, n_lines) on lines counted from 1: counted from 0 if the least is 0 and none is n_lines; others go."""
    by = Window.partitionBy(*id_cols)
    some = tokens.where("line >= 0")
    zero = (F.min("line").over(by) == 0) & (F.max("line").over(by) < F.col("n_lines"))
    return some.withColumn("line_no", F.when(zero, F.col("line") + 1).otherwise(F.col("line"))).where("line_no between 1 and n_lines").drop("line")


def anchor_similarity(lines: DataFrame, anchors: DataFrame, *id_cols: str) -> DataFrame:
    """(ids, line_no, score): weighted mean of the cosines of line vectors to the anchors (ids, vector, weight) that are there."""
    x = lines.join(anchors.withColumnRenamed("vector", "_a"), list(id_cols))
    return x.groupBy(*id_cols, "line_no").agg((F.sum(F.col("weight") * cosine(F.col("vector"), F.col("_a"))) / F.sum("weight")).alias("score"))


def reduce(df: DataFrame, keep: list[str], axis: str, how: str, decay: float = 1.0) -> DataFrame:
    """df with an axis reduced by mean, max, sum or decay-weighted mean of `value`; the order of reductions matters."""
    if how == "weighted":
        w = F.pow(F.lit(decay), F.row_number().over(Window.partitionBy(*keep).orderBy(axis)) - 1)
        return df.withColumn("_w", w).groupBy(*keep).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))
    agg: dict[str, Column] = {"mean": F.avg("value"), "max": F.max("value"), "sum": F.sum("value")}
    return df.groupBy(*keep).agg(agg[how].alias("value"))


def attention_mass(df: DataFrame, *id_cols: str, steps: str = "mean", heads: str = "mean", layers: str = "mean", decay: float = 1.0) -> DataFrame:
    """(ids, token, value) of (ids, layer, head, step, token, value): negatives as 0, then steps, heads and layers reduced in this order."""
    x = df.withColumn("value", F.greatest("value", F.lit(0.0)))
    x = reduce(x, [*id_cols, "layer", "head", "token"], "step", steps, decay)
    x = reduce(x, [*id_cols, "layer", "token"], "head", heads, decay)
    return reduce(x, [*id_cols, "token"], "layer", layers, decay)


def line_attention(mass: DataFrame, mapping: DataFrame, *id_cols: str) -> DataFrame:
    """(ids, line_no, score): mass summed by line over the tokens that aren't sinks, over the largest line's."""
    x = mass.join(mapping.where("NOT sink"), [*id_cols, "token"]).groupBy(*id_cols, "line_no").agg(F.sum("value").alias("_v"))
    top = F.max("_v").over(Window.partitionBy(*id_cols))
    return x.select(*id_cols, "line_no", F.when(top > 0, F.col("_v") / top).otherwise(0.0).alias("score"))


def attention_rollout(df: DataFrame, id_col: str, *, residual: float = 1.0) -> DataFrame:
    """(id, token, value) of (id, layer, head, query, key, value): head means, residual, rows to sum 1, product of the layers; the last row."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        size = int(max(part["query"].max(), part["key"].max())) + 1
        out = np.eye(size)
        for _, layer in part.groupby("layer"):
            m = np.zeros((size, size))
            mean = layer.groupby(["query", "key"])["value"].mean()
            m[mean.index.get_level_values(0), mean.index.get_level_values(1)] = np.maximum(mean.to_numpy(), 0)
            m += residual * np.eye(size)
            total = m.sum(1, keepdims=True)
            out = np.divide(m, total, out=np.zeros_like(m), where=total > 0) @ out
        return pd.DataFrame({id_col: key[0], "token": range(size), "value": out[-1]})

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.groupBy(id_col).applyInPandas(run, f"{id_col} {kind}, token bigint, value double")


def leave_one_out(blocks: DataFrame, scorer, id_col: str, block_col: str, text_col: str = "text") -> DataFrame:
    """(id, block, harm): the scorer's value of all blocks' text less that of the text without the block.

    scorer(texts: Iterator[pd.Series]) -> Iterator[pd.Series] is made once in each worker.
    """
    by = Window.partitionBy(id_col)
    order = F.array_sort(F.collect_list(F.struct(block_col, text_col)).over(by))
    x = blocks.withColumn("_all", order)
    join = lambda a: F.array_join(F.transform(a, lambda b: b[text_col]), "\n")
    score = F.pandas_udf(scorer, "double")
    x = x.select(id_col, block_col, join(F.col("_all")).alias("_full"), join(F.filter("_all", lambda b: b[block_col] != F.col(block_col))).alias("_less"))
    return x.select(id_col, block_col, (score("_full") - score("_less")).alias("harm"))


def lexical_scorer(words: list[str]):
    """A scorer for tests: 10 for each of the words that is in the text."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda t: 10.0 * sum(w in t for w in words))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def greedy_deletion(blocks: DataFrame, score, id_col: str, *, keep: int) -> DataFrame:
    """(id, block, step): blocks deleted one at a time, the one whose loss harms the score(text) least first (ties: the later), until `keep` are left."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        left = list(part.sort_values("block")[["block", "text"]].itertuples(index=False, name=None))
        gone = []
        while len(left) > keep:
            trial = [(score("\n".join(t for j, (_, t) in enumerate(left) if j != i)), i) for i in range(len(left))]
            i = max(trial)[1]
            gone.append((key[0], left.pop(i)[0], len(gone) + 1))
        return pd.DataFrame(gone, columns=[id_col, "block", "step"])

    kind = blocks.select(id_col).schema[0].dataType.simpleString()
    return blocks.groupBy(id_col).applyInPandas(run, f"{id_col} {kind}, block bigint, step bigint")


def axis_indices(selector: str | int | list[int], size: int) -> list[int]:
    """Sorted indices of an axis: all, first, last, first-N, last-N, numbers with commas, a list or a number; negative ones count from the end."""
    if size <= 0:
        raise ValueError("an axis must not be empty")
    if isinstance(selector, str):
        word, _, count = selector.lower().partition("-")
        if word in ("all", "first", "last") and (count or selector.lower() == word):
            n = size if word == "all" else int(count or 1)
            found = list(range(max(0, size - n), size)) if word == "last" else list(range(min(size, n)))
        else:
            found = [int(x) for x in selector.split(",") if x]
    else:
        found = list(selector) if isinstance(selector, (list, tuple)) else [int(selector)]
    found = [x + size if x < 0 else x for x in found]
    if not found or min(found) < 0 or max(found) >= size:
        raise ValueError("the selector is empty or out of range")
    return sorted(set(found))


def axis_layout(given: str | None, ndim: int, *, rollout: bool = False) -> tuple[str, ...]:
    """The axes' names: those given, by name or alias, or the usual ones of so many dimensions."""
    usual = ("batch", "layers", "heads", "queries", "keys") if rollout else ("batch", "layers", "heads", "steps", "tokens")
    if given is None:
        if not (3 if rollout else 1) <= ndim <= 5:
            raise ValueError(f"no usual layout has {ndim} dimensions")
        return ("layers", "queries", "keys") if rollout and ndim == 3 else usual[5 - ndim :]
    short = {"b": "batch", "l": "layers", "layer": "layers", "h": "heads", "head": "heads", "s": "steps", "step": "steps", "t": "tokens", "token": "tokens", "q": "queries", "query": "queries", "k": "keys", "key": "keys"}
    axes = tuple(short.get(x, x) for x in given.replace(",", " ").split())
    if len(axes) != ndim or len(set(axes)) != ndim:
        raise ValueError("the layout must name each dimension once")
    return axes


def is_rectangular(rows: Column) -> Column:
    """Whether an array's arrays are all of one size, and there are any."""
    return F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) == 1


def with_floors(scored: DataFrame, *id_cols: str, structure: float = 0.08, seeds: int = 3, window: int = 1, local: float = 0.04) -> DataFrame:
    """`score` of lines (ids, line_no, n_lines, score, structural), raised to a floor on structural lines, then near the best lines."""
    x = scored.withColumn("score", F.when(F.col("structural"), F.greatest("score", F.lit(structure))).otherwise(F.col("score")))
    order = Window.partitionBy(*id_cols).orderBy(F.desc("score"), "line_no")
    x = x.withColumn("_seed", (F.row_number().over(order) <= seeds).cast("int"))
    near = F.max("_seed").over(Window.partitionBy(*id_cols).orderBy("line_no").rangeBetween(-window, window)) == 1
    return x.withColumn("score", F.when(near, F.greatest("score", F.lit(local))).otherwise(F.col("score"))).drop("_seed")


def select_by_mode(scored: DataFrame, *id_cols: str, mode: str, top_p: float = 0.9, window: int = 1, no_prune_below: int = 20) -> DataFrame:
    """The kept lines of (ids, line_no, n_lines, score, target): by the budget (hard_budget), with the nucleus expanded (hybrid), or as many as the nucleus has, if that is less (top_p)."""
    core = selection.nucleus(scored, *id_cols, top_p=top_p).select(*id_cols, "line_no", F.lit(True).alias("_core"))
    x = scored.join(core, [*id_cols, "line_no"], "left").withColumns({"mandatory": F.lit(False), "_core": F.coalesce("_core", F.lit(False))})
    whole = F.col("n_lines") <= no_prune_below
    x = x.withColumn("seed", F.lit(mode != "hard_budget") & F.col("_core") & ~whole)
    if mode == "top_p":
        n = F.count_if("_core").over(Window.partitionBy(*id_cols))
        x = x.withColumn("target", F.when(whole, F.col("target")).otherwise(F.least(n, F.col("target"))))
    return selection.select_lines(x, *id_cols, window=window).drop("mandatory", "seed", "_core")
