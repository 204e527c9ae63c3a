"""Context runtime over observations of a task: tiers, views, planners and switches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KIND_WEIGHT = {"source": 1.2, "traceback": 1.5, "test_log": 1.4, "diff": 1.5, "search": 1.0, "tree": 0.8, "generic": 1.0}


def tiers(df: DataFrame, task: str, order: str, *, hot: int = 2) -> DataFrame:
    """`recency` from 0 for the newest, and `tier`: the newest `hot` observations of a task are HOT, the others COLD."""
    x = df.withColumn("recency", F.row_number().over(Window.partitionBy(task).orderBy(F.desc(order))) - 1)
    return x.withColumn("tier", F.when(F.col("recency") < hot, "HOT").otherwise("COLD"))


def follow_ups(events: DataFrame, task: str, order: str) -> DataFrame:
    """Actions (rows whose type is 'action') with `follows`: the latest observation before each in its task."""
    last = F.last(F.when(F.col("type") == "observation", F.col(order)), ignorenulls=True).over(Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("follows", last).where("type = 'action'")


def recent_context(messages: DataFrame, task: str, *order: str, text_col: str = "text", last: int = 3, each: int = 1000, most: int = 2500) -> DataFrame:
    """`recent`: the ends of a task's last messages up to each one, a line between; messages without text are passed over."""
    by = Window.partitionBy(task).orderBy(*order).rowsBetween(1 - last, 0)
    ends = F.collect_list(F.right(F.col(text_col), F.lit(each))).over(by)
    return messages.withColumn("recent", F.right(F.array_join(ends, "\n"), F.lit(most)))


def view_switches(views: DataFrame, *by: str, order: str) -> DataFrame:
    """`switched`: whether the view's fingerprint differs from the one before; a first one is no switch."""
    before = F.lag("fingerprint").over(Window.partitionBy(*by).orderBy(order))
    return views.withColumn("switched", F.coalesce(before != F.col("fingerprint"), F.lit(False)))


def text_views(df: DataFrame, *id_cols: str, text_col: str = "text") -> DataFrame:
    """(ids, level, view, tokens): reference, skeleton, focused and full views; a compact one has to be shorter than the text."""

    def levels(lines: Column) -> Column:
        n = F.size(lines)
        skeleton = F.when(n > 2, F.array(F.get(lines, F.lit(0)), F.get(lines, n - 1))).otherwise(lines)
        focused = F.filter(lines, lambda x, i: (i % 2 == 0) | (i == n - 1))
        each = [F.concat(F.lit("<observation of "), n.cast("string"), F.lit(" lines>")), F.array_join(skeleton, "\n"), F.array_join(focused, "\n"), F.col(text_col)]
        return F.array(*(F.struct(F.lit(k).alias("level"), v.alias("view")) for k, v in enumerate(each)))

    x = df.select(*id_cols, F.length(text_col).alias("_n"), F.explode(T.let(T.split_lines(F.col(text_col)), levels)).alias("v"))
    return x.where((F.col("v.level") == 3) | (F.length("v.view") < F.col("_n"))).select(*id_cols, "v.level", "v.view", T.token_estimate_max(F.col("v.view")).alias("tokens"))


def full_views(df: DataFrame, *id_cols: str, text_col: str = "text") -> DataFrame:
    """(ids, level, view, tokens): the full views of text_views() only, without making the others."""
    return df.select(*id_cols, F.lit(3).alias("level"), F.col(text_col).alias("view"), T.token_estimate_max(F.col(text_col)).alias("tokens"))


def minimum_views(views: DataFrame, *id_cols: str) -> DataFrame:
    """The view of the fewest tokens of each observation; the lower level on ties."""
    return views.groupBy(*id_cols).agg(F.min_by("level", F.struct("tokens", "level")).alias("level"), F.min("tokens").alias("tokens"))


def budget(full: Column, mode: str, *, retention: float = 0.6, fixed: int = 0, limit: int = 32768, reserved: int = 4096, other: Column | None = None) -> Column:
    """Tokens that the observations may have: all, a share (halves to even), a fixed number, or what a context limit leaves."""
    if mode == "passthrough":
        return full
    if mode == "retention":
        return F.bround(full * retention, 0).cast("bigint")
    if mode == "fixed":
        return F.lit(fixed).cast("bigint")
    return F.greatest(F.lit(0), F.lit(limit - reserved) - (other if other is not None else F.lit(0))).cast("bigint")


def greedy_plan(views: DataFrame, task: str, *, id_col: str, retention: float = 0.6) -> DataFrame:
    """(task, id, level, tokens) chosen from (task, id, level, tokens, importance, recency).

    All start at their cheapest view.  Of all steps up by one, the one with the
    best importance times level gain per token is taken if it fits the budget
    (then the more recent, then the larger id), until none fits.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ladders: dict[int, list[tuple[int, int]]] = {}
        meta = {}
        for r in part.sort_values([id_col, "level"]).itertuples():
            i = getattr(r, id_col)
            meta[i] = (r.importance, r.recency)
            steps = ladders.setdefault(i, [])
            if steps and r.tokens <= steps[-1][1]:
                steps[-1] = (r.level, r.tokens)
            else:
                steps.append((r.level, r.tokens))
        full = int(part[part["level"] == 3]["tokens"].sum())
        most, at = round(full * retention), dict.fromkeys(ladders, 0)
        used = sum(s[0][1] for s in ladders.values())
        while True:
            ups = []
            for i, s in ladders.items():
                if at[i] + 1 < len(s):
                    (a, x), (b, y) = s[at[i]], s[at[i] + 1]
                    ups.append((meta[i][0] * (b - a) / max(1, y - x), -meta[i][1], i, y - x))
            fit = [u for u in sorted(ups, reverse=True) if used + u[3] <= most]
            if not fit:
                break
            at[fit[0][2]] += 1
            used += fit[0][3]
        return pd.DataFrame([(key[0], i, *s[at[i]]) for i, s in ladders.items()], columns=[task, id_col, "level", "tokens"])

    kinds = [views.select(c).schema[0].dataType.simpleString() for c in (task, id_col)]
    return views.groupBy(task).applyInPandas(run, f"{task} {kinds[0]}, {id_col} {kinds[1]}, level int, tokens bigint")


def ablation_matrix(spark, axes: dict[str, list[str]]) -> DataFrame:
    """Every combination of the axes' values, and its slug."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} string")
        out = one if out is None else out.crossJoin(one)
    return out.withColumn("slug", T.slug(F.concat_ws(" ", *axes)))


def locate_boundary(df: DataFrame) -> DataFrame:
    """`prefix` and `suffix` around the raw output in a message (content, raw): inside <output> tags if it is there, else its only place; null if unsure."""
    tagged = F.concat(F.lit("<output>\n"), F.col("raw"), F.lit("\n</output>"))
    at, plain = F.instr(F.col("content"), tagged), F.instr(F.col("content"), F.col("raw"))
    again = F.instr(F.substring(F.col("content"), plain + 1, F.length("content")), F.col("raw"))
    start = F.when(at > 0, at + 9).when((plain > 0) & (again == 0) & (F.length("raw") > 0), plain)
    return df.withColumns({"prefix": F.substring(F.col("content"), F.lit(1), start - 1), "suffix": F.substring(F.col("content"), start + F.length("raw"), F.length("content"))})
