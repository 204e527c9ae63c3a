"""Budgets, budgeted selection and rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_lines(n: Column, keep_ratio: Column, *, min_lines: Column | int = 1, max_lines: Column | int | None = None, no_prune_below: Column | int = 20) -> Column:
    """How many of n lines to keep; halves round to even, texts of at most no_prune_below lines stay whole."""
    low = F.lit(min_lines) if isinstance(min_lines, int) else min_lines
    want = F.greatest(low.cast("bigint"), F.bround(n * keep_ratio, 0).cast("bigint"))
    if max_lines is not None:
        want = F.least(want, (F.lit(max_lines) if isinstance(max_lines, int) else max_lines).cast("bigint"))
    whole = n <= (F.lit(no_prune_below) if isinstance(no_prune_below, int) else no_prune_below)
    return F.when(whole, n.cast("bigint")).otherwise(F.greatest(F.lit(0), F.least(n.cast("bigint"), want)))


def length_band_ratio(n: Column, bands: Sequence[tuple[int | None, float]] = ((20, 1.0), (80, 0.7), (200, 0.45), (None, 0.3))) -> Column:
    """The ratio of the first band whose limit is at least n."""
    out = F.lit(bands[-1][1])
    for limit, ratio in reversed(bands[:-1]):
        out = F.when(n <= limit, F.lit(ratio)).otherwise(out)
    return out


def expand(df: DataFrame, *id_cols: str, radius: int | Column, by: str = "line_no") -> DataFrame:
    """(ids, line, distance): the least distance of each line within the radius of a row's line, from 1 to n_lines."""
    r = F.lit(radius) if isinstance(radius, int) else radius
    low, high = F.greatest(F.lit(1), F.col(by) - r), F.least(F.col("n_lines"), F.col(by) + r)
    near = df.where(low <= high).select(*id_cols, F.col(by).alias("_at"), F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias(by))
    return near.groupBy(*id_cols, by).agg(F.min(F.abs(F.col(by) - F.col("_at"))).alias("distance"))


def select_lines(scored: DataFrame, *id_cols: str, window: int = 1) -> DataFrame:
    """The kept rows of lines (ids, line_no, n_lines, score, mandatory, seed, target); without the column seed there are no seeds.

    Mandatory lines come first, then lines within `window` of a seed by score and
    distance, then the others by score; ties go to the earlier line.  Scores are
    compared to nine decimals.
    """
    if "seed" in scored.columns:
        by, at = Window.partitionBy(*id_cols).orderBy("line_no"), F.when(F.col("seed"), F.col("line_no"))
        before, after = F.max(at).over(by.rangeBetween(-window, 0)), F.min(at).over(by.rangeBetween(0, window))
        x = scored.withColumn("distance", F.least(F.col("line_no") - before, after - F.col("line_no")))
    else:
        x = scored.withColumn("distance", F.lit(None).cast("int"))
    tier = F.when(F.col("mandatory"), 0).when(F.col("distance").isNotNull(), 1).otherwise(2)
    order = Window.partitionBy(*id_cols).orderBy(tier, F.round("score", 9).desc(), F.when(tier == 1, F.col("distance")).otherwise(0), "line_no")
    return x.withColumn("_r", F.row_number().over(order)).where("_r <= target").drop("_r", "distance")


def nucleus(scored: DataFrame, *id_cols: str, top_p: float = 0.9, by: str = "line_no") -> DataFrame:
    """The rows of the highest scores whose share reaches top_p, the one that crosses it included; only the first if nothing is positive."""
    order = Window.partitionBy(*id_cols).orderBy(F.col("score").desc(), by)
    total = F.sum("score").over(Window.partitionBy(*id_cols))
    before = F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("score")
    x = scored.withColumns({"_t": total, "_b": before, "_r": F.row_number().over(order)})
    return x.where((F.col("_r") == 1) | ((F.col("_t") > 0) & (F.col("_b") < top_p * F.col("_t") - 1e-12))).drop("_t", "_b", "_r")


def fill_until(ranked: DataFrame, *id_cols: str, target: str = "target", size: str = "size", order: str = "rank", start: Column | int = 0) -> DataFrame:
    """Rows in their order until their sizes reach the target, the one that crosses it included."""
    w = Window.partitionBy(*id_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(size).over(w), F.lit(0)) + (F.lit(start) if isinstance(start, int) else start)
    return ranked.withColumn("_b", begun).where(F.col("_b") < F.col(target)).drop("_b")


def render_skeleton(kept: DataFrame, *id_cols: str, numbers: bool = True) -> DataFrame:
    """(ids, rendered) of kept lines (ids, line_no, n_lines, line): gaps are told as `<N lines pruned>`."""
    w = Window.partitionBy(*id_cols).orderBy("line_no")
    gap = F.col("line_no") - F.coalesce(F.lag("line_no").over(w), F.lit(0)) - 1
    number = F.when(F.length(F.col("line_no").cast("string")) < 6, F.lpad(F.col("line_no").cast("string"), 6, " ")).otherwise(F.col("line_no").cast("string"))
    text = F.concat(number, F.lit(" | "), F.col("line")) if numbers else F.col("line")
    marker = lambda n: F.concat(F.lit("<"), n.cast("string"), F.lit(" lines pruned>"))
    x = kept.withColumn("_t", F.when(gap > 0, F.concat(marker(gap), F.lit("\n"), text)).otherwise(text))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "_t")))["_t"], "\n")
    tail = F.max("n_lines") - F.max("line_no")
    return x.groupBy(*id_cols).agg(F.when(tail > 0, F.concat(body, F.lit("\n"), marker(tail))).otherwise(body).alias("rendered"))


def render_omissions(lines: DataFrame, *id_cols: str, label: str = "context") -> DataFrame:
    """(ids, body) of lines (ids, line_no, line, keep): what is left out is told as `... [LABEL omitted lines A-B] ...`."""
    by = Window.partitionBy(*id_cols).orderBy("line_no")
    left = F.min(F.when(F.col("keep"), F.col("line_no"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("line_no").over(Window.partitionBy(*id_cols))
    first = F.coalesce(F.lag("keep").over(by), F.lit(True))
    x = lines.withColumns({"_first": first, "_end": F.coalesce(left - 1, last)})
    number = lambda c: F.col(c).cast("string")
    what = F.when(F.col("line_no") == F.col("_end"), F.concat(F.lit("line "), number("line_no"))).otherwise(F.concat(F.lit("lines "), number("line_no"), F.lit("-"), number("_end")))
    text = F.when(F.col("keep"), F.col("line")).when(F.col("_first"), F.concat(F.lit(f"... [{label} omitted "), what, F.lit("] ...")))
    parts = F.collect_list(F.when(text.isNotNull(), F.struct("line_no", text.alias("t"))))
    return x.groupBy(*id_cols).agg(F.array_join(F.array_sort(parts)["t"], "\n").alias("body"))


def render_compacted(lines: DataFrame, id_col: str, *, raw_id: Column, url: Column, label: str = "compaction") -> DataFrame:
    """(id, rendered) of lines (id, line_no, line, keep) under a header that tells how to get the whole text back."""
    n = lines.groupBy(id_col).agg(F.count_if("keep").alias("kept"), F.count("*").alias("n"))
    path = F.concat(F.lit(f"/tmp/{label}-"), raw_id, F.lit(".txt"))
    head = F.concat(F.lit(f'<{label} kept_lines="'), F.col("kept").cast("string"), F.lit('" original_lines="'), F.col("n").cast("string"), F.lit('" raw_id="'), raw_id, F.lit('">\nFetch the whole text only if what is left out is needed, and without printing it:\ncurl -fsS \''), url, F.lit("' -o '"), path, F.lit(f"'\nSearch it with rg -n, read some 50 lines at a time with sed -n.\n</{label}>\n"))
    return render_omissions(lines, id_col, label=label).join(n, id_col).select(id_col, F.concat(head, F.col("body")).alias("rendered"))


def render_posterior(lines: DataFrame, commands: DataFrame, id_col: str, *, label: str = "history") -> DataFrame:
    """(id, rendered) of lines (id, line_no, line, keep) under a header with the follow-up's command (id, command), its white space single and 240 characters at most."""
    n = lines.groupBy(id_col).agg(F.count_if("keep").alias("kept"), F.count("*").alias("n"))
    command = F.left(F.btrim(F.regexp_replace(F.coalesce("command", F.lit("")), r"\s+", " ")), F.lit(240))
    asked = F.when(command != "", F.concat(F.lit(": "), command)).otherwise("")
    head = F.concat(F.lit(f'<{label} kept_lines="'), F.col("kept").cast("string"), F.lit('" original_lines="'), F.col("n").cast("string"), F.lit('">\nThis older text was shown whole before the next action; what is left was chosen by that action'), asked, F.lit(f".\n</{label}>\n"))
    return render_omissions(lines, id_col, label=label).join(n, id_col).join(commands.select(id_col, "command"), id_col, "left").select(id_col, F.concat(head, F.col("body")).alias("rendered"))


def read_range(lines: DataFrame, *id_cols: str, start: int = 1, end: int | None = None) -> DataFrame:
    """(ids, text) of lines start to end, both included."""
    some = lines.where(F.col("line_no") >= start)
    some = some if end is None else some.where(F.col("line_no") <= end)
    return some.groupBy(*id_cols).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))


def search(lines: DataFrame, pattern: str, *id_cols: str, regex: bool = False, max_results: int = 50) -> DataFrame:
    """The first max_results matching lines of each text."""
    hit = lines.where(F.col("line").rlike(pattern) if regex else F.contains("line", F.lit(pattern)))
    return hit.withColumn("_r", F.row_number().over(Window.partitionBy(*id_cols).orderBy("line_no"))).where(F.col("_r") <= max_results).drop("_r")
