"""Lines and blocks from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_LOG = ["error", "trace-frame", "source-location", "test-failure"]
_PLAIN = ["error", "source-location", "test-failure"]
#: Reasons that split blocks and reasons that always stay, by kind of output.
SPECIAL = {
    "source": ["structure", "error", "source-location", "diff"],
    "diff": ["diff", "error", "source-location"],
    **dict.fromkeys(("traceback", "test_log"), _LOG),
    **dict.fromkeys(("search", "tree", "generic"), _PLAIN),
}
HARD = SPECIAL | {"source": SPECIAL["source"][:3], "traceback": _LOG[:3]}
#: The same for what later actions compact: stricter with tracebacks, searches and trees.
POSTERIOR_SPECIAL = SPECIAL | {"traceback": _LOG[:3], "search": ["error", "source-location"], "tree": ["error"]}
POSTERIOR_HARD = POSTERIOR_SPECIAL | {"source": SPECIAL["source"][:3]}


def split_lines(df: DataFrame, *id_cols: str, text_col: str = "text") -> DataFrame:
    """(ids, line_no from 1, line); a null or empty text has no lines."""
    return df.select(*id_cols, F.posexplode(T.split_lines(F.col(text_col))).alias("p", "line")).select(*id_cols, (F.col("p") + 1).alias("line_no"), "line")


def paragraph_blocks(lines: DataFrame, *id_cols: str, max_lines: int = 24) -> DataFrame:
    """(ids, block, start_line, end_line): runs of lines that aren't blank, in pieces of at most max_lines."""
    by = Window.partitionBy(*id_cols).orderBy("line_no")
    blank = ~F.col("line").rlike(r"\S")
    islands = lines.withColumn("island", F.sum(blank.cast("int")).over(by)).where(~blank)
    within = Window.partitionBy(*id_cols, "island").orderBy("line_no")
    pieces = islands.withColumn("piece", F.floor((F.row_number().over(within) - 1) / max_lines))
    blocks = pieces.groupBy(*id_cols, "island", "piece").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    order = Window.partitionBy(*id_cols).orderBy("start_line")
    return blocks.select(*id_cols, (F.row_number().over(order) - 1).alias("block"), "start_line", "end_line")


def split_ranges(df: DataFrame, max_lines: int) -> DataFrame:
    """df with each start_line..end_line cut into ranges of at most max_lines."""
    cuts = df.withColumn("_s", F.explode(F.sequence("start_line", "end_line", F.lit(max_lines))))
    return cuts.withColumn("end_line", F.least(F.col("end_line"), F.col("_s") + max_lines - 1)).withColumn("start_line", F.col("_s")).drop("_s")


def gap_blocks(lines: DataFrame, blocks: DataFrame, *id_cols: str, max_lines: int = 24) -> DataFrame:
    """(ids, start_line, end_line) of the runs of lines that no block covers, in pieces."""
    covered = blocks.select(*id_cols, F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
    return runs(lines.join(covered, [*id_cols, "line_no"], "left_anti"), *id_cols).transform(split_ranges, max_lines)


def ends_stay(blocks: DataFrame, *id_cols: str) -> DataFrame:
    """blocks (ids, block, is_hard) with `is_hard` of the first and the last one."""
    by = Window.partitionBy(*id_cols)
    return blocks.withColumn("is_hard", F.col("is_hard") | (F.col("block") == F.min("block").over(by)) | (F.col("block") == F.max("block").over(by)))


def runs(lines: DataFrame, *id_cols: str) -> DataFrame:
    """(ids, start_line, end_line) of each run of line numbers next to each other."""
    by = Window.partitionBy(*id_cols).orderBy("line_no")
    islands = lines.withColumn("_g", F.col("line_no") - F.row_number().over(by))
    return islands.groupBy(*id_cols, "_g").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("_g")


def omitted_ranges(lines: DataFrame, kept: DataFrame, *id_cols: str) -> DataFrame:
    """(ids, start_line, end_line) of what was left out."""
    return runs(lines.join(kept, [*id_cols, "line_no"], "left_anti"), *id_cols)


def disjoint_blocks(blocks: DataFrame, *id_cols: str) -> DataFrame:
    """The blocks that begin after all earlier ones' ends: nested ones go."""
    before = Window.partitionBy(*id_cols).orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_m", F.max("end_line").over(before)).where("_m IS NULL OR start_line > _m").drop("_m")


def _by_kind(table: dict[str, list[str]], kind: str = "kind"):
    out = F.array().cast("array<string>")
    for k, v in table.items():
        out = F.when(F.col(kind) == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def evidence_blocks(lines: DataFrame, *id_cols: str, max_lines: int = 16, special: dict[str, list[str]] = SPECIAL, hard: dict[str, list[str]] = HARD) -> DataFrame:
    """(ids, kind, block, start_line, end_line, reasons, is_hard) of lines (ids, kind, line_no, line).

    A line with a special reason is a block of its own; the others are cut into
    pieces of at most max_lines.  Blocks with a hard reason, and the first and
    the last, have to stay.
    """
    by = Window.partitionBy(*id_cols).orderBy("line_no")
    x = lines.withColumn("reasons", F.array_intersect(T.line_reasons(F.col("line")), _by_kind(special)))
    x = x.withColumn("special", F.size("reasons") > 0).withColumn("island", F.sum(F.col("special").cast("int")).over(by))
    within = Window.partitionBy(*id_cols, "island", "special").orderBy("line_no")
    x = x.withColumn("piece", F.floor((F.row_number().over(within) - 1) / max_lines))
    b = x.groupBy(*id_cols, "kind", "island", "special", "piece").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.first("reasons").alias("reasons"), F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    order = Window.partitionBy(*id_cols).orderBy("start_line")
    b = b.withColumn("block", F.row_number().over(order) - 1).withColumn("n_blocks", F.count("*").over(Window.partitionBy(*id_cols)))
    stays = F.arrays_overlap("reasons", _by_kind(hard)) | F.col("block").isin(0) | (F.col("block") == F.col("n_blocks") - 1)
    return b.select(*id_cols, "kind", "block", "start_line", "end_line", "reasons", stays.alias("is_hard"), "text")


def block_lines(blocks: DataFrame, *id_cols: str) -> DataFrame:
    """(ids, line_no) of the blocks' lines."""
    return blocks.select(*id_cols, F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
