"""Selections that depend on what was chosen before, and compaction of old observations by what followed them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import POSTERIOR_HARD, POSTERIOR_SPECIAL, evidence_blocks, split_lines
from .tools import classify_output

SOFT_CAP = {"source": 12, "diff": 0, "traceback": 12, "test_log": 12, "search": 16, "tree": 10, "generic": 8}
RADIUS = {"source": 1, "traceback": 2, "test_log": 2}


def adaptive_evidence(ranked: DataFrame, id_col: str) -> DataFrame:
    """(id, block, why) kept of ranked blocks (id, kind, block, is_hard, reasons, found, identifier_hits, rrf, rank); found: their intent terms.

    Hard blocks stay.  Then, up to the kind's soft cap: blocks that cover the
    most terms not covered yet, then positive blocks by rank (once two soft ones
    are kept, only those with an identifier).  Last come the neighbours of the
    relevant blocks, or of hard ones that aren't mere structure if there are none.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = part.set_index("block").sort_index()
        kind = rows["kind"].iloc[0]
        cap, kept = SOFT_CAP[kind], {b: "hard" for b in rows.index[rows["is_hard"]]}
        covered = {t for b in kept for t in rows.at[b, "found"]}
        soft: list[int] = []
        while len(soft) < cap:
            gain = [(len(set(r.found) - covered), r.identifier_hits, r.rrf, -b) for b, r in rows.iterrows() if b not in kept]
            best = max(gain, default=(0,))
            if best[0] == 0:
                break
            b = -best[3]
            kept[b] = "term"
            covered |= set(rows.at[b, "found"])
            soft.append(b)
        for b, r in rows.sort_values("rank").iterrows():
            if len(soft) >= cap:
                break
            if b not in kept and r.rrf > 0 and (len(soft) < 2 or r.identifier_hits > 0):
                kept[b] = "rank"
                soft.append(b)
        seeds = [b for b in rows.index if b in kept and len(rows.at[b, "found"])] or [b for b, w in kept.items() if w == "hard" and set(rows.at[b, "reasons"]) - {"structure"}]
        for b in seeds:
            for near in range(b - RADIUS.get(kind, 0), b + RADIUS.get(kind, 0) + 1):
                if near in rows.index:
                    kept.setdefault(near, "near")
        return pd.DataFrame([(key[0], b, w) for b, w in sorted(kept.items())], columns=[id_col, "block", "why"])

    kind = ranked.select(id_col).schema[0].dataType.simpleString()
    return ranked.groupBy(id_col).applyInPandas(run, f"{id_col} {kind}, block bigint, why string")


def cap_output(kept: DataFrame, id_col: str, *, max_chars: int = 9000) -> DataFrame:
    """The kept blocks (id, block, is_hard, rrf, text) that fit max_chars: hard ones first, then by score; one that doesn't fit is passed over."""
    order = F.array_sort(F.collect_list(F.struct((~F.col("is_hard")).alias("a"), (-F.col("rrf")).alias("b"), "block", (F.length("text") + 1).alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("blocks"))
    fits = lambda x, r: x["used"] + r["n"] <= max_chars
    fold = F.aggregate("o", start, lambda x, r: F.struct(F.when(fits(x, r), x["used"] + r["n"]).otherwise(x["used"]).cast("bigint").alias("used"), F.when(fits(x, r), F.concat(x["blocks"], F.array(r["block"].cast("bigint")))).otherwise(x["blocks"]).alias("blocks")), lambda x: x["blocks"])
    some = kept.groupBy(id_col).agg(order.alias("o")).select(id_col, F.explode(fold).alias("block"))
    return kept.join(some, [id_col, "block"], "left_semi")


def posterior_compaction(df: DataFrame, id_col: str, *, method: str = "adaptive", min_tokens: int = 1500, min_savings: int = 256, max_retention: float = 0.85, max_chars: int = 9000, max_lines: int = 16) -> DataFrame:
    """(id, status, reason, n_lines, kept_lines, compact) of observations (id, text, command, path, posterior).

    The posterior is what the next action said.  Its terms that are in at most
    max(2, (blocks + 9) div 10) blocks mark what has to stay besides hard blocks,
    with neighbours by kind.  The first gate that holds leaves the text whole.
    """
    kinds = classify_output(df, paths_in_command=False)
    b = evidence_blocks(split_lines(kinds, id_col, "kind"), id_col, max_lines=max_lines, special=POSTERIOR_SPECIAL, hard=POSTERIOR_HARD)
    by = Window.partitionBy(id_col)
    b = b.withColumns({"n": F.count("*").over(by), "size": F.col("end_line") - F.col("start_line") + 1})
    each = b.select(id_col, "block", "n", F.explode(T.term_set(F.col("text"))).alias("term"))
    wanted = df.select(id_col, F.explode(T.term_set(F.coalesce("posterior", F.lit("")))).alias("term"))
    df_ = F.count("*").over(Window.partitionBy(id_col, "term"))
    hit = each.withColumn("df", df_).where(F.col("df") <= F.greatest(F.lit(2), F.floor((F.col("n") + 9) / 10))).join(wanted, [id_col, "term"], "left_semi").select(id_col, "block").distinct().withColumn("hit", F.lit(True))
    x = b.join(hit, [id_col, "block"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    place = by.orderBy("block")
    near = lambda r: F.max(F.col("hit").cast("int")).over(place.rowsBetween(-r, r)) == 1
    keep = F.col("is_hard") | F.when(F.col("kind") == "source", near(1)).when(F.col("kind").isin("traceback", "test_log"), near(2)).otherwise(F.col("hit"))
    x = x.withColumn("keep", keep)
    whole = x.groupBy(id_col).agg(F.sum("size").alias("n_lines"), F.sum(F.when(F.col("keep"), F.col("size")).otherwise(0)).alias("kept_lines"), F.max("hit").alias("any_hit"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("block", "text"))))["text"], "\n").alias("compact"))
    y = kinds.join(whole, id_col, "left")
    text, posterior = F.coalesce("text", F.lit("")), F.coalesce("posterior", F.lit(""))
    before, after = T.token_estimate_max(text), T.token_estimate_max(F.coalesce("compact", F.lit("")))
    reason = (
        F.when(~text.rlike(r"\S"), "empty-observation")
        .when(before < min_tokens, "below-min-input-tokens")
        .when(F.col("kind") == "diff", "diff-is-never-compacted")
        .when(~posterior.rlike(r"\S"), "missing-posterior-signal")
        .when(F.col("n_lines").isNull(), "no-blocks")
        .when(F.lit(method == "adaptive") & ~F.col("any_hit"), "no-posterior-match")
        .when(F.col("kept_lines") >= F.col("n_lines"), "no-safe-reduction")
        .when(F.col("kept_lines") / F.col("n_lines") > max_retention, "retention-above-cost-gate")
        .when(F.length("compact") > max_chars, "output-cap-not-safe")
        .when(before - after < min_savings, "insufficient-token-savings")
        .otherwise("compacted")
    )
    y = y.withColumn("reason", reason)
    done = F.col("reason") == "compacted"
    return y.select(id_col, F.when(done, "compacted").otherwise("unchanged").alias("status"), "reason", "n_lines", F.when(done, F.col("kept_lines")).otherwise(F.col("n_lines")).alias("kept_lines"), F.when(done, F.col("compact")).otherwise(text).alias("compact"))
