"""Whole rankers and pruners, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines, ranking, selection, tools


def _numbered(requests: DataFrame, *cols: str) -> DataFrame:
    x = lines.split_lines(requests, "request_id", *cols)
    return x.withColumn("n_lines", F.count("*").over(Window.partitionBy("request_id")))


def ir_scores(requests: DataFrame, *, window: int = 1) -> DataFrame:
    """Lines of (request_id, text, query, path) with the weighted sum of BM25, identifiers, path, structure and errors, and neighbour bonuses."""
    near = Window.partitionBy("request_id").orderBy("line_no").rowsBetween(-window, window)
    x = _numbered(requests, "query", "path").withColumn("tokens", F.flatten(F.collect_list(T.word_tokens(F.col("line"))).over(near)))
    text = T.build_query(F.col("query"), F.col("path"), F.lit(""))
    intent = requests.select("request_id", T.word_tokens(text).alias("tokens"))
    x = x.join(ranking.bm25(x, intent, "request_id", "line_no"), ["request_id", "line_no"])
    x = x.withColumns({"query_ids": T.identifiers(F.col("query")), "path_terms": T.path_terms(F.col("path")), "recent_words": F.array().cast("array<string>")})
    x = ranking.ir_components(x).drop("tokens")
    bonus = ranking.neighbour_bonus(x, "request_id", window=window)
    order = Window.partitionBy("request_id").orderBy(F.round("strength", 9).desc(), "line_no")
    x = x.join(bonus, ["request_id", "line_no"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 9))
    structural = F.array_contains("reasons", "structure")
    return x.withColumns({"mandatory": structural, "seed": structural | ((F.col("strength") > 0) & (F.row_number().over(order) <= 8))})


def ast_scores(requests: DataFrame) -> DataFrame:
    """Lines with the scores of the rules for their kind of output; the query and trees aside."""
    return tools.execution_rules(_numbered(tools.detect_tool_type(requests), "tool_type"), "request_id")


def execution_scores(requests: DataFrame) -> DataFrame:
    """Lines with the scores of all rules: of the query's symbols, and for their kind of output."""
    x = _numbered(tools.detect_tool_type(requests), "tool_type", "query").withColumn("_symbols", tools.query_symbols(F.col("query")))
    return tools.execution_rules(x, "request_id", symbols="_symbols").drop("_symbols", "query")


def prune(scores: DataFrame, *, keep_ratio: float = 0.5, no_prune_below: int = 20, window: int = 1) -> DataFrame:
    """The kept lines of scored ones under the budget."""
    target = selection.target_lines(F.col("n_lines"), F.lit(keep_ratio), no_prune_below=no_prune_below)
    return selection.select_lines(scores.withColumn("target", target), "request_id", window=window)


def ir_structural(requests: DataFrame, **budget) -> DataFrame:
    return prune(ir_scores(requests), **budget)


def execution_ast(requests: DataFrame, **budget) -> DataFrame:
    return prune(execution_scores(requests), **budget)


def ir_ast_hybrid(requests: DataFrame, *, ir_weight: float = 0.55, **budget) -> DataFrame:
    """Rank percentiles of both scores, weighted; critical rules' lines have to stay."""
    a = ranking.rank_percentiles(ir_scores(requests), "request_id").select("request_id", "line_no", "n_lines", "line", F.col("percentile").alias("a"), F.col("seed").alias("s"))
    b = ranking.rank_percentiles(execution_scores(requests), "request_id").select("request_id", "line_no", F.col("percentile").alias("b"), "reasons", F.col("seed").alias("t"))
    critical = F.exists("reasons", lambda r: r.rlike("^(?:query_symbol_match|source_error|traceback_|test_|diff_|grep_hit|tree_query_hit)"))
    x = a.join(b, ["request_id", "line_no"]).withColumns({"score": F.round(ir_weight * F.col("a") + (1 - ir_weight) * F.col("b"), 9), "mandatory": critical, "seed": F.col("s") | F.col("t")})
    return prune(x, **budget)


RANKERS = {"ir_structural": ir_structural, "execution_ast": execution_ast, "ir_ast_hybrid": ir_ast_hybrid}
ALIASES = {"ir": "ir_structural", "ast": "execution_ast", "hybrid": "ir_ast_hybrid"}


def ranker(name: str):
    """A ranker by name or alias; case, blanks around and hyphens don't matter."""
    name = name.strip().lower().replace("-", "_")
    name = ALIASES.get(name, name)
    if name not in RANKERS:
        raise ValueError(f"unknown ranker {name!r}; there are: {', '.join(RANKERS)}")
    return RANKERS[name]
