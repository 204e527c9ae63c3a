"""Sparse retrieval, rank fusion and pooled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def bm25(documents: DataFrame, queries: DataFrame, group: str, doc: str, *, k1: float = 1.2, b: float = 0.75, least_average: float = 0.0) -> DataFrame:
    """(group, doc, bm25) of every document (group, doc, tokens) for its group's query (group, tokens); 0 without a common term.

    Only the query's terms are counted, and one pass gives term and document
    frequencies; lengths count all tokens.
    """
    q = queries.select(group, F.explode("tokens").alias("term")).groupBy(group, "term").agg(F.count("*").alias("qtf"))
    sized = documents.select(group, doc, "tokens", F.size("tokens").alias("len"))
    by = Window.partitionBy(group)
    corpus = sized.withColumns({"n": F.count("*").over(by), "avgdl": F.greatest(F.avg("len").over(by), F.lit(least_average))})
    tf = corpus.select(group, doc, "len", "n", "avgdl", F.explode("tokens").alias("term")).join(q, [group, "term"]).groupBy(group, doc, "term", "qtf", "len", "n", "avgdl").agg(F.count("*").alias("tf"))
    df = F.count("*").over(Window.partitionBy(group, "term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.nullif("avgdl", F.lit(0.0)))) * F.col("qtf")
    scores = tf.withColumn("df", df).groupBy(group, doc).agg(F.sum(part).alias("bm25"))
    return documents.select(group, doc).join(scores, [group, doc], "left").select(group, doc, F.round(F.coalesce("bm25", F.lit(0.0)), 9).alias("bm25"))


def bm25_scores(tokens: Column, query: Column, *, k1: float = 1.2, b: float = 0.75) -> Column:
    """bm25() as an array, of documents given as an array of token arrays, for a query's tokens; 0 for all if the query is null."""
    none = F.array().cast("array<string>")

    def scores(query: Column, terms: Column, found: Column, sizes: Column) -> Column:
        # found: each document's query terms by their positions in terms, repeats included
        n = F.size(sizes)
        avgdl = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))

        def weights(each: Column) -> Column:
            def weight(term: Column, i: Column) -> Column:
                df = F.size(F.filter(each, lambda x: x == i + 1))
                return F.struct(T.let(df, lambda k: F.log(1 + (n - k + 0.5) / (k + 0.5))).alias("idf"), F.size(F.filter(query, lambda x: x == term)).alias("qtf"))

            return F.transform(terms, weight)

        def one(avgdl: Column, w: Column) -> Column:
            def score(f: Column, k: Column) -> Column:
                def part(i: Column) -> Column:
                    of, tf = F.get(w, (i - 1).cast("int")), F.size(F.filter(f, lambda x: x == i))
                    return T.let(tf, lambda tf: of["idf"] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.get(sizes, k) / F.nullif(avgdl, F.lit(0.0)))) * of["qtf"])

                return F.aggregate(F.array_distinct(f), F.lit(0.0), lambda a, i: a + part(i))

            return F.transform(found, score)

        return T.let(avgdl, lambda a: T.let(T.let(F.flatten(F.transform(found, F.array_distinct)), weights), lambda w: one(a, w)))

    def of(query: Column, terms: Column) -> Column:
        at = lambda line: F.filter(F.transform(line, lambda t: F.array_position(terms, t)), lambda i: i > 0)
        return T.let(F.transform(tokens, at), lambda found: T.let(F.transform(tokens, lambda x: F.size(x)), lambda sizes: scores(query, terms, found, sizes)))

    return T.let(F.coalesce(query, none), lambda q: T.let(F.array_distinct(q), lambda terms: of(q, terms)))


def bm25_lines(df: DataFrame, *id_cols: str, query: str, text_col: str = "text") -> DataFrame:
    """(ids, line_no, n_lines, line, score): BM25 of each text's lines among the lines of that text, for the tokens in `query`.

    All of it is told within the row, so nothing is shuffled.
    """

    def rows(lines: Column, tokens: Column) -> Column:
        scores = bm25_scores(tokens, F.col(query))
        return T.let(scores, lambda s: F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.round(F.get(s, i), 9).alias("score"), F.size(lines).cast("bigint").alias("n_lines"))))

    each = T.let(T.split_lines(F.col(text_col)), lambda lines: T.let(F.transform(lines, T.word_tokens), lambda tokens: rows(lines, tokens)))
    return df.select(*id_cols, F.posexplode(each).alias("p", "v")).select(*id_cols, (F.col("p") + 1).alias("line_no"), "v.n_lines", "v.line", "v.score")


def document_frequency(documents: DataFrame, group: str, doc: str) -> DataFrame:
    """(group, term, df)."""
    return documents.select(group, doc, F.explode(F.array_distinct("tokens")).alias("term")).groupBy(group, "term").agg(F.count_distinct(doc).alias("df"))


def rank_percentiles(scored: DataFrame, *id_cols: str, score: str = "score") -> DataFrame:
    """`percentile`: 1 for the highest distinct score down to 0 for the lowest; 1 for all if all tie."""
    dense = F.dense_rank().over(Window.partitionBy(*id_cols).orderBy(F.col(score).desc()))
    x = scored.withColumn("_d", dense)
    top = F.max("_d").over(Window.partitionBy(*id_cols))
    return x.withColumn("percentile", F.when(top == 1, 1.0).otherwise(1 - (F.col("_d") - 1) / (top - 1))).drop("_d")


def reciprocal_rank_fusion(scored: DataFrame, *id_cols: str, components: list[str], by: str, k: int = 60) -> DataFrame:
    """`rrf`: the sum of 1 / (k + rank) over the components that are positive; ties rank by `by`."""
    total = F.lit(0.0)
    for c in components:
        rank = F.row_number().over(Window.partitionBy(*id_cols).orderBy(F.col(c).desc(), by))
        total = total + F.when(F.col(c) > 0, 1 / (k + rank)).otherwise(0.0)
    return scored.withColumn("rrf", total)


def neighbour_bonus(scored: DataFrame, *id_cols: str, seeds: int = 8, window: int = 1, weight: float = 0.25) -> DataFrame:
    """(ids, line_no, bonus) from the strongest positive lines (ids, line_no, n_lines, strength) to their neighbours, by distance."""
    order = Window.partitionBy(*id_cols).orderBy(F.col("strength").desc(), "line_no")
    top = scored.where("strength > 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seeds)
    low, high = F.greatest(F.lit(1), F.col("line_no") - window), F.least(F.col("n_lines"), F.col("line_no") + window)
    near = top.select(*id_cols, F.col("line_no").alias("_at"), "strength", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("line_no")).where("line_no <> _at")
    return near.groupBy(*id_cols, "line_no").agg(F.sum(weight * F.col("strength") / (F.abs(F.col("line_no") - F.col("_at")) + 1)).alias("bonus"))


def signal_scores(units: DataFrame, signals: DataFrame, group: str, unit: str, *, max_df_ratio: float | None = 0.1) -> DataFrame:
    """(group, unit, score): summed weights of the signals' terms (group, term, weight) in units (group, unit, tokens).

    With a ratio, terms in more than max(2, ceil(n * ratio)) units don't count.
    """
    each = units.select(group, unit, F.explode(F.array_distinct("tokens")).alias("term"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    hit = each.join(signals, [group, "term"])
    if max_df_ratio is not None:
        df = F.count("*").over(Window.partitionBy(group, "term", "weight"))
        hit = hit.withColumn("_df", df).where(F.col("_df") <= F.greatest(F.lit(2), F.ceil(F.col("n") * max_df_ratio)))
    got = hit.groupBy(group, unit).agg(F.sum("weight").alias("score"))
    return units.select(group, unit).join(got, [group, unit], "left").select(group, unit, F.coalesce("score", F.lit(0.0)).alias("score"))


def discriminative_terms(blocks: DataFrame, intent: DataFrame, group: str, block: str) -> DataFrame:
    """(group, term, df): intent terms in at least one and at most max(3, ceil(n / 10)) blocks."""
    n = blocks.groupBy(group).agg(F.count("*").alias("n"))
    df = document_frequency(blocks, group, block).join(intent.select(group, F.explode(F.array_distinct("tokens")).alias("term")), [group, "term"], "left_semi")
    return df.join(n, group).where(F.col("df") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.1))).select(group, "term", "df")


def ir_components(lines: DataFrame) -> DataFrame:
    """Line scores of (line, bm25, query_ids, path_terms, recent_words): all six weighted parts, their sum and their names."""
    ids, words = T.identifiers(F.col("line")), T.word_tokens(F.col("line"))
    x = lines.withColumns({
        "identifier": 2.0 * T.overlap_fraction(ids, F.col("query_ids")),
        "path": 0.75 * T.overlap_fraction(F.array_union(ids, words), F.col("path_terms")),
        "recent": T.overlap_fraction(F.array_union(ids, words), F.col("recent_words")),
        "structure": F.when(F.col("line").rlike(T.A_STRUCTURE), 0.35).otherwise(0.0),
        "error": F.when(F.col("line").rlike(T.A_ERROR), 1.0).otherwise(0.0),
    })
    x = x.withColumn("strength", F.col("bm25") + F.col("identifier") + F.col("path") + F.col("recent"))
    names = ["bm25", "identifier", "path", "recent", "structure", "error"]
    return x.withColumns({"score": F.col("strength") + F.col("structure") + F.col("error"), "reasons": F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in names)))})
