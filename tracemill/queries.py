"""Queries over the test tables, each with the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures
from .functions import text as T
from .functions import vector as V
from .operators import compaction, context, lines, metrics, ranking, selection, tensors, tools, trajectories
from .plans import rankers, surprisal
from .streaming import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB: documents' lines, as operators.lines.split_lines makes them of texts with line feeds only.
LINES = """lines AS (SELECT doc_id, line, i AS line_no, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS i
 FROM (SELECT doc_id, CASE WHEN t[len(t)] = '' THEN t[1:len(t) - 1] ELSE t END AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))))"""
WORDS = r"list_transform(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*|\d+'), lambda x: lower(x))"
BM25 = f"""{LINES},
t AS (SELECT doc_id, line_no, n_lines, line, {WORDS.format("line")} AS tokens FROM lines),
c AS (SELECT doc_id, line_no, len(tokens) AS len, count(*) OVER (PARTITION BY doc_id) AS n, avg(len(tokens)) OVER (PARTITION BY doc_id) AS avgdl FROM t),
q AS (SELECT doc_id, term, count(*) AS qtf FROM (SELECT doc_id, unnest({WORDS.format("b.text")}) AS term FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)) GROUP BY 1, 2),
f AS (SELECT doc_id, line_no, term, count(*) AS tf FROM (SELECT doc_id, line_no, unnest(tokens) AS term FROM t) GROUP BY 1, 2, 3),
g AS (SELECT f.*, qtf, count(*) OVER (PARTITION BY doc_id, term) AS df FROM f JOIN q USING (doc_id, term)),
s AS (SELECT doc_id, line_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / nullif(avgdl, 0))) * qtf) AS bm25 FROM g JOIN c USING (doc_id, line_no) GROUP BY 1, 2),
scored AS (SELECT t.doc_id, t.line_no, n_lines, line, round(coalesce(bm25, 0), 9) AS score FROM t LEFT JOIN s USING (doc_id, line_no))"""
TARGET = "CAST(greatest(0, least(n_lines, greatest(1, round_even(n_lines * 0.5::DOUBLE, 0)))) AS BIGINT)"
KEPT = f"""{BM25},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS r FROM scored) WHERE r <= {TARGET})"""
OBS = f"obs AS (SELECT * FROM {fixtures.observations_sql()})"
OBS_LINES = f"""{OBS}, ol AS (SELECT obs_id, command, path, query, text, line, i AS line_no, count(*) OVER (PARTITION BY obs_id) AS n_lines FROM (SELECT *, unnest(w) AS line, generate_subscripts(w, 1) AS i
 FROM (SELECT *, CASE WHEN t[len(t)] = '' THEN t[1:len(t) - 1] ELSE t END AS w FROM (SELECT *, string_split(text, chr(10)) AS t FROM obs))))"""


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.split_lines(table(spark, sf_dir, "documents"), "doc_id")
    return got.withColumn("n_lines", F.count("*").over(Window.partitionBy("doc_id")))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines with their BM25 score for one benchmark text each."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n = bench.count()
    asked = bench.groupBy("item_id").agg(F.flatten(F.collect_list(T.word_tokens(F.col("text")))).alias("asked"))
    x = docs.select("doc_id", "text", (F.col("doc_id") % n).alias("item_id")).join(asked, "item_id", "left")
    return ranking.bm25_lines(x, "doc_id", query="asked")


def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = selection.target_lines(F.col("n_lines"), F.lit(0.5), no_prune_below=0)
    x = scored_lines(spark, sf_dir).withColumns({"target": target, "mandatory": F.lit(False)})
    return selection.select_lines(x, "doc_id")


# ---- lines, tokens, terms


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def split_lines(spark, sf_dir):
    return lines.split_lines(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH {LINES}, a AS (SELECT *, sum(CASE WHEN regexp_matches(line, '\\S') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines),
b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) - 1) // 4 AS piece FROM a WHERE regexp_matches(line, '\\S')),
c AS (SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line FROM b GROUP BY doc_id, island, piece)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS block, start_line, end_line FROM c""")
def paragraph_blocks(spark, sf_dir):
    return lines.paragraph_blocks(lines.split_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", max_lines=4)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./:-]*|\d+|[^\p{L}\p{N}_\s]')) AS lexical, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS counted,
greatest(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./:-]*|\d+|[^\p{L}\p{N}_\s]')), CAST(ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0) AS BIGINT) + length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) AS max_proxy FROM documents""")
def token_estimates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate_lexical(t).cast("bigint").alias("lexical"), T.token_estimate_counted(t).cast("bigint").alias("counted"), T.token_estimate_max(t).alias("max_proxy"))


@query(f"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.:/-]*|\\d+'), lambda x: lower(x))) AS term FROM documents)
WHERE length(term) > 1 AND NOT regexp_matches(term, '^\\d+$') AND term NOT IN ({", ".join(f"'{w}'" for w in T.STOPWORDS)}) GROUP BY 1, 2""")
def term_counts(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(r"""SELECT doc_id, len(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.:-]*') IF length(x) > 1])) AS n_identifiers FROM documents""")
def identifier_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.identifiers(F.col("text"))).cast("bigint").alias("n_identifiers"))


@query(f"WITH {LINES}, k AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE line_no % 3 <> 1) SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line FROM k GROUP BY doc_id, g")
def omitted_ranges(spark, sf_dir):
    x = lines.split_lines(table(spark, sf_dir, "documents"), "doc_id")
    return lines.omitted_ranges(x, x.where("line_no % 3 = 1"), "doc_id")


@query(f"WITH {LINES}, c AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE NOT (line_no BETWEEN 2 AND 4)), r AS (SELECT doc_id, min(line_no) AS a, max(line_no) AS b FROM c GROUP BY doc_id, g) SELECT doc_id, s AS start_line, least(b, s + 4) AS end_line FROM r, unnest(generate_series(a, b, 5)) AS u(s)")
def gap_blocks(spark, sf_dir):
    x = doc_lines(spark, sf_dir)
    block = x.where("line_no = 2").select("doc_id", F.lit(2).alias("start_line"), F.least(F.lit(4), F.col("n_lines")).cast("int").alias("end_line"))
    return lines.gap_blocks(x, block, "doc_id", max_lines=5)


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM lines WHERE contains(line, 'the')) WHERE r <= 2")
def search_lines(spark, sf_dir):
    return selection.search(lines.split_lines(table(spark, sf_dir, "documents"), "doc_id"), "the", "doc_id", max_results=2)


@query(f"WITH {LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines WHERE line_no BETWEEN 2 AND 4 GROUP BY doc_id")
def read_range(spark, sf_dir):
    return selection.read_range(lines.split_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", start=2, end=4)


# ---- budgets, selection, rendering


@query(f"""WITH {LINES}, n AS (SELECT DISTINCT doc_id, n_lines FROM lines) SELECT doc_id, n_lines, {TARGET} AS target,
CASE WHEN n_lines <= 20 THEN 1.0 WHEN n_lines <= 80 THEN 0.7 WHEN n_lines <= 200 THEN 0.45 ELSE 0.3 END::DOUBLE AS band_ratio FROM n""")
def budget_targets(spark, sf_dir):
    n = lines.split_lines(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return n.select("doc_id", "n_lines", selection.target_lines(F.col("n_lines"), F.lit(0.5), no_prune_below=0).alias("target"), selection.length_band_ratio(F.col("n_lines")).alias("band_ratio"))


@query(f"WITH {BM25} SELECT doc_id, line_no, score FROM scored")
def bm25_lines(spark, sf_dir):
    return scored_lines(spark, sf_dir).select("doc_id", "line_no", "score")


@query(f"WITH {KEPT} SELECT doc_id, line_no, score FROM kept")
def select_lines(spark, sf_dir):
    return kept_lines(spark, sf_dir).select("doc_id", "line_no", "score")


@query(f"""WITH {BM25}, m AS (SELECT *, line_no = 1 AS mandatory, line_no % 5 = 0 AS seed FROM scored), d AS (SELECT a.doc_id, a.line_no, min(abs(a.line_no - b.line_no)) AS dist FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.seed AND abs(a.line_no - b.line_no) <= 1 GROUP BY 1, 2),
r AS (SELECT m.*, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN mandatory THEN 0 WHEN dist IS NOT NULL THEN 1 ELSE 2 END, score DESC, CASE WHEN mandatory OR dist IS NULL THEN 0 ELSE dist END, line_no) AS r FROM m LEFT JOIN d USING (doc_id, line_no))
SELECT doc_id, line_no FROM r WHERE r <= {TARGET}""")
def select_with_seeds(spark, sf_dir):
    x = scored_lines(spark, sf_dir).withColumns({"target": selection.target_lines(F.col("n_lines"), F.lit(0.5), no_prune_below=0), "mandatory": F.col("line_no") == 1, "seed": F.col("line_no") % 5 == 0})
    return selection.select_lines(x, "doc_id").select("doc_id", "line_no")


@query(f"""WITH {KEPT}, gp AS (SELECT *, line_no - coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), 0) - 1 AS gap FROM kept),
p AS (SELECT *, CASE WHEN gap > 0 THEN '<' || gap || ' lines pruned>' || chr(10) ELSE '' END || CASE WHEN length(line_no::VARCHAR) < 6 THEN lpad(line_no::VARCHAR, 6, ' ') ELSE line_no::VARCHAR END || ' | ' || line AS t FROM gp)
SELECT doc_id, string_agg(t, chr(10) ORDER BY line_no) || CASE WHEN max(n_lines) > max(line_no) THEN chr(10) || '<' || (max(n_lines) - max(line_no)) || ' lines pruned>' ELSE '' END AS rendered FROM p GROUP BY doc_id""")
def render_skeleton(spark, sf_dir):
    return selection.render_skeleton(kept_lines(spark, sf_dir), "doc_id")


@query(f"""WITH {BM25}, d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY score DESC) AS d FROM scored) SELECT doc_id, line_no, round(CASE WHEN max(d) OVER w = 1 THEN 1.0 ELSE 1 - (d - 1) / (max(d) OVER w - 1) END::DOUBLE, 9) AS percentile FROM d WINDOW w AS (PARTITION BY doc_id)""")
def rank_percentiles(spark, sf_dir):
    return ranking.rank_percentiles(scored_lines(spark, sf_dir), "doc_id").select("doc_id", "line_no", F.round("percentile", 9).alias("percentile"))


@query(f"""WITH {BM25}, w AS (SELECT *, sum(score) OVER (PARTITION BY doc_id) AS t, sum(score) OVER o - score AS b, row_number() OVER o AS r FROM scored WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, line_no ROWS UNBOUNDED PRECEDING)) SELECT doc_id, line_no FROM w WHERE r = 1 OR (t > 0 AND b < 0.9 * t - 1e-12)""")
def nucleus(spark, sf_dir):
    return selection.nucleus(scored_lines(spark, sf_dir), "doc_id").select("doc_id", "line_no")


@query(f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line_no) AS b FROM scored)
SELECT doc_id, line_no, round(CASE WHEN score > 0 THEN 1 / (60 + a) ELSE 0 END + CASE WHEN length(line) > 0 THEN 1 / (60 + b) ELSE 0 END, 9)::DOUBLE AS rrf FROM r""")
def rrf_lines(spark, sf_dir):
    x = scored_lines(spark, sf_dir).withColumn("size", F.length("line"))
    return ranking.reciprocal_rank_fusion(x, "doc_id", components=["score", "size"], by="line_no").select("doc_id", "line_no", F.round("rrf", 9).alias("rrf"))


@query(f"""WITH {BM25}, s8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS r FROM scored WHERE score > 0) WHERE r <= 8)
SELECT b.doc_id, b.line_no, round(sum(0.25 * a.score / (abs(a.line_no - b.line_no) + 1)), 6) AS bonus FROM s8 a JOIN scored b ON a.doc_id = b.doc_id AND abs(a.line_no - b.line_no) = 1 GROUP BY 1, 2""")
def neighbour_bonus(spark, sf_dir):
    return ranking.neighbour_bonus(scored_lines(spark, sf_dir).withColumnRenamed("score", "strength"), "doc_id").select("doc_id", "line_no", F.round("bonus", 6).alias("bonus"))


# ---- evaluation

_SAMPLES = f"""{KEPT}, k AS (SELECT doc_id, list(line_no) AS kept FROM kept GROUP BY 1), a0 AS (SELECT doc_id, lang, count(*) AS n_lines FROM lines JOIN documents USING (doc_id) GROUP BY 1, 2), a AS (SELECT *, [x FOR x IN range(1, n_lines + 1) IF x % 3 = 1 AND doc_id % 4 <> 0] AS gold, [x FOR x IN range(1, n_lines + 1) IF x % 5 = 2] AS required FROM a0),
m AS (SELECT *, len(list_intersect(kept, gold))::DOUBLE AS hit, len(list_intersect(kept, required)) AS found FROM a JOIN k USING (doc_id)),
z AS (SELECT doc_id, lang, n_lines, kept, CASE WHEN len(gold) > 0 THEN CASE WHEN len(kept) = 0 THEN 0 ELSE hit / len(kept) END END AS line_precision, CASE WHEN len(gold) > 0 THEN hit / len(gold) END AS line_recall, CASE WHEN len(required) > 0 THEN found / len(required) END AS required_recall, CASE WHEN len(required) > 0 THEN found < len(required) END AS critical_miss, len(kept) / n_lines AS retention FROM m),
y AS (SELECT *, CASE WHEN line_precision IS NOT NULL THEN CASE WHEN line_precision + line_recall = 0 THEN 0 ELSE 2 * line_precision * line_recall / (line_precision + line_recall) END END AS line_f1 FROM z)"""


def samples(spark, sf_dir):
    kept = kept_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("kept"), F.first("n_lines").alias("n_lines"))
    seq = F.sequence(F.lit(1), F.col("n_lines").cast("int"))
    gold = F.filter(seq, lambda x: (x % 3 == 1) & (F.col("doc_id") % 4 != 0))
    return metrics.sample_metrics(table(spark, sf_dir, "documents").select("doc_id", "lang").join(kept, "doc_id").withColumns({"gold": gold, "required": F.filter(seq, lambda x: x % 5 == 2)}))


@query(f"WITH {_SAMPLES} SELECT doc_id, round(line_precision, 9) AS line_precision, round(line_recall, 9) AS line_recall, round(line_f1, 9) AS line_f1, round(required_recall, 9) AS required_recall, critical_miss, round(retention, 9) AS retention FROM y")
def replay_metrics(spark, sf_dir):
    x = samples(spark, sf_dir)
    return x.select("doc_id", *(F.round(c, 9).alias(c) for c in ("line_precision", "line_recall", "line_f1", "required_recall")), "critical_miss", F.round("retention", 9).alias("retention"))


@query(f"""WITH {_SAMPLES} SELECT lang, grouping(lang) = 1 AS is_total, count(*) AS samples, round(sum(len(kept)) / sum(n_lines), 9)::DOUBLE AS retention_ratio, round(avg(line_precision), 9) AS macro_precision, round(avg(line_recall), 9) AS macro_recall, round(avg(line_f1), 9) AS macro_f1, round(avg(required_recall), 9) AS macro_required_recall,
round(count(*) FILTER (critical_miss) / nullif(count(critical_miss), 0), 9) AS critical_miss_rate FROM y GROUP BY GROUPING SETS ((), (lang))""")
def replay_summary(spark, sf_dir):
    got = metrics.summarize(samples(spark, sf_dir), "lang")
    return got.select("lang", "is_total", "samples", *(F.round(c, 9).alias(c) for c in got.columns[3:]))


_MATRIX = f"WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1), r AS (SELECT unnest([1.0, 0.7, 0.5, 0.35, 0.25])::DOUBLE AS ratio), x AS (SELECT ratio, doc_id, n, greatest(1, round_even(n * ratio, 0)) AS k FROM n, r), m AS (SELECT ratio, sum(k)::DOUBLE / sum(n) AS retention, avg(ceil(k / 3) / ceil(n / 3)) AS recall FROM x GROUP BY ratio)"


def matrix(spark, sf_dir):
    n = lines.split_lines(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    ratios = spark.createDataFrame([(x,) for x in (1.0, 0.7, 0.5, 0.35, 0.25)], "ratio double")
    x = n.crossJoin(F.broadcast(ratios)).withColumn("k", selection.target_lines(F.col("n"), F.col("ratio"), no_prune_below=0))
    return x.groupBy("ratio").agg((F.sum("k") / F.sum("n")).alias("retention"), F.avg(F.ceil(F.col("k") / 3) / F.ceil(F.col("n") / 3)).alias("recall"))


@query(f"{_MATRIX} SELECT ratio, round(retention, 9) AS retention, round(recall, 9) AS recall FROM m")
def budget_matrix(spark, sf_dir):
    return matrix(spark, sf_dir).select("ratio", F.round("retention", 9).alias("retention"), F.round("recall", 9).alias("recall"))


@query("""WITH a AS (SELECT p_partkey, p_size, round(p_retailprice, 2)::DOUBLE AS price FROM part) SELECT p_partkey, NOT EXISTS (SELECT 1 FROM a b WHERE b.p_size <= a.p_size AND b.price >= a.price AND (b.p_size < a.p_size OR b.price > a.price)) AS pareto FROM a""")
def pareto_frontier(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.round("p_retailprice", 2).cast("double").alias("price"))
    return metrics.pareto(x, "p_size", "price").select("p_partkey", "pareto")


@query("SELECT o_orderpriority AS priority, round(quantile_cont(o_totalprice::DOUBLE, 0.5), 2) AS p50, round(quantile_cont(o_totalprice::DOUBLE, 0.95), 2) AS p95 FROM orders GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("double").alias("v"))
    return metrics.percentiles(x, "priority", "v", {"p50": 0.5, "p95": 0.95}).select("priority", F.round("p50", 2).alias("p50"), F.round("p95", 2).alias("p95"))


# ---- kinds of output, rules, blocks (over observations made here, since the tables hold none)

_FRAME2 = r"""regexp_matches(x, '^\s*(?:at\s+\S+.*:\d+|File\s+"[^"]+",\s+line\s+\d+)')"""


@query(f"""WITH {OBS} SELECT obs_id, kind, tool_type FROM (VALUES (1, 'source', 'source'), (2, 'traceback', 'traceback'), (3, 'diff', 'diff'), (4, 'test_log', 'test_log'), (5, 'search', 'grep'), (6, 'tree', 'tree'), (7, 'generic', 'generic'), (8, 'generic', 'generic')) AS v(i, kind, tool_type) JOIN obs ON obs_id = i""")
def observation_kinds(spark, sf_dir):
    """The kinds that each observation was made to have."""
    x = tools.detect_tool_type(tools.classify_output(fixtures.observations(spark)))
    return x.select("obs_id", "kind", "tool_type")


def _sql_reasons(line: str) -> str:
    return "[r FOR r IN [" + ", ".join(f"CASE WHEN regexp_matches({line}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in T.REASONS.items()) + "] IF r IS NOT NULL]"


@query(f"WITH {OBS_LINES} SELECT obs_id, line_no, array_to_string({_sql_reasons('line')}, ',') AS reasons FROM ol")
def line_reasons(spark, sf_dir):
    x = lines.split_lines(fixtures.observations(spark), "obs_id")
    return x.select("obs_id", "line_no", F.array_join(T.line_reasons(F.col("line")), ",").alias("reasons"))


def _requests(spark):
    return fixtures.observations(spark).withColumnRenamed("obs_id", "request_id")


def _sql_rules() -> str:
    q = lambda p: p.replace("'", "''").replace("(?!--- |\\+\\+\\+ )", "")
    hit = lambda k, p: f"(tool_type = '{k}' AND regexp_matches(line, '{q(p)}')" + (" AND NOT regexp_matches(line, '^(?:--- |\\+\\+\\+ )')" if "(?!" in p else "") + ")"
    score = " + ".join(f"CASE WHEN {hit(k, p)} THEN {s} ELSE 0 END" for k, _, p, s, _ in tools.RULES)
    seed = " OR ".join([hit(k, p) for k, _, p, _, e in tools.RULES if e] + [hit("diff", tools.HUNK)])
    kinds = "SELECT * FROM (VALUES (1, 'source'), (2, 'traceback'), (3, 'diff'), (4, 'test_log'), (5, 'grep'), (6, 'tree'), (7, 'generic'), (8, 'generic')) AS v(obs_id, tool_type)"
    return f"""WITH {OBS_LINES}, k AS ({kinds}), f AS (SELECT obs_id AS request_id, line_no, 0.01::DOUBLE + {score} AS score, {seed} AS seed FROM ol JOIN k USING (obs_id)),
n AS (SELECT *, max(seed::INT) OVER (PARTITION BY request_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM f)
SELECT request_id, line_no, round(score + CASE WHEN near AND NOT seed THEN 1 ELSE 0 END, 9)::DOUBLE AS score, seed FROM n"""


@query(_sql_rules())
def execution_rules(spark, sf_dir):
    return rankers.ast_scores(_requests(spark)).select("request_id", "line_no", F.round("score", 9).alias("score"), "seed")


@query("WITH d AS (SELECT * FROM (VALUES ('FunctionDef', 'load_config', 5, 7), ('ClassDef', 'Store', 9, 14), ('FunctionDef', 'get', 10, 11), ('FunctionDef', 'put', 13, 14)) AS v(kind, name, start_line, end_line) UNION ALL SELECT 'FunctionDef', 'helper_' || i, 16 + 3 * i, 17 + 3 * i FROM range(6) AS u(i)) SELECT 1 AS obs_id, * FROM d")
def python_definitions(spark, sf_dir):
    return tools.python_definitions(fixtures.observations(spark), "obs_id")


@query(f"""WITH {OBS_LINES}, t AS (SELECT obs_id, line_no, CASE WHEN regexp_matches(line, '^[│ ]*[├└]') THEN length(regexp_extract(line, '^([│ ]*)', 1)) // 4 + 1 ELSE 0 END AS depth, contains(line, 'core.py') AS hit FROM ol WHERE obs_id = 6)
SELECT a.obs_id, a.line_no FROM t a WHERE EXISTS (SELECT 1 FROM t h WHERE h.hit AND h.line_no > a.line_no AND a.depth < (SELECT min(depth) FROM t m WHERE m.line_no > a.line_no AND m.line_no <= h.line_no))""")
def tree_ancestors(spark, sf_dir):
    x = lines.split_lines(fixtures.observations(spark).where("obs_id = 6"), "obs_id")
    depth = F.when(F.col("line").rlike("^[│ ]*[├└]"), F.floor(F.length(F.regexp_extract("line", "^([│ ]*)", 1)) / 4) + 1).otherwise(0)
    return tools.tree_ancestors(x.select("obs_id", "line_no", depth.alias("depth")), x.where(F.contains("line", F.lit("core.py"))).select("obs_id", "line_no"), "obs_id")


def _sql_by_kind(t: dict[str, list[str]]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " END"


_BLOCKS = f"""{OBS_LINES}, k AS (SELECT * FROM (VALUES (1, 'source'), (2, 'traceback'), (3, 'diff'), (4, 'test_log'), (5, 'search'), (6, 'tree'), (7, 'generic'), (8, 'generic')) AS v(obs_id, kind)),
a AS (SELECT obs_id, kind, line_no, line, list_intersect({_sql_reasons('line')}, {_sql_by_kind(lines.SPECIAL)}) AS r FROM ol JOIN k USING (obs_id)),
i AS (SELECT *, len(r) > 0 AS special, sum((len(r) > 0)::INT) OVER (PARTITION BY obs_id ORDER BY line_no) AS island FROM a),
p AS (SELECT *, (row_number() OVER (PARTITION BY obs_id, island, special ORDER BY line_no) - 1) // 16 AS piece FROM i),
b AS (SELECT obs_id, kind, min(line_no) AS start_line, max(line_no) AS end_line, any_value(r) AS r FROM p GROUP BY obs_id, kind, island, special, piece),
blocks AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY start_line) - 1 AS block, count(*) OVER (PARTITION BY obs_id) AS n FROM b),
hard AS (SELECT *, len(list_intersect(r, {_sql_by_kind(lines.HARD)})) > 0 OR block = 0 OR block = n - 1 AS is_hard FROM blocks)"""


@query(f"WITH {_BLOCKS} SELECT obs_id, block, start_line, end_line, is_hard FROM hard")
def evidence_blocks(spark, sf_dir):
    x = lines.split_lines(tools.classify_output(fixtures.observations(spark)), "obs_id", "kind")
    return lines.evidence_blocks(x, "obs_id").select("obs_id", F.col("block").cast("bigint").alias("block"), "start_line", "end_line", "is_hard")


@query(f"WITH {_BLOCKS} SELECT obs_id, block FROM (SELECT *, max(is_hard::INT) OVER (PARTITION BY obs_id ORDER BY block ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS keep FROM hard) WHERE keep")
def safe_rules(spark, sf_dir):
    x = tools.select_blocks(tools.ranked_blocks(fixtures.observations(spark), "obs_id"), "obs_id", "safe_rules")
    return x.where("keep").select("obs_id", F.col("block").cast("bigint").alias("block"))


@query()
def intent_ir(spark, sf_dir):
    return tools.select_blocks(tools.ranked_blocks(fixtures.observations(spark), "obs_id"), "obs_id", "intent_ir").where("keep").select("obs_id", "block", "rank")


@query()
def intent_structure(spark, sf_dir):
    return tools.select_blocks(tools.ranked_blocks(fixtures.observations(spark), "obs_id"), "obs_id", "intent_structure").where("keep").select("obs_id", "block", "rank")


@query()
def cost_gates(spark, sf_dir):
    x = tools.select_blocks(tools.ranked_blocks(fixtures.observations(spark), "obs_id"), "obs_id", "intent_ir")
    size = F.col("end_line") - F.col("start_line") + 1
    kept = x.groupBy("obs_id").agg(F.sum(size).alias("n_lines"), F.sum(F.when(F.col("keep"), size).otherwise(0)).alias("kept_lines"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("block", "text"))))["text"], "\n").alias("compact"))
    y = tools.classify_output(fixtures.observations(spark)).join(kept, "obs_id", "left")
    return tools.cost_gate(y, min_tokens=50, min_savings=5).select("obs_id", "status", "reason")


@query()
def ir_structural(spark, sf_dir):
    return rankers.ir_structural(_requests(spark), no_prune_below=0).select("request_id", "line_no", "score")


@query()
def execution_ast(spark, sf_dir):
    return rankers.execution_ast(_requests(spark), no_prune_below=0).select("request_id", "line_no", "score")


@query()
def ir_ast_hybrid(spark, sf_dir):
    return rankers.ir_ast_hybrid(_requests(spark), no_prune_below=0).select("request_id", "line_no", "score")


# ---- vectors and tensors


@query("""WITH a AS (SELECT label, list(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings GROUP BY label), m AS (SELECT label, [list_avg([y[d] FOR y IN v]) FOR d IN range(1, len(v[1]) + 1)] AS c FROM a)
SELECT vec_id, round(CASE WHEN list_inner_product(e, e) * list_inner_product(c, c) > 0 THEN list_inner_product(e, c) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(c, c))) ELSE 0 END, 6) AS score FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) JOIN m USING (label)""")
def hidden_similarity(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings")
    anchors = tensors.pool_vectors(x, "label", vector="embedding").withColumn("weight", F.lit(0.35))
    got = tensors.anchor_similarity(x.select("label", F.col("vec_id").alias("line_no"), F.col("embedding").cast("array<double>").alias("vector")), anchors, "label")
    return got.select(F.col("line_no").alias("vec_id"), F.round("score", 6).alias("score"))


_CUBE = """cube AS (SELECT vec_id % 5 AS req, (vec_id // 5) % 4 AS layer, (vec_id // 20) % 3 AS head, (vec_id // 60) % 2 AS step, d - 1 AS token, embedding[d]::DOUBLE AS value FROM embeddings, unnest(range(1, 9)) AS u(d) WHERE vec_id < 120)"""


def cube(spark, sf_dir):
    v = F.col("vec_id")
    x = table(spark, sf_dir, "embeddings").where("vec_id < 120").select((v % 5).alias("req"), (F.floor(v / 5) % 4).alias("layer"), (F.floor(v / 20) % 3).alias("head"), (F.floor(v / 60) % 2).alias("step"), F.posexplode(F.slice("embedding", 1, 8)).alias("token", "value"))
    return x.withColumn("value", F.col("value").cast("double"))


@query(f"""WITH {_CUBE}, s AS (SELECT req, layer, head, token, avg(greatest(value, 0)) AS v FROM cube GROUP BY ALL), h AS (SELECT req, layer, token, max(v) AS v FROM s GROUP BY ALL), l AS (SELECT req, token, avg(v) AS v FROM h GROUP BY ALL),
n AS (SELECT req, token // 2 + 1 AS line_no, sum(v) AS v FROM l WHERE token <> 0 GROUP BY ALL) SELECT req, line_no, round(CASE WHEN max(v) OVER (PARTITION BY req) > 0 THEN v / max(v) OVER (PARTITION BY req) ELSE 0 END, 6) AS score FROM n""")
def attention_mass(spark, sf_dir):
    x = cube(spark, sf_dir)
    mapping = x.select("req", "token").distinct().withColumns({"line_no": F.floor(F.col("token") / 2) + 1, "sink": F.col("token") == 0})
    got = tensors.line_attention(tensors.attention_mass(x, "req", heads="max"), mapping, "req")
    return got.select("req", "line_no", F.round("score", 6).alias("score"))


@query()
def attention_rollout(spark, sf_dir):
    x = cube(spark, sf_dir).select("req", "layer", "head", (F.col("token") % 4).alias("key"), ((F.col("token") + F.col("step")) % 4).alias("query"), "value")
    return tensors.attention_rollout(x.groupBy("req", "layer", "head", "query", "key").agg(F.avg("value").alias("value")), "req").select("req", "token", F.round("value", 6).alias("value"))


@query(f"WITH {LINES} SELECT doc_id, line_no, 10.0 * (SELECT count(*) FROM (VALUES ('the'), ('ing'), ('qu')) AS v(w) WHERE contains(line, w) AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.doc_id = lines.doc_id AND b.line_no <> lines.line_no AND b.line_no <= 6 AND contains(b.line, w)))::DOUBLE AS harm FROM lines WHERE line_no <= 6 AND doc_id < 200")
def influence_loo(spark, sf_dir):
    x = doc_lines(spark, sf_dir).where("line_no <= 6 AND doc_id < 200").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("line").alias("text"))
    return tensors.leave_one_out(x, tensors.lexical_scorer(["the", "ing", "qu"]), "doc_id", "line_no")


# ---- runs, context, prompts


@query("""WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS recency FROM conversations) SELECT conv_id, turn, recency, CASE WHEN recency < 2 THEN 'HOT' ELSE 'COLD' END AS tier FROM o""")
def hot_window(spark, sf_dir):
    return context.tiers(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("recency").cast("bigint").alias("recency"), "tier")


@query("""SELECT * FROM (SELECT conv_id, turn, role, max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS follows FROM conversations) WHERE role = 'assistant'""")
def follow_ups(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").withColumn("type", F.when(F.col("role") == "assistant", "action").otherwise("observation"))
    return context.follow_ups(x, "conv_id", "turn").select("conv_id", "turn", "role", "follows")


@query("""SELECT conv_id, turn, coalesce(lag(substr(sha256(concat_ws(chr(0), role, text[1:1])), 1, 16)) OVER (PARTITION BY conv_id ORDER BY turn) <> substr(sha256(concat_ws(chr(0), role, text[1:1])), 1, 16), false) AS switched FROM conversations""")
def view_switches(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").withColumn("fingerprint", T.fingerprint(F.col("role"), F.substring("text", 1, 1)))
    return context.view_switches(x, "conv_id", order="turn").select("conv_id", "turn", "switched")


_ARMS = r"""turns AS (SELECT 'arm' || conv_id % 3 AS arm, conv_id // 3 AS task, turn, role, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens, CASE WHEN turn % 4 = 3 THEN 'compacted' ELSE 'full' END AS status, length(text) AS saved FROM conversations),
one AS (SELECT arm, task, count(*) FILTER (role = 'assistant') AS calls, coalesce(sum(tokens) FILTER (role = 'assistant'), 0) AS completion, coalesce(sum(tokens) FILTER (role <> 'assistant'), 0) AS prompt, coalesce(sum(saved) FILTER (status = 'compacted'), 0) AS saved, count(*) FILTER (status = 'compacted') AS compacted, max(turn) AS last_turn FROM turns GROUP BY 1, 2),
arms AS (SELECT arm, count(*) AS trajectories, sum(calls)::BIGINT AS api_calls, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens, sum(saved)::BIGINT AS tokens_saved, sum(compacted)::BIGINT AS compactions, round(avg(last_turn), 9) AS mean_last_turn, list_sort(list(task)) AS tasks FROM one GROUP BY 1)"""


def arms(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").select(F.concat(F.lit("arm"), (F.col("conv_id") % 3).cast("string")).alias("arm"), F.floor(F.col("conv_id") / 3).alias("task"), "turn", "role", "text", F.when(F.col("turn") % 4 == 3, "compacted").otherwise("full").alias("status"), F.length("text").alias("saved"))
    return trajectories.arm_summary(x)


@query(f"WITH {_ARMS} SELECT * EXCLUDE (tasks) FROM arms")
def arm_summary(spark, sf_dir):
    return arms(spark, sf_dir).drop("tasks").withColumn("mean_last_turn", F.round("mean_last_turn", 9))


@query(f"WITH {_ARMS}, b AS (SELECT * FROM arms WHERE arm = 'arm1') SELECT a.arm, a.trajectories = b.trajectories AS comparable, CASE WHEN a.trajectories = b.trajectories THEN a.api_calls - b.api_calls END AS api_calls_delta, round(CASE WHEN a.trajectories = b.trajectories THEN a.api_calls / b.api_calls END, 9) AS api_calls_ratio FROM arms a, b")
def baseline_compare(spark, sf_dir):
    got = metrics.against_baseline(arms(spark, sf_dir), "arm1", ["api_calls"])
    return got.select("arm", "comparable", "api_calls_delta", F.round("api_calls_ratio", 9).alias("api_calls_ratio"))


@query(f"WITH {_ARMS} SELECT arm, tasks = (SELECT tasks FROM arms ORDER BY arm LIMIT 1) AS same_tasks FROM arms")
def task_set_check(spark, sf_dir):
    return trajectories.task_sets_equal(arms(spark, sf_dir)).select("arm", "same_tasks")


@query("SELECT role, turn % 3 AS level, count(*) AS n FROM conversations GROUP BY 1, 2")
def manifest_histogram(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").withColumn("level", F.col("turn") % 3)
    return trajectories.histogram(x, "role", value="level")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS r FROM conversations) WHERE r = 1")
def grader_latest(spark, sf_dir):
    return metrics.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query("""WITH b AS (SELECT l_returnflag AS name, sum(l_quantity)::DOUBLE AS v FROM lineitem WHERE l_linenumber < 3 GROUP BY 1), a AS (SELECT l_linestatus AS name, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, sum(l_quantity)::DOUBLE FROM lineitem WHERE l_linenumber < 4 AND l_returnflag <> 'N' GROUP BY 1)
SELECT name, CASE WHEN a.v >= b.v THEN a.v - b.v END AS delta FROM b FULL JOIN a USING (name)""")
def prometheus_delta(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    before = x.where("l_linenumber < 3").groupBy(F.col("l_returnflag").alias("name")).agg(F.sum("q").alias("value"))
    after = x.groupBy(F.col("l_linestatus").alias("name")).agg(F.sum("q").alias("value")).union(x.where("l_linenumber < 4 AND l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.sum("q")))
    return metrics.counter_deltas(before, after)


@query("SELECT planner, codec, signal, planner || '-' || codec || '-' || signal AS slug FROM (VALUES ('greedy'), ('full'), ('minimum')) AS a(planner), (VALUES ('typed'), ('legacy')) AS b(codec), (VALUES ('rare'), ('all')) AS c(signal)")
def ablation_matrix(spark, sf_dir):
    return context.ablation_matrix(spark, {"planner": ["greedy", "full", "minimum"], "codec": ["typed", "legacy"], "signal": ["rare", "all"]})


def views(spark, sf_dir):
    return context.text_views(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query()
def planner_minimum(spark, sf_dir):
    return context.minimum_views(views(spark, sf_dir), "conv_id", "turn")


@query()
def planner_greedy(spark, sf_dir):
    recency = context.tiers(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "recency", (1 + 1 / (1 + F.col("recency"))).alias("importance"))
    return context.greedy_plan(views(spark, sf_dir).join(recency, ["conv_id", "turn"]), "conv_id", id_col="turn")


@query()
def trace_replay(spark, sf_dir):
    return replay.replay(replay.trace_of_turns(table(spark, sf_dir, "conversations")))


@query()
def adaptive_evidence(spark, sf_dir):
    """Also what fits the output cap."""
    ranked = tools.ranked_blocks(fixtures.observations(spark), "obs_id").withColumn("found", F.array_intersect(T.term_set(F.col("text")), T.term_set(F.col("query"))))
    kept = compaction.adaptive_evidence(ranked, "obs_id").join(ranked.select("obs_id", "block", "is_hard", "rrf", "text"), ["obs_id", "block"])
    return compaction.cap_output(kept, "obs_id", max_chars=600).select("obs_id", "block", "why")


@query()
def posterior_compaction(spark, sf_dir):
    x = fixtures.observations(spark).withColumnRenamed("query", "posterior")
    return compaction.posterior_compaction(x, "obs_id", min_tokens=40, min_savings=5)


@query()
def conditional_ppl(spark, sf_dir):
    return surprisal.conditional_surprisal(_requests(spark), surprisal.word_overlap_scorer(), no_prune_below=0).select("request_id", "line_no", "score")


from . import runtime_queries  # noqa: E402, F401  (registers its queries here)
