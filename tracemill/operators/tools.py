"""Kinds of tool output, the rules for each kind, and the gates before anything is left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .lines import evidence_blocks, paragraph_blocks, split_lines
from .ranking import bm25, document_frequency, reciprocal_rank_fusion

FRAME = r'^\s*at\s+.+\([^():]+:\d+(?::\d+)?\)|^\s*File\s+"[^"]+",\s+line\s+\d+'
EXCEPTION = r"(?i)^\s*(?:panic|fatal|segmentation fault|[A-Za-z_][A-Za-z0-9_.]*(?:Exception|Error))\s*:"
FILE_LINE = r"(?:^|\s)(?:[A-Za-z]:)?[^:\s]+\.[A-Za-z0-9_]+:\d+(?::\d+)?"
GREP = r"^\s*\d+(?::|-)|^(?:[A-Za-z]:)?[^:\n]+:\d+(?::|-)"
DECLARATION = r"(?:^|:\s*)\s*" + T._any("fn func impl enum class trait struct function interface def async~def") + r"\s+[A-Za-z_]"
HUNK = r"^@@@?\s"
TEST_SIGNAL = r"(?i)(?:^|\b)(?:\d+\s+failed|short test summary info|assertion failed|AssertionError|ERRORS?|FAILURES|FAILURE|FAILED)(?:\b|:)"
BRANCH = r"^([\s│|]*)(?:`--|\+--|└──|├──)\s*"


@F.pandas_udf(StringType())
def shell_verb(command: pd.Series) -> pd.Series:
    """The program that a command runs: assignments, options and wrappers before it don't count."""
    import shlex

    def one(c: str | None) -> str:
        try:
            words = shlex.split(c or "")
        except ValueError:
            words = (c or "").split()
        for w in words:
            name = w.rstrip("/").rpartition("/")[2].lower()
            assigns = "=" in w and not w.startswith(("/", "./", "../"))
            if not assigns and name not in ("xargs", "command", "timeout", "sudo", "env") and not name.startswith("-"):
                return name
        return ""

    return command.map(one)


def classify_output(df: DataFrame, *, paths_in_command: bool = True) -> DataFrame:
    """`kind` of (text, command, path): diff, traceback, test_log, search, tree, source or generic, the first that fits."""
    lines = F.coalesce(T.split_lines(F.col("text")), F.array().cast("array<string>"))
    count = lambda p: F.size(F.filter("_lines", lambda x: x.rlike(p)))
    low, text = F.lower(F.coalesce("command", F.lit(""))), F.coalesce("text", F.lit(""))
    suffix = r"(?i)\." + T._any(T.SUFFIXES) + "$"
    named = F.coalesce("path", F.lit("")).rlike(suffix)
    if paths_in_command:
        named = named | F.exists(T.extract_paths(F.coalesce("command", F.lit(""))), lambda p: p.rlike(suffix))
    n = F.size("_lines")
    trees = F.size(F.filter(F.slice("_lines", 1, 100), lambda x: x.rlike(T.B_TREE)))
    kind = (
        F.when(F.contains(low, F.lit("git diff")) | (count(T.B_DIFF) >= 3), "diff")
        .when(F.contains(F.lower(text), F.lit("traceback (most recent call last)")) | (count(T.B_FRAME) >= 2), "traceback")
        .when(text.rlike(T.B_TEST) | (F.col("_verb").isin("pytest", "tox", "jest", "npm", "pnpm", "yarn", "go", "cargo") & F.contains(low, F.lit("test"))), "test_log")
        .when(F.col("_verb").isin("grep", "rg", "ag", "ack", "find"), "search")
        .when(F.col("_verb").isin("tree", "ls") & (trees >= 3), "tree")
        .when(named | ((n >= 20) & (count(T.B_STRUCTURE) >= F.greatest(F.lit(2), F.floor(n / 50)))), "source")
        .otherwise("generic")
    )
    return df.withColumns({"_lines": lines, "_verb": shell_verb("command")}).withColumn("kind", kind).drop("_lines", "_verb")


def detect_tool_type(df: DataFrame) -> DataFrame:
    """`tool_type` of (text, command, path): from the command's words, then from the text, then from the path."""
    hint, text = F.lower(F.coalesce("command", F.lit(""))), F.coalesce("text", F.lit(""))
    lines = F.coalesce(T.split_lines(F.col("text")), F.array().cast("array<string>"))
    any_ = lambda p: F.exists("_lines", lambda x: x.rlike(p))
    word = lambda names: hint.rlike(r"(?:^|\s)" + T._any(names) + r"(?:\s|$)")
    kind = (
        F.when(word("ag rg grep ripgrep"), "grep")
        .when(hint.rlike(r"\bdiff\b"), "diff")
        .when(hint.rlike(r"\b" + T._any("jest vitest pytest unittest go~test cargo~test") + r"\b"), "test_log")
        .when(word("ls find tree"), "tree")
        .when(word("cat sed head tail read_file"), "source")
        .when(F.contains(text, F.lit("Traceback (most recent call last):")) | (F.size(F.filter("_lines", lambda x: x.rlike(FRAME))) >= 2), "traceback")
        .when(F.contains(text, F.lit("diff --git ")) | (any_(HUNK) & any_(r"^(?:\+\+\+|---) ")), "diff")
        .when(text.rlike(TEST_SIGNAL), "test_log")
        .when(any_(GREP), "grep")
        .when(any_(BRANCH), "tree")
        .when(F.coalesce("path", F.lit("")).rlike(r"(?i)\." + T._any("c h cc go js py rs ts cpp hpp jsx pyi tsx java") + "$") | any_(T.A_STRUCTURE), "source")
        .otherwise("generic")
    )
    return df.withColumn("_lines", lines).withColumn("tool_type", kind).drop("_lines")


#: (kind, reason, pattern, score, expands): each rule that fires adds its score, and its line has to stay.
RULES = [
    ("grep", "grep_hit", GREP, 10, True),
    ("grep", "grep_definition", f"{T.A_STRUCTURE}|{DECLARATION}", 3, False),
    ("traceback", "traceback_header", r"Traceback \(most recent call last\):", 10, False),
    ("traceback", "traceback_frame", FRAME, 10, True),
    ("traceback", "traceback_exception", EXCEPTION, 13, True),
    ("traceback", "traceback_error", T.A_ERROR, 10, True),
    ("diff", "diff_header", rf"^(?:index |--- |\+\+\+ |diff --git )|{HUNK}", 3, False),
    ("diff", "diff_change", r"^(?!--- |\+\+\+ )[+-]", 10, True),
    ("test_log", "test_failure", TEST_SIGNAL, 10, True),
    ("test_log", "test_file_line", FILE_LINE, 10, True),
    ("test_log", "test_error", T.A_ERROR, 10, True),
    ("generic", "generic_structure", T.A_STRUCTURE, 3, True),
    ("generic", "generic_error", T.A_ERROR, 10, True),
    ("source", "source_error", T.A_ERROR, 10, True),
    ("source", "source_signature", T.A_STRUCTURE, 3, True),
]


def query_symbols(query: Column) -> Column:
    """Distinct lower-case identifiers of the query, their parts, and its plain words of more than one character."""
    query = F.coalesce(query, F.lit(""))
    found = T.identifiers(query)
    parts = F.flatten(F.transform(found, lambda x: F.split(x, r"[.:\-/]+")))
    return F.filter(F.array_distinct(F.concat(found, parts, F.transform(T.extract(query, "[A-Za-z_][A-Za-z0-9_]*"), F.lower))), lambda x: F.length(x) > 1)


def branch_depth(line: Column) -> Column:
    """Depth by the prefix of a branch glyph in steps of four, tabs to the next step; without a glyph, by indentation in steps of two."""
    chars = F.filter(F.split(F.regexp_extract(line, "(?U)" + BRANCH, 1), ""), lambda c: c != "")
    wide = F.aggregate(chars, F.lit(0), lambda n, c: F.when(c == "\t", n + 4 - n % 4).otherwise(n + 1))
    depth = F.when(line.rlike("(?U)" + BRANCH), F.floor(wide / 4) + 1).otherwise(F.floor(F.length(F.regexp_extract(line, r"(?U)^(\s*)", 1)) / 2))
    return depth.cast("int")


def _query_hits(lines: DataFrame, symbols: str, id_cols: tuple[str, ...], shallow: int = 1) -> tuple[DataFrame, list[tuple]]:
    """lines with columns for the rules of the query's symbols and of trees; and these rules: condition, reason, score, expands."""
    tree = F.col("tool_type") == "tree"
    own = T.identifiers(F.col("line"))
    leaves = F.flatten(F.transform(own, lambda x: F.split(x, r"[.:\-/]+")))
    x = lines.withColumns({"_match": F.arrays_overlap(symbols, F.concat(own, leaves)), "_hit": tree & F.exists(symbols, lambda s: F.contains(F.lower("line"), s)), "_depth": F.when(tree, branch_depth(F.col("line")))})
    later = F.collect_list(F.when(tree, F.struct("line_no", "_depth", "_hit"))).over(Window.partitionBy(*id_cols).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing))
    end = F.coalesce(F.array_min(F.transform(F.filter("_later", lambda a: a["_depth"] <= F.col("_depth")), lambda a: a["line_no"])), F.lit(1 << 31))
    x = x.withColumn("_later", later).withColumn("_end", end)
    below = F.when(tree, F.size(F.filter("_later", lambda a: a["_hit"] & (a["line_no"] < F.col("_end"))))).otherwise(0)
    x = x.withColumn("_below", below).drop("_later", "_end")
    return x, [(F.col("_match"), "query_symbol_match", 9, True), (tree & (F.col("_depth") <= shallow), "tree_shallow", 3, False), (F.col("_hit"), "tree_query_hit", 10, True), (F.col("_below") > 0, "tree_ancestor", 3 * F.col("_below"), False)]


def execution_rules(lines: DataFrame, *id_cols: str, window: int = 1, base: float = 0.01, context: float = 1.0, symbols: str | None = None) -> DataFrame:
    """`score`, `reasons`, `mandatory`, `seed` of lines (ids, tool_type, line_no, line); lines near a seed get the context's score.

    symbols: a column of the query's symbols; with it, lines that hold one count, and so do shallow lines of trees, and hits there with their ancestors (once a hit).
    """
    hits = [((F.col("tool_type") == k) & F.col("line").rlike(p), r, s, e) for k, r, p, s, e in RULES]
    if symbols:
        lines, more = _query_hits(lines, symbols, id_cols)
        hits = [*more, *hits]
    fired = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r, _, _ in hits)))
    score = sum((F.when(c, s * F.lit(1.0)).otherwise(0.0) for c, _, s, _ in hits), F.lit(base))
    hunk = (F.col("tool_type") == "diff") & F.col("line").rlike(HUNK)
    seed = F.exists(F.array(*(c for c, _, _, e in hits if e), hunk), lambda x: x)
    by = Window.partitionBy(*id_cols).orderBy("line_no").rowsBetween(-window, window)
    x = lines.withColumns({"reasons": fired, "score": score, "seed": seed}).withColumn("_near", F.max(F.col("seed").cast("int")).over(by) == 1)
    x = x.withColumn("mandatory", F.size("reasons") > 0)
    return x.withColumns({"score": F.col("score") + F.when(F.col("_near") & ~F.col("seed"), context).otherwise(0.0), "reasons": F.when(F.col("_near") & ~F.col("seed"), F.concat("reasons", F.array(F.lit("context")))).otherwise(F.col("reasons"))}).drop("_near", "_match", "_hit", "_depth", "_below")


def tree_ancestors(lines: DataFrame, hits: DataFrame, *id_cols: str) -> DataFrame:
    """(ids, line_no) of the lines that are ancestors of hit lines: earlier ones of less depth with nothing as shallow between.

    A line's subtree ends before the next line of at most its depth, so it is an
    ancestor if a hit lies in that range.
    """
    by = Window.partitionBy(*id_cols).orderBy("line_no")
    x = lines.join(hits.withColumn("hit", F.lit(True)), [*id_cols, "line_no"], "left")
    later = F.collect_list(F.struct("line_no", "depth", F.coalesce("hit", F.lit(False)).alias("hit"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    end = F.coalesce(F.array_min(F.transform(F.filter("_l", lambda a: a["depth"] <= F.col("depth")), lambda a: a["line_no"])), F.lit(1 << 31))
    return x.withColumn("_l", later).where(F.exists("_l", lambda a: a["hit"] & (a["line_no"] < end))).select(*id_cols, "line_no")


def python_definitions(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, kind, name, start_line, end_line) of functions and classes, from the line of def or class on; none for a text that isn't Python."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for part in parts:
            out = []
            for i, text in zip(part[id_col], part[text_col]):
                try:
                    nodes = list(ast.walk(ast.parse(text or "")))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for n in nodes:
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        out.append((i, type(n).__name__, n.name, n.lineno, n.end_lineno))
            yield pd.DataFrame(out, columns=[id_col, "kind", "name", "start_line", "end_line"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, kind string, name string, start_line bigint, end_line bigint")


def code_aware_blocks(df: DataFrame, id_col: str, text_col: str = "text", *, max_lines: int = 24) -> DataFrame:
    """(id, start_line, end_line): a Python text's definitions, which may nest; the paragraphs of any other text."""
    code = python_definitions(df, id_col, text_col).select(id_col, F.col("start_line").cast("int"), F.col("end_line").cast("int"))
    rest = df.join(code.select(id_col).distinct(), id_col, "left_anti")
    return code.union(paragraph_blocks(split_lines(rest, id_col, text_col=text_col), id_col, max_lines=max_lines).select(id_col, "start_line", "end_line"))


def ranked_blocks(df: DataFrame, id_col: str, *, max_lines: int = 16) -> DataFrame:
    """Evidence blocks of (id, text, command, path, query) with BM25, identifier overlap, fused rank and discriminative hits."""
    kinds = classify_output(df)
    lines = split_lines(kinds, id_col, "kind", "query")
    blocks = evidence_blocks(lines, id_col, "query", max_lines=max_lines).withColumn("tokens", T.terms(F.col("text")))
    intent = kinds.select(id_col, T.terms(F.col("query")).alias("tokens"))
    scores = bm25(blocks, intent, id_col, "block", least_average=1.0)
    wanted = df.select(id_col, T.strict_identifiers(F.col("query")).alias("_ids"))
    x = blocks.join(scores, [id_col, "block"]).join(wanted, id_col)
    x = x.withColumn("identifier_hits", F.size(F.array_intersect(T.strict_identifiers(F.col("text")), "_ids")).cast("double"))
    x = x.withColumn("reason_count", F.size("reasons").cast("double"))
    fused = reciprocal_rank_fusion(x, id_col, components=["bm25", "identifier_hits", "reason_count"], by="block")
    n = F.count("*").over(Window.partitionBy(id_col))
    df_ = document_frequency(blocks, id_col, "block").join(intent.select(id_col, F.explode(F.array_distinct("tokens")).alias("term")), [id_col, "term"], "left_semi")
    rare = fused.select(id_col, "block", n.alias("n"), F.explode(F.array_distinct("tokens")).alias("term")).join(df_, [id_col, "term"]).where(F.col("df") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.1))).groupBy(id_col, "block").agg(F.count("*").alias("rare_terms"))
    order = Window.partitionBy(id_col).orderBy(F.round("rrf", 12).desc(), "block")
    return fused.join(rare, [id_col, "block"], "left").fillna(0, ["rare_terms"]).withColumn("rank", F.row_number().over(order)).drop("_ids", "tokens")


def select_blocks(ranked: DataFrame, id_col: str, method: str, *, ratio: float = 0.5) -> DataFrame:
    """The blocks that a method keeps: hard ones, and then

    safe_rules: the ones next to hard ones; intent_ir: the best ranked until the
    ratio's lines are reached; intent_structure: those and, around blocks with
    rare intent terms, the neighbours within 1 (2 for tracebacks and tests).
    """
    by = Window.partitionBy(id_col)
    x = ranked.withColumns({"_size": F.col("end_line") - F.col("start_line") + 1, "_r": F.when(F.col("kind").isin("traceback", "test_log"), 2).otherwise(1)})
    x = x.withColumns({"_all": F.sum("_size").over(by), "_hard": F.sum(F.when(F.col("is_hard"), F.col("_size")).otherwise(0)).over(by)})
    order = by.orderBy("rank")
    soft = F.when(~F.col("is_hard") & (F.col("rrf") > 0), F.col("_size")).otherwise(0)
    before = F.coalesce(F.sum(soft).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_hard")
    fill = (F.col("rrf") > 0) & (before < F.greatest(F.lit(1), F.ceil(F.col("_all") * min(0.9, max(0.1, ratio)))))
    place = by.orderBy("block")
    hard_near = F.max(F.col("is_hard").cast("int")).over(place.rowsBetween(-1, 1)) == 1
    if method == "safe_rules":
        keep: Column = F.col("is_hard") | hard_near
    else:
        keep = F.col("is_hard") | fill
        if method == "intent_structure":
            one, two = (F.max((F.col("rare_terms") > 0).cast("int")).over(place.rowsBetween(-r, r)) == 1 for r in (1, 2))
            keep = keep | F.when(F.col("_r") == 2, two).otherwise(one)
    return x.withColumn("keep", keep).drop("_size", "_r", "_all", "_hard")


def cost_gate(df: DataFrame, *, min_tokens: int = 1500, min_savings: int = 256, max_retention: float = 0.85, max_chars: int = 9000) -> DataFrame:
    """(status, reason) of (text, kind, n_lines, kept_lines, compact): the first gate that holds leaves the text as it is."""
    before, after = T.token_estimate_lexical(F.coalesce("text", F.lit(""))), T.token_estimate_lexical(F.coalesce("compact", F.lit("")))
    reason = (
        F.when(F.coalesce("text", F.lit("")) == "", "empty-output")
        .when(before < min_tokens, "below-min-input-tokens")
        .when(F.col("kind") == "diff", "diff-is-never-pruned")
        .when(F.col("kept_lines") >= F.col("n_lines"), "no-safe-reduction")
        .when(F.col("kept_lines") / F.col("n_lines") > max_retention, "retention-above-cost-gate")
        .when(F.length("compact") > max_chars, "output-cap-left-no-evidence")
        .when(before - after < min_savings, "insufficient-token-savings")
        .otherwise("pruned")
    )
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "pruned", "pruned").otherwise("unchanged"))
