"""Typed codecs: an observation's units by its kind, and the views that are made of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_VIEWS = "array<struct<level:int,content:string,relevance:double>>"

class Codec(NamedTuple):
    """How one kind is cut: lines of `special` reasons are units, those of `mandatory` ones stay; a match keeps `radius` units around."""

    name: str
    radius: int = 0
    special: tuple[str, ...] = ()
    mandatory: tuple[str, ...] = ()
    one_line: bool = False
    compacts: bool = True


CODECS = {
    "source": Codec("source_structure", 1, ("structure", "error", "source-location"), ("structure", "error")),
    "diff": Codec("diff_full", compacts=False),
    "traceback": Codec("traceback_frames", 2, ("error", "trace-frame", "source-location"), ("error", "trace-frame")),
    "test_log": Codec("test_failures", 2, ("error", "trace-frame", "source-location", "test-failure"), ("error", "trace-frame", "test-failure")),
    "search": Codec("search_hits", 0, (), ("error",), one_line=True),
    "tree": Codec("tree_paths", 0, (), ("error",), one_line=True),
    "generic": Codec("generic_evidence", 1, ("error", "source-location", "test-failure"), ("error", "test-failure")),
}


def _of(field: str, kind: str = "kind") -> Column:
    """A field of the kind's codec."""
    values = {k: getattr(c, field) for k, c in CODECS.items()}
    one = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v)
    out = one(values["generic"])
    for k, v in values.items():
        out = F.when(F.col(kind) == k, one(v)).otherwise(out)
    return out


def unit_ranges(special: Column, max_lines: int = 16) -> Column:
    """Units as structs (s, e) of their first and last line, from 0: each special line (array of booleans, one a line) is one, the others are cut into pieces of at most max_lines."""
    n, ints = F.size(special), F.array().cast("array<int>")
    at = F.filter(F.transform(special, lambda x, i: F.when(x, i)), lambda x: x.isNotNull())

    def cut(at: Column) -> Column:
        def starts(p: Column, k: Column) -> Column:
            after = F.coalesce(F.get(at, k), n)
            return F.concat(F.when(p >= 0, F.array(p)).otherwise(ints), F.when(p + 1 < after, F.sequence(p + 1, after - 1, F.lit(max_lines))).otherwise(ints))

        return F.flatten(F.transform(F.concat(F.array(F.lit(-1)), at), starts))

    ends = lambda starts: F.transform(starts, lambda s, k: F.struct(s.alias("s"), (F.coalesce(F.get(starts, k + 1), n) - 1).alias("e")))
    return T.let(T.let(at, cut), ends)


def _sum(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def rare_terms(found: Column, signals: Column, *, max_df_ratio: float | None = 0.1) -> Column:
    """The signals (structs of term and weight, a term once) whose term is in some unit, of units' terms `found` (an array each).

    A term in more than max(2, ceil(units * max_df_ratio)) units doesn't count;
    without a ratio all do.
    """
    most = F.size(found) if max_df_ratio is None else F.greatest(F.lit(2), F.ceil(F.size(found) * F.lit(max_df_ratio)))
    df = lambda all_, t: F.size(F.filter(all_, lambda x: x == t["term"]))
    return T.let(F.flatten(found), lambda all_: F.filter(signals, lambda t: df(all_, t).between(1, most)))


def shown(lines: Column, units: Column, keep: Column, *, label: str = "context") -> Column:
    """The lines of units (s, e) that are kept (array of booleans, the first and the last unit are), what is left out told as render_omissions() does."""

    def body(kept: Column) -> Column:
        def one(u: Column, j: Column) -> Column:
            first, last = u["e"] + 2, F.get(kept, j + 1)["s"]
            what = F.when(first == last, F.concat(F.lit("line "), first.cast("string"))).otherwise(F.concat(F.lit("lines "), first.cast("string"), F.lit("-"), last.cast("string")))
            gap = F.when(first <= last, F.array(F.concat(F.lit(f"... [{label} omitted "), what, F.lit("] ...")))).otherwise(F.array().cast("array<string>"))
            return F.concat(F.slice(lines, u["s"] + 1, u["e"] - u["s"] + 1), gap)

        return F.array_join(F.flatten(F.transform(kept, one)), "\n")

    return T.let(F.filter(units, lambda u, k: F.get(keep, k)), body)


def typed_views(df: DataFrame, signals: DataFrame | str, id_col: str, *, text_col: str = "text", max_lines: int = 16, max_chars: int | None = None, tag: str = "context_view") -> DataFrame:
    """(id, level, codec, content, tokens, relevance): the views of observations (id, kind, text) that a prompt may hold.

    Level 0 is a reference, 1 the mandatory units, 2 these and what the signals
    (id, term, weight) match with its neighbours, 3 the whole text.  A view that
    isn't shorter than the text, or longer than max_chars, is left out; texts of
    a kind that isn't compacted, and empty ones, have level 3 only.  Signals may
    also be a column of df with structs of term and weight, a term once; all is
    told within the row then, and nothing is shuffled.
    """
    if isinstance(signals, DataFrame):
        each = signals.groupBy(id_col, "term").agg(F.sum("weight").cast("double").alias("weight")).groupBy(id_col).agg(F.collect_list(F.struct("term", "weight")).alias("_signals"))
        df, signals = df.join(each, id_col, "left"), "_signals"
    key, codec, kind = F.col(id_col).cast("string"), _of("name"), F.col("kind")
    text, none = F.coalesce(text_col, F.lit("")), F.lit(0.0)
    view = lambda level, content, relevance=none: F.struct(F.lit(level).alias("level"), content.alias("content"), relevance.alias("relevance"))
    counts = F.filter(F.coalesce(signals, F.array().cast("array<struct<term:string,weight:double>>")), lambda t: T.is_term(t["term"]))

    def compact(lines: Column, reasons: Column, units: Column, found: Column, rare: Column) -> Column:
        n = F.size(units)
        told = F.when(F.size(rare) > 0, F.concat(F.lit(" Matched signals: "), F.array_join(F.slice(F.array_sort(rare["term"]), 1, 12), ", "), F.lit("."))).otherwise("")
        head = lambda level: F.concat(F.lit(f'<{tag} observation_id="'), key, F.lit(f'" level="{level}" codec="'), codec, F.lit('">\nThis is a reversible view of an older tool observation.'), told, F.lit(f"\n</{tag}>\n"))
        scores = F.transform(found, lambda f: _sum(F.filter(rare, lambda t: F.array_contains(f, t["term"]))["weight"]))
        stays = F.transform(units, lambda u, k: (k == 0) | (k == n - 1) | F.arrays_overlap(F.flatten(F.slice(reasons, u["s"] + 1, u["e"] - u["s"] + 1)), _of("mandatory")))
        radius = _of("radius")

        def made(level: int, name: str, keep: Column, scores: Column) -> Column:
            return T.let(keep, lambda keep: view(level, F.concat(head(name), shown(lines, units, keep)), _sum(F.filter(scores, lambda x, k: F.get(keep, k)))))

        def levels(scores: Column, stays: Column) -> Column:
            near = lambda k: F.exists(F.slice(scores, F.greatest(F.lit(1), k + 1 - radius), F.least(k, radius) + radius + 1), lambda x: x > 0)
            focused = F.when(F.exists(scores, lambda x: x > 0), made(2, "focused", F.transform(stays, lambda x, k: x | near(k)), scores))
            return F.array(made(1, "skeleton", stays, scores), focused)

        return T.let(scores, lambda scores: T.let(stays, lambda stays: levels(scores, stays)))

    def terms_of(lines: Column, units: Column, signals: Column) -> Column:
        of = lambda u: F.transform(T.extract(F.array_join(F.slice(lines, u["s"] + 1, u["e"] - u["s"] + 1), "\n"), T.B_WORD), F.lower)
        return T.let(signals["term"], lambda terms: F.transform(units, lambda u: F.array_intersect(terms, of(u))))

    def views(lines: Column, reasons: Column, signals: Column) -> Column:
        special = F.transform(reasons, lambda r: _of("one_line") | F.arrays_overlap(r, _of("special")))
        compacts = lambda units: T.let(terms_of(lines, units, signals), lambda found: T.let(rare_terms(found, signals), lambda rare: compact(lines, reasons, units, found, rare)))
        reference = F.concat(F.lit('<observation_reference id="'), key, F.lit('" kind="'), kind, F.lit('">\nOlder tool output archived with '), F.size(lines).cast("string"), F.lit(" visible lines. Use memory.search or memory.read with observation id "), key, F.lit(" to inspect it.\n</observation_reference>"))
        return F.concat(F.array(view(0, reference)), T.let(unit_ranges(special, max_lines), compacts))

    def all_views(text: Column) -> Column:
        fits = lambda v: (F.length(v["content"]) < F.length(text)) & (F.lit(True) if max_chars is None else F.length(v["content"]) <= max_chars)
        some = lambda lines: F.when(_of("compacts") & (F.size(lines) > 0), T.let(F.transform(lines, T.line_reasons), lambda r: T.let(counts, lambda s: F.filter(views(lines, r, s), fits))))
        return T.let(T.let(T.split_lines(text), some), lambda v: F.concat(F.coalesce(v, F.array().cast(_VIEWS)), F.array(view(3, text))))

    x = df.select(id_col, codec.alias("codec"), F.explode(T.let(text, all_views)).alias("v"))
    x = x.select(id_col, "v.level", "codec", "v.content", "v.relevance")
    return x.select(id_col, "level", "codec", "content", T.token_estimate_max(F.col("content")).alias("tokens"), "relevance")
