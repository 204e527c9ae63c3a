"""URL filter: host names split into words by a unigram Viterbi, then multinomial naive Bayes over host and path tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._shared import small, written

SMOOTHING = 1.0
THRESHOLD = 0.0
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"


def url_host(url: Column) -> Column:
    """The host in lower case; empty if there is none, null for a null."""
    return F.lower(F.regexp_extract(url, _URL, 1))


def path_tokens(url: Column) -> Column:
    """'p:' tokens of path and query in lower case, repeats included, digits as '#'; of all the text if it isn't a URL with a host."""
    rest = F.when(url.rlike(_URL), F.regexp_extract(url, _URL, 2)).otherwise(F.coalesce(url, F.lit("")))
    words = F.split(F.regexp_replace(F.lower(rest), "[0-9]+", "#"), "[^\\p{L}#]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit("p:"), w))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n, chars): how often each word, by its hash, is in all the texts, in lower case without ASCII punctuation, and how long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, long = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            data, offsets = _text.buffers(b.column(0))
            for lo, hi in _text.chunks(offsets):
                part, off = _text.fold(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                t = _text.tokens(part, off)
                chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                found.append(t.hash)
                long.append(chars[t.end] - chars[t.start])
            word, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(np.concatenate(long)[first].astype(np.int32))], names=["h", "n", "chars"])

    return docs.select(text_col).mapInArrow(run, "h bigint, n bigint, chars int").groupBy("h").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"))


def substrings(names: DataFrame, longest: int) -> DataFrame:
    """(name, i, j, h) of each name's substrings that are as long as the corpus's longest word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                most = min(len(name), longest)
                step = max(1, (1 << 20) // max(1, most * most))
                for at in range(0, len(name) if most else 0, step):
                    spans = [(i, j) for i in range(at, min(at + step, len(name))) for j in range(i + 1, min(len(name), i + most) + 1)]
                    data, off = _text.buffers(pa.array([name[i:j] for i, j in spans], pa.string()))
                    h = _text.hash_spans(data, off[:-1], off[1:]).view(np.int64)
                    i, j = zip(*spans)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(spans)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(h)], names=["name", "i", "j", "h"])

    return names.mapInArrow(run, "name string, i int, j int, h bigint")


def viterbi(name: str, known: dict[tuple[int, int], int], total: float) -> list[str]:
    """The words of most probable product: n / total for a known word, 10 / (total * 10 ** length) for any other string.

    Of equally probable splits the one whose last word is the longest known one counts; neighbours
    of unknown characters stay together.
    """
    n, every = len(name), math.log(max(total, 2.0))
    ends: dict[int, list[tuple[int, int]]] = {}
    for (i, j), k in sorted(known.items(), reverse=True):
        ends.setdefault(j, []).append((i, k))
    start = every - math.log(10)
    best = [0.0] + [math.inf] * n  # cost of the best split, and the place before its last word
    back = [0] * (n + 1)
    open_, begun = math.inf, 0  # cost of the best split with an unknown word that may go on
    for j in range(1, n + 1):
        if best[j - 1] + start <= open_:
            open_, begun = best[j - 1] + start, j - 1
        open_ += math.log(10)
        best[j], back[j] = open_, begun
        for i, k in ends.get(j, ()):
            if best[i] + every - math.log(k) <= best[j]:
                best[j], back[j] = best[i] + every - math.log(k), i
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of the distinct non-empty names, under the word counts (h, n, chars)."""
    total, longest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double"), F.coalesce(F.max("chars"), F.lit(0))).first()
    names = written(names.where("name <> ''").distinct(), "names")
    arcs = counts.drop("chars").join(substrings(names, longest), "h").groupBy("name").agg(F.collect_list(F.struct("i", "j", "n")).alias("arcs"))
    rows = names.join(arcs, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [viterbi(name, {(a["i"], a["j"]): a["n"] for a in arcs or ()}, total) for name, arcs in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return rows.mapInArrow(run, "name string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): each distinct host's labels, the last one aside, split into words in their order; numbers as '#'."""
    labels = written(hosts.select("host").where("host <> ''").distinct().select("host", F.posexplode(F.split("host", "\\.")).alias("at", "label")), "labels")
    last = F.max("at").over(Window.partitionBy("host"))
    parts = labels.withColumn("last", last).where("at < last or last = 0").select("host", "at", F.posexplode(F.split(F.regexp_replace("label", "[0-9]+", "-#-"), "[^\\p{L}#]+")).alias("part", "name")).where("name <> ''")
    words = segment_names(parts.select("name"), counts)
    joined = parts.join(small(words), "name")
    return joined.groupBy("host").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "part", "words")))["words"]).alias("words"))


def url_tokens(pages: DataFrame, counts: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host_words, tokens) of every row: tokens are the 'h:' words of its host and the 'p:' tokens of its path, repeats included."""
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"), url_host(F.col(url_col).cast("string")).alias("host"))
    words = written(host_words(rows, counts), "hosts").withColumnRenamed("host", "_host")
    joined = rows.join(small(words), rows["host"] == F.col("_host"), "left")
    none = F.array().cast("array<string>")
    h = F.transform(F.coalesce("words", none), lambda w: F.concat(F.lit("h:"), w))
    return joined.select(id_col, "url", F.coalesce("words", none).alias("host_words"), F.concat(h, path_tokens(F.col("url"))).alias("tokens"))


def train(rows: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(token, weight) of rows (tokens, bad): the log of how much likelier each token is in bad URLs; token '' has the prior.

    Every occurrence counts, over all rows.  Rows of a null label are left out; without rows of both classes there are no tokens.
    """
    given = rows.where("bad is not null")
    n = given.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    seen = given.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    seen = written(seen, "tokens")
    b, g, v = seen.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0)), F.count("*")).first()
    if not n[0] or not n[1]:
        return rows.sparkSession.createDataFrame([], "token string, weight double")
    rate = lambda c, total: F.log((F.col(c) + smoothing) / (total + smoothing * v))
    prior = rows.sparkSession.createDataFrame([("", math.log(n[0] / n[1]))], "token string, weight double")
    return seen.select("token", (rate("b", b) - rate("g", g)).alias("weight")).union(prior)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a number each, written, so that the numbers stay."""
    return written(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")


def score(rows: DataFrame, model: DataFrame, *, id_col: str = "page_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, url, host_words, score, is_bad) of every row (id, url, host_words, tokens): the log odds that it is bad.

    Tokens that training didn't see say nothing.  A null URL has the prior's score; under an empty model all scores are 0.
    """
    prior = model.where("token = ''").first()
    prior = prior["weight"] if prior else 0.0
    rows = rows if "_row" in rows.columns else _numbered(rows)
    each = rows.select("_row", F.explode("tokens").alias("token"))
    weights = each.join(small(model.where("token <> ''")), "token").groupBy("_row").agg(F.sum("weight").alias("_w"))
    total = F.coalesce("_w", F.lit(0.0)) + F.lit(prior)
    return rows.join(weights, "_row", "left").select(id_col, "url", "host_words", total.alias("score"), (total > threshold).alias("is_bad"))


def filter_urls(pages: DataFrame, docs: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", doc_id: Column | None = None) -> DataFrame:
    """Every page with its host's words and its score; is_bad ones are what the filter would drop.

    Words are counted over all docs' texts.  labels (doc_id, quality, toxic) say
    which documents are bad (quality 0 or toxic 1); doc_id gives the document of
    a page's URL, by default the first number in its path.  URLs that are null,
    empty or no URLs have no host words and are scored by what tokens they have;
    names and words may be of any length; repeated rows are scored alike; an
    empty table has no rows; other columns are not read.
    """
    counts = written(word_counts(docs), "words")
    rows = _numbered(url_tokens(pages, counts, id_col=id_col, url_col=url_col))
    doc = doc_id if doc_id is not None else F.try_to_number(F.nullif(F.regexp_extract(F.regexp_extract("url", _URL, 2), r"^[^?]*?/([0-9]{1,18})(?:[/.?]|$)", 1), F.lit("")), F.lit("9" * 18)).cast("bigint")
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).withColumnRenamed("doc_id", "_doc")
    labelled = rows.withColumn("_doc", doc).join(bad, "_doc").select("tokens", "bad")
    return score(rows, train(labelled), id_col=id_col)
