from __future__ import annotations

import itertools
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import urlfilter

COUNTS = {"cat": 50, "food": 40, "cats": 9, "foo": 3, "d": 2, "casino": 30, "win": 20, "big": 20}


def cost(words, total):
    return sum(-math.log(COUNTS[w] / total) if w in COUNTS else math.log(total) - math.log(10) + len(w) * math.log(10) for w in words)


def splits(name):
    for cuts in itertools.product((0, 1), repeat=max(0, len(name) - 1)):
        out = [""]
        for c, cut in zip(name, (*cuts, 0)):
            out[-1] += c
            if cut:
                out.append("")
        yield out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["cat", "food", "s", "foo", "d", "xq", "win"]), min_size=1, max_size=4).map("".join))
def test_viterbi_is_the_best_split(name):
    total = float(sum(COUNTS.values()))
    known = {(i, j): COUNTS[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in COUNTS}
    got = urlfilter.viterbi(name, known, total)
    assert "".join(got) == name
    assert abs(cost(got, total) - min(cost(s, total) for s in splits(name))) < 1e-9


def tables(spark):
    docs = spark.createDataFrame([(i, " ".join(w for w, n in COUNTS.items() for _ in range(n))) for i in range(3)], "doc_id long, text string")
    pages = [(i, f"https://www.{'bigcasinowin' if i % 2 else 'catfood'}{i % 7}.example.com/en/{i}?ref={'spam' if i % 2 else 'x'}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    return docs, pages, labels


def test_held_out_pages(spark):
    docs, pages, labels = tables(spark)
    got = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), docs, labels).collect()}
    assert len(got) == 60
    assert got[1].host_words == ["www", "big", "casino", "win", "#", "example"]
    assert all(got[i].is_bad == bool(i % 2) for i in range(60))  # 40 to 59 had no label


def test_scores_equal_brute_force(spark):
    docs, pages, labels = tables(spark)
    counts = urlfilter.word_counts(docs)
    rows = urlfilter.url_tokens(spark.createDataFrame(pages, "page_id long, url string"), counts)
    tokens = {r.page_id: r.tokens for r in rows.collect()}
    seen = [(t, i % 2) for i in range(40) for t in tokens[i]]
    vocabulary = {t for t, _ in seen}
    total = [sum(c == k for _, c in seen) for k in (0, 1)]

    def weight(t):
        b, g = (sum(x == t and c == k for x, c in seen) for k in (1, 0))
        return math.log((b + 1) / (total[1] + len(vocabulary))) - math.log((g + 1) / (total[0] + len(vocabulary)))

    got = {r.page_id: r.score for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), docs, labels).collect()}
    for i, ts in tokens.items():
        assert abs(got[i] - sum(weight(t) for t in ts if t in vocabulary)) < 1e-9


def test_repeats_count_and_long_words_are_known(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    docs = spark.createDataFrame([(1, f"{long} {long} cat")], "doc_id long, text string")
    rows = urlfilter.url_tokens(spark.createDataFrame([(1, f"http://{long}cat.com/2021/05/x/x")], "page_id long, url string"), urlfilter.word_counts(docs)).first()
    assert rows.host_words == [long, "cat"] and rows.tokens == [f"h:{long}", "h:cat", "p:#", "p:#", "p:x", "p:x"]


def test_odd_rows(spark):
    docs, _, labels = tables(spark)
    pages = spark.createDataFrame([(1, None), (None, ""), (2, "no url at all"), (3, "https://" + "a" * 5000 + ".com/" + "x" * 90_000), (4, "http://catfood.org/9"), (4, "http://catfood.org/9"), (5, "http://[::1]:80/1"), (6, "//user:pw@casino.net:8080/9")], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS tokens", "2 AS words", "3 AS score", "4 AS label")
    got = urlfilter.filter_urls(pages, docs, labels).collect()
    assert len(got) == 8
    by = {r.page_id: r for r in got}
    assert by[1].host_words == [] and by[4].host_words == ["cat", "food"] and by[6].host_words == ["casino"]
    assert len(by[3].host_words) > 0
    assert urlfilter.filter_urls(pages.where("false"), docs, labels).collect() == []
    none = urlfilter.filter_urls(pages, docs.where("false"), labels.where("false")).collect()
    assert len(none) == 8 and all(r.score == 0 and not r.is_bad for r in none)
