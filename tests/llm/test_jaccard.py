from __future__ import annotations

import random
import re

from tracemill.llm import jaccard


def grams(text, n=3):
    w = re.sub(r"[!-/:-@\[-`{-~]", "", text).lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def pairs(df):
    """Every pair of documents: rows of jaccard 1 tell the classes, others pair all of two classes."""
    got = df.collect()
    of = {}
    for r in got:
        assert r.id_a < r.id_b
        if r.jaccard == 1:
            of.setdefault(r.id_a, [r.id_a]).append(r.id_b)
    out = {}
    found = [(a, b, 1.0) for x in of.values() for k, a in enumerate(sorted(x)) for b in sorted(x)[k + 1 :]]
    found += [(a, b, r.jaccard) for r in got if r.jaccard < 1 for a in of.get(r.id_a, [r.id_a]) for b in of.get(r.id_b, [r.id_b])]
    for a, b, j in found:
        assert tuple(sorted((a, b))) not in out
        out[tuple(sorted((a, b)))] = round(j, 9)
    return out


def brute(texts, t=0.6):
    want = {}
    sets = [grams(x) for x in texts]
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and len(x & y) >= t * len(x | y) - 1e-9:
                want[b, a] = round(len(x & y) / len(x | y), 9)
    return want


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def some_texts():
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = random.choices(words, k=random.randint(1, 90))
        for _ in range(random.randint(1, 6)):
            copy = [random.choice(words) if random.random() < 0.03 else w for w in base]
            texts.append(" ".join(copy).capitalize() + random.choice([".", "", "!"]))
    passage = " ".join(words[:30])
    return texts + [f"{passage} {' '.join(random.choices(words, k=40))}" for _ in range(30)]


def test_all_pairs_of_brute_force(spark):
    texts = some_texts()
    want = brute(texts)
    assert len(want) > 50
    assert pairs(jaccard.ngram_jaccard_join(table(spark, texts))) == want


def test_no_pair_of_a_template_is_missed(spark):
    """Over 100 sets share a core, and each has n-grams that only its own near copy shares; all pairs are similar enough."""
    core = [f"c{i}" for i in range(160)]
    texts = []
    for page in range(60):
        own = [f"p{page}x{i}" for i in range(46)]
        texts += [" ".join(core + own + [f"p{page}y{k}"]) for k in range(2)]
    want = brute(texts)
    assert len(want) == 120 * 119 // 2
    assert pairs(jaccard.ngram_jaccard_join(table(spark, texts))) == want


def test_quoted_sections_hide_no_pair(spark):
    """140 pages of one template, each with a section that one other text quotes: J = 80 / 124 for any two pages."""
    core = [f"c{i}" for i in range(82)]
    own = [[f"p{page}x{i}" for i in range(22)] for page in range(140)]
    texts = [" ".join(core + x) for x in own] + [" ".join([f"q{k}y{i}" for i in range(80)] + x) for k, x in enumerate(own)]
    want = brute(texts)
    assert len(want) == 9730 and set(want.values()) == {round(80 / 124, 9)}
    assert pairs(jaccard.ngram_jaccard_join(table(spark, texts))) == want
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each_group(table(spark, texts)).collect()) == [0, *range(140, 280)]


def test_parts_and_packed_rows_change_nothing(spark, monkeypatch):
    texts = some_texts()
    monkeypatch.setattr(jaccard, "_POSTINGS", 300)
    assert pairs(jaccard.ngram_jaccard_join(table(spark, texts))) == brute(texts)


def test_one_of_each_group_stays(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    root = list(range(len(texts)))
    for a, b in sorted(brute(texts)):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    kept = jaccard.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_odd_rows(odd_docs, no_docs):
    assert pairs(jaccard.ngram_jaccard_join(odd_docs)) == {(5, 6): 1.0}
    kept = jaccard.keep_one_of_each_group(odd_docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 5, 7, 8, None]
    assert kept.columns == odd_docs.columns
    assert jaccard.ngram_jaccard_join(no_docs).collect() == []
    assert jaccard.keep_one_of_each_group(no_docs).collect() == []


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100}


def classes(texts, rows, t=0.6):
    """(id, class, links) by brute force; rows: (id, text number)."""
    links, root = dict.fromkeys((i for i, _ in rows), 0), {i: i for i, _ in rows}
    near = brute(texts, t)
    for a, x in sorted(set(rows)):
        for b, y in sorted(set(rows)):
            if (a, x) != (b, y) and (tuple(sorted((x, y))) in near or (x == y and a != b)):
                links[a] += 1
                p, q = root[a], root[b]
                root = {i: min(p, q) if r in (p, q) else r for i, r in root.items()}
    return sorted((i, root[i], links[i]) for i in links)


def test_classes_and_links_of_brute_force(spark, monkeypatch):
    texts = some_texts()
    want = classes(texts, [(i, i) for i in range(len(texts))])
    assert len({c for _, c, _ in want}) < len(want) and max(n for *_, n in want) > 4
    for few, cells in ((40, 1 << 24), (0, 1 << 10)):
        monkeypatch.setattr(jaccard, "_FEW_PAIRS", few)
        monkeypatch.setattr(jaccard, "_CELLS", cells)
        assert sorted(map(tuple, jaccard.near_copy_classes(table(spark, texts)).collect())) == want


def test_classes_of_one_template(spark):
    core = [f"c{i}" for i in range(82)]
    texts = [" ".join(core + [f"p{page}x{i}" for i in range(22)]) for page in range(140)]
    assert sorted(map(tuple, jaccard.near_copy_classes(table(spark, texts)).collect())) == [(i, 0, 139) for i in range(140)]


def test_classes_that_share_their_smallest_id(spark):
    """Id 5 has two texts, which are near copies of each other and equal to those of 7 and 9: 7 and 9 are a pair."""
    words = [f"a{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:-2], "zz", "yy"])]
    rows = [(5, 0), (7, 0), (5, 1), (9, 1), (11, 1)]
    df = spark.createDataFrame([(i, texts[k]) for i, k in rows], "doc_id long, text string")
    got = [(r.id_a, r.id_b) for r in jaccard.ngram_jaccard_join(df).collect() if r.jaccard < 1]
    assert {(7, 9), (7, 11)} <= set(got) and len(got) == len(set(got))
    assert sorted(map(tuple, jaccard.near_copy_classes(df).collect())) == classes(texts, rows)


def test_low_thresholds_lose_no_pair(spark):
    """At 0.4 the bitmaps of two bands may differ by a factor of four; unfolded ones kept this pair too."""
    words = [f"a{i}" for i in range(702)]
    texts = [" ".join(words[:502]), " ".join(words)]
    want = brute(texts, 0.4)
    assert len(want) == 1
    assert pairs(jaccard.ngram_jaccard_join(table(spark, texts), threshold=0.4)) == want


def test_classes_of_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, jaccard.near_copy_classes(odd_docs).collect()))
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 8, 0)]
    assert jaccard.near_copy_classes(no_docs).collect() == []
