from __future__ import annotations

import math
import random

import pyarrow as pa
from llm.conftest import SMALL
from pyspark.sql import functions as F

from tracemill.llm import _text, toxicity


def prose(spark, n, seed):
    random.seed(seed)
    words, nasty = [f"w{i}" for i in range(500)], ["vile", "scum", "rotten"]
    docs, labels = [], []
    for i in range(n):
        w = random.choices(words, k=random.randint(5, 80))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(random.randrange(len(w)), random.choice(nasty))
        docs.append((seed * 10_000 + i, " ".join(w)))
        labels.append((seed * 10_000 + i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, _ = prose(spark, 1500, 1)
    model = toxicity.train(docs, labels)
    assert 0 < len(model.at) < 2000  # L1 leaves few of a million buckets
    fresh, _, truth = prose(spark, 400, 2)
    right = [r.is_toxic == bool(truth[r.doc_id]) for r in toxicity.score(fresh, model).collect()]
    assert sum(right) / len(right) > 0.97


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.1") + "/documents.parquet")
    labels = spark.read.parquet(SMALL.replace("0.001", "0.1") + "/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert sum(r.is_toxic == bool(r.toxic) for r in got) / len(got) > 0.95
    assert sum(r.is_toxic and not r.toxic for r in got) / len(got) < 0.01


def test_training_equals_plain_ftrl(spark):
    """The update rule written out, one coordinate after the other, over words, word pairs and skip-grams."""
    docs, labels, truth = prose(spark, 120, 5)
    bits, alpha, beta, l1, l2 = 20, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    order = [r._id for r in docs.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}

    def buckets(words):
        """Numbers of the distinct features; a text of two words far enough apart tells a skip-gram's."""
        out = {1 << bits}
        for gap in (0, 1, 2, 3):
            for i in range(len(words) - gap):
                few = [words[i]] if gap == 0 else [words[i], *["\x01"] * (gap - 1), words[i + gap]]
                row, at = toxicity.features(_text.tokens(*_text.buffers(pa.array([" ".join(few)]))), bits)
                out.add(int(at[0] if gap == 0 else at[-1]))
        return out

    seen = {i: buckets(text[i].split()) for i in order}
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(toxicity.EPOCHS):
        for i in order:
            w = {k: weight(k) for k in seen[i]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - truth[i]
            for k in seen[i]:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = {k: weight(k) for k in z if weight(k)}
    model = toxicity.train(docs, labels)
    got = dict(zip(model.at.tolist(), model.weight.tolist()))
    assert got.keys() == want.keys() and len(want) > 3
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for r in toxicity.score(docs, model).collect():
        assert abs(r.toxic_score - 1 / (1 + math.exp(-sum(want.get(k, 0.0) for k in seen[r.doc_id])))) < 1e-9


def test_training_is_bounded_and_repeatable(spark):
    docs, labels, _ = prose(spark, 300, 3)
    a, b = (toxicity.train(docs, labels.repartition(n), max_train=100) for n in (1, 3))
    assert a.at.tolist() == b.at.tolist() and a.weight.tolist() == b.weight.tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels, _ = prose(spark, 400, 4)
    model = toxicity.train(docs.union(docs).union(spark.createDataFrame([(40_001, None)], docs.schema)), labels.union(spark.createDataFrame([(None, 1), (40_002, None), (40_003, 1)], labels.schema)))
    got = toxicity.score(odd_docs, model)
    assert got.columns == ["doc_id", "toxic_score", "is_toxic"] and got.count() == odd_docs.count()
    assert all(r.toxic_score == 0 and not r.is_toxic for r in got.where("doc_id in (1, 2, 3)").collect())
    assert toxicity.score(no_docs, model).collect() == []
    empty = toxicity.train(docs, labels.where("toxic = 0"))
    assert len(empty.at) == 0 and all(r.toxic_score == 0 for r in toxicity.score(docs, empty).collect())
    assert len(toxicity.train(no_docs, labels.where("false")).at) == 0
