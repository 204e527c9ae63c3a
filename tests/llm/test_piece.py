from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import piece
from tracemill.llm.queries import MODEL

sentencepiece = pytest.importorskip("sentencepiece")
model = piece.PieceModel.load(MODEL)
encoder, decoder = piece.coders(model)
theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(texts):
    off, ids = encoder.column(pa.array(texts, pa.string()))
    got = [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))]
    assert got == [theirs.encode(t or "") for t in texts]
    assert decoder.column(off, ids).to_pylist() == [theirs.decode(g) for g in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_as_in_the_library(texts):
    check(texts)


def test_pieces_and_hard_texts_as_in_the_library():
    random.seed(1)
    pieces = [p.replace("▁", " ") for p in model.rank]
    check(["".join(random.choices(pieces, k=25)) for _ in range(800)])
    check([None, "", " ", "   a", "a\n\n b", "▁x▁", "=" * 999, "ab" * 5000, "漢字" * 2000, "\x00", "<s> </s> <unk> <0x41>", "👍🏽 ﬁ ☃"])


def test_odd_rows(odd_docs, no_docs):
    got = piece.encode(odd_docs, model, decoded_col="decoded")
    assert set(got.columns) == (set(odd_docs.columns) - {"text"}) | {"n_ids", "decoded"}
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in got.collect():
        assert r.ids == theirs.encode(texts[r.doc_id] or "") and r.n_ids == len(r.ids) and r.decoded == (texts[r.doc_id] or "")
    assert got.count() == odd_docs.count()
    assert piece.encode(no_docs, model).collect() == []


def test_decode(spark):
    df = spark.createDataFrame([(1, [22557, 28725, 2]), (2, []), (3, None), (4, [0xE2 + 3, 0])], "i int, ids array<int>")
    got = {r.i: r.text for r in piece.decode(df, model).collect()}
    assert got == {1: theirs.decode([22557, 28725, 2]), 2: "", 3: None, 4: theirs.decode([0xE2 + 3, 0])}
    assert piece.decode(df.where("false"), model).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=9), max_size=8))
def test_any_ids_as_in_the_library(ids):
    """Control pieces, bytes that aren't UTF-8 and the unknown piece among them."""
    ids += [[1, *theirs.encode("hello there")], [1, 2, 28705, 28705, 300]]
    cut = [0]
    for x in ids:
        cut.append(cut[-1] + len(x))
    got = decoder.column(np.array(cut), np.array([i for x in ids for i in x], np.int64))
    assert got.to_pylist() == [theirs.decode(x) for x in ids]


def test_pairs_are_those_of_the_merges():
    """The test of two pieces against encoding both together, whatever was asked before."""
    random.seed(3)
    a, b = random.choices(model.reachable, k=4000), random.choices(model.reachable, k=4000)
    want = [model.merge(model.pieces[x] + model.pieces[y]) == [model.pieces[x], model.pieces[y]] for x, y in zip(a, b)]
    for _ in range(2):
        assert encoder.pairs.ok(np.array(a), np.array(b)).tolist() == want
    assert not all(want)


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m"
    path.write_bytes(b"\n\x05\n\x01a\x18\x01")
    with pytest.raises(ValueError, match="only BPE"):
        piece.PieceModel.load(str(path))
