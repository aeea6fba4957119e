"""The n-gram join against brute force: boilerplate, frequent signatures, large groups, edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_chosenpath import ROWS, brute, corpus, edited, same

from tilewright.llm import quality, setjoin
from tilewright.llm.frames import doc_key, opened
from tilewright.llm.queries import QUERIES


def joined(docs, words, numer):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.ngram_components(docs, words, numer).collect()]


def wanted(rows, words, numer):
    return [r[:3] for r in brute(rows, words, numer)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("words,numer", [(4, 85), (5, 80), (1, 60)])
def test_against_brute_force(spark, words, numer):
    draw = np.random.default_rng(5)
    boiler = " ".join(f"licence{k}" for k in range(60))
    rows = corpus(draw, 30) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(draw, 30, boiler))]
    same(joined(frame(spark, rows), words, numer), wanted(rows, words, numer))


@pytest.mark.parametrize("frequent", [10, 1 << 40])
def test_large_groups(spark, monkeypatch, frequent):
    """Tight and loose groups of near copies above the bounds of a node, with frequent signatures dealt out or not."""
    for name, value in (("SMALL", 8), ("CHUNK", 16), ("PIECE", 8), ("FREQUENT", frequent)):
        monkeypatch.setattr(setjoin, name, value)
    draw = np.random.default_rng(9)
    rows = corpus(draw, 10)
    for share in (0.002, 0.02, 0.05):
        base = [f"g{share}x{k}" for k in range(90)]
        rows += [(len(rows) + i, " ".join(edited(draw, base, share))) for i in range(50)]
    same(joined(frame(spark, rows), 4, 85), wanted(rows, 4, 85))


def test_boilerplate_is_compared_little(spark):
    """Texts that share much but are not similar make few clusters: the full sets compared grow with the links."""
    draw = np.random.default_rng(2)
    shared = [f"s{k}" for k in range(120)]
    rows = [(i, " ".join(shared + [f"o{k}" for k in draw.integers(0, 10**6, 120)])) for i in range(200)]
    sets = [np.sort(draw.choice(10**9, 400, False).astype(np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([sets[0][:200], s[:200]])) for s in sets]
    near = setjoin.may_link([setjoin.parities(s) for s in sets], np.array([len(s) for s in sets]), 85)
    assert (near == np.eye(len(sets), dtype=bool)).all()
    same(joined(frame(spark, rows), 4, 85), wanted(rows, 4, 85))


def test_parities_rule_out_no_link():
    draw = np.random.default_rng(1)
    for size in (1, 2, 7, 60, 64, 65, 130, 1000):
        base = draw.choice(10**12, 2 * size, False).astype(np.uint64)
        for numer in (50, 80, 85, 100):
            sets = [np.sort(base[a:a + size + b]) for a in range(0, max(1, size // 3)) for b in range(0, max(1, size // 4), max(1, size // 20))][:40]
            near = setjoin.may_link([setjoin.parities(s) for s in sets], np.array([len(s) for s in sets]), numer)
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    assert near[i, j] or 100 * both < numer * (len(x) + len(y) - both)


def test_edges(spark):
    docs = (frame(spark, ROWS).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("bits", F.lit(0))
            .withColumn("component", F.lit(2)).withColumn("n_shingles", F.lit(None).cast("string")))
    same(joined(docs, 5, 80), wanted(ROWS, 5, 80))
    assert setjoin.ngram_components(docs.where("false")).count() == 0


def test_words_that_share_a_sum_are_not_linked(spark):
    """The Thue-Morse word and its complement."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (9, "one two"), (9, "three four"), (10, "three four")]
    same(joined(frame(spark, rows), 4, 85), wanted(rows, 4, 85))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_join"](spark, sf).collect()]
    same(found, wanted(rows, 4, 85))


def test_texts_travel_packed(spark):
    docs = frame(spark, [(i, f"word{i} " * 5000) for i in range(3)] + [(7, None)])
    classes = spark.createDataFrame([(i, 10 + i, b"k") for i in (0, 2, 7)], "doc_id long, id long, key binary")
    found = setjoin.set_texts(docs, classes).collect()
    assert {r.id for r in found} == {10, 12, 17}
    assert all(r.text is None or len(r.text) < 1000 for r in found)
    batch = pa.RecordBatch.from_pydict({"id": [r.id for r in found], "text": pa.array([r.text for r in found], pa.binary())})
    pieces = list(opened(batch, 20_000))
    texts = {i: t for p in pieces for i, t in zip(p.column("id").to_pylist(), p.column("text").to_pylist(), strict=True)}
    assert texts == {10: b"word0 " * 5000, 12: b"word2 " * 5000, 17: None}
    assert len(pieces) > 1


def test_texts_without_cluster_stay(spark, monkeypatch):
    """All wanted texts pass the filter, and nearly all others are left out, for any ids and filters that are too small."""
    ids = [*range(-3000, 3000, 3), 2**63 - 1, -2**63, 0, None]
    texts = spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string")
    asked = [(1, -3000), (1, 3), (2, 3), (2, 2**63 - 1), (3, -2**63), (3, 0), (4, 5), (4, None)]
    members = spark.createDataFrame(asked, "cluster long, id long")
    want = {i for _, i in asked if i in ids and i is not None}
    left = [r.id for r in setjoin.wanted(texts, members).collect()]
    assert want <= set(left) and len(left) < 20
    assert setjoin.wanted(texts, members.where("false")).count() == 0
    for bits in (1, 8, 1000):
        monkeypatch.setattr(setjoin, "FILTER_BITS", bits)
        assert want <= {r.id for r in setjoin.wanted(texts, members).collect()}


def test_training_rows_are_narrow_and_exact(spark):
    """Counts above a byte's range and empty texts give the weights of the plain formula."""
    texts = [("a b " * 400, 1), ("", 0), ("c d e", 0), ("a c " * 70, 1), (None, 0)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64(doc_key())).collect()]
    model = quality.Leader(10)
    for _ in range(2):
        for i in order:
            data = np.frombuffer((texts[i][0] or "").encode(), np.uint8)
            at, _ = quality.features(data, np.array([0, len(data)]), 10)
            own, count = np.unique(at, return_counts=True)
            model.step(np.append(own, 1 << 10), np.append(count / np.sqrt(max(1, len(at))), 1.0), float(texts[i][1]))
    assert np.array_equal(quality.train(docs, 10, 2), model.weights())
