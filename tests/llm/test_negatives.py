"""Hard negatives against brute force, their bounds and their order."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import negatives as neg
from tilewright.llm.hilbert import hilbert_places


def brute(rows, is_anchor, low=80, high=100, top=5, scale=256):
    """Every row against every row, in exact integers."""
    usable = [(i, tuple(min(max(math.floor(scale * float(np.float32(x))), -2**63), 2**63 - 1) for x in v), label) for i, v, label in rows
              if i is not None and v is not None and label is not None
              and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    out = []
    for a, av, al in usable:
        if not is_anchor(a):
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(av, v, strict=True)), -2**63), 2**63 - 1), i, label)
                        for i, v, label in usable if i != a and len(v) == len(av))
        for ps, p, _ in [s for s in scored if s[2] == al][:top]:
            window = [(n, -s) for s, n, label in scored if label != al and low * -ps <= 100 * -s <= high * -ps][:top]
            out += [(a, p, k + 1, n, -ps, s) for k, (n, s) in enumerate(window)]
    return sorted(out)


def frame(spark, rows):
    return (spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dim", F.lit("clash"))
            .withColumn("block", F.lit(1)).withColumn("score", F.lit(None).cast("string")))


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in neg.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, **options).collect())


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        places = [bytes(p) for p in hilbert_places(cells, bits)]
        assert len(set(places)) == len(cells)
        walk = cells[np.array(sorted(range(len(cells)), key=places.__getitem__))]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    draw = np.random.default_rng(2)
    matrix, anchors = draw.integers(-300, 300, (40, 6)), draw.integers(-300, 300, (9, 6))
    least, most = neg.bounds(anchors, matrix.min(0)[None], matrix.max(0)[None])
    scores = neg.scores_of(anchors, matrix)
    assert (scores >= least).all() and (scores <= most).all()


def test_scores_stay_exact():
    a, b = np.array([[2**40, 1], [2**62, 2**62]]), np.array([[2**21, 3], [2**62, 2**62]])
    assert neg.scores_of(a[:1], b[:1]).tolist() == [[2**61 + 3]]
    assert neg.scores_of(a, b)[1, 1] == 2**63 - 1


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neg, "BLOCK", 16)
    monkeypatch.setattr(neg, "GROUP", 4)
    monkeypatch.setattr(neg, "PAGE", 3)
    draw = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v], int(draw.integers(0, 3))) for i, v in enumerate(np.abs(draw.normal(size=(180, 4))).round(1))]
    rows += [(180, [-1.0, 0.0, 0.0, 0.0], 0), (181, [-0.5, 0.0, 0.0, 0.0], 0)]  # negative scores have no window
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf"), 0.0, 0.0, 0.0], 2),
             (204, [1.0] * 4, None), (None, [1.0] * 4, 1), (205, [1.0], 1), (210, [1.0], 1), (211, [0.9], 2), (220, [], 0), (221, [], 0),
             (222, [], 1), (230, [3e38, 1.0], 1), (231, [3e38, 0.0], 1), (232, [2.9e38, 1.0], 2)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_repeats_and_empty(spark):
    rows = [(i, [1.0, 2.0], i % 2) for i in range(30)] + [(3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []
    assert neg.hard_negatives(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("spread,share", [(0.02, 0.25)])
def test_clusters_spare_most_blocks(spark, monkeypatch, spread, share):
    """Of clustered vectors an anchor reads few blocks, and the result stays whole."""
    monkeypatch.setattr(neg, "BLOCK", 32)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(8, 8))
    rows = []
    for i in range(1600):
        v = centres[i % 8] + spread * draw.normal(size=8)
        rows.append((i, [float(x) for x in v], int(draw.integers(0, 4))))
    tables = []
    real = neg.chosen_blocks

    def seen(groups, pages, choose):
        tables.append((choose.__name__, real(groups, pages, choose)))
        return tables[-1][1]

    monkeypatch.setattr(neg, "chosen_blocks", seen)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    for name, table in tables:
        read = table.agg(F.sum(F.octet_length("ids") / 8)).first()[0]
        assert read <= share * 160 * 50, name
