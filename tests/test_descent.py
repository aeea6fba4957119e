"""Lines and areas cut zoom by zoom against whole geometries clipped in every tile."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tilewright.operators import descent
from tilewright.operators.cover import cover
from tilewright.operators.geometry import geometry_code, shape_commands
from tilewright.sources.layers import as_layer, with_parts

PARTS = "id int, parts array<array<array<struct<x:double,y:double>>>>"


def layer(spark, rows, kind):
    return as_layer(with_parts(spark.createDataFrame(rows, PARTS), "parts", kind), "shapes")


def star(rng, x, y, size, n=14):
    """A concave ring."""
    ring = [(x + (size if i % 2 else size * rng.uniform(0.2, 0.6)) * math.cos(2 * math.pi * i / n),
             y + (size if i % 2 else size * rng.uniform(0.2, 0.6)) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*ring, ring[0]]


def walk(rng, x, y, step, n):
    path = [(x, y)]
    for _ in range(n):
        x, y = max(-180.0, min(180.0, x + rng.uniform(-step, step))), max(-84.0, min(84.0, y + rng.uniform(-step, step)))
        path.append((x, y))
    return path


def areas(rng):
    rows = []
    for i in range(30):
        parts = []
        for _ in range(rng.randint(1, 3)):
            x, y, size = rng.uniform(-150, 150), rng.uniform(-60, 60), rng.choice([0.5, 4.0, 20.0])
            rings = [star(rng, x, y, size)]
            if rng.random() < 0.5:
                rings.append(star(rng, x, y, size * 0.15, 6)[::-1])
            parts.append(rings)
        rows.append((i, parts))
    world = [(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0), (-180.0, -90.0)]
    return [*rows, (30, [[world]]), (31, [[[(0.0, 0.0), (45.0, 0.0), (45.0, 40.0), (0.0, 0.0)]]]), (32, []), (33, None)]


def lines(rng):
    rows = [(i, [[walk(rng, rng.uniform(-170, 170), rng.uniform(-70, 70), rng.choice([0.3, 3.0, 40.0]), rng.randint(1, 60))]
                 for _ in range(rng.randint(1, 3))]) for i in range(40)]
    return [*rows, (40, [[[(-180.0, -84.0), (180.0, 84.0)]]]), (41, [[[(10.0, 10.0), (10.0, 10.0)]]]), (42, [[[(0.0, -80.0), (0.0, 80.0)]]])]


CASES = [("MULTIPOLYGON", areas), ("MULTILINESTRING", lines), ("MULTIPOINT", lines)]


def direct(made, zooms, extent, buffer):
    g = made.geometry()
    z, x, y = (F.col(c) for c in "zxy")
    cmds = shape_commands(F.col(g.name)["parts"], g.srid, geometry_code(g.kind), z, x, y, extent, buffer)
    return cover(made.frame, g, zooms, extent).select("id", "z", "x", "y", cmds.alias("cmds")).filter("cmds is not null")


@pytest.mark.parametrize("kind,shapes", CASES)
@pytest.mark.parametrize("wide", [False, True])
def test_pieces_draw_what_whole_geometries_draw(spark, monkeypatch, kind, shapes, wide):
    if wide:
        monkeypatch.setattr(descent, "WIDE_COVER", 20)
        monkeypatch.setattr(descent, "SPLIT_ZOOM", 2)
    monkeypatch.setattr(descent, "CHUNK_PIECES", 50)
    made = layer(spark, shapes(random.Random(3)), kind)
    zooms = [0, 2, 3, 5, 6]
    got = descent.tile_shapes(made.frame, made.geometry(), zooms, 512, 8, ["id"], wide)
    want = direct(made, zooms, 512, 8)
    found, wanted = ({(r.id, r.z, r.x, r.y): tuple(r.cmds) for r in frame.collect()} for frame in (got, want))
    assert len(wanted) > 500 and found == wanted and got.count() == len(wanted)


def test_many_vertices_deep_down(spark):
    """A path of 200,000 vertices to zoom 12, where clipping it whole in each of its tiles would take billions of steps."""
    rng = random.Random(5)
    made = layer(spark, [(1, [[walk(rng, 0.0, 0.0, 0.02, 200_000)]])], "LINESTRING")
    start = time.time()
    rows = descent.tile_shapes(made.frame, made.geometry(), [12], 4096, 64, ["id"]).agg(
        F.count("*").alias("n"), F.sum(F.size("cmds")).alias("words")).first()
    assert rows.n > 1000 and rows.words > 400_000 and time.time() - start < 60


def test_slanting_line_walks_the_grid(spark):
    made = layer(spark, [(1, [[[(-179.0, -80.0), (179.0, 80.0)]]])], "LINESTRING")
    n = descent.tile_shapes(made.frame, made.geometry(), [10], 4096, 64, ["id"]).count()
    assert 1000 < n < 5000  # its box covers more than 700,000 tiles
