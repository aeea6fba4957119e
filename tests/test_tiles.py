from __future__ import annotations

import contextlib
import gc
import hashlib
import io
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from plain_reader import read_feature, read_layers, read_paths, read_value
from pyspark.sql import functions as F

from tilewright.functions import tilemath as tm
from tilewright.model import LayerError, TileOptions, check_srid
from tilewright.operators import inspect, mvt
from tilewright.operators.geometry import LINE, POINT, POLYGON, batch_commands
from tilewright.operators.mvt import tile_address
from tilewright.operators.publish import tile_etags
from tilewright.operators.cover import cover, requested
from tilewright.plans import tiles as plans
from tilewright.sources.layers import as_layer, with_boxes, with_parts, with_points, with_segments


def read_tiles(rows) -> dict:
    """Features of every tile, by plain sequential decoding of the joined parts."""
    bodies: dict = {}
    for r in sorted(rows, key=lambda r: (r.layer, r.z, r.x, r.y, r.part)):
        bodies.setdefault((r.z, r.x, r.y), []).append(bytes(r.tile))
    out = {}
    for key, parts in bodies.items():
        (one,) = read_layers(b"".join(parts))
        found = []
        for message in one["features"]:
            f = read_feature(message)
            pairs = zip(f["tags"][0::2], f["tags"][1::2])
            props = tuple((one["keys"][k], read_value(one["values"][v])) for k, v in pairs)
            found.append((props, f["type"], read_paths(f["geometry"])))
        out[key] = (one["name"], one["version"], one["extent"], sorted(found, key=repr))
    return out


def points(spark, rows, schema="id bigint, name string, lon double, lat double"):
    return as_layer(with_points(spark.createDataFrame(rows, schema), "lon", "lat"), "pts", drop=("lon", "lat"))


def test_lookup_of_a_known_point(spark):
    t = spark.range(1).select(tm.point_tile(F.lit(-6.2088), F.lit(106.8456), F.lit(10)).alias("t")).first().t
    assert (t.z, t.x, t.y) == (10, 815, 529)


def test_tile_numbers_run_back(spark):
    rng = random.Random(1)
    rows = [(z, rng.randrange(2**z), rng.randrange(2**z)) for z in range(31) for _ in range(5)]
    rows += [(30, 2**30 - 1, 2**30 - 1), (0, 0, 0)]
    frame = spark.createDataFrame(rows, "z int, x int, y int")
    got = frame.select(tm.tile_number(F.col("z"), F.col("x"), F.col("y")).alias("n")).collect()
    z, x, y = tile_address(np.array([r.n for r in got]))
    assert list(zip(z.tolist(), x.tolist(), y.tolist())) == rows


def test_edges_belong_to_both_sides(spark):
    made = points(spark, [(1, "a", 0.0, 10.0), (2, "b", 180.0, 10.0), (3, "c", -180.0, -10.0)])
    rows = cover(made.frame, made.geometry(), [2]).select("id", "x").collect()
    assert sorted((r.id, r.x) for r in rows) == [(1, 1), (1, 2), (2, 3), (3, 0)]


def test_memberships_are_points_plus_edge_copies(spark):
    rows = [(i, "p", -180 + i * 0.37, -80 + i * 0.16) for i in range(900)]
    made = points(spark, rows)
    g = made.geometry()
    n = cover(made.frame, g, [5]).count()
    on_edge = 0
    for side in ("u0", "v0"):
        c = F.col(g.box(side))
        on_edge += made.frame.filter((c * 32 % 1 == 0) & c.between(0.01, 0.99)).count()
    assert n == len(rows) + on_edge and on_edge > 0


@pytest.mark.parametrize("part_bytes", [1, 300, 5000, 4 << 20])
def test_parts_hold_the_same_tile(spark, monkeypatch, part_bytes):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None]), rng.uniform(-179, 179), rng.uniform(-80, 80)) for i in range(300)]
    rows += [(7, "copy", 12.5, 41.5)] * 200  # a group of copies
    made = points(spark, rows)
    one_block = read_tiles(plans.tile_pyramid(made, 0, 2).collect())
    monkeypatch.setattr(plans, "BLOCK_BYTES", 300)
    whole = plans.tile_pyramid(made, 0, 2, TileOptions(part_bytes=1 << 30))
    split = plans.tile_pyramid(made, 0, 2, TileOptions(part_bytes=part_bytes))
    parts = split.collect()
    assert read_tiles(parts) == one_block
    assert joined_bytes(parts) == joined_bytes(whole.collect())
    assert {tuple(r) for r in tile_etags(split).collect()} == {tuple(r) for r in tile_etags(whole).collect()}
    assert sum(r.n_features for r in parts) == sum(len(t[3]) for t in one_block.values())
    if part_bytes < 300:
        # copies spread too: no part holds more than a few of them
        assert max(r.n_features for r in parts) < 60
    for key, rows_ in _by_tile(parts).items():
        assert sorted(r.part for r in rows_) == list(range(rows_[0].n_parts)), key


def joined_bytes(rows):
    return {k: b"".join(bytes(r.tile) for r in sorted(v, key=lambda r: r.part)) for k, v in _by_tile(rows).items()}


def test_etag_is_that_of_all_bytes(spark):
    rows = [("a", 1, 0, 0, part, 3, bytes([part]) * (100 + part)) for part in (2, 0, 1)] + [("a", 0, 0, 0, 0, 1, b"x"), ("b", 0, 0, 0, 0, 1, b"")]
    frame = spark.createDataFrame(rows, "layer string, z int, x int, y int, part int, n_parts int, tile binary").repartition(3)
    got = {(r.layer, r.z): (r.bytes, r.etag) for r in tile_etags(frame).collect()}
    whole = b"".join(bytes([part]) * (100 + part) for part in range(3))
    assert got[("a", 1)] == (303, f'W/"303-{hashlib.md5(whole).hexdigest()[:16]}"')
    assert got[("a", 0)][0] == 1 and got[("b", 0)] == (0, 'W/"0-empty"')


def _by_tile(rows):
    out: dict = {}
    for r in rows:
        out.setdefault((r.z, r.x, r.y), []).append(r)
    return out


def test_tiles_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 50, rng.choice("abc"), rng.uniform(-179, 179), rng.uniform(-80, 80)) for i in range(400)]
    for block_bytes in (500, 4 << 20):
        monkeypatch.setattr(plans, "BLOCK_BYTES", block_bytes)
        etags = []
        for seed in (1, 2):
            random.Random(seed).shuffle(rows)
            made = points(spark, rows)
            made = made.with_frame(made.frame.repartition(seed * 3))
            tiles = plans.tile_pyramid(made, 0, 3, TileOptions(part_bytes=block_bytes))
            etags.append({(r.z, r.x, r.y): r.etag for r in tile_etags(tiles).collect()})
        assert etags[0] == etags[1] and len(etags[0]) > 20


def test_attribute_types(spark):
    schema = ("i int, big bigint, neg bigint, f float, d double, b boolean, s string, day date, dec decimal(10,2), "
              "list array<int>, raw binary, nothing string, lon double, lat double")
    import datetime as dt
    from decimal import Decimal
    frame = spark.createDataFrame([(5, 2**40, -3, 1.5, 2.25, True, "ü", dt.date(2020, 2, 3), Decimal("1.50"), [1, 2],
                                    bytearray(b"\x01\xff"), None, 10.0, 10.0)], schema)
    made = as_layer(with_points(frame, "lon", "lat"), "kinds", drop=("lon", "lat"))
    (tile,) = read_tiles(plans.tile_pyramid(made, 0, 0).collect()).values()
    assert dict(tile[3][0][0]) == {"i": 5, "big": 2**40, "neg": -3, "f": 1.5, "d": 2.25, "b": True, "s": "ü",
                                   "day": "2020-02-03", "dec": "1.50", "list": "[1,2]", "raw": "\\x01ff"}
    assert tile[:3] == ("kinds", 2, 4096)


def test_batch_decoder_agrees_with_plain_reader(spark, monkeypatch):
    monkeypatch.setattr(plans, "BLOCK_BYTES", 200)
    rng = random.Random(4)
    ring = [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0), (0.0, 0.0)]
    hole = [(10.0, 10.0), (10.0, 20.0), (20.0, 20.0), (20.0, 10.0), (10.0, 10.0)]
    other = [(-60.0, -20.0), (-50.0, -20.0), (-55.0, -10.0), (-60.0, -20.0)]
    rows = [(i, rng.random() - 0.5, [[ring, hole], [other]]) for i in range(5)]
    frame = spark.createDataFrame(rows, "id int, v double, parts array<array<array<struct<x:double,y:double>>>>")
    made = as_layer(with_parts(frame, "parts", "MULTIPOLYGON"), "multi")
    for part_bytes in (200, 4 << 20):
        tiles = plans.tile_pyramid(made, 0, 3, TileOptions(part_bytes=part_bytes))
        plain = read_tiles(tiles.collect())
        decoded: dict = {}
        for r in inspect.decode_features(tiles).collect():
            props = tuple(sorted(r.properties.items()))
            decoded.setdefault((r.z, r.x, r.y), []).append((props, r.type, [[(p.x, p.y) for p in path] for path in r.paths]))
        assert {k: sorted(v, key=repr) for k, v in decoded.items()} == {
            k: sorted(((tuple(sorted((a, str(b)) for a, b in f[0])), f[1], f[2]) for f in t[3]), key=repr)
            for k, t in plain.items()}
        samples = inspect.tile_samples(tiles, 3).collect()
        assert max(r.sample for r in samples) == 3


def commands(parts, code, margin=64, z=0, x=0, y=0, srid=3857):
    nested = pa.array([parts], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))
    one = np.array([0])
    words = batch_commands(nested, srid, code, one + z, one + x, one + y, 4096, margin)[0].as_py()
    return None if words is None else read_paths(np.array(words, np.int64))


def at(px, py):
    """Source coordinates of a position on the grid of tile 0/0/0."""
    w = tm.WORLD
    return {"x": (px / 4096 - 0.5) * 2 * w, "y": (0.5 - py / 4096) * 2 * w}


def test_line_that_leaves_and_returns_becomes_two_paths():
    line = [[[at(100, 100), at(100, -500), at(300, -500), at(300, 100)]]]
    assert commands(line, LINE) == [[(100, 100), (100, -64)], [(300, -64), (300, 100)]]
    assert commands(line, LINE, None) == [[(100, 100), (100, -500), (300, -500), (300, 100)]]


def test_line_outside_is_dropped():
    assert commands([[[at(-500, -500), at(-300, -90)]]], LINE) is None
    assert commands([[[at(10, 10), at(10.2, 10.1)]]], LINE) is None  # one grid cell


def test_polygon_is_cut_and_wound():
    ring = [at(-1000, 10), at(500, 10), at(500, 500), at(-1000, 500), at(-1000, 10)]
    hole = [at(100, 100), at(200, 100), at(200, 200), at(100, 200), at(100, 100)]
    paths = commands([[ring, hole]], POLYGON)
    assert len(paths) == 2 and min(x for x, _ in paths[0]) == -64 and max(x for x, _ in paths[0]) == 500
    areas = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:])) for p in paths]
    assert areas[0] > 0 > areas[1]
    assert all(p[0] == p[-1] for p in paths)


def test_hole_goes_with_its_outer_ring():
    ring = [at(-500, -500), at(-400, -500), at(-400, -400), at(-500, -500)]
    hole = [at(100, 100), at(200, 100), at(200, 200), at(100, 100)]
    assert commands([[ring, hole]], POLYGON) is None


def test_multipoint_keeps_points_inside():
    assert commands([[[at(1, 2)]], [[at(-500, 2)]], [[at(7, 9)]]], POINT) == [[(1, 2)], [(7, 9)]]


def test_clipped_vertices_stay_in_the_box():
    rng = random.Random(5)
    for _ in range(200):
        line = [[[at(rng.uniform(-6000, 9000), rng.uniform(-6000, 9000)) for _ in range(6)]]]
        for path in commands(line, LINE) or []:
            assert all(-64 <= c <= 4160 for p in path for c in p) and len(path) >= 2


def test_wide_cover_equals_plain_cover(spark):
    frame = spark.createDataFrame([(1, -170.0, -70.0, 170.0, 70.0), (2, 1.0, 1.0, 2.0, 2.0)],
                                  "id int, w double, s double, e double, n double")
    made = as_layer(with_boxes(frame, "w", "s", "e", "n"), "wide", drop=("w", "s", "e", "n"))
    g = made.geometry()
    plain = cover(made.frame, g, [0, 7]).groupBy("id", "z", "x", "y").count()
    spread = cover(made.frame, g, [0, 7], wide=True).groupBy("id", "z", "x", "y").count()
    assert plain.count() > 8000
    assert plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()


def test_requested_tiles_include_empty_ones(spark):
    made = points(spark, [(1, "a", 10.0, 10.0)])
    asked = spark.createDataFrame([(0, 0, 0), (2, 0, 0), (31, 0, 0), (1, 5, 0), (0, 0, 0)], "z int, x int, y int")
    rows = {(r.z, r.x, r.y): bytes(r.tile) for r in plans.tiles_for(made, asked).collect()}
    assert set(rows) == {(0, 0, 0), (2, 0, 0)} and rows[(2, 0, 0)] == b"" and rows[(0, 0, 0)]
    status = {(r.z, r.x, r.y): (r.status, r.total_features) for r in
              inspect.inspect_tiles(plans.tiles_for(made, asked)).collect()}
    assert status == {(0, 0, 0): ("OK", 1), (2, 0, 0): ("EMPTY_TILE", 0)}


def test_one_deep_tile_below_a_huge_area(spark):
    """A feature brings a few cells for each requested zoom, not the tiles it covers."""
    frame = spark.createDataFrame([(1, -179.0, -80.0, 179.0, 80.0), (2, 10.0, 10.0, 10.0001, 10.0001), (3, 10.0, 10.0, 10.0, 10.0001)],
                                  "id int, w double, s double, e double, n double")
    made = as_layer(with_boxes(frame, "w", "s", "e", "n"), "wide", drop=("w", "s", "e", "n"))
    x, y = int((10.00005 + 180) / 360 * 2**22), 1978000
    t = spark.range(1).select(tm.point_tile(F.lit(10.00005), F.lit(10.00005), F.lit(22)).alias("t")).first().t
    asked = spark.createDataFrame([(22, t.x, t.y), (22, x, y), (30, 5, 2**29), (0, 0, 0)], "z int, x int, y int")
    cells = requested(made.frame, made.geometry(), asked, [0, 22, 30], every=True)
    assert {(r.id, r.z, r.x, r.y) for r in cells.collect()} >= {(1, 22, t.x, t.y), (2, 22, t.x, t.y), (3, 0, 0, 0), (1, 0, 0, 0)}
    rows = {(r.z, r.x, r.y): r.n_features for r in plans.tiles_for(made, asked).collect()}
    assert rows == {(22, t.x, t.y): 2, (22, x, y): 1, (30, 5, 2**29): 0, (0, 0, 0): 1}
    far = {(r.z, r.x, r.y): (r.in_box, r.verdict) for r in plans.diagnose_tiles(made, asked).collect()}
    assert far[30, 5, 2**29] == (0, "no features here") and far[0, 0, 0] == (3, "ok")


def test_requested_equals_cover(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        w, s, size = rng.uniform(-180, 170), rng.uniform(-80, 70), rng.choice([0.0, 0.1, 1.40625, 11.25, 90.0])
        rows.append((i, w, s, min(w + size, 180.0), min(s + size * rng.random(), 85.0)))
    rows += [(300, 0.0, 0.0, 45.0, 10.0), (301, -45.0, -10.0, 0.0, 0.0)]  # on tile edges
    made = as_layer(with_boxes(spark.createDataFrame(rows, "id int, w double, s double, e double, n double"), "w", "s", "e", "n"), "some")
    asked = spark.createDataFrame([(z, x, y) for z in (1, 3, 6) for x in range(2**z) for y in range(0, 2**z, 3)], "z int, x int, y int")
    g = made.geometry()
    want = cover(made.frame, g, [1, 3, 6]).join(asked, ["z", "x", "y"], "left_semi").select("id", "z", "x", "y")
    got = requested(made.frame, g, asked, [1, 3, 6]).select("id", "z", "x", "y")
    assert want.count() > 3000 and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_poles_are_finite(spark):
    lat = spark.createDataFrame([(v,) for v in (-90.0, -89.9, 0.0, 89.9, 90.0, None)], "lat double")
    v = [r.v for r in lat.select(tm.unit_y(F.col("lat")).alias("v")).collect()]
    assert v[0] > v[1] > 1 > v[2] == 0.5 > 0 > v[3] > v[4] and abs(v[0] + v[4] - 1) < 1e-12 and v[5] is None
    whole = [[[{"x": -180.0, "y": -90.0}, {"x": 180.0, "y": -90.0}, {"x": 180.0, "y": 90.0}, {"x": -180.0, "y": 90.0}]]]
    assert sorted(commands(whole, POLYGON, srid=4326)[0][:-1]) == [(0, -64), (0, 4160), (4096, -64), (4096, 4160)]


def test_merge_of_large_layers_keeps_every_byte(spark, monkeypatch):
    rows = [(i, "n", i * 0.5 - 40, i * 0.2 - 20) for i in range(120)]
    frame = spark.createDataFrame(rows, "id bigint, name string, lon double, lat double")
    frame = frame.selectExpr("*", "lon - 1 as w", "lat - 1 as s", "lon + 1 as e", "lat + 1 as n")
    shaped = with_boxes(with_points(frame, "lon", "lat"), "w", "s", "e", "n", "area")
    made = as_layer(shaped, "two", drop=("lon", "lat", "w", "s", "e", "n"))
    whole = {(r.z, r.x, r.y): bytes(r.tile) for r in plans.multilayer_pyramid(made, 0, 1).collect()}
    b = {tuple(r) for r in inspect.inspect_layers(plans.multilayer_pyramid(made, 0, 1)).collect()}
    monkeypatch.setattr(plans, "BLOCK_BYTES", 2000)
    small = plans.multilayer_pyramid(made, 0, 1, TileOptions(part_bytes=2000))
    assert {r.n_parts for r in small.collect()} != {1}
    a = {tuple(r) for r in inspect.inspect_layers(small).collect()}
    assert a == b and len(whole) == len({r[:3] for r in a})


def test_options_are_checked(spark):
    for bad in ({"extent": 0}, {"buffer": -1}, {"extent": 1.5}, {"extent": True}):
        with pytest.raises(LayerError):
            TileOptions(**bad)
    for srid in (-1, 32748, 1.5, True):
        with pytest.raises(LayerError):
            check_srid(srid)
    assert check_srid(0) == 4326 and check_srid(3857) == 3857
    made = points(spark, [(1, "a", 0.0, 0.0)])
    with pytest.raises(LayerError):
        made.geometry("shape")
    with pytest.raises(LayerError):
        plans.tile_pyramid(made, 3, 2)
    with pytest.raises(LayerError):
        plans.tile_pyramid(made, 0, 31)


def test_property_choice(spark):
    made = points(spark, [(1, "a", 0.0, 0.0)])
    assert plans.property_names(made, None) == ["id", "name"]
    assert plans.property_names(made, ()) == ["id", "name"]
    assert plans.property_names(made, ("nonsense",)) == []
    assert plans.attribute_names(made, TileOptions(properties=("name", "id"), id_column="id")) == ["id", "name"]


def test_requests_prune_the_scan(spark, tmp_path):
    made = points(spark, [(i, "n", i * 0.3 - 170, i * 0.1 - 60) for i in range(1000)])
    made.frame.write.parquet(str(tmp_path / "pts"))
    stored = made.with_frame(spark.read.parquet(str(tmp_path / "pts")))
    asked = spark.createDataFrame([(5, 16, 16), (6, 33, 32)], "z int, x int, y int")
    got = plans.tiles_for(stored, asked)
    assert "GreaterThanOrEqual(geom_u0,0.5)" in got._jdf.queryExecution().executedPlan().toString()
    want = plans.tile_pyramid(made, 5, 6).join(asked, ["z", "x", "y"], "left_semi")
    assert want.count() == 2
    assert {(r.z, r.x, r.y, bytes(r.tile)) for r in got.collect()} == {(r.z, r.x, r.y, bytes(r.tile)) for r in want.collect()}


@pytest.fixture
def no_small_tables(spark):
    """Joins shuffle unless they are told otherwise."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_few_requests_go_to_the_features(spark, monkeypatch, no_small_tables):
    areas = as_layer(with_boxes(spark.createDataFrame([(i, -170.0 + i, -60.0 + i, -168.0 + i, -59.0 + i) for i in range(50)],
                                                      "id bigint, w double, s double, e double, n double"), "w", "s", "e", "n"), "areas")
    asked = spark.createDataFrame([(3, x, y) for x in range(8) for y in range(8)], "z int, x int, y int")

    def met():
        sent = plans._sent(asked, plans._requested_ranges(asked))
        return requested(areas.frame, areas.geometry(), sent, [3], every=True).select("id", "z", "x", "y")

    few = met()
    assert "BroadcastHashJoin" in plan_of(few) and "SortMergeJoin" not in plan_of(few)
    monkeypatch.setattr(plans, "SENT_CELLS", 1)
    many = met()
    assert "SortMergeJoin" in plan_of(many)
    assert sorted(few.collect()) == sorted(many.collect())


def test_blocks_stay_where_they_are(spark, monkeypatch, no_small_tables):
    """Few numbers are sent to the blocks of large tiles; many are joined, with the same bytes."""
    monkeypatch.setattr(plans, "BLOCK_BYTES", 2000)
    made = points(spark, [(i, f"n{i % 7}", i % 40 / 10, i % 30 / 10) for i in range(400)])
    shuffled = r"SortMergeJoin \[z#\d+, x#\d+, y#\d+(, bucket#\d+L)?\]"
    few = plans.tile_pyramid(made, 0, 2)
    assert not re.search(shuffled, plan_of(few))
    monkeypatch.setattr(plans, "SENT_BLOCKS", 0)
    many = plans.tile_pyramid(made, 0, 2)
    assert re.search(shuffled, plan_of(many))
    order = ["z", "x", "y", "part"]
    assert few.orderBy(order).collect() == many.orderBy(order).collect()
    assert few.agg(F.max("n_parts")).first()[0] > 1


def test_waiting_parts_are_compressed_and_finished_in_pieces(monkeypatch):
    n = 3000
    table = pa.table({"tile_no": pa.array(np.zeros(n, np.int64)), "bucket": pa.array(np.repeat(np.arange(3), n // 3)),
                      "flag": pa.array(["a", "b", "c"] * (n // 3)), "step_x": pa.array(np.arange(n)), "step_y": pa.array(np.arange(n))})
    parts = mvt.encode_parts(table, ["flag"], POINT)
    assert parts.num_rows == 3 and sum(parts.column(c).nbytes for c in ("key_index", "value_index", "pairs", "shape_lens")) < n
    parts = parts.append_column("value_base", pa.array([0, 3, 6]))
    whole = list(mvt.finish_parts(parts, ["bucket"]))
    monkeypatch.setattr(mvt, "BATCH_BYTES", 1)
    pieces = list(mvt.finish_parts(parts, ["bucket"]))
    assert [b.num_rows for b in whole] == [3] and [b.num_rows for b in pieces] == [1, 1, 1]
    assert pa.Table.from_batches(pieces).to_pylist() == whole[0].to_pylist()


def test_areas_go_down_once(spark, monkeypatch):
    """Large and other tiles come out of one descent, with the same features; copies count in both."""
    rows = [(i % 50, -170.0 + i % 50 * 6, -60.0 + i % 40, -169.0 + i % 50 * 6, -59.5 + i % 40) for i in range(300)]
    areas = as_layer(with_boxes(spark.createDataFrame(rows * 2, "id bigint, w double, s double, e double, n double"), "w", "s", "e", "n"),
                     "areas", drop=("w", "s", "e", "n"))
    want = read_tiles(plans.tile_pyramid(areas, 0, 4).collect())
    descents = []
    shapes = plans._shapes
    monkeypatch.setattr(plans, "_shapes", lambda *a, **k: descents.append(1) or shapes(*a, **k))
    monkeypatch.setattr(plans, "BLOCK_BYTES", 4000)
    found = plans.tile_pyramid(areas, 0, 4).collect()
    assert len(descents) == 1
    assert {r.n_parts > 1 for r in found} == {True, False}
    assert read_tiles(found) == want
    assert sum(r.n_features for r in found) == sum(len(t[3]) for t in want.values())


@pytest.mark.parametrize("kind", ["points", "lines"])
def test_features_are_read_by_code_that_the_jvm_compiles(spark, kind):
    """The box is projected once, not again for each comparison of the filter; longer methods are interpreted."""
    raw = spark.range(9).selectExpr("id", "cast(id * 7919 % 36000 as double) / 100 - 180 as a", "cast(id * 104729 % 16000 as double) / 100 - 80 as b",
                                    "timestamp_seconds(id) as at")
    if kind == "points":
        made = as_layer(with_points(raw, "a", "b"), "made", drop=("a", "b"))
    else:
        made = as_layer(with_segments(raw.withColumn("c", F.col("a") + 1).withColumn("d", F.col("b") + 1), "a", "b", "c", "d"), "made")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        plans._features(made, TileOptions()).frame.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) <= 8000


@pytest.mark.parametrize("base", [0, 100, 20_000, 3_000_000])
def test_size_of_a_finished_part(base):
    n = 500
    table = pa.table({"tile_no": pa.array(np.zeros(n, np.int64)), "bucket": pa.array(np.zeros(n, np.int64)),
                      "flag": pa.array([None if i % 7 == 0 else str(i) for i in range(n)]), "more": pa.array([None, "a" * 200] * (n // 2)),
                      "step_x": pa.array(np.arange(n) * 40), "step_y": pa.array(np.arange(n))})
    row = mvt.encode_parts(table, ["flag", "more"], POINT).to_pylist()[0] | {"value_base": base}
    assert mvt.finished_size(row) == len(mvt.finish_part(row))


def test_points_of_large_tiles_only_are_not_multiplied(spark, monkeypatch):
    """Points on the edges of large tiles still come to the other tiles that they touch; every tile holds all of its points."""
    rows = [(i, -100.0 + i % 10, 40.0 + i % 9) for i in range(600)] + [(1000 + i, -90.0, 66.51326044311186) for i in range(5)]
    rows += [(2000 + i, 0.0, -10.0) for i in range(3)] + [(3000 + i, 100.0, 10.0) for i in range(4)]
    made = as_layer(with_points(spark.createDataFrame(rows, "id bigint, lon double, lat double"), "lon", "lat"), "made", drop=("lon", "lat"))
    want = read_tiles(plans.tile_pyramid(made, 0, 3).collect())
    monkeypatch.setattr(plans, "BLOCK_BYTES", 4000)
    kept = []
    thinned = plans._seldom_met
    monkeypatch.setattr(plans, "_seldom_met", lambda *a: kept.append(thinned(*a)) or kept[-1])
    found = plans.tile_pyramid(made, 0, 3).collect()
    assert read_tiles(found) == want
    assert {r.n_parts > 1 for r in found} == {True, False}
    assert 0 < kept[0].count() < 100


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_large_tiles_are_made_run_by_run(spark, monkeypatch):
    """Blocks made in runs and slices give the same rows, and no run leaves its shuffle or its features on disk."""
    monkeypatch.setattr(plans, "BLOCK_BYTES", 2000)
    options = TileOptions(part_bytes=8000)
    made = points(spark, [(i, f"n{i % 7}", i % 40 / 10, i % 30 / 10) for i in range(400)])
    order = ["z", "x", "y", "part"]
    want = plans.tile_pyramid(made, 0, 2, options).orderBy(order).collect()
    kept, cuts = [], []
    monkeypatch.setattr(plans, "RUN_BLOCKS", 5)
    keep, cut = plans.stored, plans.cut_lineage
    monkeypatch.setattr(plans, "stored", lambda *a: kept.append(keep(*a)) or kept[-1])
    monkeypatch.setattr(plans, "cut_lineage", lambda frame: cuts.append(frame) or cut(frame))
    gc.collect()
    before = shuffle_files(spark)
    tiles = plans.tile_pyramid(made, 0, 2, options)
    folders = {Path(f.removeprefix("file:")).parent for f in kept[0].inputFiles()}
    assert len(kept) == 1 and sum("n_values" in c.columns for c in cuts) > 3 and not any(f.exists() for f in folders)
    found = tiles.orderBy(order).collect()
    assert found == want and max(r.n_parts for r in found) > 2
    until = time.time() + 20  # files go in the background
    plans.tile_pyramid(made, 0, 2, options)
    while (left := shuffle_files(spark) - before) and time.time() < until:
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    assert len(left) == 0


def test_blocks_of_a_part_are_joined_where_they_lie(spark, monkeypatch):
    """Finished bytes are not shuffled, unless buckets are empty; then too the rows are those of the plain way."""
    monkeypatch.setattr(plans, "BLOCK_BYTES", 300)
    many = points(spark, [(i, f"n{i % 7}", i % 40 / 10, i % 30 / 10) for i in range(400)])
    seldom = points(spark, [(i, "x" * 290, 1.0 + i, 2.0) for i in range(40)])
    plain, order, gathered = [], ["z", "x", "y", "part"], "collect_list"
    for layer, shuffles, part_bytes in ((many, False, 1 << 20), (seldom, True, 600)):
        tiles = plans.tile_pyramid(layer, 0, 0, TileOptions(part_bytes=part_bytes))
        assert (gathered in plan_of(tiles)) == shuffles
        plain.append(tiles.orderBy(order).collect())
    monkeypatch.setattr(plans, "SENT_BLOCKS", 0)
    for layer, part_bytes, want in ((many, 1 << 20, plain[0]), (seldom, 600, plain[1])):
        tiles = plans.tile_pyramid(layer, 0, 0, TileOptions(part_bytes=part_bytes))
        assert gathered in plan_of(tiles) and tiles.orderBy(order).collect() == want
    assert max(r.n_parts for r in plain[1]) > 3


@pytest.mark.parametrize("sizes", [[], [5], [3, 40, 3, 33, 0, 7, 200, 1]])
def test_messages_wait_by_length(sizes):
    lens, body = np.array(sizes, np.int64), np.random.default_rng(3).integers(0, 256, sum(sizes)).astype(np.uint8)
    held = mvt._packed_messages(body, lens)
    assert mvt._messages(held) == body.tobytes() and int.from_bytes(held[:4], "little") == len(body)


def test_waiting_points_are_small():
    """Ids that occur once and a few values take under eleven bytes of a feature while they wait."""
    n, draw = 8000, np.random.default_rng(1)
    table = pa.table({"tile_no": np.zeros(n, np.int64), "bucket": np.zeros(n, np.int64), "id": np.sort(draw.integers(0, 10**10, n)),
                      "kind": draw.integers(0, 50, n), "day": [f"1995-{d // 28 % 12 + 1:02}-{d % 28 + 1:02}" for d in draw.integers(0, 336, n)],
                      "step_x": draw.integers(0, 8192, n), "step_y": draw.integers(0, 8192, n)})
    row = mvt.encode_parts(table, ["id", "kind", "day"], POINT).to_pylist()[0]
    assert sum(len(v) for v in row.values() if isinstance(v, bytes)) < 11 * n
