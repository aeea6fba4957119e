"""The store of made tiles: hits, retries, versions and half-written batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from queryset.fixtures import layer
from tilewright.model import TileOptions
from tilewright.plans.tiles import get_or_store, tiles_for
from tilewright.sources.store import TileStore

ASKED = [(0, 0, 0), (1, 0, 0), (1, 1, 1), (3, 0, 7), (3, 0, 7), (5, 99, 0)]  # one twice, one outside the grid


@pytest.fixture(scope="module")
def made(spark, sf):
    return layer(spark, sf, "customer_pt")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "z int, x int, y int")


def sources(rows):
    return sorted((r.z, r.x, r.y, r.source) for r in rows.where("part = 0").collect())


def test_second_run_is_all_hits(made, asked, tmp_path):
    store = TileStore(str(tmp_path))
    first = get_or_store(made, asked.where("z = 0"), store)
    assert sources(first) == [(0, 0, 0, "MISS")]
    assert [s[3] for s in sources(get_or_store(made, asked, store))] == ["HIT", "MISS", "MISS", "MISS"]
    again = get_or_store(made, asked, store)
    assert {s[3] for s in sources(again)} == {"HIT"}
    want = {(r.z, r.x, r.y, r.part): bytes(r.tile) for r in tiles_for(made, asked).collect()}
    assert {(r.z, r.x, r.y, r.part): bytes(r.tile) for r in again.collect()} == want


def test_options_and_versions_have_tiles_of_their_own(spark, made, asked, tmp_path):
    store = TileStore(str(tmp_path))
    one = asked.where("z = 0")
    for options, version in ((TileOptions(), 1), (TileOptions(id_column="id"), 1), (TileOptions(), 2)):
        assert [s[3] for s in sources(get_or_store(made, one, store, version, options))] == ["MISS"]
        assert [s[3] for s in sources(get_or_store(made, one, store, version, options))] == ["HIT"]
    assert store.drop_outdated(spark, made.id, 2) == ["1"]
    assert [s[3] for s in sources(get_or_store(made, one, store, 2))] == ["HIT"]
    assert [s[3] for s in sources(get_or_store(made, one, store, 1))] == ["MISS"]
    assert store.drop_outdated(spark, "public.nothing", 1) == [] == TileStore(f"{tmp_path}/none").drop_outdated(spark, made.id, 1)


def test_a_put_cut_short_does_not_count(spark, made, asked, tmp_path):
    store = TileStore(str(tmp_path))
    tiles = get_or_store(made, asked.where("z = 1"), TileStore(f"{tmp_path}/other")).drop("source")
    half = tiles.where("x = 0").select("*", F.lit(made.id).alias("store_layer"), F.lit("1").alias("store_version"),
                                       F.col("z").alias("store_z"), F.lit("b").alias("batch"))
    half.write.partitionBy("store_layer", "store_version", "store_z", "batch").parquet(f"{tmp_path}/tiles")
    keys = tiles.select("tile_key", "z")
    assert store.lookup(keys, made.id, 1).count() == 0
    assert store.put(tiles, made.id, 1, "b") == "b"  # the same batch again
    store.put(tiles, made.id, 1, "c")  # and another with the same keys
    rows = store.lookup(keys, made.id, 1).collect()
    assert len(rows) == tiles.count() and {r.batch for r in rows} == {"b"}


def test_lookup_reads_only_its_folders(spark, made, asked, tmp_path):
    store = TileStore(str(tmp_path))
    get_or_store(made, asked, store)
    keys = get_or_store(made, asked.where("z = 1"), store).select("tile_key", "z")
    plan = store.lookup(keys, made.id, 1)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "store_z" in line]
    assert scans and all(f"{name}#" in line for line in scans for name in ("store_layer", "store_version", "store_z", "batch"))
