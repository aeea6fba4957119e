"""Tile keys, ETags and the publishing of tile tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.text import blank_to_null, etag, etag_of, strip

TILE = ["z", "x", "y"]


def canonical_parameters(frame: DataFrame) -> Column:
    """JSON text of the parameters that affect a tile, in fixed key order, NULLs left out.

    Reads the optional columns ``buffer, clip, extent, geom, layer_name,
    properties, tenant_id, where``.
    """
    have = {f.name: f.dataType for f in frame.schema.fields}

    def text(name):
        return blank_to_null(F.col(f"`{name}`")) if name in have else F.lit(None).cast("string")

    def plain(name, dtype):
        return F.col(name) if name in have else F.lit(None).cast(dtype)

    if "properties" in have:
        items = F.col("properties")
        if not isinstance(have["properties"], T.ArrayType):
            items = F.split(items, ",")
        items = F.array_sort(F.array_distinct(F.filter(F.transform(items, strip), lambda p: p != "")))
        properties = F.when(F.size(items) > 0, items)
    else:
        properties = F.lit(None).cast("array<string>")
    body = F.struct(
        plain("buffer", "int").alias("buffer"), plain("clip", "boolean").alias("clip"),
        plain("extent", "int").alias("extent"), text("geom").alias("geom"), text("layer_name").alias("layerName"),
        properties.alias("properties"), text("tenant_id").alias("tenantId"), text("where").alias("where"))
    return F.to_json(body)


def parameter_hash(parameters: Column) -> Column:
    return F.substring(F.sha2(parameters, 256), 1, 16)


def tile_keys(requests: DataFrame) -> DataFrame:
    """Add ``tile_key`` to tile requests ``catalog_id, version, z, x, y`` with optional parameters."""
    tenant = blank_to_null(F.col("tenant_id")) if "tenant_id" in requests.columns else F.lit(None).cast("string")
    version = F.col("version").cast("string") if "version" in requests.columns else F.lit(None).cast("string")
    key = F.concat(
        F.lit("mvt:v1:"), F.lower(strip(F.col("catalog_id"))), F.lit(":d"), F.coalesce(version, F.lit("1")),
        F.lit(":z"), F.col("z").cast("string"), F.lit(":x"), F.col("x").cast("string"),
        F.lit(":y"), F.col("y").cast("string"), F.lit(":q"), parameter_hash(canonical_parameters(requests)),
        F.coalesce(F.concat(F.lit(":t"), tenant), F.lit("")))
    return requests.withColumn("tile_key", key)


def tile_etags(tiles: DataFrame) -> DataFrame:
    """``layer, z, x, y, bytes, etag`` of each tile of a tile table.

    The ETag is that of all bytes of the tile, in however many parts they are kept. A tile of one part is
    digested where it lies. The parts of others are brought together in order and fed to the digest one by one, so a
    task holds no more of a tile than one batch of parts.
    """
    key = ["layer", *TILE]
    whole = tiles.filter(F.col("n_parts") == 1).select(
        *key, F.octet_length("tile").cast("bigint").alias("bytes"), etag("tile").alias("etag"))
    parts = (tiles.filter(F.col("n_parts") > 1).select(*key, "part", "tile")
             .repartition(*key).sortWithinPartitions(*key, "part"))
    digests = parts.mapInArrow(_digests, "layer string, z int, x int, y int, bytes bigint, digest string")
    return whole.unionByName(digests.select(*key, "bytes", etag_of(F.col("bytes"), F.col("digest")).alias("etag")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of the joined parts of each tile; rows come sorted by tile and part."""
    names = ["layer", *TILE, "bytes", "digest"]
    last, size, digest = None, 0, None
    for batch in batches:
        done = []
        for *key, tile in zip(*(batch.column(c).to_pylist() for c in ["layer", *TILE]), batch.column("tile"), strict=True):
            if key != last:
                if last is not None:
                    done.append((*last, size, digest.hexdigest()[:16]))
                last, size, digest = key, 0, hashlib.md5(usedforsecurity=False)
            part = tile.as_buffer()
            digest.update(part)
            size += len(part)
        if done:
            yield _etag_rows(done, names)
    if last is not None:
        yield _etag_rows([(*last, size, digest.hexdigest()[:16])], names)


def _etag_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def publish_list(tiles: DataFrame, catalog_id: str, version: str | int = 1) -> DataFrame:
    """``tile_key, etag`` of the tiles of one layer."""
    named = tile_etags(tiles).withColumn("catalog_id", F.lit(catalog_id)).withColumn(
        "version", F.lit(str(version)))
    return tile_keys(named).select("tile_key", *TILE, "bytes", "etag")


def compare_published(new: DataFrame, published: DataFrame) -> DataFrame:
    """``tile_key, status``: added, changed, same or removed against an earlier publication."""
    before = published.select("tile_key", F.col("etag").alias("old_etag"))
    both = new.select("tile_key", F.col("etag").alias("new_etag")).join(before, "tile_key", "full_outer")
    status = (F.when(F.col("old_etag").isNull(), "added").when(F.col("new_etag").isNull(), "removed")
              .when(F.col("old_etag") == F.col("new_etag"), "same").otherwise("changed"))
    return both.select("tile_key", "old_etag", "new_etag", status.alias("status"))


def not_modified(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """Conditional requests: ``if_none_match`` equal to the ETag, or ``*``, needs no body.

    ``requests`` has ``tile_key, if_none_match``; ``tiles`` has ``tile_key, etag``.
    """
    answer = requests.join(tiles.select("tile_key", "etag"), "tile_key", "left")
    same = (F.col("if_none_match") == F.col("etag")) | (F.col("if_none_match") == "*")
    status = F.when(F.col("etag").isNull(), 404).when(F.coalesce(same, F.lit(False)), 304).otherwise(200)
    return answer.withColumn("status", status)


def missing_tiles(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct requested keys that the store of published tiles does not hold."""
    wanted = requests.dropDuplicates(["tile_key"])
    return wanted.join(store.select("tile_key").distinct(), "tile_key", "left_anti")


def store_size(tiles: DataFrame) -> DataFrame:
    """Tiles and bytes held, per layer and zoom."""
    first = F.col("part") == 0
    return tiles.groupBy("layer", "z").agg(
        F.count_if(first).alias("tiles"), F.sum(F.octet_length("tile").cast("bigint")).alias("bytes"))
