"""Look into finished tiles: layers, feature counts, geometry types, samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tilewright.model import LayerError
from tilewright.operators import untile

TILE = ["z", "x", "y"]
MAX_SAMPLES = 20

def type_name(code: Column) -> Column:
    return (F.when(code == 1, "Point").when(code == 2, "LineString").when(code == 3, "Polygon")
            .otherwise(F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")"))))


_PLACE = [*[(c, pa.int32()) for c in (*TILE, "part")], ("layer", pa.string())]
_LAYERS = pa.schema([*_PLACE, ("version", pa.int32()), ("extent", pa.int32()), ("type", pa.int32()), ("n", pa.int64()),
                     ("bytes", pa.int64())])
_FEATURES = pa.schema([
    *_PLACE, ("ordinal", pa.int32()), ("type", pa.int32()), ("properties", pa.map_(pa.string(), pa.string())),
    ("paths", pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))))])


def _decode(tiles: DataFrame, decode, schema: pa.Schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in untile.chunks(batch):
                yield decode(piece)

    return tiles.select("layer", *TILE, "part", "tile", "keys").mapInArrow(run, from_arrow_schema(schema))


def _layer_rows(tiles: DataFrame) -> DataFrame:
    return _decode(tiles, lambda batch: untile.layer_rows(batch, _LAYERS), _LAYERS)


def decode_features(tiles: DataFrame, limit: int | None = None) -> DataFrame:
    """Features of a tile table: ``z, x, y, part, layer, ordinal, type, properties, paths``.

    ``limit`` keeps the first features of every row of the table only.
    """
    return _decode(tiles, lambda batch: untile.feature_rows(batch, limit, _FEATURES), _FEATURES)


def inspect_layers(tiles: DataFrame) -> DataFrame:
    """Per tile and layer: version, extent, number of features, and how many of each geometry type."""
    rows = _layer_rows(tiles).filter(F.col("layer").isNotNull())
    kinds = {n: F.coalesce(F.sum(F.when(F.col("type") == code, F.col("n"))), F.lit(0).cast("bigint"))
             for n, code in (("points", 1), ("lines", 2), ("polygons", 3))}
    other = F.coalesce(F.sum(F.when(~F.col("type").isin(1, 2, 3), F.col("n"))), F.lit(0).cast("bigint"))
    return rows.groupBy(*TILE, "layer").agg(
        F.max("version").alias("version"), F.max("extent").alias("extent"), F.sum("n").alias("feature_count"),
        *[c.alias(n) for n, c in kinds.items()], other.alias("unknown"))


def geometry_types(tiles: DataFrame) -> DataFrame:
    """``z, x, y, layer, geometry_type, n``."""
    rows = _layer_rows(tiles).filter(F.col("type").isNotNull())
    return rows.groupBy(*TILE, "layer", type_name(F.col("type")).alias("geometry_type")).agg(F.sum("n").alias("n"))


def inspect_tiles(tiles: DataFrame) -> DataFrame:
    """Per tile: status, bytes, number of layers and features; an empty tile is a row too."""
    layers = _layer_rows(tiles).groupBy(*TILE, "layer").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("bigint")
    totals = layers.groupBy(TILE).agg(F.sum("bytes").alias("byte_size"), F.count("layer").alias("total_layers"),
                                      F.coalesce(F.sum("n"), zero).alias("total_features"))
    status = F.when(F.col("byte_size") == 0, "EMPTY_TILE").otherwise("OK").alias("status")
    return totals.select(*TILE, status, "byte_size", "total_layers", "total_features")


def tile_samples(tiles: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` features of every layer of every tile, in tile order."""
    if not 0 <= n <= MAX_SAMPLES:
        raise LayerError(f"the number of samples must be between 0 and {MAX_SAMPLES}")
    w = Window.partitionBy(*TILE, "layer").orderBy("part", "ordinal")
    found = decode_features(tiles, n).withColumn("sample", F.row_number().over(w)).filter(F.col("sample") <= n)
    return found.select(*TILE, "layer", "sample", type_name(F.col("type")).alias("geometry_type"), "properties")
