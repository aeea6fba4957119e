"""Writers of tiles and documents."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tilewright.model import Layer
from tilewright.operators.features import geojson_lines


def write_tiles(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tile table partitioned by layer and zoom, so a lookup reads one folder."""
    tiles.write.mode(mode).partitionBy("layer", "z").parquet(path)


def write_geojson(layer: Layer, path: str, where: Any = None, mode: str = "overwrite") -> None:
    """One GeoJSON Feature per line."""
    geojson_lines(layer, where).select("feature").write.mode(mode).text(path)


def write_documents(documents: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One document per line: TileJSON texts or metric lines."""
    documents.select(column).write.mode(mode).text(path)
