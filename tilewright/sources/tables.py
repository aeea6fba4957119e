"""Spatial tables and views of the session catalog."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.catalog import Table

from tilewright.functions import tilemath as tm
from tilewright.functions.text import split_catalog_id
from tilewright.model import Layer, LayerError, geometry_columns

# fixed values: kinds of catalog objects
KINDS = {"VIEW": "view", "TEMPORARY": "view", "MANAGED": "table", "EXTERNAL": "table"}
DEFAULT_SCHEMA = "public"  # schema name shown for objects without a namespace


def register(layer: Layer) -> Layer:
    """Publish a layer as a temporary view of the session."""
    layer.frame.createOrReplaceTempView(layer.name)
    return layer


def save_layer(layer: Layer, table: str, files: int | None = None) -> None:
    """Write a layer as a table clustered by position.

    Rows are ordered along a space-filling curve over the corner of their box, so rows near each other in both
    directions land in the same files and the box columns' Parquet statistics let a bounding-box filter skip most of them.
    """
    g = layer.geometry()
    placed = layer.frame.withColumn("_place", tm.curve_place(F.col(g.box("u0")), F.col(g.box("v0"))))
    spread = placed.repartitionByRange(files, "_place") if files else placed.repartitionByRange("_place")
    spread.sortWithinPartitions("_place").drop("_place").write.mode("overwrite").saveAsTable(table)


def open_layer(spark: SparkSession, catalog_id: str) -> Layer:
    """Layer of ``schema.table``, or of a bare name: a temporary view first, then a table of the current database."""
    schema, name = split_catalog_id(catalog_id, "")
    for where in [schema] if schema else [DEFAULT_SCHEMA, spark.catalog.currentDatabase()]:
        for layer in scan_catalog(spark, where, [name]):
            return layer
    raise LayerError(f"catalog item {catalog_id!r} not found")


def scan_catalog(spark: SparkSession, schema: str | None = None, names: Iterable[str] | None = None) -> list[Layer]:
    """All objects with a geometry column in the databases of the current catalog, ordered by schema and name.

    Temporary views stand in the default schema. ``schema`` and ``names`` narrow the search. Reads metadata only.
    """
    wanted = None if names is None else set(names)
    found = []
    for namespace, t in _objects(spark, schema):
        if wanted is not None and t.name not in wanted:
            continue
        frame = spark.table(f"`{t.name}`" if t.isTemporary else f"`{namespace}`.`{t.name}`")
        if geometry_columns(frame.schema):
            found.append(Layer.from_frame(frame, t.name, namespace, KINDS.get(t.tableType, "table"), t.description))
    return sorted(found, key=lambda layer: (layer.schema, layer.name))


def _objects(spark: SparkSession, schema: str | None) -> Iterator[tuple[str, Table]]:
    """Temporary views, which every database lists, once; then tables and views of one database or of all."""
    if schema in (None, DEFAULT_SCHEMA):
        yield from ((DEFAULT_SCHEMA, t) for t in spark.catalog.listTables() if t.isTemporary)
    for database in spark.catalog.listDatabases():
        if schema in (None, database.name):
            yield from ((database.name, t) for t in spark.catalog.listTables(database.name) if not t.isTemporary)


def bbox_filter(layer: Layer, u0: float, v0: float, u1: float, v1: float) -> DataFrame:
    """Rows whose box overlaps a unit box, edges included; pushed down to the scan."""
    g = layer.geometry()
    return layer.frame.filter((F.col(g.box("u1")) >= u0) & (F.col(g.box("u0")) <= u1)
                              & (F.col(g.box("v1")) >= v0) & (F.col(g.box("v0")) <= v1))
