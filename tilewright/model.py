"""Layers: a DataFrame plus the description of its geometry columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import tilemath as tm

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))  # part > ring > vertex
GEOMETRY = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("parts", PARTS)]
)
BOX = ("u0", "v0", "u1", "v1")


class LayerError(ValueError):
    """A layer, geometry column or option that cannot be used."""


@dataclass(frozen=True)
class GeometryColumn:
    name: str
    kind: str
    srid: int = tm.DEFAULT_SRID
    dimensions: int = 2
    comment: str | None = None

    @property
    def is_point(self) -> bool:
        return self.kind == "POINT"

    def box(self, side: str) -> str:
        """Column of one side of the unit box; a point stores two sides only."""
        return f"{self.name}_{side.replace('1', '0') if self.is_point else side}"

    @property
    def box_names(self) -> list[str]:
        return [self.box(side) for side in BOX]

    @property
    def box_columns(self) -> list[str]:
        """The stored columns of the box, each once."""
        return list(dict.fromkeys(self.box_names))


@dataclass(frozen=True)
class TileOptions:
    extent: int = 4096
    buffer: int = 64
    clip: bool = True
    geometry: str | None = None
    properties: tuple[str, ...] | None = None
    id_column: str | None = None
    layer_name: str | None = None
    where: Any = None
    part_bytes: int = 4 << 20  # a larger tile is stored as numbered parts of whole blocks; its bytes stay the same

    def __post_init__(self):
        for name, low in (("extent", 1), ("buffer", 0), ("part_bytes", 1)):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < low:
                raise LayerError(f"{name} must be an integer of at least {low}")


@dataclass(frozen=True)
class Layer:
    """A spatial table. ``frame`` holds the attributes and, per geometry column,
    the geometry struct and its unit box ``<name>_u0 .. <name>_v1`` (a point has
    ``u0`` and ``v0`` only)."""

    name: str
    frame: DataFrame
    geometries: tuple[GeometryColumn, ...]
    schema: str = "public"
    kind: str = "table"
    comment: str | None = None
    _hidden: frozenset = field(default=frozenset(), compare=False)

    @property
    def id(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def fields(self) -> dict[str, T.DataType]:
        """Attribute columns in table order, geometry left out."""
        skip = {n for g in self.geometries for n in (g.name, *g.box_names)}
        return {f.name: f.dataType for f in self.frame.schema.fields if f.name not in skip}

    def geometry(self, name: str | None = None) -> GeometryColumn:
        if name is None:
            return self.geometries[0]
        for g in self.geometries:
            if g.name == name:
                return g
        raise LayerError(f"{self.id} has no geometry column {name!r}")

    def with_frame(self, frame: DataFrame) -> Layer:
        return replace(self, frame=frame)

    @staticmethod
    def from_frame(frame: DataFrame, name: str, schema: str = "public", kind: str = "table",
                   comment: str | None = None) -> Layer:
        """Read the geometry columns back from the metadata of a stored table or view."""
        found = geometry_columns(frame.schema)
        if not found:
            raise LayerError(f"{schema}.{name} has no geometry column")
        return Layer(name, frame, tuple(found), schema, kind, comment)


def geometry_columns(schema: T.StructType) -> list[GeometryColumn]:
    out = []
    for f in schema.fields:
        meta = (f.metadata or {}).get("geometry")
        if meta:
            out.append(GeometryColumn(f.name, meta["type"], meta["srid"], meta["dimensions"],
                                      (f.metadata or {}).get("comment")))
    return out


def check_srid(srid: int, default: int = tm.DEFAULT_SRID) -> int:
    """A positive integer SRID that can be projected; zero means the default."""
    if srid is None or srid == 0:
        return default
    if isinstance(srid, bool) or not isinstance(srid, int) or srid < 0:
        raise LayerError("srid must be a positive integer")
    if srid not in tm.SUPPORTED_SRIDS:
        raise LayerError(f"srid {srid} is not supported, use one of {tm.SUPPORTED_SRIDS}")
    return srid


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def add_geometry(frame: DataFrame, name: str, kind: str, parts: Column, srid: int = 4326,
                 box: tuple[Column, Column, Column, Column] | None = None,
                 present: Column | None = None, comment: str | None = None) -> DataFrame:
    """Add a geometry column and its unit box.

    ``box`` is ``(minx, miny, maxx, maxy)`` in source coordinates; without it
    the box is taken from the vertices. ``present`` marks rows with geometry.
    """
    code = check_srid(srid)
    if box is None:
        flat = F.flatten(F.flatten(parts))
        xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
        box = (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    minx, miny, maxx, maxy = box
    here = parts.isNotNull() if present is None else present
    shape = F.struct(F.lit(kind).alias("kind"), F.lit(code).cast("int").alias("srid"), parts.alias("parts"))
    meta: dict[str, Any] = {"geometry": {"type": kind, "srid": code, "dimensions": 2}}
    if comment:
        meta["comment"] = comment
    sides = {
        "u0": tm.unit_x_of(minx, code),
        "v0": tm.unit_y_of(maxy, code),
        "u1": tm.unit_x_of(maxx, code),
        "v1": tm.unit_y_of(miny, code),
    }
    if kind == "POINT":
        sides = {side: sides[side] for side in ("u0", "v0")}
    # The sides come out of a generator, past which no filter moves: a filter on the box would else repeat the projection once
    # for each comparison, in a method too long for the JVM to compile.
    box = F.inline(F.array(F.struct(*[F.when(here, c).alias(f"{name}_{side}") for side, c in sides.items()])))
    out = frame.select("*", F.when(here, shape).alias(name, metadata=meta), box)
    for side in sides:
        out = out.withMetadata(f"{name}_{side}", {"box_of": name})
    return out
