"""Build layers from tables that hold coordinates in plain columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.model import Layer, add_geometry, geometry_columns, vertex


def with_points(frame: DataFrame, x: str, y: str, geometry: str = "geom", srid: int = 4326,
                comment: str | None = None) -> DataFrame:
    cx, cy = F.col(x), F.col(y)
    parts = F.array(F.array(F.array(vertex(cx, cy))))
    return add_geometry(frame, geometry, "POINT", parts, srid, (cx, cy, cx, cy),
                        cx.isNotNull() & cy.isNotNull(), comment)


def with_segments(frame: DataFrame, x0: str, y0: str, x1: str, y1: str, geometry: str = "geom",
                  srid: int = 4326, comment: str | None = None) -> DataFrame:
    a, b, c, d = (F.col(n) for n in (x0, y0, x1, y1))
    parts = F.array(F.array(F.array(vertex(a, b), vertex(c, d))))
    box = (F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))
    present = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    return add_geometry(frame, geometry, "LINESTRING", parts, srid, box, present, comment)


def with_boxes(frame: DataFrame, west: str, south: str, east: str, north: str, geometry: str = "geom",
               srid: int = 4326, present: str | None = None, comment: str | None = None) -> DataFrame:
    w, s, e, n = (F.col(c) for c in (west, south, east, north))
    ring = F.array(vertex(w, s), vertex(e, s), vertex(e, n), vertex(w, n), vertex(w, s))
    here = w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull()
    if present is not None:
        here = here & F.col(present).isNotNull()
    return add_geometry(frame, geometry, "POLYGON", F.array(F.array(ring)), srid, (w, s, e, n), here, comment)


def with_parts(frame: DataFrame, parts: str, kind: str, geometry: str = "geom", srid: int = 4326,
               comment: str | None = None) -> DataFrame:
    """Any geometry from a nested array part > ring > vertex (x, y)."""
    return add_geometry(frame, geometry, kind, F.col(parts), srid, comment=comment).drop(parts)


def as_layer(frame: DataFrame, name: str, schema: str = "public", comment: str | None = None,
             drop: tuple[str, ...] = ()) -> Layer:
    """Name a frame with geometry as a layer; ``drop`` leaves out the coordinate columns."""
    kept = frame.drop(*drop)
    return Layer(name, kept, tuple(geometry_columns(kept.schema)), schema, comment=comment)
