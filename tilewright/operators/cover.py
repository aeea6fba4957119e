"""Which tiles a feature belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tilemath as tm
from tilewright.model import GeometryColumn

WIDE_COVER = 4096  # tiles of one feature and zoom from which its cover is spread over tasks
BLOCK = 64  # tiles per side of one spread block


def in_world(g: GeometryColumn) -> Column:
    """Has geometry and touches the square web-mercator world."""
    u0, v0, u1, v1 = (F.col(n) for n in g.box_names)
    return u0.isNotNull() & (u1 >= 0) & (u0 <= 1) & (v1 >= 0) & (v0 <= 1)


def visible(g: GeometryColumn, z: Column, extent: int) -> Column:
    """Lines and areas smaller than half a grid cell have no tile geometry."""
    if g.kind.endswith("POINT"):
        return F.lit(True)
    u0, v0, u1, v1 = (F.col(n) for n in g.box_names)
    half = F.lit(0.5 / extent)
    across = tm.tiles_across(z)
    return ((u1 - u0) * across >= half) | ((v1 - v0) * across >= half)


def tile_range(g: GeometryColumn, z: Column) -> tuple[Column, Column, Column, Column]:
    """First and last column and row of tiles touched at a zoom (inclusive edges)."""
    u0, v0, u1, v1 = (F.col(n) for n in g.box_names)
    return tm.first_tile(u0, z), tm.last_tile(u1, z), tm.first_tile(v0, z), tm.last_tile(v1, z)


def widest_cover(frame: DataFrame, g: GeometryColumn, zoom: int) -> int:
    """Largest number of tiles one feature covers at a zoom; reads the box columns only."""
    if g.is_point:
        return 4
    x0, x1, y0, y1 = tile_range(g, F.lit(zoom))
    count = (x1 - x0 + 1).cast("bigint") * (y1 - y0 + 1)
    return frame.filter(in_world(g)).agg(F.max(count)).first()[0] or 0


def cover(frame: DataFrame, g: GeometryColumn, zooms: list[int], extent: int = 4096,
          wide: bool = False, every: bool = False) -> DataFrame:
    """One row per feature and tile, with columns ``z, x, y`` added.

    Features too small to be seen at a zoom are left out, unless ``every`` is set.
    With ``wide`` the cover of huge features is cut into blocks of tiles that
    are shuffled before they are expanded, so no task expands a continent alone.
    """
    z = F.col("z")
    levels = F.array(*[F.lit(int(v)) for v in zooms])
    base = frame.filter(in_world(g)).withColumn("z", F.explode(levels))
    if not every:
        base = base.filter(visible(g, z, extent))
    x0, x1, y0, y1 = tile_range(g, z)
    if not wide:
        return base.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
    count = (x1 - x0 + 1).cast("bigint") * (y1 - y0 + 1)
    plain = (base.filter(count <= WIDE_COVER)
             .withColumn("x", F.explode(F.sequence(x0, x1)))
             .withColumn("y", F.explode(F.sequence(y0, y1))))

    def steps(low, high):
        return F.sequence((low / BLOCK).cast("int"), (high / BLOCK).cast("int"))

    def inside(block, low, high):
        return F.sequence(F.greatest(block * BLOCK, low), F.least(block * BLOCK + BLOCK - 1, high))

    blocks = (base.filter(count > WIDE_COVER)
              .withColumn("_bx", F.explode(steps(x0, x1)))
              .withColumn("_by", F.explode(steps(y0, y1)))
              .repartition("z", "_bx", "_by", *g.box_columns))
    spread = (blocks.withColumn("x", F.explode(inside(F.col("_bx"), x0, x1)))
              .withColumn("y", F.explode(inside(F.col("_by"), y0, y1)))
              .drop("_bx", "_by"))
    return plain.unionByName(spread)


def requested(frame: DataFrame, g: GeometryColumn, requests: DataFrame, zooms: list[int], extent: int = 4096,
              every: bool = False) -> DataFrame:
    """One row per feature and requested tile it belongs to, with columns ``z, x, y`` added.

    A feature has a home zoom, at which its box is no larger than a tile. For each requested zoom it is covered at its
    home zoom, or at the requested one if that is less deep, by at most three cells a side; a request brings the cells
    above it. They meet by an equi-join on the cell, so the rows do not grow with the tiles that a feature covers
    but only with the requested ones. ``requests`` has distinct addresses ``z, x, y`` of the zooms in ``zooms``.
    """
    z, home = F.col("z"), F.col("_at")
    box = [F.col(n) for n in g.box_names]
    deepest = F.lit(tm.MAX_ZOOM) if g.is_point else tm.home_zoom(*box)
    base = frame.filter(in_world(g)).withColumn("z", F.explode(F.array(*[F.lit(int(v)) for v in zooms])))
    if not every:
        base = base.filter(visible(g, z, extent))
    x0, x1, y0, y1 = tile_range(g, home)
    cells = (base.withColumn("_at", F.least(z, deepest)).withColumn("_cx", F.explode(F.sequence(x0, x1)))
             .withColumn("_cy", F.explode(F.sequence(y0, y1))))
    above = (requests.select("z", "x", "y", F.explode(F.sequence(F.lit(0), z)).alias("_at"))
             .select("z", "x", "y", "_at", tm.ancestor(F.col("x"), z, home).alias("_cx"), tm.ancestor(F.col("y"), z, home).alias("_cy")))
    met = cells.join(above, ["z", "_at", "_cx", "_cy"]).drop("_at", "_cx", "_cy")
    return met.filter(tm.box_touches_tile(*box, z, F.col("x"), F.col("y")))
