"""Lines and areas down the zooms: what a tile holds of a geometry goes to its children.

A geometry starts whole in the tile of zoom 0. Each child of a tile gets the vertices of its parent's piece that matter to it:
of a run of vertices beyond one side of the child's box, grown by the buffer, only the first and the last are
kept. No vertex is moved or made, so the tile geometry is that of the whole geometry, while a vertex is looked at
about four times for each zoom. Tiles that a path passes by are left as soon as nothing of it is left there, so a
slanting line walks along the grid instead of filling its box.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.model import GeometryColumn
from tilewright.operators.cover import WIDE_COVER, in_world, tile_range
from tilewright.operators.geometry import POINT, POLYGON, Paths, clip_shapes, command_lists, geometry_code, source_paths
from tilewright.operators.ragged import spans

SPLIT_ZOOM = 5  # pieces of huge features are dealt out to tasks at this zoom
CHUNK_VERTICES = 1 << 18  # vertices and pieces handled at once; a piece is never cut
CHUNK_PIECES = 1 << 13
SLACK = 2  # grid cells beyond the buffer, for rounding
PIECE = "px int, py int, rings binary, holes binary, us binary, vs binary"


@dataclass
class Pieces:
    """Pieces of features in tiles of one zoom; ``paths`` holds unit coordinates, ``paths.row`` numbers the pieces."""

    z: int
    feature: np.ndarray
    x: np.ndarray
    y: np.ndarray
    paths: Paths

    def some(self, a: int, b: int) -> Pieces:
        p = self.paths
        ring = np.searchsorted(p.row, [a, b])
        vertex = np.concatenate(([0], np.cumsum(p.lens)))[ring]
        rings, vertices = slice(*ring), slice(*vertex)
        paths = Paths(p.row[rings] - a, p.hole[rings], p.lens[rings], p.px[vertices], p.py[vertices])
        return Pieces(self.z, self.feature[a:b], self.x[a:b], self.y[a:b], paths)

    def chunks(self) -> Iterator[Pieces]:
        """The pieces in runs of bounded size."""
        n = len(self.feature)
        size = np.bincount(self.paths.row, weights=self.paths.lens, minlength=n)
        number = np.maximum(np.cumsum(size) // CHUNK_VERTICES, np.arange(n) // CHUNK_PIECES)
        edges = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
            if a < b:
                yield self.some(a, b)


@dataclass(frozen=True)
class Descent:
    code: int
    zooms: tuple[int, ...]
    extent: int
    buffer: int

    def children(self, pieces: Pieces, box: np.ndarray) -> Pieces:
        """The pieces of the next zoom, within the tiles that the box (``u0, v0, u1, v1``) of each feature touches."""
        z = pieces.z + 1
        across = 2.0**z
        u0, v0, u1, v1 = (side[pieces.feature] * across for side in box)
        first_x, first_y = (np.maximum(np.ceil(low) - 1, 0) for low in (u0, v0))
        last_x, last_y = (np.minimum(np.floor(high), across - 1) for high in (u1, v1))
        found = []
        for right in (0, 1):
            for below in (0, 1):
                x, y = 2 * pieces.x + right, 2 * pieces.y + below
                at = np.flatnonzero((x >= first_x) & (x <= last_x) & (y >= first_y) & (y <= last_y))
                found.append((at, x[at], y[at]))
        at, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        p = pieces.paths
        begin = np.searchsorted(p.row, np.arange(len(pieces.feature) + 1))
        count = np.diff(begin)[at]
        ring = spans(begin[at], count)
        vertex = spans(p.starts[ring], p.lens[ring])
        whole = Paths(np.repeat(np.arange(len(at)), count), p.hole[ring], p.lens[ring], p.px[vertex], p.py[vertex])
        kept = self.thinned(whole, x, y, across)
        left, row = np.unique(kept.row, return_inverse=True)
        kept.row = row
        return Pieces(z, pieces.feature[at][left], x[left], y[left], kept)

    def thinned(self, p: Paths, x: np.ndarray, y: np.ndarray, across: float) -> Paths:
        """Paths without what lies beyond one side of their tile's grown box."""
        if not len(p.px):
            return p.keep_paths(np.zeros(len(p.lens), bool))
        owner = np.repeat(p.row, p.lens)
        pad = (self.buffer + SLACK) / self.extent
        across_x, across_y = p.px * across - x[owner], p.py * across - y[owner]
        side = np.select([across_x < -pad, across_x > 1 + pad, across_y < -pad, across_y > 1 + pad], [1, 2, 3, 4], 0)
        if self.code == POINT:
            p = p.keep_vertices(side == 0)
            return p.keep_paths(p.lens > 0)
        index = np.arange(len(side))
        before, after = index - 1, index + 1
        some = p.lens > 0
        first, last = p.starts[some], (p.starts + p.lens - 1)[some]
        ring = self.code == POLYGON
        before[first], after[last] = (last, first) if ring else (first, last)
        p = p.keep_vertices((side == 0) | (side != side[before]) | (side != side[after]))
        good = p.lens > 0
        if ring:  # a hole goes when its outer ring goes
            outer = np.maximum.accumulate(np.where(p.hole, 0, np.arange(len(p.hole))))
            good &= good[outer]
        return p.keep_paths(good)

    def drawn(self, pieces: Pieces, box: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Pieces that leave something in their tile, and their command integers."""
        p, across = pieces.paths, 2.0**pieces.z
        owner = np.repeat(p.row, p.lens)
        grid = Paths(p.row, p.hole, p.lens, np.rint((p.px * across - pieces.x[owner]) * self.extent),
                     np.rint((p.py * across - pieces.y[owner]) * self.extent))
        commands = command_lists(self.code, clip_shapes(self.code, grid, self.extent, self.buffer), len(pieces.feature))
        left = np.asarray(commands.is_valid())
        if self.code != POINT:
            u0, v0, u1, v1 = (side[pieces.feature] * across for side in box)
            left = left & ((u1 - u0 >= 0.5 / self.extent) | (v1 - v0 >= 0.5 / self.extent))
        at = np.flatnonzero(left)
        return at, commands.take(pa.array(at))

    def walk(self, start: Pieces, box: np.ndarray, until: int) -> Iterator[Pieces]:
        """All pieces from a start to a zoom, children before the neighbours, so that few are held at once."""
        waiting = list(start.chunks())
        while waiting:
            pieces = waiting.pop()
            yield pieces
            if pieces.z < until and len(pieces.feature):
                waiting.extend(self.children(pieces, box).chunks())


def _boxes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.array([np.asarray(batch.column(n)) for n in names])


def _whole(batch: pa.RecordBatch, srid: int) -> Pieces:
    n = batch.num_rows
    none = np.zeros(n, np.int64)
    return Pieces(0, np.arange(n), none, none, source_paths(batch.column("_parts"), srid))


def _dealt(batch: pa.RecordBatch, zoom: int) -> Pieces:
    """Pieces as they come out of the shuffle."""
    def flat(name: str, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype)

    count = np.array([len(b.as_py()) for b in batch.column("holes")], np.int64)
    paths = Paths(np.repeat(np.arange(len(count)), count), flat("holes", bool), flat("rings", np.int64), flat("us", float), flat("vs", float))
    return Pieces(zoom, np.arange(len(count)), *(np.asarray(batch.column(c), np.int64) for c in ("px", "py")), paths)


def _small(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; a larger row is a batch of its own."""
    for batch in batches:
        each = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, each):
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([c]) for c in batch.slice(at, each).columns], schema=batch.schema)


def tile_shapes(frame: DataFrame, g: GeometryColumn, zooms: list[int], extent: int, buffer: int, keep: list[str],
                wide: bool = False) -> DataFrame:
    """``keep``, ``z, x, y`` and the command integers ``cmds`` of each feature in each tile where something of it is drawn.

    With ``wide`` features that cover more than ``WIDE_COVER`` tiles of the deepest zoom are dealt out in pieces at
    ``SPLIT_ZOOM``, so that no task walks through a continent alone.
    """
    code, srid, top, split = geometry_code(g.kind), g.srid, max(zooms), SPLIT_ZOOM
    box = g.box_names
    source = frame.filter(in_world(g)).select(*keep, *g.box_columns, F.col(g.name)["parts"].alias("_parts"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    kept = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    out_schema = f"{kept}{', ' if keep else ''}z int, x int, y int, cmds array<int>"

    def draw(start, chosen: tuple[int, ...]):
        plan, wanted = Descent(code, chosen, extent, buffer), set(chosen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                sides = _boxes(batch, box)
                for pieces in plan.walk(start(batch), sides, max(chosen)):
                    if pieces.z not in wanted:
                        continue
                    at, commands = plan.drawn(pieces, sides)
                    if len(at):
                        take = pa.array(pieces.feature[at])
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(k).take(take) for k in keep], pa.array(np.full(len(at), pieces.z, np.int32)),
                             pa.array(pieces.x[at].astype(np.int32)), pa.array(pieces.y[at].astype(np.int32)), commands],
                            names=[*keep, "z", "x", "y", "cmds"])

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Descent(code, (), extent, buffer)
        for batch in _small(batches):
            for pieces in plan.walk(_whole(batch, srid), _boxes(batch, box), split):
                if pieces.z < split or not len(pieces.feature):
                    continue
                take = pa.array(pieces.feature)
                ones = [pieces.some(i, i + 1).paths for i in range(len(pieces.feature))]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(take) for k in (*keep, *g.box_columns)], pa.array(pieces.x.astype(np.int32)),
                     pa.array(pieces.y.astype(np.int32)), *[pa.array([one(p) for p in ones], pa.binary()) for one in (
                         lambda p: p.lens.tobytes(), lambda p: p.hole.tobytes(), lambda p: p.px.tobytes(), lambda p: p.py.tobytes())]],
                    names=[*keep, *g.box_columns, "px", "py", "rings", "holes", "us", "vs"])

    def whole(batch: pa.RecordBatch) -> Pieces:
        return _whole(batch, srid)

    def dealt(batch: pa.RecordBatch) -> Pieces:
        return _dealt(batch, split)

    if not wide or top <= split:
        return source.mapInArrow(draw(whole, tuple(zooms)), out_schema)
    x0, x1, y0, y1 = tile_range(g, F.lit(top))
    huge = (x1 - x0 + 1).cast("bigint") * (y1 - y0 + 1) > WIDE_COVER
    out = source.filter(~huge).mapInArrow(draw(whole, tuple(zooms)), out_schema)
    high, deep = (tuple(z for z in zooms if (z <= split) == upper) for upper in (True, False))
    if high:
        out = out.unionByName(source.filter(huge).mapInArrow(draw(whole, high), out_schema))
    boxes = ", ".join(f"`{c}` double" for c in g.box_columns)
    pieces = source.filter(huge).mapInArrow(cut, f"{kept}{', ' if keep else ''}{boxes}, {PIECE}")
    spread = pieces.repartition(F.xxhash64("px", "py", *g.box_columns, F.crc32("rings")))
    return out.unionByName(spread.mapInArrow(draw(dealt, deep), out_schema))
