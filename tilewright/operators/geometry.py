"""Geometry to tile commands: project, snap to the tile grid, clip, encode.

Points need no Python: :func:`point_steps` gives Columns. Everything else runs
through one Arrow function that works on whole record batches with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import tilemath as tm
from tilewright.operators.ragged import spans, sums, zigzag

# fixed values: geometry types and commands of the vector tile format
POINT, LINE, POLYGON = 1, 2, 3
MOVE_TO, LINE_TO, CLOSE = 1, 2, 7


def geometry_code(kind: str) -> int:
    return POINT if kind.endswith("POINT") else LINE if kind.endswith("LINESTRING") else POLYGON


def point_steps(u: Column, v: Column, z: Column, x: Column, y: Column, extent: int, margin: int | None
                ) -> tuple[Column, Column, Column]:
    """The two zigzag steps that move to a point, and whether it is inside the clip box."""
    qx, qy = tm.tile_pixel(u, z, x, extent), tm.tile_pixel(v, z, y, extent)

    def fold(q):
        return F.when(q >= 0, q * 2).otherwise(-q * 2 - 1)

    inside = F.lit(True)
    if margin is not None:
        inside = qx.between(-margin, extent + margin) & qy.between(-margin, extent + margin)
    return fold(qx), fold(qy), inside


def shape_commands(parts: Column, srid: int, code: int, z: Column, x: Column, y: Column,
                   extent: int, margin: int | None) -> Column:
    """Command integers of any geometry, NULL when nothing is left of it."""

    @F.arrow_udf("array<int>")
    def encode(p: pa.Array, tz: pa.Array, tx: pa.Array, ty: pa.Array) -> pa.Array:
        return batch_commands(p, srid, code, *[np.asarray(a) for a in (tz, tx, ty)], extent, margin)

    # not pushed into filters, where it would run a second time
    return encode.asNondeterministic()(parts, z, x, y)


class Paths:
    """Vertex chains of many rows: points, lines or open rings."""

    __slots__ = ("row", "hole", "lens", "px", "py")

    def __init__(self, row, hole, lens, px, py):
        self.row, self.hole, self.lens, self.px, self.py = row, hole, lens, px, py

    @property
    def starts(self):
        return np.cumsum(self.lens) - self.lens

    def path_of_vertex(self):
        return np.repeat(np.arange(len(self.lens)), self.lens)

    def keep_vertices(self, mask) -> Paths:
        return Paths(self.row, self.hole, sums(mask.astype(np.int64), self.lens), self.px[mask], self.py[mask])

    def keep_paths(self, mask) -> Paths:
        vertex = np.repeat(mask, self.lens)
        return Paths(self.row[mask], self.hole[mask], self.lens[mask], self.px[vertex], self.py[vertex])

    def previous(self):
        """Index of the vertex before, going round within each path."""
        index = np.arange(len(self.px)) - 1
        some = self.lens > 0
        index[self.starts[some]] = (self.starts + self.lens - 1)[some]
        return index


def source_paths(parts: pa.ListArray, srid: int) -> Paths:
    """Vertex chains of a column of geometries in unit coordinates."""
    n = len(parts)
    rings, chains = parts.values, parts.values.values
    to_ring, to_chain, to_vertex = (np.asarray(a.offsets) for a in (parts, rings, chains))
    part_count = np.diff(to_ring)
    part_ids = np.arange(to_ring[0], to_ring[-1])
    ring_count = to_chain[part_ids + 1] - to_chain[part_ids] if len(part_ids) else np.empty(0, np.int64)
    first, last = int(to_chain[to_ring[0]]), int(to_chain[to_ring[-1]])
    lens = np.diff(to_vertex[first:last + 1]).astype(np.int64)
    part_row = np.repeat(np.arange(n), part_count)
    row = np.repeat(part_row, ring_count)
    hole = spans(np.zeros(len(ring_count), np.int64), ring_count) > 0
    lo, hi = int(to_vertex[first]), int(to_vertex[last])
    vx = np.asarray(chains.values.field("x"))[lo:hi]
    vy = np.asarray(chains.values.field("y"))[lo:hi]
    return Paths(row, hole, lens, *unit_position(vx, vy, srid))


def clip_shapes(code: int, paths: Paths, extent: int, margin: int | None) -> Paths:
    box = None if margin is None else (-float(margin), float(extent + margin))
    return {POINT: clip_points, LINE: clip_lines, POLYGON: clip_polygons}[code](paths, box)


def batch_commands(parts: pa.ListArray, srid: int, code: int, z, x, y, extent: int, margin: int | None) -> pa.Array:
    p = source_paths(parts, srid)
    at = np.repeat(p.row, p.lens)
    across = np.exp2(z[at].astype(np.float64))
    grid = Paths(p.row, p.hole, p.lens, np.rint((p.px * across - x[at]) * extent), np.rint((p.py * across - y[at]) * extent))
    return command_lists(code, clip_shapes(code, grid, extent, margin), len(parts))


def unit_position(vx, vy, srid: int):
    if srid == 3857:
        return vx / (2.0 * tm.WORLD) + 0.5, 0.5 - vy / (2.0 * tm.WORLD)
    phi = np.minimum(np.abs(vy), 90.0) * (np.pi / 180.0)
    return (vx + 180.0) / 360.0, (1.0 - np.sign(vy) * np.log(np.tan(phi) + 1.0 / np.cos(phi)) / np.pi) / 2.0


def clip_points(p: Paths, box):
    if box is not None:
        low, high = box
        p = p.keep_vertices((p.px >= low) & (p.px <= high) & (p.py >= low) & (p.py <= high))
    # one command block per row: all points of a row form one path
    row, count = np.unique(np.repeat(p.row, p.lens), return_counts=True)
    return Paths(row, np.zeros(len(row), bool), count, p.px, p.py)


def drop_repeats(p: Paths, ring: bool) -> Paths:
    if not len(p.px):
        return p
    prev = p.previous()
    same = (p.px == p.px[prev]) & (p.py == p.py[prev])
    if not ring:
        same[p.starts[p.lens > 0]] = False
    else:
        same[p.starts[p.lens == 1]] = False
    return p.keep_vertices(~same)


def clip_lines(p: Paths, box):
    p = drop_repeats(p, ring=False)
    if box is not None and len(p.px):
        low, high = box
        inside = (p.px >= low) & (p.px <= high) & (p.py >= low) & (p.py <= high)
        cut = sums((~inside).astype(np.int64), p.lens) > 0
        if cut.any():
            whole, crossing = p.keep_paths(~cut), cut_lines(p.keep_paths(cut), low, high)
            row = np.concatenate((whole.row, crossing.row))
            p = take_paths(
                Paths(row, np.zeros(len(row), bool), np.concatenate((whole.lens, crossing.lens)),
                      np.concatenate((whole.px, crossing.px)), np.concatenate((whole.py, crossing.py))),
                np.argsort(row, kind="stable"))
    return p.keep_paths(p.lens >= 2)


def take_paths(p: Paths, order) -> Paths:
    index = spans(p.starts[order], p.lens[order])
    return Paths(p.row[order], p.hole[order], p.lens[order], p.px[index], p.py[index])


def cut_lines(p: Paths, low: float, high: float) -> Paths:
    """The pieces of each line inside the box, as separate paths."""
    owner = p.path_of_vertex()
    seg = np.flatnonzero(owner[1:] == owner[:-1])
    ax, ay, bx, by = p.px[seg], p.py[seg], p.px[seg + 1], p.py[seg + 1]
    dx, dy = bx - ax, by - ay
    enter, leave = np.zeros(len(seg)), np.ones(len(seg))
    ok = np.ones(len(seg), bool)
    for step, gap in ((-dx, ax - low), (dx, high - ax), (-dy, ay - low), (dy, high - ay)):
        flat = step == 0
        ok &= ~(flat & (gap < 0))
        t = gap / np.where(flat, 1.0, step)
        enter = np.where(step < 0, np.maximum(enter, t), enter)
        leave = np.where(step > 0, np.minimum(leave, t), leave)
    ok &= enter <= leave
    new = np.ones(len(seg), bool)
    if len(seg) > 1:
        follows = (owner[seg[1:]] == owner[seg[:-1]]) & ok[:-1] & (leave[:-1] >= 1.0) & (enter[1:] <= 0.0)
        new[1:] = ~follows
    seg, ax, ay, dx, dy = seg[ok], ax[ok], ay[ok], dx[ok], dy[ok]
    enter, leave, new = enter[ok], leave[ok], new[ok]
    piece = np.cumsum(new) - 1
    count = np.bincount(piece) + 1 if len(piece) else np.empty(0, np.int64)
    size = int(count.sum())
    px, py = np.empty(size), np.empty(size)
    at = np.arange(len(seg)) + piece  # a piece of k segments has k + 1 vertices
    px[at + 1], py[at + 1] = np.rint(ax + leave * dx), np.rint(ay + leave * dy)
    px[at[new]] = np.rint(ax + enter * dx)[new]
    py[at[new]] = np.rint(ay + enter * dy)[new]
    row = p.row[owner[seg[new]]]
    return drop_repeats(Paths(row, np.zeros(len(row), bool), count.astype(np.int64), px, py), ring=False)


def clip_polygons(p: Paths, box):
    p = drop_repeats(p, ring=True)
    if box is not None and len(p.px):
        low, high = box
        for axis, bound, sign in ((0, low, 1.0), (0, high, -1.0), (1, low, 1.0), (1, high, -1.0)):
            p = cut_rings(p, axis, bound, sign)
        p.px, p.py = np.rint(p.px), np.rint(p.py)
        p = straighten(drop_repeats(p, ring=True), low, high)
    area = ring_area(p)
    good = (p.lens >= 3) & (area != 0)
    # a hole goes when its outer ring goes
    outer = np.maximum.accumulate(np.where(p.hole, -1, np.arange(len(p.hole)))) if len(p.hole) else p.hole
    good &= good[outer] if len(p.hole) else good
    area, p = area[good], p.keep_paths(good)
    flip = (area > 0) == p.hole
    starts, lens = p.starts, p.lens
    place = spans(np.zeros(len(lens), np.int64), lens)
    back = np.repeat(flip, lens)
    index = np.repeat(starts, lens) + np.where(back, np.repeat(lens, lens) - 1 - place, place)
    return from_lowest(Paths(p.row, p.hole, lens, p.px[index], p.py[index]))


def straighten(p: Paths, low: float, high: float) -> Paths:
    """Rings without vertices in the middle of an edge of the box, and so without spikes along it."""
    while len(p.px):
        before, middle = p.previous(), np.zeros(len(p.px), bool)
        after = np.empty(len(p.px), np.int64)
        after[before] = np.arange(len(p.px))
        for along in (p.px, p.py):
            for edge in (low, high):
                on = along == edge
                middle |= on & on[before] & on[after]
        if not middle.any():
            break
        p = drop_repeats(p.keep_vertices(~middle), ring=True)
    return p


def from_lowest(p: Paths) -> Paths:
    """Rings from their lowest vertex on, so that a ring does not depend on where it was opened."""
    if not len(p.px):
        return p
    ring, follows = p.path_of_vertex(), np.empty(len(p.px), np.int64)
    follows[p.previous()] = np.arange(len(p.px))
    order = np.lexsort((p.py[follows], p.px[follows], p.py, p.px, ring))
    lowest = order[p.starts] - p.starts
    place = spans(np.zeros(len(p.lens), np.int64), p.lens)
    index = p.starts[ring] + (place + lowest[ring]) % p.lens[ring]
    return Paths(p.row, p.hole, p.lens, p.px[index], p.py[index])


def ring_area(p: Paths):
    if not len(p.px):
        return np.zeros(len(p.lens))
    prev = p.previous()
    return sums_float(p.px[prev] * p.py - p.px * p.py[prev], p.lens)


def sums_float(values, counts):
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def cut_rings(p: Paths, axis: int, bound: float, sign: float) -> Paths:
    """Keep the side of each ring where ``sign * (coordinate - bound) >= 0``."""
    if not len(p.px):
        return p
    prev = p.previous()
    along = p.px if axis == 0 else p.py
    dist = sign * (along - bound)
    inside = dist >= 0
    if inside.all():
        return p
    cross = inside != inside[prev]
    gap = dist[prev] - dist
    t = np.where(cross, dist[prev] / np.where(gap == 0, 1.0, gap), 0.0)
    ix = p.px[prev] + t * (p.px - p.px[prev])
    iy = p.py[prev] + t * (p.py - p.py[prev])
    if axis == 0:
        ix = np.where(cross, bound, ix)
    else:
        iy = np.where(cross, bound, iy)
    count = cross.astype(np.int64) + inside
    at = np.cumsum(count) - count
    px, py = np.empty(int(count.sum())), np.empty(int(count.sum()))
    px[at[cross]], py[at[cross]] = ix[cross], iy[cross]
    own = at + cross
    px[own[inside]], py[own[inside]] = p.px[inside], p.py[inside]
    return Paths(p.row, p.hole, sums(count, p.lens), px, py)


def command_lists(code: int, p: Paths, n: int) -> pa.Array:
    """One list of command integers per row, NULL for rows without a path."""
    closed = code == POLYGON
    size = (1 if code == POINT else 2 + closed) + 2 * p.lens
    out = np.zeros(int(size.sum()), np.int64)
    base = np.cumsum(size) - size
    dx, dy = deltas(p)
    place = spans(np.zeros(len(p.lens), np.int64), p.lens)
    at = np.repeat(base, p.lens) + 1 + 2 * place
    if code != POINT:
        at += place > 0  # the LineTo command stands before the second vertex
        out[base + 3] = LINE_TO | (p.lens - 1) << 3
    out[at], out[at + 1] = zigzag(dx), zigzag(dy)
    out[base] = MOVE_TO | np.where(code == POINT, p.lens, 1) << 3
    if closed:
        out[base + size - 1] = CLOSE | 1 << 3
    count = np.bincount(np.repeat(p.row, size), minlength=n)
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.astype(np.int32)), mask=pa.array(count == 0))


def deltas(p: Paths):
    """Steps from vertex to vertex; the cursor starts at 0,0 for each row."""
    owner = np.repeat(p.row, p.lens)
    fresh = np.ones(len(owner), bool)
    if len(owner) > 1:
        fresh[1:] = owner[1:] != owner[:-1]
    px, py = p.px.astype(np.int64), p.py.astype(np.int64)
    return (px - np.where(fresh, 0, np.concatenate(([0], px[:-1]))) if len(px) else px,
            py - np.where(fresh, 0, np.concatenate(([0], py[:-1]))) if len(py) else py)
