"""Batch decoder of vector tiles, used inside Spark tasks.

One pass finds the layers, features and values of all tiles of a record batch;
their contents are then read together with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tilewright.operators.ragged import Ragged, read_varints, spans, sums, unzigzag

OPENING = 0x1A  # first byte of a tile; later parts of a large tile start with a feature or value field
CHUNK_BYTES = 2 << 20
PLACE = ("z", "x", "y", "part")


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch of tiles so that each piece holds a bounded number of bytes."""
    sizes = np.asarray(pc.binary_length(batch.column("tile")).fill_null(0)).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    edges = np.flatnonzero(np.diff(group)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if high > low:
            yield batch.slice(low, high - low)


class Tiles:
    """Layers of a batch of tiles and where their features and values lie."""

    def __init__(self, batch: pa.RecordBatch):
        tiles = Ragged.from_arrow(batch.column("tile").fill_null(b""))
        self.batch = batch
        raw = tiles.data.tobytes()
        self.data = np.concatenate((tiles.data, np.zeros(10, np.uint8)))
        named, names = batch.column("layer"), batch.column("keys")
        self.row, self.name, self.version, self.extent, self.keys, self.known = [], [], [], [], [], []
        self.feature_at, self.feature_end, self.feature_layer = [], [], []
        self.value_at, self.value_end, self.value_layer = [], [], []
        end = 0
        for row, size in enumerate(tiles.lens.tolist()):
            start, end = end, end + size
            if not size:
                continue
            if raw[start] != OPENING:
                self._layer(raw, start, end, row, named[row].as_py(), names[row].as_py())
                continue
            at = start
            while at < end:
                tag, at = raw[at], at + 1
                size_, at = _varint(raw, at)
                stop = min(at + size_, end)  # the opening part announces more than it holds
                if tag == OPENING:
                    self._layer(raw, at, stop, row, None, None)
                at = stop

    def _layer(self, raw: bytes, at: int, end: int, row: int, name: str | None,
               told: list[str] | None) -> None:
        index, known, keys, version, extent = len(self.row), told is None, list(told or []), 1, 4096
        while at < end:
            tag, at = raw[at], at + 1
            value, at = _varint(raw, at)
            if tag & 7 == 0:
                if tag == 0x28:
                    extent = value
                elif tag == 0x78:
                    version = value
                continue
            if tag == 0x12:
                self.feature_at.append(at)
                self.feature_end.append(at + value)
                self.feature_layer.append(index)
            elif tag == 0x22:
                self.value_at.append(at)
                self.value_end.append(at + value)
                self.value_layer.append(index)
            elif tag == 0x1A:
                keys.append(raw[at:at + value].decode())
            elif tag == 0x0A:
                name = raw[at:at + value].decode()
            at += value
        for column, item in ((self.row, row), (self.name, name), (self.version, version if known else None),
                             (self.extent, extent if known else None), (self.keys, keys), (self.known, known)):
            column.append(item)

    def place(self, layers: np.ndarray) -> dict[str, pa.Array]:
        rows = pa.array(np.asarray(self.row, np.int64)[layers])
        out = {c: self.batch.column(c).take(rows) for c in PLACE}
        out["layer"] = pa.array(self.name, pa.string()).take(pa.array(layers))
        return out

    def ordinals(self) -> np.ndarray:
        layer = np.asarray(self.feature_layer, np.int64)
        first = np.searchsorted(layer, layer)
        return np.arange(len(layer)) - first


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = raw[at]
    at += 1
    if out < 128:
        return out, at
    out &= 127
    shift = 7
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def varints_at(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and width of the varint at each position."""
    window = data[at[:, None] + np.arange(10)]
    width = np.argmax(window < 128, axis=1) + 1
    bits = (window & 127).astype(np.uint64) << (np.arange(10, dtype=np.uint64) * np.uint64(7))
    bits[np.arange(10) >= width[:, None]] = 0
    return bits.sum(axis=1, dtype=np.uint64), width


class Features:
    """Types and the byte spans of tags and geometry of chosen features."""

    def __init__(self, tiles: Tiles, chosen: np.ndarray):
        data, n = tiles.data, len(chosen)
        at = np.asarray(tiles.feature_at, np.int64)[chosen]
        end = np.asarray(tiles.feature_end, np.int64)[chosen]
        self.type = np.zeros(n, np.int64)
        self.tags_at, self.tags_len = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.shape_at, self.shape_len = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = np.flatnonzero(at < end)
        while len(active):
            tag = data[at[active]]
            value, width = varints_at(data, at[active] + 1)
            value = value.astype(np.int64)
            body = at[active] + 1 + width
            number, wire = tag >> 3, tag & 7
            self.type[active[number == 3]] = value[number == 3]
            for field, start, size in ((2, self.tags_at, self.tags_len), (4, self.shape_at, self.shape_len)):
                mine = (number == field) & (wire == 2)
                start[active[mine]], size[active[mine]] = body[mine], value[mine]
            at[active] = np.where(wire == 2, body + value, body)
            active = active[at[active] < end[active]]


def layer_rows(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """One row per layer and geometry type with its number of features, and one row per tile with its bytes."""
    tiles = Tiles(batch)
    layer = np.asarray(tiles.feature_layer, np.int64)
    kind = Features(tiles, np.arange(len(layer))).type
    pairs, count = np.unique(np.stack((layer, kind)), axis=1, return_counts=True) if len(layer) else (
        np.empty((2, 0), np.int64), np.empty(0, np.int64))
    empty = np.setdiff1d(np.arange(len(tiles.row)), layer)
    index = np.concatenate((pairs[0], empty))
    take = pa.array(index)
    columns = tiles.place(index)
    columns["version"] = pa.array(tiles.version, pa.int32()).take(take)
    columns["extent"] = pa.array(tiles.extent, pa.int32()).take(take)
    columns["type"] = pa.concat_arrays([pa.array(pairs[1].astype(np.int32)), pa.nulls(len(empty), pa.int32())])
    columns["n"] = pa.array(np.concatenate((count, np.zeros(len(empty), np.int64))))
    columns["bytes"] = pa.nulls(len(index), pa.int64())
    sizes = pc.binary_length(batch.column("tile")).fill_null(0)
    own = {c: batch.column(c) for c in PLACE} | {"bytes": sizes}
    columns = {f.name: pa.concat_arrays([columns[f.name].cast(f.type), own[f.name].cast(f.type) if f.name in own
                                         else pa.nulls(batch.num_rows, f.type)]) for f in schema}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def feature_rows(batch: pa.RecordBatch, limit: int | None, schema: pa.Schema) -> pa.RecordBatch:
    """One row per feature; ``limit`` keeps the first features of every layer."""
    tiles = Tiles(batch)
    ordinal = tiles.ordinals()
    layer = np.asarray(tiles.feature_layer, np.int64)
    known = np.asarray(tiles.known, bool)
    every = Features(tiles, np.arange(len(layer)))
    key, value, count = _tags(tiles, every, layer, known)
    kept = np.arange(len(layer)) if limit is None else np.flatnonzero(ordinal < limit)
    if limit is not None:
        index = spans((np.cumsum(count) - count)[kept], count[kept])
        key, value, count = key[index], value[index], count[kept]
    columns = tiles.place(layer[kept])
    columns["ordinal"] = pa.array(ordinal[kept])
    columns["type"] = pa.array(every.type[kept])
    texts = value_texts(tiles).take(pa.array(value))
    first_key = np.cumsum([0, *[len(k) for k in tiles.keys]])[:-1].astype(np.int64)
    names = pa.array([k for keys in tiles.keys for k in keys], pa.string())
    key_at = first_key[np.repeat(layer[kept], count)] + key
    columns["properties"] = pa.MapArray.from_arrays(_offsets(count), names.take(pa.array(key_at)), texts)
    columns["paths"] = paths(tiles.data, every.shape_at[kept], every.shape_len[kept])
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def _tags(tiles: Tiles, f: Features, layer: np.ndarray, known: np.ndarray):
    """Key number, value position and number of tags per feature."""
    body = tiles.data[spans(f.tags_at, f.tags_len)]
    words = read_varints(body).astype(np.int64)
    count = sums((body < 128).astype(np.int64), f.tags_len) // 2
    key, value = words[0::2], words[1::2]
    pair_layer = np.repeat(layer, count)
    base = np.zeros(len(tiles.row), np.int64)
    if len(known) and not known.all():
        # values of a later part are numbered on from the parts before it; its first value is the lowest it uses
        lowest = np.full(len(base), np.iinfo(np.int64).max)
        np.minimum.at(lowest, pair_layer, value)
        base = np.where(known | (lowest == np.iinfo(np.int64).max), 0, lowest)
    first = np.searchsorted(np.asarray(tiles.value_layer, np.int64), np.arange(len(tiles.row)))
    return key, first[pair_layer] + value - base[pair_layer], count


def value_texts(tiles: Tiles) -> pa.Array:
    """All attribute values as text."""
    at = np.asarray(tiles.value_at, np.int64)
    if not len(at):
        return pa.array([], pa.string())
    data = tiles.data
    number = data[at] >> 3
    value, width = varints_at(data, at + 1)
    out = np.full(len(at), None, object)
    text = number == 1
    lens = value[text].astype(np.int64)
    body = Ragged(data[spans((at + 1 + width)[text], lens)], lens).to_arrow().cast(pa.string())
    out[text] = body.to_numpy(zero_copy_only=False)
    for field, size, kind in ((2, 4, "<f4"), (3, 8, "<f8")):
        mine = np.flatnonzero(number == field)
        if len(mine):
            real = np.ascontiguousarray(data[(at[mine] + 1)[:, None] + np.arange(size)]).view(kind).ravel()
            out[mine] = [repr(v) for v in real.astype(float).tolist()]
    for field in (4, 5, 6):
        mine = number == field
        whole = value[mine] if field == 5 else value[mine].astype(np.int64)
        out[mine] = [str(v) for v in (unzigzag(whole) if field == 6 else whole).tolist()]
    flag = number == 7
    out[flag] = np.where(value[flag] != 0, "true", "false")
    return pa.array(out, pa.string())


def paths(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Vertex lists of each feature; a closed ring repeats its first vertex."""
    body = data[spans(at, size)]
    words = read_varints(body).astype(np.int64)
    count = sums((body < 128).astype(np.int64), size)
    end = np.cumsum(count)
    cursor = end - count
    found = []
    active = np.flatnonzero(cursor < end)
    while len(active):  # one command of every feature at a time
        here = cursor[active]
        command, times = words[here] & 7, words[here] >> 3
        found.append(np.stack((active, here, command, times)))
        cursor[active] = here + 1 + np.where(command == 7, 0, 2 * times)
        active = active[cursor[active] < end[active]]
    feature, here, command, times = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
    order = np.argsort(here, kind="stable")
    feature, here, command, times = feature[order], here[order], command[order], times[order]
    vertices = np.where(command == 7, 1, times)
    owner = np.repeat(feature, vertices)
    kind = np.repeat(command, vertices)
    nth = spans(np.zeros(len(vertices), np.int64), vertices)
    word = np.where(kind == 7, 0, np.repeat(here, vertices) + 1 + 2 * nth)
    moves = kind != 7
    xy = []
    for side in (0, 1):
        step = np.where(moves, unzigzag(words[np.minimum(word + side, max(len(words) - 1, 0))]), 0) if len(words) else word
        total = np.cumsum(step)
        first = np.searchsorted(owner, owner)
        xy.append(total - (total - step)[first] if len(total) else total)
    opens = np.flatnonzero(kind == 1)
    path = np.cumsum(kind == 1) - 1
    closing = np.flatnonzero(kind == 7)
    for c in xy:
        c[closing] = c[opens[path[closing]]]
    per_path = np.bincount(path, minlength=len(opens)) if len(path) else np.empty(0, np.int64)
    per_feature = np.bincount(owner[opens], minlength=len(at)) if len(at) else np.empty(0, np.int64)
    points = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in xy], ["x", "y"])
    return pa.ListArray.from_arrays(_offsets(per_feature), pa.ListArray.from_arrays(_offsets(per_path), points))
