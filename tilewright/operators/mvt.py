"""Vector tile bytes: batch encoder and decoder used inside Spark tasks.

The encoder takes feature rows sorted by tile and writes one row per tile (or
per part of a large tile). It never loops over rows: all tiles of a batch are
encoded together with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tilewright.operators.ragged import Ragged, constant, spans, sums, varint_sizes, varints, weave, zigzag

KEYS = ("tile_no", "bucket")  # what a group of rows has in common; small tiles have no bucket
TILE_FIELDS = [("z", "int"), ("x", "int"), ("y", "int"), ("n_features", "bigint")]
BATCH_ROWS = 20_000
BATCH_BYTES = 8 << 20


def _tag(number: int, wire: int) -> bytes:
    return bytes([number << 3 | wire])


def _sized(number: int, body: Ragged) -> Ragged:
    """A length-delimited field around each byte string."""
    return weave([constant(_tag(number, 2), len(body.lens)), varints(body.lens), body])


def encode_values(column: pa.Array) -> pa.Array:
    """Value messages of the distinct values of one attribute column."""
    t = column.type
    if pa.types.is_boolean(t):
        body = np.asarray(column.cast(pa.int8())).astype(np.uint64)
        msg = weave([constant(_tag(7, 0), len(body)), varints(body)])
    elif pa.types.is_integer(t):
        v = np.asarray(column).astype(np.int64)
        low = v < 0
        kind = Ragged(np.where(low, 6 << 3, 5 << 3).astype(np.uint8), np.ones(len(v), np.int64))
        msg = weave([kind, varints(np.where(low, zigzag(v), v).astype(np.uint64))])
    elif pa.types.is_floating(t):
        wide = t == pa.float64()
        raw = np.ascontiguousarray(np.asarray(column)).astype("<f8" if wide else "<f4").view(np.uint8)
        width = 8 if wide else 4
        msg = weave([constant(_tag(3, 1) if wide else _tag(2, 5), len(column)),
                     Ragged(raw, np.full(len(column), width, np.int64))])
    else:
        msg = _sized(1, Ragged.from_arrow(column.cast(pa.string()).cast(pa.binary())))
    return msg.to_arrow()


def value_codes(table: pa.Table, properties: list[str]) -> tuple[np.ndarray, Ragged]:
    """A code per cell (-1 for NULL) and the Value message behind each code."""
    n = table.num_rows
    cells = np.full((n, len(properties)), -1, np.int64)
    messages, base = [], 0
    for j, name in enumerate(properties):
        column = table.column(name).combine_chunks()
        coded = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        indices = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64)
        cells[:, j] = np.where(indices >= 0, indices + base, -1)
        messages.append(encode_values(coded.dictionary))
        base += len(coded.dictionary)
    if not messages:
        return cells, Ragged(np.empty(0, np.uint8), np.empty(0, np.int64))
    merged = pa.concat_arrays(messages).dictionary_encode()  # equal values of two columns share a code
    recode = np.asarray(merged.indices).astype(np.int64)
    if len(recode):
        cells = np.where(cells >= 0, recode[np.maximum(cells, 0)], -1)
    return cells, Ragged.from_arrow(merged.dictionary)


def tile_address(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, x, y of tile numbers."""
    first = np.array([(4**z - 1) // 3 for z in range(32)], np.uint64).astype(np.int64)
    z = np.searchsorted(first, number, side="right") - 1
    rest = number - first[z]
    return z, rest & ((np.int64(1) << z) - 1), rest >> z


def _present(names) -> list[str]:
    return [k for k in KEYS if k in names]


class Encoded:
    """Dictionary-coded features of several tiles, before value numbers are final."""

    def __init__(self, table: pa.Table, properties: list[str], gtype: int):
        n = table.num_rows
        copies = (np.asarray(table.column("copies")).astype(np.int64) if "copies" in table.column_names
                  else np.ones(n, np.int64))
        keys = [np.asarray(table.column(k)).astype(np.int64) for k in _present(table.column_names)]
        change = np.zeros(n, bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(change)
        self.keys = [k[first] for k in keys]
        tile_of_row = np.cumsum(change) - 1
        n_tiles = len(first)

        cells, messages = value_codes(table, properties)
        row_index, key_index = np.nonzero(cells >= 0)
        code = cells[row_index, key_index]
        width = max(1, len(messages.lens))
        pair, seen = pd.factorize(tile_of_row[row_index] * width + code)
        value_tile = seen // width
        begin = np.searchsorted(value_tile, np.arange(n_tiles))
        value_index = pair - begin[tile_of_row[row_index]]
        self.value_counts = np.bincount(value_tile.astype(np.int64), minlength=n_tiles)
        self.values = _sized(4, messages.take((seen % width).astype(np.int64)))

        words = _geometry_words(table)
        shape = weave([constant(_tag(3, 0) + bytes([gtype]), n), _sized(4, words)])

        # write identical features as often as they occur
        pairs = np.bincount(row_index, minlength=len(copies))
        if (copies != 1).any():
            again = np.repeat(np.arange(len(copies)), copies)
            index = spans((np.cumsum(pairs) - pairs)[again], pairs[again])
            key_index, value_index, pairs = key_index[index], value_index[index], pairs[again]
            shape = shape.take(again)
        self.feature_counts = sums(copies, np.diff(np.append(first, len(copies))))
        self.key_index, self.value_index, self.pairs, self.shape = key_index, value_index, pairs, shape


def _geometry_words(table: pa.Table) -> Ragged:
    """Command integers as varints; points come as their two steps only."""
    if "step_x" in table.column_names:
        words = np.empty((table.num_rows, 3), np.uint32)
        words[:, 0] = 9  # one MoveTo
        words[:, 1], words[:, 2] = np.asarray(table.column("step_x")), np.asarray(table.column("step_y"))
        return varints(words.ravel()).fold(np.full(table.num_rows, 3))
    lists = table.column("cmds").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lens = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    return varints(np.asarray(lists.flatten()).astype(np.uint32)).fold(lens)


def feature_bytes(key_index, value_index, pairs, shape: Ragged) -> Ragged:
    """Complete feature fields of a layer."""
    tags = np.empty(2 * len(key_index), np.uint64)
    tags[0::2], tags[1::2] = key_index, value_index
    packed = varints(tags).fold(2 * pairs)
    some = packed.lens > 0
    mark = Ragged(np.full(int(some.sum()), _tag(2, 2)[0], np.uint8), some.astype(np.int64))
    size = varints(packed.lens)
    if not some.all():
        size = Ragged(size.data[np.repeat(some, size.lens)], size.lens * some)
    return _sized(2, weave([mark, size, packed, shape]))


def layer_fields(name: str, properties: list[str], extent: int) -> tuple[bytes, bytes, bytes]:
    """Constant fields of a layer: name, keys, and extent with version."""
    def sized(number: int, text: str) -> bytes:
        body = text.encode()
        return _tag(number, 2) + varints(np.array([len(body)])).data.tobytes() + body

    tail = _tag(5, 0) + varints(np.array([extent])).data.tobytes() + _tag(15, 0) + b"\x02"
    return sized(1, name), b"".join(sized(3, p) for p in properties), tail


def wrap_layer(body: Ragged) -> Ragged:
    return _sized(3, body)


def encode_tiles(table: pa.Table, name: str, properties: list[str], extent: int, gtype: int) -> pa.RecordBatch:
    e = Encoded(table, properties, gtype)
    n = len(e.feature_counts)
    features = feature_bytes(e.key_index, e.value_index, e.pairs, e.shape).fold(e.feature_counts)
    head, keys, tail = layer_fields(name, properties, extent)
    body = weave([constant(head + keys + tail, n), features, e.values.fold(e.value_counts)])
    return _rows(e, {"tile": wrap_layer(body).to_arrow()})


def encode_parts(table: pa.Table, properties: list[str], gtype: int) -> pa.RecordBatch:
    """Parts of large tiles; value numbers still start at zero in every part."""
    e = Encoded(table, properties, gtype)
    per_part = sums(e.pairs, e.feature_counts)
    keys, shape = _cut(e.key_index, per_part), e.shape.fold(e.feature_counts)
    lens, values = _cut(e.values.lens, e.value_counts), _cut(e.values.data, sums(e.values.lens, e.value_counts))
    packed = {
        "key_index": map(_packed_words, keys),
        "value_index": map(_packed_values, _cut(e.value_index, per_part), keys),
        "pairs": map(_packed_words, _cut(e.pairs, e.feature_counts)),
        "shape_lens": map(_packed_words, _cut(e.shape.lens, e.feature_counts)),
        "shape": map(_packed, _cut(shape.data, shape.lens)),
        "part_values": map(_packed_messages, values, lens),
    }
    cols = {k: pa.array(list(v), pa.binary()) for k, v in packed.items()}
    cols["n_values"] = pa.array(e.value_counts.astype(np.int64))
    return _rows(e, {"bucket": pa.array(e.keys[1]), **cols})


PART_FIELDS = [*TILE_FIELDS, ("bucket", "bigint")] + [(k, "binary") for k in ("key_index", "value_index", "pairs", "shape_lens", "shape",
                                                     "part_values")] + [("n_values", "bigint")]


MESSAGE_BYTES = 32  # value messages up to this length are laid out byte by byte


def _cut(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Runs of ``counts[i]`` neighbours."""
    return np.split(values, np.cumsum(counts)[:-1])


def _packed(body: np.ndarray | bytes, size: int | None = None) -> bytes:
    """Bytes compressed, as parts wait on disk for their numbers; a length goes first, by default their own."""
    held = pa.py_buffer(body if isinstance(body, bytes) else body.tobytes())
    return (held.size if size is None else size).to_bytes(4, "little") + pa.compress(held, codec="zstd", asbytes=True)


def _plain(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:4], "little")
    return pa.decompress(packed[4:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _planes(words: np.ndarray) -> bytes:
    """Numbers of four bytes, all first bytes first: those that are alike then stand together."""
    return words.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packed_words(words: np.ndarray) -> bytes:
    return _packed(_planes(words))


def _words(packed: bytes) -> np.ndarray:
    return _from_planes(_plain(packed))


def _packed_values(values: np.ndarray, keys: np.ndarray) -> bytes:
    """Value numbers key by key. Values are numbered as they first occur, so 0 stands for one that has not, and any other is one higher."""
    most = np.maximum.accumulate(np.append(-1, values))[:-1]
    return _packed_words(np.where(values > most, 0, values + 1)[_by_key(keys)])


def _by_key(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")  # two bytes are sorted by radix


def _value_words(row: dict) -> np.ndarray:
    """Value numbers of one part, from zero, in the order of its features."""
    keys = _words(row["key_index"])
    told = np.empty(len(keys), np.int64)
    told[_by_key(keys)] = _words(row["value_index"])
    return np.where(told == 0, np.cumsum(told == 0) - 1, told - 1)


def _packed_messages(body: np.ndarray, lens: np.ndarray) -> bytes:
    """Messages by length, short ones with all first bytes first, as neighbours differ in few bytes; the length in front is theirs."""
    starts = np.cumsum(lens) - lens
    laid = [len(lens).to_bytes(4, "little"), _planes(lens)]
    for size in np.unique(lens).tolist():
        some = np.flatnonzero(lens == size) if size <= MESSAGE_BYTES else np.flatnonzero(lens > MESSAGE_BYTES)
        if size > MESSAGE_BYTES:
            laid.append(body[spans(starts[some], lens[some])].tobytes())
            break
        laid.append(body[starts[some][:, None] + np.arange(size)].T.tobytes())
    joined = b"".join(laid)
    return len(body).to_bytes(4, "little") + _packed(joined)


def _messages(packed: bytes) -> bytes:
    """The bytes of ``_packed_messages``."""
    laid = _plain(packed[4:])
    count = int.from_bytes(laid[:4], "little")
    lens = _from_planes(laid[4:4 + 4 * count])
    starts, data, at = np.cumsum(lens) - lens, np.frombuffer(laid, np.uint8), 4 + 4 * count
    out = np.empty(int.from_bytes(packed[:4], "little"), np.uint8)
    for size in np.unique(lens).tolist():
        if size > MESSAGE_BYTES:
            some = np.flatnonzero(lens > MESSAGE_BYTES)
            out[spans(starts[some], lens[some])] = data[at:]
            break
        some = np.flatnonzero(lens == size)
        out[starts[some][:, None] + np.arange(size)] = data[at:at + size * len(some)].reshape(size, len(some)).T
        at += size * len(some)
    return out.tobytes()


def finish_part(row: dict) -> bytes:
    """Layer fields of one part, its values numbered from ``value_base``."""
    shape = Ragged(np.frombuffer(_plain(row["shape"]), np.uint8), _words(row["shape_lens"]))
    values = _value_words(row) + row["value_base"]
    features = feature_bytes(_words(row["key_index"]), values, _words(row["pairs"]), shape)
    return features.data.tobytes() + _messages(row["part_values"])


SIZE_FIELDS = ["key_index", "value_index", "pairs", "shape_lens", "part_values", "value_base"]


def finished_size(row: dict) -> int:
    """Length of ``finish_part`` without making it."""
    tags = varint_sizes(_words(row["key_index"])) + varint_sizes(_value_words(row) + row["value_base"])
    packed, shape = sums(tags, _words(row["pairs"])), _words(row["shape_lens"])
    body = np.where(packed > 0, 1 + varint_sizes(packed) + packed, 0) + shape
    return int((1 + varint_sizes(body) + body).sum()) + int.from_bytes(row["part_values"][:4], "little")


def finish_parts(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """``columns`` and the finished bytes ``tile`` of parts, a few megabytes at a time."""
    held, size, start = [], 0, 0
    for at in range(batch.num_rows):
        held.append(finish_part(batch.slice(at, 1).to_pylist()[0]))
        size += len(held[-1])
        if size >= BATCH_BYTES or at + 1 == batch.num_rows:
            small = batch.select(columns).slice(start, len(held))
            yield pa.RecordBatch.from_arrays([*small.columns, pa.array(held, pa.binary())], names=[*columns, "tile"])
            held, size, start = [], 0, at + 1


def join_parts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The finished bytes ``tile`` and the sum of ``n_features`` of each run of blocks that agree in ``columns``, a few megabytes at a time."""
    done: list[tuple] = []
    now, held, features, size = None, [], 0, 0

    def rows() -> pa.RecordBatch:
        cells = [pa.array([r[0][i] for r in done], pa.int32()) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*cells, pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done], pa.binary())],
                                          names=[*columns, "n_features", "tile"])

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            own = tuple(row[c] for c in columns)
            if held and own != now:
                done.append((now, features, b"".join(held)))
                held, features = [], 0
                if size >= BATCH_BYTES:
                    yield rows()
                    done, size = [], 0
            now = own
            held.append(finish_part(row))
            features, size = features + row["n_features"], size + len(held[-1])
    if held:
        done.append((now, features, b"".join(held)))
    if done:
        yield rows()


def _rows(e: Encoded, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    z, x, y = tile_address(e.keys[0])
    base = {"z": pa.array(z.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "y": pa.array(y.astype(np.int32)),
            "n_features": pa.array(e.feature_counts.astype(np.int64))}
    return pa.RecordBatch.from_pydict({**base, **columns})


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no tile (or part) is cut between two tables."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < BATCH_ROWS and size < BATCH_BYTES:
            continue
        cut = _last_group_start(batch)
        if cut is None:
            if len(held) == 1 or _same_group(held[-2], batch):
                continue  # one group fills everything held since its start
            cut = 0
        done = [*held[:-1], batch.slice(0, cut)] if cut else held[:-1]
        yield pa.Table.from_batches(done)
        held = [batch.slice(cut)]
        rows, size = held[0].num_rows, held[0].nbytes
    if held:
        yield pa.Table.from_batches(held)


def _last_group_start(batch: pa.RecordBatch) -> int | None:
    change = np.zeros(batch.num_rows, bool)
    for k in _present(batch.schema.names):
        values = np.asarray(batch.column(k))
        change[1:] |= values[1:] != values[:-1]
    at = np.flatnonzero(change)
    return int(at[-1]) if len(at) else None


def _same_group(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(k)[-1].as_py() == b.column(k)[0].as_py() for k in _present(a.schema.names))


def opening(sizes: pa.Array, fixed: bytes) -> pa.Array:
    """First part of large tiles: layer header announcing the length of all parts."""
    n = len(sizes)
    total = varints(np.asarray(sizes).astype(np.int64) + len(fixed))
    return weave([constant(_tag(3, 2), n), total, constant(fixed, n)]).to_arrow()
