"""Shared plumbing: chosen columns, tables in the shared folder, batches out of tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.checkpoints import new_folder, stored  # noqa: F401, for the operators


def doc_key(column: Column | str = "doc_id") -> Column:
    """The id as text, as folds are dealt by it; a null id counts as the empty text."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def fold(parts: int) -> Column:
    """Remainder of the crc32 of the id as text."""
    return (F.crc32(doc_key().cast("binary")) % parts).cast("int")


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


def sliced(batch: pa.RecordBatch, most_bytes: int = 1 << 23, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Split a batch so that each piece holds a bounded amount of text; a longer text is a piece of its own."""
    if batch.num_rows == 0:
        return
    each = max(1, int(batch.num_rows * most_bytes / max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def packed(texts: pa.Array) -> pa.Array:
    """Each text as compressed bytes, in which it travels; null stays null."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([None if t is None else press.compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(column: pa.Array) -> list[bytes | None]:
    """The bytes of packed texts."""
    press = zstandard.ZstdDecompressor()
    return [None if t is None else press.decompress(t) for t in column.to_pylist()]


def opened(batch: pa.RecordBatch, most_bytes: int = 1 << 21, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch with its packed texts unpacked, in pieces of a bounded amount of text; a longer text is a piece of its own."""
    press, at = zstandard.ZstdDecompressor(), batch.schema.get_field_index(column)
    held, size, start = [], 0, 0
    for row, text in enumerate(batch.column(at)):
        held.append(press.decompress(text.as_buffer()) if text.is_valid else None)
        size += len(held[-1] or b"")
        if size >= most_bytes or row + 1 == batch.num_rows:
            yield batch.slice(start, len(held)).set_column(at, column, pa.array(held, pa.large_binary()))
            held, size, start = [], 0, row + 1


def packing(frame: DataFrame, column: str = "text") -> DataFrame:
    """``frame`` with a text column packed."""
    at = frame.columns.index(column)

    def pack(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, column=column):
                yield pa.RecordBatch.from_arrays([packed(c) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(pack, kinds)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
