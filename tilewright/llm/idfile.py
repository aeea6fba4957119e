"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Ids are numbered by falling frequency, so the commonest 256 take one byte. Two control bits hold the length of each
value, four values to a control byte. Decoding looks lengths and masks up in tables and gathers all values of a block at
once. A file is Parquet with a row for each block of documents, as executors reach a shared store through Spark alone;
a shard is what one task wrote, and shards, blocks and documents ascend by ``doc_id``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.frames import new_folder, sliced, stored
from tilewright.llm.tokens import END_ID, encoder, tokenizer_path
from tilewright.llm.words import chunks

BLOCK_TOKENS = 1 << 17
_LENGTHS = np.array([[(c >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for c in range(256)], np.int64)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = length - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    start = np.cumsum(length) - length
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    value = raw[start] | raw[start + 1] << 8 | raw[start + 2] << 16 | raw[start + 3] << 24 if count else raw[:0]
    return value & _MASKS[length]


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text) and the ids (``n``, ``control``, ``data``, with the end id) of each row."""
    path = tokenizer or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])

    def encode(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in read:
            for part in sliced(batch):
                sizes, packed = [], []
                for _, data, where in chunks(part.column("text")):
                    found, bounds = encoder(path).encode(data, where)
                    sizes += (np.diff(bounds) + 1).tolist()
                    packed += [pack_numbers(np.concatenate([found[a:b], end])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("tie"), pa.array(sizes, pa.int64()),
                    pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) tie", "cast(text as string) text").mapInArrow(
        encode, "doc_id long, tie long, n long, control binary, data binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, control, data in zip(*(batch.column(c) for c in ("n", "control", "data")), strict=True):
        yield unpack_numbers(control.as_py(), data.as_py(), n.as_py())


def id_ranks(ids: DataFrame) -> np.ndarray:
    """Ids by falling frequency. There are no more of them than the tokenizer has."""

    def count(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in read:
            for row in _unpacked(batch):
                own = np.bincount(row)
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]})

    rows = (ids.select("n", "control", "data").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "id").collect())
    return np.array([r.id for r in rows], np.uint32)


def write_token_file(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID,
                     block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of all ``docs`` (``doc_id``, ``text``) below ``folder`` as ``blocks`` and ``ranks``.

    Null and empty texts are the end id alone; null ids come first; repeated rows are written as often as they stand
    there; other columns are left out; an empty table writes no blocks. A document is never split over blocks.
    """
    spark = docs.sparkSession
    ids = stored(token_ids(docs, tokenizer, end_id), "ids")
    ranks = id_ranks(ids)
    spark.createDataFrame([(i, int(v)) for i, v in enumerate(ranks)], "rank int, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])

    def write(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def block() -> pa.RecordBatch:
            lengths = [len(h) for h in held]
            control, data = pack_numbers(rank_of[np.concatenate(held)])
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, [
                [v] for v in (shard, number, first, names, lengths, sum(lengths), control, data)], strict=True)), schema=schema)

        tokens = 0
        for batch in read:
            for doc, one in zip(batch.column("doc_id").to_pylist(), _unpacked(batch), strict=True):
                if held and tokens + len(one) > block_tokens:
                    yield block()
                    number, first, held, names, tokens = number + 1, first + tokens, [], [], 0
                held.append(one)
                names.append(doc)
                tokens += len(one)
        if held:
            yield block()

    (ids.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
     .mapInArrow(write, "shard int, block int, first long, doc_ids array<long>, lengths array<long>, n_tokens long, "
                        "control binary, data binary").write.parquet(f"{folder}/blocks"))


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (binary) of each document, decoded."""
    return _read(spark, folder, "ids binary", pa.field("ids", pa.binary()), lambda b: b)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the decoded ids."""
    return _read(spark, folder, "ids_crc32 long", pa.field("ids_crc32", pa.int64()), zlib.crc32)


def _read(spark: SparkSession, folder: str, column: str, field: pa.Field, of) -> DataFrame:
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # no more than the tokenizer has
    id_of = np.array([r.id for r in ranks], "<u4")
    blocks = spark.read.parquet(f"{folder}/blocks")
    starts, total = {}, 0
    for row in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # one row per task
        starts[row.shard] = total
        total += row.n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), field])

    def read_block(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = id_of[unpack_numbers(row["control"], row["data"], row["n_tokens"])]
                ends = np.cumsum(row["lengths"])
                begin = ends - np.array(row["lengths"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(begin + starts[row["shard"]] + row["first"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([of(ids[a:b].tobytes()) for a, b in zip(begin, ends, strict=True)], field.type)], schema=schema)

    return blocks.mapInArrow(read_block, f"doc_id long, start long, n_tokens long, {column}")


def token_file(docs: DataFrame, **how) -> str:
    """Write ``docs`` to a new folder below the shared one; gives the folder."""
    folder = new_folder(docs, "token-file")
    write_token_file(docs, folder, **how)
    return folder
