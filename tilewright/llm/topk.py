"""Exact top-k search by inner product with a pivot table.

``2 q.v = |q|^2 + |v|^2 - d(q, v)^2``, and by the triangle inequality ``d(q, v)`` is at least the difference of their distances to
any pivot. Distances to the pivots are computed once for each block of vectors; the greatest difference over the pivots
bounds each score from above. Candidates are evaluated in the order of their bounds, until no bound reaches the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.frames import stored

SCALE = 1024
TOP = 10
PIVOTS = 32
QUERY_BLOCK = 1024  # queries that meet a block of candidates at once
BLOCK = 4096  # candidates
LANES = 64  # shares of the candidates
STEP = 512  # candidates evaluated between two looks at the bounds


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``dim`` and ``vector`` (array of long) of each usable row."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
            .select(F.col("vec_id").cast("long"), F.size("x").alias("dim"),
                    F.transform("x", lambda c: F.floor(c * scale)).alias("vector")))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of ``vec_id``, ``dim``, ``vector`` as matrices: ``block``, ``dim``, ``ids``, ``matrix``."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])

    def gather(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, parts = held.pop(dim)
            number += 1
            return pa.RecordBatch.from_pydict({"block": [number], "dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "matrix": [
                np.array(parts, np.int64).tobytes()]}, schema=schema)

        for batch in read:
            for vec, dim, vector in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "vector")), strict=True):
                ids, parts = held.setdefault(dim, ([], []))
                ids.append(vec)
                parts.append(vector)
                if len(ids) == size:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(gather, "block long, dim int, ids binary, matrix binary")


def best_of(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, top: int,
            pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (its number, ids, scores) its ``top`` best of a block, ties to the smaller id."""
    if not len(ids):
        return
    at = np.random.default_rng(len(ids)).permutation(len(ids))[:pivots]
    points = matrix[at].astype(float)
    of = np.sqrt(np.maximum(0, ((matrix ** 2).sum(1)[:, None] + (points ** 2).sum(1) - 2 * (matrix.astype(float) @ points.T))))
    to = np.sqrt(np.maximum(0, ((queries ** 2).sum(1)[:, None] + (points ** 2).sum(1) - 2 * (queries.astype(float) @ points.T))))
    norms, own_norms = (matrix ** 2).sum(1), (queries ** 2).sum(1)
    for q in range(len(query_ids)):
        gap = np.zeros(len(ids))
        for p in range(of.shape[1]):
            np.maximum(gap, np.abs(of[:, p] - to[q, p]), out=gap)
        bound = (norms + own_norms[q] - np.maximum(0, gap - 1e-3) ** 2) / 2 + 1  # a margin for rounding
        order = np.argsort(-bound, kind="stable")
        order = order[ids[order] != query_ids[q]]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(order), STEP):
            if len(found) == top and bound[order[start]] < scores[-1]:
                break
            some = order[start:start + STEP]
            found = np.concatenate([found, ids[some]])
            scores = np.concatenate([scores, matrix[some] @ queries[q]])
            best = np.lexsort((found, -scores))[:top]
            found, scores = found[best], scores[best]
        yield np.full(len(found), query_ids[q]), found, scores


def top_scores(vectors: DataFrame, queries: DataFrame, top: int = TOP, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``top`` best of ``vectors`` for each of ``queries`` (both ``vec_id``,
    ``embedding``).

    Components count as ``floor(scale * x)``. Rows with a null id, a null vector, or a null or non-finite component take no
    part; vectors meet vectors of their own length only. A query's id is never its own result; an id that repeats may come more than
    once, as a result and as a query. Other columns are left out; without queries there are no rows.
    """
    # Every block of queries meets every block of candidates; a lane gets a share of the candidates and all queries.
    asked = blocks(whole_vectors(queries, scale), QUERY_BLOCK).select(
        F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
        F.col("matrix").alias("q_matrix"))
    asked = stored(asked, "queries")
    names = [(r.q_block, r.q_dim) for r in asked.select("q_block", "q_dim").collect()]  # one for each block
    named = vectors.sparkSession.createDataFrame(names, "q_block long, dim int").groupBy("dim").agg(
        F.collect_list("q_block").alias("q_blocks"))
    held = (blocks(whole_vectors(vectors, scale), BLOCK).withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(LANES)))
            .join(F.broadcast(named), "dim").withColumn("q_block", F.explode("q_blocks")))
    asked = asked.drop("q_dim").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))).withColumn(
        "lane", F.col("lane").cast("long"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for row in batch.to_pylist():
                ids, wanted = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                matrix = np.frombuffer(row["matrix"], np.int64).reshape(len(ids), row["dim"])
                against = np.frombuffer(row["q_matrix"], np.int64).reshape(len(wanted), row["dim"])
                found = list(best_of(against, wanted, matrix, ids, top, pivots))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

    pairs = held.join(asked, ["q_block", "lane"]).select("ids", "matrix", "dim", "q_ids", "q_matrix")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInArrow(search, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"))


TOP_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::bigint score
    from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) rank, vec_id, score from p)
select query_id, rank::int rank, vec_id, score from r where rank <= 10
"""
