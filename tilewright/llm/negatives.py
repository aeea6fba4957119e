"""Hard negatives out of Hilbert-ordered blocks with zone maps.

Vectors are sorted along a Hilbert curve and written as blocks. Beside its matrix a block keeps a zone map: the least and the
greatest value of each dimension and of the labels. For an anchor ``q`` and a block with zones ``[lo, hi]``, interval
arithmetic bounds every inner product: at most ``q+ . hi + q- . lo`` and at least ``q+ . lo + q- . hi``, where ``q+`` and ``q-``
are the positive and the negative part of ``q``. The zone maps are read without the matrices, and three readings follow:

1. *probe*: of each page of zone maps the block that may hold the anchor's label and whose bounds have the best middle; the
   last of the best scores so far is a floor;
2. *positives*: blocks that may hold the label and whose bound reaches the floor;
3. *negatives*: blocks that may hold another label and whose bounds meet a window ``[low * p, high * p]`` of a positive ``p``.

An anchor is compared only with the blocks chosen for it. Blocks and anchors meet by a join on the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.frames import stored
from tilewright.llm.hilbert import hilbert_places

SCALE = 256
BLOCK = 256  # vectors of a block
GROUP = 64  # anchors that look at zone maps together
PAGE = 256  # zone maps of a page
BITS = 4  # cells a side of the Hilbert curve, as a power of two
LOW, HIGH = 80, 100  # window of the negatives, in hundredths of the positive score
POSITIVES = NEGATIVES = 5


def usable(vectors: DataFrame, anchors: Column, scale: int) -> DataFrame:
    """``vec_id``, ``label``, ``asked``, ``dim``, ``vector`` (array of long) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce(anchors, F.lit(False)).alias("asked"),
                          x.alias("x"))
    return (rows.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(~bad)
            .select("vec_id", "label", "asked", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("vector")))


def in_curve_order(rows: DataFrame) -> DataFrame:
    """The rows with ``vector`` as bytes, dealt out and sorted by their place on the curve."""
    ends = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    least, most = float(ends[0] or 0), float(ends[1] or 0)
    side = max((most - least) / (1 << BITS), 1e-9)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("asked", pa.bool_()), ("dim", pa.int32()),
                        ("place", pa.binary()), ("vector", pa.binary())])

    def place(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            dims = np.asarray(batch.column("dim"))
            lists = batch.column("vector")
            flat, starts = np.asarray(lists.values, np.int64), np.asarray(lists.offsets)[:-1]
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                matrix = flat[starts[at][:, None] + np.arange(dim)]
                cells = np.clip((matrix - least) / side, 0, (1 << BITS) - 1).astype(np.uint32)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(take) for c in ("vec_id", "label", "asked", "dim")],
                    pa.array([r.tobytes() for r in hilbert_places(cells, BITS)], pa.binary()),
                    pa.array([r.tobytes() for r in matrix], pa.binary())], schema=schema)

    placed = rows.mapInArrow(place, "vec_id long, label long, asked boolean, dim int, place binary, vector binary")
    order = ["dim", "place", "vec_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def _numbered() -> Iterator[int]:
    """Numbers that no other task hands out."""
    number = TaskContext.get().partitionId() << 33
    while True:
        number += 1
        yield number


def _gathered(read: Iterator[pa.RecordBatch], size: int, columns: list[str]) -> Iterator[tuple[int, list[list]]]:
    """Neighbouring rows of one ``dim``, up to ``size`` at once, column by column."""
    held: list[list] = [[] for _ in columns]
    last = None
    for batch in read:
        for dim, *row in zip(*(batch.column(c).to_pylist() for c in ["dim", *columns]), strict=True):
            if held[0] and (dim != last or len(held[0]) == size):
                yield last, held
                held = [[] for _ in columns]
            last = dim
            for column, value in zip(held, row, strict=True):
                column.append(value)
    if held[0]:
        yield last, held


def blocks(ordered: DataFrame) -> DataFrame:
    """Blocks of neighbours with their zone maps."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("low_label", pa.int64()),
                        ("high_label", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("asked", pa.binary()),
                        ("any_asked", pa.bool_()), ("matrix", pa.binary())])

    def gather(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (dim, (ids, labels, asked, rows)) in zip(_numbered(), _gathered(read, BLOCK, ["vec_id", "label", "asked", "vector"])):
            matrix = np.frombuffer(b"".join(rows), np.int64).reshape(len(ids), dim)
            yield pa.RecordBatch.from_pydict({
                "block": [number], "dim": [dim], "low": [matrix.min(0).tobytes()], "high": [matrix.max(0).tobytes()],
                "low_label": [min(labels)], "high_label": [max(labels)], "ids": [np.array(ids, np.int64).tobytes()],
                "labels": [np.array(labels, np.int64).tobytes()], "asked": [np.array(asked, bool).tobytes()], "any_asked": [any(asked)],
                "matrix": [matrix.tobytes()]}, schema=schema)

    return ordered.mapInArrow(gather, "block long, dim int, low binary, high binary, low_label long, high_label long, ids binary, "
                                      "labels binary, asked binary, any_asked boolean, matrix binary")


def anchor_groups(held: DataFrame) -> DataFrame:
    """The anchors among the blocks, some neighbours at once: ``group``, ``dim``, ``ids``, ``labels``, ``matrix``."""
    schema = pa.schema([("group", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary())])

    def anchors(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["asked"], bool))
                ids, labels = np.frombuffer(row["ids"], np.int64)[at], np.frombuffer(row["labels"], np.int64)[at]
                matrix = np.frombuffer(row["matrix"], np.int64).reshape(-1, row["dim"])[at] if row["dim"] else np.zeros((len(at), 0), np.int64)
                yield pa.RecordBatch.from_pydict({"dim": [row["dim"]] * len(at), "vec_id": ids.tolist(), "label": labels.tolist(),
                                                  "vector": [r.tobytes() for r in matrix]})

    def gather(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (dim, (ids, labels, rows)) in zip(_numbered(), _gathered(anchors(read), GROUP, ["vec_id", "label", "vector"])):
            yield pa.RecordBatch.from_pydict({"group": [number], "dim": [dim], "ids": [np.array(ids, np.int64).tobytes()],
                                              "labels": [np.array(labels, np.int64).tobytes()], "matrix": [b"".join(rows)]}, schema=schema)

    return held.where("any_asked").select("dim", "ids", "labels", "asked", "matrix").mapInArrow(
        gather, "group long, dim int, ids binary, labels binary, matrix binary")


def zone_pages(held: DataFrame) -> DataFrame:
    """The zone maps, some at once: ``page``, ``dim`` and a column of bytes for each part."""
    columns = ["block", "low_label", "high_label", "low", "high"]
    schema = pa.schema([("page", pa.int64()), ("dim", pa.int32()), *[(f"zone_{c}", pa.binary()) for c in columns]])

    def gather(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (dim, (*numbers, low, high)) in zip(_numbered(), _gathered(read, PAGE, columns)):
            parts = [*[np.array(c, np.int64).tobytes() for c in numbers], b"".join(low), b"".join(high)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([dim], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]],
                                             schema=schema)

    return held.select("dim", *columns).mapInArrow(gather, "page long, dim int, " + ", ".join(f"zone_{c} binary" for c in columns))


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high``, by interval arithmetic."""
    plus, minus = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    low, high = low.astype(float).T, high.astype(float).T
    slack = np.abs(anchors.astype(float)) @ np.maximum(np.abs(low), np.abs(high)) * 1e-12  # rounding of large values
    least, most = plus @ low + minus @ high - slack, plus @ high + minus @ low + slack
    return np.clip(least, -2.0**63, 2.0**63), np.clip(most, -2.0**63, 2.0**63)  # as scores stop there


def scores_of(anchors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond a long they stop at its ends."""
    most = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    reach = most(anchors) * most(matrix) * max(1, anchors.shape[1])
    if reach < 1 << 53:
        return (anchors.astype(float) @ matrix.T.astype(float)).astype(np.int64)
    if reach < 1 << 63:
        return anchors @ matrix.T
    ends = np.iinfo(np.int64)
    exact = anchors.astype(object) @ matrix.T.astype(object)
    return np.array([[min(max(v, ends.min), ends.max) for v in row] for row in exact], np.int64).reshape(exact.shape)


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(rows, dim)


Wanted = list[list]  # for each anchor of a group what it looks for
Choice = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Wanted], np.ndarray]


def chosen_blocks(groups: DataFrame, pages: DataFrame, choose: Choice) -> DataFrame:
    """``block`` and ``group`` with the anchors of the group that must read the block.

    A page of zone maps meets all groups in its lane. ``choose`` gets labels, lower and upper bounds, the zones' labels and
    what each anchor wants, and gives a table of anchors by blocks.
    """
    spark = groups.sparkSession
    lanes = max(1, min(pages.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    lane = F.pmod(F.xxhash64("page"), F.lit(lanes)).cast("int")
    every = groups.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    schema = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("at", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()),
                        ("anchors", pa.binary()), ("wanted", pa.list_(pa.struct([("at", pa.int32()), ("rank", pa.int32()), ("id", pa.int64()), (
                            "score", pa.int64())])))])

    def pick(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                anchors = _matrix(row["matrix"], len(ids), dim)
                numbers = np.frombuffer(row["zone_block"], np.int64)
                low, high = (_matrix(row[f"zone_{c}"], len(numbers), dim) for c in ("low", "high"))
                wanted: Wanted = [[] for _ in ids]
                for w in row["wanted"] or []:
                    wanted[w["at"]].append(w)
                least, most = bounds(anchors, low, high)
                table = choose(labels, least, most, np.frombuffer(row["zone_low_label"], np.int64),
                               np.frombuffer(row["zone_high_label"], np.int64), wanted)
                out: dict[str, list] = {c: [] for c in schema.names}
                for k in np.flatnonzero(table.any(0)).tolist():
                    at = np.flatnonzero(table[:, k])
                    values = (int(numbers[k]), row["group"], at.astype(np.int32).tobytes(), ids[at].tobytes(), labels[at].tobytes(),
                              anchors[at].tobytes(), [w for a in at.tolist() for w in wanted[a]])
                    for c, v in zip(schema.names, values, strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    met = pages.withColumn("lane", lane).join(every, ["dim", "lane"]).drop("lane", "page")
    return met.mapInArrow(pick, "block long, group long, at binary, ids binary, labels binary, anchors binary, "
                                "wanted array<struct<at:int,rank:int,id:long,score:long>>")


def best_in_blocks(held: DataFrame, choice: DataFrame, best: Callable, top: int) -> DataFrame:
    """``group``, ``at``, ``rank``, ``id``, ``score`` of what the anchors find in their chosen blocks, and ``anchor_id``.

    A task carries the best of one group from block to block; ``rank`` tells the windows of an anchor apart.
    """
    schema = pa.schema([("group", pa.int64()), ("at", pa.int32()), ("rank", pa.int32()), ("anchor_id", pa.int64()), ("id", pa.int64()),
                        ("score", pa.int64())])

    def look(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, {}

        def done() -> pa.RecordBatch:
            rows = [(group, at, rank, anchor, i, s) for (at, rank, anchor), found in kept.items() for s, i in found]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                                              schema=schema)

        for batch in read:
            for row in batch.to_pylist():
                if row["group"] != group:
                    if any(kept.values()):
                        yield done()
                    group, kept = row["group"], {}
                ids, labels = np.frombuffer(row["block_ids"], np.int64), np.frombuffer(row["block_labels"], np.int64)
                at, own = np.frombuffer(row["at"], np.int32).tolist(), np.frombuffer(row["ids"], np.int64).tolist()
                matrix = _matrix(row["block_matrix"], len(ids), row["dim"])
                scores = scores_of(_matrix(row["anchors"], len(own), row["dim"]), matrix)
                wanted: dict[int, list] = {}
                for w in row["wanted"] or []:
                    wanted.setdefault(w["at"], []).append(w)
                of = np.frombuffer(row["labels"], np.int64).tolist()
                for a, anchor, label, line in zip(at, own, of, scores, strict=True):
                    for rank, where in best(line, ids, labels == label, ids != anchor, wanted.get(a, [])):
                        old = kept.get((a, rank, anchor), [])
                        found = old + list(zip(line[where].tolist(), ids[where].tolist(), strict=True))
                        kept[a, rank, anchor] = sorted(found, key=lambda f: (-f[0], f[1]))[:top]
        if any(kept.values()):
            yield done()

    right = held.select("block", "dim", *[F.col(c).alias(f"block_{c}") for c in ("ids", "labels", "matrix")])
    met = choice.join(right, "block").sortWithinPartitions("group")
    found = met.mapInArrow(look, "group long, at int, rank int, anchor_id long, id long, score long")
    order = Window.partitionBy("group", "at", "rank").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def _first(line: np.ndarray, ids: np.ndarray, where: np.ndarray, top: int) -> np.ndarray:
    """The best ``top`` of some candidates, ties to the smaller id."""
    if len(where) > 4 * top:  # sort no more than the ties of the last one
        least = np.partition(line[where], len(where) - top)[len(where) - top]
        where = where[line[where] >= least]
    return where[np.lexsort((ids[where], -line[where]))[:top]]


def hard_negatives(vectors: DataFrame, anchors: Column, low: int = LOW, high: int = HIGH, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` over ``vec_id``, ``embedding``, ``label``.

    ``anchors`` is true for the rows that are anchors. Components count as ``floor(scale * x)``. The positives of an anchor are
    its best rows of the same label; the negatives of a positive are the best rows of other labels that score from ``low`` to
    ``high`` hundredths of it. Ties go to the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; a null ``anchors`` is false.
    Vectors meet vectors of their own length only; empty ones score 0. A row never meets rows of its own id; rows that repeat
    an id count one by one, as anchors and as results. Components and scores beyond a long stop at its ends. Anchors
    without positives and positives without negatives give no rows, nor does an empty table. Other columns are left out.
    """
    held = stored(blocks(in_curve_order(usable(vectors, anchors, scale))), "blocks")
    groups = stored(anchor_groups(held), "anchors")
    pages = stored(zone_pages(held), "zones")
    none = F.lit(None).cast("array<struct<at:int,rank:int,id:long,score:long>>")

    def may_hold(labels, low_label, high_label):
        return (low_label <= labels[:, None]) & (labels[:, None] <= high_label)

    def probe(labels, least, most, low_label, high_label, wanted):
        middle = np.where(may_hold(labels, low_label, high_label), least + most, -np.inf)
        table = np.zeros(middle.shape, bool)
        table[np.arange(len(middle)), middle.argmax(1)] = True
        return table & (middle > -np.inf)

    def reaching(labels, least, most, low_label, high_label, wanted):
        floor = np.array([w[0]["score"] if w else -np.inf for w in wanted], float)
        return may_hold(labels, low_label, high_label) & (most >= floor[:, None])

    def meeting(labels, least, most, low_label, high_label, wanted):
        table = np.zeros(most.shape, bool)
        for a, windows in enumerate(wanted):
            for w in windows:
                table[a] |= (100 * most[a] >= low * w["score"]) & (100 * least[a] <= high * w["score"])
        return table & ~((low_label == labels[:, None]) & (high_label == labels[:, None]))

    def alike(line, ids, same, other, windows):
        yield 0, _first(line, ids, np.flatnonzero(same & other), positives)

    def in_windows(line, ids, same, other, windows):
        where = np.flatnonzero(~same & other)
        where = where[np.lexsort((ids[where], -line[where]))]
        falling = -line[where]
        for w in windows:
            top, bottom = high * w["score"] // 100, -(-low * w["score"] // 100)
            first, last = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -bottom, "right")
            if first < last:
                yield w["rank"], where[first:min(last, first + negatives)]

    def looking(found: DataFrame) -> DataFrame:
        wanted = found.groupBy("group").agg(F.collect_list(F.struct("at", F.col("place").alias("rank"), "id", "score")).alias("wanted"))
        return groups.join(wanted, "group", "left")  # a group has a bounded number of anchors, an anchor of results

    seen = best_in_blocks(held, chosen_blocks(groups.withColumn("wanted", none), pages, probe), alike, positives)
    floors = seen.where(F.col("place") == positives)
    good = stored(best_in_blocks(held, chosen_blocks(looking(floors), pages, reaching), alike, positives), "positives")
    bad = best_in_blocks(held, chosen_blocks(looking(good).where("wanted is not null"), pages, meeting), in_windows, negatives)
    return (bad.join(good.select("group", "at", F.col("place").alias("rank"), F.col("id").alias("positive_id"),
                                 F.col("score").alias("positive_score")), ["group", "at", "rank"])
            .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


NEGATIVES_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e
    from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same,
        list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::bigint score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
g as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) r from p where same qualify r <= 5),
n as (select g.anchor_id, g.vec_id positive_id, p.vec_id negative_id, g.score positive_score, p.score negative_score,
        row_number() over (partition by g.anchor_id, g.vec_id order by p.score desc, p.vec_id) r
    from g join p on g.anchor_id = p.anchor_id and not p.same
        and 80 * g.score <= 100 * p.score and 100 * p.score <= 100 * g.score)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from n where r <= 5
"""
