"""Removal of byte passages that also start earlier, by distributed prefix doubling over sampled suffixes.

Suffixes are ranked by the hash of their first bytes, and only those whose rank is shared go on to a longer prefix:

1. Each ``length`` bytes belong to the suffix inside with the lowest rank of ``FIRST`` bytes (the leftmost, if equal), so
   equal bytes belong to suffixes of one rank. Suffixes with a rank of their own are done.
2. A suffix's stretch, all bytes of the windows that belong to it, is ranked next. Of equal stretches all but the
   earliest go as a whole; the earliest is done if its first rank has no other stretch.
3. The windows of what is left are ranked at the whole ``length``; all but the earliest of each rank go.

Ranks are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.frames import packing, sliced, stored, unpacked
from tilewright.llm.words import chunks, prefix_sums, span_hash

LENGTH = 100
FIRST = 32
CHUNK = 1 << 18  # text ranked at once; a longer text is a chunk of its own


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[:len(values) - (width - step)], values[width - step:]) if width > step else values


def _inside(where: np.ndarray, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``count`` windows lie in one text, and the first window of each text that has any."""
    begins, ends = where[:-1], where[1:] - length + 1
    begins, ends = begins[ends > begins], ends[ends > begins]
    marks = np.zeros(count + 1, np.int64)
    marks[begins] += 1
    marks[ends] -= 1
    return np.cumsum(marks)[:count] > 0, begins


def stretches(data: np.ndarray, where: np.ndarray, length: int, first: int) -> tuple[np.ndarray, ...]:
    """Rank, begin, number of windows and rank of the whole stretch, for each suffix of a chunk that windows belong to."""
    count = len(data) - length + 1
    if count < 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint64))
    sums, starts, width = prefix_sums(data), np.arange(len(data) - first + 1), length - first + 1
    ranks = span_hash(sums, starts, starts + first)
    low = _slide(ranks, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == ranks)
    valid, begins = _inside(where, length, count)
    # Between two marks all windows belong to one suffix.
    new = np.ones(count, bool)
    new[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    new[begins] = True
    new[at[at + 1 < count] + 1] = True
    begin = np.flatnonzero(new)
    own = np.searchsorted(at, begin)
    wrong = np.flatnonzero(ranks[at[own]] != low[begin])
    while len(wrong):
        own[wrong] += 1
        wrong = wrong[ranks[at[own[wrong]]] != low[begin[wrong]]]
    other = np.ones(len(begin), bool)
    other[1:] = (own[1:] != own[:-1]) | (valid[begin[1:]] != valid[begin[:-1]]) | np.isin(begin[1:], begins)
    lo, own = begin[other], own[other]
    n = np.diff(np.append(lo, count))
    lo, own, n = lo[valid[lo]], own[valid[lo]], n[valid[lo]]
    return ranks[at[own]], lo, n, span_hash(sums, lo, lo + n - 1 + length)


def removed_runs(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs (begin, end) that the given ones cover."""
    if not len(begins):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, begins[1:] > ends[:-1]))
    return np.column_stack([begins[new], ends[np.append(new[1:] - 1, len(ends) - 1)]])


def beside(read: Iterator[pa.RecordBatch], place: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of rows in order of ``rank``, ``whole`` (if any) and ``place``: those ``later`` than the first of their whole, and the first of each
    whole of a rank with several. What has the place of the first is not later, as rows may repeat an id."""
    rank = whole = None
    first: list[int] = []  # place of the first of the whole at hand
    waiting = False  # whether that is the rank's only whole so far
    for batch in read:
        if not batch.num_rows:
            continue
        ranks, wholes = (batch.column(c).to_numpy() for c in ("rank", "whole" if "whole" in batch.schema.names else "rank"))
        held = [batch.column(c).to_numpy() for c in place]
        new_rank, new = np.ones(len(ranks), bool), np.ones(len(ranks), bool)
        np.not_equal(ranks[1:], ranks[:-1], out=new_rank[1:])
        new_rank[0] = rank is None or ranks[0] != rank
        np.not_equal(wholes[1:], wholes[:-1], out=new[1:])
        new[0] = whole is None or wholes[0] != whole
        new |= new_rank
        starts, group = np.flatnonzero(new), np.cumsum(new)
        firsts = [np.concatenate([v[:0] if not first else np.array(first[i:i + 1], v.dtype), v[starts]]) for i, v in enumerate(held)]
        later = ~new & np.any([f[group - (not first)] != v for f, v in zip(firsts, held, strict=True)], axis=0)
        opens = ~new_rank[starts]  # not the rank's first whole
        if len(starts):
            if waiting and opens[0]:
                yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(place, first, strict=True)}, "later": [False]}, schema=schema)
            waiting = bool(new_rank[starts[-1]])
            opens[:-1] |= ~new_rank[starts[1:]]
            first = [int(v[starts[-1]]) for v in held]
        rank, whole = ranks[-1], wholes[-1]
        some = np.sort(np.concatenate([np.flatnonzero(later), starts[opens]]))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in held] + [pa.array(later[some])], schema=schema)


def _beside(rows: DataFrame, keys: list[str]) -> DataFrame:
    place = [c for c in keys if c not in ("rank", "whole")]
    schema = pa.schema([(c, pa.int64() if c == "doc" else pa.int32()) for c in place] + [("later", pa.bool_())])
    kinds = ", ".join(f"{c} {'long' if c == 'doc' else 'int'}" for c in place)
    ordered = rows.select(*keys).repartition("rank").sortWithinPartitions(*keys)
    return ordered.mapInArrow(lambda read: beside(read, place, schema), f"{kinds}, later boolean")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs of ``n`` windows of ``length`` bytes from byte ``lo`` of ``doc`` that also start earlier, of ``docs`` (``doc``, ``text``)."""
    first = min(FIRST, length)

    def ranked(columns: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        schema = pa.schema(list(columns.items()))

        def rank(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in read:
                for part in sliced(batch, CHUNK):
                    for row, data, where in chunks(part.column("text"), CHUNK):
                        ranks, lo, n, whole = stretches(data, where, length, first)
                        at = np.searchsorted(where, lo, "right") - 1
                        found = {"rank": ranks.view(np.int64), "whole": whole.view(np.int64), "lo": lo - where[at], "n": n}
                        if "doc" in columns:
                            found["doc"] = part.column("doc").to_numpy()[row + at]
                        yield pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in columns.items()], schema=schema)

        return rank

    def spread(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for doc, text, open_ones in zip(batch.column("doc"), batch.column("text"), batch.column("open"), strict=True):
                data = np.frombuffer(unpacked(pa.array([text]))[0], np.uint8)
                lo, n = (open_ones.values.field(f).to_numpy() for f in ("lo", "n"))
                lo, n = lo[lo + n - 1 + length <= len(data)], n[lo + n - 1 + length <= len(data)]
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                ranks = span_hash(prefix_sums(data), at, at + length)
                for k in range(0, len(at), 1 << 16):
                    own = at[k:k + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"rank": ranks[k:k + (1 << 16)].view(np.int64),
                                                      "doc": np.full(len(own), doc.as_py(), np.int64), "lo": own.astype(np.int32)})

    columns = {"rank": pa.int64(), "whole": pa.int64(), "doc": pa.int64(), "lo": pa.int32(), "n": pa.int32()}
    found = docs.select("doc", "text").mapInArrow(ranked(columns), "rank long, whole long, doc long, lo int, n int")
    shared = stored(_beside(found, ["rank", "whole", "doc", "lo", "n"]), "stretches")  # they travel once, to their rank
    copies = shared.where("later").select("doc", "lo", "n")
    # at most one entry for each window of one text
    open_ones = shared.where("not later").groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("open"))
    windows = packing(docs.select("doc", "text")).join(open_ones, "doc").mapInArrow(spread, "rank long, doc long, lo int")
    later = _beside(windows, ["rank", "doc", "lo"]).where("later").select("doc", "lo", F.lit(1).alias("n"))
    return copies.unionByName(later)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept`` (bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A null text is empty. Rows are earlier by smaller ``doc_id``, null first; rows that repeat an id count as one document, a
    string of theirs being earlier by its start, and what goes from one of them goes from all. Texts shorter than ``length`` keep
    all bytes. Other columns stay, but must not have the four names or begin with ``sd_``.
    """
    least = -(1 << 63)
    keyed = docs.withColumn("sd_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(least))).withColumn(
        "sd_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    long = keyed.where(F.octet_length("sd_text") >= length).select(F.col("sd_doc").alias("doc"), F.col("sd_text").alias("text"))
    # at most one entry for each window of one text
    runs = stored(repeated_windows(long, length).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("sd_runs")), "runs")
    columns = docs.columns
    # A text travels packed; where it is a string it is put back from that.
    same = isinstance(docs.schema["text"].dataType, T.StringType)
    sent = keyed.withColumn("sd_text", F.col("text").cast("string"))
    whole = packing(sent.drop("text") if same else sent, "sd_text").join(runs.withColumnRenamed("doc", "sd_doc"), "sd_doc", "left")

    def cut(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, CHUNK, column="sd_text"):
                texts = unpacked(part.column("sd_text"))
                out: list[tuple[bytes, int, int, int]] = []
                for raw, given in zip([t or b"" for t in texts], part.column("sd_runs"), strict=True):
                    runs = np.zeros((0, 2), np.int64)
                    if given.is_valid:
                        lo, n = (given.values.field(f).to_numpy().astype(np.int64) for f in ("lo", "n"))
                        fits = lo < len(raw)
                        runs = removed_runs(lo[fits], np.minimum(lo + n - 1 + length, len(raw))[fits])
                    ends = [0, *runs.ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                    out.append((kept, len(raw), len(raw) - len(kept), len(runs)))
                whole = pa.array(texts, pa.binary()).cast(pa.string()) if same else None
                arrays = [whole if same and c == "text" else part.column(c) for c in columns] + [pa.array([o[0] for o in out], pa.binary())]
                arrays += [pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return whole.select(*(f"`{c}`" for c in columns if c != "text" or not same), "sd_text", "sd_runs").mapInArrow(
        cut, f"{schema}, kept binary, n_bytes long, n_removed long, n_spans long")
