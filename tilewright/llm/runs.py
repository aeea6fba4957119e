"""Periodic runs of words by a dictionary of basic factors.

The basic factors of a text are its stretches of 1, 2, 4, 8, ... words. Equal factors get equal names; the name of a factor is
made of the names of its two halves, so one sort for each length names all of them. Within a window of twice a
factor's length, the occurrences of a factor form arithmetic progressions: each occurrence points to its successor, and
neighbouring positions with one and the same distance make a stretch with that distance as a period.

A run with smallest period ``q`` and at least ``3 * q`` words shows at the factor length ``m`` with ``q <= m < 2 * q``: an earlier
return of such a factor would give the run a smaller period. For the same reason a stretch with ``q <= m`` ends where the
period ends on either side, so extending it is taking its outer words. A run shows at several lengths and is kept once.
A factor that occurs once in a text is dropped together with all longer factors that begin or end with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_WORDS = 400_000  # words whose factors are named together; a longer text is a chunk of its own
LEAST_WORDS = 24  # shortest run
LEAST_TIMES = 3  # periods a run has at least

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_codes(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word; equal within a text for equal words, never equal between texts."""
    out = np.empty(sum(map(len, texts)), np.int64)
    at = 0
    for words in texts:
        own: dict[bytes, int] = {}
        out[at:at + len(words)] = [own.setdefault(w, at + len(own)) for w in words]
        at += len(words)
    return out


def factor_runs(codes: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """``start``, ``length``, ``period`` of every run, a row each, by start and period. ``times`` is 3 at least."""
    total = len(codes)
    found = [np.zeros((0, 3), np.int64)]
    names, places = codes, np.arange(total)
    m = 1
    while len(places):
        order = np.argsort(names, kind="stable")
        name, place = names[order], places[order]
        again = name[1:] == name[:-1]
        gap = place[1:] - place[:-1]
        close = again & (gap <= m)
        found.append(progressions(place[:-1][close], gap[close], m, least, times))
        # on to factors twice as long, of those that occur more than once
        repeated = np.zeros(len(name), bool)
        repeated[1:] |= again
        repeated[:-1] |= again
        number = np.zeros(len(name), np.int64)
        np.cumsum(~again, out=number[1:])
        named = np.full(total + m, -1, np.int64)
        named[place[repeated]] = number[repeated]
        places = np.flatnonzero((named[:total] >= 0) & (named[m:] >= 0))
        names = named[places] * (total + 1) + named[places + m]
        m *= 2
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def progressions(place: np.ndarray, gap: np.ndarray, m: int, least: int, times: int) -> np.ndarray:
    """Stretches of neighbouring places whose factors of ``m`` words return after the same distance."""
    if not len(place):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(place)
    place, gap = place[order], gap[order]
    first = np.ones(len(place), bool)
    first[1:] = (place[1:] != place[:-1] + 1) | (gap[1:] != gap[:-1])
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], len(place)) - 1
    start, period = place[begins], gap[begins]
    length = place[ends] - start + m + period
    long = (length >= least) & (length >= times * period)
    return np.stack([start[long], length[long], period[long]], 1)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for each word that a run contains after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _runs_of(texts: list[list[bytes]]) -> Iterator[tuple[list[dict], str]]:
    """Runs and collapsed text of each text of a chunk."""
    all_runs = factor_runs(word_codes(texts))
    ends = np.cumsum([0, *map(len, texts)])
    cut = np.searchsorted(all_runs[:, 0], ends)
    for i, words in enumerate(texts):
        runs = all_runs[cut[i]:cut[i + 1]].copy()
        if len(runs):
            runs[:, 0] -= ends[i]
            words = [w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k]
        yield [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], b" ".join(words).decode()


def _mapped(read: Iterator[pa.RecordBatch], words_of) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([
        ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
    ids: list = []
    texts: list[list[bytes]] = []
    held = 0

    def done() -> pa.RecordBatch:
        runs, collapsed = zip(*_runs_of(texts), strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, schema.field("runs").type),
                                          pa.array(collapsed, pa.string())], schema=schema)
        ids.clear()
        texts.clear()
        return out

    for batch in read:
        for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            words = words_of(doc.as_py(), (text.as_py() or "").encode().split())
            if texts and held + len(words) > CHUNK_WORDS:
                yield done()
                held = 0
            ids.append(doc.as_py())
            texts.append(words)
            held += len(words)
    if texts:
        yield done()


def word_runs(docs: DataFrame, unrolled: bool = False) -> DataFrame:
    """``doc_id``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed`` of each row.

    Words are runs of bytes other than space and tab to carriage return. A run is a stretch of at least 24 words and three
    periods that cannot grow; periods are smallest ones. ``collapsed`` joins by one space the words that no run holds after
    its first period. With ``unrolled`` each tenth document first gets a repeated tail, see ``unrolled_words``.

    A null text and one without words have no runs and an empty ``collapsed``. A null id stays null. Rows that repeat give
    rows that repeat; rows stand for themselves, so there are no ties between them. Other columns are left out, whatever
    their names; an empty table gives no rows. Texts are whole; a task holds one chunk of texts or one long text.
    """
    change = unrolled_words if unrolled else lambda doc, words: words
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda read: _mapped(read, change), f"doc_id bigint, runs array<{RUN}>, collapsed string")


def unrolled_words(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repeated tail where the crc32 of the id (a null id: of the empty text) ends in 0."""
    h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[:n - a]


def best_run(runs: Column) -> Column:
    """The run with the greatest exact exponent; of equal ones the first by start, then period."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """Count, greatest run and digests of the rows of ``word_runs``."""
    best = best_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("*", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
