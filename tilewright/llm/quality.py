"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words and pairs of words are hashed into ``2 ** BITS`` weights; a text's features are their counts over the root of their
number. The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, taken in the order of a hash of their id; scoring
is a sparse dot product over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.frames import doc_key, fold, sliced
from tilewright.llm.words import LOWER, chunks, join_hashes, mix, prefix_sums, span_hash, word_spans

BITS = 18
SAMPLE_ROWS = 20_000
PASSES = 4
SLICE = 1 << 20  # bytes of text looked at together
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def features(data: np.ndarray, where: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows of a chunk, and how many stand before each row (and after the last).

    Each word gives itself, its pair with the next word, its shape and the pair of shapes; the shape is what its last two
    bytes are and whether it repeats the word before.
    """
    low = LOWER[data]
    starts, ends, first = word_spans(low, where)
    hashes = span_hash(prefix_sums(low), starts, ends)
    last = low[ends - 1].astype(np.uint64)
    middle = low[np.maximum(ends - 2, starts)].astype(np.uint64)
    letter = np.uint64(97)
    shape = np.where(_LETTER[last.astype(np.int64)], letter, last) * np.uint64(256) + np.where(_LETTER[middle.astype(np.int64)], letter, middle)
    shape = shape * np.uint64(2)
    shape[1:] += hashes[1:] == hashes[:-1]
    shape = mix(shape + np.uint64(1))
    top = np.uint64(64 - bits)
    at = np.zeros((len(hashes), 4), np.int64)
    at[:, 0], at[:, 1] = hashes >> top, shape >> top
    if len(hashes) > 1:
        at[:-1, 2], at[:-1, 3] = join_hashes(hashes, 2) >> top, join_hashes(shape, 2) >> top
    keep = np.ones((len(hashes), 4), bool)
    keep[first[1:][np.diff(first) > 0] - 1, 2:] = False
    before = np.concatenate([[0], np.cumsum(keep.sum(1))])
    return at[keep], before[first]


class Leader:
    """Follow the regularised leader, a step for each row."""

    def __init__(self, bits: int):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def train(labelled: DataFrame, bits: int = BITS, passes: int = PASSES) -> np.ndarray:
    """Weights (the last is the bias) from rows of ``text`` and ``label`` (0 or 1) in the order of ``doc_id``'s hash."""

    def describe(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, SLICE):
                rows = []
                for _, data, where in chunks(part.column("text"), SLICE):
                    at, before = features(data, where, bits)
                    for a, b in zip(before[:-1], before[1:], strict=True):
                        own, count = np.unique(at[a:b], return_counts=True)
                        least = np.min_scalar_type(count.max(initial=0))  # most counts take one byte
                        rows.append((own.astype(np.int32).tobytes(), count.astype(least).tobytes(), int(b - a)))
                yield pa.RecordBatch.from_arrays([
                    part.column("place"), part.column("label"), pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
                    names=["place", "label", "at", "counts", "total"])

    def learn(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows stay as they came, five bytes for most features, and are widened one at a time
        held = [batch.select(["at", "counts", "total", "label"]) for batch in read]

        def row(at: pa.Scalar, counts: pa.Scalar, total: int, label: int) -> tuple[np.ndarray, np.ndarray, float]:
            own, n = np.frombuffer(at.as_buffer(), np.int32), counts.as_buffer()
            n = np.frombuffer(n, f"<u{n.size // max(1, len(own)) or 1}").astype(float)
            return np.append(own, 1 << bits), np.append(n / np.sqrt(max(1, total)), 1.0), float(label)

        model = Leader(bits)
        for _ in range(passes):
            for batch in held:
                for at, counts, total, label in zip(batch.column("at"), batch.column("counts"), batch.column("total").to_pylist(),
                                                    batch.column("label").to_pylist(), strict=True):
                    model.step(*row(at, counts, total, label))
        weights = model.weights()
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"at": used, "w": weights[used]})

    chosen = labelled.withColumn("place", F.xxhash64(doc_key())).select("place", "text", F.col("label").cast("int").alias("label"))
    seen = (chosen.mapInArrow(describe, "place long, label int, at binary, counts binary, total long").repartition(1)
            .sortWithinPartitions("place", "label", "at"))
    weights = np.zeros((1 << bits) + 1)
    for row in seen.mapInArrow(learn, "at long, w double").collect():  # no more than the model's size
        weights[row["at"]] = row.w
    return weights


def labelled_rows(docs: DataFrame, labels: DataFrame, held_out: Column, column: str = "quality",
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``sample_rows`` labelled documents outside ``held_out``; null ids and labels take no part."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out)
              .select("doc_id", F.col(column).alias("label")).orderBy(F.xxhash64(doc_key()), "doc_id", "label").limit(sample_rows))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by sample_rows


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; null and empty texts get that of the bias. Other columns stay."""
    bits = len(weights).bit_length() - 1

    def apply(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, SLICE):
                sums = []
                for _, data, where in chunks(part.column("text").cast(pa.string()), SLICE):
                    at, before = features(data, where, bits)
                    for a, b in zip(before[:-1], before[1:], strict=True):
                        sums.append(weights[-1] + weights[at[a:b]].sum() / np.sqrt(max(1, b - a)))
                yield part.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35)))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(apply, f"{schema}, `{name}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, out: int = 1) -> DataFrame:
    """``docs`` with ``held_out`` and ``score``; labels of the held-out fold are never read."""
    held = fold(parts) == out
    model = train(labelled_rows(docs, labels, held))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score")
