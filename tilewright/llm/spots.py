"""Document fingerprints from spot signatures.

The commonest words of the corpus are anchors. Each anchor and the ``CHAIN`` content words after it make a signature; the
fingerprint of a text is the set of its signatures, written as ascending 64-bit numbers in hexadecimal. Fingerprints are compared by
Jaccard similarity, and only if their lengths allow the similarity asked for.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.frames import packed, sliced, unpacked
from tilewright.llm.words import chunks, hashed_words, join_hashes, mix

ANCHORS = 64
CHAIN = 2
PART_BYTES = 1 << 24  # text of neighbouring documents handled by one task
_FIELDS = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
           ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def common_words(docs: DataFrame, count: int = ANCHORS) -> np.ndarray:
    """Hashes of the ``count`` commonest words of all texts, ascending."""

    def tally(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, 1 << 24):
                own, n = np.unique(np.concatenate([hashed_words(d, w)[0] for _, d, w in chunks(part.column("text"))]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": own.view(np.int64), "n": n.astype(np.int64)})

    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tally, "hash long, n long")
            .groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(count).collect())
    return np.sort(np.array([r["hash"] for r in rows], np.int64).view(np.uint64))


def spot_set(text: str, anchors: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Signatures of a text, ascending; one of all its words if no chain is complete, none without words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words, _ = hashed_words(raw, np.array([0, len(raw)]))
    if not len(words):
        return words
    anchor = np.isin(words, anchors)
    content = np.append(words[~anchor], np.zeros(chain, np.uint64))
    at = np.flatnonzero(anchor)
    follow = (np.cumsum(~anchor))[at]  # content words before each anchor
    whole = follow + chain <= len(content) - chain
    at, follow = at[whole], follow[whole]
    if not len(at):
        return join_hashes(words, len(words))
    out = words[at]
    for i in range(chain):
        out = mix(out + content[follow + i] * np.uint64(2 * i + 3))
    return np.unique(out)


def fingerprint_text(spots: np.ndarray) -> str:
    return spots.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 if the lengths alone put it below ``least``; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited_text(text: str, after: str) -> str:
    """The text with its last quarter replaced by as many first characters of the next."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


def _order(doc: int | None, tie: int) -> tuple[bool, int, int]:
    """Null ids first, equal ones by the hash of their text."""
    return doc is not None, doc or 0, tie


def part_starts(keyed: DataFrame, most: int = PART_BYTES) -> list[tuple[bool, int, int]]:
    """Where parts of about ``most`` bytes begin in the order of ``doc_id`` and ``tie``: keys of rows, the first of all among them."""

    def begin(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = most, None
        for batch in read:
            found = []
            for doc, tie, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "size")), strict=True):
                if held >= most and (doc, tie) != last:
                    held = 0
                    found.append((doc, tie))
                held, last = held + size, (doc, tie)
            if found:
                docs, ties = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "tie": pa.array(ties, pa.int64())})

    sizes = keyed.select("doc_id", "tie", F.octet_length("text").alias("size")).repartitionByRange("doc_id", "tie")
    rows = sizes.sortWithinPartitions("doc_id", "tie").mapInArrow(begin, "doc_id long, tie long").collect()  # two numbers a part
    return sorted({_order(r["doc_id"], r["tie"]) for r in rows})


def fingerprints(docs: DataFrame, anchors: int = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of ``docs`` (``doc_id``, ``text``) and of their edited texts, each likened to the next document's.

    Null texts are empty; null ids come first; repeated ids follow in the order of a hash of their text; the last
    document's next is the first. Texts without words have the empty fingerprint. Other columns are left out; an empty table gives no rows.
    """
    common = common_words(docs, anchors)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
                        ).withColumn("tie", F.xxhash64("text"))
    starts = part_starts(keyed)

    def place(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for some in sliced(batch):
                keys = [*map(_order, some.column("doc_id").to_pylist(), some.column("tie").to_pylist())]
                parts = [bisect_right(starts, k) - 1 for k in keys]
                lead = [i for i, k in enumerate(keys) if starts[parts[i]] == k]
                at = pa.array([*range(len(keys)), *lead], pa.int64())
                sent = pa.array(parts + [(parts[i] - 1) % len(starts) for i in lead], pa.int32())
                after = pa.array([False] * len(keys) + [True] * len(lead))
                texts = packed(some.column("text"))
                yield pa.RecordBatch.from_pydict({"part": sent, "after": after, "doc_id": some.column("doc_id").take(at),
                                                  "tie": some.column("tie").take(at), "text": texts.take(at)})

    schema = pa.schema([(f, _ARROW[t]) for f, t in _FIELDS])

    def made(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in read:
            for some in sliced(batch, 1 << 20):
                rows = []
                for after, doc, raw in zip(some.column("after").to_pylist(), some.column("doc_id").to_pylist(), unpacked(some.column("text")), strict=True):
                    if after and last is None:
                        continue  # another row like the one that begins the next part
                    text = raw.decode()
                    spots = spot_set(text, common, chain)
                    if last is not None:
                        before, whole, own = last
                        edited = edited_text(whole, text)
                        other = spot_set(edited, common, chain)
                        rows.append((before, len(whole), hashlib.sha256(edited.encode()).hexdigest(), fingerprint_text(own),
                                     fingerprint_text(other), likeness(own, other), likeness(own, spots)))
                    last = None if after else (doc, text, spots)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # A part ends with the first row of the next, so what is made of it need not be kept.
    placed = (keyed.mapInArrow(place, "part int, after boolean, doc_id long, tie long, text binary").repartition(max(1, len(starts)), "part")
              .sortWithinPartitions("part", "after", "doc_id", "tie"))
    return placed.mapInArrow(made, ", ".join(f"{f} {t}" for f, t in _FIELDS))
