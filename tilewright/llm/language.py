"""Language-model scores from a log-frequency Bloom filter.

The filter holds each pair of neighbouring tokens once for each level of its count, levels doubling. A count is read by
probing level after level until one is missing, as the least count of its level. The first level has enough probes that a
pair which was never seen is hardly ever found; a pair that was seen may be read too high, and is then read so everywhere.

With ``q`` the count read for a pair, ``Q`` the sum of those of all pairs seen after the first token, ``c`` the count of the first token
and ``L = max(c - Q, 0) + PRIOR``, the second token follows with probability ``(q + L * p) / (Q + L)``, where ``p`` is its smoothed share
of all tokens. This sums to 1 over all tokens and one unknown, but for pairs found that were never seen.

The filter is built in shards of pairs, each by one task, and grows with the corpus. A small model is broadcast: piece by piece, so
that the driver holds one piece. A Python worker holds one piece at a time, read from the file in which its executor keeps it; a chunk
of texts asks every piece once. Asked to keep fewer shards or words at hand than there are, this takes passes over the texts, as scores
are sums over tokens; the number of passes would grow with the corpus.

A larger model stays where it is and the texts ask it: a slice of texts sends its distinct pairs to the tasks that hold their shards and its
distinct words to those that hold their part of the vocabulary, and gets a byte for a pair and two counts for a word. The texts are
tokenized once, so the work grows with the corpus and memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.frames import packed, sliced, stored, unpacked
from tilewright.llm.words import chunks, hashed_words, join_hashes, mix, mixed

PROBES = (4, 1)  # words of 64 bits looked at on the first level and on each further one, seven bits in each
BITS = (40, 10)  # for each entry of the first level and of each further one; half of all bits are set
LEVELS = 60
LEAST = np.array([0, *(1 << level for level in range(LEVELS - 1))], np.int64)  # count of each level
PRIOR = 20.0  # weight of the single token against the pair
SHARD_TOKENS = 1 << 20
SHARDS_AT_ONCE = 64  # 5 MB each at most
BROADCAST_SHARDS = 8  # the most shards of a model that is broadcast unasked
WORDS_AT_ONCE = 1 << 22  # 24 bytes each
SHARDS_SENT = 8  # in one piece
WORDS_SENT = 1 << 19  # in one piece
SLICE_BYTES = 1 << 23  # texts that ask together
ANSWERED_PAIRS = 1 << 17  # looked up together
HELD = -1  # slice number of what is asked, which so stands before those that ask it
END = mixed(0x656E64)


def tokens(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends of a chunk, and the number of tokens before each row (and after the last)."""
    hashes, first = hashed_words(data, where)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def contexts_of(hashes: np.ndarray) -> np.ndarray:
    """The token before each; what is before a text is an end."""
    return np.concatenate([[END], hashes[:-1]]).astype(np.uint64)


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    return join_hashes(np.concatenate([[END], hashes]).astype(np.uint64), 2)


def _some_bits(count: int, seed: int) -> np.ndarray:
    """65,536 words with ``count`` bits each, or fewer where two fall together."""
    at = mix(np.arange(seed << 20, (seed << 20) + (count << 16), dtype=np.uint64)) & np.uint64(63)
    return np.bitwise_or.reduce((np.uint64(1) << at).reshape(-1, count), axis=1)


_FOUR, _THREE = _some_bits(4, 1), _some_bits(3, 2)


class LogBloom:
    """Bloom filters of counted hashes, one after the other in ``words``; each has a first word and a number of words."""

    def __init__(self, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        self.words, self.begins, self.sizes = words, begins, sizes

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> LogBloom:
        levels = np.frexp(counts.astype(float))[1]  # 1 for 1, 2 for 2 and 3, 3 for 4 to 7
        size = 1 + (len(hashes) * BITS[0] + int((levels - 1).sum()) * BITS[1]) // 64
        out = cls(np.zeros(size, np.uint64), np.zeros(1, np.int64), np.array([size], np.uint64))
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = hashes[levels >= level]
            for at, bits in out.places(own, np.zeros(len(own), np.int64), level):
                np.bitwise_or.at(out.words, at, bits)
        return out

    @classmethod
    def joined(cls, filters: list[bytes | bytearray]) -> LogBloom:
        lengths = np.array([len(f) // 8 for f in filters], np.int64)
        return cls(np.frombuffer(b"".join(filters), np.uint64), np.cumsum(lengths) - lengths, lengths.astype(np.uint64))

    def places(self, hashes: np.ndarray, which: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The words to look at, and the bits that are set in them."""
        own = mix(hashes ^ mixed(level))
        size, begin = self.sizes[which], self.begins[which]
        low, half = np.uint64(0xFFFF), np.uint64(32)
        for probe in range(PROBES[level > 1]):
            if probe:
                own = mix(own + mixed(probe))
            at = begin + ((own >> half) * size >> half).astype(np.int64)
            yield at, _FOUR[own & low] | _THREE[own >> np.uint64(16) & low]

    def levels(self, hashes: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """The level that each hash is read on in its filter; 0 for none."""
        which = np.zeros(len(hashes), np.int64) if which is None else which
        out, left = np.zeros(len(hashes), np.uint8), np.arange(len(hashes))
        for level in range(1, LEVELS):
            if not len(left):
                break
            found = np.ones(len(left), bool)
            for at, bits in self.places(hashes[left], which[left], level):
                found &= self.words[at] & bits == bits
            left = left[found]
            out[left] = level
        return out

    def counts(self, hashes: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Least count of the level that each hash is read on in its filter; 0 for none."""
        return LEAST[self.levels(hashes, which)]


def read_anew(piece: Broadcast):
    """Value of a piece that the worker does not keep; an encrypted piece has no file of its own and is kept."""
    path = getattr(piece, "_path", None)
    return piece.value if path is None or hasattr(piece, "_value") else piece.load_from_path(path)


class SentFilters:
    """Pieces of the filter, each broadcast by itself."""

    def __init__(self, pieces: list[Broadcast], shards: int):
        self.pieces, self.shards = pieces, shards

    def counts(self, hashes: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """What ``LogBloom.counts`` gives of all pieces joined; ``which`` counts shards from the first of the pass."""
        which = np.zeros(len(hashes), np.int64) if which is None else which
        out = np.zeros(len(hashes), np.int64)
        for piece in self.pieces:
            held, bloom = read_anew(piece)
            place = np.full(self.shards, -1, np.int64)
            place[held] = np.arange(len(held))
            some = np.flatnonzero(place[which] >= 0)
            out[some] = bloom.counts(hashes[some], place[which[some]])
        return out

    def destroy(self) -> None:
        for piece in self.pieces:
            piece.destroy()


class SentWords:
    """Pieces of a part of the vocabulary, each broadcast by itself: sorted hashes with ``c`` and ``q``."""

    def __init__(self, pieces: list[Broadcast], parts: int):
        self.pieces, self.parts = pieces, parts

    def __getitem__(self, column: str) -> np.ndarray:
        """A column of all pieces; only small vocabularies are looked at like this."""
        return np.concatenate([piece.value[column] for piece in self.pieces])

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = hashes.view(np.int64)
        c, q = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        piece_of = np.mod(own, self.parts * len(self.pieces)) // self.parts
        for i, piece in enumerate(self.pieces):
            words = read_anew(piece)
            if not len(words["hash"]):
                continue
            some = np.flatnonzero(piece_of == i)
            at = np.minimum(np.searchsorted(words["hash"], own[some]), len(words["hash"]) - 1)
            hit = words["hash"][at] == own[some]
            c[some], q[some] = np.where(hit, words["c"][at], 0), np.where(hit, words["q"][at], 0)
        return c, q

    def destroy(self) -> None:
        for piece in self.pieces:
            piece.destroy()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _counted(docs: DataFrame) -> DataFrame:
    """``hash`` and ``c`` of tokens, counted within batches."""

    def count(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, 1 << 23):
                all_of = [tokens(data, where)[0] for _, data, where in chunks(part.column("text"))]
                own, n = np.unique(np.concatenate(all_of), return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": own.view(np.int64), "c": n.astype(np.int64)})

    return _texts(docs).mapInArrow(count, "hash long, c long")


def _pairs(docs: DataFrame, shards: int) -> DataFrame:
    """For each slice of texts and each shard one row: first tokens, ascending, how many pairs each begins, the pairs and their counts."""

    def pack(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, 1 << 23):
                seen = [tokens(data, where)[0] for _, data, where in chunks(part.column("text"))]
                hashes = np.concatenate(seen)
                pairs, at, n = np.unique(pair_hashes(hashes), return_index=True, return_counts=True)
                before, shard = contexts_of(hashes)[at], (pairs % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((before, shard))
                pairs, n, before, shard = pairs[order], n[order].astype(np.uint32), before[order], shard[order]
                edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                rows: dict[str, list] = {c: [] for c in ("shard", "firsts", "runs", "pairs", "counts")}
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)], strict=True):
                    firsts, runs = np.unique(before[a:b], return_counts=True)
                    held = (firsts, runs.astype(np.uint32), pairs[a:b], n[a:b])
                    for name, value in zip(rows, (int(shard[a]), *(v.tobytes() for v in held)), strict=True):
                        rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows)

    return _texts(docs).mapInArrow(pack, "shard long, firsts binary, runs binary, pairs binary, counts binary")


def _filters(rows: DataFrame, shards: int) -> DataFrame:
    """The filter of each shard, with the counts it gives for all its pairs summed by first token."""

    def made(shard: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        before, pairs, n = (np.concatenate(v) for v in zip(*held, strict=True))
        own, at, where = np.unique(pairs, return_index=True, return_inverse=True)
        bloom = LogBloom.of(own, np.bincount(where, n).astype(np.int64))
        firsts, where = np.unique(before[at], return_inverse=True)
        q = np.bincount(where, bloom.counts(own)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"shard": [shard], "bits": [bloom.words.tobytes()], "firsts": [firsts.tobytes()], "q": [q.tobytes()]})

    def build(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in read:
            for i in range(batch.num_rows):
                now, firsts, runs, pairs, n = (batch.column(c)[i].as_py() for c in ("shard", "firsts", "runs", "pairs", "counts"))
                if held and now != shard:
                    yield made(shard, held)
                    held = []
                shard = now
                before = np.repeat(np.frombuffer(firsts, np.uint64), np.frombuffer(runs, np.uint32))
                held.append((before, np.frombuffer(pairs, np.uint64), np.frombuffer(n, np.uint32)))
        if held:
            yield made(shard, held)

    placed = rows.repartition(max(1, shards // 2), "shard").sortWithinPartitions("shard")
    return placed.mapInArrow(build, "shard long, bits binary, firsts binary, q binary")


def train(docs: DataFrame) -> dict:
    """The model of all ``docs``: a stored vocabulary with counts and stored shards of the filter. Both grow with ``docs``."""
    words = stored(_counted(docs).groupBy("hash").agg(F.sum("c").alias("c")), "words")
    known, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    shards = max(1, -(-total // SHARD_TOKENS))
    filters = stored(_filters(_pairs(docs, shards), shards), "filters")

    def summed(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for firsts, q in zip(batch.column("firsts"), batch.column("q"), strict=True):
                yield pa.RecordBatch.from_pydict({"hash": np.frombuffer(firsts.as_py(), np.int64), "q": np.frombuffer(q.as_py(), np.int64)})

    after = filters.select("firsts", "q").mapInArrow(summed, "hash long, q long").groupBy("hash").agg(F.sum("q").alias("q"))
    words = stored(words.join(after, "hash", "left").na.fill(0, ["q"]), "vocabulary")
    return {"words": words, "filters": filters, "known": known, "total": total, "shards": shards}


def passes(model: dict, shards_at_once: int, words_at_once: int) -> Iterator[tuple[dict, bool, bool]]:
    """What is at hand in each pass, and whether the pass is the first over all tokens and the first with its second tokens."""
    parts = max(1, -(-model["known"] // words_at_once))
    pieces = max(1, -(-min(words_at_once, model["known"]) // WORDS_SENT))
    send = model["words"].sparkSession.sparkContext.broadcast

    def piece_of(part: int, piece: int) -> dict[str, np.ndarray]:
        table = model["words"].where(F.pmod("hash", F.lit(parts * pieces)) == piece * parts + part).toArrow()  # about WORDS_SENT rows
        own = {c: table[c].to_numpy() for c in ("hash", "c", "q")}
        order = np.argsort(own["hash"])
        return {c: v[order] for c, v in own.items()}

    def words_of(part: int) -> SentWords:
        return SentWords([send(piece_of(part, piece)) for piece in range(pieces)], parts)

    def filters_of(group: int, count: int) -> SentFilters:
        rows = model["filters"].where(F.col("shard").between(group, group + count - 1)).select("shard", "bits")
        sent, held = [], {}
        for row in rows.toLocalIterator():
            held[row.shard - group] = row.bits
            if len(held) == min(SHARDS_SENT, count):
                sent.append(send((np.array([*held], np.int64), LogBloom.joined([*held.values()]))))
                held.clear()
        if held:
            sent.append(send((np.array([*held], np.int64), LogBloom.joined([*held.values()]))))
        return SentFilters(sent, count)

    for group in range(0, model["shards"], shards_at_once):
        count = min(shards_at_once, model["shards"] - group)
        bloom = filters_of(group, count)
        for i in range(parts):
            first = words_of(i)
            for j in range(parts):
                second = first if i == j else words_of(j)
                yield ({"parts": parts, "i": i, "j": j, "first": first, "second": second, "bloom": bloom, "shards": model["shards"],
                        "from": group, "until": group + count, "known": model["known"], "total": model["total"]},
                       group == i == j == 0, group == i == 0)
                if i != j:
                    second.destroy()
            first.destroy()
        bloom.destroy()


def _look(words: SentWords, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``c`` and ``q`` of each hash, 0 if unknown."""
    return words.look(hashes)


def chances(hand: dict, first: tuple[np.ndarray, np.ndarray], second: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Probability of each token after the one before it, from ``c`` and ``q`` of the first, ``c`` of the second and the pair."""
    own = hand["bloom"].counts(pairs, (pairs % np.uint64(hand["shards"])).astype(np.int64) - hand["from"])
    return _chances(hand, first, second, own)


def _chances(model: dict, first: tuple[np.ndarray, np.ndarray], second: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The same from the counts read for the pairs."""
    single = (second + 1) / (model["total"] + model["known"] + 1)
    c, all_of = first
    left = np.maximum(c - all_of, 0) + PRIOR
    return (np.minimum(own, all_of) + left * single) / (all_of + left)


def _slices(given: DataFrame) -> DataFrame:
    """Slices of texts, a row each: ids and folds, tokens before each text (and after the last), distinct hashes, place of each token in them."""

    def cut(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in read:
            for part in sliced(batch, SLICE_BYTES):
                seen = [tokens(data, where) for _, data, where in chunks(part.column("text"))]
                own, at = np.unique(np.concatenate([h for h, _ in seen]), return_inverse=True)
                first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in seen]))])
                yield pa.RecordBatch.from_pydict({
                    "slice": [task << 32 | made],
                    **{c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("doc_id", "held_out")},
                    "first": [first.astype(np.int64).tobytes()], "own": [thin(own)],
                    "at": packed(pa.array([at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()]))})
                made += 1

    return given.mapInArrow(cut, "slice long, doc_id array<long>, held_out array<boolean>, first binary, own binary, at binary")


def _own(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a slice and the place of each token in them."""
    at = np.frombuffer(unpacked(pa.array([row["at"]]))[0], np.uint8).reshape(4, -1)
    return whole(row["own"]), np.ascontiguousarray(at.T).view("<u4").ravel().astype(np.int64)


def thin(ascending: np.ndarray) -> bytes:
    """Ascending numbers as the bytes of their steps, all first bytes first; the bytes that are zero in every step are left out."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def whole(held: bytes) -> np.ndarray:
    """The numbers of ``thin``."""
    steps = np.frombuffer(held, np.uint8, offset=1).reshape(held[0], -1)
    out = np.zeros((steps.shape[1], 8), np.uint8)
    out[:, :held[0]] = steps.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Each once, ascending; sorting is faster here than the hash table of ``np.unique``."""
    own = np.sort(hashes)
    return own[np.append(True, own[1:] != own[:-1])]


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which hashes are asked, by part, and the part of each in this order."""
    part = (hashes % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # two bytes are sorted by radix
    order = np.argsort(part, kind="stable")
    return order, part[order].astype(np.int64)


def _asked(slices: DataFrame, parts: int, of_pairs: bool) -> DataFrame:
    """For each slice and part one row: the distinct pairs, or words, to be looked up there, divided by the number of parts."""

    def ask(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if of_pairs:
                    own, at = _own(row)
                    hashes = _distinct(pair_hashes(own[at]))
                else:
                    hashes = whole(row["own"])
                order, part = _dealt(hashes, parts)
                hashes = hashes[order] // np.uint64(parts)
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                ends = [*edges[1:].tolist(), len(part)]
                yield pa.RecordBatch.from_pydict({
                    "part": part[edges], "slice": np.full(len(edges), row["slice"], np.int64),
                    "held": pa.array([thin(hashes[a:b]) for a, b in zip(edges.tolist(), ends, strict=True)], pa.binary())})

    return slices.select("slice", "own", *["at"] * of_pairs).mapInArrow(ask, "part long, slice long, held binary")


def _word_parts(words: DataFrame, parts: int) -> DataFrame:
    """The vocabulary, a row for each part: hashes, ascending, their ``c`` and their ``q``."""

    def made(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        own = [table[c].to_numpy() for c in ("hash", "c", "q")]
        order = np.argsort(own[0].view(np.uint64))
        return pa.RecordBatch.from_pydict({"part": [part], "held": [b"".join(v[order].tobytes() for v in own)]})

    def pack(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in read:
            part = np.asarray(batch.column("part"))
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
                if b > a and held and now != part[a]:
                    yield made(now, held)
                    held = []
                if b > a:
                    now = int(part[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield made(now, held)

    # the part of a hash without its sign, as ``_dealt`` has it
    part = F.pmod(F.pmod("hash", F.lit(parts)) + F.when(F.col("hash") < 0, 2**64 % parts).otherwise(0), F.lit(parts))
    dealt = words.select(part.cast("long").alias("part"), "hash", "c", "q").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(pack, "part long, held binary")


def _filter_levels(held: bytes | None, asked: np.ndarray) -> np.ndarray:
    """The level of each pair in a shard."""
    return np.zeros(len(asked), np.uint8) if held is None else LogBloom.joined([held]).levels(asked)


def _word_counts(held: bytes | None, asked: np.ndarray) -> np.ndarray:
    """``c`` of all words asked for, then ``q``."""
    out = np.zeros((2, len(asked)), np.int64)
    if held is not None:
        own, *values = np.frombuffer(held, np.int64).reshape(3, -1)
        at = np.minimum(np.searchsorted(own.view(np.uint64), asked), len(own) - 1)
        hit = own.view(np.uint64)[at] == asked
        for row, value in zip(out, values, strict=True):
            row[hit] = value[at[hit]]
    return out


def _answers(held: DataFrame, asked: DataFrame, parts: int, reply, kind: int) -> DataFrame:
    """What each part says to each slice. What is held comes first, then each request by itself, so a task holds one part."""

    def said(part: int, value: bytes | None, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        own = [whole(body) for _, body in asked]
        ends = np.cumsum([len(v) for v in own])
        answers = reply(value, np.concatenate(own) * np.uint64(parts) + np.uint64(part))
        return pa.RecordBatch.from_arrays([pa.array([number for number, _ in asked], pa.int64()), pa.array([part] * len(asked), pa.int64()),
                                           packed(pa.array([v.tobytes() for v in np.split(answers, ends[:-1], axis=-1)], pa.binary()))],
                                          names=["slice", "part", "answer"])

    def answer(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, asked, size = None, None, [], 0
        for batch in read:
            for part, number, body in zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "held")), strict=True):
                if asked and (part != at or size >= ANSWERED_PAIRS << 3):
                    yield said(at, value, asked)
                    asked, size = [], 0
                if part != at:
                    at, value = part, None
                if number == HELD:
                    value = body
                else:
                    asked.append((number, body))
                    size += len(body)
        if asked:
            yield said(at, value, asked)

    both = held.select("part", F.lit(HELD).cast("long").alias("slice"), "held").unionByName(asked)
    dealt = both.repartition(max(1, parts // 2), "part").sortWithinPartitions("part", "slice")
    return dealt.mapInArrow(answer, "slice long, part long, answer binary").withColumn("kind", F.lit(kind))


def _asking_scores(given: DataFrame, model: dict) -> DataFrame:
    """The sums of each row, by asking the model where it lies."""
    shards, parts = model["shards"], max(1, -(-model["known"] // WORDS_SENT))
    slices = stored(_slices(given), "slices")
    levels = stored(_answers(model["filters"].select(F.col("shard").alias("part"), F.col("bits").alias("held")),
                             _asked(slices, shards, True), shards, _filter_levels, 1), "levels")
    counts = stored(_answers(_word_parts(model["words"], parts), _asked(slices, parts, False), parts, _word_counts, 2), "counts")
    known = {"total": model["total"], "known": model["known"]}

    def summed(row: dict, levels: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        own, at = _own(row)
        first = np.frombuffer(row["first"], np.int64)
        pairs, where = np.unique(pair_hashes(own[at]), return_inverse=True)
        q, (c, all_of) = np.zeros(len(pairs), np.int64), np.zeros((2, len(own)), np.int64)
        q[_dealt(pairs, shards)[0]] = LEAST[np.frombuffer(b"".join(levels), np.uint8)]
        order = _dealt(own, parts)[0]
        c[order], all_of[order] = np.concatenate([np.frombuffer(v, np.int64).reshape(2, -1) for v in counts], axis=1)
        before = np.append(np.searchsorted(own, END), at[:-1])
        values = np.stack([c[at] > 0, np.log10((c[at] + 1) / (known["total"] + known["known"] + 1)),
                           np.log10(_chances(known, (c[before], all_of[before]), c[at], q[where]))])
        hit, base_score, score = np.add.reduceat(values, first[:-1], axis=1)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": np.diff(first),
            "n_known": hit.astype(np.int64), "base_score": base_score, "score": score})

    def add(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, said = None, {}
        for batch in read:
            for i in range(batch.num_rows):
                now = batch.slice(i, 1).to_pylist()[0]
                if now["kind"] == 0:
                    if row is not None:
                        yield summed(row, said[1], said[2])
                    row, said = now, {1: [], 2: []}
                else:
                    said[now["kind"]] += unpacked(pa.array([now["answer"]]))
        if row is not None:
            yield summed(row, said[1], said[2])

    rows = slices.withColumn("kind", F.lit(0)).unionByName(levels, True).unionByName(counts, True)
    dealt = rows.repartition("slice").sortWithinPartitions("slice", "kind", "part")
    return dealt.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_scores(docs: DataFrame, model: dict, held_out: Column | None = None, shards_at_once: int | None = None,
                    words_at_once: int | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    A null text is empty, and an empty text is its end alone. Null ids stay null, repeated rows are scored alike, an empty training
    set knows no token and gives every token one chance in one. Other columns are left out. The passes run when this is called, or the
    questions are asked. A model of up to ``BROADCAST_SHARDS`` shards and ``WORDS_AT_ONCE`` words, or of any size where these are
    given, is broadcast.
    """
    out = F.lit(False) if held_out is None else held_out
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    train_tokens = F.lit(model["total"]).cast("long").alias("train_tokens")
    if shards_at_once is None and words_at_once is None and (model["shards"] > BROADCAST_SHARDS or model["known"] > WORDS_AT_ONCE):
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), text.alias("text"))
        return _asking_scores(given, model).select("doc_id", "held_out", "n_tokens", "n_known", train_tokens, "base_score", "score")
    shards_at_once, words_at_once = shards_at_once or SHARDS_AT_ONCE, words_at_once or WORDS_AT_ONCE
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.md5(text).alias("key"), text.alias("text"))
    sums = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.string()), *sums.items()])
    added = None
    for hand, first_of_all, first_of_word in passes(model, shards_at_once, words_at_once):
        def apply(read: Iterator[pa.RecordBatch], m=hand, count=first_of_all, base=first_of_word) -> Iterator[pa.RecordBatch]:
            lo, hi = m["from"], m["until"]
            for batch in read:
                for part in sliced(batch, 1 << 22):
                    rows = []
                    for _, data, where in chunks(part.column("text")):
                        hashes, first = tokens(data, where)
                        before, pairs, values = contexts_of(hashes), pair_hashes(hashes), np.zeros((3, len(hashes)))
                        # Words repeat, so each is looked up once; every text ends with an end, which is thus among them.
                        own, at = np.unique(hashes, return_inverse=True)
                        at_before = np.append(np.searchsorted(own, END), at[:-1])
                        first_c, first_q = _look(m["first"], own)
                        c = first_c if m["second"] is m["first"] else _look(m["second"], own)[0]
                        of_second = np.mod(hashes.view(np.int64), m["parts"]) == m["j"]
                        if base:
                            some = np.flatnonzero(of_second)
                            values[0, some] = c[at[some]] > 0
                            values[1, some] = np.log10((c[at[some]] + 1) / (m["total"] + m["known"] + 1))
                        shard = (pairs % np.uint64(m["shards"])).astype(np.int64)
                        some = np.flatnonzero((shard >= lo) & (shard < hi) & of_second & (np.mod(before.view(np.int64), m["parts"]) == m["i"]))
                        values[2, some] = np.log10(chances(m, (first_c[at_before[some]], first_q[at_before[some]]), c[at[some]], pairs[some]))
                        n = np.diff(first) if count else np.zeros(len(first) - 1, np.int64)
                        rows.append((n, *np.add.reduceat(values, first[:-1], axis=1)))
                    n, hit, base_score, score = (np.concatenate(v) for v in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "held_out", "key")]
                                                     + [pa.array(n), pa.array(hit.astype(np.int64)), pa.array(base_score), pa.array(score)], schema=schema)

        kinds = "doc_id long, held_out boolean, key string, n_tokens long, n_known long, base_score double, score double"
        # Rows that agree in id and text have one result, given as often as they stand.
        own = stored(given.mapInArrow(apply, kinds).groupBy("doc_id", "held_out", "key").agg(
            F.count("*").alias("copies"), *(F.min(c).alias(c) for c in sums)), "pass")
        added = own if added is None else added.unionByName(own)
    whole = added.groupBy("doc_id", "held_out", "key").agg(F.min("copies").cast("int").alias("copies"), *(F.sum(c).alias(c) for c in sums))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens,
                        "base_score", "score", F.expr("explode(array_repeat(1, copies)) AS copy")).drop("copy")
