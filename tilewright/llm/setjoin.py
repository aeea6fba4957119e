"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of shingles are joined without loss at a similarity of ``numer / 100``:

* Equal sets are one class; only classes go on.
* Sizes fall into bands whose bounds grow by ``100 / numer``, so linked sets lie in one band or in neighbours. A set
  joins the schemes of its own band and the next. In a scheme linked sets differ in at most ``H`` shingles.
* A scheme deals the universe of shingles into segments by hash. With ``H + 1 + spare`` segments, linked sets agree on
  more than ``spare`` of them, so each set leaves out its ``spare`` costliest ones, those whose signatures are the most
  frequent: the rarest common segment is then kept by both. Small sets take half as many segments with one-deletion
  neighbourhoods, whichever costs less.
* Signatures are cut to five bytes and dealt into buckets that grow in number with the corpus. Classes that share one are a group;
  groups of the same members are one. Signatures that very many sets have are dealt over all buckets.
* Every member of a group is first compared with the group's first. Groups that still hold several components are then
  compared whole, large ones in cells of two chunks, so that no task holds more than two chunks.
* A pair is compared by parities first: the cells of two sets' parities differ in no more places than the sets do, so no
  link is lost. What the parities leave is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.chosenpath import (
    CHUNK,
    SMALL,
    TABLE_CELLS,
    _node_runs,
    _same_ids,
    _with_components,
    cells,
    links_within,
    parts_of,
    set_key,
)
from tilewright.llm.components import components
from tilewright.llm.frames import opened, packing, sliced, stored, unpacked
from tilewright.llm.words import chunks, hashed_words, mix, mixed, shingle_sets

SKETCH_BITS = 18  # counters of the sketch of signature frequencies; any value gives the same links
BUCKET = 2_000_000  # signatures of a bucket, about
FREQUENT = 200_000  # a signature whose counter exceeds the mean by so many is dealt over all buckets
PIECE = 1024  # members of a group in one row
FILTER_BITS = 1 << 25  # of the filter of wanted ids, 4 MB; any number gives the same links
REST = np.uint64((1 << 40) - 1)  # what is kept of a signature within its bucket


def bands(numer: int, largest: int) -> list[int]:
    """Highest size of each band, from size 1 up."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // numer))
    return tops


def allocate(low: int, top: int, numer: int) -> tuple[int, int, int]:
    """Segments, spare ones and reach (2 with one-deletion neighbourhoods) of a scheme for sizes ``low`` to ``top``.

    The costs compared are kept signatures of a mean set, an empty segment counting as a hundred. Empty segments are the most
    frequent, so the spare ones cover them as far as they go, with two standard deviations.
    """
    differ = (100 - numer) * 2 * top // (100 + numer)
    spare = max(1, math.ceil((differ + 1) / 4)) if differ else 0
    exact = differ + 1 + spare
    halves = (differ + 2) // 2
    size = (low + top) / 2
    empty = exact * math.exp(-low / exact)
    cost_exact = exact - spare + 100 * max(0.0, empty + 2 * math.sqrt(empty) - spare)
    cost_halves = halves * (1 + 100 * math.exp(-low / halves)) + size
    return (halves, 0, 2) if cost_halves < cost_exact and differ else (exact, spare, 1)


class Signer:
    """Signatures of sets of shingle hashes."""

    def __init__(self, numer: int):
        self.numer, self.tops = numer, bands(numer, 64)

    def of(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Signatures of a set in each of its two schemes, with the number of spare ones."""
        if self.tops[-1] < len(own):
            self.tops = bands(self.numer, 2 * len(own))
        band = int(np.searchsorted(self.tops, len(own)))
        while len(self.tops) < band + 2:
            self.tops = bands(self.numer, 2 * self.tops[-1])
        for scheme in (band, band + 1):
            low = (self.tops[scheme - 2] if scheme > 1 else 0) + 1
            segments, spare, reach = allocate(low, self.tops[scheme], self.numer)
            salt = mixed(scheme + 1)
            at = (mix(own ^ salt) % np.uint64(segments)).astype(np.int64)
            values = mix(own + salt)
            sums = np.zeros(segments, np.uint64)
            np.add.at(sums, at, values)
            names = mix(np.arange(segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
            out = mix(sums ^ names)
            if reach == 2:
                out = np.unique(np.concatenate([out, mix((sums[at] - values) ^ names[at])]))
            yield out, spare


def _sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text as ascending 64-bit hashes."""
    for _, data, where in chunks(column):
        yield from shingle_sets(*hashed_words(data, where), words)


def described(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key`` and ``bits`` (both null for empty sets) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bits", pa.binary())])

    def describe(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in sliced(batch, 1 << 21):
                sets = list(_sets_of(part.column("text"), words))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([parities(s) if len(s) else None for s in sets], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        describe, "doc_id long, n_shingles long, key binary, bits binary")


def parities(own: np.ndarray) -> bytes:
    """For each of at least as many cells as shingles, whether an odd number of shingles falls into it.

    Cells in which two sets differ hold a shingle that only one of them has, so there are no more of them than such shingles.
    """
    cells = max(64, 1 << (len(own) - 1).bit_length())
    at = (mix(own + mixed(97)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(bool), bitorder="little").tobytes()


def folded(rows: list[bytes]) -> np.ndarray:
    """Parities as a matrix of the fewest cells of any row; halves add up where a row has more."""
    width = min(map(len, rows))
    out = np.empty((len(rows), width), np.uint8)
    for i, row in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(row, np.uint8).reshape(-1, width), axis=0)
    return out


def may_link(rows: list[bytes], sizes: np.ndarray, numer: int) -> np.ndarray:
    """Table of the pairs whose parities do not rule a link out; it never rules out a similar pair."""
    matrix, n = folded(rows), len(rows)
    agree = np.zeros((n, n))
    width = max(1, TABLE_CELLS // (8 * n))
    for at in range(0, matrix.shape[1], width):
        signs = np.unpackbits(matrix[:, at:at + width], axis=1).astype(np.float32) * 2 - 1
        agree += signs @ signs.T
    differ = (8 * matrix.shape[1] - agree) / 2
    return differ * (100 + numer) <= (sizes[:, None] + sizes[None, :]) * (100 - numer)


def set_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``id``, ``key`` and packed ``text`` of a document of each class, and of rows that repeat its id."""
    texts = packing(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return texts.join(classes.select("doc_id", "id", "key"), "doc_id").select("id", "key", "text")


def _sets(read: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Classes and their sets, batch by batch."""
    for batch in read:
        for part in opened(batch):
            sets = _sets_of(part.column("text"), words)
            # a repeated id may stand for other texts
            yield [(i, own) for i, key, own in zip(part.column("id").to_pylist(), part.column("key").to_pylist(), sets, strict=True)
                   if set_key(own) == key]


def sketch_of_counts(texts: DataFrame, words: int, numer: int) -> np.ndarray:
    """Sketch of how frequent signatures are; its size is fixed."""

    def count(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, total = Signer(numer), np.zeros(1 << SKETCH_BITS, np.int64)
        for sets in _sets(read, words):
            for _, own in sets:
                for signs, _ in signer.of(own):
                    np.add.at(total, (signs >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": used, "n": total[used]})

    def pack(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            yield pa.RecordBatch.from_pydict({c: pa.array([np.asarray(batch.column(c), np.int64).tobytes()], pa.binary())
                                              for c in ("at", "n")})

    total = np.zeros(1 << SKETCH_BITS, np.int64)
    packed = (texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
              .mapInArrow(pack, "at binary, n binary"))
    for row in packed.toLocalIterator():  # 2 ** SKETCH_BITS counters in all, at most
        total[np.frombuffer(row["at"], np.int64)] = np.frombuffer(row["n"], np.int64)
    return total


def dealt(texts: DataFrame, words: int, numer: int, buckets: int) -> DataFrame:
    """Kept signatures in packed rows: ``to`` (where the row goes), ``home`` (bucket), ``hot``, ``rests``, ``ids``."""
    sketch = sketch_of_counts(texts, words, numer)
    held, frequent = texts.sparkSession.sparkContext.broadcast(sketch), FREQUENT + sketch.mean()
    schema = pa.schema([("to", pa.int64()), ("home", pa.int64()), ("hot", pa.bool_()), ("rests", pa.binary()), ("ids", pa.binary()),
                        ("counts", pa.binary())])

    def packed(signs: np.ndarray, ids: np.ndarray, hot: bool) -> Iterator[tuple]:
        home, rest = signs % np.uint64(buckets), (signs // np.uint64(buckets)) & REST
        order = np.lexsort((rest, home)) if hot else np.lexsort((ids, home))
        home, rest, ids = home[order], rest[order], ids[order]
        new = (home[1:] != home[:-1]) | ((rest[1:] != rest[:-1]) if hot else False)
        edges = np.flatnonzero(np.concatenate([[True], new, [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = int(home[a])
            to = int(mix(np.array([home[a]]) ^ ids[a:a + 1].view(np.uint64))[0] % np.uint64(buckets)) if hot else at
            starts = np.flatnonzero(np.concatenate([[True], ids[a + 1:b] != ids[a:b - 1]]))
            counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
            yield (to, at, hot, rest[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), ids[a:b][starts].tobytes(), counts.tobytes())

    def sign(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, counts = Signer(numer), held.value
        own_signs: list[np.ndarray] = []
        own_ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            signs, ids = np.concatenate(own_signs), np.concatenate(own_ids)
            hot = counts[(signs >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > frequent
            rows = [r for flag in (False, True) if (hot == flag).any() for r in packed(signs[hot == flag], ids[hot == flag], flag)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                             schema=schema)
            own_signs.clear()
            own_ids.clear()

        for sets in _sets(read, words):
            for doc, own in sets:
                for signs, spare in signer.of(own):
                    if spare:
                        often = counts[(signs >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                        signs = signs[np.lexsort((signs, often))][:len(signs) - spare]
                    own_signs.append(signs)
                    own_ids.append(np.full(len(signs), doc, np.int64))
            if sum(map(len, own_signs)) > 1 << 20:
                yield from flush()
        if own_signs:
            yield from flush()

    return texts.mapInArrow(sign, "to long, home long, hot boolean, rests binary, ids binary, counts binary")


def groups(signs: DataFrame, buckets: int) -> DataFrame:
    """``path``, ``members`` and ``whole``: groups of several classes; large ones and parts of hot ones in pieces."""
    schema = pa.schema([("path", pa.int64()), ("members", pa.list_(pa.int64())), ("whole", pa.bool_())])

    def rows(rest: np.ndarray, ids: np.ndarray, home: int, hot: bool) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, rest))
        rest, ids = rest[order], ids[order]
        keep = np.concatenate([[True], (rest[1:] != rest[:-1]) | (ids[1:] != ids[:-1])])
        rest, ids = rest[keep], ids[keep]
        starts = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        sizes = np.diff(np.append(starts, len(rest)))
        path = mix(mix(rest[starts] + np.uint64(1)) ^ np.uint64(home)).view(np.int64)
        small = (sizes > 1) & (sizes <= SMALL) & (not hot)
        # of groups with the same members one goes on, named by them
        if small.any():
            names = np.stack([np.add.reduceat(mix(ids.view(np.uint64) + mixed(k)), starts) for k in (11, 12)], 1)[small]
            at = np.flatnonzero(small)[np.unique(names, axis=0, return_index=True)[1]]
            offsets = np.concatenate([[0], np.cumsum(sizes[at])])
            inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts[at], sizes[at])
            named = np.add.reduceat(mix(ids.view(np.uint64) + mixed(11)), starts)[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(named), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[inside])),
                pa.array(np.ones(len(at), bool))], schema=schema)
        for g in np.flatnonzero((sizes > SMALL) | hot).tolist():
            for a in range(int(starts[g]), int(starts[g] + sizes[g]), PIECE):
                b = min(a + PIECE, int(starts[g] + sizes[g]))
                yield pa.RecordBatch.from_arrays([pa.array(path[g:g + 1]), pa.array([ids[a:b]], pa.list_(pa.int64())),
                                                  pa.array([False])], schema=schema)

    def gather(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["home", "hot", "rests", "ids", "counts"]
        last, held = None, ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            yield from rows(np.concatenate(held[0]), np.concatenate(held[1]), *last)

        for batch in read:
            for home, hot, rests, ids, counts in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (home, hot) != last and held[0]:
                    yield from out()
                    held = ([], [])
                last = (home, hot)
                wide = np.zeros((len(rests) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(rests, np.uint8).reshape(-1, 5)
                held[0].append(wide.view(np.uint64).ravel())
                held[1].append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)))
        if held[0]:
            yield from out()

    return (signs.repartition(buckets, "to").sortWithinPartitions("home", "hot")
            .mapInArrow(gather, "path long, members array<long>, whole boolean"))


def near_pairs(pairs: DataFrame, classes: DataFrame, numer: int) -> DataFrame:
    """Those pairs ``a``, ``b`` that parities do not rule out."""

    def check(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            keep = [100 * min(m, n) >= numer * max(m, n) and bool(may_link([x, y], np.array([m, n]), numer)[0, 1])
                    for x, m, y, n in zip(*(batch.column(c).to_pylist() for c in "xmyn"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = lambda i, bits, n: classes.select(
        F.col("id").alias(i), F.col("bits").alias(bits), F.col("n_shingles").alias(n))
    return (pairs.join(one("a", "x", "m"), "a").join(one("b", "y", "n"), "b").select("a", "b", "x", "m", "y", "n")
            .mapInArrow(check, "a long, b long"))


def clusters(nodes: DataFrame, numer: int) -> DataFrame:
    """``cluster`` and ``id`` of what may hang together in each bounded node (``path``, ``id``, ``component``, ``bits``, ``n_shingles``).

    Classes of one component are not compared. Clusters of the same members have one name.
    """
    schema = pa.schema([("path", pa.int64()), ("id", pa.int64())])

    def compare(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for ids, bits, sizes, parts in _node_runs(read, ["id", "bits", "n_shingles", "component"]):
            ids, first = np.unique(np.array(ids, np.int64), return_index=True)
            sizes, parts = np.array(sizes)[first], np.array(parts, np.int64)[first]
            if len(ids) < 2 or (parts == parts[0]).all():
                continue
            near = may_link([bits[i] for i in first.tolist()], sizes, numer)
            label = parts_of(near & (parts[:, None] != parts[None, :]))
            names, count = np.unique(label, return_counts=True)
            for name in names[count > 1].tolist():
                members = ids[label == name]
                key = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
                out[0].extend([key] * len(members))
                out[1].extend(members.tolist())
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
                out = ([], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return (nodes.repartition("path").sortWithinPartitions("path").select("path", "id", "bits", "n_shingles", "component")
            .mapInArrow(compare, "path long, id long").dropDuplicates(["path", "id"]).withColumnRenamed("path", "cluster"))


def wanted(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose ``id`` may be one of ``members``: all that are, and few others.

    Texts are much larger than ids, so those that no cluster asks for are left out before texts are dealt. The filter has a fixed
    size and is broadcast; it lets more pass as ids outgrow it.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    held = (members.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("held")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("held", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = (F.bitmap_bucket_number(place) == F.col("bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return texts.join(F.broadcast(held), met, "left_semi")


def confirmed(texts: DataFrame, members: DataFrame, words: int, numer: int) -> DataFrame:
    """Links ``a``, ``b`` that connect what similar pairs of full sets connect in each cluster (``cluster``, ``id``).

    Texts travel packed, not sets, which take more room; a cluster has no more members than two chunks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _node_runs(read, ["id", "key", "text"]):
            own = {}
            whole = pa.array(unpacked(pa.array(texts, pa.binary())), pa.large_binary())
            for i, key, one in zip(ids, keys, _sets_of(whole, words), strict=True):
                if set_key(one) == key:  # a repeated id may stand for other texts
                    own[i] = one
            names = list(own)
            pairs = links_within(list(own.values()), numer) if len(own) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([names[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    met = wanted(texts, members).join(members, "id").select(F.col("cluster").alias("path"), "id", "key", "text")
    return met.repartition("path").sortWithinPartitions("path", "id").mapInArrow(link, "a long, b long")


def _links(docs: DataFrame, classes: DataFrame, words: int, numer: int) -> DataFrame:
    """Links ``a``, ``b`` between classes that connect what similar pairs connect."""
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // (2 * BUCKET))
    texts = stored(set_texts(docs, classes), "texts")
    met = stored(groups(dealt(texts, words, numer, buckets), buckets), "groups")
    # Each member with the first of its group; of several firsts the smallest that parities allow.
    star = met.select(F.col("members")[0].alias("a"), F.explode("members").alias("b")).where("a != b").distinct()
    parent = stored(near_pairs(star, classes, numer).groupBy("b").agg(F.min("a").alias("a")), "parents")
    chunked = parent.join(parent.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts")), "a")
    cluster = F.xxhash64("a", F.pmod(F.xxhash64("b", F.lit(9)), "parts"))
    members = chunked.select(cluster.alias("cluster"), F.explode(F.array("a", "b")).alias("id")).distinct()
    links = stored(confirmed(texts, stored(members, "members"), words, numer), "links")
    found = stored(components(links), "components")
    # Groups that still hold several components are compared whole.
    each = met.select("path", "whole", F.explode("members").alias("id")).distinct()
    small = each.where("whole").join(found, "id", "left").select("path", "id", F.coalesce("component", "id").alias("component"))
    several = small.groupBy("path").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    large = _with_components(each.where("not whole").select("path", "id"), found)
    nodes = small.join(several.select("path"), "path").unionByName(
        cells(large.where("n_minor > 0")).select("path", "id", "component"))
    about = classes.select("id", "bits", "n_shingles")
    rest = stored(clusters(nodes.join(about, "id"), numer), "clusters")
    return links.unionByName(confirmed(texts, rest, words, numer))


def ngram_components(docs: DataFrame, words: int = 5, numer: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs`` (``doc_id``, ``text``).

    Two rows link when ``100 * intersection >= numer * union`` of their distinct shingles. Fewer than ``words`` words are one shingle;
    null texts and texts without words have no shingles and link with nothing. Rows with a null id link with nothing and
    have a null component. Rows of one id belong together whatever their texts. Texts are whole. Other columns are
    left out, whatever their names; an empty table gives no rows.
    """
    rows = stored(described(docs, words), "described")
    usable = rows.where("doc_id is not null and key is not null")
    # the first half of the key is a class's number
    number = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    classes = stored(usable.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "bits")).alias("one"))
                     .select(number.alias("id"), "key", "one.*"), "classes")
    found = components(stored(_links(docs, classes, words, numer).unionByName(_same_ids(usable, number)), "links"))
    named = classes.select("id", "key", "doc_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "component").select("key", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "key").join(labels, "key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"))
