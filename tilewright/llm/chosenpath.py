"""Near-duplicate documents by a chosen-path set similarity join.

Every distinct set of shingles is a class with a sketch of ``SKETCH`` minwise tokens. The classes are the root of ``trees``
independent trees. A node chooses ``FORK`` of the token positions by a hash of its path; each of its classes goes on into one child
for each chosen position, named by the token it has there, so similar sets keep meeting in some child and others part.

* A small node is compared exhaustively: sketches first, in numpy, with a margin of ``MARGIN`` standard deviations below the
  threshold. What hangs together by sketch is a *cluster*; all pairs of a cluster are then compared on the full sets, and
  the cluster hands on what is connected, at most one row less than members.
* In a large node every class is first compared, on full sets, with a few pivots of the node. Classes of one component need
  no more comparisons with one another: the node is done when it holds a single component, compared exhaustively when
  few pairs across components are left, and branches otherwise. After ``DEPTH`` levels what is left is
  compared exhaustively whatever its size, in cells of two chunks of the node, so that no task holds more than two chunks.

Two sets of similarity ``s`` part in all children of a node with probability ``(1 - s) ** FORK``; the number of trees
follows from that, as a branching process, and from the wanted recall. Links are always confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.frames import sliced, stored
from tilewright.llm.words import join_hashes, mix, mixed

SKETCH = 64  # minwise tokens of a class
FORK = 2  # token positions that a node chooses
SMALL = 256  # classes of a node that are compared exhaustively at once
CHUNK = 1024  # classes of a chunk of a larger node
PIVOTS = 3  # classes of a large node that all others of the node are compared with
CROSS = 4_000_000  # pairs across components of a large node that are compared exhaustively
DEPTH = 6  # levels of branching
MARGIN = 4.0  # standard deviations of a sketch's estimate
RECALL = 0.9999  # of links at the threshold
KNOWN_WORDS = 500_000  # words whose hashes a task keeps
TABLE_CELLS = 1 << 22  # cells of a table of sets and shingles that is multiplied at once

_STEPS = np.array([int(mixed(i + 101)) | 1 for i in range(SKETCH)], np.uint64)


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """Trees that meet the recall for pairs at the threshold, ``DEPTH`` levels deep."""
    lost = 0.0
    for _ in range(DEPTH):
        lost = (1 - threshold + threshold * lost) ** FORK
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


class Shingler:
    """Distinct shingles of texts as ascending 64-bit hashes, from cryptographic hashes of the words."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def hash(self, word: bytes) -> int:
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        return self.known.setdefault(word, int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))

    def of(self, text: str | None) -> np.ndarray:
        known, new = self.known, self.hash
        words = (text or "").encode().lower().split()
        values = [known.get(w) for w in words]
        if None in values:
            values = [new(w) if v is None else v for w, v in zip(words, values, strict=True)]
        hashes = np.array(values, np.uint64)
        return np.unique(join_hashes(hashes, min(self.words, len(hashes)))) if len(hashes) else hashes


def set_key(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minwise tokens for each set that is not empty."""
    out = np.empty((len(sets), SKETCH), np.uint32)
    if sets:
        whole = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        for j, step in enumerate(_STEPS):
            out[:, j] = mix(np.minimum.reduceat(whole * step, starts)) >> np.uint64(32)
    return out


def described(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key`` and ``sketch`` (null for empty sets) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])

    def describe(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in read:
            for part in sliced(batch, 1 << 21):
                sets = [shingler.of(t.as_py()) for t in part.column("text")]
                rows = iter(sketches([s for s in sets if len(s)]))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        describe, "doc_id long, n_shingles long, key binary, sketch binary")


def _of(column: pa.Array) -> np.ndarray:
    """Sketches of a column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def branched(rows: DataFrame, trees: int | None = None) -> DataFrame:
    """``path`` and ``id`` of each row of ``path``, ``id``, ``sketch`` in its children; roots of ``trees`` trees without ``path``."""
    schema = pa.schema([("path", pa.int64()), ("id", pa.int64())])

    def branch(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            tokens, ids = _of(batch.column("sketch")).astype(np.uint64), np.asarray(batch.column("id"), np.int64)
            if trees is None:
                starts = [np.asarray(batch.column("path"), np.int64).view(np.uint64)]
            else:
                starts = [np.full(len(ids), mixed(7 * t + 1), np.uint64) for t in range(trees)]
            for path in starts:
                first = mix(path) % np.uint64(SKETCH)
                # the other positions stand at a step that is odd, so all of them differ
                step = (mix(path + np.uint64(1)) % np.uint64(SKETCH)) | np.uint64(1)
                for k in range(FORK):
                    at = (first + np.uint64(k) * step) % np.uint64(SKETCH)
                    token = tokens[np.arange(len(ids)), at.astype(np.int64)]
                    child = mix(mix(path ^ (at << np.uint64(32))) + token)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids)], schema=schema)

    return rows.select(*([] if trees else ["path"]), "id", "sketch").mapInArrow(branch, "path long, id long")


def alike(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which rows of two sketch matrices agree in ``least`` positions."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for j in range(SKETCH):
        equal += a[:, j, None] == b[None, :, j]
    return equal >= least


def least_equal(numer: int) -> int:
    """Equal positions from which two sketches may belong to similar sets."""
    s = numer / 100
    return max(1, math.floor(SKETCH * (s - MARGIN * math.sqrt(s * (1 - s) / SKETCH))))


def parts_of(near: np.ndarray) -> np.ndarray:
    """For each thing the first thing it is connected with, out of a symmetric table of neighbours."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] >= 0:
            continue
        new = np.array([i])
        while len(new):
            label[new] = i
            new = np.flatnonzero(near[new].any(0) & (label < 0))
    return label


def _node_runs(read: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """Rows of one ``path`` after the other, column by column; rows come sorted by it."""
    held: list[list] = [[] for _ in columns]
    last = None
    for batch in read:
        for path, *row in zip(*(batch.column(c).to_pylist() for c in ["path", *columns]), strict=True):
            if path != last and held[0]:
                yield held
                held = [[] for _ in columns]
            last = path
            for column, value in zip(held, row, strict=True):
                column.append(value)
    if held[0]:
        yield held


def clusters(nodes: DataFrame, numer: int) -> DataFrame:
    """``cluster`` and ``id`` of what hangs together by sketch in each bounded node (``path``, ``id``, ``sketch``, ``component``).

    Classes of one component are not compared. Clusters of the same members have one name.
    """
    schema = pa.schema([("path", pa.int64()), ("id", pa.int64())])
    least = least_equal(numer)

    def compare(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for ids, rows, parts in _node_runs(read, ["id", "sketch", "component"]):
            if len(ids) < 2:
                continue
            ids, first = np.unique(np.array(ids, np.int64), return_index=True)
            matrix = np.frombuffer(b"".join(rows), np.uint32).reshape(-1, SKETCH)[first]
            parts = np.array([ids[k] if parts[at] is None else parts[at] for k, at in enumerate(first.tolist())])
            label = parts_of(alike(matrix, matrix, least) & (parts[:, None] != parts[None, :]))
            names, sizes = np.unique(label, return_counts=True)
            for name in names[sizes > 1].tolist():
                members = ids[label == name]
                key = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
                out[0].extend([key] * len(members))
                out[1].extend(members.tolist())
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
                out = ([], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return (nodes.repartition("path").sortWithinPartitions("path").select("path", "id", "sketch", "component")
            .mapInArrow(compare, "path long, id long").dropDuplicates(["path", "id"]).withColumnRenamed("path", "cluster"))


def cells(nodes: DataFrame) -> DataFrame:
    """Nodes of any size (``path``, ``id``, ``component``, ``largest``, ``n_major``, ``n_minor``) as bounded ones.

    The classes of the node's largest component are dealt into major chunks, the others into minor ones. A cell is a minor
    chunk with any other chunk; two major chunks hold one component and need no cell.
    """
    minor = F.col("component") != F.col("largest")
    counts = {k: F.greatest(F.ceil(F.col(f"n_{k}") / CHUNK), F.lit(1)).cast("long") for k in ("major", "minor")}
    own = F.when(minor, F.pmod(F.xxhash64("id", F.lit(5)), counts["minor"])).otherwise(F.pmod(F.xxhash64("id", F.lit(6)), counts["major"]))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda kind, a, b: F.xxhash64("path", F.lit(kind), a, b)
    others = F.when(minor, F.concat(
        F.transform(upto(counts["minor"]), lambda j: pair("minor", F.least("own", j), F.greatest("own", j))),
        F.transform(upto(counts["major"]), lambda i: pair("both", i, F.col("own"))),
    )).otherwise(F.transform(upto(counts["minor"]), lambda j: pair("both", F.col("own"), j)))
    return nodes.withColumn("own", own).select(F.explode(others).alias("path"), "id", "component")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``id`` and ``shingles`` of the classes ``id``, ``doc_id``, ``key`` from the text of one of their documents."""

    def build(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in read:
            for part in sliced(batch, 1 << 21):
                ids, rows = [], []
                for i, key, text in zip(*(part.column(c) for c in ("id", "key", "text")), strict=True):
                    own = shingler.of(text.as_py())
                    if set_key(own) == key.as_py():  # a repeated id may stand for other texts
                        ids.append(i.as_py())
                        rows.append(own.tobytes())
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "shingles": pa.array(rows, pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(wanted, "doc_id").select("id", "key", "text").mapInArrow(
        build, "id long, shingles binary").dropDuplicates(["id"])


def similar(a: np.ndarray, b: np.ndarray, numer: int) -> bool:
    if 100 * min(len(a), len(b)) < numer * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= numer * (len(a) + len(b) - both)


def pair_links(pairs: DataFrame, sets: DataFrame, numer: int) -> DataFrame:
    """Those pairs ``a``, ``b`` whose full sets are similar enough."""

    def check(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), numer)
                    for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(k), F.col("shingles").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def cluster_links(members: DataFrame, sets: DataFrame, numer: int) -> DataFrame:
    """``a``, ``b`` that connect what similar pairs of full sets connect in each cluster, one less than members at most."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _node_runs(read, ["id", "shingles"]):
            pairs = links_within([np.frombuffer(r, np.uint64) for r in rows], numer)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    met = members.join(sets, "id").select(F.col("cluster").alias("path"), "id", "shingles")
    return met.repartition("path").sortWithinPartitions("path", "id").mapInArrow(link, "a long, b long")


def links_within(sets: list[np.ndarray], numer: int) -> list[tuple[int, int]]:
    """For each set but the first of those it is connected with by similar pairs, that first one and itself.

    Shingles of a single set cannot be common. The others are the columns of a table of sets, whose product with itself,
    block by block, counts the common shingles of all pairs.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    mask = shared[column]
    owner, column = owner[mask], place[column[mask]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n))
    width = max(1, TABLE_CELLS // n)
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        table = np.zeros((n, width), np.float32)
        table[owner[lo:hi], column[lo:hi] - start] = 1
        both += table @ table.T
    near = 100 * both >= numer * (sizes[:, None] + sizes[None, :] - both)
    return [(first, i) for i, first in enumerate(parts_of(near).tolist()) if first != i]


def near_duplicates(docs: DataFrame, words: int = 5, numer: int = 80, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs`` (``doc_id``, ``text``).

    Two rows link when ``100 * intersection >= numer * union`` of their distinct ``words``-word shingles, A to Z as small letters;
    fewer words are one shingle. ``component_id`` is the smallest id reached by links, ``kept`` whether that is the row's own.

    Null texts and texts without words have no shingles and link with nothing. Rows with a null id link with nothing, have a
    null component and are kept. Rows of one id belong together whatever their texts; rows that repeat are all
    kept or all not. Texts are whole. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    rows = stored(described(docs, words), "described")
    usable = rows.where("doc_id is not null and key is not null")
    # the first half of the key is a class's number
    number = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    classes = stored(usable.groupBy("key").agg(F.min(F.struct("doc_id", "sketch")).alias("one"))
                     .select(number.alias("id"), "key", "one.doc_id", "one.sketch"), "classes")
    found = components(stored(_links(docs, classes, words, numer, recall).unionByName(_same_ids(usable, number)), "links"))
    named = classes.select("id", "key", "doc_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "component").select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key").join(labels, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _same_ids(usable: DataFrame, number) -> DataFrame:
    """Links between the classes of one id."""
    own = usable.select("doc_id", number.alias("id"))
    ends = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    return own.join(ends, "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct()


def _links(docs: DataFrame, classes: DataFrame, words: int, numer: int, recall: float) -> DataFrame:
    """Links ``a``, ``b`` between classes that connect what similar pairs connect."""
    sketched = classes.select("id", "sketch")
    paths = branched(sketched, trees_for(numer / 100, recall))
    small, large = _by_size(paths)
    tight, todo, links = None, [small.select("path", "id", F.lit(None).cast("long").alias("component"))], []
    if not large.isEmpty():
        sets = stored(full_sets(docs, classes.join(large.select("id").distinct(), "id", "left_semi"), words), "sets")
        links.append(stored(pair_links(_with_pivots(large), sets, numer), "links"))
        tight = stored(components(links[0]), "components")
    for level in range(DEPTH):
        if large.isEmpty():
            break
        node = _with_components(large, tight)
        mixed_up = node.where("n_major < n")
        ready = F.lit(True) if level == DEPTH - 1 else F.col("pairs") <= CROSS
        todo.append(cells(mixed_up.where(ready)))
        small, large = _by_size(branched(mixed_up.where(~ready).join(sketched, "id")))
        todo.append(small.join(tight, "id", "left").select("path", "id", "component"))
    nodes = todo[0]
    for more in todo[1:]:
        nodes = nodes.unionByName(more)
    members = stored(clusters(nodes.join(sketched, "id"), numer), "clusters")
    sets = stored(full_sets(docs, classes.join(members.select("id").distinct(), "id", "left_semi"), words), "sets")
    out = cluster_links(members, sets, numer)
    return out.unionByName(links[0]) if links else out


def _by_size(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of nodes with several classes, small and large nodes apart: ``path``, ``id``, ``n``."""
    sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    nodes = stored(paths.join(sizes, "path"), "nodes")
    return nodes.where(F.col("n") <= SMALL), nodes.where(F.col("n") > SMALL)


def _with_pivots(large: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of a node's pivots, drawn by hash, with the classes of the node."""
    drawn = large.groupBy("path").agg(F.array_distinct(F.array(*[
        F.min(F.struct(F.xxhash64("path", "id", F.lit(k)).alias("draw"), "id"))["id"] for k in range(PIVOTS)])).alias("pivots"))
    pairs = large.join(drawn, "path").select(F.explode("pivots").alias("p"), "id").where("p != id")
    return pairs.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()


def _with_components(large: DataFrame, found: DataFrame) -> DataFrame:
    """Classes of large nodes with their component, the node's largest one, its size and the pairs across components."""
    node = large.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = node.groupBy("path", "component").agg(F.count("*").alias("size"))
    totals = each.groupBy("path").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("all"),
                                      F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    about = totals.select("path", F.col("most.component").alias("largest"), F.col("most.size").alias("n_major"),
                          (F.col("all") - F.col("most.size")).alias("n_minor"),
                          ((F.col("all").cast("double") * F.col("all") - F.col("squares")) / 2).alias("pairs"))
    return node.join(about, "path")
