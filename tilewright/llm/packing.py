"""Packing token sequences into windows of near-equal length by multiway differencing.

A document's whole windows stand alone; what is left of it goes into a group. Each group is dealt into windows by
Karmarkar-Karp differencing: every piece starts as a partition of its own, and the two partitions with the widest
spread are merged, the fullest windows of one onto the emptiest of the other, until one partition is left. A group has
as many windows as its tokens need, and one more whenever the fullest would exceed its capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tilewright.llm.frames import sliced
from tilewright.llm.tokens import END_ID, encoder, tokenizer_path
from tilewright.llm.words import chunks

WINDOW = 4096
GROUP_WINDOWS = 48  # windows in a group
SLACK = 4  # tokens left free in each window of a full group, so that near-equal windows fit
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items into ``windows`` lists of near-equal sums by multiway differencing; gives item numbers."""
    heap = []
    for item, size in enumerate(sizes):
        heap.append((-size, item, [0] * (windows - 1) + [size], [()] * (windows - 1) + [((item,),)]))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, others, theirs = heapq.heappop(heap)
        merged = sorted(zip(map(int.__add__, sums, reversed(others)), range(windows)), key=lambda x: x[0])
        joined = [(held[i], theirs[windows - 1 - i]) for _, i in merged]
        low = merged[0][0]
        heapq.heappush(heap, (low - merged[-1][0], tick, [s for s, _ in merged], joined))
        tick += 1
    out: list[list[int]] = []
    for tree in (heap[0][3] if heap else [()] * windows):
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                items.append(node)
            else:
                stack.extend(node)
        out.append(sorted(items))
    return out


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as multiway differencing fits within ``capacity``."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, count)
        if max(sum(sizes[i] for i in items) for items in dealt) <= capacity:
            return [items for items in dealt if items]
        count += 1


class Packer:
    """Packs the documents of one task, a group at a time."""

    def __init__(self, window: int, group_windows: int, slack: int, first_sequence: int):
        self.window, self.full = window, group_windows * (window - min(slack, window - 1))
        self.sequence = first_sequence
        self.group: list[tuple[int | None, int, int, int, int]] = []  # id, start, length, crc32, tokens of the document
        self.held = 0
        self.rows: dict[str, list] = {name: [] for name in PIECES.names}

    def place(self, piece: tuple, offset: int) -> None:
        doc, start, length, crc, tokens = piece
        for name, value in zip(PIECES.names, (doc, start, length, crc, tokens, self.sequence, offset), strict=True):
            self.rows[name].append(value)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        tokens, at = len(ids), 0
        while tokens - at >= self.window:
            self.place((doc, at, self.window, zlib.crc32(ids[at:at + self.window].tobytes()), tokens), 0)
            self.sequence += 1
            at += self.window
        while at < tokens:
            length = min(tokens - at, self.full - self.held)
            self.group.append((doc, at, length, zlib.crc32(ids[at:at + length].tobytes()), tokens))
            self.held += length
            at += length
            if self.held == self.full:
                self.close()

    def close(self) -> None:
        if self.group:
            for items in windows_for([p[2] for p in self.group], self.window):
                offset = 0
                for i in items:
                    self.place(self.group[i], offset)
                    offset += self.group[i][2]
                self.sequence += 1
            self.group, self.held = [], 0

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.rows["doc_id"]:
            yield pa.RecordBatch.from_pydict(self.rows, schema=PIECES)
            self.rows = {name: [] for name in PIECES.names}


def pack_sequences(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID,
                   group_windows: int = GROUP_WINDOWS, slack: int = SLACK) -> DataFrame:
    """Pieces of all ``docs`` (``doc_id``, ``text``) in windows of at most ``window`` tokens.

    A document is its token ids and ``end_id``; null and empty texts are the end alone. Every id lies in exactly one
    piece. Rows that repeat are packed as often as they stand there, null ids stay null, other columns are left out,
    and an empty table gives no pieces. No shuffle: tasks pack what they read, and only the last group of a task can
    be loose.
    """
    path = tokenizer or tokenizer_path()

    def pack(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(window, group_windows, slack, (context.partitionId() if context else 0) << 33)
        end = np.array([end_id], np.uint32)
        for batch in read:
            for part in sliced(batch):
                docs_of = part.column("doc_id").to_pylist()
                for row, data, where in chunks(part.column("text")):
                    ids, bounds = encoder(path).encode(data, where)
                    for i in range(len(where) - 1):
                        packer.add(docs_of[row + i], np.concatenate([ids[bounds[i]:bounds[i + 1]], end]).astype("<u4"))
                    yield from packer.taken()
        packer.close()
        yield from packer.taken()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
