"""License scans by conditional compression.

A candidate block is a line with a word that license notices use. It is compressed alone and with each template as
a raw zstandard dictionary; templates are ranked by how much smaller that makes it, and the best are confirmed by the words that differ.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.frames import sliced

# Short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CANDIDATE = re.compile(r"licen[sc]|redistribut|permission|copyright", re.IGNORECASE)
MOST_DIFFERENT = 0.2  # words that may differ, by the template's words
CONFIRMED = 3  # templates confirmed for each block, beginning with the best; ties are all kept


def _words(text: str) -> list[str]:
    return re.findall(r"\w+(?:[.-]\w+)*", text.lower())


def differences(block: str, template: str) -> tuple[int, int]:
    """Template words missing or other in the block's best stretch, and the template's words."""
    a, b = _words(template), _words(block)
    same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return len(a) - same, len(a)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, most_different: float = MOST_DIFFERENT) -> DataFrame:
    """``doc_id``, ``line`` (from 0), ``license``, ``saved`` (bytes) and ``n_different`` (words) of each licensed line of ``docs``.

    Null and empty texts have none; a line names the template with the fewest differing words, then the most saved, then
    the first by name. Repeated rows are reported as often as they stand there; null ids stay null; other columns are left out.
    """
    known = dict(sorted((TEMPLATES if templates is None else templates).items()))
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("license", pa.string()), ("saved", pa.int64()),
                        ("n_different", pa.int64())])

    def scan(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdCompressor(level=3)
        given = {name: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
            text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in known.items() if text}
        remembered: dict[str, tuple | None] = {}

        def judge(block: str) -> tuple | None:
            raw = block.encode()
            alone = len(plain.compress(raw))
            saved = sorted(((alone - len(c.compress(raw)), name) for name, c in given.items()), key=lambda s: (-s[0], s[1]))
            if not saved:
                return None
            floor = saved[min(CONFIRMED, len(saved)) - 1][0]
            found = [(different, -gain, name) for gain, name in saved if gain >= max(1, floor)
                     for different, words in [differences(block, known[name])] if different <= most_different * words]
            return min(found) if found else None

        for batch in read:
            for part in sliced(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text or not CANDIDATE.search(text):
                        continue
                    for number, line in enumerate(text.split("\n")):
                        if CANDIDATE.search(line):
                            if line not in remembered:
                                if len(remembered) > 10_000:
                                    remembered.clear()
                                remembered[line] = judge(line)
                            if best := remembered[line]:
                                rows.append((doc, number, best[2], -best[1], best[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, line long, license string, saved long, n_different long")
