"""Periodic runs against brute force, and edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm.queries import QUERIES
from tilewright.llm.runs import factor_runs, run_digests, word_codes, word_runs


def brute(words, least=24, times=3):
    """All maximal stretches for every period, smallest periods only."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                own = words[i:i + length]
                if not any(q % d == 0 and all(own[k] == own[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def report(doc, text, unroll=True):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n, h = len(words), zlib.crc32(b"" if doc is None else str(doc).encode())
    if unroll and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_factor_runs_against_brute_force():
    draw = np.random.default_rng(7)
    for turn in range(150):
        words, letters = [], int(draw.integers(1, 5))
        while len(words) < 160:
            root = draw.integers(0, letters, int(draw.integers(1, 14))).tolist()
            words += root * int(draw.integers(1, 9))
            if turn % 3 == 0:
                words += draw.integers(0, 50, int(draw.integers(0, 6))).tolist()
        words = [str(w).encode() for w in words]
        assert [tuple(r) for r in factor_runs(word_codes([words])).tolist()] == brute(words)


def test_runs_stay_within_a_text():
    same = [b"a"] * 20
    assert len(factor_runs(word_codes([same, same]))) == 0
    assert factor_runs(word_codes([same * 2, same * 2])).tolist() == [[0, 40, 1], [40, 40, 1]]


def test_overlapping_runs():
    words = [b"a"] * 30 + [b"b"] + ([b"a"] * 3 + [b"b"]) * 8
    assert [tuple(r) for r in factor_runs(word_codes([words])).tolist()] == brute(words)
    assert len(brute(words)) == 2


ROWS = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one"), (5, "x y " * 40), (6, "X y " * 40), (7, "a b 中 " * 30),
        (None, "x y " * 40), (5, "x y " * 40), (5, "z " * 23), (8, "z " * 24), (28, " ".join(f"w{i}" for i in range(50))),
        (9, " ".join(f"w{i % 7000}" for i in range(30_000)))]


@pytest.mark.parametrize("unroll", [False, True])
def test_edges(spark, unroll):
    docs = (spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("runs", F.lit("clash"))
            .withColumn("collapsed", F.lit(1)).withColumn("best", F.lit(None).cast("string")))
    rows = [tuple(r) for r in run_digests(word_runs(docs, unroll)).collect()]
    want = [report(*r, unroll) for r in ROWS if r[0] != 9]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((r for r in rows if r[0] != 9), key=key) == sorted(want, key=key)
    long = next(r for r in rows if r[0] == 9)
    if not unroll:
        assert long[1:6] == (1, 0, 30_000, 7000, 4285)
    assert len(rows) == len(ROWS) and run_digests(word_runs(docs.where("false"))).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_runs"](spark, sf).collect()
    short = [r for r in rows if len((docs[r.doc_id] or "").split()) < 600]
    assert len(rows) == len(docs) and len(short) > 150
    for r in short:
        assert tuple(r) == report(r.doc_id, docs[r.doc_id])
