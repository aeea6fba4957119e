"""The chosen-path join against brute force, its nodes and edge cases."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import chosenpath as cp
from tilewright.llm.queries import QUERIES


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(words, len(found))
    return {tuple(found[k:k + n]) for k in range(len(found) - n + 1)} if found else set()


def brute(rows, words=5, numer=85):
    """Components over all pairs, rows of one id together."""
    sets = [shingles(t, words) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, (doc, _) in enumerate(rows):
        if doc is None:
            continue
        for j in {j for x in sets[i] for j in holders[x] if j < i}:
            both = len(sets[i] & sets[j])
            if rows[j][0] is not None and 100 * both >= numer * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    by_id = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            group[root(i)] = root(by_id.setdefault(doc, i))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        own = None if doc is None else least[root(i)]
        out.append((doc, len(sets[i]), own, doc is None or doc == own))
    return out


def same(found, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def edited(draw, base, share):
    return [w if draw.random() > share else f"n{draw.integers(10**6)}" for w in base]


def corpus(draw, groups=30, boiler=""):
    rows = []
    for _ in range(groups):
        base = [f"v{k}" for k in draw.integers(0, 5000, int(draw.integers(3, 120)))]
        for _ in range(int(draw.integers(1, 6))):
            rows.append((len(rows), " ".join([*edited(draw, base, 0.015), boiler])))
    return rows


def test_trees_reach_the_recall():
    assert cp.trees_for(0.85) == 3 and cp.trees_for(0.5) > cp.trees_for(0.9)


@pytest.mark.parametrize("words,numer", [(5, 85), (4, 85), (5, 80)])
def test_against_brute_force(spark, words, numer):
    draw = np.random.default_rng(3)
    rows = corpus(draw, 40) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(draw, 30, " ".join(f"licence{k}" for k in range(60))))]
    same(cp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, numer).collect(), brute(rows, words, numer))


@pytest.mark.parametrize("depth,cross", [(6, 4_000_000), (1, 0), (3, 40)])
def test_large_nodes(spark, monkeypatch, depth, cross):
    """Large groups of near copies, tight and loose: pivots, components, branches and cells."""
    monkeypatch.setattr(cp, "SMALL", 8)
    monkeypatch.setattr(cp, "CHUNK", 16)
    monkeypatch.setattr(cp, "DEPTH", depth)
    monkeypatch.setattr(cp, "CROSS", cross)
    draw = np.random.default_rng(9)
    rows = corpus(draw, 10)
    for share in (0.002, 0.02, 0.05):
        base = [f"g{share}x{k}" for k in range(90)]
        rows += [(len(rows) + i, " ".join(edited(draw, base, share))) for i in range(60)]
    same(cp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows, 5, 80))


def test_links_of_a_cluster_are_a_forest():
    sets = [np.arange(100 + k, dtype=np.uint64) for k in range(40)]
    assert cp.links_within(sets, 85) == [(0, k) for k in range(1, 40)]
    assert cp.links_within([sets[0], sets[0] + np.uint64(500), sets[1] + np.uint64(500)], 85) == [(1, 2)]


def test_links_of_a_cluster_in_blocks(monkeypatch):
    monkeypatch.setattr(cp, "TABLE_CELLS", 64)
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.choice(60, int(draw.integers(1, 60)))).astype(np.uint64) for _ in range(60)]
    near = np.array([[100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for b in sets] for a in sets])
    part = cp.parts_of(near)
    assert cp.links_within(sets, 60) == [(p, i) for i, p in enumerate(part.tolist()) if p != i]


LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "One"), (5, "ONE"), (6, LONG), (7, LONG + " end"), (None, LONG), (None, None),
        (8, "a b c d"), (9, "A B C D"), (9, "A B C D"), (10, "a b c e"), (11, "x y z one two three"), (11, LONG), (12, "x y z one two three"),
        (13, "É accents stay"), (14, "é accents stay")]


def test_edges(spark):
    docs = (spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("key", F.lit(1))
            .withColumn("component", F.lit(2)).withColumn("kept", F.lit(None).cast("string")))
    same(cp.near_duplicates(docs).collect(), brute(ROWS, 5, 80))
    assert cp.near_duplicates(docs.where("false")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op11_neardup"](spark, sf).collect(), brute(rows))
