"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import frames, language, spots
from tilewright.llm.idfile import pack_numbers, read_token_file, token_file, unpack_numbers
from tilewright.llm.language import END, LogBloom, _look, chances, contexts_of, language_scores, pair_hashes, passes, tokens, train
from tilewright.llm.licenses import scan_licenses
from tilewright.llm.mixing import mix_sources, mixed_documents
from tilewright.llm.packing import pack_sequences, windows_for
from tilewright.llm.quality import quality_scores
from tilewright.llm.queries import ORACLES, QUERIES
from tilewright.llm.setjoin import ngram_components
from tilewright.llm.spots import fingerprints
from tilewright.llm.suffixes import beside, remove_repeats
from tilewright.llm.tokens import tokenizer_path
from tilewright.llm.topk import top_scores
from tilewright.llm.words import join_hashes
from tools.check import compare, duck

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(30))
ROWS = [(1, None, None), (2, "", "a"), (3, "one", "a"), (4, "ONE", "b"), (5, LONG, "b"), (6, LONG, "c"), (7, LONG + " end", None),
        (8, f"before {PASSAGE} after", "a"), (9, f"other {PASSAGE} text here", "a"), (9, f"other {PASSAGE} text here", "a"),
        (None, "no id", "z"), (10, " \t\n", "a"), (11, "ümläut <|endoftext|> it's 123", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return (spark.createDataFrame(ROWS, "doc_id long, text string, source string")
            .withColumn("score", F.lit("clash")).withColumn("size", F.lit(None).cast("string")).withColumn("id", F.lit(1)))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_join(docs, none):
    rows = ngram_components(docs, 4, 85).collect()
    assert len(rows) == len(ROWS) and ngram_components(none).count() == 0
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert of[1] == (0, 1) and of[2] == (0, 2) and of[10] == (0, 10)
    assert of[3] == (1, 3) and of[4] == (1, 3) and of[5][1] == of[6][1] == of[7][1] == 5 and of[None] == (1, None)


def test_join_brute_force(spark):
    draw = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        base = [f"v{k}" for k in draw.integers(0, 60, int(draw.integers(3, 70)))]
        for _ in range(4):
            own = list(base)
            for _ in range(int(draw.integers(0, 3))):
                own[int(draw.integers(len(own)))] = f"n{draw.integers(9)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[k:k + 2]) for k in range(len(w) - 1)} for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                hi, lo = max(group[i], group[j]), min(group[i], group[j])
                group = [lo if g == hi else g for g in group]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_components(frame, 2, 80).collect()} == dict(enumerate(group))


def test_repeats(docs, none):
    rows = remove_repeats(docs).collect()
    assert len(rows) == len(ROWS) and remove_repeats(none).count() == 0
    seen, kept = set(), {}
    for doc, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        if doc in kept:
            continue
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(raw[k:k + 100])
        kept[doc] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    assert all(bytes(r.kept) == kept[r.doc_id] and r.n_removed == r.n_bytes - len(r.kept) for r in rows)


def test_overlapping_repeats(spark):
    frame = spark.createDataFrame([(1, "ab" * 200), (2, "x" + "ab" * 60)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in remove_repeats(frame).orderBy("doc_id").collect()] == [(398, 1), (120, 1)]


def test_beside():
    """Rows beside others of their rank, by brute force, however they are cut into batches."""
    draw = np.random.default_rng(3)
    for trial in range(200):
        place = ["doc", "lo", "n"][:2 + trial % 2]
        names = (["rank", "whole"] if trial % 2 else ["rank"]) + place
        rows = sorted(tuple(int(v) for v in draw.integers(0, [6, 3, 3, 3, 2][-len(names):])) for _ in range(int(draw.integers(0, 60))))
        cuts = sorted({0, len(rows), *draw.integers(0, len(rows) + 1, 6).tolist()})
        read = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[a:b])), strict=True))) for a, b in zip(cuts, cuts[1:])]
        schema = pa.schema([(c, pa.int64()) for c in place] + [("later", pa.bool_())])
        groups, wholes, want = {}, {}, []
        for r in rows:
            key = r[:len(names) - len(place)]
            groups.setdefault(key, []).append(r[len(key):])
            wholes.setdefault(r[0], set()).add(key)
        for key, own in groups.items():
            want += [(*p, True) for p in own if p > own[0]] + [(*own[0], False)] * (len(wholes[key[0]]) > 1)
        assert sorted(tuple(r.values()) for b in beside(iter(read), place, schema) for r in b.to_pylist()) == sorted(want)


def test_numbers():
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 5, 6], np.uint32)
    for n in range(len(values) + 1):
        assert unpack_numbers(*pack_numbers(values[:n]), n).tolist() == values[:n].tolist()


def ids_of(text):
    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 2]


def test_token_file(spark, docs, none):
    rows = sorted(read_token_file(spark, token_file(docs, block_tokens=500)).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in rows] == sorted([r[0] for r in ROWS], key=lambda d: -1 if d is None else d)
    texts = {r[0]: r[1] for r in ROWS}
    for row in rows:
        assert row.start == start and np.frombuffer(row.ids, "<u4").tolist() == ids_of(texts[row.doc_id])
        start += row.n_tokens
    assert read_token_file(spark, token_file(none)).count() == 0


def test_packing(docs, none):
    rows = pack_sequences(docs, window=512, group_windows=4).collect()
    assert pack_sequences(none).count() == 0
    pieces = {}
    for r in rows:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in pieces.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t, _ in ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        own = np.array(ids_of(texts[r.doc_id])[r.start:r.start + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32


def test_differencing():
    sizes = [700, 600, 500, 400, 300, 200, 100, 100]
    dealt = windows_for(sizes, 1000)
    assert sorted(i for d in dealt for i in d) == list(range(8)) and all(sum(sizes[i] for i in d) <= 1000 for d in dealt)


def test_mix(docs, none):
    plain = docs
    for name in ("shift", "mix_row", "mix_part", "mix_of", "mix_source", "mix_salt", "mix_copy", "mix_doc", "mix_size", "first", "n"):
        plain = plain.withColumn(name, F.lit("clash"))
    rows = mix_sources(plain).collect()
    assert len(rows) == len(ROWS) and mix_sources(none).count() == 0 and {r["shift"] for r in rows} == {"clash"}
    assert mixed_documents(plain).columns == plain.columns and mixed_documents(none).count() == 0
    silent = docs.sparkSession.createDataFrame([(90, None, "silent"), (91, " ", "silent")], "doc_id long, text string, source string")
    quiet = [r for r in mix_sources(plain.unionByName(silent, allowMissingColumns=True)).collect() if r.source == "silent"]
    assert [(r.mix_source_size, r.mix_target, r.mix_copies) for r in quiet] == [(0, 0.0, 0)] * 2
    assert mixed_documents(silent).count() == 0
    total = sum(len(words(t)) for _, t, _ in ROWS)
    targets = {r.source: r.mix_target for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6 and all(0 <= r.mix_copies <= 3 for r in rows)
    assert all(r.mix_target <= 3 * r.mix_source_size + 1e-9 for r in rows)
    assert mixed_documents(plain).count() == sum(r.mix_copies for r in rows)


def test_language(spark, docs, none):
    rows = language_scores(docs, train(docs)).collect()
    counts = {}
    for _, text, _ in ROWS:
        for w in [*words(text), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    base = {d: sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]) for d, t, _ in ROWS}
    assert all(abs(r.base_score - base[r.doc_id]) < 1e-6 and r.n_known == r.n_tokens and r.score <= 0 for r in rows)
    assert language_scores(none, train(docs)).count() == 0
    assert {r.n_known for r in language_scores(docs, train(none)).collect()} == {0}


def test_language_passes(spark, docs):
    """Parts of the vocabulary and of the filter give what all at once gives."""
    model = train(docs)
    whole = sorted(language_scores(docs, model).collect(), key=str)
    parts = sorted(language_scores(docs, model, words_at_once=3000).collect(), key=str)
    assert len(whole) == len(parts) == len(ROWS)
    for a, b in zip(whole, parts, strict=True):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-6


def test_language_pieces(spark, docs, monkeypatch):
    """The model reaches the tasks in pieces of a bounded size, and scores do not depend on it."""
    monkeypatch.setattr(language, "SHARD_TOKENS", 700)
    model = train(docs)
    whole = sorted(language_scores(docs, model).collect(), key=str)
    sizes, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(language, "SHARDS_SENT", 2)
    monkeypatch.setattr(language, "WORDS_SENT", 500)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sizes.append(len(pickle.dumps(value))) or send(self, value))
    parts = sorted(language_scores(docs, model, shards_at_once=7).collect(), key=str)
    assert model["shards"] > 14 and len(sizes) > 20 and max(sizes) < 20_000
    for a, b in zip(whole, parts, strict=True):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-6


def test_language_large_models_are_asked(spark, docs, monkeypatch):
    """Texts are read once, however many shards and words a model has, and get the scores that passes give."""
    monkeypatch.setattr(language, "SHARD_TOKENS", 700)
    rows = docs.unionByName(docs.where("doc_id < 3"))
    held = F.col("doc_id") % 3 == 0
    model = train(rows.where(~held))
    whole = sorted(language_scores(rows, model, held, shards_at_once=64).collect(), key=str)
    for name, value in (("BROADCAST_SHARDS", 2), ("WORDS_SENT", 500), ("SLICE_BYTES", 3000), ("ANSWERED_PAIRS", 100)):
        monkeypatch.setattr(language, name, value)
    seen = spark.sparkContext.accumulator(0)

    def count(read):
        for batch in read:
            seen.add(batch.num_rows)
            yield batch

    asked = sorted(language_scores(rows.mapInArrow(count, rows.schema), model, held).collect(), key=str)
    assert model["shards"] > 14 and model["known"] > 1000 and seen.value == len(whole) == len(asked) > len(ROWS)
    for a, b in zip(whole, asked, strict=True):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-6


def test_thin_numbers():
    for numbers in ([], [0], [2**64 - 1], [5, 5, 2**40, 2**64 - 1], range(0, 3000, 7)):
        assert language.whole(language.thin(np.array(numbers, np.uint64))).tolist() == [*numbers]


def test_language_workers_hold_one_piece(spark):
    """A worker asks all pieces of the filter and of the words, and keeps none of them."""
    hashes = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shards = [LogBloom.of(hashes[hashes % np.uint64(4) == k], np.full(int((hashes % np.uint64(4) == k).sum()), 3)) for k in range(4)]
    send = spark.sparkContext.broadcast
    filters = language.SentFilters([send((np.array([k]), LogBloom.joined([shards[k].words.tobytes()]))) for k in range(4)], 4)
    want = np.select([hashes % np.uint64(4) == k for k in range(4)], [shards[k].counts(hashes) for k in range(4)])  # some are read too high
    assert (want >= 2).all() and (want == 2).mean() > 0.95
    own = np.sort(hashes.view(np.int64))
    parts = [own[np.mod(own, 4) == k] for k in range(4)]
    words = language.SentWords([send({"hash": p, "c": p % 97, "q": p % 89}) for p in parts], 1)

    def ask(read):
        for _ in read:
            q = filters.counts(hashes, (hashes % np.uint64(4)).astype(np.int64))
            c = words.look(own.view(np.uint64))
            right = bool((q == want).all() and (c[0] == own % 97).all() and (c[1] == own % 89).all())
            yield pa.RecordBatch.from_pydict({"right": [right], "kept": [sum("_value" in vars(p) for p in (*filters.pieces, *words.pieces))]})

    rows = spark.range(1, numPartitions=1).mapInArrow(ask, "right boolean, kept long").collect()
    assert [tuple(r) for r in rows] == [(True, 0)]


def test_language_brute_force(spark):
    """Scores by dictionaries, and chances that sum to 1 after every token."""
    draw = np.random.default_rng(5)
    chain = [[f"w{k}" for k in np.minimum(draw.zipf(1.3, int(draw.integers(1, 400))), 5000)] for _ in range(300)]
    texts = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(chain)], "doc_id long, text string")
    held = F.col("doc_id") % 5 == 0
    model = train(texts.where(~held))
    hand = next(passes(model, 64, 1 << 22))[0]
    one, two, after = {}, {}, {}
    for i, t in enumerate(chain):
        if i % 5:
            for a, b in zip([None, *t], [*t, None], strict=True):
                one[b], two[a, b] = one.get(b, 0) + 1, two.get((a, b), 0) + 1
    raw = "\n".join(" ".join(t) for t in chain).encode()
    lengths = np.cumsum([0, *[len(" ".join(t)) + 1 for t in chain]])
    lengths[-1] -= 1
    hashes, first = tokens(np.frombuffer(raw, np.uint8), lengths)
    read = hand["bloom"].counts(pair_hashes(hashes))
    flat = [w for t in chain for w in (*t, None)]
    pairs = list(zip([None, *flat[:-1]], flat, strict=True))
    q = dict(zip(pairs, read.tolist(), strict=True))
    exact = [2 ** (two[p].bit_length() - 1) if p in two else 0 for p in q]
    assert np.mean(np.array(list(q.values())) == exact) > 0.85 and all(v >= e for v, e in zip(q.values(), exact, strict=True))
    for (a, _), n in q.items():
        after.setdefault(a, 0)
    for p in two:
        after[p[0]] = after.get(p[0], 0) + q[p]
    n, v = sum(one.values()), len(one)

    def chance(a, b):
        left = max(one.get(a, 0) - after.get(a, 0), 0) + 20
        return (min(q[a, b], after.get(a, 0)) + left * (one.get(b, 0) + 1) / (n + v + 1)) / (after.get(a, 0) + left)

    for r in language_scores(texts, model, held).collect():
        t = [None, *chain[r.doc_id], None]
        assert abs(r.score - sum(np.log10(chance(*p)) for p in zip(t[:-1], t[1:], strict=True))) < 1e-6
        assert r.held_out == (r.doc_id % 5 == 0) and r.train_tokens == n and r.n_tokens == len(t) - 1
    known = hand["first"]["hash"].view(np.uint64)
    assert len(known) == v
    every = np.append(known, np.uint64(12345))  # and one unknown token
    off = []
    for a in known:
        both = np.stack([np.full(len(every), a), every], 1).ravel()
        first, second = _look(hand["first"], np.full(len(every), a)), _look(hand["second"], every)[0]
        off.append(abs(chances(hand, first, second, join_hashes(both, 2)[::2]).sum() - 1))
    # of six million pairs one or two are found that were never seen; each adds one in 20 at most
    assert np.sum(np.array(off) > 0.01) <= 2 and max(off) < 0.05
    assert contexts_of(hashes)[0] == END


def test_log_bloom():
    hashes = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    counts = np.tile([1, 2, 5, 1000], 1000)
    bloom = LogBloom.of(hashes, counts)
    least = np.tile([1, 2, 4, 512], 1000)
    assert (bloom.counts(hashes) >= least).all() and (bloom.counts(hashes) == least).mean() > 0.8
    assert (bloom.counts(hashes + np.uint64(1)) > 0).mean() < 0.001


def test_spots(docs, none):
    rows = fingerprints(docs).collect()
    assert len(rows) == len(ROWS) and fingerprints(none).count() == 0
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault({d: t for d, t, _ in ROWS}[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    text, after = order[-1][1], order[0][1] or ""
    edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
    assert next(r for r in rows if r.doc_id == 11).edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_spots_in_parts(spark, monkeypatch):
    """Fingerprints and likeness by brute force over parts of a few rows, with nothing written down."""
    draw = np.random.default_rng(8)
    rows = [(None if i == 5 else i // 2 * 3, " ".join(f"w{k}" for k in draw.zipf(1.5, int(draw.integers(0, 60))) % 500)) for i in range(120)]
    rows += [rows[0]] * 3 + [(9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(spots.part_starts, "__defaults__", (300,))
    written = []
    monkeypatch.setattr(frames, "new_folder", lambda *args: written.append(args))
    got = sorted(map(tuple, fingerprints(frame).collect()), key=str)
    tie = {r.text: r.tie for r in frame.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).collect()}
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    common, want = spots.common_words(frame), []
    for (doc, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        edited = spots.edited_text(text, after)
        own, other, following = (spots.spot_set(t, common) for t in (text, edited, after))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), spots.fingerprint_text(own), spots.fingerprint_text(other),
                     spots.likeness(own, other), spots.likeness(own, following)))
    assert got == sorted(want, key=str) and len(spots.part_starts(frame.withColumn("tie", F.xxhash64("text")).na.fill("", ["text"]))) > 20
    assert not written


def test_licenses(spark, none):
    frame = spark.createDataFrame([(1, "a\nReleased under the MIT License.\nb"), (2, "Licensed under the Apache License, Version 2.0"),
                                   (3, "He had a license to fish."), (4, None), (None, "")], "doc_id long, text string")
    assert {(r.doc_id, r.line, r.license) for r in scan_licenses(frame).collect()} == {(1, 1, "MIT"), (2, 0, "Apache-2.0")}
    assert scan_licenses(none).count() == 0


def test_topk(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(300, 8)).round(1))]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, rows[3][1]), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = top_scores(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    usable = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows
              if i is not None and v and None not in v and not np.isnan(v).any()}
    want = [(q, k + 1, v, s) for q in (0, 100, 200) for k, (s, v) in enumerate(
        (-a, b) for a, b in sorted((-int(usable[q] @ usable[v]), v) for v in usable if v != q)[:10])]
    assert [tuple(r) for r in found] == want
    assert top_scores(frame, frame.where("false")).count() == 0


def test_quality(spark, sf, none):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.9
    assert quality_scores(none, labels).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name]).startswith("ok")
