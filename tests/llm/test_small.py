"""Small inputs with nulls, ties, repeats and clashing columns, against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from quire.llm import decontamination, language, mixing, quality, secret_scan, sentence_spans, sharding, topk

ODD = [(None, None, "z"), (None, "", None), (5, None, "a"), (5, "same words here", "a"), (5, "same words here", "a"), (6, " \n", "b"), (7, "!!! 123", None)]
SCHEMA = "doc_id long, text string, source string, lang string, n long, score string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, s, "en", 1, "x", "y") for d, t, s in ODD], SCHEMA)


def _searched(ids, vectors, asked, k=5, floors=None):
    """The operator's group search, and the share of pairs that it evaluated."""
    pivots = topk.choose_pivots(vectors[: topk.PIVOT_SAMPLE])
    tables = topk.distances(vectors, pivots), topk.distances(vectors[asked], pivots)
    floors = np.full(len(asked), -(2**63)) if floors is None else floors
    got, evaluated = topk.best_in_group(ids, vectors, ids[asked], vectors[asked], k, pivots, tables, floors)
    for q in asked:
        scores = vectors @ vectors[q]
        want = sorted((-int(scores[i]), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q])[:k]
        mine = got[got["query_id"] == ids[q]]
        assert [(-s, i) for s, i in zip(mine["score"], mine["vec_id"], strict=True)] == want
    return evaluated / (len(asked) * len(ids))


def test_top_k_prunes_and_is_exact():
    draw = np.random.default_rng(1)
    vectors = draw.integers(-90, 90, (3000, 12)) // 20 * 20
    vectors[:40] = vectors[0]
    assert _searched(np.arange(3000), vectors, np.arange(20)) < 0.5
    # fewer dimensions than coordinates, zero vectors, one vector
    flat = np.outer(draw.integers(-9, 9, 200), np.arange(6))
    _searched(np.arange(200), flat, np.arange(30))
    _searched(np.arange(3), np.zeros((3, 4), dtype=np.int64), np.arange(3))
    huge = draw.integers(-(2**27), 2**27, (300, 5))
    _searched(np.arange(300), huge, np.arange(20))


def test_top_k_eliminates_most_pairs_of_embeddings(spark):
    rows = topk.integers(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 256, "embedding").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    asked = np.flatnonzero(ids % 50 == 0)
    share = _searched(ids, vectors, asked)
    assert share < 0.1, share


def test_top_k_rows(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.0, -0.25]), (7, [2.0, 1.0]), (8, [2.0, 1.0]), (9, None), (10, [nan, 1.0]), (11, [1.0, None]), (None, [9.0, 9.0]), (12, [3.0])]
    got = topk.quantised_top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=2).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, 163840), (0, 2, 8, 163840), (50, 1, 0, -8192), (50, 2, 7, -16384)]
    assert topk.quantised_top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == len(ODD)
    total = sum(r["size"] for r in rows)
    assert {r["source"]: r["source_size"] for r in rows} == {"a": 6, "b": 0, "z": 0, None: 2}
    targets = {r["source"]: r["target"] for r in rows}
    assert math.isclose(sum(targets.values()), total) and all(t <= 3 * 6 for t in targets.values())
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix_report(odd.limit(0)).count() == 0


def test_shards(spark, odd):
    docs = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text").union(odd.select("doc_id", "text"))
    rows = sharding.shard_report(docs).collect()
    assert len(rows) == 20_000 + len(ODD)
    slots: dict[int, list[int]] = {}
    for r in rows:
        raw = (r["doc_id"] is not None and r["size"]) or 8
        assert raw >= 8 and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.25 * 20_000 / 24
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 11} == {zlib.crc32(b"11")}


def test_shards_follow_weights(spark):
    leaf = lambda i, w: sharding.Node(f"s{i}", shard=i, own=w)
    tree = lambda w: sharding.Node("root", (sharding.Node("r0", (leaf(0, 1.0), leaf(1, w))), sharding.Node("r1", (leaf(2, 1.0), leaf(3, 1.0)))))
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    light = {r["doc_id"]: r["shard"] for r in sharding.with_shard(docs, tree(1.0)).collect()}
    heavy = {r["doc_id"]: r["shard"] for r in sharding.with_shard(docs, tree(3.0)).collect()}
    # shards 2 and 3 are in a subtree of unchanged weights: nothing moves between them
    assert not any({light[d], heavy[d]} == {2, 3} for d in light)
    assert not any(light[d] < 2 <= heavy[d] for d in light)
    assert sum(s == 1 for s in heavy.values()) > 1.6 * sum(s == 1 for s in light.values())


def test_secret_rules_and_grammar(spark, odd):
    draw = np.random.default_rng(2)
    hexes = ["".join(draw.choice(list("0123456789abcdef"), 18)) for _ in range(60)]
    texts = [f"plain words 12345 with password={h} and more ordinary writing" for h in hexes[:50]]
    texts += [f"bare {hexes[55]} here", "TOKEN: 'abc' secret = \"abcdefgh1\" AKIAABCDEFGHIJKL AKIAX " + "a1" * 17, "ordinary interesting writing only"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    rows = [r for r in secret_scan.scan(docs, secret_scan.learn(docs)).collect()]
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] > 7}
    assert len(rows) == len(texts) + len(ODD)
    assert by[50]["spans"] == "grammar:5:23" and by[50]["n_assign"] == 0
    t = texts[51]
    assert (by[51]["n_assign"], by[51]["n_access"], by[51]["n_hex"]) == (1, 1, 1)
    spans = [("assign", t.index("secret"), t.index("secret") + 19), ("access", t.index("AKIAA"), t.index("AKIAA") + 16), ("hex", t.index("a1a1"), len(t))]
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert by[51]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and by[51]["spans"].startswith(base[:10])
    assert by[52]["spans"] == "" and by[10]["n_assign"] == 1


def test_leaks(spark, odd):
    question = "A train leaves Oslo with 120 passengers and travels 60 km to reach Bergen before the evening ferry departs with 120 people"
    moved = question.replace("120", "75").replace("Oslo", "Rome").replace("Bergen", "Naples").replace("60", "44")
    broken = question.replace("120 passengers", "75 passengers").replace("before", "some time well after").replace("leaves", "quits the")
    items = spark.createDataFrame([(1, question, 0), (2, "too short", 0), (3, None, 0), (None, question, 0)], "item_id long, text string, doc_id long")
    texts = [(100, f"some intro. {question} and an end"), (101, f"Before it {moved} after"), (102, "words that have nothing to do with any item at all in here"), (103, broken)]
    docs = spark.createDataFrame([(d, t) for d, t in texts], "doc_id long, text string").union(odd.select("doc_id", "text"))
    rows = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.leaks(docs, items).collect()}
    assert rows == {(100, 1): "verbatim", (101, 1): "reparameterised"}
    kept = sorted((r["doc_id"] for r in decontamination.clean_documents(docs, items).collect()), key=str)
    assert kept == sorted([102, 103, *(d for d, *_ in ODD)], key=str)
    assert decontamination.leaks(docs.limit(0), items).count() == 0


def _brute_spans(rows):
    first: dict = {}
    seen = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        spans, hashes, counts = sentence_spans._pieces(t or "")
        gone = set()
        mine = {}
        for i in range(len(spans) - 1):
            key = (hashes[i], hashes[i + 1])
            if counts[i] + counts[i + 1] < sentence_spans.LEAST_WORDS:
                continue
            if key in mine or (key in first and first[key] != d):
                gone |= {i, i + 1}
            mine.setdefault(key, i)
        for key in mine:
            first.setdefault(key, d)
        seen[d] = len(gone)
    return seen


def test_spans(spark, odd):
    passage = "First we walk down to the old harbour. Then we look for the blue boat there. At last we row out to the far island."
    texts = [(1, f"Own start one. {passage} Own end one."), (2, f"Another begins here {passage} Another one ends."), (3, passage + "\n" + passage), (4, "Nothing of it is in this text. It stays as it was before today."), (9, "word " * 80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").union(odd.select("doc_id", "text"))
    rows = sentence_spans.without_repeats(docs).collect()
    assert len(rows) == len(texts) + len(ODD)
    got = {r["doc_id"]: r for r in rows if r["doc_id"] in (1, 2, 3, 4)}
    want = _brute_spans(texts)
    assert {d: r["n_removed"] for d, r in got.items()} == {d: want[d] for d in got}
    assert got[1]["text"] == texts[0][1] and got[4]["removed"] == ""
    assert got[2]["text"] == "Another begins here First we walk down to the old harbour. Another one ends." and got[3]["text"] == ""


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, None), (6, 0, None), (None, 1, None), (7, None, None)], "doc_id long, quality int, text string")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    none = quality.score_quality(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    named = language.language_report(odd).collect()
    assert len(named) == len(ODD)
    for r, t in ((r, t) for r in named for d, t, _ in ODD if d == r["doc_id"] and d in (6, 7)):
        assert (r["lang_pred"], r["score"]) == ("und", 0.0), t
    assert language.language_report(odd.limit(0)).count() == 0


def test_chunks_equal_one_pass(monkeypatch):
    draw = np.random.default_rng(4)
    words = {"en": "the of and with that this from".split(), "de": "der die und mit nicht ein auf".split()}
    texts = [(lang, " ".join(draw.choice(ws, 40))) for lang, ws in words.items() for _ in range(10)]
    monkeypatch.setattr(language, "STEPS", 30)
    field = language.learn(texts)
    mixed = [" ".join([*draw.choice(words["en"], 33), *draw.choice(words["de"], 50)]), None, "", "the", *[t for _, t in texts]]
    whole = []
    for size in (4, 7, 200):
        monkeypatch.setattr(language, "CHUNK", size)
        whole.append(field.expected(mixed))
    assert np.allclose(whole[0], whole[2], atol=1e-3) and np.allclose(whole[1], whole[2], atol=1e-3)
    assert abs(whole[0][0][1] - 33) < 4 and abs(whole[0][0].sum() - 83) < 1e-3


def test_form():
    assert re.fullmatch(r"Aa#/\d", quality.form("Unter###"))


def test_very_long_words_have_the_same_features(monkeypatch):
    draw = np.random.default_rng(4)
    field = language.Field(["a", "b"], draw.standard_normal((language.HASHED + 2, 2)).astype(np.float32), np.zeros((2, 2), dtype=np.float32), {})
    field.weights[0] = 0
    words = ["".join(draw.choice(list("abcdeäöü漢ß"), n)) for n in (4, 5, 6, 7, 8, 13, 14, 15, 400)]
    want = field.word_scores(words)
    monkeypatch.setattr(language, "LONG", 3)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.abs(field.word_scores(words) - want).max() < 1e-3
    monkeypatch.undo()
    assert field.expected(["abcde" * 400_000]).shape == (1, 2)
