"""The corpus operators against plain twins that share no code with them, and planted cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quire.llm import decontamination, language, quality, secret_scan, sentence_spans, sharding
from quire.llm.queries import QUERIES
from tests.conftest import SF_DIR

WORDS = "river stone garden window market engine bridge winter summer doctor teacher music paper silver forest candle mirror planet ocean thunder".split()


def _prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


# --- secrets --------------------------------------------------------------------------


def _base(text):
    """Base spans by the contract's rules, read anew."""
    found = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_spans_equal_plain_rules(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op1_secret_scan"](spark, folder).collect()
    assert len(rows) == len(texts) and any(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows)
    for r in rows:
        spans = _base(texts[r["doc_id"]])
        kinds = [k for k, _, _ in spans]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [kinds.count(k) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(","))


def test_planted_credentials_without_a_keyword(spark):
    draw = random.Random(3)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    alnum, hexa = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    forms = [lambda: "ghp_" + pick(alnum, 36), lambda: "sk-live-" + pick(hexa, 24), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "-_", 35)]
    labelled = [f"{_prose(draw, 20)} {key}{forms[i % 4]()} {_prose(draw, 20)}" for i, key in zip(range(400), itertools.cycle(["password=", "token: ", "api_key = ", "secret="]))]
    bare = [(forms[i % 4](), _prose(draw, 12), _prose(draw, 9)) for i in range(120)]
    usual = [f"{_prose(draw, 6)} {word} {_prose(draw, 6)}" for word in ("internationalisation", "www.example.com/path/to/page", "2026-01-31", "snake_case_name_here", "v1.22.333-rc4", "CamelCaseIdentifier") for _ in range(20)]
    texts = labelled + [f"{a} {s} {b}" for s, a, b in bare] + usual
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, secret_scan.learn(docs)).collect()}
    hit = sum(f"grammar:{len(a) + 1}:{len(a) + 1 + len(s)}" in got[400 + i].split(",") for i, (s, a, _) in enumerate(bare))
    false = [usual[i] for i in range(len(usual)) if "grammar" in got[520 + i]]
    assert hit / len(bare) >= 0.9, hit / len(bare)
    # a long word of mixed case looks like the credentials of letters and figures; README says so
    assert all("CamelCaseIdentifier" in t for t in false), false[:2]
    assert len([s for s in got.values() if "grammar" in s]) - len(bare) <= 20


# --- decontamination and spans --------------------------------------------------------


def _item(draw):
    name, city, n, m = draw.choice(["Anna", "Peter", "Maria", "Oscar"]), draw.choice(["Oslo", "Rome", "Paris", "Vienna"]), draw.randrange(2, 900), draw.randrange(2, 900)
    return f"{name} buys {n} {draw.choice(WORDS)} {draw.choice(WORDS)} in {city} and sells {m} of them at the {draw.choice(WORDS)} {draw.choice(WORDS)} before the {draw.choice(WORDS)} closes so how many are left over"


def test_planted_items_are_found_and_clean_documents_stay(spark):
    draw = random.Random(4)
    items = [_item(draw) for _ in range(40)]

    def other(text):
        numbers = {n: str(int(n) + 1000) for n in re.findall(r"\d+", text)}
        names = dict(zip(("Anna", "Peter", "Maria", "Oscar", "Oslo", "Rome", "Paris", "Vienna"), ("Lars", "Ines", "Olga", "Hugo", "Lima", "Bern", "Riga", "Cork")))
        return re.sub(r"\d+|[A-Z]\w+", lambda m: numbers.get(m.group()) or names.get(m.group(), m.group()), text)

    forms = [lambda t: t, str.upper, str.lower, other]
    planted = [(i, f"{_prose(draw, 30)} {forms[i % 4](items[i])} {_prose(draw, 30)}") for i in range(40)]
    clean = [(100 + i, _prose(draw, 120)) for i in range(150)]
    docs = spark.createDataFrame(planted + clean, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert {(i, i) for i in range(40)} <= found
    assert {d for d, _ in found} <= set(range(40))
    kept = {r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()}
    assert kept == {d for d, _ in clean}


def test_planted_passages_go_whole(spark):
    """A later copy of a passage goes, and nothing else, by texts put together here."""
    draw = random.Random(5)
    sentence = lambda n: _prose(draw, n).capitalize() + "."
    passages = [" ".join(sentence(draw.randrange(6, 15)) for _ in range(draw.randrange(6, 9))) for _ in range(12)]
    parts, want = [], {}
    for d in range(90):
        own = [sentence(draw.randrange(6, 20)) for _ in range(8)]
        at = d // 12 + 1
        held = [passages[d % 12]] if d < 60 else []
        parts.append((d, " ".join([*own[:at], *held, *own[at:]])))
        want[d] = " ".join(own) if 12 <= d < 60 else parts[-1][1]
    docs = spark.createDataFrame(parts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sentence_spans.without_repeats(docs, sentence_spans.PASSAGE).collect()}
    assert {d: r["text"] for d, r in rows.items()} == want
    assert all(r["n_removed"] == 0 for d, r in rows.items() if d < 12 or d >= 60)


# --- models ---------------------------------------------------------------------------


def test_field_equals_enumeration_of_paths():
    draw = np.random.default_rng(6)
    field = language.Field(["a", "b", "c"], draw.standard_normal((language.HASHED + 3, 3)).astype(np.float32), draw.standard_normal((3, 3)).astype(np.float32), {"zwei": 1})
    field.weights[0] = 0
    for text in ("one", "eins zwei", "uno dos tres quatro", "a b zwei c d"):
        words = text.split()
        scores = field.word_scores(words).astype(float)
        total, sums = 0.0, np.zeros(3)
        # the path enters from every label alike
        for path in itertools.product(range(3), repeat=len(words) + 1):
            weight = math.exp(sum(scores[i, k] for i, k in enumerate(path[1:])) + sum(float(field.transitions[p, q]) for p, q in zip(path, path[1:])))
            total += weight
            for k in path[1:]:
                sums[k] += weight
        assert np.abs(field.expected([text])[0] - sums / total).max() < 1e-4


def test_votes_equal_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    space = quality.fit(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    for r in docs.limit(40).collect():
        bag = quality.bag(r["text"])
        own = [math.sqrt(b / max(sum(bag), 1)) * w for b, w in zip(bag.tolist(), space.rarity.tolist())]
        size = math.sqrt(sum(x * x for x in own))
        place = np.array([x / size if size else 0.0 for x in own]) @ space.axes.astype(float)
        size = math.sqrt(float(place @ place))
        if size <= 1e-9:
            continue
        cosines = sorted(((float(place @ v) / size, i) for i, v in enumerate(space.voters.astype(float))), reverse=True)[: quality.NEIGHBOURS]
        weight = [(max(c, 0) ** quality.SHARPNESS * space.weights[i], space.votes[i]) for c, i in cosines]
        want = sum(w for w, v in weight if v == 1) / sum(w for w, _ in weight)
        assert abs(scored[r["doc_id"]] - want) < 0.02


def test_held_out_rows_are_mostly_right(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = QUERIES["op6_quality"](spark, folder).join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").where("held_out and quality is not null")
    right, total = found.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert total > 30 and right / total > 0.95, (right, total)
    named = QUERIES["op7_language"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, total = named.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert total > 100 and right / total > 0.97, (right, total)


# --- shards ---------------------------------------------------------------------------


def _drawn(doc_id, node):
    """Spark's xxhash64 of (doc_id, name), as draws of an exponential by weight."""
    while node.children:
        def draw(c):
            h = xxhash.xxh64_intdigest(c.name.encode(), xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42))
            return -math.log(((h >> 11) + 0.5) / (1 << 53)) / c.weight, c.name

        node = min(node.children, key=draw)
    return node.shard


def test_shards_equal_plain_draws(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op10_shards"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (_drawn(r["doc_id"], sharding.topology(24)), _drawn(r["doc_id"], sharding.topology(25)))
