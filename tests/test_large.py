"""Shapes that grow: wide gaps, long chains beside cycles, one document's many saves, wide digest trees."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import aggregates as A
from quire.plans import hierarchy as H, ledger as L, manuscript as M, merge as G
from tests.conftest import rows


def test_gap_of_a_billion_numbers(spark):
    chapters = spark.createDataFrame([("p", 1), ("p", 999_999_999), ("p", 3), ("q", 5), ("q", 5)], "project_id string, number long")
    assert rows(M.missing_ranges(chapters)) == [("p", 2, 2), ("p", 4, 999_999_998)]
    some = M.missing_chapters(chapters).where("number % 300000000 = 7 or number < 6")
    assert rows(some) == [("p", 2), ("p", 300000007), ("p", 4), ("p", 5), ("p", 600000007), ("p", 7), ("p", 900000007)]
    assert rows(M.missing_chapters(chapters, 4, 6)) == [("p", 4), ("p", 5), ("p", 6), ("q", 4), ("q", 6)]
    assert M.missing_chapters(chapters.limit(0)).collect() == []


def test_long_chain_beside_a_cycle(spark):
    chain = spark.range(100_000).selectExpr("cast(id as string) as id", "case when id > 0 then cast(id - 1 as string) end as parent_id", "'f' as name")
    cycle = spark.range(3).selectExpr("concat('c', id) as id", "concat('c', (id + 1) % 3) as parent_id", "'f' as name")
    below = spark.createDataFrame([("under", "c0", "f"), ("lost", "nowhere", "f")], "id string, parent_id string, name string")
    found = H.folder_outcomes(chain.union(cycle).union(below))
    assert "path" not in found.columns
    counts = {r.outcome: (r["count"], r.deepest) for r in found.groupBy("outcome").agg(F.count("*").alias("count"), F.max("depth").alias("deepest")).collect()}
    assert counts == {"resolved": (100_000, 100_000), "parentCycle": (4, None), "unknownParent": (1, None)}
    short = chain.where("cast(id as int) < 70").union(cycle)
    paths = {r.id: r.path for r in H.folder_paths(short).collect()}
    assert paths["69"] == "/".join("f" * 70) and paths["0"] == "f" and paths["c1"] is None


def test_many_large_saves_of_one_document(spark):
    start = dt.datetime(2026, 1, 1)
    saves = spark.range(100_000).select(
        F.lit("d").alias("document_id"), F.col("id").alias("backup_id"), F.timestamp_seconds(F.lit(start.timestamp()) + F.col("id")).alias("created_at"),
        F.lit(2 << 20).cast("long").alias("byte_count"), F.lit("automaticSave").alias("reason"),
    )
    began = time.time()
    assert sorted(r.backup_id for r in L.rate_limit_large(saves).collect()) == list(range(0, 100_000, 300))
    assert time.time() - began < 60


def test_digest_lists_do_not_grow(spark):
    def files(n):
        return spark.range(n).select(
            F.lit("text").alias("kind"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("relative_path"), F.col("id").alias("bytes"), F.lit("h").alias("content_hash")
        )

    for n in (10, 1000, 30_000):
        digits = A.digest_digits(n)
        entry = F.sha2(F.concat_ws("\0", "kind", "relative_path", F.col("bytes").cast("string"), "content_hash"), 256)
        longest = files(n).groupBy(F.left(entry, F.lit(digits))).count().agg(F.max("count")).first()[0]
        assert longest < 160, (n, longest)
    assert [A.digest_digits(n) for n in (0, 64, 65, 1024, 1025, 16_384, 16_385)] == [0, 0, 1, 1, 2, 2, 3]
    # repeated rows are one entry, but their number counts
    one, again = A.corpus_fingerprint(files(100)).first(), A.corpus_fingerprint(files(100).union(files(100).where("id = 5"))).first()
    assert (one.files, again.files) == (100, 101) and one.fingerprint != again.fingerprint
    copies = files(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("n")
    assert A.corpus_fingerprint(copies).first().files == 5000
    assert A.corpus_fingerprint(files(0)).first().files == 0


def _applied(base, changed):
    """The base with the changed stretches put in."""
    out, done = [], 0
    for i, k, j, m in G._stretches_of(base, changed):
        assert i >= done and (i, j) != (k, m)
        out += base[done:i] + changed[j:m]
        done = k
    return out + base[done:]


@pytest.mark.parametrize("seed", range(6))
def test_line_differences_rebuild_the_text(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(G, "MATCHED", 0)  # shortest edit paths in place of the matcher
    if seed == 5:
        monkeypatch.setattr(G, "WALK", 3)
    for _ in range(60):
        base = [f"{rng.randrange(rng.choice([2, 5, 40]))}\n" for _ in range(rng.randrange(30))]
        changed = [line for line in base if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            changed.insert(rng.randrange(len(changed) + 1), f"{rng.randrange(50)}\n")
        assert _applied(base, changed) == changed


def test_merge_of_repetitive_texts():
    began = time.time()
    equal = "same\n" * 100_000
    assert G.merge_lines(equal, "mine\n" + equal, equal + "yours\n") == ("mine\n" + equal + "yours\n", 0)
    pairs = ["a\n", "b\n"] * 50_000
    local, remote, both = list(pairs), list(pairs), list(pairs)
    for i in (1000, 60_000):
        local[i] = both[i] = f"local {i}\n"
    for i in (20_000, 90_000):
        remote[i] = both[i] = f"remote {i}\n"
    assert G.merge_lines("".join(pairs), "".join(local), "".join(remote)) == ("".join(both), 0)
    numbered = [f"line {i}\n" for i in range(100_000)]
    local, remote, both = list(numbered), list(numbered), list(numbered)
    for i in range(0, 100_000, 100):
        local[i] = both[i] = f"local {i}\n"
        remote[i + 50] = both[i + 50] = f"remote {i}\n"
    assert G.merge_lines("".join(numbered), "".join(local), "".join(remote)) == ("".join(both), 0)
    assert time.time() - began < 30
