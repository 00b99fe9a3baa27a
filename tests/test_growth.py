"""What a query moves and how it deals its work, at sizes where that shows."""

from __future__ import annotations

import pathlib
import random
from collections import Counter

from pyspark.sql import functions as F

from quire.operators import aggregates, chains
from quire.plans import ledger as L
from quire.registry import roundtrips
from quire.sources import sinks
from tests.conftest import SF_DIR, rows

_REQUEST = (
    "document_id string, seq bigint, operation_id string, project_id string, base_revision bigint, device_id string, "
    "relative_path string, content_hash string, is_deleted boolean"
)


def _request(rng, i, project):
    doc = None if rng.random() < 0.05 else f"{project}{rng.randrange(4)}"
    operation = None if rng.random() < 0.1 else f"{project}-{rng.randrange(8)}"
    path = None if rng.random() < 0.1 else f"path{rng.randrange(3)}"
    gone = None if rng.random() < 0.05 else rng.random() < 0.3
    return (doc, i, operation, project, rng.randrange(5), "x", path, f"h{rng.randrange(2)}", gone)


def test_projects_apart_need_no_rounds(spark, monkeypatch):
    rng = random.Random(11)
    data = [_request(rng, i, rng.choice(["p", "q", "r"])) for i in range(60)]
    requests = spark.createDataFrame(data, _REQUEST)
    expected = rows(L._replay_in_rounds(requests, ["seq"]))
    monkeypatch.setattr(L, "_replay_in_rounds", None)
    assert rows(L.replay_ledger(requests, ["seq"])) == expected
    assert {r[3] for r in expected} >= {"committed", "OPERATION_ID_REUSED"}


def test_only_projects_that_share_go_through_rounds(spark, monkeypatch):
    rng = random.Random(12)
    data = [_request(rng, i, rng.choice(["p", "q", "r", "s"])) for i in range(60)]
    data += [("p0", 500, "x", "q", 0, "x", "path0", "h", False), ("r0", 501, "y", None, 0, "x", "path0", "h", False)]
    requests = spark.createDataFrame(data, _REQUEST)
    expected, seen, real = rows(L._replay_in_rounds(requests, ["seq"])), [], L._replay_in_rounds
    monkeypatch.setattr(L, "_replay_in_rounds", lambda df, order: seen.extend(r[0] for r in df.select("project_id").distinct().collect()) or real(df, order))
    assert rows(L.replay_ledger(requests, ["seq"])) == expected
    assert set(seen) == {"p", "q", "r", None}


def test_state_comes_with_the_fold(spark, heavy):
    rng = random.Random(13)
    data = [(None if rng.random() < 0.05 else f"d{rng.randrange(5)}", i, f"o{rng.randrange(90)}", rng.randrange(6), f"v{i}", rng.random() < 0.8) for i in range(200)]
    requests = spark.createDataFrame(data, "document_id string, seq bigint, operation_id string, base_revision bigint, v string, good boolean")
    rule = {"slot": F.lit("s"), "opens": F.array(F.lit("s")), "is_head": F.col("base_revision") == 0, "is_candidate": F.col("good")}
    by_links = rows(chains.replayed(requests, rule, ["v"]))
    spark.conf.set("quire.taskRows", "1000")
    by_fold = rows(chains.replayed(requests, rule, ["v"]))
    own = requests.withColumns(rule)
    before = rows(chains.state_before(requests, chains.committed(own.where("is_candidate")), ["v"]).select(*requests.columns, "committed", "was_v"))
    assert by_fold == before
    assert [r for r in by_links if r[2] is not None] == [r for r in by_fold if r[2] is not None]
    assert sum(r[-2] for r in by_fold) > 5 and any(r[-1] for r in by_fold)


def test_an_offer_meets_the_table_once(spark, tmp_path, monkeypatch):
    path, written = str(tmp_path / "table"), []
    monkeypatch.setattr(sinks, "durable", lambda df, real=sinks.durable: written.append(1) or real(df))
    long = "y" * (2 * sinks.SHORT)
    offer = lambda data: rows(sinks.insert_only(spark.createDataFrame(data, "k long, v string"), path, ["k"]))
    assert offer([(1, "x"), (2, long), (3, long), (3, long + "z"), (None, None)]) == [(1, "inserted"), (2, "inserted"), (3, "refused"), (None, "inserted")]
    assert offer([(1, "x"), (2, long + "z"), (3, long), (None, None)]) == [(1, "present"), (2, "refused"), (3, "inserted"), (None, "present")]
    assert rows(sinks.read_inserted(spark, path)) == sorted([(1, "x"), (2, long), (3, long), (None, None)], key=str)
    assert len(written) == 2


def test_small_files_are_written_by_many_tasks(spark):
    tree = pathlib.Path(roundtrips._text_tree(spark, SF_DIR))
    files = [p.name for p in tree.rglob("*.txt")]
    assert len({name.split("-")[1] for name in files}) > 1


def test_manuscripts_are_written_by_many_tasks(spark, tmp_path):
    parts = spark.range(200).selectExpr("concat('f', id) as file_name", "id as number", "'t' as part")
    sinks.write_manuscript_parts(parts, str(tmp_path / "books"))
    files = list((tmp_path / "books").rglob("*.txt"))
    assert len(files) == 200 and len({p.name.split("-")[1] for p in files}) > 1


def test_code_points_are_counted_in_place(spark, monkeypatch):
    texts = ["", None, "a한𝒳" * 5, "\x00é" + "b" * 40, "🙂"]
    monkeypatch.setattr(aggregates, "_AT_ONCE", 7)
    counted = aggregates.code_point_counts(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert {r.cp: r.n for r in counted.collect()} == {ord(c): n for c, n in Counter("".join(t or "" for t in texts)).items()}
    assert counted.where("false").count() == 0
