"""File scans, JSON readers and writers on small folders."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quire.operators.ordering import fixed_categories, plan_order, with_category
from quire.operators.windows import assign_order
from quire.plans import ledger as L
from quire.plans.contracts import canonical_json, contract_audit, invariant_audit, payload_digest_audit
from quire.sources import files, sinks, snapshots as R
from tests.conftest import rows

ID = "11111111-1111-4111-8111-11111111111"


def test_scan_corpus(spark, tmp_path):
    root = tmp_path / "work"
    (root / "메인" / "원고").mkdir(parents=True)
    (root / "메인" / "a.txt").write_text("가나", encoding="utf-8")
    (root / "메인" / "원고" / "b.txt").write_bytes(b"\xff\xfe\x00")
    (root / "메인" / "원고" / "c.png").write_bytes(b"\x00")
    out = {r.relative_path: r for r in files.scan_corpus(spark, str(root)).collect()}
    assert set(out) == {"메인", "메인/원고", "메인/a.txt", "메인/원고/b.txt"}
    assert out["메인/a.txt"].bytes == 6 and out["메인/a.txt"].text == "가나"
    assert out["메인/a.txt"].content_hash == hashlib.sha256("가나".encode()).hexdigest()
    assert out["메인/원고/b.txt"].valid_utf8 is False and out["메인/원고/b.txt"].text is None
    assert rows(files.scan_errors(files.scan_corpus(spark, str(root)))) == [("메인/원고/b.txt", "invalidUTF8")]
    tree = files.scan_import_tree(spark, str(root), "p")
    assert {r.relative_path for r in tree.collect()} == {"메인", "메인/원고", "메인/a.txt", "메인/원고/b.txt", "메인/원고/c.png"}


def test_node_and_snapshot_readers(spark, tmp_path):
    path = str(tmp_path / "docs")
    data = [
        (ID + "1", "p", "a/b", "t", 1, False, None, "2026-01-01T00:00:00Z"),
        (ID + "2", "p", "c", "t", 1, True, "2026-01-01T00:00:00.123Z", "2026-01-01T00:00:00.5+09:00"),
        (ID + "3", "q", "c", "t", 0, False, None, "x"),
    ]
    schema = "document_id string, project_id string, relative_path string, content string, revision bigint, is_deleted boolean, deleted_at string, updated_at string"
    spark.createDataFrame(data, schema).withColumn("parent_id", F.lit("f")).write.parquet(path)
    df = R.read_snapshot(spark, path, "p")
    assert df.columns == R.DOCUMENT_COLUMNS
    assert [r.document_id for r in R.validate_snapshot(df).collect()] == [ID + "1", ID + "2"]
    assert df.where("updated_at IS NULL").count() == 0
    assert R.read_nodes(spark, path, "p", "f").count() == 2
    plan = R.read_nodes(spark, path, "p")._jdf.queryExecution().toString()
    assert "EqualTo(project_id,p)" in plan
    bad = spark.createDataFrame(data + data[:1], schema)
    assert rows(R.snapshot_faults(bad)) == [(ID + "1", "duplicateId"), (ID + "3", "revision")]
    with pytest.raises(ValueError):
        R.validate_snapshot(bad)


def test_backup_inventory(spark, tmp_path):
    a, b = tmp_path / "auto", tmp_path / "manual"
    a.mkdir(), b.mkdir()
    base = {"project_id": "p", "document_id": "d", "relative_path": "x", "content_hash": "h", "reason": "manual"}
    (a / "1.json").write_text(json.dumps({**base, "backup_id": "1", "created_at": "2026-01-02T00:00:00Z", "is_pinned": False}))
    (b / "1.json").write_text(json.dumps({**base, "backup_id": "1", "created_at": "2026-01-01T00:00:00Z", "is_pinned": True}))
    (b / "2.json").write_text("{broken")
    out = R.read_backup_inventory(spark, [str(a), str(b)]).collect()
    assert [(r.backup_id, r.is_pinned) for r in out] == [("1", True)]
    (b / "3.json").write_text(json.dumps({**base, "is_pinned": True}))
    rejects = R.read_backups(spark, [str(a), str(b)])["rejects"].collect()
    assert sorted((r.source_file.rsplit("/", 1)[1], r._corrupt_record) for r in rejects) == [("2.json", "{broken"), ("3.json", None)]


def test_server_snapshot_and_incident(spark, tmp_path):
    snap = {
        "snapshot_version": "0.3.0", "captured_at": "2026-01-01T00:00:00Z", "server_project_id": ID + "1", "project_name": "n",
        "project_sync_mode": "LEGACY", "migration_epoch": 0,
        "folders": [{"folder_id": ID + "2", "parent_folder_id": None, "name": "f", "revision": 1, "is_deleted": False, "updated_at": "2026-01-01T00:00:00Z"}],
        "documents": [], "tree_order": {"document_id": ID + "3", "revision": 1, "representation": "names", "entries": {"<root>": ["f"]}, "updated_at": "2026-01-01T00:00:00Z"},
    }
    folder = tmp_path / "snaps"
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps(snap))
    (folder / "mode.json").write_text(json.dumps({**snap, "project_sync_mode": "OTHER"}))
    (folder / "broken.json").write_text("{")
    out = R.read_server_snapshot(spark, str(folder))
    assert [r.name for r in out["folders"].collect()] == ["f"]
    assert rows(out["tree_order"].select("parent_key", F.array_join("children", ","))) == [("<root>", "f")]
    assert out["rejects"].count() == 2 and out["documents"].count() == 0
    incident = {
        "incident_schema_version": "0.3.0", "incident_id": ID + "1", "source_devices": [{"platform": "ipad", "device_id": ID + "2"}],
        "evidence_files": [{"path": "a", "size_bytes": 3}], "batches": [{"batch_id": "b"}], "operations": [{"operation_id": "o", "sequence": 1}],
        "source_mutations_performed": False,
    }
    path = tmp_path / "incident"
    path.mkdir()
    (path / "i.json").write_text(json.dumps(incident))
    (path / "j.json").write_text(json.dumps({**incident, "source_mutations_performed": True}))
    out = R.read_incident(spark, str(path))
    assert [out[n].count() for n in ("devices", "files", "batches", "operations", "rejects")] == [1, 1, 1, 1, 1]


def test_trash_purge_envelopes(spark):
    good = {"version": 1, "purged_revisions": {ID + "1": 3}, "empty_generation": ""}
    cases = [
        (json.dumps(good), None),
        (json.dumps({**good, "extra": 1}), "invalidEnvelope"),
        (json.dumps({**good, "version": "1"}), "invalidEnvelope"),
        (json.dumps({**good, "version": 2}), "invalidVersion"),
        (json.dumps({**good, "empty_generation": "x"}), "invalidGeneration"),
        (json.dumps({**good, "empty_generation": 5}), "invalidWireTypes"),
        (json.dumps({**good, "purged_revisions": {ID.upper() + "A": 3}}), "invalidRevision"),
        (json.dumps({**good, "purged_revisions": {ID + "1": -1}}), "invalidRevision"),
        (json.dumps({**good, "purged_revisions": {ID + "1": 1.5}}), "invalidEnvelope"),
        ("nonsense", "invalidEnvelope"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content string")
    out = {r.i: r for r in R.decode_trash_purge(df).collect()}
    assert [out[i].fault for i in range(len(cases))] == [f for _, f in cases]
    assert out[0].revisions == {ID + "1": 3} and out[1].revisions is None


def test_canonical_json(spark):
    cases = [
        ('{"b": [1, {"d": null, "c": "x\\"y: 1.5"}], "a": true}', '{"a":true,"b":[1,{"c":"x\\"y: 1.5","d":null}]}'),
        ('{"a": 1.5}', None), ('{"a-b": 1}', None), ('{"a": "1.5", "b": "k\\": 2.0"}', '{"a":"1.5","b":"k\\": 2.0"}'), ("[]", "[]"), ("{", None),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "j string")
    assert [r[0] for r in df.select(canonical_json(F.col("j"))).collect()] == [e for _, e in cases]
    digest = hashlib.sha256(b'{"a":1}').hexdigest()
    intents = spark.createDataFrame([(1, '{"a": 1}', digest), (2, '{"a": 1}', "0"), (3, '{"a": 0.1}', "0")], "i int, payload string, payload_sha256 string")
    assert rows(payload_digest_audit(intents).select("i", "problem")) == [(2, "CONTRACT_DIGEST_MISMATCH"), (3, "INVALID_ARGUMENT")]


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("메인", 0), ("메인/a", 2), ("메인/설정집", 1), ("메인/설정집/c", 1), ("메인/설정집/b", 1), ("메인/설정집/d", 0), ("메인/휴지통", 3), ("메인/휴지통/x", 0)],
        "relative_path string, user_order bigint",
    )
    sinks.write_tree_order(nodes, str(tmp_path / "order"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "order")).collect()]
    assert sorted(lines, key=str) == [
        {"tree_order": {"<root>": ["설정집", "a"]}, "version": 1}, {"tree_order": {"메인/설정집": ["d", "b", "c"]}, "version": 1}
    ]
    live = nodes.withColumn("status", F.when(F.col("relative_path") == "메인/a", "trashed").otherwise("active"))
    assert rows(sinks.tree_order_entries(live).where("parent_key = '<root>'")) == [("<root>", 0, "설정집")]
    books = spark.createDataFrame([("p(1~2화).txt", "one\n\ntwo"), ("q(1~1화).txt", "x")], "file_name string, content string")
    sinks.write_manuscript(books, str(tmp_path / "books"))
    back = spark.read.text(str(tmp_path / "books"), wholetext=True)
    assert sorted(r.value for r in back.collect()) == ["one\n\ntwo\n", "x\n"]
    ledger = spark.createDataFrame([("p", 1)], "project_id string, revision bigint")
    for _ in range(2):
        sinks.append_ledger(ledger, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_fixed_categories_and_plan_order(spark):
    assert fixed_categories(spark).count() == 9
    nodes = spark.createDataFrame([("메인/원고",), ("메인/x",)], "relative_path string")
    assert {r.relative_path: r.category for r in with_category(nodes).collect()} == {"메인/원고": "manuscript", "메인/x": None}
    actions = spark.createDataFrame(
        [("1", "delete", "a"), ("2", "delete", "a/b"), ("3", "move", "a/b"), ("4", "move", "a"), ("5", "conflict", None), ("6", "create", "z")],
        "folder_id string, action string, path string",
    )
    assert [r.folder_id for r in plan_order(actions).collect()] == ["4", "3", "6", "2", "1", "5"]


def test_assign_order_starts_at_zero(spark):
    known = spark.createDataFrame([("p", 4)], "parent_id string, user_order bigint")
    fresh = spark.createDataFrame([("p", "b"), ("p", "a"), (None, "c")], "parent_id string, name string")
    assert rows(assign_order(known, fresh, ["name"]).select("parent_id", "name", "user_order")) == [(None, "c", 0), ("p", "a", 5), ("p", "b", 6)]


def test_contract_audit_links(spark):
    payload, digest = '{"a": 1}', hashlib.sha256(b'{"a":1}').hexdigest()
    intents_digest = hashlib.sha256(b"[]").hexdigest()
    batch = lambda b, epoch=0: (b, "p", "LEGACY", epoch, "v1", "good", 3, ["a"], "build", "[]", intents_digest)
    batches = spark.createDataFrame(
        [batch("ok"), batch("gap"), batch("self"), batch("twice"), batch("old", 7), batch("link"), batch("empty")],
        "batch_id string, project_id string, mode string, epoch int, contract_version string, contract_sha256 string, protocol_version int, "
        "capabilities array<string>, client_build_id string, ordered_intents string, batch_payload_sha256 string",
    )
    one = lambda b, s, o, sup=None: (b, s, o, "folder", "create", 0, payload, digest, sup)
    intents = spark.createDataFrame(
        [one("ok", 1, "o1"), one("ok", 2, "o2", "known"), one("gap", 2, "o3"), one("self", 1, "o4", "o4"), one("twice", 1, "o5"), one("twice", 2, "o5"), one("old", 1, "o6"), one("link", 1, "o7", "nobody")],
        "batch_id string, sequence int, operation_id string, entity_kind string, intent_kind string, base_revision bigint, payload string, payload_sha256 string, supersedes_operation_id string",
    )
    projects = spark.createDataFrame([("p", "LEGACY", 0)], "project_id string, actual_mode string, actual_epoch int")
    allow = spark.createDataFrame([("good", "v1", True, ["a"], ["a"])], "contract_sha256 string, version string, enabled boolean, required array<string>, allowed array<string>")
    known = spark.createDataFrame([("known", "p")], "operation_id string, project_id string")
    out = dict(rows(contract_audit(batches, intents, projects, allow, known)))
    assert out == {"ok": None, "gap": "INVALID_ARGUMENT", "self": "INVALID_ARGUMENT", "twice": "OPERATION_ID_REUSED", "old": "STALE_MIGRATION_EPOCH", "link": "INVALID_ARGUMENT", "empty": None}


def test_invariants(spark):
    versions = spark.createDataFrame([("d", 1), ("d", 3)], "document_id string, revision bigint")
    current = spark.createDataFrame(
        [("p", "d", "x", False, None, False), ("p", "e", "x", False, None, True), ("p", "f", "y", True, None, False)],
        "project_id string, document_id string, relative_path string, is_deleted boolean, deleted_at string, structure_changed boolean",
    )
    requests = spark.createDataFrame([("o", "1", "CONTRACT_BATCH", None), ("o", "2", "LEGACY", None)], "operation_id string, payload_digest string, provenance string, batch_id string")
    folders = spark.createDataFrame(
        [("a", "b", "a", "p", False), ("b", "a", "b", "p", False), ("c", None, "N", "p", False), ("e", None, "n.", "p", False), ("g", "c", "g", "q", False)],
        "id string, parent_id string, name string, project_id string, is_deleted boolean",
    )
    orders = spark.createDataFrame([(["a", "zz", "c", "c"],)], "children array<string>")
    events = spark.createDataFrame([("o", 1), ("o", 2), ("q", 2)], "operation_id string, event_sequence bigint")
    out = rows(invariant_audit(versions, current, requests, folders, orders, folders.select("id", "is_deleted"), events).select("invariant", "subject"))
    assert out == [
        ("INV-001", "d"), ("INV-002", "o"), ("INV-003", "x"), ("INV-005", "c"), ("INV-005", "zz"), ("INV-006", "f"), ("INV-009", "o"),
        ("INV-010", "a"), ("INV-010", "b"), ("INV-010", "g"), ("INV-011", "q"), ("INV-012", "n"), ("INV-013", "e"),
    ]


def test_restore_candidates(spark):
    digest = hashlib.sha256(b"old").hexdigest()
    snaps = spark.createDataFrame([("b1", "p", "d", digest), ("b2", "p", "d", "0"), ("b3", "q", "d", digest)], "backup_id string, project_id string, document_id string, content_hash string")
    contents = spark.createDataFrame([("b1", "old"), ("b2", "old"), ("b3", "old")], "backup_id string, text string")
    docs = spark.createDataFrame([("d", "p", "now", 4)], "document_id string, project_id string, text string, generation bigint")
    out = rows(L.restore_candidates(snaps, contents, docs).select("backup_id", "row_kind", "row_hash", "row_generation"))
    assert out == [("b1", "beforeRestore", hashlib.sha256(b"now").hexdigest(), 4), ("b1", "restored", digest, 5)]


def test_insert_only_table(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k long, part string, v string, w long"
    offer = lambda rows: sorted((r.k or 0, r.part, r.outcome) for r in sinks.insert_only(spark.createDataFrame(rows, schema), path, ["k", "part"]).collect())
    held = lambda: sorted((r.k or 0, r.part, r.v) for r in sinks.read_inserted(spark, path).collect())
    first = [(1, "a", "x", 1), (2, "a", "x", None), (2, "a", "x", None), (3, "a", "x", 1), (3, "a", "y", 1), (None, "a", None, 1)]
    assert offer(first) == [(0, "a", "inserted"), (1, "a", "inserted"), (2, "a", "inserted"), (3, "a", "refused")]
    assert offer(first) == [(0, "a", "present"), (1, "a", "present"), (2, "a", "present"), (3, "a", "refused")]
    assert held() == [(0, "a", None), (1, "a", "x"), (2, "a", "x")]
    assert offer([(1, "a", "other", 1), (1, "b", "x", 1), (2, "a", "x", 0)]) == [(1, "a", "refused"), (1, "b", "inserted"), (2, "a", "refused")]
    # files that no manifest entry names are not part of the table
    spark.createDataFrame([(9, "z", "x", 1, "p")], schema + ", _payload string").write.parquet(f"{path}/rows/batch=left")
    assert held() == [(0, "a", None), (1, "a", "x"), (1, "b", "x"), (2, "a", "x")]
    # a manifest number taken meanwhile: the offer is judged again
    real, calls = sinks._last_version, []
    try:
        sinks._last_version = lambda s, p: calls.append(1) or (real(s, p) - 1 if len(calls) == 1 else real(s, p))
        assert offer([(1, "b", "x", 1), (5, "c", "x", 1)]) == [(1, "b", "present"), (5, "c", "inserted")]
        assert len(calls) == 2
    finally:
        sinks._last_version = real
    assert sum(1 for r in held() if r[:2] == (1, "b")) == 1


def test_manuscript_of_many_parts(spark, tmp_path):
    from quire.plans import manuscript as M

    path = str(tmp_path / "books")
    chapters = spark.range(1, 401).selectExpr("if(id <= 300, 'p', 'q') as project_id", "id as number", "concat('text ', id, '\\nmore') as text", "'t' as prefix")
    clash = spark.createDataFrame([("r", 1, "x", "t"), ("r", 1, "y", "t")], "project_id string, number long, text string, prefix string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_manuscript_parts(M.manuscript_rows(chapters.union(clash)), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {}
    for r in sorted(sinks.read_manuscript_files(spark, path).collect(), key=lambda r: r.file):
        got[r.file_name] = got.get(r.file_name, "") + r.content
    assert len(sinks.read_manuscript_files(spark, path).where("file_name like 'p%'").collect()) > 1
    text = lambda low, high: "\n\n".join(f"text {i}\nmore" for i in range(low, high)) + "\n"
    assert got == {"p(1~300화).txt": text(1, 301), "q(301~400화).txt": text(301, 401)}
