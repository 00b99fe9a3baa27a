"""Exact duplicates: files that come later, digests that collide, odd rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quire.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string, place int"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _brute(rows):
    """The fates of rows (doc_id, text), as a sorted list."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(_lower(text), []).append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        spent = False
        for doc in ids:
            kept = doc == keep and not spent
            spent = spent or kept
            out.append((doc, keep, len(ids), kept, sha))
    return sorted(out, key=str)


def _table(spark, path, rows, mode="overwrite"):
    spark.createDataFrame([(i, t, "own", 7) for i, t in rows], SCHEMA).repartition(2).write.mode(mode).parquet(path)


def _fates(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


ROWS = [
    (1, "Same text"), (2, "same TEXT"), (9, "SAME text"), (3, "other"), (3, "other"), (3, "another"), (4, None), (5, ""),
    (None, "lone"), (None, "LONE"), (6, "lone"), (None, "ÄÖ"), (None, "Äö"), (None, "ÄÖ"), (7, "x" * 300_000), (8, "X" * 300_000), (10, "x" * 299_999),
]


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    _table(spark, path, ROWS)
    assert _fates(exact_dedup.deduplicate(spark, path)) == _brute(ROWS)
    kept = exact_dedup.distinct_documents(spark, path)
    assert kept.columns == ["doc_id", "text", "kept", "place"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3, 3, 5, 6, 8, 9, 10]


def test_texts_decide_where_digests_collide(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    _table(spark, path, ROWS)
    weak = exact_dedup.deduplicate(spark, path, digest=lambda text: F.crc32(text.cast("binary")) % 2)
    assert _fates(weak) == _brute(ROWS)


def test_state_outlives_the_run(spark, tmp_path):
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    _table(spark, path, ROWS[:9])
    assert _fates(exact_dedup.deduplicate(spark, path, folder)) == _brute(ROWS[:9])
    _table(spark, path, ROWS[9:], "append")
    groups = exact_dedup.index(spark, path, folder)
    assert groups.agg(F.sum("size")).first()[0] == len(ROWS)
    assert len(list((tmp_path / "state" / "groups").glob("batch=*"))) == 2
    assert _fates(exact_dedup.deduplicate(spark, path, folder)) == _brute(ROWS)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert exact_dedup.deduplicate(spark, path).collect() == []
    assert exact_dedup.distinct_documents(spark, path).collect() == []
