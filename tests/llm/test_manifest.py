"""The manifest against a plain tree of lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from quire.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, hash string, height int"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    fields = (row[0], row[1], row[2], row[3], text)
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def _tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _steps(levels, place):
    for level in levels[:-1]:
        first = place // 16 * 16
        run = level[first : first + 16]
        yield "".join(run[: place - first]), "".join(run[place - first + 1 :])
        place //= 16


def _brute(rows):
    by = {}
    for row in rows:
        chosen = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if chosen else row[4]
        by.setdefault(row[1], []).append((row[0], _leaf(row, row[4]), _leaf(row, text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        by[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [_tree([x[1] for x in by[s]]) for s in order]
    top = _tree([t[-1][0] for t in trees])
    out = []
    for i, source in enumerate(order):
        for place, (doc, leaf, altered) in enumerate(by[source]):
            steps = [*_steps(trees[i], place), *_steps(top, i)]
            folded = altered
            for left, right in steps:
                folded = _h(left + folded + right)
            root = top[-1][0]
            out.append((doc, leaf, trees[i][-1][0], root, _h("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


def _case(name):
    if name == "odd":  # nulls, extreme ids, one id with many texts, repeated rows, names apart by bytes
        rows = [(None, "a", "x", 3, "Ab"), (None, "a", "x", 3, "AbC"), (5, None, None, None, None), (7, "a", "y", 1, "Q"), (None, None, None, None, None)]
        rows += [(7, "a", "y", 1, f"Q{i % 40}") for i in range(300)]
        rows += [(i, "b", "y", 1, "Q") for i in (-(2**63), 2**63 - 1, 0, -1, 64, 63, 65)] + [(5, "é", "", 0, "é" * 50_000), (6, "z", "", 0, "")]
        return rows
    if name == "sources":  # more sources than a node has slots
        return [(i, f"s{i % 19}", "x", i, "T") for i in range(60)]
    return {"empty": [], "one": [(1, "a", "b", 2, "T")], "seventeen": [(i * 1_000_003, "a", "b", 2, f"T{i}") for i in range(17)]}[name]


@pytest.mark.parametrize("name", ["odd", "sources", "empty", "one", "seventeen"])
def test_equals_plain_tree(spark, name):
    rows = _case(name)
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], SCHEMA)
    found = manifest.tamper_report(docs)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _brute(rows)


def test_manifest_tables(spark):
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in _case("sources")], SCHEMA)
    built = manifest.build(docs)
    assert sorted((r["source"], r["n"]) for r in built.sources.collect())[0] == ("s0", 4) and built.sources.count() == 19
    places = [(r["tree"], r["pos"]) for r in built.leaves.collect()]
    assert len(set(places)) == 60 and built.root.count() == 1


def test_copies_beyond_one_run(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES", 4)
    rows = [(7, "a", "y", 1, "Q")] * 23 + [(8, "a", "y", 1, "R"), (6, "a", "y", 1, "R")]
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in manifest.tamper_report(docs).collect()), key=str) == _brute(rows)
