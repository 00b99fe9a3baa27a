"""Small fixed cases: merges, storage names, folder plans, search, retention."""

from __future__ import annotations

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions.digests import uuid5
from quire.functions.tables import assigned_ranges
from quire.functions.text import grapheme_count, rewrite_typography, unmatched_brackets, utf16_length
from quire.operators import windows as W
from quire.operators.ordering import natural_order
from quire.plans import hierarchy as H, manuscript as M, search as S
from quire.plans.ledger import rate_limit_large
from quire.plans.merge import merge_lines, reconcile_versions
from quire.plans.storage_keys import with_storage_key
from tests.conftest import rows

# Three-way merge cases (base, local, remote, expected, conflicts).
MERGES = [
    ("red\ngreen\nblue\n", "dark red\ngreen\nblue\n", "red\ngreen\npale blue\n", "dark red\ngreen\npale blue\n", 0),
    ("one\ntwo\n", "one\ntwo\nthree", "one\ndeux", "one\ndeux\nthree\n", 0),
    ("keep\ndrop\nalter\nend\n", "keep\nalter\nend\n", "keep\ndrop\naltered\nend\n", "keep\naltered\nend\n", 0),
    ("a\nb\n", "a\nb", "a\nB\n", "a\nB\n", 0),
    ("", "only here", "", "only here", 0),
    ("same\n", "mine\n", "yours\n", None, 1),
    ("x\ny\n", "x\nnew\ny\n", "x\nnew\ny\n", "x\nnew\ny\n", 0),
    ("x\ny\n", "x\nmine\ny\n", "x\nyours\ny\n", None, 1),
    ("r\nr\nr\n", "r\nr\nr\nr\n", "r\nr\nr\n", "r\nr\nr\nr\n", 0),
    ("p\r\nq\r\n", "P\r\nq\r\n", "p\r\nQ\r\n", "P\nQ\n", 0),
]


def test_merge_cases(spark):
    pairs = [(i, *m[:3], "p", "p", "p", False) for i, m in enumerate(MERGES)]
    df = spark.createDataFrame(
        pairs, "pair_id bigint, base string, local string, remote string, base_path string, "
        "local_path string, remote_path string, remote_deleted boolean",
    )
    out = {r.pair_id: r for r in reconcile_versions(df).collect()}
    for i, (*_, expected, conflicts) in enumerate(MERGES):
        assert (out[i].content, out[i].conflicts) == (expected, conflicts)
        assert out[i].outcome == ("conflict" if conflicts else "merged")


def test_text_conflict_before_path_conflict(spark):
    df = spark.createDataFrame(
        [(1, "a\n", "b\n", "c\n", "p", "q", "r", False), (2, "a\n", "b\n", "a\n", "p", "q", "r", False)],
        "pair_id bigint, base string, local string, remote string, base_path string, local_path string, remote_path string, remote_deleted boolean",
    )
    out = {r.pair_id: (r.outcome, r.conflicts) for r in reconcile_versions(df).collect()}
    assert out == {1: ("conflict", 1), 2: ("PATH_CONFLICT", 0)}


def test_merge_long_document():
    base = [f"line {i}\n" for i in range(2000)]
    local, remote = list(base), list(base)
    local[10], local[1500], remote[700] = "mine\n", "mine too\n", "theirs\n"
    expected = list(local)
    expected[700] = "theirs\n"
    assert merge_lines("".join(base), "".join(local), "".join(remote)) == ("".join(expected), 0)


def test_merge_paths_and_limits(spark):
    base = "a\n"
    cases = [
        (1, base, "b\n", base, "p", "q", "r", False),
        (2, base, "b\n", base, "p", "q", "p", False),
        (3, base, "b\n", base, "p", "p", "p", True),
        (4, base, "x" * (10 * 1024 * 1024 + 1), base, "p", "p", "p", False),
    ]
    df = spark.createDataFrame(
        cases, "pair_id bigint, base string, local string, remote string, base_path string, "
        "local_path string, remote_path string, remote_deleted boolean",
    )
    out = {r.pair_id: (r.outcome, r.path) for r in reconcile_versions(df).collect()}
    assert out == {1: ("PATH_CONFLICT", None), 2: ("merged", "q"), 3: ("REMOTE_DELETION", None), 4: ("CONTENT_TOO_LARGE", None)}


# Names with their storage key or error code.
STORAGE_NAMES = [
    ("Résumé", "résumé", None), ("Résumé", "résumé", None), ("FILE.TXT", "file.txt", None),
    ("File. ", "file", None), ("폴더", "폴더", None), ("İ", "i̇", None), ("Straße", "strasse", None),
    (" leading", " leading", None), ("A B", "a b", None), ("ＡＢＣ", "abc", None),
    ("CON.txt", None, "STORAGE_NAME_RESERVED"), ("folder/name", None, "STORAGE_NAME_INVALID"),
    ("folder\\name", None, "STORAGE_NAME_INVALID"), (". ", None, "STORAGE_NAME_INVALID"), ("", None, "STORAGE_NAME_INVALID"),
    ("a／b", None, "STORAGE_NAME_INVALID"), ("℅", None, "STORAGE_NAME_INVALID"), ("﹨", None, "STORAGE_NAME_INVALID"),
    ("ab", None, "STORAGE_NAME_UNSUPPORTED_SCALAR"), ("\U000e0041", None, "STORAGE_NAME_UNSUPPORTED_SCALAR"),
    ("\U000e0100", None, "STORAGE_NAME_UNSUPPORTED_SCALAR"), ("\U0001ccd6", None, "STORAGE_NAME_UNASSIGNED"),
    ("\U00010d50", None, "STORAGE_NAME_UNASSIGNED"), ("\U00013046́", None, "STORAGE_NAME_INVALID"),
    ("\U00013046ﾞ", None, "STORAGE_NAME_INVALID"), ("\U00013046a", "\U00013046a", None),
    ("\U0001f642️", "\U0001f642️", None), ("ꭰ", "Ꭰ", None), ("ᲀ", "в", None),
]


def test_storage_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(STORAGE_NAMES)], "i int, name string")
    out = {r.i: (r.storage_key, r.storage_code) for r in with_storage_key(df).collect()}
    for i, (_, key, code) in enumerate(STORAGE_NAMES):
        assert out[i] == (key, code), STORAGE_NAMES[i]


def test_assigned_set_size():
    # Number of ranges and scalars of Unicode 14.0
    ranges = assigned_ranges()
    assert (len(ranges), sum(b - a + 1 for a, b in ranges)) == (698, 282230)


def test_derived_uuid(spark):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = ["a", "폴더/이름", "x" * 200, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(space, F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(uuid.UUID(space), n)) for n in names}


# --- folder plans -----------------------------------------------------------------------


def _plan(spark, remote, local, blocked=None):
    r = spark.createDataFrame(remote, "folder_id string, parent_folder_id string, name string, is_deleted boolean")
    n = spark.createDataFrame(local, "document_id string, kind string, relative_path string")
    b = None if blocked is None else spark.createDataFrame([(x,) for x in blocked], "folder_id string")
    return {x.folder_id: (x.action, x.reason, x.from_path, x.path) for x in H.plan_folders(r, n, b).collect()}


def test_rename_moves(spark):
    assert _plan(spark, [("a", None, "new", False)], [("a", "folder", "old")]) == {"a": ("move", None, "old", "new")}


def test_absent_left_alone_and_tombstone_deletes(spark):
    local = [("a", "folder", "x"), ("b", "folder", "y")]
    assert _plan(spark, [("b", None, "y", True)], local) == {"b": ("delete", None, None, "y")}


def test_occupied_and_two_wanting_one_place(spark):
    out = _plan(spark, [("a", None, "x", False)], [("z", "text", "x")])
    assert out == {"a": ("conflict", "destinationOccupied", None, "x")}
    out = _plan(spark, [("a", None, "x", False), ("b", None, "x", False)], [("a", "folder", "o")])
    assert {k: v[:2] for k, v in out.items()} == {k: ("conflict", "destinationOccupied") for k in "ab"}


def test_vacated_place_is_usable(spark):
    remote = [("a", None, "two", False), ("b", None, "one", False)]
    out = _plan(spark, remote, [("a", "folder", "one"), ("b", "folder", "two")])
    assert {k: v[0] for k, v in out.items()} == {"a": "move", "b": "move"}


def test_blocked_cycle_unknown_and_local_parent(spark):
    remote = [
        ("a", "b", "a", False), ("b", "a", "b", False), ("c", "missing", "c", False), ("d", "here", "d", False),
        ("e", None, "e", False), ("f", "g", "f", False), ("g", None, "g", True),
    ]
    out = _plan(spark, remote, [("here", "folder", "메인/설정집")], blocked=["e"])
    assert out["a"][:2] == out["b"][:2] == ("conflict", "parentCycle")
    assert out["c"][:2] == ("conflict", "unknownParent")
    assert out["d"] == ("create", None, None, "메인/설정집/d")
    assert out["e"][:2] == ("conflict", "pendingLocalOperation")
    assert out["f"][:2] == ("conflict", "unknownParent")
    assert "g" not in out


def test_unchanged_and_decomposed_names_do_nothing(spark):
    composed, decomposed = "폴더", "폴더"
    assert _plan(spark, [("a", None, composed, False)], [("a", "folder", decomposed)]) == {}


def test_deep_chain(spark):
    remote = [(str(i), None if i == 0 else str(i - 1), f"n{i}", False) for i in range(130)]
    tree = spark.createDataFrame(remote, "id string, parent_id string, name string, is_deleted boolean")
    out = {r.id: r for r in H.folder_paths(tree).collect()}
    assert out["129"].depth == 130 and out["129"].path == "/".join(f"n{i}" for i in range(130))


def test_derived_folder_ids(spark):
    project = "11111111-2222-4333-8444-555555555555"
    nodes = [("f1", "folder", None, "메인"), ("f2", "folder", "f1", "메인/원고"), ("d1", "text", "f2", "메인/원고/a.txt")]
    df = spark.createDataFrame(nodes, "document_id string, kind string, parent_id string, relative_path string")
    out = {r.old_id: r for r in H.derive_folder_ids(df, project, "folder/").collect()}
    space = uuid.UUID(project)
    top, inner = (str(uuid.uuid5(space, "folder/" + p)) for p in ("메인", "메인/원고"))
    assert (out["f1"].new_id, out["f2"].new_id, out["f2"].new_parent_id) == (top, inner, top)
    assert (out["d1"].new_id, out["d1"].new_parent_id) == ("d1", inner)
    server = spark.createDataFrame([("메인", "srv")], "relative_path string, folder_id string")
    assert {r.old_id: r.new_id for r in H.derive_folder_ids(df, project, "folder/", server).collect()}["f1"] == "srv"
    twice = spark.createDataFrame(nodes + [("f3", "folder", None, "/메인/")], df.schema)
    assert H.derive_folder_ids(twice, project, "folder/").count() == 0


def test_infer_renames(spark):
    nodes = spark.createDataFrame(
        [("p", "folder", "메인"), ("a", "folder", "메인/old"), ("b", "folder", "메인/kept"), ("c", "text", "메인/kept/x.txt")],
        "id string, kind string, relative_path string",
    )
    none = spark.createDataFrame([], "relative_path string")
    remote = spark.createDataFrame([("메인", "new"), ("메인", "kept")], "parent_path string, name string")
    assert rows(H.infer_renames(remote, nodes, none)) == [("a", "메인/old", "new")]
    more = spark.createDataFrame([("메인", "new"), ("메인", "newer"), ("메인", "kept")], "parent_path string, name string")
    assert rows(H.infer_renames(more, nodes, none)) == []


def test_trash_and_restore(spark):
    nodes = spark.createDataFrame(
        [
            ("m", "folder", None, "메인", 0), ("t", "folder", "m", "메인/휴지통", 9), ("s", "folder", "m", "메인/설정집", 1),
            ("a", "text", "s", "메인/설정집/a.txt", 0), ("x", "text", "t", "메인/휴지통/a.txt", 4),
        ],
        "id string, kind string, parent_id string, relative_path string, user_order bigint",
    )
    plan = H.trash_plan(nodes.where("id = 'a'"), nodes, "t", "메인/휴지통")
    assert rows(plan) == [("a", "메인/설정집/a.txt", "메인/휴지통/a_2.txt", "t", 5)]
    moved = H.relocate(nodes, plan, trashed=True).collect()
    assert [(r.id, r.relative_path, r.parent_id, r.user_order, r.original_path) for r in moved] == [
        ("a", "메인/휴지통/a_2.txt", "t", 5, "메인/설정집/a.txt")
    ]
    nested = spark.createDataFrame([("메인", "A"), ("메인/설정집", "B")], "root_path string, new_path string")
    assert rows(H.relocate(nodes, nested).select("id", "relative_path")) == [
        ("a", "B/a.txt"), ("m", "A"), ("s", "B"), ("t", "A/휴지통"), ("x", "A/휴지통/a.txt")
    ]
    assert [r.id for r in H.purge_candidates(nodes, "t").collect()] == ["x"]
    trashed = spark.createDataFrame(
        [("x", "text", "메인/설정집/a.txt", "s", 7), ("y", "folder", "메인/gone/f", "gone", -1), ("z", "text", "메인/gone/z.txt", "gone", 0)],
        "id string, kind string, original_path string, original_parent_id string, original_order bigint",
    )
    out = {r.id: r for r in H.restore_plan(trashed, nodes).collect()}
    assert (out["x"].parent_id, out["x"].new_path, out["x"].new_order) == ("s", "메인/설정집/a_2.txt", 1)
    assert (out["y"].parent_id, out["y"].new_path, out["y"].new_order, out["y"].problem) == ("m", "메인/f", 0, None)
    assert out["z"].problem == "textCannotRestoreToTop"


def test_canonical_order_keys(spark):
    df = spark.createDataFrame(
        [("p", "<root>", ["📚 원고", "플롯"]), ("p", "메인/플롯/a", ["x"]), ("q", "메인/플롯", []), ("q", "메인/스토리 플롯", [])],
        "project_id string, parent_key string, children array<string>",
    )
    out = {(r.project_id, r.parent_key): (r.children, r.valid) for r in H.canonical_order_keys(df).collect()}
    assert out[("p", "<root>")] == (["원고", "스토리 플롯"], True)
    assert out[("p", "메인/스토리 플롯/a")] == (["x"], True)
    assert out[("q", "메인/스토리 플롯")][1] is False


def test_apply_node_changes_rejects(spark):
    schema = "id string, project_id string, kind string, parent_id string, relative_path string"
    nodes = spark.createDataFrame(
        [("r", "p", "folder", None, "r"), ("a", "p", "text", "r", "r/a"), ("gone", "p", "folder", None, "gone"), ("k", "p", "text", "gone", "gone/k")],
        schema,
    )
    upserts = spark.createDataFrame(
        [("n1", "p", "text", "r", "r/A"), ("n2", "p", "text", "n2", "r/n2"), ("n3", "p", "text", "a", "r/n3"),
         ("n4", "p", "text", "gone", "r/n4"), ("a", "q", "text", None, "z"), ("ok", "p", "text", "r", "gone")],
        schema,
    )
    removed = spark.createDataFrame([("gone",)], "id string")
    after, rejected = H.apply_node_changes(nodes, upserts, removed)
    codes = {r.id: r.code for r in rejected.collect()}
    # the old row of "a" is replaced, so its path is free; its new project is not allowed
    assert codes == {"n2": "missingParent", "n3": "missingParent", "n4": "missingParent", "a": "projectCannotChange"}
    assert {r.id for r in after.collect()} == {"r", "a", "n1", "ok"}


# --- text -------------------------------------------------------------------------------


def _brute_search(text, query):
    return [(m.start(), len(text[: m.start()].encode("utf-16-be")) // 2) for m in re.finditer(re.escape(query), text, re.I)]


@pytest.mark.parametrize("query", ["a", "Ab", "é", "🐈", ".", "\\E"])
def test_search_offsets(spark, query):
    rng = random.Random(7)
    alphabet = ["a", "b", "A", "B", "é", "É", "🐈", ".", "\n", " ", "\\", "E", "가"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 300, 3000]))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    out = {}
    for r in S.search(df, query).collect():
        out.setdefault(r.document_id, []).append((r.cp_location, r.utf16_location))
    for i, text in enumerate(texts):
        assert out.get(i, []) == _brute_search(text, query)


def _brute_excerpt(text, at, length):
    units = text.encode("utf-16-be")
    cp_of = lambda u: len(units[: 2 * u].decode("utf-16-be", "ignore"))
    u16 = len(text[:at].encode("utf-16-be")) // 2
    end16 = len(text[: at + length].encode("utf-16-be")) // 2
    start, end = cp_of(max(0, u16 - 80)), cp_of(min(len(units) // 2, end16 + 80))
    if end < len(text) and len(text[:end].encode("utf-16-be")) // 2 < min(len(units) // 2, end16 + 80):
        end += 1
    stops = set(".!?\n\r。！？")
    for i in range(at - 1, start - 1, -1):
        if text[i] in stops:
            start = i + 1
            break
    for i in range(at + length, end):
        if text[i] in stops:
            end = i + 1
            break
    lead, tail = ("…" if start > 0 else ""), ("…" if end < len(text) else "")
    return lead + text[start:end] + tail, len(text[start:at].encode("utf-16-be")) // 2 + len(lead)


def test_excerpts(spark):
    rng = random.Random(3)
    alphabet = ["x", "y", "z", " ", "가", "é", "🐈"] * 6 + [".", "\n", "。"]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) + "Key" + "".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 3, 70, 80, 81, 200, 1500, 2100)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    found = S.search(df, "key", excerpts=True).collect()
    assert len(found) >= len(texts)
    for r in found:
        assert (r.preview, r.preview_offset) == _brute_excerpt(texts[r.document_id], r.cp_location, 3)


def test_empty_query_has_no_hits(spark):
    df = spark.createDataFrame([(1, "abc")], "document_id int, text string")
    assert S.search(df, "").count() == 0
    assert rows(S.search_report(df, "")) == [(1, 0, 0, 0, 0)]


def test_lengths_and_typography(spark):
    text = "é👩‍👩‍👧 가\r\n"
    df = spark.createDataFrame([(text, "a...b\n*\nㄴㄴ ㄱㄱ ( [ ]")], "t string, u string")
    row = df.select(grapheme_count(F.col("t")), utf16_length(F.col("t")), rewrite_typography(F.col("u")), unmatched_brackets(F.col("u"))).first()
    assert row[0] == 5 and row[1] == len(text.encode("utf-16-be")) // 2
    assert row[2] == "a⋯b\n\n\n * * *\n\n\n「」 『』 ( [ ]" and row[3] == 1


def test_names(spark):
    cases = [
        ("", "empty"), ("..", "dotSegment"), ("a\tb", "controlCharacter"), ("a:b", "forbiddenCharacter"), ("a ", "trailingSpaceOrPeriod"),
        ("con.txt", "reservedName"), ("x" * 256, "nameTooLong"), ("🐈" * 128, "nameTooLong"), ("ok.txt", None), ("a‍b", "controlCharacter"),
    ]
    df = spark.createDataFrame([(n,) for n, _ in cases], "n string")
    assert [r[0] for r in df.select(N.name_violation(F.col("n"))).collect()] == [c for _, c in cases]
    chapters = [("001화.txt", 1), ("1화.txt", None), ("0001화.txt", None), ("1000화 제목.txt", 1000), ("000화.txt", None), ("12화.txt", None), ("١٢٣화.txt", None)]
    df = spark.createDataFrame([(n,) for n, _ in chapters], "n string")
    assert [r[0] for r in df.select(N.chapter_number(F.col("n"))).collect()] == [v for _, v in chapters]
    volumes = [("1권", 1), ("01권", None), ("0권", None), ("12권", 12), ("권", None), ("1 권", None)]
    df = spark.createDataFrame([(n,) for n, _ in volumes], "n string")
    assert [r[0] for r in df.select(N.volume_number(F.col("n"))).collect()] == [v for _, v in volumes]
    ordered = spark.createDataFrame([("b",), ("10권",), ("002화.txt",), ("a",), ("1권",)], "n string")
    assert [r.n for r in natural_order(ordered, "n").collect()] == ["1권", "002화.txt", "10권", "a", "b"]


def test_assembly_boundary(spark):
    data = [("p", f"메인/원고/1권/{n:03d}화.txt", "x" * size) for n, size in [(1, 300), (2, 0), (3, 400), (5, 299), (6, 500)]]
    nodes = spark.createDataFrame(data, "project_id string, relative_path string, text string")
    chapters = M.manuscript_chapters(nodes)
    assert [r.number for r in M.missing_chapters(chapters).collect()] == [4]
    row = M.assemble(chapters, skip_empty=True, titles=True).first()
    assert (row.first_number, row.last_number, row.file_name) == (1, 6, "p(1~6화).txt")
    # the empty chapter is short, so stopping comes before skipping
    short = M.assemble(chapters, stop_short=True, skip_empty=True).first()
    assert (short.first_number, short.last_number, len(short.content)) == (1, 1, 300)
    parts = "".join(r.part for r in M.assemble_parts(chapters, titles=True).collect())
    assert parts == M.assemble(chapters, titles=True).first().content
    twice = nodes.unionByName(spark.createDataFrame([("p", "메인/원고/2권/001화 b.txt", "y")], nodes.schema))
    assert M.assemble(M.manuscript_chapters(twice)).first().problem == "duplicateChapterNumber"
    with pytest.raises(ValueError):
        M.assemble(chapters, first=3, last=2)


# --- snapshots --------------------------------------------------------------------------


def _brute_retention(snaps, now, recent, days):
    out = set()
    for doc in {s["document_id"] for s in snaps}:
        mine = sorted((s for s in snaps if s["document_id"] == doc and not s["is_pinned"]), key=lambda s: (-s["created_at"].timestamp(), s["backup_id"]))
        young = [s for s in mine if now - dt.timedelta(days=1) <= s["created_at"] <= now]
        out |= {s["backup_id"] for s in young[recent:]}
        seen = set()
        for s in mine:
            if s["created_at"] >= now - dt.timedelta(days=1):
                continue
            day = s["created_at"].date()
            if s["created_at"] < now - dt.timedelta(days=days) or day in seen:
                out.add(s["backup_id"])
            if s["created_at"] >= now - dt.timedelta(days=days):
                seen.add(day)
    return out


def test_retention_by_brute_force(spark):
    now, rng = dt.datetime(2026, 3, 1, 12), random.Random(5)
    snaps = [
        {"backup_id": f"b{i:05d}", "document_id": f"d{rng.randrange(3)}", "created_at": now - dt.timedelta(seconds=600 * (i - 5)), "is_pinned": i % 97 == 0}
        for i in range(3000)
    ]
    schema = "backup_id string, document_id string, created_at timestamp_ntz, is_pinned boolean"
    expected = _brute_retention(snaps, now, 30, 14)
    moment = F.expr("TIMESTAMP_NTZ '2026-03-01 12:00:00'")
    for data in (snaps, snaps[::-1], snaps * 6):
        df = spark.createDataFrame(data, schema)
        out = [r.backup_id for r in W.retention_deletions(df, moment, 30, 14).collect()]
        assert len(out) == len(set(out)) and set(out) == expected


def test_policy_out_of_range_falls_back():
    assert W.retention_policy(0, 4000) == (30, 30)
    assert W.retention_policy(500, 3650) == (500, 3650)


def _brute_rate_limit(saves, large, seconds):
    kept, last = set(), {}
    for doc, at, backup, size in sorted(saves):
        before = last.get(doc)
        if size < large or before is None or at - before >= seconds:
            kept.add(backup)
            last[doc] = at
    return kept


@pytest.mark.parametrize("limits", [None, ("0", "3")])
def test_rate_limit_by_brute_force(spark, limits):
    rng = random.Random(11)
    saves = [(f"d{rng.randrange(4)}", rng.randrange(40000), f"b{i:04d}", rng.choice([10, 2_000_000, 3_000_000])) for i in range(800)]
    df = spark.createDataFrame(saves, "document_id string, at bigint, backup_id string, byte_count bigint").select(
        "document_id", "backup_id", "byte_count", F.timestamp_seconds("at").alias("created_at"), F.lit("automaticSave").alias("reason")
    )
    if limits:
        spark.conf.set("quire.taskBytes", limits[0])
        spark.conf.set("quire.taskRows", limits[1])
    try:
        kept = [r.backup_id for r in rate_limit_large(df, 1024 * 1024, 300).collect()]
    finally:
        spark.conf.unset("quire.taskBytes")
        spark.conf.unset("quire.taskRows")
    assert len(kept) == len(set(kept)) and set(kept) == _brute_rate_limit(saves, 1024 * 1024, 300)


def test_numbers_have_no_upper_bound(spark):
    from quire.plans.hierarchy import safe_names

    requests = spark.range(1200).selectExpr("id as request_id", "'r' as parent_id", "'Note' as name")
    held = spark.createDataFrame([("r", "note"), ("r", "note 3"), ("r", "note 1100")], "parent_id string, name string")
    got = [r.safe_name for r in safe_names(requests, held).orderBy("request_id").collect()]
    free = [n for n in range(2, 1300) if n not in (3, 1100)]
    assert got == [f"Note {n}" for n in free[:1200]]


def test_deep_chains_resolve(spark):
    from quire.plans.hierarchy import folder_paths

    chain = spark.range(1500).selectExpr("cast(id as string) as id", "case when id > 0 then cast(id - 1 as string) end as parent_id", "'f' as name")
    assert folder_paths(chain).where("outcome <> 'resolved'").count() == 0
