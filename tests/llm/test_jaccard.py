from __future__ import annotations

import random

import numpy as np
import pytest

from quire.llm import jaccard as J


def _set(text):
    words = "".join(c.lower() if c.isascii() else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted(((d, len(s), ids.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _family(draw, words, copies, edits, first):
    base = [f"w{draw.randrange(900)}" for _ in range(words)]
    out = []
    for k in range(copies):
        copy = list(base)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10_000)}"
        out.append((first + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = []
    for words, copies, edits in ((3, 3, 0), (9, 12, 1), (12, 15, 1), (30, 25, 2), (80, 30, 5), (200, 25, 12), (400, 12, 25)):
        rows += _family(draw, words, copies, edits, 1000 * len(rows))
    rows += [(7, None), (8, ""), (9, " \n\t"), (10, "one"), (11, "ONE"), (11, "ONE"), (12, "one two"), (None, "one two"), (None, "alone here"), (13, "É one"), (14, "é one")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, cls string")
    got = sorted((tuple(r) for r in J.join_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_linked_sets_share_an_asked_signature():
    draw = np.random.default_rng(3)
    for size in [*range(1, 40), *range(40, 700, 23)]:
        for _ in range(6):
            a = np.unique(draw.integers(1, 1 << 62, size).astype(np.uint64))
            most = J.most_different(len(a), len(a)) // 2
            b = a.copy()
            for _ in range(most):
                b[draw.integers(len(b))] = draw.integers(1, 1 << 62)
            b = np.unique(b[int(draw.integers(0, 2)) * (most > 0) :])
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common) or len(a) == common == len(b):
                continue
            (sa, qa), (sb, qb) = J.signatures(a), J.signatures(b)
            shared_by_a = set(sa[qa].tolist()) & set(sb.tolist())
            shared_by_b = set(sb[qb].tolist()) & set(sa.tolist())
            assert shared_by_a and shared_by_b


def test_sketches_never_rule_out_a_link():
    draw = np.random.default_rng(4)
    a = np.unique(draw.integers(1, 1 << 62, 300).astype(np.uint64) << np.uint64(2))
    b = np.concatenate([a[20:], draw.integers(1, 1 << 62, 20).astype(np.uint64) << np.uint64(2)])
    apart = np.bitwise_count((J._sketch(a) ^ J._sketch(b)).view(np.uint64)).sum()
    assert 30 <= apart <= 40


def test_empty_table_and_one_of_each(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.join_components(empty).collect() == []
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "a b c d e f"), (2, ""), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in J.one_of_each(docs).collect()) == [1, 2, 4]
