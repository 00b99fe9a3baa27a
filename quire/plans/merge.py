"""Reconciling divergent versions: set rules first, line merge for the rest."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.plans.ledger import MAX_CONTENT_BYTES

#: Pairs of lines that the matcher may compare, and steps of a search for the shortest edit path.
MATCHED, WALK = 1_000_000, 20_000_000


def _lines(text: str) -> list[str]:
    return [line + "\n" for line in text.splitlines()]


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Lines that occur once on each side, the longest run of them that rises on both."""
    once_a, once_b = ({line for line, n in Counter(side).items() if n == 1} for side in (a, b))
    places = {line: j for j, line in enumerate(b) if line in once_b}
    pairs = [(i, places[line]) for i, line in enumerate(a) if line in once_a and line in places]
    ends, tails, before = [], [], [0] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        ends[at : at + 1], tails[at : at + 1] = [j], [n]
        before[n] = tails[at - 1] if at else -1
    out, n = [], tails[-1] if tails else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _fewest_edits(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]] | None:
    """Changed stretches (a from, to, b from, to) of a shortest edit path, if it is found in ``WALK`` steps."""
    reach, trail, steps = {1: 0}, [], 0
    for edits in range(len(a) + len(b) + 1):
        trail.append(dict(reach))
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
            x = begin = reach[k + 1] if down else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            steps += x - begin + 1
            if x >= len(a) and x - k >= len(b):
                return _stretches(trail, k, x)
        if steps > WALK:
            return None
    return None


def _stretches(trail: list[dict[int, int]], k: int, x: int) -> list[tuple[int, int, int, int]]:
    """The edits of a path, walked back, as stretches without equal lines inside."""
    out: list[list[int]] = []
    for edits in range(len(trail) - 1, 0, -1):
        reach = trail[edits]
        down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
        k = k + 1 if down else k - 1
        x = reach[k]
        step = [x, x + (not down), x - k, x - k + down]
        if out and out[-1][0] == step[1] and out[-1][2] == step[3]:
            out[-1][0], out[-1][2] = step[0], step[2]
        else:
            out.append(step)
    return [tuple(s) for s in reversed(out)]


def _stretches_of(base: list[str], changed: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Changed stretches (base from, to, changed from, to), in order.

    Equal ends are cut off; lines unique on both sides part what is left into
    pieces, and so on within them. Only pieces without such a line are
    compared line by line: small ones by the matcher, larger ones along a
    shortest edit path. A large piece with too many edits is one change.
    """
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(line, len(codes)) for line in side] for side in (base, changed))
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
        if i == k or j == m:
            if i < k or j < m:
                yield i, k, j, m
            continue
        one, two = a[i:k], b[j:m]
        found = _anchors(one, two)
        if found:
            starts = [(0, 0), *[(x + 1, y + 1) for x, y in found]]
            ends = [*found, (len(one), len(two))]
            pieces = [(i + x, i + u, j + y, j + v) for (x, y), (u, v) in zip(starts, ends, strict=True)]
            todo += reversed(pieces)
            continue
        if len(one) * len(two) <= MATCHED:
            codes_of = SequenceMatcher(None, one, two, autojunk=False).get_opcodes()
            parts = [tuple(c[1:]) for c in codes_of if c[0] != "equal"]
        else:
            parts = _fewest_edits(one, two) or [(0, len(one), 0, len(two))]
        yield from ((i + x, i + u, j + y, j + v) for x, u, y, v in parts)


def _changes(base: list[str], changed: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(first, last, start, stop, growth) of each change against the base.

    A base is gaps and lines in turn: the gap before line k is place 2k, the
    line 2k + 1. An insertion owns its gap, a change the places from its first
    to its last line.
    """
    for start, stop, c, d in _stretches_of(base, changed):
        if start == stop:
            yield 2 * start, 2 * start, start, stop, d - c
        else:
            yield 2 * start + 1, 2 * stop - 1, start, stop, d - c - (stop - start)


def merge_lines(base: str, local: str, remote: str) -> tuple[str | None, int]:
    """Merged text and number of conflicts; no text if there are conflicts.

    One sweep over the places: changes that own a common place form a region,
    and each side's lines of a region are read from its own text.
    """
    rows, sides = _lines(base), (_lines(local), _lines(remote))
    marks = sorted((*change, side) for side, lines in enumerate(sides) for change in _changes(rows, lines))
    out, done, conflicts, moved, i = [], 0, 0, [0, 0], 0
    while i < len(marks):
        region, reach = [], marks[i][1]
        while i < len(marks) and marks[i][0] <= reach:
            region.append(marks[i])
            reach = max(reach, marks[i][1])
            i += 1
        low, high = min(m[2] for m in region), max(m[3] for m in region)
        versions = []
        for side, lines in enumerate(sides):
            growth = [m[4] for m in region if m[5] == side]
            if growth:
                begin = low + moved[side]
                moved[side] += sum(growth)
                versions.append(lines[begin : high + moved[side]])
        conflicts += len(versions) == 2 and versions[0] != versions[1]
        out += rows[done:low] + versions[0]
        done = high
    return (None if conflicts else "".join(out + rows[done:])), conflicts


def _merge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        merged = [merge_lines(*row) for row in zip(batch["base"], batch["local"], batch["remote"])]
        yield pd.DataFrame(
            {
                "pair_id": batch["pair_id"],
                "content": [text for text, _ in merged],
                "conflicts": [count for _, count in merged],
            }
        )


def _one_sided(base: Column, local: Column, remote: Column) -> Column:
    """The value both sides agree on, or the only changed one; else null."""
    return (
        F.when(local.eqNullSafe(remote), local)
        .when(local.eqNullSafe(base), remote)
        .when(remote.eqNullSafe(base), local)
    )


def reconcile_versions(pairs: DataFrame) -> DataFrame:
    """Merged text and path of each pair of divergent versions.

    ``pairs``: ``pair_id, base, local, remote, base_path, local_path,
    remote_path, remote_deleted``. ``outcome`` is ``merged``, ``conflict``,
    ``PATH_CONFLICT``, ``CONTENT_TOO_LARGE`` or ``REMOTE_DELETION``. Only
    pairs changed on both sides meet the line merge, spread evenly by id. Texts
    are judged before paths: a pair in conflict in both is ``conflict``.
    """
    kind = pairs.schema["pair_id"].dataType.simpleString()
    simple = _one_sided(F.col("base"), F.col("local"), F.col("remote"))
    path = _one_sided(F.col("base_path"), F.col("local_path"), F.col("remote_path"))
    judged = pairs.withColumns({"_simple": simple, "merged_path": path})
    open_pairs = judged.where("_simple IS NULL AND NOT remote_deleted")
    merged = (
        open_pairs.select("pair_id", "base", "local", "remote")
        .repartition("pair_id")
        .mapInPandas(_merge_batches, f"pair_id {kind}, content string, conflicts bigint")
    )
    joined = judged.join(merged, "pair_id", "left")
    content = F.coalesce("_simple", "content")
    outcome = (
        F.when(F.col("remote_deleted"), "REMOTE_DELETION")
        .when(F.coalesce("conflicts", F.lit(0)) > 0, "conflict")
        .when(F.col("merged_path").isNull(), "PATH_CONFLICT")
        .when(F.octet_length(content) > MAX_CONTENT_BYTES, "CONTENT_TOO_LARGE")
        .otherwise("merged")
    )
    done = F.col("outcome") == "merged"
    return joined.withColumn("outcome", outcome).select(
        "pair_id",
        "outcome",
        F.when(done, content).alias("content"),
        F.when(done, F.col("merged_path")).alias("path"),
        F.coalesce("conflicts", F.lit(0)).alias("conflicts"),
    )
