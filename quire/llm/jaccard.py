"""Exact Jaccard join of word shingle sets by partition of the universe.

Sets of equal content form a class. Classes fall into bands of sizes; for a
band, the universe of shingles is split by hash into more segments than two
linked sets can differ in elements, so a linked pair has a segment in common.
Each class allocates the difference it may have over its segments by cost:
its smallest segments, which many sets share, are passed over as far as the
spare segments of the band allow; beyond that, some segments are asked for
with one deletion, by their own neighbourhood against the segments and
neighbourhoods of others. Every class indexes all of its segments and the
one-deletion neighbourhoods of the band's first ones.

Classes that meet in a segment are candidates. A group is not
expanded into pairs: each member first meets the leader it shares most
segments with, links are verified on whole sets and contracted to components.
Where a group is still split, the classes outside its largest component meet
the others, and parity sketches drop the pairs that cannot link inside that
join; what passes is verified. Every candidate pair is then linked, in one
component, or ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bitmap, in_bitmap, whole
from quire.session import durable

#: Words of a shingle.
WORDS = 4
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Growth of the bands of set sizes, and their largest lower end.
GROWTH, LARGEST = 1.4, 1 << 40
#: Bits of a parity sketch, as a power of two: bits that differ bound a pair's difference from below.
SKETCH = 10
#: Words whose hash a worker remembers.
MEMORY = 100_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < MEMORY:
            self[word] = found
        return found


_hashes = _Hashes()


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    if len(_hashes) >= MEMORY:
        _hashes.clear()
    words = [t.encode().lower().split() if t else [] for t in texts]  # ASCII letters and white space only
    counts = np.array([len(w) for w in words])
    codes = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), dtype=np.uint64, count=int(counts.sum()))
    ends = np.cumsum(counts)
    many = len(codes) - WORDS + 1
    total = np.full(max(many, 0), WORDS, dtype=np.uint64)
    for k in range(WORDS if many > 0 else 0):
        total = total * _M1 + codes[k : k + many]
    total = _mix(total)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(total[end - n : end - WORDS + 1]))
        elif n:
            one = np.array([n], dtype=np.uint64)
            for k in range(end - n, end):
                one = _mix(one + codes[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def most_different(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def _bands() -> list[tuple[int, int]]:
    """(lower, upper) sizes; in the first band only equal sets link."""
    upper = 1
    while most_different(upper + 1, upper + 1) == 0:
        upper += 1
    out = [(1, upper)]
    while out[-1][1] < LARGEST:
        lower = out[-1][1] + 1
        out.append((lower, max(lower, int(lower * GROWTH))))
    return out


BANDS = _bands()
_LOWER = np.array([b[0] for b in BANDS])


def shape(band: int) -> tuple[int, int, int]:
    """(difference allowed, segments, segments with one-deletion neighbourhoods) of a band."""
    allowed = most_different(BANDS[band][1], BANDS[band][1])
    spare = 0 if allowed < 4 else 1 + allowed // 8
    return allowed, allowed + 1 + spare, 1 if allowed < 40 else 2


@lru_cache(maxsize=256)
def _band(band: int) -> tuple[int, int, int, np.uint64, np.ndarray]:
    seed = _mix(np.uint64(band + 1))
    allowed, segments, deletable = shape(band)
    return allowed, segments, deletable, seed, _mix(seed + np.arange(segments, dtype=np.uint64))


def bands_of(size: int) -> list[int]:
    """The band of a size, and the next if it holds sizes that can link with this one."""
    if size == 0:
        return []
    own = int(np.searchsorted(_LOWER, size, side="right")) - 1
    out = [own] if own else []
    lower = BANDS[own + 1][0]
    return [*out, own + 1] if 100 * size >= PERCENT * lower else out


def signatures(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment signatures of a set, and which of them ask (the others are only indexed)."""
    bands = bands_of(len(items))
    if not bands:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    signs, asks = [], []
    values = _mix(items)
    for band in bands:
        allowed, segments, deletable, seed, name = _band(band)
        place = (((values ^ seed) * _M1 >> np.uint64(20)) % np.uint64(segments)).astype(np.uint32 if segments > 65535 else np.uint16)
        order = np.argsort(place, kind="stable")
        sizes = np.bincount(place, minlength=segments)
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[order], dtype=np.uint64)])
        content = sums[ends] - sums[ends - sizes]
        ask = np.ones(segments, dtype=bool)
        # allocation: pass over the smallest segments while the rest still covers the difference
        by_size = np.argsort(sizes, kind="stable")
        spare = segments - (allowed + 1)
        ask[by_size[:spare]] = False
        bare = by_size[spare : spare + int((sizes[by_size[spare:]] == 0).sum())]
        near = [i for i in range(deletable) if sizes[i] >= 3][: len(bare)]
        ask[bare[: len(near)]] = False
        ask[near] = True
        signs.append(_mix(name ^ _mix(content + sizes.astype(np.uint64))))
        asks.append(ask)
        for i in range(deletable):
            mine = values[order[ends[i] - sizes[i] : ends[i]]]
            if len(mine) > 1:
                signs.append(_mix(name[i] ^ _mix(content[i] - mine + np.uint64(sizes[i] - 1))))
                asks.append(np.full(len(mine), i in near))
    return np.concatenate(signs), np.concatenate(asks)


def _class_of(items: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes())).astype(np.int64))


def _sketch(items: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 2**SKETCH buckets."""
    odd = np.bincount((items >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, cls, sketch, signs, asks) of each row; cls names the set, null if it is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.iloc[begin : begin + 500]
                sets = shingle_sets(list(part["text"]))
                posted = [signatures(s) for s in sets]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(),
                    "text_hash": part["text_hash"].to_numpy(),
                    "n": [len(s) for s in sets],
                    "cls": pd.array([_class_of(s) if len(s) else None for s in sets], dtype="Int64"),
                    "sketch": [_sketch(s) for s in sets],
                    "signs": [p[0].astype(np.int64) for p in posted],
                    "asks": [p[1] for p in posted],
                }).astype({"doc_id": part["doc_id"].dtype})

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInPandas(facts, f"doc_id {kind}, text_hash long, n long, cls long, sketch array<long>, signs array<long>, asks array<boolean>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, decided on their whole sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, last, known = [], None, None
            for left, right in zip(batch["left"], batch["right"], strict=True):
                if right is not last:
                    last, known = right, shingles(right)
                mine = shingles(left)
                common = len(np.intersect1d(mine, known, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(mine) + len(known) - common))
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("left")), "b")
    both = both.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("right")), "a")
    return both.select("a", "b", "left", "right").mapInPandas(check, "a long, b long")


def _may_link(a: str, b: str) -> Column:
    """False where sizes or sketches rule a link out. The sides have n and sketch."""
    apart = F.aggregate(
        F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    return sizes & (apart * (100 + PERCENT) <= (n_a + n_b) * (100 - PERCENT))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class reachable over links (a, b).

    Each round takes the smallest label around a node, then the label of that
    label; written after each round.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(nodes.select("cls", F.col("cls").alias("comp")))
    while True:
        around = both.join(labels, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("near"))
        stepped = labels.join(around, F.col("cls") == F.col("a"), "left").select("cls", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        stepped = durable(stepped)
        over = stepped.select(F.col("cls").alias("comp"), F.col("comp").alias("next"))
        new = durable(stepped.join(over, "comp", "left").select("cls", F.least("comp", "next").alias("comp"), "was"))
        labels = new.select("cls", "comp")
        if new.where("comp <> was").isEmpty():
            return labels


def _links(docs: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(cls, comp) of the classes that meet others; None if none meet."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    posted = facts.where("cls is not null").select("cls", F.explode(F.arrays_zip("signs", "asks")).alias("p"))
    posted = posted.select(F.col("p.signs").alias("sign"), "cls", F.col("p.asks").alias("ask")).repartition(parts, "sign")
    # one exchange serves both sides
    meeting = posted.groupBy("sign").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.max("ask").alias("ask"))
    meeting = meeting.where("low <> high and ask").select("sign")
    groups = durable(posted.join(meeting, "sign").groupBy("sign", "cls").agg(F.max("ask").alias("ask")))
    nodes = groups.select("cls").distinct()
    met = durable(classes.join(nodes, "cls", "left_semi"))
    if met.isEmpty():
        return None
    # a group's leader is its member that meets most others: in a family, the text nearest to all
    met_by = groups.groupBy("sign").agg(F.count("*").alias("size"))
    fame = durable(groups.join(met_by, "sign").groupBy("cls").agg(F.sum("size").alias("fame")))
    known = groups.join(fame, "cls")
    leaders = known.groupBy("sign").agg(F.max_by("cls", F.struct("fame", "cls")).alias("leader"))
    # first every class with the leader it shares most segments with
    shared = groups.join(leaders, "sign").where("cls <> leader").groupBy("cls", "leader").count()
    best = shared.groupBy("cls").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    pairs = best.join(met.alias("b"), "cls").select("leader", "b.*").alias("b")
    pairs = pairs.join(met.alias("a"), F.col("b.leader") == F.col("a.cls")).where(_may_link("a", "b"))
    pairs = durable(pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")))
    links = durable(_verified(pairs, _texts(docs, pairs, met)))
    labels = components(met, links)
    # then, in groups still split, the classes outside the largest component with the others
    placed = groups.join(labels, "cls").select("sign", "cls", "ask", "comp")
    sizes = placed.groupBy("sign", "comp").agg(F.count("*").alias("n"), F.max("ask").alias("ask"))
    split = sizes.groupBy("sign").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count("*").alias("comps"), F.max("ask").alias("ask"))
    left = placed.join(split.where("comps > 1 and ask").select("sign", "largest"), "sign")
    left = durable(left.join(met.select("cls", "n", "sketch"), "cls"))
    o, m = left.where("comp <> largest").alias("o"), left.alias("m")
    once = (F.col("m.comp") == F.col("m.largest")) | (F.col("o.cls") < F.col("m.cls"))
    asked = F.col("o.ask") | F.col("m.ask")
    meets = (F.col("o.sign") == F.col("m.sign")) & (F.col("o.comp") != F.col("m.comp")) & once & asked & _may_link("o", "m")
    more = o.join(m, meets).select(F.least("o.cls", "m.cls").alias("a"), F.greatest("o.cls", "m.cls").alias("b"))
    more = durable(more.distinct())
    if more.isEmpty():
        return labels
    return components(met, links.union(_verified(more, _texts(docs, more, met))))


def _texts(docs: DataFrame, pairs: DataFrame, met: DataFrame) -> DataFrame:
    """(cls, text) of the classes in pairs, from one text of each."""
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = durable(met.join(asked, "cls", "left_semi").select("cls", "text_hash"))
    rows = in_bitmap(docs.select("text", F.xxhash64("text").alias("text_hash")), "text_hash", bitmap(chosen, "text_hash"))
    return durable(rows.join(chosen, "text_hash").select("cls", "text").dropDuplicates(["cls"]))


def join_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents without words have an empty set and link with nothing: their
    component is their own id. Equal rows, and rows of one id with different
    texts, are rows of their own; a row without an id takes part, but gives a
    component no name. An empty table gives no rows; further columns are not
    read.
    """
    facts, classes, labels = _joined(docs)
    named = classes.select("cls", "least")
    if labels is not None:
        joined = named.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        smallest = joined.groupBy("comp").agg(F.min("least").alias("component"))
        named = joined.join(smallest, "comp").select("cls", F.col("component").alias("least"))
    found = facts.select("doc_id", "n", "cls").join(named, "cls", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The facts of the rows, the classes, and (cls, comp) of the linked ones, if any."""
    facts = durable(set_facts(docs))
    classes = durable(
        facts.where("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.max("n").alias("n"), F.first("sketch").alias("sketch")
        )
    )
    return facts, classes, _links(docs, facts, classes)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, in its own columns.

    Decided by rows: the smallest id stays, null ids last, and of its texts the
    one with the smallest hash. Rows without words all stay. Repeated rows, by
    id and text, stay once, with the further columns that are smallest as JSON.
    Columns may have any names and types; an empty table gives no rows.
    """
    facts, classes, labels = _joined(docs)
    keys = durable(facts.groupBy("doc_id", "text_hash").agg(F.max("cls").alias("cls"), F.count("*").alias("n")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = keys.where("cls is not null").groupBy("cls").agg(F.min(key).alias("best"))
    if labels is not None:
        joined = best.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        smallest = joined.groupBy("comp").agg(F.min("best").alias("best"))
        best = joined.select("cls", "comp").join(smallest, "comp").select("cls", "best")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    kept = keys.join(best, "cls", "left").where(F.col("best").isNull() | first)
    kept = durable(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "n"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    rows = whole(docs, "doc_id", "text")
    single = rows.join(kept.where("n = 1"), same, "left_semi").select("row.*")
    more = kept.where("n > 1")
    if more.isEmpty():
        return single
    repeated = rows.join(more, same).groupBy("kept_id", "kept_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.union(repeated.select("row.*"))
