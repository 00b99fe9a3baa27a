"""Merkle manifest of a document table by bitmap ranks.

A row is a leaf, the digest of its fields. Its coordinate in its source is the
number of rows before it, by doc_id. No source is sorted to find it: ids are
cut into words of 64; a word keeps a bitmap of the ids it holds, and only
words in use are kept. Counts per word add up to a directory for each block,
block, region and so on up to the source, so that every window sees a bounded
number of counts. The rank of an id is the sum of its directories' entries and
the bits below its own. Repeated ids are ranked once more by their leaves, in
the same way; repeated rows stay one entry with a count until the end.

Coordinates key the nodes: sixteen slots make the array of the next node, and
each level is one shuffle of digests. Back down the same arrays every node
hands its children the digests beside them, from which a leaf's proof is
hashed and its root recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordered import with_row_number
from quire.session import durable

#: Children of a node, as a power of two.
FAN_BITS = 4
#: Bits of an id below its block, and between a directory and the next.
BLOCK_BITS, DIRECTORY_BITS = 10, 16
#: Copies of a row that one task numbers.
COPIES = 65_536
#: What a leaf takes in, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields: ``-`` for null, else its bytes' count, a colon and itself."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return _hash(F.concat(*[field(name) for name in FIELDS]))


# --- coordinates ----------------------------------------------------------------------


def _directories(blocks: DataFrame, shift: int) -> DataFrame:
    """(key, b, total) with ``before``: what the blocks of a key count before b."""
    above = F.shiftright("b", DIRECTORY_BITS)
    if shift >= 64:
        run = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        return blocks.select("key", "b", F.coalesce(F.sum("total").over(run), F.lit(0)).alias("before"))
    run = Window.partitionBy("key", "above").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("above", above).withColumn("inside", F.coalesce(F.sum("total").over(run), F.lit(0)))
    upper = blocks.groupBy("key", above.alias("b")).agg(F.sum("total").alias("total"))
    upper = _directories(upper, shift + DIRECTORY_BITS).withColumnRenamed("b", "above")
    return inside.join(upper, ["key", "above"]).select("key", "b", (F.col("inside") + F.col("before")).alias("before"))


def ranked(ids: DataFrame) -> DataFrame:
    """Add ``start``: the sum of n over the rows of the key with a smaller value, null first.

    Needs key, value (long) and n, a row for each key and value; further
    columns ride along.
    """
    facts = F.struct((F.col("value").bitwiseAND(63)).cast("int").alias("bit"), *[c for c in ids.columns if c not in ("key",)])
    dealt = ids.where("value is not null").withColumn("b", F.shiftright("value", BLOCK_BITS))
    # ids of a block meet once; its words and their running counts need no other exchange
    words = (
        dealt.withColumn("word", F.shiftright("value", 6)).repartition("key", "b").groupBy("key", "b", "word")
        .agg(
            F.bit_or(F.expr("shiftleft(1L, cast(value & 63 as int))")).alias("bits"),
            F.sum("n").alias("total"),
            F.collect_list(facts).alias("held"),
        )
    )
    earlier = Window.partitionBy("key", "b").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    words = durable(words.withColumn("before_word", F.coalesce(F.sum("total").over(earlier), F.lit(0))))
    blocks = words.groupBy("key", "b").agg(F.sum("total").alias("total"))
    starts = _directories(blocks, BLOCK_BITS + DIRECTORY_BITS)
    nulls = ids.where("value is null")
    first = nulls.select("key", F.col("n").alias("nulls"))
    found = words.join(starts, ["key", "b"]).join(first, "key", "left")
    # bits below, and the further rows of repeated ids below
    extras = F.filter("held", lambda h: h["n"] > 1)
    found = found.select("key", "bits", "before", "before_word", "nulls", extras.alias("extras"), F.explode("held").alias("h"))
    below = F.expr("bit_count(shiftleft(bits, 63 - h.bit)) - 1")  # its own bit does not count
    more = F.aggregate("extras", F.lit(0).cast("long"), lambda s, e: s + F.when(e["bit"] < F.col("h.bit"), e["n"] - 1).otherwise(F.lit(0)))
    start = F.col("before") + F.col("before_word") + below + more + F.coalesce("nulls", F.lit(0))
    columns = [c for c in ids.columns if c != "key"]
    placed = found.select("key", *[F.col(f"h.{c}").alias(c) for c in columns], start.cast("long").alias("start"))
    return placed.unionByName(nulls.withColumn("start", F.lit(0).cast("long")))


def coordinates(leaves: DataFrame) -> DataFrame:
    """(tree, pos, doc_id, hash, altered) of the rows of tree, doc_id, hash and altered.

    ``pos`` numbers the rows of a tree from 0 without gaps, by doc_id (null
    first), then hash.
    """
    ids = leaves.groupBy("tree", "doc_id").agg(
        F.count("*").alias("n"), F.min("hash").alias("hash"), F.max("hash").alias("last"), F.min("altered").alias("altered")
    )
    placed = durable(ranked(ids.withColumnsRenamed({"tree": "key", "doc_id": "value"})).withColumnsRenamed({"key": "tree", "value": "doc_id"}))
    groups = placed.where("hash = last").select("tree", "doc_id", "hash", "altered", "n", "start")
    several = placed.where("hash <> last").select(F.col("tree").alias("t"), F.col("doc_id").alias("d"), F.col("start").alias("first"))
    if not several.isEmpty():
        same = (F.col("tree") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))
        kinds = leaves.join(several, same).groupBy("tree", "doc_id", "first", "hash").agg(F.count("*").alias("n"), F.min("altered").alias("altered"))
        value = F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")
        key = F.struct("tree", "doc_id", "first")
        # one entry but for hashes that share sixty bits
        shared = kinds.groupBy(key.alias("key"), value.alias("value")).agg(
            F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("hash", "altered", "n"))).alias("equal")
        )
        each = ranked(shared).select("key", "start", "equal", F.posexplode("equal").alias("i", "e"))
        passed = F.aggregate(F.slice("equal", 1, F.col("i")), F.lit(0).cast("long"), lambda s, e: s + e["n"])
        groups = groups.unionByName(each.select(
            "key.tree", "key.doc_id", "e.hash", "e.altered", "e.n", (F.col("key.first") + F.col("start") + passed).alias("start")
        ))
    # repeated rows: runs of bounded length first, so that no task numbers one row's copies alone
    runs = groups.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    runs = runs.withColumn("to", F.least(F.col("from") + COPIES, F.col("n")) - 1)
    long = runs.where(f"n > {COPIES}").repartition("tree", "start", "from")
    turn = F.explode(F.sequence("from", "to"))
    return runs.where(f"n <= {COPIES}").unionByName(long).withColumn("turn", turn).select(
        "tree", (F.col("start") + F.col("turn")).alias("pos"), "doc_id", "hash", "altered"
    )


# --- levels ---------------------------------------------------------------------------


def height(n: Column) -> Column:
    """Levels above n nodes: the hexadecimal digits of n - 1, none for a lone node."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(F.lit(0))


def levels(nodes: DataFrame, trees: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of each level, and (tree, n, height, root).

    ``nodes``: tree, pos, hash and further columns, which the slots of the
    first level keep. ``trees``: (tree, n), n the nodes of the tree.
    """
    trees = durable(trees.withColumn("height", height(F.col("n"))))
    top = trees.agg(F.max("height")).first()[0] or 0
    tall = trees.select("tree", "height")
    current, runs, roots = nodes.join(tall, "tree"), [], []
    for level in range(1, top + 1):
        roots.append(current.where(F.col("height") == level - 1).select("tree", "hash"))
        facts = F.struct("pos", *[c for c in current.columns if c not in ("pos", "tree", "height")])
        run = (
            current.where(F.col("height") >= level).groupBy("tree", "height", F.shiftright("pos", FAN_BITS).alias("run"))
            .agg(F.array_sort(F.collect_list(facts)).alias("slots"))
        )
        runs.append(durable(run))
        digest = _hash(F.array_join(F.col("slots.hash"), ""))
        current = runs[-1].select("tree", "height", F.col("run").alias("pos"), digest.alias("hash"))
    roots.append(current.where(F.col("height") == top).select("tree", "hash"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return runs, durable(trees.join(found.withColumnRenamed("hash", "root"), "tree"))


#: A step of a proof: the digests left and right of a node.
_STEPS = "array<struct<l:string,r:string>>"


def paths(runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level, with the steps from each to the root.

    ``tops``: tree, height, root, steps (those above its root) and further
    columns, which every node of the tree gets.
    """
    beside = ["root", "steps", *[c for c in tops.columns if c not in ("tree", "height", "root", "steps")]]
    below = None
    for level in range(len(runs), 0, -1):
        here = tops.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("run"), *beside)
        here = here if below is None else here.unionByName(below.select("tree", F.col("pos").alias("run"), *beside))
        joined = runs[level - 1].drop("height").join(here, ["tree", "run"])
        digests = F.col("slots.hash")
        below = joined.select("*", F.posexplode("slots").alias("i", "s"))
        step = F.struct(
            F.array_join(F.slice(digests, 1, F.col("i")), "").alias("l"), F.array_join(F.slice(digests, F.col("i") + 2, 1 << FAN_BITS), "").alias("r")
        )
        others = [c for c in beside if c != "steps"]
        below = below.select("tree", "s.*", *others, F.concat(F.array(step), F.col("steps")).alias("steps"))
    return below


@dataclass
class Manifest:
    """The levels of all sources' trees and of the tree of sources.

    ``sources``: (source, tree, n, subroot); ``root``: one row, the digest of all.
    """

    leaves: DataFrame
    runs: list[DataFrame]
    sources: DataFrame
    tops: DataFrame
    root: DataFrame


def build(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text).

    ``altered``, if given, is a second digest of a row to be held against the
    manifest. Null fields have their own mark; rows of a null source form a
    source, the first; null ids come first in theirs; repeated ids are ordered
    by their leaves and repeated rows are leaves of their own. An empty table
    has no source and no root; further columns are not read.
    """
    rows = durable(docs.select("source", "doc_id", leaf().alias("hash"), (leaf() if altered is None else altered).alias("altered")))
    counts = durable(rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)))
    numbered = with_row_number(counts, ["all"], ["source"], "tree")
    sources = durable(numbered.select("source", (F.col("tree") - 1).alias("tree"), "n"))
    named = sources.select(F.col("source").alias("s"), "tree")
    leaves = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).select("tree", "doc_id", "hash", "altered")
    placed = durable(coordinates(leaves))
    runs, trees = levels(placed, sources.select("tree", "n"))
    # the subroots are the leaves of one more tree
    nodes = trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("hash"))
    upper, whole = levels(nodes, nodes.groupBy("tree").agg(F.count("*").alias("n")))
    none = F.array().cast(_STEPS)
    above = paths(upper, whole.select("tree", "height", "root", none.alias("steps"))) if upper else None
    if above is None:  # one source, or none: its subroot is the root
        tops = trees.select("tree", "height", F.col("root").alias("subroot"), "root", none.alias("steps"))
    else:
        tops = trees.withColumnRenamed("root", "subroot").join(above.select(F.col("pos").alias("tree"), "root", "steps"), "tree")
    tops = durable(tops.select("tree", "height", "subroot", "root", "steps"))
    named = sources.join(trees.select("tree", F.col("root").alias("subroot")), "tree")
    return Manifest(placed, runs, named.select("source", "tree", "n", "subroot"), tops, whole.select("root"))


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, hash, altered, subroot, root, steps) of every leaf."""
    lone = manifest.leaves.join(manifest.tops.where("height = 0"), "tree")
    columns = ("doc_id", "hash", "altered", "subroot", "root", "steps")
    if not manifest.runs:
        return lone.select(*columns)
    return paths(manifest.runs, manifest.tops).select(*columns).unionByName(lone.select(*columns))


def proof_digest(steps: Column) -> Column:
    return _hash(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps lead to."""
    return F.aggregate(steps, start, lambda h, s: _hash(F.concat(s["l"], h, s["r"])))


def tampered() -> Column:
    """The digest of a row after A-Z of every fifth id's text were lower-cased; a null id stays."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return leaf(text=F.when(F.coalesce(chosen, F.lit(False)), F.translate("text", letters, letters.lower())).otherwise(F.col("text")))


def tamper_report(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, roots and proof, and whether the tampered text still leads to the root."""
    found = proofs(build(docs, tampered()))
    checked = found.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
        folded(F.col("altered"), F.col("steps")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
