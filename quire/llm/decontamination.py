"""Benchmark items in documents, also with other numbers, names and units.

Words become two templates. In the typed one numbers, names and units are
slots and the rest is lower-cased without edge punctuation; a window needs
enough literal words. In the folded one case is folded, names are literal words
and numbers and units slots, and every window counts: one with too many slots
is compared by its words themselves. An item is found by either template.
Windows of documents and of items meet in a hash join. A window match is laid on its diagonal, the
distance of its places in document and item. On a diagonal the most frequent
value of the document for one of the item holds, and for names and units also
the other way round; windows with other values drop out, unless they are
verbatim. An item is found where the rest covers enough of its windows.

Documents send only windows that hit two bitmaps of the items' hashes, one by
their lower and one by their upper half. The bitmaps have a fixed size: with
more items they pass more windows, and the join still decides.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bitmap, hits, whole
from quire.session import durable

#: Template words of a window; items with fewer are one window, down to SHORTEST.
WINDOW, SHORTEST = 8, 5
#: Words of a window that must not be slots, as a share; a folded window below it has no slots.
LITERAL_SHARE = 0.5
#: Share of an item's windows that must be found.
COVERAGE = 0.5
#: Words whose canonical form a worker remembers.
WORDS = 400_000
#: Characters of documents whose windows are hashed together.
TOGETHER = 2_000_000

NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Words that count as units.
UNITS = frozenset(
    "mm cm dm km kg mg ml cl dl kb mb gb tb hz khz mhz ghz kw kwh mph kmh kph ms ns "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles yard yards "
    "foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes liter liters "
    "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros degree degrees celsius fahrenheit watt watts volt volts percent".split()
)

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,:/]*)([^\W\d_]+)")
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Templates, and the seeds of their windows' hashes; WORDWISE ones are folded windows without slots.
TYPED, FOLDED, WORDWISE = 0, 1, 2

#: Canonical words of one word: (hash, slot type or None, text shown or slot value, word with case folded).
Canonical = tuple[tuple[int, str | None, str, str], ...]


def _canonical(word: str) -> Canonical:
    core = word.strip(punctuation)
    if core.isalpha():  # most words: nothing else to strip, split or match
        kind = UNIT if core.lower() in UNITS else NAME if core[0].isupper() else None
        shown = kind or core.lower()
        return ((xxhash.xxh64_intdigest(shown), kind, core if kind else shown, core.casefold()),)
    core = _EDGE.sub("", word)
    if not core:
        return ()
    parts = [core]
    both = _NUMBER_UNIT.fullmatch(core)
    if both and both[2].lower() in UNITS:
        parts = [both[1], both[2]]
    out = []
    for part in parts:
        kind = NUMBER if _NUMBER.fullmatch(part) else UNIT if part.lower() in UNITS else NAME if part[0].isupper() else None
        shown = kind or part.lower()
        out.append((xxhash.xxh64_intdigest(shown), kind, part if kind else shown, part.casefold()))
    return tuple(out)


class _Canon(dict):
    def __missing__(self, word: str) -> Canonical:
        found = _canonical(word)
        if len(self) < WORDS and len(word) <= 64:
            self[word] = found
        return found


_canon = _Canon()


class _Codes(dict):
    """Word to its place in flat tables of three hashes of each canonical word: typed, folded and wordwise; the last bit is set for literal ones."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.starts, self.counts, self.flat = array("q"), array("q"), array("Q")

    def __missing__(self, word: str) -> int:
        place = len(self.starts)
        self.starts.append(len(self.flat) // 3)
        core = word.strip(punctuation)
        if core.isalpha() and core.islower() and core not in UNITS:  # most words: literal
            h = xxhash.xxh64_intdigest(core)
            folded = core.casefold()
            own = (h if folded == core else xxhash.xxh64_intdigest(folded)) | 1
            self.counts.append(1)
            self.flat.extend((h | 1, own, own))
        else:
            found = _canonical(word)
            self.counts.append(len(found))
            for h, kind, _, folded in found:
                own = xxhash.xxh64_intdigest(folded) | 1
                self.flat.extend((h & ~1 | (kind is None), h & ~1 if kind in (NUMBER, UNIT) else own, own))
        if len(word) <= 64:
            self[word] = place
        return place

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The three rows of hashes of all texts' canonical words, and where each text begins and the last ends."""
        if len(self.starts) >= WORDS:
            self.clear()
        # split, and each word once, outside of Python; white space at an end gives an empty word without hashes
        words = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        sizes = np.concatenate([[0], pc.list_value_length(words).to_numpy()])
        once = words.flatten().dictionary_encode()
        known = np.fromiter(map(self.__getitem__, once.dictionary.to_pylist()), dtype=np.int64, count=len(once.dictionary))
        place = known[once.indices.to_numpy()]
        starts, counts, flat = np.array(self.starts), np.array(self.counts), np.array(self.flat, dtype=np.uint64).reshape(-1, 3)
        many = counts[place]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(starts[place] - ends[:-1], many) + np.arange(ends[-1])
        return np.ascontiguousarray(flat[at].T), ends[np.cumsum(sizes)]


_codes = _Codes()


def template(text: str | None) -> list[tuple[int, str | None, str, str]]:
    if len(_canon) >= WORDS:
        _canon.clear()
    return [part for found in map(_canon.__getitem__, (text or "").split()) for part in found]


def _mixed(codes: Iterator[np.ndarray], many: int, width: int, seed: int) -> np.ndarray:
    total = np.full(many, width + (seed << 8), dtype=np.uint64)
    for part in codes:
        total ^= part
        total *= _BASE
        total ^= total >> np.uint64(31)
    return total


def _hashes(codes: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each template, the hash of the window from each place and whether it has enough literal words.

    A folded window without enough is hashed wordwise.
    """
    many = codes.shape[1] - width + 1
    if many <= 0:
        return [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool))] * 2
    out = []
    for which in (TYPED, FOLDED):
        run = np.concatenate([[0], np.cumsum((codes[which] & np.uint64(1)).astype(np.int64))])
        usable = run[width:] - run[:-width] >= LITERAL_SHARE * width
        out.append((_mixed((codes[which, k : k + many] for k in range(width)), many, width, which), usable))
    total, usable = out[FOLDED]
    rest = np.flatnonzero(~usable)
    total[rest] = _mixed((codes[WORDWISE, rest + k] for k in range(width)), len(rest), width, WORDWISE)
    return out


def item_windows(items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, template, place, width, windows, hash, words, slots) of every window that counts of every item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                words = template(text)
                width = min(WINDOW, len(words))
                if width < max(shortest, 1):
                    continue
                codes, _ = _codes.of([text])
                for which, (hashes, usable) in enumerate(_hashes(codes, width)):
                    places = np.flatnonzero(usable) if which == TYPED else np.arange(len(hashes))
                    for p in places.tolist():
                        shown = _shown(words[p : p + width], which, usable[p])
                        out.append((item, which, p, width, len(places), int(hashes[p].astype(np.int64)), *shown))
            yield pd.DataFrame(out, columns=["item_id", "template", "place", "width", "windows", "hash", "words", "slots"]).astype({"item_id": batch["item_id"].dtype})

    schema = f"item_id {kind}, template int, place int, width int, windows int, hash long, words string, slots array<string>"
    return items.where("item_id is not null").select("item_id", "text").mapInPandas(cut, schema)


def _shown(words: list[tuple[int, str | None, str, str]], which: int, usable: bool) -> tuple[str, list[str]]:
    """The words of a window with its slots by their types, and the values of the slots."""
    if which == TYPED:
        return " ".join(w[1] or w[2] for w in words), [w[2] for w in words if w[1]]
    if not usable:
        return " ".join(w[3] for w in words), []
    slot = [w[1] in (NUMBER, UNIT) for w in words]
    return " ".join(w[1] if s else w[3] for w, s in zip(words, slot, strict=True)), [w[3] for w, s in zip(words, slot, strict=True) if s]


#: (type, value in the item, value in the document) of one slot.
Pair = tuple[str, str, str]


def _held(votes: dict[tuple[str, str], Counter]) -> dict[tuple[str, str], str]:
    """The most frequent value of each key; among equals the key's own, then the smallest."""
    return {key: min(seen, key=lambda v: (-seen[v], v != key[1], v)) for key, seen in votes.items()}


def consistent(windows: list[tuple[int, str, list[str], list[str]]]) -> tuple[list[int], int]:
    """Places of the windows of one diagonal that agree with its majority or are verbatim, and their changed slot values.

    A window is (place, words with slot types, values in the item, values in
    the document). Different numbers of an item may have become equal.
    """
    pairs: dict[int, Pair] = {}  # by place in the item
    slots: list[tuple[int, list[Pair]]] = []
    for place, words, item, doc in windows:
        types = [(k, w) for k, w in enumerate(words.split(" ")) if w in (NUMBER, NAME, UNIT)] if item else []
        mine = [(w, a, b) for (_, w), a, b in zip(types, item, doc, strict=True)]
        pairs.update((place + k, pair) for (k, _), pair in zip(types, mine, strict=True))
        slots.append((place, mine))
    forth: dict[tuple[str, str], Counter] = defaultdict(Counter)
    back: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for kind, a, b in pairs.values():
        forth[kind, a][b] += 1
    to = _held(forth)
    for kind, a, b in pairs.values():
        if kind != NUMBER and to[kind, a] == b:
            back[kind, b][a] += 1
    origin = _held(back)
    kept = [
        (place, mine)
        for place, mine in slots
        if all(a == b for _, a, b in mine) or all(to[k, a] == b and (k == NUMBER or origin[k, b] == a) for k, a, b in mine)
    ]
    return [place for place, _ in kept], len({pair for _, mine in kept for pair in mine if pair[1] != pair[2]})


def _nominated(sent: DataFrame, windows: DataFrame, coverage: float) -> DataFrame:
    """The windows of each item beside each document text that may hold enough of them.

    A text that has a share of an item's windows has one of any selection
    that leaves out fewer than that share. So only the windows that fewest
    items have nominate: a phrase of many items and many documents does not
    bring them all together.
    """
    key = ["template", "hash", "words"]
    common = windows.groupBy(*key).agg(F.count("*").alias("known"))
    own = Window.partitionBy("item_id", "template")
    needed = F.greatest(F.ceil(F.max("windows").over(own) * coverage - 1e-9), F.lit(1))
    ranked = windows.join(common, key).withColumns({
        "turn": F.row_number().over(own.orderBy("known", "hash", "place")),
        "most": F.count("*").over(own) - needed + 1,
    })
    telling = ranked.where("turn <= most").select(*key, "item_id").distinct()
    pairs = sent.select("doc_id", "text_hash", *key).join(telling, key).select("doc_id", "text_hash", "item_id", "template").distinct()
    return pairs.join(windows, ["item_id", "template"])


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST) -> DataFrame:
    """One row per document text and item found in it.

    (doc_id, text_hash, item_id, windows found, coverage, changed slot values,
    kind: verbatim or reparameterised), of the template that covers more. Null
    texts, items without an id and items under ``shortest`` template words
    match nothing; with ``shortest`` 1 an item of one word is one; repeated rows
    of a document give one row; an empty side gives none; further columns are
    not read.
    """

    windows = durable(item_windows(items, shortest))
    upper = windows.select(F.shiftrightunsigned("hash", 32).alias("upper"))
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(windows, "hash"), bitmap(upper, "upper")))
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # WINDOW at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = shared.value
        for batch in batches:
            sizes = np.array([len(t) if t else 0 for t in batch["text"]])
            group = np.cumsum(sizes) // TOGETHER
            for g in np.unique(group):
                part = batch[group == g]
                out = []
                codes, begin = _codes.of(list(part["text"]))
                owner = np.repeat(np.arange(len(part)), np.diff(begin))
                words: dict[int, list] = {}  # templates of the documents that hit
                for width in widths:
                    for which, (hashes, usable) in enumerate(_hashes(codes, width)):
                        if not len(hashes):
                            continue
                        hit = hits(low, hashes) & (owner[: len(hashes)] == owner[width - 1 :])
                        if which == TYPED:
                            hit &= usable
                        places = np.flatnonzero(hit)
                        for p in places[hits(high, hashes[places] >> np.uint64(32))]:
                            d = int(owner[p])
                            if d not in words:
                                words[d] = template(part["text"].iat[d])
                            at = int(p - begin[d])
                            shown = _shown(words[d][at : at + width], which, usable[p])
                            out.append((part["doc_id"].iat[d], part["text_hash"].iat[d], which, at, int(hashes[p].astype(np.int64)), *shown))
                yield pd.DataFrame(out, columns=["doc_id", "text_hash", "template", "doc_place", "hash", "words", "doc_slots"]).astype({"doc_id": part["doc_id"].dtype})

    sent = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(
        send, f"doc_id {kind}, text_hash long, template int, doc_place int, hash long, words string, doc_slots array<string>"
    )
    sent = durable(sent.distinct())
    pairs = _nominated(sent, windows, coverage).alias("p")
    same = F.col("s.doc_id").eqNullSafe(F.col("p.doc_id"))
    for c in ("text_hash", "template", "hash", "words"):
        same = same & (F.col(f"s.{c}") == F.col(f"p.{c}"))
    met = pairs.join(sent.alias("s"), same).select("p.*", "s.doc_place", "s.doc_slots")
    diagonal = ["doc_id", "text_hash", "item_id", "template", (F.col("doc_place") - F.col("place")).alias("diagonal")]
    # lists are bounded by the windows of an item
    laid = (
        met.select(*diagonal, "windows", F.struct("place", "words", "slots", "doc_slots").alias("window"))
        .groupBy("doc_id", "text_hash", "item_id", "template", "diagonal")
        .agg(F.collect_list("window").alias("met"), F.max("windows").alias("windows"))
        .drop("diagonal")
    )
    item = items.schema["item_id"].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            judged = [consistent([(w["place"], w["words"], list(w["slots"]), list(w["doc_slots"])) for w in m]) for m in batch["met"]]
            batch["places"], batch["changed"] = [p for p, _ in judged], [c for _, c in judged]
            yield batch.drop(columns="met")

    fits = laid.select("doc_id", "text_hash", "item_id", "template", "windows", "met").mapInPandas(
        judge, f"doc_id {kind}, text_hash long, item_id {item}, template int, windows int, places array<int>, changed int"
    )
    found = (
        fits.groupBy("doc_id", "text_hash", "item_id", "template")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("found"),
            F.max("windows").alias("windows"),
            F.max_by("changed", F.struct(F.size("places"), -F.col("changed"))).alias("changed"),
        )
    )
    best = F.max_by(F.struct("found", "windows", "changed"), F.struct(F.col("found") / F.col("windows"), -F.col("template")))
    whole = found.where(F.col("found") >= F.col("windows") * coverage).groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"))
    return whole.select("doc_id", "text_hash", "item_id", "best.*").select(
        "doc_id", "text_hash", "item_id", "found",
        (F.col("found") / F.col("windows")).alias("coverage"),
        F.col("changed").alias("changed_slots"),
        F.when(F.col("changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST) -> DataFrame:
    """The rows in which no item is found, in their own columns.

    Columns may have any names and types. Null texts and repeated rows as in
    :func:`leaks`: repeated rows share their fate; no items, no row goes.
    """
    found = leaks(docs, items, coverage, shortest).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("text") == F.col("leak_hash"))
    return whole(docs, "doc_id", "text").join(found, same, "left_anti").select("row.*")
