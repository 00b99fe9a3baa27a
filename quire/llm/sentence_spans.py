"""Removal of repeated spans of consecutive sentences.

Every run of SPAN consecutive sentences is hashed and all runs meet by hash. A
run with fewer than LEAST_WORDS words grows by sentences until it has enough,
once by those that follow and once by those before, so that a repeated stretch
of SPAN sentences and LEAST_WORDS words is covered up to both its ends.
The first run, by document id and place, stays; sentences covered by any other
equal run go; asked for passages, those that make up a stretch of enough words. A run that repeats inside its own document is told in place, so
each document sends a hash once.

Sentences end at terminal punctuation before white space and at line ends.
Sentences longer than LONG words are cut after words that a hash picks: where
the cuts fall depends on the words alone, so equal passages are cut alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import durable

#: Sentences of a run at least, and the words up to which it grows.
SPAN, LEAST_WORDS = 2, 10
#: Words from which on a stretch of covered sentences is a passage; shorter ones may be common phrases.
PASSAGE = 25
#: Characters that count as a word where a script has no spaces.
DENSE = 2
#: Words from which a sentence is cut, and one word in so many ends a piece.
LONG, CUT = 24, 6

_END = re.compile(r"(?<=[.!?…。！？])\s+|\s*\n\s*")
_WORD = re.compile(r"\S+")
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in code points."""
    out, start = [], 0
    for stop, following in [*((m.start(), m.end()) for m in _END.finditer(text)), (len(text), len(text))]:
        if text[start:stop].strip():
            out.append((start, stop))
        start = following
    return out


def _amount(words: list[str], joined: str) -> int:
    """Number of words; characters of scripts without spaces count too."""
    return len(words) if joined.isascii() else max(len(words), len(_DENSE.findall(joined)) // DENSE)


def _pieces(text: str) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Spans of the sentences and pieces, their hashes and numbers of words."""
    spans, hashes, counts = [], [], []
    for start, stop in sentences(text):
        words = text[start:stop].lower().split()
        if len(words) <= LONG:
            spans.append((start, stop))
            joined = " ".join(words)
            hashes.append(xxhash.xxh64_intdigest(joined))
            counts.append(_amount(words, joined))
            continue
        piece: list[str] = []
        begin = end = None
        for m in _WORD.finditer(text, start, stop):
            begin = m.start() if begin is None else begin
            end = m.end()
            piece.append(m.group().lower())
            if zlib.crc32(piece[-1].encode()) % CUT == 0:
                spans.append((begin, end))
                joined = " ".join(piece)
                hashes.append(xxhash.xxh64_intdigest(joined))
                counts.append(_amount(piece, joined))
                piece, begin = [], None
        if piece:
            spans.append((begin, end))
            joined = " ".join(piece)
            hashes.append(xxhash.xxh64_intdigest(joined))
            counts.append(_amount(piece, joined))
    return spans, np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)


def _bounds(counts: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, sentence behind the last) of each run, in order of the text."""
    n = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(n + 1)
    stop = np.maximum(np.searchsorted(total, total + least), at + SPAN)
    start = np.minimum(np.searchsorted(total, total - least, side="right") - 1, at - SPAN)
    both = np.concatenate([(at << 32 | stop)[stop <= n], (start << 32 | at)[start >= 0]])
    both = np.unique(both)
    return both >> 32, both & 0xFFFFFFFF


def runs(text: str | None, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence << 32 | sentence behind the last, repeats an earlier run of this text) of each run."""
    _, hashes, counts = _pieces(text or "")
    start, stop = _bounds(counts, least)
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    total = np.full(len(start), SPAN, dtype=np.uint64)
    for k in range(int((stop - start).max())):
        more = np.flatnonzero(start + k < stop)
        mixed = (total[more] ^ hashes[start[more] + k]) * _MIX
        total[more] = mixed ^ (mixed >> np.uint64(31))
    total = total.astype(np.int64)
    _, first = np.unique(total, return_index=True)
    again = np.ones(len(total), dtype=bool)
    again[first] = False
    return total, start << 32 | stop, again


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, places): bounds, as ``runs`` gives them, of runs that are not the first of their content.

    Rows of one id count as one document among each other: they remove
    nothing from one another. A row without an id comes last.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.iloc[begin : begin + 1000]
                found = [runs(t, least) for t in part["text"]]
                n = [len(f[0]) for f in found]
                joined = [np.concatenate([f[k] for f in found]) for k in range(3)]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].repeat(n).to_numpy(), "text_hash": part["text_hash"].repeat(n).to_numpy(),
                    "hash": joined[0], "place": joined[1], "again": joined[2],
                }).astype({"doc_id": part["doc_id"].dtype})

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    cuts = durable(rows.mapInPandas(cut, f"doc_id {kind}, text_hash long, hash long, place long, again boolean"))
    once = cuts.where("not again")
    # two longs a hash, combined before the shuffle
    firsts = once.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    later = once.join(firsts.select("hash", "first"), "hash").where("doc_id is null or doc_id > first")
    places = later.select("doc_id", "text_hash", "place").union(cuts.where("again").select("doc_id", "text_hash", "place"))
    return places.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _long_enough(gone: np.ndarray, counts: np.ndarray, stretch: int) -> np.ndarray:
    """The marked sentences that lie in a stretch of at least so many words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out = np.zeros(len(gone), dtype=bool)
    for first, last in edges.reshape(-1, 2):
        out[first:last] = counts[first:last].sum() >= stretch
    return out


def without_repeats(docs: DataFrame, stretch: int = 0, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, text without repeated spans, n_sentences, n_removed, removed.

    A covered stretch goes if it has ``stretch`` words, by default any; with
    ``least`` 0 runs of SPAN sentences of any length count.
    ``removed`` lists the removed stretches as start:end in code points of the
    whole text. A null text stays null, an empty one empty. Repeated rows keep
    their spans among each other; an empty table gives no rows; further
    columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, places in zip(batch["doc_id"], batch["text"], batch["places"], strict=True):
                spans, _, counts = _pieces(text or "")
                gone = np.zeros(len(spans), dtype=bool)
                for p in places if places is not None else ():
                    gone[int(p) >> 32 : int(p) & 0xFFFFFFFF] = True
                gone = _long_enough(gone, counts, stretch)
                stretches: list[list[int]] = []
                for i in np.flatnonzero(gone):
                    # white space behind a removed sentence goes with it
                    start, stop = spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(text)
                    if stretches and stretches[-1][1] == start:
                        stretches[-1][1] = stop
                    else:
                        stretches.append([start, stop])
                kept, at = [], 0
                for start, stop in stretches:
                    kept.append(text[at:start])
                    at = stop
                clean = "".join([*kept, text[at:]]) if stretches else text
                out.append((doc, clean, len(spans), int(gone.sum()), ",".join(f"{a}:{b}" for a, b in stretches)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_sentences", "n_removed", "removed"]).astype({"doc_id": batch["doc_id"].dtype})

    places = repeated_runs(docs, least).withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_hash", "_hash")
    rows = docs.select("doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    both = rows.join(places, same, "left").select("doc_id", "text", "places")
    return both.mapInPandas(drop, f"doc_id {kind}, text string, n_sentences int, n_removed int, removed string")
