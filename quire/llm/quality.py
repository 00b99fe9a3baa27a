"""Text quality by votes of the nearest labelled documents in a latent space.

A document is a bag of word forms: the run of character classes of a word
with its length band, and repeats of the word before. Form frequencies over
all documents weight the bag; a singular value decomposition of labelled bags
gives the latent space. The labelled vectors are a bounded sample, so they are
broadcast; every document meets all of them in blocks of exact cosine
products, and its nearest ones vote by similarity.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import one_text, remainder, smallest_hashes

#: Hashed forms, and latent dimensions.
FORMS, LATENT = 1024, 48
#: Labelled documents of one label that the space is fitted on and that vote.
PER_LABEL = 2048
#: Voters of a document, and the power of a similarity that weights a vote.
NEIGHBOURS, SHARPNESS = 25, 8
#: Rows of a block of products.
BLOCK = 256
#: Rows with this remainder are held out.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Words whose form a worker remembers.
WORDS = 500_000

_CLASSES = [(re.compile(p), r) for p, r in ((r"[^\W\d_A-Z]+", "a"), (r"[A-Z]+", "A"), (r"\d+", "0"), (r"([^aA0])\1+", r"\1"))]
_REPEATS = 0


def form(word: str) -> str:
    """``Unter###`` is ``Aa#`` with its length band; letters outside A-Z are of one class."""
    out = word
    for pattern, put in _CLASSES:
        out = pattern.sub(put, out)
    return f"{out[:12]}/{min(len(word), 20) // 4}"


class _Forms(dict):
    def __missing__(self, word: str) -> int:
        code = 1 + zlib.crc32(form(word).encode()) % (FORMS - 1)
        if len(self) < WORDS and len(word) <= 64:
            self[word] = code
        return code


_forms = _Forms()


def bag(text: str | None) -> np.ndarray:
    """Counts of the forms of a text."""
    words = (text or "").split()
    if len(_forms) >= WORDS:
        _forms.clear()
    counts = np.bincount(np.fromiter(map(_forms.__getitem__, words), dtype=np.int64, count=len(words)), minlength=FORMS).astype(np.float32)
    counts[_REPEATS] = sum(map(operator.eq, words, words[1:]))
    return counts


@dataclass
class Space:
    rarity: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    votes: np.ndarray
    weights: np.ndarray
    prior: float

    def place(self, bags: np.ndarray) -> np.ndarray:
        rows = _weighted(bags, self.rarity) @ self.axes
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-9)

    def score(self, bags: np.ndarray) -> np.ndarray:
        """Share of the weight of a row's nearest voters that is for label 1."""
        if not len(self.voters):
            return np.full(len(bags), self.prior)
        rows = self.place(bags)
        near = rows @ self.voters.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS * self.weights[best]
        total = weight.sum(axis=1)
        return np.divide((weight * self.votes[best]).sum(axis=1), total, out=np.full(len(rows), self.prior), where=total > 1e-12)


def _weighted(bags: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    share = np.sqrt(bags / np.maximum(bags.sum(axis=1, keepdims=True), 1)) * rarity
    length = np.linalg.norm(share, axis=1, keepdims=True)
    return np.divide(share, length, out=np.zeros_like(share), where=length > 0)


def _form_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents a form occurs, and the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows = np.zeros(FORMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found += bag(text) > 0
            rows += len(batch)
        yield pd.DataFrame({"form": [*range(FORMS), -1], "n": [*found, rows]})

    sums = docs.select("text").mapInPandas(count, "form int, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()
    by = {r["form"]: r["n"] for r in sums}
    return np.array([by.get(i, 0) for i in range(FORMS)]), by.get(-1, 0)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Space:
    """Learn from at most ``per_label`` labelled rows of each label, never held-out ones.

    Votes are weighted back to the labels' shares among all rows for learning.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = F.broadcast(smallest_hashes(known, "quality", per_label, "doc_id"))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [bag(t) for t in batch["text"]]
            yield pd.DataFrame({
                "quality": batch["quality"],
                "forms": [np.flatnonzero(r).astype(np.int32) for r in rows],
                "n": [r[r > 0] for r in rows],
            })

    texts = one_text(docs.select("doc_id", "text").join(chosen, "doc_id"), "doc_id", "quality")
    found = texts.select("quality", "text").mapInPandas(bags, "quality int, forms array<int>, n array<float>").collect()
    frequency, rows = _form_counts(docs)
    rarity = np.log((1 + rows) / (1 + frequency)).astype(np.float32) + 1
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    if not found:
        empty = np.zeros((0, LATENT), dtype=np.float32)
        return Space(rarity, np.zeros((FORMS, LATENT), dtype=np.float32), empty, np.zeros(0), np.zeros(0), prior)
    dense = np.zeros((len(found), FORMS), dtype=np.float32)
    for i, r in enumerate(found):
        dense[i, r["forms"]] = r["n"]
    votes = np.array([r["quality"] for r in found])
    # rows in a fixed order, so that the decomposition does not depend on tasks
    order = np.lexsort((*dense.T[:64], dense.sum(axis=1), votes))
    dense, votes = dense[order], votes[order]
    weighted = _weighted(dense, rarity).astype(np.float64)
    _, vectors = np.linalg.eigh(weighted.T @ weighted)
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT]).astype(np.float32)
    space = Space(rarity, axes, np.zeros((0, LATENT)), votes, np.zeros(0), prior)
    space.voters = space.place(dense).astype(np.float32)
    space.weights = np.array([shares[v] / max((votes == v).sum(), 1) for v in votes], dtype=np.float64)
    return space


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text has no form and gets the share of label 1, as every
    row does if nothing is labelled. Repeated rows stand each for themselves;
    of several labels of one id the larger counts; an empty table gives no
    rows; further columns are not read.
    """
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), BLOCK):
                part = batch.iloc[begin : begin + BLOCK]
                rows = np.stack([bag(t) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": np.clip(space.value.score(rows), 0, 1)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInPandas(score, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
