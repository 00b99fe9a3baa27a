"""Language of documents from a linear-chain conditional random field over words.

Each word gets scores from its affixes, its character n-grams and lexicons of
the languages; transitions between neighbours are learned with them on
code-switched sequences made of labelled documents. Forward-backward gives
every word its distribution over languages; a document's language is that of
most expected words.

Many documents are labelled at once. Words lie in chunks of fixed length: the
products of the chunks' step matrices carry the forward and backward vectors
over whole documents, then all chunks are filled in together. The result is
that of one pass over the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import one_text, remainder, smallest_hashes

#: Labelled documents of one language to learn from, and their largest length.
PER_LANGUAGE, MOST_CHARACTERS = 200, 20_000
#: Rows with this remainder are held out.
FOLDS, HELD_OUT = 4, 2
#: Weights of hashed features; then one feature for each lexicon.
HASHED = 1 << 15
#: Words of a training sequence, and of one language's stretch in it.
SEQUENCE, STRETCH = 60, (6, 30)
STEPS, SEQUENCES, RATE, DECAY = 160, 48, 0.25, 1e-5
#: Occurrences in labelled documents from which a word enters a lexicon, and its share in one language.
LEXICON_COUNT, LEXICON_SHARE = 2, 0.9
#: Letters from which on a word's features are added up in blocks of places.
LONG, BLOCK = 4096, 1 << 18
#: Words of a chunk, and characters of documents that are labelled together.
CHUNK, TOGETHER = 64, 3_000_000

_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hash(parts: list[np.ndarray], kind: int) -> np.ndarray:
    total = np.full(parts[0].shape, 1 + kind * 7919, dtype=np.uint64)
    for p in parts:
        total = (total * _MULTIPLIERS[0] + p.astype(np.uint64)) * _MULTIPLIERS[1]
        total ^= total >> np.uint64(29)
    return (total >> np.uint64(17)) % np.uint64(HASHED - 1) + np.uint64(1)


def _features_of_width(words: list[str], width: int) -> np.ndarray:
    """Hashed features of words of at most ``width`` characters; 0 is none."""
    n = len(words)
    chars = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(n, width)
    length = np.array([len(w) for w in words])
    framed = np.zeros((n, width + 2), dtype=np.uint32)
    framed[:, 1:-1] = chars
    framed[:, 0] = 1
    framed[np.arange(n), length + 1] = 2
    place = np.arange(width + 2)
    two = _hash([framed[:, :-1], framed[:, 1:]], 1) * (place[:-1] < (length + 1)[:, None])
    three = _hash([framed[:, :-2], framed[:, 1:-1], framed[:, 2:]], 2) * (place[:-2] < length[:, None])
    out = [two, three]
    rows = np.arange(n)
    last = lambda k: framed[rows, np.maximum(length + 1 - k, 0)]
    for size in (1, 2, 3):
        whole = (length >= size).astype(np.uint64)
        out.append((_hash([framed[:, 1 + k] if 1 + k < width + 2 else framed[:, 0] for k in range(size)], 2 + size) * whole)[:, None])
        out.append((_hash([last(k) for k in range(1, size + 1)], 6 + size) * whole)[:, None])
    return np.concatenate(out, axis=1).astype(np.int32)


def _blocks_of_features(word: str) -> Iterator[np.ndarray]:
    """The same features of one word of any length, a block of places at a time."""
    framed = np.concatenate([[1], np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32), [2]]).astype(np.uint32)
    for begin in range(0, len(framed) - 1, BLOCK):
        part = framed[begin : begin + BLOCK + 2]
        yield _hash([part[: min(BLOCK, len(part) - 1)], part[1 : BLOCK + 1]], 1)
        if len(part) > 2:
            yield _hash([part[:-2], part[1:-1], part[2:]], 2)
    for size in (1, 2, 3):
        yield _hash([framed[1 + k : 2 + k] for k in range(size)], 2 + size)
        yield _hash([framed[-1 - k : len(framed) - k] for k in range(1, size + 1)], 6 + size)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features x languages; row 0 is zero
    transitions: np.ndarray  # from, to
    lexicon: dict[str, int]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words, by bands of length."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        length = np.array([len(w) for w in words])
        for i in np.flatnonzero(length > LONG):
            for features in _blocks_of_features(words[i]):
                out[i] += self.weights[features].sum(axis=0)
        band = 2 ** np.ceil(np.log2(np.maximum(length, 8))).astype(int)
        band[length > LONG] = 0
        for width in np.unique(band[band > 0]):
            place = np.flatnonzero(band == width)
            step = max(1, 200_000 // int(width))
            for begin in range(0, len(place), step):
                part = place[begin : begin + step]
                feats = _features_of_width([words[i] for i in part], int(width))
                total = out[part]
                for column in range(feats.shape[1]):
                    total += self.weights[feats[:, column]]
                out[part] = total
        listed = np.array([self.lexicon.get(w, -1) for w in words])
        known = listed >= 0
        out[known] += self.weights[HASHED + listed[known]]
        return out

    def expected(self, texts: list[str | None]) -> np.ndarray:
        """Expected number of words of each language, a row for each text."""
        size = len(self.languages)
        found = [words_of(t) if t else [] for t in texts]
        counts = np.array([len(w) for w in found], dtype=np.int64)
        result = np.zeros((len(texts), size))
        if not counts.sum() or not size:
            return result
        codes, distinct = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
        scores = self.word_scores(list(distinct))
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        chunks = -(-counts // CHUNK)
        order = np.argsort(-chunks, kind="stable")  # documents by falling number of chunks
        first = np.zeros(len(texts), dtype=np.int64)
        first[1:] = np.cumsum(chunks)[:-1]
        begin = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(texts)), counts)
        inside = np.arange(counts.sum()) - begin[doc]
        row, col = first[doc] + inside // CHUNK, inside % CHUNK
        total = int(chunks.sum())
        words = np.ones((total, CHUNK, size), dtype=np.float32)
        real = np.zeros((total, CHUNK), dtype=bool)
        words[row, col] = scores[codes]
        real[row, col] = True
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)

        def scaled(x: np.ndarray) -> np.ndarray:
            axes = tuple(range(1, x.ndim))
            return x / x.sum(axis=axes, keepdims=True)

        product = np.broadcast_to(np.eye(size, dtype=np.float32), (total, size, size)).copy()
        for t in range(CHUNK):
            live = np.flatnonzero(real[:, t])
            if not len(live):
                break
            product[live] = scaled((product[live] @ step) * words[live, t, None, :])
        enter = np.full((total, size), 1 / size, dtype=np.float32)
        leave = np.full((total, size), 1 / size, dtype=np.float32)
        most = int(chunks.max())
        width = [int((chunks > k).sum()) for k in range(most)]
        for k in range(1, most):
            now = first[order[: width[k]]] + k
            enter[now] = scaled(np.einsum("ni,nij->nj", enter[now - 1], product[now - 1]))
        for k in range(most - 2, -1, -1):
            now = first[order[: width[k + 1]]] + k
            leave[now] = scaled(np.einsum("nij,nj->ni", product[now + 1], leave[now + 1]))
        forward = np.empty_like(words)
        state = enter
        for t in range(CHUNK):
            moved = scaled((state @ step) * words[:, t])
            state = np.where(real[:, t, None], moved, state)
            forward[:, t] = state
        state = leave
        sums = np.zeros((total, size))
        for t in range(CHUNK - 1, -1, -1):
            both = forward[:, t] * state
            both = both / both.sum(axis=1, keepdims=True)
            sums += both * real[:, t, None]
            moved = scaled((words[:, t] * state) @ step.T)
            state = np.where(real[:, t, None], moved, state)
        np.add.at(result, np.repeat(np.arange(len(texts)), chunks), sums)
        return result


def _gradient(scores: np.ndarray, transitions: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected words and transitions of sequences of one length."""
    many, length, size = scores.shape
    step = np.exp(transitions)
    words = np.exp(scores - scores.max(axis=2, keepdims=True))
    forward, backward = np.empty_like(words), np.empty_like(words)
    state = np.full((many, size), 1 / size)
    for t in range(length):
        state = (state @ step) * words[:, t]
        state /= state.sum(axis=1, keepdims=True)
        forward[:, t] = state
    state = np.full((many, size), 1 / size)
    for t in range(length - 1, -1, -1):
        backward[:, t] = state
        state = (words[:, t] * state) @ step.T
        state /= state.sum(axis=1, keepdims=True)
    node = forward * backward
    node /= node.sum(axis=2, keepdims=True)
    edge = forward[:, :-1, :, None] * step[None, None] * (words[:, 1:] * backward[:, 1:])[:, :, None, :]
    edge /= edge.sum(axis=(2, 3), keepdims=True)
    seen = np.eye(size)[labels]
    seen_edges = seen[:, :-1, :, None] * seen[:, 1:, None, :]
    return seen - node, (seen_edges - edge).sum(axis=(0, 1))


def learn(texts: list[tuple[str, str]], seed: int = 11) -> Field:
    """Fit a field to (language, text) rows by steps along the likelihood's gradient."""
    languages = sorted({lang for lang, _ in texts})
    place = {lang: i for i, lang in enumerate(languages)}
    documents = [(place[lang], words_of(text)) for lang, text in sorted(texts)]
    documents = [(i, w) for i, w in documents if w]
    counts: dict[str, Counter] = {}
    for i, words in documents:
        for w in words:
            counts.setdefault(w, Counter())[i] += 1
    lexicon = {}
    for w, c in counts.items():
        i, n = max(c.items(), key=lambda x: (x[1], -x[0]))
        if n >= LEXICON_COUNT and n >= LEXICON_SHARE * sum(c.values()):
            lexicon[w] = i
    field = Field(languages, np.zeros((HASHED + len(languages), len(languages)), dtype=np.float32), np.zeros((len(languages),) * 2, dtype=np.float32), lexicon)
    if len(languages) < 2 or not documents:
        return field
    draw = np.random.default_rng(seed)
    by_language = [[w for i, w in documents if i == k] for k in range(len(languages))]
    present = [k for k in range(len(languages)) if by_language[k]]
    past = np.full_like(field.weights, 1e-2, dtype=np.float64)
    past_steps = np.full_like(field.transitions, 1e-2, dtype=np.float64)
    for _ in range(STEPS):
        sequences, labels = [], []
        for _ in range(SEQUENCES):
            words, marks = [], []
            while len(words) < SEQUENCE:
                k = present[draw.integers(len(present))]
                of = by_language[k][draw.integers(len(by_language[k]))]
                size = int(draw.integers(*STRETCH))
                begin = int(draw.integers(max(1, len(of) - size + 1)))
                part = of[begin : begin + size]
                words += part
                marks += [k] * len(part)
            sequences.append(words[:SEQUENCE])
            labels.append(marks[:SEQUENCE])
        flat = [w for s in sequences for w in s]
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        distinct = list(distinct)
        scores = field.word_scores(distinct)[codes].reshape(SEQUENCES, SEQUENCE, -1)
        words_off, steps_off = _gradient(scores.astype(np.float64), field.transitions.astype(np.float64), np.array(labels))
        by_word = np.zeros((len(distinct), len(languages)))
        np.add.at(by_word, codes, words_off.reshape(-1, len(languages)))
        change = np.zeros_like(past)
        band = np.array([2 ** int(np.ceil(np.log2(max(len(w), 8)))) for w in distinct])
        for width in np.unique(band):
            at = np.flatnonzero(band == width)
            feats = _features_of_width([distinct[i] for i in at], int(width))
            for k in range(len(languages)):
                change[:, k] += np.bincount(feats.ravel(), weights=np.repeat(by_word[at, k], feats.shape[1]), minlength=len(change))
        listed = np.array([lexicon.get(w, -1) for w in distinct])
        np.add.at(change, HASHED + listed[listed >= 0], by_word[listed >= 0])
        change = change / SEQUENCES - DECAY * field.weights
        change[0] = 0
        past += change**2
        field.weights += (RATE * change / np.sqrt(past)).astype(np.float32)
        steps_off = steps_off / SEQUENCES - DECAY * field.transitions
        past_steps += steps_off**2
        field.transitions += (RATE * steps_off / np.sqrt(past_steps)).astype(np.float32)
    return field


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Field:
    """Learn from a bounded sample of labelled documents, never from held-out ones."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where((remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & (F.length("text") <= MOST_CHARACTERS))
    chosen = F.broadcast(smallest_hashes(known.select("doc_id", "lang").distinct(), "lang", per_language, "doc_id"))
    rows = one_text(known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]), "doc_id", "lang").select("lang", "text").collect()
    return learn(sorted((r["lang"], r["text"]) for r in rows))


def has_letter(text: str) -> bool:
    return _WORD.search(text) is not None


def labelled(field: Field, docs: DataFrame) -> Callable[[str], Column]:
    """A function of a text column: struct of lang_pred and score.

    ``und`` with score 0 where a text is null, has no letter, or no language
    was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(t) if t else 0 for t in batch])
            group = np.cumsum(sizes) // TOGETHER
            parts = [shared.value.expected(list(batch[group == g])) for g in np.unique(group)]
            counts = np.concatenate(parts) if parts else np.zeros((0, 1))
            total = counts.sum(axis=1)
            names = np.array([*shared.value.languages, "und"], dtype=object)
            best = np.where(total > 0, counts.argmax(axis=1) if counts.shape[1] else 0, len(names) - 1)
            top = counts.max(axis=1) if counts.shape[1] else total
            yield pd.DataFrame({"lang_pred": names[best], "score": np.clip(np.divide(top, total, out=np.zeros(len(total)), where=total > 0), 0, 1)})

    return label


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Each row stands for itself, repeated or without an id; an empty table
    gives no rows; further columns are not read.
    """
    named = docs.select("doc_id", labelled(fit(docs), docs)("text").alias("found"))
    return named.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "found.lang_pred", "found.score")
