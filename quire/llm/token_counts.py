"""Token counts from a byte-pair vocabulary compiled to a transducer.

A byte-pair encoding is the one sequence of tokens in which every two
neighbours stay apart when encoded together. So the last token of a prefix is
decided by the bytes of its end and by the last tokens of a few shorter
prefixes, and encoding is a deterministic finite-state transducer: a state is
the longest end of the input that can still grow into a token, with the last
token at each position of it and the token counts there, relative to the
current one. A transition on a byte carries the change of the token count.
States and transitions are compiled when an input first reaches them.

Texts are split first by the vocabulary's pattern; words are counted by the
transducer. A word of more than CHUNK bytes is cut into chunks, dealt over
tasks. A chunk's state map takes the states that may be reached at its front
to the state behind it and the tokens counted between. Which states those are
the bytes in front of the chunk tell: runs that start at different places
reach the same state after a few tokens. Maps compose associatively, in a
balanced scan over the chunks of a word. Should a word's true state be missing
from a map, the chunk is run from that state in a further round, so that the
count is exact in any case.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import PreTokenizer

from quire.session import durable

#: The split pattern of the vocabulary and its added token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ADDED = "<|endoftext|>"

#: Bytes of a word from which on it is cut, and of its chunks.
CHUNK = 1 << 16
#: Tokens of the longest kind that the bytes in front of a chunk hold, from two places on.
LOOKBACK = (2, 5)
#: Words whose count a worker remembers, and transitions it keeps compiled.
WORDS, TRANSITIONS = 400_000, 1_500_000
#: Tokens beyond which a document is over the limit.
LIMIT = 1024

_SPLIT = regex.compile(PATTERN)
#: From the first code point on that some Unicode version leaves unassigned.
_LATE = re.compile("[\u0378-\U0010ffff]")


@lru_cache(maxsize=1)
def _unsure() -> regex.Pattern:
    """Letters and numbers of a newer Unicode version than Python's: the library may not know them."""
    newer = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", newer)] or [0xFFFFF]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


def _byte_of_letter() -> dict[str, int]:
    """The vocabulary file writes a byte as a letter: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The longest end that can still grow, and at its places the last token and the relative count.
State = tuple[bytes, tuple]
START: State = (b"", ((-1, 0),))
#: From the state before a chunk to the state behind it and its tokens.
Map = dict[State, tuple[State, int]]


class Transducer:
    """Counts the tokens of a word's bytes. Start state 0."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_of_letter()
        self.id_of = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        names = model["vocab"]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged[names[a], names[b]] = (rank, names[a + b])
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.growing = {t[:n] for t in self.id_of for n in range(len(t) + 1)}
        self.single = {i for t, i in self.id_of.items() if self.encode(t) == [i]}
        self.parts = {m: (a, b, rank) for (a, b), (rank, m) in reversed(self.merged.items())}
        self.apart: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states = [START]
        self.number = {START: 0}
        self.step: dict[int, int] = {}

    def encode(self, word: bytes) -> list[int]:
        """Plain merging by rank; for compiling, not for texts."""
        parts = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            found = [(self.merged[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merged]
            if not found:
                break
            rank, _ = min(found)
            out, i = [], 0
            while i < len(parts):
                m = self.merged.get((parts[i], parts[i + 1])) if i + 1 < len(parts) else None
                if m and m[0] == rank:
                    out.append(m[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _stay_apart(self, a: int, b: int) -> bool:
        known = self.apart.get(a << 20 | b)
        if known is None:
            if len(self.apart) > TRANSITIONS:
                self.apart.clear()
            known = self.apart[a << 20 | b] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        """Whether no merge crosses the seam while a and b are being built.

        Undoes the later of the two newest merges at the seam, again and
        again. A merge across it must come before both neighbours are taken
        up by their own parents; of equal ranks the left one is first.
        """
        never = 1 << 30
        a_ends = b_ends = never
        while True:
            across = self.merged.get((a, b))
            if across and across[0] < a_ends and across[0] <= b_ends:
                return False
            a_parts, b_parts = self.parts.get(a), self.parts.get(b)
            if a_parts is None and b_parts is None:
                return True
            if b_parts is None or (a_parts is not None and a_parts[2] > b_parts[2]):
                a, a_ends = a_parts[1], a_parts[2]
            else:
                b, b_ends = b_parts[0], b_parts[2]

    def _compile(self, state: int, byte: int) -> int:
        end, lasts = self.states[state]
        grown = end + bytes((byte,))
        n = len(grown)
        for size in range(n, 0, -1):
            token = self.id_of.get(grown[n - size :])
            if token is None or token not in self.single:
                continue
            before, count = lasts[n - size]
            if before < 0 or self._stay_apart(before, token):
                break
        else:
            raise AssertionError("every byte is a token")
        change = count + 1
        keep = next(k for k in range(n, -1, -1) if grown[n - k :] in self.growing)
        # a place matters only while what follows it can still become a token
        window = [(lasts[k][0], lasts[k][1] - change) if grown[k:] in self.growing else None for k in range(n - keep, n)]
        window.append((token, 0))
        key = (grown[n - keep :], tuple(window))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        packed = to << 10 | (change + 512)
        self.step[state << 8 | byte] = packed
        return packed

    def run(self, state: State, data: bytes) -> tuple[State, int]:
        """The state behind the bytes, and the tokens counted on the way."""
        if len(self.step) > TRANSITIONS:  # the compiled part is started anew once it is full
            self.clear()
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
        step, total = self.step, 0
        for byte in data:
            packed = step.get(at << 8 | byte)
            if packed is None:
                packed = self._compile(at, byte)
            at = packed >> 10
            total += (packed & 1023) - 512
        return self.states[at], total

    def count(self, word: bytes) -> int:
        return self.run(START, word)[1]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.id_of))

    def state_map(self, chunk: bytes, before: bytes, first: bool) -> Map:
        """From the states that the bytes before may lead to; from the start in a word's first chunk."""
        if first:
            return {START: self.run(START, chunk)}
        entries = {self.run(START, before[-k * self.longest :])[0] for k in LOOKBACK}
        return {state: self.run(state, chunk) for state in entries}


def compose(a: Map, b: Map) -> Map:
    """The map of two neighbours, for the entries whose exit the second one knows."""
    return {entry: (b[exit_][0], n + b[exit_][1]) for entry, (exit_, n) in a.items() if exit_ in b}


def composed(maps: list[Map]) -> Map:
    """A balanced scan."""
    while len(maps) > 1:
        pairs = [compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
        maps = pairs + maps[len(pairs) * 2 :]
    return maps[0]


def missing(maps: list[Map]) -> tuple[int, State] | None:
    """The first chunk whose map lacks the state that is reached at its front, and that state."""
    state = START
    for i, m in enumerate(maps):
        if state not in m:
            return i, state
        state = m[state][0]
    return None


def chunks(word: bytes, size: int, longest: int) -> list[tuple[bytes, bytes]]:
    """The chunks of a word, each with the bytes before it that decide its entry."""
    reach = LOOKBACK[-1] * longest
    return [(word[i : i + size], word[max(0, i - reach) : i]) for i in range(0, len(word), size)]


def written(state: State) -> str:
    """A state as text, the same in every worker."""
    return json.dumps([state[0].hex(), state[1]])


def read(text: str) -> State:
    end, window = json.loads(text)
    return bytes.fromhex(end), tuple(tuple(w) if w is not None else None for w in window)


class _Words(dict):
    """Counts of words, found when first asked for."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        count = self.transducer.count(word.encode())
        if len(word) <= 64:
            self[word] = count
        return count


class Counter:
    def __init__(self, path: str) -> None:
        self.path = path
        self.words = _Words(Transducer(path))

    @cached_property
    def _library(self) -> PreTokenizer:
        return Tokenizer.from_file(self.path).pre_tokenizer

    def _split(self, text: str) -> list[str]:
        if _LATE.search(text) and _unsure().search(text):
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def parts(self, text: str, chunk: int = CHUNK) -> tuple[int, list[bytes]]:
        """Tokens of the added token and of all words up to a size, and the longer words."""
        if len(self.words) > WORDS:
            self.words.clear()
        pieces = text.split(ADDED) if ADDED in text else [text]
        total, long = len(pieces) - 1, []
        for piece in pieces:
            words = self._split(piece)
            if len(piece) * 4 > chunk:
                long += [w for w in (word.encode() for word in words if len(word) * 4 > chunk) if len(w) > chunk]
                words = [w for w in words if len(w) * 4 <= chunk or len(w.encode()) <= chunk]
            total += sum(map(self.words.__getitem__, words))
        return total, long

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text in one place, its long words by their chunks."""
        total, long = self.parts(text, chunk)
        transducer = self.words.transducer
        for word in long:
            pieces = chunks(word, chunk, transducer.longest)
            maps = [transducer.state_map(c, before, i == 0) for i, (c, before) in enumerate(pieces)]
            while lack := missing(maps):
                maps[lack[0]][lack[1]] = transducer.run(lack[1], pieces[lack[0]][0])
            total += composed(maps)[START][1]
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens. Repeated rows, null ids
    and further columns need nothing: each row stands for itself, and an empty
    table gives none. Only chunks of words beyond ``chunk`` bytes move; a
    worker holds the vocabulary and bounded tables.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, row = counter(path), TaskContext.get().partitionId() << 40
        longest = tokens.words.transducer.longest
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                total, long = tokens.parts(text or "", chunk)
                out.append((row, doc, len((text or "").encode()), total, None, None, None, None))
                for w, word in enumerate(long):
                    out += [(row, None, None, None, w, i, c, before) for i, (c, before) in enumerate(chunks(word, chunk, longest))]
                row += 1
            found = pd.DataFrame(out, columns=["row", "doc_id", "n_bytes", "n_tokens", "word", "part", "chunk", "before"], dtype=object)
            yield found

    schema = f"row long, doc_id {kind}, n_bytes long, n_tokens long, word int, part int, chunk binary, before binary"
    parts = durable(docs.select("doc_id", "text").mapInPandas(count, schema))
    counted, cut = parts.where("part is null"), parts.where("part is not null")
    if not cut.isEmpty():
        more = _by_chunks(cut, path).groupBy("row").agg(F.sum("tokens").alias("more"))
        counted = counted.join(more, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_MAPS = "row long, word int, part int, entry string, exit string, tokens long"


def _by_chunks(cut: DataFrame, path: str) -> DataFrame:
    """(row, word, tokens) of words whose chunks lie in rows of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = counter(path).words.transducer
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.entry is None:
                    found = transducer.state_map(r.chunk, r.before, r.part == 0)
                else:
                    found = {read(r.entry): transducer.run(read(r.entry), r.chunk)}
                out += [(r.row, r.word, r.part, written(e), written(x), n) for e, (x, n) in found.items()]
            yield pd.DataFrame(out, columns=["row", "word", "part", "entry", "exit", "tokens"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        row, word = int(group["row"].iat[0]), int(group["word"].iat[0])
        maps: list[Map] = [{} for _ in range(int(group["part"].max()) + 1)]
        for r in group.itertuples(index=False):
            maps[r.part][read(r.entry)] = (read(r.exit), int(r.tokens))
        lack = missing(maps)
        done = (row, word, composed(maps)[START][1], None, None) if lack is None else (row, word, None, lack[0], written(lack[1]))
        return pd.DataFrame([done], columns=["row", "word", "tokens", "part", "entry"]).astype({"tokens": "Int64", "part": "Int32"})

    # chunks of one word go to different tasks
    dealt = cut.select("row", "word", "part", "chunk", "before", F.lit(None).cast("string").alias("entry"))
    maps = durable(dealt.repartition("row", "word", "part").mapInPandas(run, _MAPS))
    while True:
        scanned = maps.groupBy("row", "word").applyInPandas(scan, "row long, word int, tokens long, part int, entry string")
        scanned = durable(scanned)
        open_ = scanned.where("tokens is null")
        if open_.isEmpty():
            return scanned.select("row", "word", "tokens")
        asked = cut.join(open_.select("row", "word", "part", "entry"), ["row", "word", "part"])
        found = asked.select("row", "word", "part", "chunk", "before", "entry").mapInPandas(run, _MAPS)
        maps = durable(maps.unionByName(found))
