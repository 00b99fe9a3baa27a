"""Secrets by fixed rules and by inferred credential grammars.

Values that the fixed rules find are labelled credentials. Their prefix tree,
with the frequencies of ends and next symbols, is reduced by merging states
whose frequencies are compatible under a Hoeffding bound; each kind gives a
probabilistic automaton, and so do ordinary character runs. Every run of
credential characters in every text is then scored: it is a secret if a
credential automaton makes it likelier than all automata of ordinary runs by
a margin. Whole texts are scanned by row, without a shuffle; only the bounded
training samples meet.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import smallest_draws

#: Kinds in their order, rules and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LEAST = {"assign": 8, "access": 16, "hex": 32}
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The kind of a span that only a grammar finds.
GRAMMAR = "grammar"

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]{8,}")

#: Distinct values of each kind that the grammars are learned from, and their largest length.
PER_KIND, MOST_LENGTH = 512, 256
#: Confidence of the bound under which two states merge.
ALPHA = 0.05
#: A symbol stays a literal in a state where it has this share of at least so many values.
LITERAL_SHARE, LITERAL_COUNT = 0.5, 8
#: Natural log of how much likelier a credential grammar must make a run.
MARGIN = 8.0
#: Probability that a state of an ordinary grammar leaves for symbols never seen there.
UNSEEN = 1e-4

_CLASSES = {c: k for k, group in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")) for c in group}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value): leftmost matches, the short ones dropped."""
    found = []
    folded = text.lower()
    if any(n in folded for n in _NAMES):
        found += [("assign", m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    # a run of 32 or more is the same whether short ones are matched and dropped or passed over
    found += [("hex", m.start(), m.end(), m.start()) for m in _LONG_HEX.finditer(text)]
    return found


class _State:
    __slots__ = ("count", "ends", "next", "chars")

    def __init__(self) -> None:
        self.count = 0
        self.ends = 0
        self.next: dict = {}
        self.chars: Counter = Counter()  # characters behind the symbols that leave here


def _groups(values: list[str]) -> dict[str, int]:
    """Character classes; classes that most values mix count as one."""
    of = {c: _CLASSES.get(c, 10 + ord(c)) for v in values for c in v}
    parent = {k: k for k in of.values()}

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    have = Counter()
    for v in values:
        kinds = sorted({of[c] for c in v})
        have.update((a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :])
    for (a, b), n in sorted(have.items()):
        if 2 * n >= len(values):
            parent[root(b)] = root(a)
    return {c: root(k) for c, k in of.items()}


@dataclass
class Automaton:
    """States as dicts: symbol -> (state, log probability); a literal symbol goes before its class."""

    group: dict[str, int]
    moves: list[dict]
    ends: list[float]
    chars: list[dict]
    strict: bool

    def log_likelihood(self, text: str, least: float = -math.inf) -> float:
        """Log probability of the text; -inf as soon as it is known to be below ``least``."""
        state, total = 0, 0.0
        for c in text:
            moves = self.moves[state]
            hop = moves.get(c)
            if hop is None:
                hop = moves.get(self.group.get(c))
                p = self.chars[state].get(c) if hop is not None else None
                if p is None:
                    if self.strict:
                        return -math.inf
                    total += math.log(UNSEEN / 64)
                    state = 0 if hop is None else hop[0]
                    if total < least:
                        return -math.inf
                    continue
                total += p
            else:
                total += hop[1]
            state = hop[0]
            if total < least:
                return -math.inf
        return total + self.ends[state]


def _tree(values: list[str], group: dict[str, int]) -> _State:
    root = _State()
    work = [(root, sorted(values), 0)]
    while work:
        state, rest, depth = work.pop()
        state.count = len(rest)
        state.ends = sum(len(v) == depth for v in rest)
        rest = [v for v in rest if len(v) > depth]
        heads = Counter(v[depth] for v in rest)
        parts: dict = {}
        for v in rest:
            c = v[depth]
            fixed = heads[c] >= LITERAL_COUNT and heads[c] >= LITERAL_SHARE * state.count
            symbol = c if fixed else group[c]
            parts.setdefault(symbol, []).append(v)
            if not fixed:
                state.chars[c] += 1
        for symbol, part in parts.items():
            child = state.next[symbol] = _State()
            work.append((child, part, depth + 1))
    return root


def _differ(n1: int, of1: int, n2: int, of2: int, bound: float) -> bool:
    if not of1 or not of2:
        return False
    return abs(n1 / of1 - n2 / of2) > bound * (1 / math.sqrt(of1) + 1 / math.sqrt(of2))


def _compatible(a: _State, b: _State, bound: float) -> bool:
    work, seen = [(a, b)], set()
    while work:
        a, b = work.pop()
        if (id(a), id(b)) in seen:
            continue
        seen.add((id(a), id(b)))
        if _differ(a.ends, a.count, b.ends, b.count, bound):
            return False
        for s in a.next.keys() | b.next.keys():
            x, y = a.next.get(s), b.next.get(s)
            if _differ(x.count if x else 0, a.count, y.count if y else 0, b.count, bound):
                return False
            if x and y:
                work.append((x, y))
    return True


def _fold(a: _State, b: _State) -> None:
    """Add the tree below b to the states from a on."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        a.count += b.count
        a.ends += b.ends
        a.chars.update(b.chars)
        for s, y in b.next.items():
            x = a.next.get(s)
            if x is None:
                a.next[s] = y
            else:
                work.append((x, y))


def infer(values: list[str], strict: bool) -> Automaton:
    """The automaton of a sample of strings: compatible states of its prefix tree merged."""
    group = _groups(values)
    root = _tree(values, group)
    bound = math.sqrt(0.5 * math.log(2 / ALPHA))
    red = [root]
    while True:
        firm = {id(r) for r in red}
        edge = [(-y.count, i, str(s), s) for i, r in enumerate(red) for s, y in r.next.items() if id(y) not in firm]
        if not edge:
            break
        _, i, _, symbol = min(edge)
        blue = red[i].next[symbol]
        target = next((r for r in red if _compatible(r, blue, bound)), None)
        if target is None:
            red.append(blue)
        else:
            red[i].next[symbol] = target
            _fold(target, blue)
    number = {id(r): i for i, r in enumerate(red)}
    moves, ends, chars = [], [], []
    for r in red:
        total = max(r.count, 1)
        log = lambda n: math.log(n / total) if n else -math.inf  # noqa: E731, B023
        literal = {s: y for s, y in r.next.items() if isinstance(s, str)}
        outs = {c: n for c, n in r.chars.items()}
        left = total - r.ends - sum(outs.values())
        share = left / max(len(literal), 1)
        moves.append({s: (number[id(y)], log(share) if s in literal else 0.0) for s, y in r.next.items()})
        ends.append(log(r.ends) if r.ends else (-math.inf if strict else math.log(UNSEEN)))
        chars.append({c: log(n) for c, n in outs.items()})
        # characters of a class that this state never saw, but the grammar did
        for s in r.next:
            if not isinstance(s, str):
                members = [c for c, g in group.items() if g == s]
                seen = sum(outs.get(c, 0) for c in members)
                for c in members:
                    chars[-1][c] = math.log((outs.get(c, 0) + 0.5) / (seen + 0.5 * len(members)) * max(seen, 0.5) / total)
    return Automaton(group, moves, ends, chars, strict)


def _ordinary(run: str) -> str:
    """Strata of ordinary runs: rare kinds must not vanish among words."""
    digits = sum(c.isdigit() for c in run)
    return "word" if not digits else "number" if digits == sum(c.isalnum() for c in run) else "mixed"


def _labelled(text: str) -> Iterator[tuple[str, str]]:
    found = base_spans(text)
    for kind, _, end, value in found:
        yield kind, text[value:end]
    places = sorted((s, e) for _, s, e, _ in found)
    for m in _RUN.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in places):
            run = m.group()
            yield _ordinary(run), run


@dataclass
class Grammars:
    secret: list[Automaton]
    ordinary: list[Automaton]

    def is_secret(self, run: str) -> bool:
        best = max(a.log_likelihood(run) for a in self.secret)
        if best == -math.inf:
            return False
        usual = max((a.log_likelihood(run, best - MARGIN - 1) for a in self.ordinary), default=-math.inf)
        return best - usual >= MARGIN

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[Span]:
        """Runs, or pieces of runs, that a credential grammar claims outside the taken places."""
        if not self.secret:
            return []
        found = []
        for m in _RUN.finditer(text):
            run = m.group()
            if self.is_secret(run):
                found.append((m.start(), m.end()))
            elif "=" in run or "." in run:
                found += [(m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(run) if p.end() - p.start() < len(run) and self.is_secret(p.group())]
        return [(GRAMMAR, s, e) for s, e in found if not any(a < e and s < b for a, b in taken)]


def _draw(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=6).digest())


def learn(docs: DataFrame, per_kind: int = PER_KIND) -> Grammars:
    """Grammars from at most ``per_kind`` distinct values of each kind in the whole table."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # only what can be among the smallest hashes of its kind leaves the task
        best: dict[str, set[str]] = {}
        for batch in batches:
            for text in batch["text"]:
                for kind, value in _labelled(text or ""):
                    if len(value) <= MOST_LENGTH:
                        best.setdefault(kind, set()).add(value)
            for kind, held in best.items():
                if len(held) > per_kind:
                    best[kind] = set(sorted(held, key=_draw)[:per_kind])
        rows = [(k, v, _draw(v)) for k, held in best.items() for v in held]
        yield pd.DataFrame(rows, columns=["kind", "value", "draw"])

    found = docs.select("text").mapInPandas(values, "kind string, value string, draw long").distinct()
    chosen = smallest_draws(found, "kind", per_kind, "draw", "value").select("kind", "value").collect()
    by: dict[str, list[str]] = {}
    for r in chosen:
        by.setdefault(r["kind"], []).append(r["value"])
    secret = [infer(by[k], strict=True) for k in KINDS if len(by.get(k, [])) >= LITERAL_COUNT]
    # a bare credential among ordinary runs must not teach what is ordinary
    fits = lambda v: any(a.log_likelihood(v) > -math.inf for a in secret)
    usual = {k: [v for v in values if not fits(v)] for k, values in sorted(by.items()) if k not in KINDS}
    return Grammars(secret, [infer(v, strict=False) for v in usual.values() if v])


def _joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, GRAMMAR))}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def scan(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """doc_id with the counts of each kind, digest of base spans, and all spans, by row.

    A null text is an empty one. Repeated rows stand each for themselves; an
    empty table gives no rows; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammars)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                base = [(k, s, e) for k, s, e, _ in base_spans(text)]
                more = shared.value.spans(text, [(s, e) for _, s, e in base])
                n = Counter(k for k, _, _ in base)
                out.append((doc, *[n[k] for k in KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"]).astype({"doc_id": batch["doc_id"].dtype})

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long"
    return docs.select("doc_id", "text").mapInPandas(find, schema)
