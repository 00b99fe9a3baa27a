from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.token_counts import ADDED, START, Counter, Transducer, chunks, compose, composed, read, token_counts, written

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "'s", "'", "a", "the", "ing", ADDED, "<|", "é", "漢", "9", "½", " ", "\x1c", "\x85", "\xa0", "!", "🙂", "　", "ſ", "\U0003eda6"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return Counter(PATH)


def _texts(seed, many):
    draw = random.Random(seed)
    for _ in range(many):
        out = []
        for _ in range(draw.randrange(14)):
            code = draw.choice([draw.randrange(1, 0xD800), draw.randrange(0xE000, 0x110000)])
            out.append(draw.choice(PARTS) if draw.random() < 0.8 else chr(code))
        yield "".join(out)


def test_counts_equal_the_library(library, mine):
    draw = random.Random(5)
    for text in _texts(1, 4000):
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert mine.count(text) == expected, repr(text)
        assert mine.count(text, draw.randrange(1, 6)) == expected, repr(text)


def test_every_code_point(library, mine):
    for low in range(0, 0x110000, 4096):
        points = [c for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000]
        if not points or 0x40000 < low < 0xE0000:
            continue
        text = "\n".join(f"a{chr(c)}a 1{chr(c)}1 '{chr(c)}'s" for c in points)
        assert mine.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(low)


def test_seams_equal_encoding():
    t = Transducer(PATH)
    draw, ids = random.Random(2), sorted(t.single)
    for _ in range(5000):
        a, b = draw.choice(ids), draw.choice(ids)
        assert t._seam_holds(a, b) == (t.encode(t.bytes_of[a] + t.bytes_of[b]) == [a, b])


def test_tables_start_anew_when_full(library, monkeypatch):
    monkeypatch.setattr("quire.llm.token_counts.TRANSITIONS", 50)
    monkeypatch.setattr("quire.llm.token_counts.WORDS", 5)
    small = Counter(PATH)
    for text in _texts(3, 300):
        assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rows(spark, library):
    long = "word " * 60_000 + "x" * 200_000
    data = [(1, "Some words.", "a"), (1, "Some words.", "a"), (2, None, "b"), (3, "", "c"), (None, "two words", "d"), (4, long, "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs, PATH).collect()), key=str)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t, _ in data]
    assert got == sorted(want, key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_state_maps_compose(mine):
    transducer, draw = mine.words.transducer, random.Random(7)
    for _ in range(60):
        word = "".join(draw.choice(["a", "the", "ing", "xq", "é", "漢", "=", "ab"]) for _ in range(draw.randrange(20, 400))).encode()
        pieces = chunks(word, draw.randrange(1, 60), transducer.longest)
        maps = [transducer.state_map(c, before, i == 0) for i, (c, before) in enumerate(pieces)]
        whole = composed(maps)
        assert whole[START] == transducer.run(START, word)
        third = draw.randrange(len(maps) + 1)  # associative
        if 0 < third < len(maps):
            assert compose(composed(maps[:third]), composed(maps[third:])) == whole
        assert all(read(written(e)) == e for m in maps for e in m)


def test_long_words_over_several_tasks(spark, library):
    draw = random.Random(8)
    letters = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    data = [(1, letters), (1, letters), (None, "say " + letters[:150_000] + " twice " + letters[:99_999] + ADDED + "é" * 70_000), (2, "short"), (3, "=" * 200_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = sorted(((i, len(t.encode()), count(t), count(t) > 1024) for i, t in data), key=str)
    assert sorted(map(tuple, token_counts(docs, PATH, chunk=10_000).collect()), key=str) == want


def test_states_that_the_front_does_not_tell(spark, library, monkeypatch):
    monkeypatch.setattr("quire.llm.token_counts.LOOKBACK", (0, 0))  # every chunk is first run from a wrong state
    monkeypatch.setattr(Transducer, "state_map", lambda self, chunk, before, first: {START: self.run(START, chunk)})
    text = "internationalisation" * 30
    assert Counter(PATH).count(text, 7) == len(library.encode(text, add_special_tokens=False).ids)
