"""Frozen Unicode sets, derived from the interpreter's database by rule.

The assigned set is that of Unicode 14.0: what Python's database assigns,
less what later versions added.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Code points added after Unicode 14.0 (versions 15.0 and 15.1).
ADDED_LATER = [
    (0x0CF3, 0x0CF3), (0x0ECE, 0x0ECE), (0x10EFD, 0x10EFF), (0x1123F, 0x11241), (0x11B00, 0x11B09),
    (0x11F00, 0x11F10), (0x11F12, 0x11F3A), (0x11F3E, 0x11F59), (0x1342F, 0x1342F), (0x13439, 0x13455),
    (0x1B132, 0x1B132), (0x1B155, 0x1B155), (0x1D2C0, 0x1D2D3), (0x1DF25, 0x1DF2A), (0x1E030, 0x1E06D),
    (0x1E08F, 0x1E08F), (0x1E4D0, 0x1E4F9), (0x1F6DC, 0x1F6DC), (0x1F774, 0x1F776), (0x1F77B, 0x1F77F),
    (0x1F7D9, 0x1F7D9), (0x1FA75, 0x1FA77), (0x1FA87, 0x1FA88), (0x1FAAD, 0x1FAAF), (0x1FABB, 0x1FABD),
    (0x1FABF, 0x1FABF), (0x1FACE, 0x1FACF), (0x1FADA, 0x1FADB), (0x1FAE8, 0x1FAE8), (0x1FAF7, 0x1FAF8),
    (0x31350, 0x323AF), (0x2FFC, 0x2FFF), (0x31EF, 0x31EF), (0x2EBF0, 0x2EE5D),
    (0x2B739, 0x2B739),
]

# Assigned code points that a storage name may not hold.
EXCLUDED = [
    (0xE000, 0xF8FF), (0xE0000, 0xE007F), (0xE0100, 0xE01EF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD),
]

# Half-width sound marks, which join the code point before them.
HALFWIDTH_MARKS = [(0xFF9E, 0xFF9F)]


def _ranges(points) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


@lru_cache(maxsize=1)
def assigned_ranges() -> list[tuple[int, int]]:
    """Assigned scalars of Unicode 14.0; surrogates are not scalars."""
    later = {p for a, b in ADDED_LATER for p in range(a, b + 1)}
    return _ranges(
        p
        for p in range(0x110000)
        if not 0xD800 <= p <= 0xDFFF and p not in later and unicodedata.category(chr(p)) != "Cn"
    )


@lru_cache(maxsize=1)
def combining_ranges() -> list[tuple[int, int]]:
    """Code points with a non-zero combining class."""
    return _ranges(p for p in range(0x110000) if unicodedata.combining(chr(p)))


def char_class(ranges: list[tuple[int, int]], negated: bool = False) -> str:
    """A regular-expression class over code point ranges."""
    body = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[{'^' if negated else ''}{body}]"


@lru_cache(maxsize=1)
def common_class() -> str:
    """Class over the first and the largest assigned ranges.

    They hold nearly all text, so that what is left after removing them is
    short and the long class of all ranges seldom has to be tried.
    """
    ranges = assigned_ranges()
    largest = sorted(ranges[1:], key=lambda r: r[0] - r[1])[:12]
    return char_class([ranges[0], *sorted(largest)])
