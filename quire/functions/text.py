"""Text columns: lengths in the three units, literal search, typography."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def grapheme_count(text: Column) -> Column:
    """Length in user-perceived characters, whitespace included."""
    return F.regexp_count(text, F.lit(r"\X")).cast("long")


def literal_pattern(query: str) -> str:
    """A case-insensitive pattern for exactly this text."""
    quoted = query.replace("\\E", "\\E\\\\E\\Q")
    return f"(?iu)\\Q{quoted}\\E"


#: Segments handled by one inner fold; keeps the position arrays linear.
_BLOCK = 256


def is_wide(text: Column) -> Column:
    """True if some code point takes two UTF-16 units."""
    return text.rlike("[\\x{10000}-\\x{10FFFF}]")


def piece_sizes(text: Column, query: str, wide: Column) -> Column:
    """Lengths of the pieces between literal matches, in both units.

    ``wide`` is a column of the frame that holds :func:`is_wide`, so that only
    such texts pay for counting units.
    """
    pieces = F.split(text, literal_pattern(query), -1)

    def size(piece: Column) -> Column:
        points = F.length(piece).cast("long")
        units = F.when(wide, utf16_length(piece)).when(~wide, points)
        return F.struct(points.alias("cp"), units.alias("u16"))

    return F.transform(pieces, size)


def match_offsets(sizes: Column, query: str) -> Column:
    """Array of ``(hit, cp, u16)``: 0-based offsets of each literal match.

    Matches do not overlap and are found left to right. Offsets count code
    points and UTF-16 units of the original text; they come from the lengths
    of the pieces between the matches, inside the row, without a shuffle.
    ``sizes`` must be a column of the frame, since it is read repeatedly.
    """
    query_cp = len(query)
    # simple case folding keeps a match inside the plane of its query character
    query_u16 = len(query.encode("utf-16-be")) // 2
    start = F.struct(F.lit(0).cast("long").alias("cp"), F.lit(0).cast("long").alias("u16"))

    def advance(acc: Column, size: Column) -> Column:
        return F.struct(
            (acc["cp"] + size["cp"] + query_cp).alias("cp"),
            (acc["u16"] + size["u16"] + query_u16).alias("u16"),
        )

    def fold_block(origin: Column, block: Column) -> Column:
        empty = F.array().cast("array<struct<cp:bigint,u16:bigint>>")

        def step(acc: Column, size: Column) -> Column:
            here = F.struct(
                (acc["at"]["cp"] + size["cp"]).alias("cp"),
                (acc["at"]["u16"] + size["u16"]).alias("u16"),
            )
            return F.struct(
                advance(acc["at"], size).alias("at"),
                F.concat(acc["out"], F.array(here)).alias("out"),
            )

        seed = F.struct(origin.alias("at"), empty.alias("out"))
        return F.aggregate(block, seed, step)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    nested = F.aggregate(
        blocks,
        F.struct(
            start.alias("at"),
            F.array().cast("array<array<struct<cp:bigint,u16:bigint>>>").alias("out"),
        ),
        lambda acc, block: F.transform(
            F.array(fold_block(acc["at"], block)),
            lambda done: F.struct(
                done["at"].alias("at"),
                F.concat(acc["out"], F.array(done["out"])).alias("out"),
            ),
        )[0],
    )
    flat = F.flatten(nested["out"])
    # the end of the last piece is the end of the text, not a match
    hits = F.slice(flat, F.lit(1), F.size(sizes) - 1)
    return F.transform(hits, lambda at, i: F.struct(i.cast("long").alias("hit"), at["cp"], at["u16"]))


# Excerpt radius in UTF-16 units, sentence ends, ellipsis.
EXCERPT_RADIUS = 80
SENTENCE_ENDS = ".!?\n\r。！？"
ELLIPSIS = "…"


def _units_tail(text: Column, units: int) -> Column:
    """Shortest tail holding at least ``units`` UTF-16 units, else the text."""
    plain = utf16_length(text) == F.length(text)
    by_point = F.right(text, F.lit(units))
    fitting = F.filter(
        F.sequence(F.lit(units // 2), F.lit(units)),
        lambda k: utf16_length(F.right(text, k)) >= units,
    )
    return F.when(plain, by_point).otherwise(F.right(text, F.coalesce(F.get(fitting, F.lit(0)), F.lit(units))))


def _units_head(text: Column, units: int) -> Column:
    plain = utf16_length(text) == F.length(text)
    fitting = F.filter(
        F.sequence(F.lit(units // 2), F.lit(units)),
        lambda k: utf16_length(F.left(text, k)) >= units,
    )
    return F.when(plain, F.left(text, F.lit(units))).otherwise(
        F.left(text, F.coalesce(F.get(fitting, F.lit(0)), F.lit(units)))
    )


_CHUNK = 1024


def text_chunks(text: Column) -> Column:
    """The text cut into runs of 1,024 code points, for cheap access by offset."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def excerpt_window(chunks: Column, cp: Column, length: int) -> Column:
    """Text around a match at code point ``cp``, wide enough for its excerpt."""
    first = F.greatest(cp - EXCERPT_RADIUS, F.lit(0))
    start = F.floor(first / _CHUNK).cast("int")
    width = 2 * EXCERPT_RADIUS + length
    span = F.array_join(F.slice(chunks, start + 1, F.lit(width // _CHUNK + 2)), "")
    return F.substring(span, (first - start * _CHUNK).cast("int") + 1, F.lit(width))


def excerpt(window: Column, cp: Column, total: Column, length: int) -> tuple[Column, Column]:
    """``(preview, preview_offset)`` of the match at ``cp`` inside its window.

    Up to 80 units on each side, from after the preceding sentence end to the
    next one inclusive, with an ellipsis where text was left out.
    """
    ends = "[" + re.escape(SENTENCE_ENDS) + "]"
    lead = F.least(cp, F.lit(EXCERPT_RADIUS)).cast("int")
    before = _units_tail(F.left(window, lead), EXCERPT_RADIUS)
    clipped = F.regexp_replace(before, f"(?s)^.*{ends}", "")
    body = F.substring(window, lead + 1, F.lit(length))
    after = _units_head(F.substring(window, lead + length + 1, F.lit(EXCERPT_RADIUS)), EXCERPT_RADIUS)
    # extracted, since positions from regexp_instr count UTF-16 units
    stopped = F.regexp_extract(after, f"^[^{ends[1:]}*{ends}", 0)
    tail = F.when(stopped != "", stopped).otherwise(after)
    leading = F.length(clipped) < cp
    trailing = cp + length + F.length(tail) < total
    preview = F.concat(
        F.when(leading, ELLIPSIS).otherwise(""), clipped, body, tail,
        F.when(trailing, ELLIPSIS).otherwise(""),
    )
    return preview, utf16_length(clipped) + F.when(leading, 1).otherwise(0)


# Typography rules and bracket pairs.
ELLIPSIS_RULE = (r"\.\.\.", "⋯")
QUOTE_RULES = (("ㄴㄴ", "「」"), ("ㄱㄱ", "『』"))
SCENE_BREAK = "\n\n * * *\n\n"
BRACKET_PAIRS = (("'", "'"), ('"', '"'), ("[", "]"), ("(", ")"), ("{", "}"), ("「", "」"), ("『", "』"))
_LONE_STAR = r"(?m)^\*$"


def rewrite_typography(text: Column) -> Column:
    out = F.regexp_replace(text, *ELLIPSIS_RULE)
    for trigger, replacement in QUOTE_RULES:
        out = F.replace(out, F.lit(trigger), F.lit(replacement))
    return F.regexp_replace(out, _LONE_STAR, SCENE_BREAK)


def typography_counts(text: Column) -> dict[str, Column]:
    return {
        "ellipses": F.regexp_count(text, F.lit(ELLIPSIS_RULE[0])).cast("long"),
        "quotes": F.regexp_count(text, F.lit("ㄴㄴ|ㄱㄱ")).cast("long"),
        "scene_breaks": F.regexp_count(text, F.lit(_LONE_STAR)).cast("long"),
    }


def unmatched_brackets(text: Column) -> Column:
    """Pairs whose openers and closers differ in number (odd for quotes)."""
    total = F.lit(0)
    for opener, closer in BRACKET_PAIRS:
        if opener == closer:
            odd = F.regexp_count(text, F.lit(re.escape(opener))) % 2
            total = total + odd
        else:
            gap = F.regexp_count(text, F.lit(re.escape(opener))) - F.regexp_count(
                text, F.lit(re.escape(closer))
            )
            total = total + F.when(gap != 0, 1).otherwise(0)
    return total.cast("long")
