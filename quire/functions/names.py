"""Rules on entry names, relative paths and numbered folders, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quire.functions.text import utf16_length

# Reserved device names, forbidden characters, length limits.
DEVICE_NAMES = [
    "CON", "PRN", "AUX", "NUL", "CLOCK$",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]
FORBIDDEN = r'[<>:"/\\|?*]'
MAX_ENTRY_NAME = 255
MAX_PATH = 1024
MAX_FOLDER_NAME = 1024

# Folder names with a meaning of their own.
TOP = "메인"
MANUSCRIPT = "원고"
TRASH = "휴지통"
BACKUP = "백업"
ROOT_KEY = "<root>"

# First index of a root item ordered by hand.
CUSTOM_ORDER_OFFSET = 1_000_000


def valid_relative_path(path: Column) -> Column:
    bad = r"(^/|\\|//|(^|/)\.{1,2}(/|$)|/$)"
    ok = (path != "") & (path == F.btrim(path)) & (F.length(path) <= MAX_PATH) & ~path.rlike(bad)
    return F.coalesce(ok, F.lit(False))


def valid_entry_name(name: Column) -> Column:
    """Name accepted by the ledger."""
    ok = (
        (name != "")
        & (name == F.btrim(name))
        & (F.length(name) <= MAX_ENTRY_NAME)
        & (F.right(name, F.lit(1)) != ".")
        & ~name.rlike(FORBIDDEN)
        & ~name.rlike(r"\p{Cntrl}")
        & ~F.upper(F.split_part(name, F.lit("."), F.lit(1))).isin(DEVICE_NAMES)
    )
    return F.coalesce(ok, F.lit(False))


def valid_folder_name(name: Column) -> Column:
    """The looser client check on folder names."""
    ok = (name != "") & (F.length(name) <= MAX_FOLDER_NAME) & ~name.rlike(r"[/\\]")
    return F.coalesce(ok, F.lit(False))


def name_violation(name: Column) -> Column:
    """First violated naming rule as a code, null when the name is fine.

    Pass an NFC-normalized name.
    """
    stem = F.upper(F.btrim(F.split_part(name, F.lit("."), F.lit(1)), F.lit(" .")))
    first_bad = F.regexp_extract(name, r'([\p{Cc}\p{Cf}<>:"/\\|?*])', 1)
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(name.isin(".", ".."), "dotSegment")
        .when(first_bad.rlike(r"[\p{Cc}\p{Cf}]"), "controlCharacter")
        .when(first_bad != "", "forbiddenCharacter")
        .when(F.right(name, F.lit(1)).isin(" ", "."), "trailingSpaceOrPeriod")
        .when(stem.isin(DEVICE_NAMES), "reservedName")
        .when(utf16_length(name) > MAX_ENTRY_NAME, "nameTooLong")
    )


def path_violation(path: Column) -> Column:
    """First violated rule of a whole relative path; null when it is fine."""
    absolute = path.rlike(r"^(/|~/|\\|\p{L}:)")
    parts = F.transform(F.split(path, "/", -1), lambda part: name_violation(part))
    first = F.get(F.filter(parts, lambda code: code.isNotNull()), F.lit(0))
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(absolute, "absolutePath")
        .when(utf16_length(path) > MAX_PATH, "pathTooLong")
        .otherwise(first)
    )


def volume_number(name: Column) -> Column:
    digits = F.regexp_extract(name, "^([1-9][0-9]*)권$", 1)
    return digits.try_cast("bigint")


_CHAPTER = r"(?s)^([0-9]{3}|[1-9][0-9]{3,})화(.*)\.txt$"


def chapter_number(name: Column) -> Column:
    """Number of a ``NNN화….txt`` name in canonical padding, else null."""
    number = F.regexp_extract(name, _CHAPTER, 1).try_cast("bigint")
    return F.when(number > 0, number)


def chapter_prefix(name: Column) -> Column:
    return F.when(
        chapter_number(name).isNotNull(), F.concat(F.regexp_extract(name, _CHAPTER, 1), F.lit("화"))
    )


def chapter_title(name: Column) -> Column:
    return F.when(chapter_number(name).isNotNull(), F.regexp_extract(name, _CHAPTER, 2))


def location(path: Column) -> Column:
    """``(place, volume, chapter)`` of a path with respect to the manuscript."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts)
    inside = (depth >= 2) & (F.get(parts, F.lit(0)) == TOP) & (F.get(parts, F.lit(1)) == MANUSCRIPT)
    volume = volume_number(F.get(parts, F.lit(2)))
    chapter = chapter_number(F.get(parts, F.lit(3)))
    place = (
        F.when(~inside, "outside")
        .when(depth == 2, "root")
        .when(volume.isNull(), "invalid")
        .when(depth == 3, "volume")
        .when((depth == 4) & chapter.isNotNull(), "chapter")
        .otherwise("invalid")
    )
    return F.struct(
        place.alias("place"),
        F.when(place.isin("volume", "chapter"), volume).alias("volume"),
        F.when(place == "chapter", chapter).alias("chapter"),
    )


def display_name(stored: Column) -> Column:
    """Stored name without a final ``.txt``."""
    return F.regexp_replace(stored, r"(?i)\.txt$", "")


def content_state(kind: Column, size: Column) -> Column:
    return F.when(kind == "folder", "notText").when(size == 0, "empty").otherwise("written")


def stored_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def parent_path(path: Column) -> Column:
    """Path of the parent folder, null at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/", -1)).cast("long")


def ancestor_paths(path: Column) -> Column:
    """Every proper folder prefix of a path, shallow first."""
    parts = F.split(path, "/", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))


def has_component(path: Column, *names: str) -> Column:
    wanted = F.array(*[F.lit(n) for n in names])
    return F.arrays_overlap(F.split(path, "/", -1), wanted)


def first_of(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that holds, null if none does."""
    (condition, code), *rest = rules
    return reduce(lambda acc, rule: acc.when(*rule), rest, F.when(condition, code))
