"""Content digests and derived identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F


def content_sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def uuid5(namespace: Column | str, name: Column) -> Column:
    """RFC 4122 version-5 identifier from a namespace id and a name."""
    space = F.lit(str(uuid.UUID(namespace))) if isinstance(namespace, str) else namespace
    raw = F.concat(F.unhex(F.replace(space, F.lit("-"), F.lit(""))), name.cast("binary"))
    digest = F.sha1(raw)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def is_canonical_uuid(value: Column) -> Column:
    return value.rlike(UUID_PATTERN)
