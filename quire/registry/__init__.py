"""Registered queries over the shared tables, each beside its SQL."""

from __future__ import annotations

from quire.registry.core import oracles, queries  # noqa: F401
from quire.registry import (  # noqa: F401  (each module registers its queries)
    aggregates,
    corpus,
    evidence,
    hierarchy,
    jobs,
    ledgers,
    manuscripts,
    names,
    relational,
    roundtrips,
    streams,
    windows,
)
