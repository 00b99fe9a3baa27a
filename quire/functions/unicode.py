"""Unicode normalization, the one place where rows pass through Python.

Spark has no normalization function. ASCII text is its own normal form, so
only other rows carry a value into the Arrow batch; the rest travel as nulls.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _fold_nfkc(values: pd.Series) -> pd.Series:
    """NFKC, full case folding, NFKC again."""

    def fold(v: str | None) -> str | None:
        if v is None:
            return None
        return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", v).casefold())

    return values.map(fold)


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def _guarded(udf, text: Column) -> Column:
    return F.coalesce(udf(F.when(_beyond_ascii(text), text)), text)


def nfc(text: Column) -> Column:
    return _guarded(_nfc, text)


def nfkc(text: Column) -> Column:
    return _guarded(_nfkc, text)


def fold_nfkc(text: Column) -> Column:
    return F.coalesce(_fold_nfkc(F.when(_beyond_ascii(text), text)), F.lower(text))


def collision_key(name: Column) -> Column:
    """Key under which two sibling names clash: NFC, case ignored."""
    return F.lower(nfc(name))
