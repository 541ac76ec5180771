"""Label and header normalisation, and forgiving conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The token for a rejected or missing label, and the columns that
#: may hold labels, in order of preference.
UNKNOWN = "unknown"
LABEL_CANDIDATES = ("label", "type", "attack", "attack_type", "class", "category")


def normalized(label: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one `_`, none at
    the ends; null or nothing left is `unknown`."""
    kept = F.regexp_replace(F.lower(F.trim(label.cast("string"))), "[^0-9a-z]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit(UNKNOWN))


def prepared(label: Column) -> Column:
    """The preparer's milder form: lower case, blanks and hyphens as `_`."""
    return F.translate(F.lower(F.trim(label.cast("string"))), " -", "__")


def clean_header(name: str) -> str:
    """A column name without byte-order mark and outer white space."""
    return name.replace("﻿", "").strip()


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*map(clean_header, df.columns))


def label_column(columns: list[str], candidates: tuple[str, ...] = LABEL_CANDIDATES) -> str:
    """The first candidate that a column matches without regard to case."""
    known = {c.casefold(): c for c in reversed(columns)}
    for c in candidates:
        if c.casefold() in known:
            return known[c.casefold()]
    raise KeyError(f"none of {candidates} among the columns")


def number(x: Column) -> Column:
    """Double, null where the text is no number."""
    return x.try_cast("double")


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean, 0 where the sum is not positive."""
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)
