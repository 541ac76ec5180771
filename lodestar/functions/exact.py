"""Numbers that have to agree with SQL to the last bit."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments above which the exponential is infinite.
LARGEST = math.log(1.7976931348623157e308)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded by its product with a power of ten, halves away from
    zero, as SQL's round does; F.round takes the shortest decimal instead, which
    differs at halves and where a double has fewer digits than are asked for."""
    scaled = x * F.lit(10.0**digits)
    near = F.when(F.abs(scaled) < 2.0**52, F.round(scaled, 0)).otherwise(scaled) / F.lit(10.0**digits)
    return F.when(F.abs(near) < float("inf"), near).otherwise(x)


def exponential(x: Column) -> Column:
    """The C library's exp (the JVM's differs in the last bit); null for null."""

    @F.pandas_udf("double")
    def exp(v: pd.Series) -> pd.Series:
        return pd.Series([math.inf if e > LARGEST else math.exp(e) for e in v.to_numpy(float).tolist()], dtype=float)

    return F.when(x.isNotNull(), exp(x))
