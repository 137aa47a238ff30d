"""Scalar statistical helpers applied to small result tables (one row per variable)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_sf_scalar(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for integer ``dof`` (closed form).

    even dof 2m: exp(-x/2) * sum_{i<m} (x/2)^i / i!
    odd dof:     erfc(sqrt(x/2)) + exp(-x/2) * sum_{i=1}^{(dof-1)/2} (x/2)^(i-1/2) / Gamma(i+1/2)
    """
    if x is None or dof is None or (isinstance(x, float) and math.isnan(x)) or dof < 1:
        return float("nan")
    if x <= 0:
        return 1.0
    y = x / 2.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= y / i
            total += term
        return math.exp(-y) * total if total < float("inf") else math.exp(-y + math.log(total))
    total = 0.0
    log_y = math.log(y)
    for i in range(1, (dof - 1) // 2 + 1):
        total += math.exp((i - 0.5) * log_y - y - math.lgamma(i + 0.5))
    return math.erfc(math.sqrt(y)) + total


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_scalar(float(a), int(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(x, dof)], dtype="float64")


def chi2_sf_col(x: Column, dof: Column) -> Column:
    return chi2_sf(x.cast("double"), dof.cast("int"))
