"""Exact test of Hardy-Weinberg proportions with mid-p, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def midp(het: int, hom1: int, hom2: int) -> float:
    """P(rarer than seen) + P(seen) / 2, given the allele counts. 1 where nothing varies."""
    n, rare = het + hom1 + hom2, 2 * min(hom1, hom2) + het
    if n == 0 or rare == 0:
        return 1.0
    lf = math.lgamma
    ln = [-lf(h + 1) - lf((rare - h) // 2 + 1) - lf(n - h - (rare - h) // 2 + 1) + h * math.log(2) for h in range(rare % 2, rare + 1, 2)]
    p = np.exp(np.array(ln) - max(ln))
    p /= p.sum()
    seen = p[(het - rare % 2) // 2]
    return float(p[p < seen * (1 - 1e-9)].sum() + seen / 2)


@F.pandas_udf(T.DoubleType())
def hwe_midp(het: pd.Series, hom1: pd.Series, hom2: pd.Series) -> pd.Series:
    keys = pd.DataFrame({"a": het, "b": hom1, "c": hom2}).astype("int64")
    known = {k: midp(*k) for k in keys.drop_duplicates().itertuples(index=False, name=None)}
    return pd.Series([known[k] for k in keys.itertuples(index=False, name=None)], dtype="float64")
