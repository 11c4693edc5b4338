"""Window statistics over a stream of counted sites (an extension: nothing here is needed for batch use)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k


def window_diversity(sites: DataFrame, window: int = 100_000) -> DataFrame:
    """chr, start, end, pop, n_variants, pi of tumbling windows, kept up to date as sites (chr, pos, pop, ac, an) arrive.

    Works on batch and streaming frames alike; the state is one row for each window and population.
    """
    start = F.floor(F.col("pos") / window) * window
    out = sites.where("an >= 2").groupBy("chr", start.alias("start"), "pop").agg(F.count(F.lit(1)).alias("n_variants"), F.sum(k.pi_site("ac", "an")).alias("pi_sum"))
    return out.select("chr", "start", (F.col("start") + window - 1).alias("end"), "pop", "n_variants", (F.col("pi_sum") / F.col("n_variants")).alias("pi"))
