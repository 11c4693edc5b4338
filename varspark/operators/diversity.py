"""Diversity of one population: per region, per chromosome and in sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..plans.cohort import Cohort
from .divergence import between_sites, fst_columns
from .select import NO_FILTER, SiteFilter, annotated, counts, covering_windows, in_region

STATS = ["pi", "theta_w", "tajima_d", "fay_wu_h", "fay_wu_h_norm", "het_exp", "het_obs", "fis", "n_variants", "n_segregating", "n_polarized"]


def site_terms(sites: DataFrame) -> DataFrame:
    """Everything that sums need, computed once per site."""
    derived = k.derived_count(F.col("ac"), F.col("an"), F.col("ancestral"))
    diploids = F.floor(F.col("an") / 2)
    return sites.withColumns({
        "pi_": k.pi_site("ac", "an"),
        "he_": k.expected_het(F.col("ac") / F.col("an")),
        "ho_": F.when(diploids > 0, F.col("het") / diploids).otherwise(0.0),
        "seg_": ((F.col("ac") > 0) & (F.col("ac") < F.col("an"))).cast("long"),
        "pol_": derived.isNotNull().cast("long"),
        "th_": F.when(derived.isNotNull(), k.theta_h_site(derived, "an")).otherwise(0.0),
        "pp_": F.when(derived.isNotNull(), k.pi_site("ac", "an")).otherwise(0.0),
    })


def sums() -> list:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return [F.count(F.lit(1)).alias("n_variants"), *(total(c) for c in ("pi_", "he_", "ho_", "seg_", "pol_", "th_", "pp_")), F.min_by("an", F.struct("pos", "variant_id")).alias("n_")]


def finish(df: DataFrame, *keys: str) -> DataFrame:
    """Statistics from the sums; n_ is the number of alleles at the first site."""
    n, size, seg, pol = F.coalesce("n_", F.lit(0)), F.col("n_variants"), F.col("seg_"), F.col("pol_")
    a1, a2 = k.harmonic(n), k.harmonic(n, 2)
    per_site = lambda c: k.ratio(F.col(c), size)
    h = F.col("pp_") - F.col("th_")
    return df.select(
        *keys, per_site("pi_").alias("pi"), k.ratio(k.ratio(seg, a1), size).alias("theta_w"), k.tajima_d(F.col("pi_"), seg, n, a1, a2).alias("tajima_d"),
        k.ratio(h, pol).alias("fay_wu_h"), k.fay_wu_h_norm(h, pol, n, a1, a2).alias("fay_wu_h_norm"),
        per_site("he_").alias("het_exp"), per_site("ho_").alias("het_obs"), F.when(F.col("he_") > 0, 1 - F.col("ho_") / F.col("he_")).otherwise(0.0).alias("fis"),
        F.col("n_variants"), seg.alias("n_segregating"), pol.alias("n_polarized"),
    )


def diversity(cohort: Cohort, chr: str, start: int | None, end: int | None, pop: str, where: SiteFilter = NO_FILTER, samples: list | None = None, **conditions) -> DataFrame:
    """One row of diversity statistics of a region, zeros where it has no sites. Means are per site kept, not per base.

    conditions: consequence, pathway, gene.
    """
    sites = annotated(cohort, in_region(counts(cohort, pop, samples), chr, start, end), **conditions)
    return finish(site_terms(where.apply(sites)).agg(*sums()))


def pop_summary(cohort: Cohort, where: SiteFilter = NO_FILTER, **conditions) -> DataFrame:
    """The same statistics for every population and chromosome, in one pass."""
    sites = site_terms(where.apply(annotated(cohort, cohort.variant_pop, **conditions)))
    return finish(sites.groupBy("pop", "chr").agg(*sums()), "pop", "chr").withColumnsRenamed({"het_exp": "mean_he", "het_obs": "mean_ho", "fis": "mean_fis"})


def genome_scan(cohort: Cohort, pop: str, window: int = 100_000, step: int = 50_000, pop2: str | None = None, pop3: str | None = None, chr: str | None = None, where: SiteFilter = NO_FILTER, run_id: str = "run", **conditions) -> DataFrame:
    """Windows from the first site of each chromosome; without sites there is none.

    With pop2, fst, dxy and da are added, with pop3 also pbs. dxy and da are means over all sites of the window.
    A window is found by arithmetic from a site's position, so that no range join is needed, and terms
    are computed before a site is copied to its windows.
    """
    sites = annotated(cohort, in_region(counts(cohort, pop), chr), **conditions)
    first = sites.groupBy("chr").agg(F.min("pos").alias("first_"))
    sites = site_terms(where.apply(sites))
    extra = []
    if pop2:
        sites = between_sites(cohort, sites, pop2, pop3)
        extra = fst_columns(pop3 is not None)
    spread = sites.join(F.broadcast(first), "chr").withColumn("k_", F.explode(covering_windows(F.col("pos"), F.col("first_"), window, step)))
    total = spread.groupBy("chr", "first_", "k_").agg(*sums(), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in extra))
    # the number of alleles is that of the chromosome's first site that passes
    n = sites.groupBy("chr").agg(F.min_by("an", F.struct("pos", "variant_id")).alias("n_"))
    total = total.drop("n_").join(F.broadcast(n), "chr")
    start = F.col("first_") + F.col("k_") * step
    names = "_".join(x for x in (pop, pop2, pop3) if x)
    out = total.withColumns({"start": start, "end": start + window - 1})
    keys = ["chr", "start", "end"]
    base = finish(out, *keys)
    if pop2:
        valid = F.col("hd") > 0
        pi1, pi2 = F.col("pi_") / F.col("n_variants"), F.col("pi2_") / F.col("n_variants")
        dxy = F.when(valid, F.col("dx") / F.col("n_variants")).otherwise(0.0)
        more = [k.ratio(F.col("hn"), F.col("hd")).alias("fst"), k.ratio(F.col("wn"), F.col("wd")).alias("fst_wc"), dxy.alias("dxy"), F.when(valid, dxy - (pi1 + pi2) / 2).otherwise(0.0).alias("da")]
        if pop3:
            t = lambda x: k.branch_length(k.ratio(F.col(f"wn{x}"), F.col(f"wd{x}")))
            more.append(((t("") + t(13) - t(23)) / 2).alias("pbs"))
        base = base.join(out.select(*keys, *more), keys)
    return base.withColumns({"population": F.lit(pop), "run_id": F.lit(run_id), "window_id": F.concat(F.col("chr"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(f":{names}:{run_id}"))})
