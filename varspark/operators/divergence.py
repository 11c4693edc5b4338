"""Differentiation between populations, and frequency spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..plans.cohort import Cohort
from .select import NO_FILTER, SiteFilter, annotated, counts, in_region


def _other(cohort: Cohort, pop: str, i: int, samples: list | None = None) -> DataFrame:
    return counts(cohort, pop, samples).select("v", *(F.col(c).alias(f"{c}{i}") for c in ("ac", "an", "het")))


def between_sites(cohort: Cohort, sites: DataFrame, pop2: str, pop3: str | None = None, samples2: list | None = None) -> DataFrame:
    """Adds terms of pop (ac, an, het) against pop2, and of pop3 against both; null where a population has fewer than two alleles."""
    out = sites.join(_other(cohort, pop2, 2, samples2), "v", "left")
    ok = F.col("an2") >= 2
    if pop3:
        out = out.join(_other(cohort, pop3, 3), "v", "left")
        ok = ok & (F.col("an3") >= 2)
    out = k.with_pair_terms(out, "", "2", "", ok).withColumns({"pi2_": F.when(ok, k.pi_site("ac2", "an2")), "both_": F.when(ok, 1)})
    if pop3:
        out = k.with_pair_terms(k.with_pair_terms(out, "", "3", "13", ok), "2", "3", "23", ok)
    return out


def fst_columns(three: bool) -> list[str]:
    return ["hn", "hd", "wn", "wd", "dx", "pi2_", "both_"] + ["wn13", "wd13", "wn23", "wd23"] * three


def divergence(cohort: Cohort, chr: str, start: int | None, end: int | None, pop1: str, pop2: str, pop3: str | None = None, where: SiteFilter = NO_FILTER, samples1: list | None = None, samples2: list | None = None, **conditions) -> DataFrame:
    """One row: Fst (Hudson; Weir-Cockerham), dxy, da, pbs (0 without pop3). Filters look at pop1; Fst are ratios of sums."""
    sites = where.apply(annotated(cohort, in_region(counts(cohort, pop1, samples1), chr, start, end), **conditions))
    terms = between_sites(cohort, sites.withColumn("pi_", k.pi_site("ac", "an")), pop2, pop3, samples2).where("both_ = 1")
    total = terms.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ["pi_", *fst_columns(pop3 is not None)]))
    n = F.col("both_")
    dxy, fst_wc = k.ratio(F.col("dx"), n), k.ratio(F.col("wn"), F.col("wd"))
    t = lambda x: k.branch_length(k.ratio(F.col(f"wn{x}"), F.col(f"wd{x}")))
    pbs = (t("") + t(13) - t(23)) / 2 if pop3 else F.lit(0.0)
    return total.select(
        k.ratio(F.col("hn"), F.col("hd")).alias("fst_hudson"), fst_wc.alias("fst_wc"), dxy.alias("dxy"),
        (dxy - (k.ratio(F.col("pi_"), n) + k.ratio(F.col("pi2_"), n)) / 2).alias("da"), pbs.alias("pbs"), n.cast("long").alias("n_variants"),
    )


def fst_matrix(cohort: Cohort, where: SiteFilter = NO_FILTER, by: tuple[str, ...] = (), **conditions) -> DataFrame:
    """Fst, dxy and da of all pairs of populations, in one pass over the sites (their pairs are as many at every site)."""
    sites = where.apply(annotated(cohort, cohort.variant_pop, **conditions))
    right = sites.select("v", F.col("pop").alias("pop2"), *(F.col(c).alias(f"{c}2") for c in ("ac", "an", "het")))
    pairs = sites.withColumnRenamed("pop", "pop1").join(right, "v").where("pop1 < pop2")
    pairs = k.with_pair_terms(pairs)
    return pairs.groupBy(*by, "pop1", "pop2").agg(
        k.ratio(F.sum("hn"), F.sum("hd")).alias("fst_hudson"), k.ratio(F.sum("wn"), F.sum("wd")).alias("fst_wc"), F.avg("dx").alias("dxy"),
        (F.avg("dx") - F.avg(k.pi_site("ac", "an") + k.pi_site("ac2", "an2")) / 2).alias("da"), F.count(F.lit(1)).alias("n_variants"),
    )


def sfs(cohort: Cohort, chr: str, start: int | None, end: int | None, pop: str, folded: bool = False, where: SiteFilter = NO_FILTER, samples: list | None = None, **conditions) -> DataFrame:
    """bin, n: a row for every possible count. Unfolded counts are of the derived allele, or of ALT where that isn't known."""
    sites = where.apply(annotated(cohort, in_region(counts(cohort, pop, samples), chr, start, end), **conditions))
    ac, an = F.col("ac"), F.col("an")
    value = F.least(ac, an - ac) if folded else F.coalesce(k.derived_count(ac, an, F.col("ancestral")), ac).cast("int")
    return _spectrum(sites.select(value.alias("bin"), "an"), folded)


def sfs_facts(cohort: Cohort, chr: str | None, start: int | None, end: int | None, pop: str, folded: bool = False, where: SiteFilter = NO_FILTER, samples: list | None = None, **conditions) -> DataFrame:
    """n_variants, max_ac (the largest number of alleles) and n_polarized (0 if folded) of the sites of a spectrum; a row always."""
    sites = where.apply(annotated(cohort, in_region(counts(cohort, pop, samples), chr, start, end), **conditions))
    polarized = F.lit(0).cast("long") if folded else F.count("ancestral")
    return sites.agg(F.count(F.lit(1)).alias("n_variants"), F.coalesce(F.max("an"), F.lit(0)).alias("max_ac"), polarized.alias("n_polarized"))


def joint_sfs_facts(cohort: Cohort, chr: str | None, start: int | None, end: int | None, pop1: str, pop2: str, folded: bool = False, where: SiteFilter = NO_FILTER, **conditions) -> DataFrame:
    """n_variants, max_ac1, max_ac2 and the dimensions dim1, dim2 of a joint spectrum."""
    sites = where.apply(annotated(cohort, in_region(counts(cohort, pop1), chr, start, end), **conditions))
    both = sites.join(_other(cohort, pop2, 2), "v").where("an2 >= 2")
    out = both.agg(F.count(F.lit(1)).alias("n_variants"), F.coalesce(F.max("an"), F.lit(0)).alias("max_ac1"), F.coalesce(F.max("an2"), F.lit(0)).alias("max_ac2"))
    size = lambda c: (F.floor(F.col(c) / 2) if folded else F.col(c)).cast("int") + 1
    return out.select("*", size("max_ac1").alias("dim1"), size("max_ac2").alias("dim2"))


def _spectrum(sites: DataFrame, folded: bool) -> DataFrame:
    top = sites.agg(F.max("an").alias("top"))
    bins = top.where("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0), (F.floor(F.col("top") / 2) if folded else F.col("top")).cast("int"))).alias("bin"))
    return bins.join(sites.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def joint_sfs(cohort: Cohort, chr: str, start: int | None, end: int | None, pop1: str, pop2: str, folded: bool = False, where: SiteFilter = NO_FILTER, **conditions) -> DataFrame:
    """bin1, bin2, n of the counts that occur; never polarised. Filters look at pop1."""
    sites = where.apply(annotated(cohort, in_region(counts(cohort, pop1), chr, start, end), **conditions))
    both = sites.join(_other(cohort, pop2, 2), "v").where("an2 >= 2")
    value = lambda i: F.least(F.col(f"ac{i}"), F.col(f"an{i}") - F.col(f"ac{i}")) if folded else F.col(f"ac{i}")
    return both.groupBy(value("").alias("bin1"), value(2).alias("bin2")).agg(F.count(F.lit(1)).alias("n"))


def sfs_all(cohort: Cohort, where: SiteFilter = NO_FILTER) -> DataFrame:
    """Unfolded spectra of all populations: pop, bin, n of the counts that occur, polarised sites only."""
    sites = where.apply(cohort.variant_pop).withColumn("bin", k.derived_count(F.col("ac"), F.col("an"), F.col("ancestral")).cast("int"))
    return sites.where("bin IS NOT NULL").groupBy("pop", "bin").agg(F.count(F.lit(1)).alias("n"))
