"""Which sites and which samples a statistic is computed from: regions, annotations, subsets, site filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hwe import hwe_midp
from ..plans.cohort import Cohort, count_alleles


@dataclass(frozen=True)
class SiteFilter:
    """Site filters on the focal population; None is no filter. hwe_pvalue rejects sites below it."""

    min_af: float | None = None
    max_af: float | None = None
    min_call_rate: float | None = None
    hwe_pvalue: float | None = None
    variant_type: str | None = None

    def apply(self, sites: DataFrame, by: tuple[str, ...] = ("chr", "pop")) -> DataFrame:
        """Sites with two alleles or more that pass. The call rate is relative to the first site (by pos, id) that passes on frequency."""
        af = F.col("ac") / F.col("an")
        out = sites.where("an >= 2")
        if self.min_af is not None:
            out = out.where(af >= self.min_af)
        if self.max_af is not None:
            out = out.where(af <= self.max_af)
        if self.min_call_rate is not None:
            full = out.groupBy(*by).agg(F.min_by("an", F.struct("pos", "variant_id")).alias("_full"))  # a row for each chromosome and population
            out = out.join(full, list(by)).where(F.col("an") / F.col("_full") >= self.min_call_rate).drop("_full")
        if self.hwe_pvalue is not None:
            out = out.where(hwe_midp(F.col("het"), F.col("hom"), F.floor(F.col("an") / 2).cast("int") - F.col("het") - F.col("hom")) >= self.hwe_pvalue)
        if self.variant_type is not None:
            out = out.where(F.col("variant_type") == self.variant_type)
        return out


NO_FILTER = SiteFilter()


def in_region(df: DataFrame, chr: str | None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows on a chromosome, positions inclusive at both ends; None leaves a side open."""
    if chr is not None:
        df = df.where(F.col("chr") == chr)
    if start is not None:
        df = df.where(F.col("pos") >= start)
    if end is not None:
        df = df.where(F.col("pos") <= end)
    return df


def annotated(cohort: Cohort, sites: DataFrame, consequence: str | None = None, pathway: str | None = None, gene: str | None = None) -> DataFrame:
    """Sites with an annotation that meets all conditions at once (the same edge has the consequence and leads to the gene)."""
    if consequence is None and pathway is None and gene is None:
        return sites
    edges = cohort.has_consequence
    if consequence is not None:
        edges = edges.where(F.col("consequence") == consequence)
    if pathway is not None:
        edges = edges.join(cohort.in_pathway.where(F.col("pathway") == pathway), "gene", "left_semi")
    if gene is not None:
        edges = edges.join(named_gene(cohort, gene), "gene", "left_semi")
    return sites.join(edges.select("v"), "v", "left_semi")


def named_gene(cohort: Cohort, name: str) -> DataFrame:
    """Genes with that symbol or identifier."""
    return cohort.gene.where((F.col("symbol") == name) | (F.col("gene") == name))


def counts(cohort: Cohort, pop: str, samples: list | None = None) -> DataFrame:
    """Allele counts of a population, or of a list of samples under the population's name (unknown ones are ignored)."""
    if samples is None:
        require_population(cohort, pop)
        return cohort.variant_pop.where(F.col("pop") == pop)
    own = cohort.sample.where(F.col("sample").isin(list(samples))).withColumn("pop", F.lit(pop))
    return count_alleles(cohort.variant, cohort.genotype.join(own.select("sample"), "sample", "left_semi"), own)


def require_population(cohort: Cohort, *pops: str) -> None:
    """An error for a population that the cohort doesn't have."""
    if "pops" not in cohort._kept:
        cohort._kept["pops"] = {r["pop"] for r in cohort.population.select("pop").collect()}  # as many rows as there are populations
    for pop in pops:
        if pop not in cohort._kept["pops"]:
            raise ValueError(f"unknown population {pop!r}; there are {sorted(cohort._kept['pops'])}")


def covering_windows(pos: Column, first: Column, window: int, step: int) -> Column:
    """Numbers k of the windows [first + k * step, first + k * step + window - 1] that hold pos."""
    low = F.greatest(F.lit(0), F.ceil((pos - window + 1 - first) / step))
    return F.sequence(low, F.floor((pos - first) / step))
