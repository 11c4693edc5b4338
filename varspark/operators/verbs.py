"""Query verbs over the genomic tables and over saved results: lookup, neighbours, filter, converge, rank, compare, extract, peaks.

Saved results are long tables: scores(variant_id, chr, pos, stat, pop, value) and windows(chr, start, end, ...).
Every limit has a tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cohort import Cohort
from .select import in_region, named_gene


def lookup_gene(cohort: Cohort, name: str) -> DataFrame:
    """Variants of a gene (by symbol or id), with their consequence and the gene's pathways."""
    gene = named_gene(cohort, name)
    pathways = cohort.in_pathway.groupBy("gene").agg(F.concat_ws(",", F.sort_array(F.collect_set("pathway"))).alias("pathways"))
    found = gene.join(cohort.has_consequence, "gene").join(cohort.variant.select("v", "variant_id", "chr", "pos"), "v").join(pathways, "gene", "left")
    return found.select("gene", "symbol", "variant_id", "chr", "pos", "consequence", "impact", "pathways")


def lookup_pathway(cohort: Cohort, part: str) -> DataFrame:
    """Genes of the pathways whose name holds part, with their numbers of variants."""
    own = cohort.in_pathway.where(F.contains(F.col("pathway"), F.lit(part)))
    n = cohort.has_consequence.join(own.select("gene").distinct(), "gene", "left_semi").groupBy("gene").agg(F.countDistinct("v").alias("variant_count"))
    return own.join(cohort.gene, "gene").join(n, "gene", "left").select("pathway", "gene", "symbol", F.coalesce("variant_count", F.lit(0)).alias("variant_count"))


def lookup_variant(cohort: Cohort, variant_id: str) -> DataFrame:
    """A row for each gene of the variant (one without, if it has none)."""
    own = cohort.variant.where(F.col("variant_id") == variant_id)
    pathways = cohort.in_pathway.groupBy("gene").agg(F.concat_ws(",", F.sort_array(F.collect_set("pathway"))).alias("pathways"))
    return own.join(cohort.has_consequence, "v", "left").join(cohort.gene, "gene", "left").join(pathways, "gene", "left").select("variant_id", "chr", "pos", "variant_type", "ancestral", "gene", "symbol", "consequence", "impact", "pathways")


def lookup_region(cohort: Cohort, chr: str, start: int, end: int) -> DataFrame:
    """Genes of a region with variant counts and extent; variants without a gene are intergenic."""
    own = in_region(cohort.variant, chr, start, end).select("v", "pos").join(cohort.has_consequence.select("v", "gene"), "v", "left").join(cohort.gene, "gene", "left")
    return own.groupBy(F.coalesce("symbol", F.lit("intergenic")).alias("symbol")).agg(F.countDistinct("v").alias("variant_count"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def neighbors(edges: DataFrame, gene: str, hops: int = 1) -> DataFrame:
    """Genes reached from a gene over edges (gene, other end) in at most three hops by way of shared ends, and how many ways lead there.

    Genes on a way are distinct at one and two hops; at three, the last only differs from the first.
    """
    if hops not in (1, 2, 3):
        raise ValueError("hops is 1, 2 or 3")
    end = next(c for c in edges.columns if c != "gene")
    near = edges.select(F.col("gene").alias("next"), end)
    out = edges.where(F.col("gene") == gene).join(near, end).where(F.col("next") != gene).groupBy("next").agg(F.count(F.lit(1)).alias("ways"))
    for _ in range(1, hops):  # from the genes reached so far, never from all pairs
        step = out.select(F.col("next").alias("gene"), "ways").join(edges, "gene").join(near, end).where((F.col("next") != F.col("gene")) & (F.col("next") != gene))
        out = step.groupBy("next").agg(F.sum("ways").alias("ways"))
    return out.select(F.col("next").alias("gene"), F.col("ways").cast("long").alias("ways"))


def ld_neighbors(cohort: Cohort, pairs: DataFrame, gene: str) -> DataFrame:
    """Genes whose variants are linked (ld pairs, either direction) with those of a gene: largest r2."""
    name = cohort.has_consequence.join(cohort.variant.select("v", "variant_id"), "v").select("variant_id", "gene")
    both = pairs.select("variant1", "variant2", "r2").union(pairs.select("variant2", "variant1", "r2"))
    own = both.join(name.where(F.col("gene") == gene).select(F.col("variant_id").alias("variant1")), "variant1")
    return own.join(name, own["variant2"] == name["variant_id"]).where(F.col("gene") != gene).groupBy("gene").agg(F.max("r2").alias("max_r2"))


def filter_scores(cohort: Cohort, scores: DataFrame, stat: str, pop: str, chr: str | None = None, consequence: str | None = None, pathway: str | None = None, gene: str | None = None, min_score: float | None = None, max_score: float | None = None, limit: int | None = None) -> DataFrame:
    """Saved scores by size (absolute), consequence, pathway name and gene; strongest first."""
    out = in_region(scores.where((F.col("stat") == stat) & (F.col("pop") == pop)), chr)
    if min_score is not None:
        out = out.where(F.abs("value") >= min_score)
    if max_score is not None:
        out = out.where(F.abs("value") <= max_score)
    edges = cohort.has_consequence
    if consequence is not None:
        edges = edges.where(F.col("consequence") == consequence)
    if pathway is not None:
        edges = edges.join(cohort.in_pathway.where(F.contains(F.col("pathway"), F.lit(pathway))), "gene", "left_semi")
    if gene is not None:
        edges = edges.join(named_gene(cohort, gene), "gene", "left_semi")
    if edges is not cohort.has_consequence:
        out = out.join(cohort.variant.join(edges, "v", "left_semi").select("variant_id"), "variant_id", "left_semi")
    out = out.select("variant_id", "chr", "pos", "value")
    return out.orderBy(F.abs("value").desc(), "variant_id").limit(limit) if limit else out


def converge(scores: DataFrame, thresholds: dict[tuple[str, str], float]) -> DataFrame:
    """Variants on which all of the (stat, pop) scores reach their thresholds in absolute value, with the scores side by side."""
    keys = list(thresholds)
    wanted = scores.where(F.struct("stat", "pop").isin([F.struct(F.lit(s).alias("stat"), F.lit(p).alias("pop")) for s, p in keys]))
    wide = wanted.groupBy("variant_id", "chr", "pos").agg(*(F.max(F.when((F.col("stat") == s) & (F.col("pop") == p), F.col("value"))).alias(f"{s}_{p}") for s, p in keys))
    for (s, p), least in thresholds.items():
        wide = wide.where(F.abs(f"{s}_{p}") >= least)
    return wide


def converge_windows(windows: DataFrame, at_least: dict[str, float], at_most: dict[str, float] | None = None) -> DataFrame:
    """Windows in which all columns reach their bounds."""
    for c, x in at_least.items():
        windows = windows.where(F.col(c) >= x)
    for c, x in (at_most or {}).items():
        windows = windows.where(F.col(c) <= x)
    return windows


def rank_genes(cohort: Cohort, scores: DataFrame, stats: list[str], pop: str) -> DataFrame:
    """Genes by the sum of scaled dense ranks of their largest absolute scores and number of HIGH variants."""
    named = cohort.has_consequence.join(cohort.variant.select("v", "variant_id"), "v")
    own = scores.where((F.col("pop") == pop) & F.col("stat").isin(stats))
    best = named.join(own, "variant_id").groupBy("gene").agg(*(F.coalesce(F.max(F.when(F.col("stat") == s, F.abs("value"))), F.lit(0.0)).alias(f"max_{s}") for s in stats))
    high = named.groupBy("gene").agg(F.count_if(F.col("impact") == "HIGH").alias("n_high"), F.countDistinct("v").alias("n_variants"))
    out = high.join(best, "gene", "left").fillna(0.0, [f"max_{s}" for s in stats])
    composite = F.lit(0.0)
    for c in [*(f"max_{s}" for s in stats), "n_high"]:
        # ranks of one row per gene: there are some ten thousands at most
        rank = F.dense_rank().over(Window.orderBy(c)) - 1
        out = out.withColumn("_r", rank)
        top = F.max("_r").over(Window.partitionBy())
        out = out.withColumn("_s", F.when(top > 0, F.col("_r") / F.nullif(top, F.lit(0))).otherwise(0.0))
        composite = composite + F.col(f"_s_{c}")
        out = out.withColumnRenamed("_s", f"_s_{c}").drop("_r")
    return out.withColumn("composite", composite).select("gene", "n_variants", "n_high", *(f"max_{s}" for s in stats), "composite")


def compare(left: DataFrame, right: DataFrame, stat: str) -> DataFrame:
    """Differences of a column of two window tables in the same places."""
    other = right.select("chr", "start", "end", F.col(stat).alias("other"))
    out = left.select("chr", "start", "end", F.col(stat).alias("value")).join(other, ["chr", "start", "end"])
    return out.withColumn("delta", F.col("value") - F.col("other")).withColumn("abs_delta", F.abs("delta"))


def compare_variants(scores: DataFrame, stat: str, pop1: str, pop2: str) -> DataFrame:
    """Differences of a saved score between two populations."""
    side = lambda p, name: scores.where((F.col("stat") == stat) & (F.col("pop") == p)).select("variant_id", F.col("value").alias(name))
    out = side(pop1, "value").join(side(pop2, "other"), "variant_id")
    return out.withColumn("delta", F.col("value") - F.col("other")).withColumn("abs_delta", F.abs("delta"))


def extract_variants(cohort: Cohort, pop: str, chr: str | None = None, start: int | None = None, end: int | None = None, min_af: float | None = None, max_af: float | None = None, consequence: str | None = None) -> DataFrame:
    out = in_region(cohort.variant_pop.where(F.col("pop") == pop), chr, start, end).withColumn("af", F.col("ac") / F.col("an"))
    if min_af is not None:
        out = out.where(F.col("af") >= min_af)
    if max_af is not None:
        out = out.where(F.col("af") <= max_af)
    if consequence is not None:
        out = out.join(cohort.has_consequence.where(F.col("consequence") == consequence), "v", "left_semi")
    return out.select("variant_id", "chr", "pos", "variant_type", "ac", "an", "af")


def extract_samples(cohort: Cohort, pop: str | None = None) -> DataFrame:
    out = cohort.sample.join(cohort.population, "pop")
    return (out if pop is None else out.where(F.col("pop") == pop)).select("sample", "pop", "n_samples")


def extract_genotypes(cohort: Cohort, chr: str, start: int, end: int, pop: str) -> DataFrame:
    """Dosage and phased text of every variant and sample, absent genotypes as 0|0."""
    sites = in_region(cohort.variant, chr, start, end).select("v", "variant_id")
    samples = cohort.sample.where(F.col("pop") == pop).select("sample")
    every = sites.join(F.broadcast(samples))  # all genotypes asked for
    text = F.when(F.col("gt") == 2, "1|1").when(F.col("gt") == 1, F.when(F.col("phase") == 0, "1|0").otherwise("0|1")).otherwise("0|0")
    return every.join(cohort.genotype, ["v", "sample"], "left").select("variant_id", "sample", F.coalesce("gt", F.lit(0)).alias("dosage"), text.alias("genotype"))


def inventory(cohort: Cohort) -> DataFrame:
    """Number of rows of every table."""
    one = lambda name, df: df.agg(F.lit(name).alias("label"), F.count(F.lit(1)).alias("n"))
    parts = [one(n, getattr(cohort, n)) for n in ("variant", "sample", "population", "genotype", "gene", "has_consequence", "in_pathway", "has_go_term")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def validate(cohort: Cohort) -> DataFrame:
    """check, n: rows that break a rule of the tables (0 everywhere is sound)."""
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    parts = [
        one("repeated variant", cohort.variant.groupBy("variant_id").count().where("count > 1")),
        one("genotype without variant", cohort.genotype.join(cohort.variant, "v", "left_anti")),
        one("genotype without sample", cohort.genotype.join(cohort.sample, "sample", "left_anti")),
        one("consequence without gene", cohort.has_consequence.join(cohort.gene, "gene", "left_anti")),
        one("impossible count", cohort.variant_pop.where("ac > an OR het + 2 * hom <> ac")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def call_peaks(points: DataFrame, score: str, merge_distance: int = 100_000) -> DataFrame:
    """Intervals (chr, start, end) at most merge_distance apart merged: n, mean absolute and largest score, start of the strongest."""
    order = Window.partitionBy("chr").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - before > merge_distance).cast("int"), F.lit(1))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = points.withColumn("_new", new).withColumn("_island", island)
    return out.groupBy("chr", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(score)).alias("mean_score"), F.max(F.abs(score)).alias("max_score"),
        F.max_by("start", F.struct(F.abs(score), -F.col("start"))).alias("peak"),
    ).drop("_island")


def top_k(df: DataFrame, column: str, k: int, *ties: str, by: list[str] | None = None) -> DataFrame:
    """The k largest rows, of each group if by is given."""
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(column).desc(), *ties))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    return df.orderBy(F.col(column).desc(), *ties).limit(k)
