"""Analyses over counts, annotations and saved results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..plans.cohort import Cohort


def _pair_sites(cohort: Cohort, pop1: str, pop2: str) -> DataFrame:
    side = lambda p, i: cohort.variant_pop.where(F.col("pop") == p).select("v", *(F.col(c).alias(f"{c}{i}") for c in ("ac", "an", "het")))
    return side(pop1, 1).join(side(pop2, 2), "v")


def gene_fst(cohort: Cohort, pop1: str, pop2: str, least: int = 5) -> DataFrame:
    """Hudson's Fst of genes with enough variants, never below 0."""
    own = cohort.has_consequence.select("v", "gene").join(k.with_pair_terms(_pair_sites(cohort, pop1, pop2), "1", "2"), "v")
    return own.groupBy("gene").agg(F.greatest(F.lit(0.0), k.ratio(F.sum("hn"), F.sum("hd"))).alias("fst"), F.count(F.lit(1)).alias("n_variants")).where(F.col("n_variants") >= least)


def pathway_fst(cohort: Cohort, pop1: str, pop2: str, least: int = 5, diploid: bool = False) -> DataFrame:
    """Fst of pathways over their distinct variants. diploid: sample sizes count individuals, not alleles."""
    sites = _pair_sites(cohort, pop1, pop2)
    if diploid:
        p1, p2, n1, n2 = F.col("ac1") / F.col("an1"), F.col("ac2") / F.col("an2"), F.col("an1") / 2, F.col("an2") / 2
        num = (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1)
        sites = sites.where("an1 >= 10 AND an2 >= 10").select("v", num.alias("hn"), (p1 * (1 - p2) + p2 * (1 - p1)).alias("hd"))
    else:
        sites = k.with_pair_terms(sites, "1", "2").select("v", "hn", "hd")
    own = cohort.in_pathway.join(cohort.has_consequence, "gene").select("pathway", "v").distinct().join(sites, "v")
    return own.groupBy("pathway").agg(F.greatest(F.lit(0.0), k.ratio(F.sum("hn"), F.sum("hd"))).alias("fst"), F.count(F.lit(1)).alias("n_variants")).where(F.col("n_variants") >= least)


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided exact test of a 2 x 2 table: P(a or more) with fixed margins."""
    lf = math.lgamma
    ln = lambda n, r: lf(n + 1) - lf(r + 1) - lf(n - r + 1)
    row, col, n = a + b, a + c, a + b + c + d
    return min(1.0, sum(math.exp(ln(col, x) + ln(n - col, row - x) - ln(n, row)) for x in range(a, min(row, col) + 1)))


def enrichment(terms: DataFrame, genes: DataFrame, universe: DataFrame, least: int = 5) -> DataFrame:
    """Terms (columns term, gene) with at least ``least`` genes, tested for the genes given, with Benjamini-Hochberg q values."""
    total = universe.select("gene").distinct()
    chosen = genes.select("gene").distinct().join(total, "gene", "left_semi")
    marked = terms.distinct().join(total, "gene", "left_semi").join(chosen.withColumn("hit", F.lit(1)), "gene", "left")
    counts = marked.groupBy("term").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("hit"), F.lit(0)).alias("a")).where(F.col("size") >= least)
    n, m = total.count(), chosen.count()

    @F.pandas_udf("double")
    def test(size: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([fisher_greater(int(x), m - int(x), int(s) - int(x), n - m - int(s) + int(x)) for s, x in zip(size, a, strict=True)])

    tested = counts.withColumn("p", test("size", "a"))
    # one row for each term
    rank = F.row_number().over(Window.orderBy("p", "term"))
    scaled = tested.withColumn("rank", rank).withColumn("x", F.col("p") * F.count(F.lit(1)).over(Window.partitionBy()) / F.col("rank"))
    q = F.least(F.lit(1.0), F.min("x").over(Window.orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    return scaled.select("term", F.col("size").cast("long").alias("n_genes"), F.col("a").cast("long").alias("n_hits"), "p", q.alias("q"))


def outlier_windows(windows: DataFrame, column: str, percentile: float = 0.99, by: str = "population") -> DataFrame:
    """Windows at or above the percentile (linear) of their group."""
    cut = windows.groupBy(by).agg(F.expr(f"percentile({column}, {percentile})").alias("cut"))
    return windows.join(F.broadcast(cut), by).where(F.col(column) >= F.col("cut"))


def overlap(points: DataFrame, intervals: DataFrame, bin_size: int) -> DataFrame:
    """Points (chr, pos) in intervals (chr, start, end): an equi-join on bins that intervals are spread over."""
    spread = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    both = points.withColumn("_bin", F.floor(F.col("pos") / bin_size)).join(spread, ["chr", "_bin"])
    return both.where(F.col("pos").between(F.col("start"), F.col("end"))).drop("_bin")


def window_genes(cohort: Cohort, windows: DataFrame, column: str, bin_size: int = 100_000) -> DataFrame:
    """Genes with variants in the windows: largest value and number of windows."""
    points = cohort.has_consequence.select("v", "gene").join(cohort.variant.select("v", "chr", "pos"), "v")
    hit = overlap(points, windows.select("chr", "start", "end", column), bin_size).select("gene", "chr", "start", column).distinct()
    return hit.groupBy("gene").agg(F.max(column).alias(f"max_{column}"), F.count(F.lit(1)).alias("n_windows"))


def daf_enrichment(cohort: Cohort, peaks: DataFrame, pop: str, bin_size: int = 100_000) -> DataFrame:
    """Mean derived allele frequency in peaks against elsewhere."""
    derived = k.derived_count(F.col("ac"), F.col("an"), F.col("ancestral"))
    sites = cohort.variant_pop.where((F.col("pop") == pop) & (F.col("an") >= 10)).select("v", "chr", "pos", (derived / F.col("an")).alias("daf")).where("daf IS NOT NULL")
    inside = overlap(sites.select("v", "chr", "pos"), peaks.select("chr", "start", "end"), bin_size).select("v").distinct().withColumn("inside", F.lit(True))
    marked = sites.join(inside, "v", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    mean = lambda flag: F.avg(F.when(F.col("inside") == flag, F.col("daf")))
    return marked.agg(mean(True).alias("peak_mean"), mean(False).alias("background_mean"), F.count_if("inside").alias("n_peak"), F.count_if(~F.col("inside")).alias("n_background")).withColumn("ratio", k.ratio(F.col("peak_mean"), F.col("background_mean")))


def private_rare(cohort: Cohort, max_ac: int = 4, max_af: float = 0.1) -> DataFrame:
    """Per population, rare variants that no other population has."""
    total = cohort.variant_pop.groupBy("v").agg(F.sum("ac").alias("total"))
    own = cohort.variant_pop.where((F.col("an") >= 10) & (F.col("ac") > 0) & (F.col("ac") <= max_ac) & (F.col("ac") / F.col("an") < max_af)).join(total, "v")
    return own.groupBy("pop").agg(F.count_if(F.col("total") == F.col("ac")).alias("n_private"), F.count(F.lit(1)).alias("n_rare"))


def pin_pis(cohort: Cohort) -> DataFrame:
    """Diversity of missense over synonymous variants by population and chromosome."""
    kind = cohort.has_consequence.where(F.col("consequence").isin("missense_variant", "synonymous_variant")).select("v", "consequence").distinct()
    sites = cohort.variant_pop.where("an >= 2").join(kind, "v").withColumn("pi", k.pi_site("ac", "an"))
    mean = lambda c: F.avg(F.when(F.col("consequence") == c, F.col("pi")))
    out = sites.groupBy("pop", "chr").agg(mean("missense_variant").alias("pi_n"), mean("synonymous_variant").alias("pi_s"))
    return out.withColumn("pin_pis", k.ratio(F.col("pi_n"), F.col("pi_s")))


def consequence_bias(cohort: Cohort, pop1: str, pop2: str) -> DataFrame:
    """Fst by impact of the variants, and U of the Mann-Whitney test of site Fst against all other impacts (ties share ranks)."""
    site = k.with_pair_terms(_pair_sites(cohort, pop1, pop2), "1", "2").select("v", "hn", "hd", F.round(k.ratio(F.col("hn"), F.col("hd")), 9).alias("fst"))
    own = cohort.has_consequence.select("v", "impact").distinct().join(site, "v")
    ranks = own.groupBy("fst").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("fst").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # distinct values
    ranked = own.join(ranks.select("fst", (before + (F.col("n") + 1) / 2).alias("rank")), "fst")
    out = ranked.groupBy("impact").agg(k.ratio(F.sum("hn"), F.sum("hd")).alias("fst"), F.avg("fst").alias("mean_site_fst"), F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"))
    return out.select("impact", "fst", "mean_site_fst", "n", (F.col("r") - F.col("n") * (F.col("n") + 1) / 2).alias("u"))


def spearman(df: DataFrame, x: str, y: str) -> Column | DataFrame:
    """Rank correlation with shared ranks for ties, over the distinct values of either column."""
    def ranks(c: str) -> DataFrame:
        n = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return n.select(c, (before + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    return df.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"rank_{x}", f"rank_{y}").alias("rho"), F.count(F.lit(1)).alias("n"))


def individual_burden(cohort: Cohort, max_af: float = 0.1) -> DataFrame:
    """Per sample: share of heterozygous sites, copies of rare alleles, and carried rare missense variants; SNPs only."""
    snps = cohort.variant.where(F.col("variant_type") == "SNP").select("v")
    n = snps.count()
    af = cohort.variant_pop.groupBy("v").agg((F.sum("ac") / F.sum("an")).alias("af"))
    missense = cohort.has_consequence.where(F.col("consequence") == "missense_variant").select("v").distinct().withColumn("missense", F.lit(1))
    g = cohort.genotype.join(snps, "v").join(af, "v").join(missense, "v", "left")
    rare = F.col("af") < max_af
    agg = g.groupBy("sample").agg((F.count_if(F.col("gt") == 1) / n).alias("het_rate"), F.coalesce(F.sum(F.when(rare, F.col("gt"))), F.lit(0)).cast("long").alias("rare_alleles"), F.count_if(rare & (F.col("missense") == 1)).alias("rare_missense"))
    return cohort.sample.join(agg, "sample", "left").fillna(0)


def centroid_outliers(features: DataFrame, columns: list[str], by: str = "pop") -> DataFrame:
    """Distance of each row to its group's mean in units of the group's deviation, and the z score of that distance."""
    w = Window.partitionBy(by)
    z2 = F.lit(0.0)
    for c in columns:
        sd = F.stddev_pop(c).over(w)
        z2 = z2 + F.when(sd > 0, F.pow((F.col(c) - F.avg(c).over(w)) / F.nullif(sd, F.lit(0.0)), F.lit(2.0))).otherwise(0.0)
    out = features.withColumn("distance", F.sqrt(z2))
    sd = F.stddev_pop("distance").over(w)
    return out.withColumn("z", F.when(sd > 0, (F.col("distance") - F.avg("distance").over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))


def sweep_type(windows: DataFrame, least: float = 0.05, hard: float = 0.05) -> DataFrame:
    """Windows with h12 above least: hard if h2/h1 is below hard, else soft."""
    return windows.where(F.col("h12") > least).withColumn("sweep_type", F.when(F.col("h2_h1") < hard, "hard").otherwise("soft"))


def convergent_sweeps(cohort: Cohort, windows: DataFrame, least_h12: float, least_groups: int = 2, bin_size: int = 100_000) -> DataFrame:
    """Genes in sweep windows of several populations: numbers of populations and the largest h12."""
    points = cohort.has_consequence.select("v", "gene").join(cohort.variant.select("v", "chr", "pos"), "v")
    own = windows.where(F.col("h12") >= least_h12).select("chr", "start", "end", "population", "h12")
    return overlap(points, own, bin_size).groupBy("gene").agg(F.countDistinct("population").alias("n_groups"), F.max("h12").alias("max_h12")).where(F.col("n_groups") >= least_groups)


def temporal_strata(windows: DataFrame, layers: dict[str, tuple[str, float]]) -> DataFrame:
    """Per population, the share of windows beyond each layer's bound (column, at most), its z score over populations, and the layer that stands out."""
    share = windows.groupBy("population").agg(*(F.avg((F.col(c) <= bound).cast("double")).alias(name) for name, (c, bound) in layers.items()))
    w = Window.partitionBy()
    for name in layers:
        sd = F.stddev_pop(name).over(w)
        share = share.withColumn(f"z_{name}", F.when(sd > 0, (F.col(name) - F.avg(name).over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))
    top = F.greatest(*(F.col(f"z_{n}") for n in layers)) if len(layers) > 1 else F.col(f"z_{next(iter(layers))}")
    layer = F.lit(None).cast("string")
    for name in reversed(layers):
        layer = F.when(F.col(f"z_{name}") == top, name).otherwise(layer)
    return share.withColumn("layer", layer)


def pathway_evidence(cohort: Cohort, fst: DataFrame, sweeps: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each pathway with an Fst or a gene in a convergent sweep; scores it lacks are 0.

    fst: pathway, fst. sweeps: gene, n_groups. terms: the enriched terms. n_convergent_genes, n_go_genes: swept genes of the
    pathway, and those of them with an enriched term; n_groups: the most populations that share a sweep in one of its genes.
    """
    enriched = cohort.has_go_term.join(terms.select(F.col("term").alias("go")), "go", "left_semi").select("gene").distinct().withColumn("hit", F.lit(1))
    swept = cohort.in_pathway.select("pathway", "gene").distinct().join(sweeps.select("gene", "n_groups"), "gene").join(enriched, "gene", "left")
    swept = swept.groupBy("pathway").agg(F.count(F.lit(1)).alias("n_convergent_genes"), F.count("hit").alias("n_go_genes"), F.max("n_groups").alias("n_groups"))
    return fst.select("pathway", "fst").join(swept, "pathway", "full").na.fill(0)


def synthesis(scores: DataFrame, lines: dict[str, float], key: str) -> DataFrame:
    """Evidence from several scores: ranks scaled to 0..1 (ties by key), their mean, lines of evidence (scores above their bound in lines) and a tier."""
    out, parts, n_lines = scores, [], F.lit(0)
    for c, bound in lines.items():
        rank = F.row_number().over(Window.orderBy(c, key)) - 1  # one row for each key
        out = out.withColumn(f"{c}_scaled", rank / F.greatest(F.lit(1), F.count(F.lit(1)).over(Window.partitionBy()) - 1))
        parts.append(F.col(f"{c}_scaled"))
        n_lines = n_lines + (F.col(c) > bound).cast("int")
    tier = F.when(F.col("n_lines") >= 3, "HIGH").when(F.col("n_lines") >= 2, "MEDIUM").otherwise("LOW")
    return out.withColumn("composite", sum(parts[1:], parts[0]) / len(parts)).withColumn("n_lines", n_lines).withColumn("tier", tier)


def sweep_extent(points: DataFrame, center: int, column: str, bin_size: int, half: float = 0.5) -> DataFrame:
    """How far a signal reaches from a centre: means by distance bin, cut at max(peak * half, mean + 2 deviations), walking outward."""
    bins = points.groupBy(F.floor((F.col("pos") - center) / bin_size).alias("bin")).agg(F.avg(column).alias("x"))
    facts = bins.agg(F.max("x").alias("peak"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).select("peak", F.greatest(F.col("peak") * half, F.col("m") + 2 * F.col("s")).alias("cut"))
    low = bins.join(F.broadcast(facts)).where("x < cut")
    ends = low.agg(F.max(F.when(F.col("bin") < 0, F.col("bin"))).alias("left"), F.min(F.when(F.col("bin") >= 0, F.col("bin"))).alias("right"))
    return ends.join(facts).select("peak", "cut", ((F.col("left") + 1) * bin_size + center).alias("start"), (F.col("right") * bin_size + center - 1).alias("end"))


def coselection(values: DataFrame, entity: str, dimension: str, column: str, least: float = 0.7) -> DataFrame:
    """Pairs of entities whose values over the dimensions have a rank correlation of at least ``least`` in absolute value."""
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy(entity).orderBy(column, dimension)).cast("double"))
    right = ranked.select(F.col(entity).alias("other"), dimension, F.col("r").alias("r2"))
    pairs = ranked.join(right, dimension).where(F.col(entity) < F.col("other"))
    return pairs.groupBy(entity, "other").agg(F.corr("r", "r2").alias("rho")).where(F.abs("rho") >= least)


def upgma(names: list[str], distance: np.ndarray) -> str:
    """Average-linkage tree of a small distance matrix, as Newick text with branch lengths."""
    nodes = [(n, 1, 0.0) for n in names]
    d = distance.astype(float).copy()
    while len(nodes) > 1:
        m = d + np.where(np.eye(len(d), dtype=bool), np.inf, 0)
        i, j = divmod(int(m.argmin()), len(d))
        i, j = min(i, j), max(i, j)
        height = d[i, j] / 2
        (a, na, ha), (b, nb, hb) = nodes[i], nodes[j]
        row = (d[i] * na + d[j] * nb) / (na + nb)
        d[i], d[:, i] = row, row
        d[i, i] = 0
        d = np.delete(np.delete(d, j, 0), j, 1)
        nodes[i] = (f"({a}:{height - ha:.6g},{b}:{height - hb:.6g})", na + nb, height)
        del nodes[j]
    return nodes[0][0] + ";"


def principal_components(rows: np.ndarray, k_: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Scores and shares of variance of a small table (populations x statistics), standardised."""
    x = (rows - rows.mean(0)) / np.where(rows.std(0) > 0, rows.std(0), 1)
    value, vector = np.linalg.eigh(np.cov(x, rowvar=False))
    order = np.argsort(value)[::-1][:k_]
    return x @ vector[:, order], value[order] / value.sum()


# ---------------------------------------------------------------- genes, annotations and individuals


def gene_extent(cohort: Cohort) -> DataFrame:
    """gene, chr, start, end: from the first to the last annotated variant of a gene on a chromosome."""
    points = cohort.has_consequence.select("v", "gene").join(cohort.variant.select("v", "chr", "pos"), "v")
    return points.groupBy("gene", "chr").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))


def overlapping(left: DataFrame, right: DataFrame, bin_size: int = 100_000, margin: int = 0) -> DataFrame:
    """Pairs of intervals (chr, start, end) that overlap or lie at most margin apart; right's columns start and end come back as start2, end2.

    Both sides are spread over bins; a pair counts in the first bin that it shares.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor(b / bin_size))).alias("_bin")
    one = left.select("*", bins(F.col("start") - margin, F.col("end") + margin))
    two = right.withColumnsRenamed({"start": "start2", "end": "end2"})
    two = two.select("*", bins(F.col("start2"), F.col("end2")))
    first = F.greatest(F.floor((F.col("start") - margin) / bin_size), F.floor(F.col("start2") / bin_size))
    both = one.join(two, ["chr", "_bin"]).where((F.col("start") - margin <= F.col("end2")) & (F.col("end") + margin >= F.col("start2")) & (F.col("_bin") == first))
    return both.drop("_bin")


def gene_windows(cohort: Cohort, windows: DataFrame, columns: list[str], bin_size: int = 100_000) -> DataFrame:
    """Of the windows that overlap a gene's extent: their number, and the largest and the mean value of the columns."""
    both = overlapping(windows.select("chr", "start", "end", *columns), gene_extent(cohort), bin_size)
    return both.groupBy("gene").agg(F.count(F.lit(1)).alias("n_windows"), *(f(x).alias(f"{n}_{x}") for x in columns for n, f in (("max", F.max), ("mean", F.avg))))


# Impacts from the gravest on.
IMPACTS = ["HIGH", "MODERATE", "LOW", "MODIFIER"]


def peak_genes(cohort: Cohort, peaks: DataFrame, margin: int = 100_000, most: int = 30, bin_size: int = 100_000) -> DataFrame:
    """Genes with variants in or near peaks (chr, start, end), each gene once a peak with its gravest variant; at most ``most`` a peak, gravest first, then by gene."""
    grave = F.coalesce(F.array_position(F.array(*map(F.lit, IMPACTS)), F.col("impact")), F.lit(99))
    points = cohort.has_consequence.select("v", "gene", "consequence", F.when(grave > 0, grave).otherwise(99).alias("rank")).join(cohort.variant.select("v", "chr", "pos"), "v")
    near = peaks.select("chr", F.col("start").alias("peak_start"), F.col("end").alias("peak_end"), (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    hit = overlap(points, near, bin_size)
    best = hit.groupBy("chr", "peak_start", "peak_end", "gene").agg(F.min(F.struct("rank", "pos", "consequence")).alias("best"))
    place = F.row_number().over(Window.partitionBy("chr", "peak_start", "peak_end").orderBy("best.rank", "gene"))
    out = best.withColumn("place", place).where(F.col("place") <= most).join(cohort.gene, "gene", "left")
    return out.select("chr", "peak_start", "peak_end", "gene", "symbol", F.element_at(F.array(*map(F.lit, [*IMPACTS, None])), F.least(F.col("best.rank"), F.lit(5)).cast("int")).alias("impact"), "best.consequence", F.col("place").cast("long").alias("place"))


def keyword_modules(names: DataFrame, column: str, modules: dict[str, list[str]], other: str = "other") -> DataFrame:
    """names with a column module: the first whose keyword stands in the lower-cased name."""
    out = F.lit(other)
    for module, words in reversed(modules.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(F.col(column)), F.lit(w.lower()))
        out = F.when(hit, module).otherwise(out)
    return names.withColumn("module", out)


def velocity(features: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key, velocity: weighted mean of the z scores (over all rows) of the columns; weights may be negative."""
    facts = features.agg(*(f(c).alias(f"{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_pop))))  # one row
    z = lambda c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.nullif(f"s_{c}", F.lit(0.0))).otherwise(0.0)
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(float(w)) * z(c)
    return features.join(F.broadcast(facts)).select(key, (total / sum(map(abs, weights.values()))).alias("velocity"))


def pathway_burden(cohort: Cohort, pathway_values: DataFrame, max_af: float = 0.1, impacts: tuple[str, ...] = ("HIGH", "MODERATE")) -> DataFrame:
    """sample, pop, constrained, divergent: carried rare missense alleles' sites, by the mean value (pathway, fst) of the pathways that a variant lies in.

    Sites at or below the lower quartile of these means are constrained, at or above the upper quartile divergent. Values count
    to 15 decimals, and are added as decimals: equal means stay equal in whatever order they are added, so none misses a cut that it lies on.
    """
    edges = cohort.has_consequence.where(F.col("impact").isin(list(impacts)))
    lies = edges.select("v", "gene").distinct().join(cohort.in_pathway, "gene").select("v", "pathway").distinct().join(pathway_values.select("pathway", "fst"), "pathway")
    mean = lies.groupBy("v").agg(F.avg(F.col("fst").cast("decimal(30,15)")).cast("double").alias("x"))
    cuts = mean.agg(F.expr("percentile(x, 0.25)").alias("low"), F.expr("percentile(x, 0.75)").alias("high"))  # one row
    missense = cohort.has_consequence.where(F.col("consequence") == "missense_variant").select("v").distinct()
    af = cohort.variant_pop.groupBy("v").agg((F.sum("ac") / F.sum("an")).alias("af")).where(F.col("af") < max_af).select("v")
    sites = mean.join(missense, "v", "left_semi").join(af, "v", "left_semi").join(F.broadcast(cuts))
    carried = cohort.genotype.join(sites, "v").groupBy("sample").agg(F.count_if(F.col("x") <= F.col("low")).alias("constrained"), F.count_if(F.col("x") >= F.col("high")).alias("divergent"))
    return cohort.sample.join(carried, "sample", "left").fillna(0).select("sample", "pop", "constrained", "divergent")


def population_means(summary: DataFrame, columns: list[str]) -> DataFrame:
    """Means over chromosomes of the per-chromosome statistics of each population, and the number of chromosomes."""
    return summary.groupBy("pop").agg(F.count(F.lit(1)).alias("n_chromosomes"), *(F.avg(c).alias(c) for c in columns))


def run_all(cohort: Cohort, columns: list[str]) -> DataFrame:
    """stat, pop, pop2, chr, value: all statistics of all populations, pairs and chromosomes, a job for each kind instead of one for each combination."""
    from .divergence import fst_matrix
    from .diversity import pop_summary

    one = pop_summary(cohort).select("chr", "pop", F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x"))
    two = fst_matrix(cohort, by=("chr",)).select("chr", "pop1", "pop2", F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in ("fst_hudson", "fst_wc", "dxy", "da")))).alias("x"))
    return one.select("x.stat", "pop", F.lit(None).cast("string").alias("pop2"), "chr", "x.value").union(two.select("x.stat", "pop1", "pop2", "chr", "x.value"))
