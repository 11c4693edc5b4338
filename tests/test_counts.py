"""Published values of a five-variant, two-population fixture, scalars, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varspark.functions import kernels as k
from varspark.functions.hwe import midp
from varspark.operators import divergence as dg
from varspark.operators import diversity as dv
from varspark.operators.select import SiteFilter, require_population
from varspark.plans.cohort import Cohort, star_cohort

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def five(spark):
    """Counts only: POP1 has 5 samples, POP2 4."""
    sites = [(100, "A", "T", (2, 1), (2, 1), (0, 0), "REF"), (200, "C", "G", (4, 3), (2, 1), (1, 1), "REF"), (300, "G", "A", (6, 5), (2, 1), (2, 2), "ALT"), (400, "T", "C", (8, 2), (2, 2), (3, 0), "REF"), (500, "A", "G", (0, 0), (0, 0), (0, 0), "REF")]
    rows = [(p, "chr1", p, f"chr1:{p}:{r}:{a}", "SNP", anc, f"POP{i + 1}", ac[i], (10, 8)[i], het[i], hom[i]) for p, r, a, ac, het, hom, anc in sites for i in (0, 1)]
    counts = spark.createDataFrame(rows, "v long, chr string, pos long, variant_id string, variant_type string, ancestral string, pop string, ac int, an int, het int, hom int")
    e = lambda s: spark.createDataFrame([], s)
    sample = spark.createDataFrame([(i, "POP1" if i < 5 else "POP2") for i in range(9)], "sample int, pop string")
    variant = counts.select("v", "chr", "pos", F.lit("A").alias("ref"), F.lit("T").alias("alt"), "variant_id", "variant_type", "ancestral").distinct()
    return Cohort(variant, sample, e("v long, sample int, gt int, phase int"), e("gene string, symbol string"), e("v long, gene string, consequence string, impact string"), e("gene string, pathway string"), e("gene string, go string"), counts)


def test_diversity(five):
    r = dv.diversity(five, "chr1", None, None, "POP1").first()
    want = {"pi": 0.35555556, "theta_w": 0.28278861, "tajima_d": 0.98793288, "fay_wu_h": -0.08888889, "fay_wu_h_norm": -0.93643842, "het_exp": 0.32, "het_obs": 0.32, "fis": 0.0}
    for name, value in want.items():
        assert r[name] == pytest.approx(value, abs=1e-7), name
    assert (r.n_variants, r.n_segregating, r.n_polarized) == (5, 4, 5)
    part = dv.diversity(five, "chr1", 100, 300, "POP1").first()
    assert (part.n_variants, part.n_segregating) == (3, 3)
    assert set(dv.diversity(five, "chr1", 600, 900, "POP1").first()) == {0}


def test_divergence(five):
    r = dg.divergence(five, "chr1", None, None, "POP1", "POP2").first()
    assert (r.fst_hudson, r.fst_wc, r.dxy, r.da) == pytest.approx((0.05925926, 0.03277245, 0.375, 0.02222222), abs=1e-7)
    back = dg.divergence(five, "chr1", None, None, "POP2", "POP1").first()
    assert back.fst_hudson == pytest.approx(r.fst_hudson) and back.dxy == pytest.approx(r.dxy)


def test_spectra(five):
    values = lambda df: [r.n for r in df.orderBy("bin").collect()]
    assert values(dg.sfs(five, "chr1", None, None, "POP1", folded=True)) == [1, 0, 2, 0, 2, 0]
    assert values(dg.sfs(five, "chr1", None, None, "POP1")) == [1, 0, 1, 0, 2, 0, 0, 0, 1, 0, 0]
    assert values(dg.sfs(five, "chr1", None, None, "POP2", folded=True)) == [1, 1, 1, 2, 0]
    joint = lambda folded: {(r.bin1, r.bin2): r.n for r in dg.joint_sfs(five, "chr1", None, None, "POP1", "POP2", folded).collect()}
    assert joint(True) == {(0, 0): 1, (2, 1): 1, (2, 2): 1, (4, 3): 2}
    assert joint(False) == {(0, 0): 1, (2, 1): 1, (4, 3): 1, (6, 5): 1, (8, 2): 1}


def test_unknown_population(five):
    require_population(five, "POP1")
    with pytest.raises(ValueError):
        require_population(five, "POP9")


def test_scalars(spark):
    th = lambda i, n: spark.range(1).select(k.theta_h_site(F.lit(i), F.lit(n)).alias("x")).first().x
    assert [th(3, 10), th(1, 10), th(9, 10), th(0, 10), th(10, 10), th(1, 1)] == pytest.approx([0.2, 2 / 90, 1.8, 0, 0, 0])
    assert spark.range(1).select(k.harmonic(F.lit(10)).alias("x")).first().x == pytest.approx(2.8289682539682538)
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(k.dot(a, b).alias("d"), k.euclidean(a, b).alias("e"), k.cosine(a, b).alias("c"), k.cosine(a, zero).alias("z"), k.subtract(a, b).alias("s")).first()
    assert (row.d, row.e, row.c, row.z, row.s) == (24.0, pytest.approx(math.sqrt(2)), pytest.approx(0.96), 0.0, [-1.0, 1.0])


def test_hwe():
    assert midp(0, 10, 0) == 1.0 and midp(0, 0, 0) == 1.0
    assert midp(40, 0, 0) < 0.001 < 0.5 < midp(50, 25, 25)


def test_call_rate_filter(spark, five):
    sites = five.variant_pop.where("pop = 'POP1'").withColumn("an", F.when(F.col("pos") == 400, 8).otherwise(F.col("an")))
    assert SiteFilter(min_call_rate=0.9).apply(sites).count() == 4 and SiteFilter(min_call_rate=0.8).apply(sites).count() == 5


def test_invariants(spark):
    c = star_cohort(spark, SF)
    scan = dv.genome_scan(c, "POP0", 20_000, 10_000, pop2="POP1").collect()
    assert all(r.fst <= 1 and r.dxy >= r.da and 0 <= r.pi <= 1 for r in scan)
    n = dv.diversity(c, "chr1", None, None, "POP0").first().n_variants
    assert sum(r.n for r in dg.sfs(c, "chr1", None, None, "POP0").collect()) == n
    m = {(r.pop1, r.pop2): r.fst_hudson for r in dg.fst_matrix(c).collect()}
    assert len(m) == 10 and np.isfinite(list(m.values())).all()
