import numpy as np
import pytest

from varspark.functions import ehh as e
from varspark.operators import haplotypes as hp
from varspark.operators.posthoc import fisher_greater, principal_components, upgma
from varspark.plans.cohort import Cohort, star_cohort

SF = "/root/testdata/sf0.001"


def test_ehh_trapezoid():
    hap = np.array([[0, 0, 0, 1, 1, 1, 0, 1], [1, 1, 1, 1, 1, 1, 0, 0], [0, 0, 0, 0, 0, 0, 1, 1]])
    assert e.integrated(hap, np.array([900, 1000, 1200]), 1, np.arange(6), 0.0) == pytest.approx(270)
    assert e.integrated(hap, np.array([900, 1000, 1200]), 1, np.arange(1)) == 0
    assert e.integrated(hap, np.array([900, 1000, 400_000]), 1, np.arange(6)) == -1


def brute_ehh(hap, pos, f, who, least):
    total = 0.0
    for step in (1, -1):
        last, at, i = 1.0, pos[f], f + step
        while 0 <= i < len(pos):
            lo, hi = min(f + step, i), max(f + step, i)
            n = len(who)
            same = sum((hap[lo : hi + 1, a] == hap[lo : hi + 1, b]).all() for x, a in enumerate(who) for b in who[:x])
            v = same / (n * (n - 1) / 2)
            v = 0.0 if v < least else v
            total += (last + v) / 2 * min(abs(pos[i] - at), e.GAP_SCALE)
            if v == 0:
                break
            last, at, i = v, pos[i], i + step
    return total


@pytest.mark.parametrize("seed", range(4))
def test_ehh_against_pairs(seed):
    rng = np.random.default_rng(seed)
    hap, pos = rng.integers(0, 2, (30, 9)), np.cumsum(rng.integers(1, 30_000, 30))
    for f in range(30):
        who = np.flatnonzero(hap[f] == 1)
        if len(who) > 1:
            assert e.integrated(hap, pos, f, who, 0.2) == pytest.approx(brute_ehh(hap, pos, f, who.tolist(), 0.2))


def test_run_sums():
    """Shared runs of all pairs, both directions added up, against pairs walked one by one."""
    rng = np.random.default_rng(0)
    for hap in (np.zeros((2, 4), np.int8), rng.integers(0, 2, (12, 5)).astype(np.int8), (rng.random((40, 11)) < 0.2).astype(np.int8)):
        n = len(hap)
        ahead, back = e.Sweep(hap.shape[1]), e.Sweep(hap.shape[1])
        backward = [e.run_sums(back, x) for x in hap]
        forward = [e.run_sums(ahead, x) for x in hap[::-1]][::-1]
        for f in range(n):
            want, pairs = [0, 0], [0, 0]
            for a in range(hap.shape[1]):
                for b in range(a):
                    if hap[f, a] == hap[f, b]:
                        x = y = f
                        while x >= 0 and hap[x, a] == hap[x, b]:
                            x -= 1
                        while y < n and hap[y, a] == hap[y, b]:
                            y += 1
                        want[hap[f, a]] += (f - x) + (y - f)
                        pairs[hap[f, a]] += 1
            assert [backward[f][i][0] + forward[f][i][0] for i in (0, 1)] == want
            assert [backward[f][i][1] for i in (0, 1)] == pairs == [forward[f][i][1] for i in (0, 1)]


def test_pair_counts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lcp = rng.integers(0, 4, rng.integers(0, 12))
        got = np.bincount(lcp, e.pair_counts(lcp), 4) if len(lcp) else np.zeros(4)
        want = np.bincount([lcp[i:j].min() for i in range(len(lcp)) for j in range(i + 1, len(lcp) + 1)] or [0], minlength=4) if len(lcp) else np.zeros(4)
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize(
    "sizes, want",
    [((10,), (1, 1, 0, 0, 1)), ((1,) * 8, (1 / 8, 5 / 32, 7 / 8, 1, 8)), ((8, 1, 1), (0.66, 0.82, 0.02 / 0.66, None, 3)), ((4, 4, 1, 1), (0.34, 0.66, 0.18 / 0.34, None, 4))],
)
def test_garud(sizes, want):
    cols = [[int(b) for b in f"{i:04b}"] for i, n in enumerate(sizes) for _ in range(n)]
    got = e.garud(np.array(cols).T)
    for g, w in zip(got, want, strict=True):
        assert w is None or g == pytest.approx(w)


def test_viterbi():
    pos, af = 1_000_000 + 10_000 * np.arange(200), np.full(200, 0.3)
    args = (6.7e-8, 5e-9, 1e-3)
    assert e.viterbi(pos, af, np.zeros((200, 1), int), *args).all()
    assert not e.viterbi(pos, af, np.ones((200, 1), int), *args).any()
    gt = np.ones((200, 2), int)
    gt[60:130, 0] = 0
    a, b = e.runs(e.viterbi(pos, af, gt, *args)[:, 0])[0]
    assert abs(a - 60) < 5 and abs(b - 129) < 5 and not e.viterbi(pos, af, gt, *args)[:, 1].any()


def brute_window(pos, het, size, max_het, threshold):
    n = len(pos)
    hit = [sum(het[i : i + size]) <= max_het for i in range(n - size + 1)]
    return [np.mean([hit[w] for w in range(max(0, i - size + 1), min(i, n - size) + 1)]) >= threshold for i in range(n)]


def test_window_runs():
    rng = np.random.default_rng(2)
    pos, het = 1000 * np.arange(120), rng.random(120) < 0.1
    good = np.array(brute_window(pos, het, 20, 1, 0.5))
    assert hp._window_runs(pos, het, 20, 1, 0.5, 10**9) == e.runs(good)
    wide = pos.copy()
    wide[60:] += 10**7
    assert hp._window_runs(wide, np.zeros(120, bool), 20, 1, 0.5, 10**6) == [(0, 59), (60, 119)]
    assert hp._window_runs(pos[:5], het[:5], 20, 1, 0.5, 10**6) == []


def test_chunks_do_not_matter(spark):
    c = star_cohort(spark, SF)
    rows = lambda **o: sorted((r.variant_id, round(r.ihs_unstd, 9)) for r in hp.ihs(c, "POP0", "chr1", **o).collect())
    whole = rows()
    assert len(whole) > 20 and whole == rows(chunk_size=15_000, ehh_margin=30_000)


def test_options(spark):
    c = star_cohort(spark, SF)
    whole = {r.variant_id: r for r in hp.ihs(c, "POP0", "chr1").collect()}
    part = hp.ihs(c, "POP0", "chr1", start=10_000, end=30_000, max_af=0.5, unstd_only=True)
    assert part.columns == ["variant_id", "chr", "pos", "af", "ihs_unstd"]
    assert {r.variant_id: r.ihs_unstd for r in part.collect()} == {k: pytest.approx(r.ihs_unstd) for k, r in whole.items() if 10_000 <= r.pos <= 30_000 and r.af <= 0.5}
    one = [r.sample for r in c.sample.where("pop = 'POP0'").collect()]
    got = {r.variant_id: r.xpehh_unstd for r in hp.xpehh(c, "POP0", "POP1", "chr1", samples1=one, unstd_only=True).collect()}
    assert got == {r.variant_id: pytest.approx(r.xpehh_unstd) for r in hp.xpehh(c, "POP0", "POP1", "chr1").collect()}
    assert 0 < hp.nsl(c, "POP0", "chr1", max_af=0.4, end=30_000).count() < hp.nsl(c, "POP0", "chr1").count()
    short = hp.roh(c, "POP0", "chr1", min_length=1, min_snps=2, az_length=5000.0, az_fraction=0.5).collect()
    assert len(short) == 20 and sum(r.n_roh for r in short) > 0


def test_thousands_of_samples(spark):
    """3,000 samples: alleles, linkage, shared runs and extended homozygosity in bounded time."""
    n = 3000
    variant = spark.range(60).selectExpr("id AS v", "'chr1' AS chr", "id * 1000 + 1000 AS pos", "'A' AS ref", "'T' AS alt", "concat('v', id) AS variant_id", "'SNP' AS variant_type", "'REF' AS ancestral")
    sample = spark.range(n).selectExpr("cast(id AS int) AS sample", "'P' AS pop")
    genotype = variant.crossJoin(sample).selectExpr("v", "sample", "cast(pmod(hash(v div 4, sample), 10) AS int) AS x", "cast(pmod(hash(sample, 7), 2) AS int) AS phase").where("x < 3").selectExpr("v", "sample", "CASE WHEN x = 0 THEN 2 ELSE 1 END AS gt", "phase")
    none = lambda schema: spark.createDataFrame([], schema)
    c = Cohort(variant, sample, genotype, none("gene string, symbol string"), none("v long, gene string, consequence string, impact string"), none("gene string, pathway string"), none("gene string, go string"))
    sites = hp.site_haplotypes(c, "P").collect()
    assert len(sites) == 60 and all(len(r.alleles) == 2 * n and sum(r.alleles) == r.ac == sum(r.dosage) for r in sites)
    pairs = hp.ld(c, None, None, None, "P", max_dist=10_000, r2_threshold=0.9).collect()
    assert len(pairs) == 15 * 6 and all(r.r2 == pytest.approx(1) and r.dprime == pytest.approx(1) for r in pairs)  # four sites in a row are equal
    assert hp.nsl(c, "P").count() == 60 and hp.ihs(c, "P").count() == 60


def test_xpehh_swaps_sign(spark):
    c = star_cohort(spark, SF)
    rows = lambda a, b: {r.variant_id: r.xpehh_unstd for r in hp.xpehh(c, a, b, "chr2").collect()}
    one, two = rows("POP0", "POP1"), rows("POP1", "POP0")
    assert one.keys() == two.keys() and all(x == pytest.approx(-two[k]) for k, x in one.items())


def test_roh_methods(spark):
    c = star_cohort(spark, SF)
    assert hp.roh(c, "POP0", "chr1").count() == 20
    with pytest.raises(ValueError):
        hp.roh(c, "POP0", "chr1", "other")


def test_small_statistics():
    assert fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert upgma(["a", "b", "c"], np.array([[0, 2, 6], [2, 0, 6], [6, 6, 0]])) == "((a:1,b:1):2,c:3);"
    scores, share = principal_components(np.array([[1.0, 2.0], [2.0, 4.1], [3.0, 5.9]]), 1)
    assert share[0] > 0.99 and scores.shape == (3, 1)
