"""Per-site and summary statistics as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def expected_het(p: Column) -> Column:
    return 2 * p * (1 - p)


def pi_site(ac, an) -> Column:
    """Nucleotide diversity of a site with its small-sample correction; 0 below two alleles."""
    n = _d(an)
    return F.when(n < 2, F.lit(0.0)).otherwise(expected_het(_d(ac) / n) * n / (n - 1))


def theta_h_site(derived, an) -> Column:
    i, n = _d(derived), _d(an)
    return F.when((n >= 2) & (i > 0) & (i < n), 2 * i * i / (n * (n - 1))).otherwise(F.lit(0.0))


def derived_count(ac, an, ancestral) -> Column:
    """Copies of the derived allele; null where the ancestral allele is unknown."""
    return F.when(ancestral == "REF", _d(ac)).when(ancestral == "ALT", _d(an) - _d(ac))


def harmonic(n: Column, power: int = 1) -> Column:
    """Sum of 1 / i**power for i from 1 to n - 1."""
    up_to = F.greatest(n.cast("int") - 1, F.lit(1))
    total = F.aggregate(F.sequence(F.lit(1), up_to), F.lit(0.0), lambda a, i: a + 1 / F.pow(i.cast("double"), F.lit(float(power))))
    return F.when(n < 2, F.lit(0.0)).otherwise(total)


def tajima_d(pi_sum: Column, seg: Column, n: Column, a1: Column, a2: Column) -> Column:
    """Tajima (1989); 0 where it isn't defined."""
    n, s = F.when(n >= 4, n.cast("double")), seg.cast("double")  # null, hence 0, for fewer
    a1 = F.when(n >= 4, a1)
    c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    variance = c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1)
    return F.when((s > 0) & (n >= 4) & (variance > 0), (pi_sum - s / a1) / F.sqrt(variance)).otherwise(F.lit(0.0))


def fay_wu_h_norm(h_sum: Column, sites: Column, n: Column, a1: Column, a2: Column) -> Column:
    """Fay and Wu's H over its standard deviation (Zeng et al. 2006)."""
    n = F.when(n >= 4, n.cast("double"))
    theta = sites / F.when(n >= 4, a1)
    variance = theta * (n - 2) / (6 * (n - 1)) + theta * theta * (18 * n * n * (3 * n + 2) * a2 - (88 * n * n * n + 9 * n * n - 13 * n + 6)) / (9 * n * (n - 1) * (n - 1))
    return F.when((sites > 0) & (n >= 4) & (variance > 0), h_sum / F.sqrt(variance)).otherwise(F.lit(0.0))


def with_pair_terms(df: DataFrame, one: str = "", two: str = "2", suffix: str = "", ok: Column | None = None) -> DataFrame:
    """Adds the per-site terms of two populations, whose counts stand in ac, an and het with suffixes one and two.

    hn, hd: numerator and denominator of Hudson's Fst; wn, wd: a and a + b + c of Weir and Cockerham
    (1984); dx: dxy. Null unless ok; 0 below two alleles. Built in steps, so that no term is computed twice
    and the generated code stays small.
    """
    d = lambda c: F.col(c).cast("double")
    n1, n2, p1, p2, mean, p, s2, h, within, w1, w2 = (F.col(f"_{x}") for x in ("n1", "n2", "p1", "p2", "mean", "p", "s2", "h", "within", "w1", "w2"))
    steps = [
        {"_n1": d(f"an{one}") / 2, "_n2": d(f"an{two}") / 2, "_p1": d(f"ac{one}") / d(f"an{one}"), "_p2": d(f"ac{two}") / d(f"an{two}")},
        {"_mean": (n1 + n2) / 2, "_p": (n1 * p1 + n2 * p2) / (n1 + n2), "_h": (d(f"het{one}") / n1 + d(f"het{two}") / n2) / 2, "_w1": 4 * p1 * (1 - p1) * n1 / (2 * n1 - 1), "_w2": 4 * p2 * (1 - p2) * n2 / (2 * n2 - 1)},
        {"_s2": (n1 * (p1 - p) * (p1 - p) + n2 * (p2 - p) * (p2 - p)) / mean, "_hn": (p1 - p2) * (p1 - p2) - w1 / (4 * n1) - w2 / (4 * n2)},
        {"_within": p * (1 - p) - s2 / 2},
        {
            "_a": mean / (2 * mean - (n1 * n1 + n2 * n2) / (2 * mean)) * (s2 - (within - h / 4) / (mean - 1)),
            "_b": mean / (mean - 1) * (within - (2 * mean - 1) / (4 * mean) * h),
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    known = (F.col(f"an{one}") >= 2) & (F.col(f"an{two}") >= 2)
    two_each = known & (mean > 1)
    out = {
        "hn": F.when(known, F.col("_hn")).otherwise(F.lit(0.0)), "hd": F.when(known, F.col("_hn") + (w1 + w2) / 2).otherwise(F.lit(0.0)),
        "wn": F.when(two_each, F.col("_a")).otherwise(F.lit(0.0)), "wd": F.when(two_each, F.col("_a") + F.col("_b") + h / 2).otherwise(F.lit(0.0)),
        "dx": p1 * (1 - p2) + p2 * (1 - p1),
    }
    df = df.withColumns({f"{k}{suffix}": x if ok is None else F.when(ok, x) for k, x in out.items()})
    return df.drop(*(name for step in steps for name in step))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 unless den is positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def branch_length(fst: Column) -> Column:
    return -F.log(F.greatest(F.lit(1e-10), 1 - fst))


# ---------------------------------------------------------------- arrays


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 when either norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


# ---------------------------------------------------------------- linkage


def r_squared(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Squared Pearson correlation from sums; 0 where a side doesn't vary."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) * (n * sxy - sx * sy) / (vx * vy)).otherwise(F.lit(0.0))


def d_prime(n: Column, n1: Column, n2: Column, n11: Column) -> Column:
    """|D| / Dmax of haplotype counts; 0 where a site doesn't vary."""
    p, q = n1 / n, n2 / n
    d = n11 / n - p * q
    top = F.when(d >= 0, F.least(p * (1 - q), q * (1 - p))).otherwise(F.least(p * q, (1 - p) * (1 - q)))
    return F.when(top > 0, F.least(F.abs(d) / top, F.lit(1.0))).otherwise(F.lit(0.0))
