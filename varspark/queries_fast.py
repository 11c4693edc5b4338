"""Registered queries over allele counts, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import kernels as k
from .operators import diversity as dv
from .operators import divergence as dg
from .operators.select import SiteFilter
from .plans.cohort import COHORT_SQL, star_cohort

QUERIES, ORACLE = {}, {}
_cohorts: dict = {}


def cohort(spark, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cohorts:
        _cohorts[key] = star_cohort(spark, sf_dir)
    return _cohorts[key]


def rounded(df, digits: int = 6):
    """Doubles rounded, so that the order of additions doesn't show (nudged, so that it doesn't decide ties); -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(c) + 1e-9, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, digits: int = 6):
    """Register f(cohort) under its name, with its SQL over the cohort's tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(cohort(spark, sf_dir)), digits)
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {COHORT_SQL.strip()}{sql}"
        return f

    return add


def _r(x: str, name: str) -> str:
    return f"round(CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN {x} ELSE 0 END + 1e-9, 6) + 0.0 AS {name}"


HARMONIC = "list_sum(list_transform(range(1, greatest(2, {n})), lambda i: 1.0 / (i {p})))"
SITE_SQL = """
terms AS (SELECT *, 2.0 * ac / an * (1 - 1.0 * ac / an) * an / (an - 1) AS pi_, 2.0 * ac / an * (1 - 1.0 * ac / an) AS he_, 1.0 * het / (an // 2) AS ho_,
    CAST(ac > 0 AND ac < an AS INT) AS seg_, CAST(ancestral IS NOT NULL AS INT) AS pol_, CASE ancestral WHEN 'REF' THEN ac WHEN 'ALT' THEN an - ac END AS der FROM {sites}),
{name} AS (SELECT {keys}count(*) AS n_variants, coalesce(sum(pi_), 0) AS pi_, coalesce(sum(he_), 0) AS he_, coalesce(sum(ho_), 0) AS ho_, coalesce(sum(seg_), 0) AS seg, coalesce(sum(pol_), 0) AS pol,
    coalesce(sum(CASE WHEN der > 0 AND der < an THEN 2.0 * der * der / (an * (an - 1)) ELSE 0 END), 0) AS th, coalesce(sum(pol_ * pi_), 0) AS pp, coalesce(arg_min(an, pos), 0) AS n FROM terms{join}{group}),
h AS (SELECT *, HARM1 AS a1, HARM2 AS a2 FROM {name}),
stats AS (SELECT *, (seg / a1 * ((n + 1.0) / (3 * (n - 1.0)) - 1 / a1) + (2.0 * (n * n + n + 3) / (9.0 * n * (n - 1)) - (n + 2.0) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) * seg * (seg - 1)) AS vt,
    (pol / a1 * (n - 2.0) / (6 * (n - 1.0)) + pol / a1 * pol / a1 * (18.0 * n * n * (3 * n + 2) * a2 - (88.0 * n * n * n + 9.0 * n * n - 13 * n + 6)) / (9.0 * n * (n - 1) * (n - 1))) AS vh FROM h)
"""
STATS_SQL = ", ".join([
    _r("pi_ / n_variants", "pi"), _r("seg / a1 / n_variants", "theta_w"), _r("CASE WHEN seg > 0 AND vt > 0 THEN (pi_ - seg / a1) / sqrt(vt) END", "tajima_d"),
    _r("(pp - th) / pol", "fay_wu_h"), _r("CASE WHEN pol > 0 AND vh > 0 THEN (pp - th) / sqrt(vh) END", "fay_wu_h_norm"),
    _r("he_ / n_variants", "{he}"), _r("ho_ / n_variants", "{ho}"), _r("CASE WHEN he_ > 0 THEN 1 - ho_ / he_ END", "{fis}"),
    "n_variants", "CAST(seg AS BIGINT) AS n_segregating", "CAST(pol AS BIGINT) AS n_polarized",
])


def site_sql(sites: str, keys: str = "", join: str = "", name: str = "sums") -> str:
    group = f" GROUP BY {keys}" if keys else ""
    text = SITE_SQL.format(sites=sites, name=name, keys=f"{keys}, " if keys else "", join=join, group=group)
    return text.replace("HARM1", HARMONIC.format(n="n", p="")).replace("HARM2", HARMONIC.format(n="n", p="* i"))


def diversity_sql(sites: str, with_: str = "") -> str:
    return f", {with_}{site_sql(sites)} SELECT {STATS_SQL.format(he='het_exp', ho='het_obs', fis='fis')} FROM stats"


SITES = "(SELECT * FROM variant_pop WHERE pop = 'POP0'{more})"


@query(diversity_sql(SITES.format(more=" AND chr = 'chr1' AND pos BETWEEN 1000 AND 400000")))
def diversity_region(c):
    return dv.diversity(c, "chr1", 1000, 400_000, "POP0")


@query(diversity_sql(SITES.format(more=" AND v IN (SELECT v FROM has_consequence WHERE consequence = 'missense_variant')")))
def diversity_missense(c):
    return dv.diversity(c, None, None, None, "POP0", consequence="missense_variant")


@query(diversity_sql(SITES.format(more=" AND v IN (SELECT v FROM has_consequence JOIN in_pathway USING (gene) WHERE consequence = 'synonymous_variant' AND pathway = 'ASIA')")))
def diversity_pathway(c):
    return dv.diversity(c, None, None, None, "POP0", consequence="synonymous_variant", pathway="ASIA")


@query(diversity_sql(SITES.format(more=" AND v IN (SELECT v FROM has_consequence WHERE gene = 'G3')")))
def diversity_gene(c):
    return dv.diversity(c, None, None, None, "POP0", gene="G3")


@query(diversity_sql(SITES.format(more=" AND false")))
def diversity_empty(c):
    return dv.diversity(c, "chr1", 1, 10, "POP0")


@query(diversity_sql(SITES.format(more=" AND 1.0 * ac / an >= 0.05 AND 1.0 * ac / an <= 0.3 AND variant_type = 'SNP'")))
def diversity_filtered(c):
    return dv.diversity(c, None, None, None, "POP0", SiteFilter(min_af=0.05, max_af=0.3, min_call_rate=0.9, variant_type="SNP"))


_subset = "own AS (SELECT sample FROM sample WHERE sample IN (0, 1, 2, 7, 9, 31)), "
_subset += "few AS (SELECT variant.*, 12 AS an, CAST(coalesce(sum(gt), 0) AS INTEGER) AS ac, CAST(count(*) FILTER (gt = 1) AS INTEGER) AS het FROM variant LEFT JOIN (genotype JOIN own USING (sample)) USING (v) GROUP BY ALL),"


@query(diversity_sql("few", _subset))
def diversity_subset(c):
    return dv.diversity(c, None, None, None, "POP0", samples=[0, 1, 2, 7, 9, 31, 999, 7])


_hwe = """lnp AS (SELECT v, het, 2 * least(hom, an // 2 - het - hom) + het AS rare, an // 2 AS n FROM variant_pop WHERE pop = 'POP0'),
alt AS (SELECT v, het, h, exp(-lgamma(h + 1) - lgamma((rare - h) / 2.0 + 1) - lgamma(n - h - (rare - h) / 2.0 + 1) + h * ln(2)) AS p FROM (SELECT *, unnest(range(rare % 2, rare + 1, 2)) AS h FROM lnp)),
pv AS (SELECT v, (sum(p) FILTER (p < s * (1 - 1e-9)) + 0.5 * any_value(s)) / sum(p) AS a, 0.5 * any_value(s) / sum(p) AS b FROM alt JOIN (SELECT v, p AS s FROM alt WHERE h = het) USING (v) GROUP BY v),"""


@query(diversity_sql(SITES.format(more=" AND v IN (SELECT v FROM pv WHERE coalesce(a, b) >= 0.2 UNION SELECT v FROM lnp WHERE rare = 0)"), _hwe))
def diversity_hwe(c):
    return dv.diversity(c, None, None, None, "POP0", SiteFilter(hwe_pvalue=0.2))


@query(f", {site_sql('variant_pop', 'pop, chr')} SELECT pop, chr, {STATS_SQL.format(he='mean_he', ho='mean_ho', fis='mean_fis')} FROM stats")
def pop_summary_all(c):
    return dv.pop_summary(c)


@query(" SELECT v, pop, ac, an, het, hom FROM variant_pop")
def cohort_variant_pop(c):
    return c.variant_pop.select("v", "pop", "ac", "an", "het", "hom")


# ---------------------------------------------------------------- two and three populations


def pair_sql(a: str, b: str, p: str = "") -> str:
    """Terms of the sites' counts ac{a}, an{a}, het{a} against those of b."""
    s = lambda x, i: f"{x}{i}"
    ac1, an1, h1, ac2, an2, h2 = (s(x, i) for i in (a, b) for x in ("ac", "an", "het"))
    p1, p2 = f"(1.0 * {ac1} / {an1})", f"(1.0 * {ac2} / {an2})"
    w1, w2 = f"(2 * {p1} * (1 - {p1}) * {an1} / ({an1} - 1))", f"(2 * {p2} * (1 - {p2}) * {an2} / ({an2} - 1))"
    hn = f"(({p1} - {p2}) * ({p1} - {p2}) - {w1} / (2 * {an1}) - {w2} / (2 * {an2}))"
    n1, n2 = f"({an1} / 2.0)", f"({an2} / 2.0)"
    nt, nb = f"({n1} + {n2})", f"(({n1} + {n2}) / 2)"
    pb = f"(({n1} * {p1} + {n2} * {p2}) / {nt})"
    s2 = f"(({n1} * ({p1} - {pb}) * ({p1} - {pb}) + {n2} * ({p2} - {pb}) * ({p2} - {pb})) / {nb})"
    hb = f"(({h1} / {n1} + {h2} / {n2}) / 2)"
    wi = f"({pb} * (1 - {pb}) - {s2} / 2)"
    wa = f"({nb} / ({nt} - ({n1} * {n1} + {n2} * {n2}) / {nt}) * ({s2} - ({wi} - {hb} / 4) / ({nb} - 1)))"
    wb = f"({nb} / ({nb} - 1) * ({wi} - (2 * {nb} - 1) / (4 * {nb}) * {hb}))"
    return f"{hn} AS hn{p}, {hn} + ({w1} + {w2}) / 2 AS hd{p}, {wa} AS wn{p}, {wa} + {wb} + {hb} / 2 AS wd{p}, {p1} * (1 - {p2}) + {p2} * (1 - {p1}) AS dxy{p}, {w1} AS pia{p}, {w2} AS pib{p}"


def wide(where: str = "true") -> str:
    part = lambda i: f"(SELECT v, ac AS ac{i}, an AS an{i}, het AS het{i} FROM variant_pop WHERE pop = 'POP{i - 1}')"
    return f"wide AS (SELECT * FROM (SELECT v, chr, pos, variant_id, ancestral FROM variant WHERE {where}) JOIN {part(1)} USING (v) JOIN {part(2)} USING (v) JOIN {part(3)} USING (v))"


FST_SQL = f"{_r('sum(hn) / sum(hd)', 'fst_hudson')}, {_r('sum(wn) / sum(wd)', 'fst_wc')}, {_r('avg(dxy)', 'dxy')}, {_r('avg(dxy) - (avg(pia) + avg(pib)) / 2', 'da')}"
_len = lambda p: f"-ln(greatest(1e-10, 1 - sum(wn{p}) / sum(wd{p})))"
PBS_SQL = _r(f"({_len('')} + {_len('13')} - {_len('23')}) / 2", "pbs")


@query(f", {wide()}, p AS (SELECT {pair_sql('1', '2')} FROM wide) SELECT {FST_SQL}, 0.0 AS pbs, count(*) AS n_variants FROM p")
def divergence_pair(c):
    return dg.divergence(c, None, None, None, "POP0", "POP1")


@query(f", {wide()}, p AS (SELECT {pair_sql('1', '2')}, {pair_sql('1', '3', '13')}, {pair_sql('2', '3', '23')} FROM wide) SELECT {FST_SQL}, {PBS_SQL}, count(*) AS n_variants FROM p")
def divergence_pbs(c):
    return dg.divergence(c, None, None, None, "POP0", "POP1", "POP2")


_pairs = "(SELECT a.pop AS pop1, b.pop AS pop2, a.v, a.chr, a.ac AS ac1, a.an AS an1, a.het AS het1, b.ac AS ac2, b.an AS an2, b.het AS het2 FROM variant_pop a JOIN variant_pop b ON a.v = b.v AND a.pop < b.pop)"


@query(f", p AS (SELECT pop1, pop2, {pair_sql('1', '2')} FROM {_pairs}) SELECT pop1, pop2, {FST_SQL}, count(*) AS n_variants FROM p GROUP BY 1, 2")
def fst_matrix(c):
    return dg.fst_matrix(c)


@query(f", p AS (SELECT pop1, pop2, {pair_sql('1', '2')} FROM {_pairs} WHERE v IN (SELECT v FROM has_consequence WHERE consequence = 'missense_variant')) SELECT pop1, pop2, {FST_SQL}, count(*) AS n_variants FROM p GROUP BY 1, 2")
def conditioned_fst(c):
    return dg.fst_matrix(c, consequence="missense_variant")


_sfs = " SELECT CAST(bin AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(0, {top} + 1)) AS bin) LEFT JOIN (SELECT {value} AS bin, count(*) AS n FROM variant_pop WHERE pop = 'POP0' GROUP BY 1) USING (bin)"


@query(_sfs.format(top=20, value="least(ac, an - ac)"))
def sfs_folded(c):
    return dg.sfs(c, None, None, None, "POP0", folded=True)


@query(_sfs.format(top=40, value="CASE ancestral WHEN 'ALT' THEN an - ac ELSE ac END"))
def sfs_unfolded(c):
    return dg.sfs(c, None, None, None, "POP0")


@query(f", {wide()} SELECT ac1 AS bin1, ac2 AS bin2, count(*) AS n FROM wide GROUP BY 1, 2")
def joint_sfs_unfolded(c):
    return dg.joint_sfs(c, None, None, None, "POP0", "POP1")


@query(f", {wide()} SELECT least(ac1, 40 - ac1) AS bin1, least(ac2, 40 - ac2) AS bin2, count(*) AS n FROM wide GROUP BY 1, 2")
def joint_sfs_folded(c):
    return dg.joint_sfs(c, None, None, None, "POP0", "POP1", folded=True)


@query(" SELECT pop, CAST(CASE ancestral WHEN 'REF' THEN ac ELSE an - ac END AS INTEGER) AS bin, count(*) AS n FROM variant_pop WHERE ancestral IS NOT NULL GROUP BY 1, 2")
def sfs_all_pops(c):
    return dg.sfs_all(c)


# ---------------------------------------------------------------- windows

WINDOW_SQL = """
w AS (SELECT *, min(pos) OVER (PARTITION BY chr) AS first_ FROM {sites}),
s AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - {w} + 1 - first_) / {s}.0)) AS BIGINT), CAST(floor((pos - first_) / {s}.0) AS BIGINT) + 1)) AS k FROM w)
"""


def windowed_sql(window: int, step: int, more: str = "") -> str:
    sites = WINDOW_SQL.format(sites="(SELECT * FROM variant_pop WHERE pop = 'POP0')", w=window, s=step)
    keys = f"chr, CAST(first_ + k * {step} AS BIGINT) AS start, CAST(first_ + k * {step} + {window} - 1 AS BIGINT) AS \"end\""
    return f", {sites}, {site_sql('s', 'chr, first_, k')}, scan AS (SELECT first_, k, {keys}, {STATS_SQL.format(he='het_exp', ho='het_obs', fis='fis')}, 'POP0' AS population, 'run' AS run_id FROM stats)"


_cols = ", ".join(["chr", "start", '"end"', *dv.STATS, "population", "run_id"])


@query(windowed_sql(100_000, 50_000) + f" SELECT {_cols}, chr || ':' || start || '-' || \"end\" || ':POP0:run' AS window_id FROM scan")
def genome_scan(c):
    return dv.genome_scan(c, "POP0")


_scan3 = f"""{windowed_sql(100_000, 50_000)}, {wide()}, p AS (SELECT v, {pair_sql('1', '2')}, {pair_sql('1', '3', '13')}, {pair_sql('2', '3', '23')} FROM wide),
q AS (SELECT chr, first_, k, {_r('sum(hn) / sum(hd)', 'fst')}, {_r('sum(wn) / sum(wd)', 'fst_wc')}, {_r('avg(dxy)', 'dxy')}, {_r('avg(dxy) - (avg(pia) + avg(pib)) / 2', 'da')}, {PBS_SQL} FROM s JOIN p USING (v) GROUP BY 1, 2, 3)
SELECT {_cols}, fst, fst_wc, dxy, da, pbs, chr || ':' || start || '-' || "end" || ':POP0_POP1_POP2:run' AS window_id FROM scan JOIN q USING (chr, first_, k)"""


@query(_scan3)
def genome_scan_pbs(c):
    return dv.genome_scan(c, "POP0", pop2="POP1", pop3="POP2")


def _vectors(name: str, expr, sql: str):
    def run(spark, sf_dir):
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
        q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
        return rounded(e.join(F.broadcast(q)).select("vec_id", expr(F.col("embedding"), F.col("q")).alias("value")), 4)

    QUERIES[name] = run
    ORACLE[name] = f"SELECT e.vec_id, round({sql} + 1e-9, 4) + 0.0 AS value FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


_x, _y = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))", "list_transform(q, lambda x: CAST(x AS DOUBLE))"
_vectors("vector_dot", k.dot, f"list_inner_product({_x}, {_y})")
_vectors("vector_euclid", k.euclidean, f"list_distance({_x}, {_y})")
_vectors("vector_cosine", k.cosine, f"list_cosine_similarity({_x}, {_y})")
