"""Registered queries over haplotypes, annotations and saved results, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import diversity as dv
from .operators import haplotypes as hp
from .operators import posthoc as ph
from .operators import verbs as vb
from .queries_fast import FST_SQL, ORACLE, PBS_SQL, QUERIES, WINDOW_SQL, _r, pair_sql, query, rounded, wide, windowed_sql

__all__ = ["ORACLE", "QUERIES"]


def _fix(x: str) -> str:
    """Rounded as rounded() does."""
    return f"round({x} + 1e-9, 6) + 0.0"


# ---------------------------------------------------------------- haplotypes

HAP = """focal AS (SELECT v, chr, pos, variant_id, ac, ac / 40.0 AS af, row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chr) AS n FROM variant_pop WHERE pop = 'POP0' AND {where}),
hap AS (SELECT f.chr, f.pos, f.v, f.i, f.n, CAST(h AS INTEGER) AS h, CASE WHEN gt = 2 OR (gt = 1 AND phase = h % 2) THEN 1 ELSE 0 END AS a FROM focal f CROSS JOIN range(40) t(h) LEFT JOIN genotype g ON g.v = f.v AND g.sample = (h // 2) * 5)"""

_ld = f""", {HAP.format(where="ac BETWEEN 1 AND 39")},
dos AS (SELECT chr, v, pos, h // 2 AS s, sum(a) AS d FROM hap GROUP BY 1, 2, 3, 4),
pr AS (SELECT x.v AS v1, y.v AS v2, y.pos - x.pos AS distance, count(*) AS m, sum(x.d) AS sx, sum(y.d) AS sy, sum(x.d * x.d) AS sxx, sum(y.d * y.d) AS syy, sum(x.d * y.d) AS sxy FROM dos x JOIN dos y ON x.chr = y.chr AND x.s = y.s AND y.pos > x.pos AND y.pos - x.pos <= 50000 GROUP BY 1, 2, 3),
hh AS (SELECT x.v AS v1, y.v AS v2, sum(x.a) / 40.0 AS p, sum(y.a) / 40.0 AS q, sum(x.a * y.a) / 40.0 AS pq FROM hap x JOIN hap y ON x.chr = y.chr AND x.h = y.h AND y.pos > x.pos AND y.pos - x.pos <= 50000 GROUP BY 1, 2),
r AS (SELECT a.variant_id AS variant1, b.variant_id AS variant2, 1.0 * (m * sxy - sx * sy) * (m * sxy - sx * sy) / ((m * sxx - sx * sx) * (m * syy - sy * sy)) AS r2,
    abs(pq - p * q) / CASE WHEN pq - p * q >= 0 THEN least(p * (1 - q), q * (1 - p)) ELSE least(p * q, (1 - p) * (1 - q)) END AS dp, distance
    FROM pr JOIN hh USING (v1, v2) JOIN focal a ON a.v = v1 JOIN focal b ON b.v = v2 WHERE m * sxx > sx * sx AND m * syy > sy * sy)
SELECT variant1, variant2, {_fix('r2')} AS r2, {_fix('least(dp, 1)')} AS dprime, distance FROM r WHERE r2 >= 0.1"""


@query(_ld)
def ld_pairs(c):
    return hp.ld(c, None, None, None, "POP0", max_dist=50_000, r2_threshold=0.1)


NSL = """pairs AS (SELECT x.chr, x.i, x.n, x.h AS h1, y.h AS h2, x.a, x.a = y.a AS same FROM hap x JOIN hap y ON x.chr = y.chr AND x.i = y.i AND x.h < y.h),
len AS (SELECT chr, i, a, same, i - coalesce(max(CASE WHEN NOT same THEN i END) OVER (PARTITION BY chr, h1, h2 ORDER BY i), -1) + coalesce(min(CASE WHEN NOT same THEN i END) OVER (PARTITION BY chr, h1, h2 ORDER BY i DESC), n) - i AS l FROM pairs),
sl AS (SELECT chr, i, avg(l) FILTER (same AND a = 0) AS s0, avg(l) FILTER (same AND a = 1) AS s1 FROM len GROUP BY 1, 2),
nsl AS (SELECT variant_id, chr, pos, af, ln(s1 / s0) AS nsl_unstd, least(CAST(floor(af * 20) AS INTEGER), 19) AS bin FROM sl JOIN focal USING (chr, i) WHERE s0 > 0 AND s1 > 0),
score AS (SELECT *, CASE WHEN coalesce(stddev_samp(nsl_unstd) OVER b, 1) = 0 THEN 0 ELSE (nsl_unstd - avg(nsl_unstd) OVER b) / coalesce(stddev_samp(nsl_unstd) OVER b, 1) END AS nsl FROM nsl WINDOW b AS (PARTITION BY bin))"""


@query(f", {HAP.format(where='''variant_type = 'SNP' AND ac BETWEEN 2 AND 38''')}, {NSL} SELECT variant_id, chr, pos, {_fix('af')} AS af, {_fix('nsl_unstd')} AS nsl_unstd, {_fix('nsl')} AS nsl FROM score")
def nsl(c):
    return hp.nsl(c, "POP0")


GARUD = f""", {HAP.format(where="variant_type = 'SNP'")}, {WINDOW_SQL.format(sites='focal', w=50_000, s=25_000)},
pat AS (SELECT chr, first_ + k * 25000 AS start, h, string_agg(CAST(hap.a AS VARCHAR), '' ORDER BY s.pos) AS p, count(*) AS n_variants FROM s JOIN hap USING (chr, v) GROUP BY 1, 2, 3),
cnt AS (SELECT chr, start, p, count(*) / 40.0 AS f, any_value(n_variants) AS n_variants, row_number() OVER (PARTITION BY chr, start ORDER BY count(*) DESC, p) AS r FROM pat GROUP BY 1, 2, 3),
gar AS (SELECT chr, CAST(start AS BIGINT) AS start, sum(f * f) AS h1, coalesce(2 * max(f) FILTER (r = 1) * max(f) FILTER (r = 2), 0) AS extra, max(f) FILTER (r = 1) AS top, count(*) AS n_haplotypes, any_value(n_variants) AS n_variants FROM cnt GROUP BY 1, 2),
garud AS (SELECT chr, start, start + 49999 AS "end", 'POP0' AS population, {_fix('h1')} AS h1, {_fix('h1 + extra')} AS h12, {_fix('(h1 - top * top) / h1')} AS h2_h1, {_fix('(1 - h1) * 40 / 39.0')} AS hap_diversity, n_haplotypes, n_variants FROM gar)"""


@query(GARUD + " SELECT * FROM garud")
def garud_h(c):
    return hp.garud_h(c, "POP0", 50_000, 25_000)


# extended homozygosity by pairs: on how many sites beyond the focal one a pair agrees (len), hence the share of pairs that agree as far as each site (ehh)
def _area(hap: str, name: str, classes: bool) -> str:
    own = "CASE WHEN x.a = y.a THEN x.a END" if classes else "0"
    return f"""{name}_pair AS (SELECT x.chr, x.i, x.n, x.h AS h1, y.h AS h2, {own} AS cls, x.a <> y.a AS differ FROM {hap} x JOIN {hap} y ON x.chr = y.chr AND x.i = y.i AND x.h < y.h),
{name}_len AS (SELECT chr, i, n, cls, coalesce(min(CASE WHEN differ THEN i END) OVER (PARTITION BY chr, h1, h2 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) - i - 1 AS f,
    i - coalesce(max(CASE WHEN differ THEN i END) OVER (PARTITION BY chr, h1, h2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS b FROM {name}_pair),
{name}_count AS (SELECT chr, i, n, cls, dir, len, count(*) AS k FROM (SELECT chr, i, n, cls, unnest([1, -1]) AS dir, unnest([f, b]) AS len FROM {name}_len WHERE cls IS NOT NULL) GROUP BY ALL),
{name}_total AS (SELECT chr, i, n, cls, dir, sum(k) AS pairs, max(len) AS top FROM {name}_count GROUP BY ALL),
{name}_reach AS (SELECT chr, i, cls, dir, t, sum(k) AS k FROM (SELECT chr, i, cls, dir, k, unnest(range(1, len + 1)) AS t FROM {name}_count) GROUP BY ALL),
{name}_grid AS (SELECT chr, i, cls, dir, pairs, unnest(range(1, least(top + 1, CASE WHEN dir = 1 THEN n - 1 - i ELSE i END) + 1)) AS t FROM {name}_total),
{name}_ehh AS (SELECT g.*, CASE WHEN 1.0 * coalesce(r.k, 0) / g.pairs < 0.05 THEN 0.0 ELSE 1.0 * coalesce(r.k, 0) / g.pairs END AS ehh FROM {name}_grid g LEFT JOIN {name}_reach r USING (chr, i, cls, dir, t)),
{name}_walk AS (SELECT e.*, coalesce(lag(ehh) OVER w, 1.0) AS before, coalesce(min(ehh) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) > 0 AS open, abs(s.pos - p.pos) AS gap
    FROM {name}_ehh e JOIN {name}_site s ON s.chr = e.chr AND s.i = e.i + e.dir * e.t JOIN {name}_site p ON p.chr = e.chr AND p.i = e.i + e.dir * (e.t - 1) WINDOW w AS (PARTITION BY e.chr, e.i, e.cls, e.dir ORDER BY e.t)),
{name}_area AS (SELECT t.chr, t.i, t.cls, CASE WHEN max(gap) > 200000 THEN -1 ELSE coalesce(sum((ehh + before) / 2 * least(gap, 20000)), 0) END AS area FROM (SELECT DISTINCT chr, i, cls FROM {name}_total) t LEFT JOIN (SELECT * FROM {name}_walk WHERE open) w USING (chr, i, cls) GROUP BY ALL)"""


_ihs = f""", {HAP.format(where="variant_type = 'SNP' AND ac BETWEEN 1 AND 39")}, one_site AS (SELECT chr, i, pos FROM focal), {_area('hap', 'one', True)},
un AS (SELECT variant_id, chr, pos, af, ln(max(area) FILTER (cls = 0) / max(area) FILTER (cls = 1)) AS ihs_unstd, least(CAST(floor(af * 20) AS INTEGER), 19) AS bin
    FROM focal JOIN one_area USING (chr, i) WHERE ac BETWEEN 2 AND 38 GROUP BY ALL HAVING max(area) FILTER (cls = 0) > 0 AND max(area) FILTER (cls = 1) > 0)
SELECT variant_id, chr, pos, {_fix('af')} AS af, {_fix('ihs_unstd')} AS ihs_unstd, {_fix('CASE WHEN coalesce(stddev_samp(ihs_unstd) OVER w, 1) = 0 THEN 0 ELSE (ihs_unstd - avg(ihs_unstd) OVER w) / coalesce(stddev_samp(ihs_unstd) OVER w, 1) END')} AS ihs FROM un WINDOW w AS (PARTITION BY bin)"""


@query(_ihs)
def ihs(c):
    return hp.ihs(c, "POP0")


_xp = f""", shared AS (SELECT a.v, a.chr, a.pos, a.variant_id, a.ac / 40.0 AS af1, b.ac / 40.0 AS af2, row_number() OVER (PARTITION BY a.chr ORDER BY a.pos) - 1 AS i, count(*) OVER (PARTITION BY a.chr) AS n
    FROM variant_pop a JOIN variant_pop b USING (v) WHERE a.pop = 'POP0' AND b.pop = 'POP1' AND a.variant_type = 'SNP' AND a.ac BETWEEN 1 AND 39 AND b.ac BETWEEN 1 AND 39),
hap0 AS (SELECT f.chr, f.i, f.n, CAST(h AS INTEGER) AS h, CASE WHEN gt = 2 OR (gt = 1 AND phase = h % 2) THEN 1 ELSE 0 END AS a FROM shared f CROSS JOIN range(40) t(h) LEFT JOIN genotype g ON g.v = f.v AND g.sample = (h // 2) * 5),
hap1 AS (SELECT f.chr, f.i, f.n, CAST(h AS INTEGER) AS h, CASE WHEN gt = 2 OR (gt = 1 AND phase = h % 2) THEN 1 ELSE 0 END AS a FROM shared f CROSS JOIN range(40) t(h) LEFT JOIN genotype g ON g.v = f.v AND g.sample = (h // 2) * 5 + 1),
one_site AS (SELECT chr, i, pos FROM shared), two_site AS (SELECT chr, i, pos FROM shared), {_area('hap0', 'one', False)}, {_area('hap1', 'two', False)},
un AS (SELECT variant_id, chr, pos, af1, af2, ln(one_area.area / two_area.area) AS x FROM shared JOIN one_area USING (chr, i) JOIN two_area USING (chr, i) WHERE one_area.area > 0 AND two_area.area > 0)
SELECT variant_id, chr, pos, {_fix('af1')} AS af_pop1, {_fix('af2')} AS af_pop2, {_fix('x')} AS xpehh_unstd, {_fix('(x - avg(x) OVER ()) / stddev_samp(x) OVER ()')} AS xpehh FROM un"""


@query(_xp)
def xpehh(c):
    return hp.xpehh(c, "POP0", "POP1")


# Viterbi by recursion over the sites: scores of both states, and the state before each
_hmm = f""", {HAP.format(where="variant_type = 'SNP' AND chr = 'chr1' AND ac BETWEEN 1 AND 39")},
obs AS (SELECT f.i, f.n, f.pos, h.s, least(greatest(f.af, 0.001), 0.999) AS p, h.d FROM focal f JOIN (SELECT i, h // 2 AS s, sum(a) AS d FROM hap GROUP BY ALL) h USING (i)),
em AS (SELECT i, n, pos, s, CASE d WHEN 0 THEN 2 * ln(1 - p) WHEN 1 THEN ln(2 * p * (1 - p)) ELSE 2 * ln(p) END AS e0, CASE d WHEN 0 THEN ln(1 - p) WHEN 1 THEN ln(0.001) ELSE ln(p) END AS e1 FROM obs),
step AS (SELECT *, 1 - pow(1 - CAST(7.2e-8 AS DOUBLE), CAST(pos - lag(pos) OVER (PARTITION BY s ORDER BY i) AS DOUBLE)) AS moved FROM em),
lv AS (SELECT *, least(greatest(67.0 / 72.0 * moved, 1e-10), 1 - 1e-10) AS l0, least(greatest(5.0 / 72.0 * moved, 1e-10), 1 - 1e-10) AS l1 FROM step),
vit(i, s, s0, s1, b0, b1) AS (
  SELECT i, s, ln(5.0 / 72.0) + e0, ln(67.0 / 72.0) + e1, 0, 1 FROM em WHERE i = 0
  UNION ALL
  SELECT lv.i, lv.s, greatest(s0 + ln(1 - l0), s1 + ln(l1)) + e0, greatest(s1 + ln(1 - l1), s0 + ln(l0)) + e1, CASE WHEN s0 + ln(1 - l0) >= s1 + ln(l1) THEN 0 ELSE 1 END, CASE WHEN s1 + ln(1 - l1) >= s0 + ln(l0) THEN 1 ELSE 0 END
  FROM vit JOIN lv ON lv.s = vit.s AND lv.i = vit.i + 1),
path(i, s, state) AS (
  SELECT i, s, CASE WHEN s1 >= s0 THEN 1 ELSE 0 END FROM vit WHERE i = (SELECT max(i) FROM vit)
  UNION ALL
  SELECT vit.i - 1, vit.s, CASE WHEN path.state = 1 THEN b1 ELSE b0 END FROM path JOIN vit ON vit.s = path.s AND vit.i = path.i WHERE vit.i > 0),
isl AS (SELECT path.s, pos, i - row_number() OVER (PARTITION BY path.s ORDER BY i) AS g FROM path JOIN focal USING (i) WHERE state = 1),
seg AS (SELECT s, max(pos) - min(pos) AS len FROM isl GROUP BY s, g HAVING max(pos) - min(pos) >= 10000 AND count(*) >= 5)
SELECT CAST(t.s * 5 AS INTEGER) AS sample, count(len) AS n_roh, CAST(coalesce(sum(len), 0) AS BIGINT) AS total_length, {_fix('coalesce(sum(len), 0) / 248956422.0')} AS froh, {_fix('coalesce(avg(len), 0)')} AS mean_length, CAST(coalesce(max(len), 0) AS BIGINT) AS max_length
FROM (SELECT DISTINCT s FROM em) t LEFT JOIN seg USING (s) GROUP BY 1"""


@query(_hmm)
def roh_hmm(c):
    return hp.roh(c, "POP0", "chr1", min_length=10_000, min_snps=5)


_roh = f""", {HAP.format(where="variant_type = 'SNP' AND chr = 'chr1'")}, het AS (SELECT i, n, pos, h // 2 AS s, CAST(sum(a) = 1 AS INT) AS het FROM hap GROUP BY 1, 2, 3, 4),
win AS (SELECT *, CASE WHEN i <= n - 20 THEN CAST(sum(het) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) <= 4 AS INT) END AS hit FROM het),
rate AS (SELECT *, avg(hit) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 0.3 AS good FROM win),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY s ORDER BY i) AS g FROM rate WHERE good),
seg AS (SELECT s, max(pos) - min(pos) AS len FROM isl GROUP BY s, g HAVING max(pos) - min(pos) >= 15000 AND count(*) >= 15)
SELECT CAST(t.s * 5 AS INTEGER) AS sample, count(len) AS n_roh, CAST(coalesce(sum(len), 0) AS BIGINT) AS total_length, {_fix('coalesce(sum(len), 0) / 248956422.0')} AS froh, {_fix('coalesce(avg(len), 0)')} AS mean_length, CAST(coalesce(max(len), 0) AS BIGINT) AS max_length
FROM (SELECT DISTINCT s FROM het) t LEFT JOIN seg USING (s) GROUP BY 1"""


@query(_roh)
def roh_window(c):
    return hp.roh(c, "POP0", "chr1", "window", min_length=15_000, min_snps=15, window_snps=20, max_het=4, window_threshold=0.3)


# ---------------------------------------------------------------- saved results that verbs read


def scores(c):
    """Site Fst of POP0 against POP1 and POP2, saved as scores of POP0."""
    if "scores" not in c._kept:
        parts = []
        for stat, pop in (("fst1", "POP1"), ("fst2", "POP2")):
            site = ph.k.with_pair_terms(ph._pair_sites(c, "POP0", pop), "1", "2").join(c.variant.select("v", "variant_id", "chr", "pos"), "v")
            parts.append(site.select("variant_id", "chr", "pos", F.lit(stat).alias("stat"), F.lit("POP0").alias("pop"), F.round(ph.k.ratio(F.col("hn"), F.col("hd")), 9).alias("value")))
        c._kept["scores"] = parts[0].union(parts[1]).persist()
    return c._kept["scores"]


SCORES = f"""{wide()}, sc AS (SELECT v, variant_id, chr, pos, {pair_sql('1', '2')}, {pair_sql('1', '3', '13')} FROM wide),
scores AS (SELECT v, variant_id, chr, pos, 'fst1' AS stat, CASE WHEN hd > 0 THEN round(hn / hd, 9) ELSE 0 END AS value FROM sc UNION ALL SELECT v, variant_id, chr, pos, 'fst2', CASE WHEN hd13 > 0 THEN round(hn13 / hd13, 9) ELSE 0 END FROM sc)"""

# ---------------------------------------------------------------- lookup and extract

PATHWAYS = "ways AS (SELECT gene, string_agg(pathway, ',' ORDER BY pathway) AS pathways FROM (SELECT DISTINCT gene, pathway FROM in_pathway) GROUP BY 1)"


@query(f", {PATHWAYS} SELECT gene, symbol, variant_id, chr, pos, consequence, impact, pathways FROM has_consequence JOIN gene USING (gene) JOIN (SELECT v, variant_id, chr, pos FROM variant) USING (v) LEFT JOIN ways USING (gene) WHERE gene = 'G3' OR symbol = 'G3'")
def lookup_gene(c):
    return vb.lookup_gene(c, "G3")


@query(" SELECT p.pathway, p.gene, symbol, coalesce(n, 0) AS variant_count FROM in_pathway p JOIN gene USING (gene) LEFT JOIN (SELECT gene, count(DISTINCT v) AS n FROM has_consequence GROUP BY 1) USING (gene) WHERE contains(pathway, 'AS')")
def lookup_pathway(c):
    return vb.lookup_pathway(c, "AS")


@query(f", {PATHWAYS} SELECT variant_id, chr, pos, variant_type, ancestral, gene, symbol, consequence, impact, pathways FROM variant LEFT JOIN has_consequence USING (v) LEFT JOIN gene USING (gene) LEFT JOIN ways USING (gene) WHERE v = 8")
def lookup_variant(c):
    return vb.lookup_variant(c, "chr1:3296:A:T")


@query(" SELECT coalesce(symbol, 'intergenic') AS symbol, count(DISTINCT v) AS variant_count, min(pos) AS first_pos, max(pos) AS last_pos FROM variant LEFT JOIN has_consequence USING (v) LEFT JOIN gene USING (gene) WHERE chr = 'chr2' AND pos BETWEEN 5000 AND 60000 GROUP BY 1")
def lookup_region(c):
    return vb.lookup_region(c, "chr2", 5000, 60_000)


NEAR = "near AS (SELECT a.gene, b.gene AS other, count(*) AS w FROM {t} a JOIN {t} b USING ({k}) WHERE a.gene <> b.gene GROUP BY 1, 2)"
_hops = {
    1: "SELECT other AS gene, CAST(w AS BIGINT) AS ways FROM near WHERE gene = 'G3'",
    2: "SELECT b.other AS gene, CAST(sum(a.w * b.w) AS BIGINT) AS ways FROM near a JOIN near b ON b.gene = a.other WHERE a.gene = 'G3' AND b.other <> 'G3' GROUP BY 1",
    3: "SELECT d.other AS gene, CAST(sum(a.w * b.w * d.w) AS BIGINT) AS ways FROM near a JOIN near b ON b.gene = a.other JOIN near d ON d.gene = b.other WHERE a.gene = 'G3' AND b.other <> 'G3' AND d.other <> 'G3' GROUP BY 1",
}
for _n in (1, 2, 3):
    for _name, _table, _key in (("pathway", "in_pathway", "pathway"), ("go", "has_go_term", "go")):

        def _f(c, table=_table, n=_n):
            return vb.neighbors(getattr(c, table), "G3", n)

        _f.__name__ = f"neighbors_{_name}_{_n}"
        query(f", {NEAR.format(t=_table, k=_key)} {_hops[_n]}")(_f)


@query(_ld.replace("SELECT variant1, variant2, round", "SELECT * FROM (SELECT variant1, variant2, round").replace(" FROM r WHERE r2 >= 0.1", " FROM r WHERE r2 >= 0.1) z").replace("\nSELECT * FROM (", "\n, zz AS (").replace(") z", ")") + ", bb AS (SELECT variant1 AS a, variant2 AS b, r2 FROM zz UNION ALL SELECT variant2, variant1, r2 FROM zz), nm AS (SELECT variant_id, gene FROM has_consequence JOIN variant USING (v)) SELECT y.gene, max(r2) AS max_r2 FROM bb JOIN nm x ON x.variant_id = a JOIN nm y ON y.variant_id = b WHERE x.gene = 'G3' AND y.gene <> 'G3' GROUP BY 1")
def neighbors_ld_1(c):
    return vb.ld_neighbors(c, ld_pairs(c), "G3")


@query(f" SELECT variant_id, chr, pos, variant_type, ac, an, {_fix('1.0 * ac / an')} AS af FROM variant_pop WHERE pop = 'POP1' AND chr = 'chr3' AND 1.0 * ac / an BETWEEN 0.1 AND 0.4 AND v IN (SELECT v FROM has_consequence WHERE consequence = 'missense_variant')")
def extract_variants(c):
    return vb.extract_variants(c, "POP1", "chr3", min_af=0.1, max_af=0.4, consequence="missense_variant")


@query(" SELECT sample, pop, CAST(20 AS BIGINT) AS n_samples FROM sample WHERE pop = 'POP2'")
def extract_samples(c):
    return vb.extract_samples(c, "POP2")


@query(" SELECT variant_id, s.sample, coalesce(gt, 0) AS dosage, CASE WHEN gt = 2 THEN '1|1' WHEN gt = 1 AND phase = 0 THEN '1|0' WHEN gt = 1 THEN '0|1' ELSE '0|0' END AS genotype FROM variant w CROSS JOIN (SELECT sample FROM sample WHERE pop = 'POP0') s LEFT JOIN genotype g ON g.v = w.v AND g.sample = s.sample")
def extract_genotypes(c):
    return vb.extract_genotypes(c, None, None, None, "POP0")


@query(" SELECT 'variant' AS label, count(*) AS n FROM variant" + "".join(f" UNION ALL SELECT '{t}', count(*) FROM {t}" for t in ("sample", "genotype", "gene", "has_consequence", "in_pathway", "has_go_term")) + " UNION ALL SELECT 'population', count(DISTINCT pop) FROM sample")
def inventory(c):
    return vb.inventory(c)


@query(" SELECT unnest(['repeated variant', 'genotype without variant', 'genotype without sample', 'consequence without gene', 'impossible count']) AS \"check\", CAST(0 AS BIGINT) AS n")
def validate(c):
    return vb.validate(c)


# ---------------------------------------------------------------- filter, converge, rank, compare


@query(f", {SCORES} SELECT variant_id, chr, pos, {_fix('value')} AS value FROM scores WHERE stat = 'fst1' AND abs(value) >= 0.02 AND v IN (SELECT v FROM has_consequence JOIN in_pathway USING (gene) WHERE consequence = 'missense_variant' AND contains(pathway, 'AS')) ORDER BY abs(value) DESC, variant_id LIMIT 100")
def filter_score(c):
    return vb.filter_scores(c, scores(c), "fst1", "POP0", consequence="missense_variant", pathway="AS", min_score=0.02, limit=100)


@query(f", {SCORES} SELECT a.variant_id, a.chr, a.pos, {_fix('a.value')} AS \"fst1_POP0\", {_fix('b.value')} AS \"fst2_POP0\" FROM scores a JOIN scores b ON a.v = b.v AND a.stat = 'fst1' AND b.stat = 'fst2' WHERE abs(a.value) >= 0.03 AND abs(b.value) >= 0.02")
def converge_variant(c):
    return vb.converge(scores(c), {("fst1", "POP0"): 0.03, ("fst2", "POP0"): 0.02})


_scan2 = f"""{windowed_sql(50_000, 25_000)}, {wide()}, p AS (SELECT v, {pair_sql('1', '2')}, {pair_sql('1', '3', '13')}, {pair_sql('2', '3', '23')} FROM wide), q AS (SELECT chr, first_, k, {FST_SQL}, {PBS_SQL} FROM s JOIN p USING (v) GROUP BY 1, 2, 3),
win AS (SELECT chr, start, "end", population, scan.*  EXCLUDE (chr, start, "end", population), fst_hudson AS fst, fst_wc, dxy, da, pbs FROM scan JOIN q USING (chr, first_, k))"""


def scan2(c):
    return rounded(dv.genome_scan(c, "POP0", 50_000, 25_000, pop2="POP1", pop3="POP2"))


@query(_scan2 + " SELECT chr, start, \"end\", pi, tajima_d, fst FROM win WHERE pi >= 0.2 AND tajima_d <= 1")
def converge_window(c):
    return vb.converge_windows(scan2(c), {"pi": 0.2}, {"tajima_d": 1.0}).select("chr", "start", "end", "pi", "tajima_d", "fst")


@query(_scan2 + ", cut AS (SELECT quantile_cont(pbs, 0.9) AS x FROM win) SELECT chr, start, \"end\", pbs FROM win, cut WHERE pbs >= x")
def pbs_outliers(c):
    return ph.outlier_windows(scan2(c), "pbs", 0.9).select("chr", "start", "end", "pbs")


@query(_scan2 + ", cut AS (SELECT quantile_cont(pbs, 0.9) AS x FROM win), hit AS (SELECT DISTINCT gene, chr, start, pbs FROM has_consequence JOIN variant USING (v) JOIN (SELECT chr, start, \"end\", pbs FROM win, cut WHERE pbs >= x) w USING (chr) WHERE pos BETWEEN start AND \"end\") SELECT gene, max(pbs) AS max_pbs, count(*) AS n_windows FROM hit GROUP BY 1")
def pbs_genes(c):
    return ph.window_genes(c, ph.outlier_windows(scan2(c), "pbs", 0.9), "pbs")


_top = _scan2 + ", cut AS (SELECT quantile_cont(pbs, 0.9) AS x FROM win), o AS (SELECT chr, start, \"end\", pbs FROM win, cut WHERE pbs >= x)"
PEAKS = _top + """, m AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o),
isl AS (SELECT *, sum(CASE WHEN last IS NULL OR start - last > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, "end") AS g FROM m)"""


@query(PEAKS + f" SELECT chr, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n, {_fix('avg(abs(pbs))')} AS mean_score, max(abs(pbs)) AS max_score, arg_max(start, abs(pbs) * 1e9 - start * 1e-9) AS peak FROM isl GROUP BY chr, g")
def export_bed_peaks(c):
    return vb.call_peaks(ph.outlier_windows(scan2(c), "pbs", 0.9), "pbs", 30_000)


@query(_top + f", dd AS (SELECT v, chr, pos, CASE ancestral WHEN 'REF' THEN 1.0 * ac / an ELSE 1 - 1.0 * ac / an END AS daf FROM variant_pop WHERE pop = 'POP0' AND ancestral IS NOT NULL), z AS (SELECT daf, EXISTS (SELECT 1 FROM o WHERE o.chr = dd.chr AND dd.pos BETWEEN o.start AND o.\"end\") AS inside FROM dd) SELECT {_fix('avg(daf) FILTER (inside)')} AS peak_mean, {_fix('avg(daf) FILTER (NOT inside)')} AS background_mean, count(*) FILTER (inside) AS n_peak, count(*) FILTER (NOT inside) AS n_background, {_fix('avg(daf) FILTER (inside) / avg(daf) FILTER (NOT inside)')} AS ratio FROM z")
def daf_enrichment(c):
    return ph.daf_enrichment(c, ph.outlier_windows(scan2(c), "pbs", 0.9), "POP0")


@query(_scan2 + " SELECT chr, start, \"end\", pi, fst, tajima_d, place FROM (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY fst DESC, start) AS place FROM win) WHERE place <= 3")
def top_windows(c):
    from pyspark.sql import Window

    best = vb.top_k(scan2(c), "fst", 3, "start", by=["chr"])
    return best.select("chr", "start", "end", "pi", "fst", "tajima_d", F.row_number().over(Window.partitionBy("chr").orderBy(F.col("fst").desc(), "start")).cast("long").alias("place"))


@query(_scan2 + " SELECT chr, start, \"end\", n_variants, pi, fst, pbs FROM win WHERE chr = 'chr2' AND fst >= 0 AND n_variants >= 20")
def export_windows(c):
    return scan2(c).where("chr = 'chr2' AND fst >= 0 AND n_variants >= 20").select("chr", "start", "end", "n_variants", "pi", "fst", "pbs")


def _win(pop: str, name: str) -> str:
    return windowed_sql(50_000, 25_000).replace("POP0", pop).replace("terms AS", f"terms{name} AS").replace("FROM terms", f"FROM terms{name}")


@query(", a AS (WITH " + windowed_sql(50_000, 25_000)[2:] + " SELECT * FROM scan), b AS (WITH " + windowed_sql(50_000, 25_000)[2:].replace("POP0", "POP1") + f" SELECT * FROM scan) SELECT chr, start, \"end\", a.pi AS value, b.pi AS other, {_fix('a.pi - b.pi')} AS delta, {_fix('abs(a.pi - b.pi)')} AS abs_delta FROM a JOIN b USING (chr, start, \"end\")")
def compare_window(c):
    return vb.compare(rounded(dv.genome_scan(c, "POP0", 50_000, 25_000)), rounded(dv.genome_scan(c, "POP1", 50_000, 25_000)), "pi")


_rank = ", ".join(f"1.0 * (dense_rank() OVER (ORDER BY {x}) - 1) AS r{i}" for i, x in enumerate(("max_fst1", "max_fst2", "n_high")))


@query(f""", {SCORES}, hi AS (SELECT gene, count(*) FILTER (impact = 'HIGH') AS n_high, count(DISTINCT v) AS n_variants FROM has_consequence GROUP BY 1),
mx AS (SELECT gene, max(abs(value)) FILTER (stat = 'fst1') AS max_fst1, max(abs(value)) FILTER (stat = 'fst2') AS max_fst2 FROM has_consequence JOIN scores USING (v) GROUP BY 1),
j AS (SELECT gene, n_variants, n_high, coalesce(max_fst1, 0) AS max_fst1, coalesce(max_fst2, 0) AS max_fst2 FROM hi LEFT JOIN mx USING (gene)), rk AS (SELECT *, {_rank} FROM j),
t AS (SELECT max(r0) AS t0, max(r1) AS t1, max(r2) AS t2 FROM rk)
SELECT gene, n_variants, n_high, {_fix('max_fst1')} AS max_fst1, {_fix('max_fst2')} AS max_fst2, {_fix('r0 / t0 + r1 / t1 + r2 / t2')} AS composite FROM rk, t""")
def rank_genes(c):
    return vb.rank_genes(c, scores(c), ["fst1", "fst2"], "POP0")


# ---------------------------------------------------------------- post-hoc

_gene = f", {wide()}, p AS (SELECT v, {pair_sql('1', '2')} FROM wide)"
_fst0 = _fix("greatest(0, CASE WHEN sum(hd) > 0 THEN sum(hn) / sum(hd) ELSE 0 END)")


@query(f"{_gene} SELECT gene, {_fst0} AS fst, count(*) AS n_variants FROM has_consequence JOIN p USING (v) GROUP BY 1 HAVING count(*) >= 5")
def gene_fst(c):
    return ph.gene_fst(c, "POP0", "POP1")


@query(f"{_gene} SELECT pathway, {_fst0} AS fst, count(*) AS n_variants FROM (SELECT DISTINCT pathway, v FROM in_pathway JOIN has_consequence USING (gene)) JOIN p USING (v) GROUP BY 1 HAVING count(*) >= 5")
def pathway_fst(c):
    return ph.pathway_fst(c, "POP0", "POP1")


@query(f", {wide()}, p AS (SELECT v, (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / 19 - p2 * (1 - p2) / 19 AS hn, p1 * (1 - p2) + p2 * (1 - p1) AS hd FROM (SELECT v, ac1 / 40.0 AS p1, ac2 / 40.0 AS p2 FROM wide)) SELECT pathway, {_fst0} AS fst, count(*) AS n_variants FROM (SELECT DISTINCT pathway, v FROM in_pathway JOIN has_consequence USING (gene)) JOIN p USING (v) GROUP BY 1 HAVING count(*) >= 5")
def pathway_fst_diploid(c):
    return ph.pathway_fst(c, "POP0", "POP1", diploid=True)


_enr = f"""{_gene}, gf AS (SELECT gene, greatest(0, sum(hn) / sum(hd)) AS fst FROM has_consequence JOIN p USING (v) GROUP BY 1 HAVING count(*) >= 5),
ch AS (SELECT gene FROM gf WHERE fst > 0.003), tot AS (SELECT (SELECT count(*) FROM gene) AS n, (SELECT count(*) FROM ch) AS m),
tm AS (SELECT go AS term, count(*) AS size, count(ch.gene) AS a FROM has_go_term LEFT JOIN ch USING (gene) GROUP BY 1 HAVING count(*) >= 5),
pv AS (SELECT term, size, a, least(1, sum(exp(lgamma(size + 1) - lgamma(x + 1) - lgamma(size - x + 1) + lgamma(n - size + 1) - lgamma(m - x + 1) - lgamma(n - size - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)))) AS p
  FROM (SELECT *, unnest(range(a, least(size, m) + 1)) AS x FROM tm, tot) WHERE n - size - m + x >= 0 GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (ORDER BY round(p, 9), term) AS r, count(*) OVER () AS k FROM pv)
SELECT term, size AS n_genes, a AS n_hits, {_fix('p')} AS p, {_fix('least(1, min(p * k / r) OVER (ORDER BY r DESC))')} AS q FROM rk"""


@query(_enr)
def go_enrichment(c):
    return ph.enrichment(c.has_go_term.withColumnRenamed("go", "term"), ph.gene_fst(c, "POP0", "POP1").where("fst > 0.003"), c.gene)


@query(" SELECT pop, count(*) FILTER (total = ac) AS n_private, count(*) AS n_rare FROM variant_pop JOIN (SELECT v, sum(ac) AS total FROM variant_pop GROUP BY 1) USING (v) WHERE ac BETWEEN 1 AND 4 AND 1.0 * ac / an < 0.1 GROUP BY 1")
def private_rare_burden(c):
    return ph.private_rare(c)


@query(f", kd AS (SELECT DISTINCT v, consequence FROM has_consequence WHERE consequence <> 'intron_variant'), st AS (SELECT pop, chr, consequence, 2.0 * ac / an * (1 - 1.0 * ac / an) * an / (an - 1) AS pi FROM variant_pop JOIN kd USING (v)), z AS (SELECT pop, chr, avg(pi) FILTER (consequence = 'missense_variant') AS n, avg(pi) FILTER (consequence = 'synonymous_variant') AS s FROM st GROUP BY 1, 2) SELECT pop, chr, {_fix('n')} AS pi_n, {_fix('s')} AS pi_s, {_fix('n / s')} AS pin_pis FROM z")
def pinpis(c):
    return ph.pin_pis(c)


@query(f"{_gene}, f AS (SELECT *, CASE WHEN hd > 0 THEN round(hn / hd, 9) ELSE 0 END AS fst FROM p), own AS (SELECT v, impact, hn, hd, fst FROM (SELECT DISTINCT v, impact FROM has_consequence) JOIN f USING (v)), rk AS (SELECT *, rank() OVER (ORDER BY fst) + (count(*) OVER (PARTITION BY fst) - 1) / 2.0 AS r FROM own) SELECT impact, {_fix('sum(hn) / sum(hd)')} AS fst, {_fix('avg(fst)')} AS mean_site_fst, count(*) AS n, {_fix('sum(r) - count(*) * (count(*) + 1) / 2.0')} AS u FROM rk GROUP BY 1")
def consequence_bias(c):
    return ph.consequence_bias(c, "POP0", "POP1")


@query(_scan2 + f", rk AS (SELECT rank() OVER (ORDER BY pi) + (count(*) OVER (PARTITION BY pi) - 1) / 2.0 AS a, rank() OVER (ORDER BY fst) + (count(*) OVER (PARTITION BY fst) - 1) / 2.0 AS b FROM win) SELECT {_fix('corr(a, b)')} AS rho, count(*) AS n FROM rk")
def spearman_stats(c):
    return ph.spearman(scan2(c), "pi", "fst")


_burden = """, af AS (SELECT v, sum(ac) / 500.0 * 2.5 AS af FROM variant_pop GROUP BY 1), ms AS (SELECT DISTINCT v FROM has_consequence WHERE consequence = 'missense_variant'),
g AS (SELECT sample, gt, af < 0.1 AS rare, ms.v IS NOT NULL AS m FROM genotype JOIN (SELECT v FROM variant WHERE variant_type = 'SNP') USING (v) JOIN af USING (v) LEFT JOIN ms USING (v)),
bu AS (SELECT sample, pop, coalesce(count(*) FILTER (gt = 1), 0) / (SELECT CAST(count(*) AS DOUBLE) FROM variant WHERE variant_type = 'SNP') AS het_rate, CAST(coalesce(sum(gt) FILTER (rare), 0) AS BIGINT) AS rare_alleles, count(*) FILTER (rare AND m) AS rare_missense FROM sample JOIN g USING (sample) GROUP BY 1, 2)""".replace("sum(ac) / 500.0 * 2.5", "sum(ac) / 200.0")


@query(_burden + f" SELECT sample, pop, {_fix('het_rate')} AS het_rate, rare_alleles, rare_missense FROM bu")
def individual_burden(c):
    return ph.individual_burden(c)


@query(_burden + f", d AS (SELECT *, sqrt(pow((het_rate - avg(het_rate) OVER w) / stddev_pop(het_rate) OVER w, 2) + pow((rare_alleles - avg(rare_alleles) OVER w) / stddev_pop(rare_alleles) OVER w, 2)) AS distance FROM bu WINDOW w AS (PARTITION BY pop)) SELECT sample, pop, {_fix('distance')} AS distance, {_fix('(distance - avg(distance) OVER w) / stddev_pop(distance) OVER w')} AS z FROM d WINDOW w AS (PARTITION BY pop)")
def sample_outliers(c):
    return ph.centroid_outliers(ph.individual_burden(c), ["het_rate", "rare_alleles"]).select("sample", "pop", "distance", "z")


@query(GARUD + " SELECT chr, start, h12, h2_h1, CASE WHEN h2_h1 < 0.6 THEN 'hard' ELSE 'soft' END AS sweep_type FROM garud WHERE h12 > 0.026")
def sweep_types(c):
    return ph.sweep_type(rounded(hp.garud_h(c, "POP0", 50_000, 25_000)), least=0.026, hard=0.6).select("chr", "start", "h12", "h2_h1", "sweep_type")


@query(f", {SCORES}, b AS (SELECT CAST(floor((pos - 200000) / 20000.0) AS BIGINT) AS bin, avg(value) AS x FROM scores WHERE stat = 'fst1' AND chr = 'chr1' GROUP BY 1), f AS (SELECT max(x) AS peak, greatest(max(x) * 0.5, avg(x) + 2 * stddev_pop(x)) AS cut FROM b) SELECT {_fix('any_value(peak)')} AS peak, {_fix('any_value(cut)')} AS cut, (max(bin) FILTER (bin < 0) + 1) * 20000 + 200000 AS start, min(bin) FILTER (bin >= 0) * 20000 + 200000 - 1 AS \"end\" FROM b, f WHERE x < cut")
def sweep_extent(c):
    return ph.sweep_extent(scores(c).where("stat = 'fst1' AND chr = 'chr1'"), 200_000, "value", 20_000)


_pi = "2.0 * ac / an * (1 - 1.0 * ac / an) * an / (an - 1)"


@query(f", m AS (SELECT chr, pop, round(avg({_pi}), 9) AS x FROM variant_pop GROUP BY 1, 2), r AS (SELECT *, 1.0 * row_number() OVER (PARTITION BY chr ORDER BY x, pop) AS r FROM m) SELECT a.chr, b.chr AS other, {_fix('corr(a.r, b.r)')} AS rho FROM r a JOIN r b ON a.pop = b.pop AND a.chr < b.chr GROUP BY 1, 2 HAVING abs(corr(a.r, b.r)) >= 0.35")
def coselection(c):
    pi = dv.pop_summary(c).select("chr", "pop", F.round("pi", 9).alias("x"))
    return ph.coselection(pi, "chr", "pop", "x", 0.35)


# ---------------------------------------------------------------- comparisons over all populations


def each_population(f):
    """Union of f(population) over POP0 to POP4."""
    one, *others = (f(f"POP{i}") for i in range(5))
    for x in others:
        one = one.unionByName(x)
    return one


@query()
def convergent_sweeps(c):
    return ph.convergent_sweeps(c, rounded(each_population(lambda p: hp.garud_h(c, p, 50_000, 25_000))), 0.03, 2)


@query()
def temporal_strata(c):
    windows = each_population(lambda p: dv.genome_scan(c, p, 50_000, 25_000).select("population", "tajima_d", "fay_wu_h"))
    return ph.temporal_strata(rounded(windows), {"recent": ("tajima_d", 0.5), "old": ("fay_wu_h", -0.5)})
