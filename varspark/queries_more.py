"""Registered queries over files written and read back, gene and individual analyses, and summaries, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import divergence as dg
from .operators import haplotypes as hp
from .operators import posthoc as ph
from .operators import verbs as vb
from .plans.cohort import COHORT_SQL
from .queries_fast import ORACLE, QUERIES, query, rounded, windowed_sql
from .queries_full import GARUD, PEAKS, SCORES, _burden, _fix, _fst0, _gene, each_population, scan2, scores
from .sources import annotations, sinks
from .sources.variants import vcf_cohort

__all__ = ["ORACLE", "QUERIES"]

# ---------------------------------------------------------------- files


def _from_files(c):
    """The cohort written as text files and read back."""
    spark = c.variant.sparkSession
    at = sinks.scratch_folder(spark, "files")
    sinks.write_vcf(c, f"{at}/calls.vcf")
    sinks.write_panel(c, f"{at}/panel.tsv")
    sinks.write_ancestral(c, f"{at}/ancestral.fa")
    return vcf_cohort(spark, f"{at}/calls.vcf", f"{at}/panel.tsv", fasta=f"{at}/ancestral.fa"), f"{at}/calls.vcf"


@query(" SELECT variant_id, chr, pos, 'SNP' AS variant_type, ancestral, pop, ac, an, het, hom FROM variant_pop")
def vcf_round_trip(c):
    return _from_files(c)[0].variant_pop.select("variant_id", "chr", "pos", "variant_type", "ancestral", "pop", "ac", "an", "het", "hom")


@query(" SELECT variant_id, CAST(sample AS VARCHAR) AS sample, gt, CASE WHEN gt = 1 THEN phase ELSE -1 END AS phase FROM genotype JOIN variant USING (v)")
def vcf_genotypes(c):
    got = _from_files(c)[0].genotype
    return got.select(F.col("v").alias("variant_id"), "sample", "gt", F.when(F.col("gt") == 1, F.col("phase").cast("long")).otherwise(-1).alias("phase"))


@query(" SELECT variant_id, gene, symbol, consequence, impact FROM has_consequence JOIN variant USING (v) JOIN gene USING (gene)")
def effects_round_trip(c):
    spark = c.variant.sparkSession
    path = sinks.scratch_folder(spark, "effects")
    sinks.write_vcf(c, path)
    gene, effects = annotations.read_effects(spark, path, c.variant.select(F.col("variant_id").alias("v")))
    return effects.join(gene, "gene").select(F.col("v").alias("variant_id"), "gene", "symbol", "consequence", "impact")


@query(" SELECT 'pathway' AS kind, gene, pathway AS name FROM (SELECT DISTINCT gene, pathway FROM in_pathway) UNION ALL SELECT 'term', gene, go FROM (SELECT DISTINCT gene, go FROM has_go_term)")
def annotation_round_trip(c):
    spark = c.variant.sparkSession
    at = sinks.scratch_folder(spark, "annotations")
    sinks.write_annotations(c, f"{at}/pathways.tsv", f"{at}/terms.tsv")
    pathways, terms = annotations.read_pathways(spark, f"{at}/pathways.tsv", c.gene)[1], annotations.read_go(spark, f"{at}/terms.tsv", c.gene)[1]
    return pathways.select(F.lit("pathway").alias("kind"), "gene", F.col("pathway").alias("name")).union(terms.select(F.lit("term"), "gene", "go"))


@query(" SELECT variant_id, CAST(coalesce(sum(gt), 0) AS BIGINT) AS ac, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt = 2) AS hom, CAST(0 AS BIGINT) AS missing FROM variant LEFT JOIN genotype USING (v) GROUP BY 1")
def packed_round_trip(c):
    return sinks.unpacked_counts(sinks.packed_genotypes(c), c.sample.count())


@query(" SELECT variant_id, pop, ac, an FROM variant_pop")
def saved_round_trip(c):
    spark = c.variant.sparkSession
    path = sinks.scratch_folder(spark, "saved")
    sinks.save_cohort(c, path)
    return sinks.load_cohort(spark, path).variant_pop.select("variant_id", "pop", "ac", "an")


# ---------------------------------------------------------------- spectra


@query(" SELECT count(*) AS n_variants, coalesce(max(an), 0) AS max_ac, count(ancestral) AS n_polarized FROM variant_pop WHERE pop = 'POP0'")
def sfs_facts(c):
    return dg.sfs_facts(c, None, None, None, "POP0")


@query(" SELECT count(*) AS n_variants, 40 AS max_ac1, 40 AS max_ac2, 21 AS dim1, 21 AS dim2 FROM variant")
def joint_sfs_facts(c):
    return dg.joint_sfs_facts(c, None, None, None, "POP0", "POP1", folded=True)


# ---------------------------------------------------------------- genes and individuals

EXTENT = "extent AS (SELECT gene, chr, min(pos) AS s2, max(pos) AS e2 FROM has_consequence JOIN variant USING (v) GROUP BY 1, 2)"


@query(f"{GARUD}, {EXTENT} SELECT gene, count(*) AS n_windows, max(h12) AS max_h12, {_fix('avg(h12)')} AS mean_h12 FROM extent JOIN garud USING (chr) WHERE start <= e2 AND \"end\" >= s2 GROUP BY 1")
def gene_windows(c):
    return ph.gene_windows(c, rounded(hp.garud_h(c, "POP0", 50_000, 25_000)), ["h12"])


@query(PEAKS + """, pk AS (SELECT chr, min(start) AS ps, max("end") AS pe FROM isl GROUP BY chr, g),
rk AS (SELECT v, gene, consequence, impact, CASE impact WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 WHEN 'MODIFIER' THEN 4 ELSE 99 END AS r FROM has_consequence),
bs AS (SELECT chr, ps, pe, gene, r, consequence, impact, row_number() OVER (PARTITION BY chr, ps, pe, gene ORDER BY r, pos, consequence) AS one FROM rk JOIN variant USING (v) JOIN pk USING (chr) WHERE pos BETWEEN ps - 10000 AND pe + 10000),
pl AS (SELECT *, row_number() OVER (PARTITION BY chr, ps, pe ORDER BY r, gene) AS place FROM bs WHERE one = 1)
SELECT chr, ps AS peak_start, pe AS peak_end, gene, symbol, impact, consequence, place FROM pl JOIN gene USING (gene) WHERE place <= 5""")
def peak_genes(c):
    peaks = vb.call_peaks(ph.outlier_windows(scan2(c), "pbs", 0.9), "pbs", 30_000)
    return ph.peak_genes(c, peaks, 10_000, 5)


@query(" SELECT pathway, CASE WHEN contains(lower(pathway), 'asia') OR contains(lower(pathway), 'china') THEN 'east' WHEN contains(lower(pathway), 'an') THEN 'an' ELSE 'other' END AS module FROM (SELECT DISTINCT pathway FROM in_pathway)")
def keyword_modules(c):
    return ph.keyword_modules(c.in_pathway.select("pathway").distinct(), "pathway", {"east": ["Asia", "China"], "an": ["an"]})


@query(_burden + f", z AS (SELECT sample, (het_rate - avg(het_rate) OVER ()) / stddev_pop(het_rate) OVER () AS a, (rare_alleles - avg(rare_alleles) OVER ()) / stddev_pop(rare_alleles) OVER () AS b FROM bu) SELECT sample, {_fix('(2 * a - b) / 3')} AS velocity FROM z")
def velocity(c):
    return ph.velocity(ph.individual_burden(c), "sample", {"het_rate": 2, "rare_alleles": -1})


@query(f"""{_gene}, pf AS (SELECT pathway, {_fst0} AS fst, count(*) AS n FROM (SELECT DISTINCT pathway, v FROM in_pathway JOIN has_consequence USING (gene)) JOIN p USING (v) GROUP BY 1 HAVING count(*) >= 5),
li AS (SELECT DISTINCT v, pathway FROM has_consequence JOIN in_pathway USING (gene) WHERE impact IN ('HIGH', 'MODERATE')), me AS (SELECT v, avg(fst) AS x FROM li JOIN pf USING (pathway) GROUP BY 1),
cu AS (SELECT quantile_cont(x, 0.25) AS low, quantile_cont(x, 0.75) AS high FROM me),
si AS (SELECT v, x FROM me WHERE v IN (SELECT v FROM has_consequence WHERE consequence = 'missense_variant') AND v IN (SELECT v FROM variant_pop GROUP BY 1 HAVING 1.0 * sum(ac) / sum(an) < 0.1))
SELECT sample, pop, count(*) FILTER (x <= low) AS constrained, count(*) FILTER (x >= high) AS divergent FROM sample LEFT JOIN (SELECT sample, x, low, high FROM genotype JOIN si USING (v), cu) USING (sample) GROUP BY 1, 2""")
def pathway_burden(c):
    return ph.pathway_burden(c, rounded(ph.pathway_fst(c, "POP0", "POP1")))


@query(f", {SCORES} SELECT variant_id, {_fix('a.value')} AS value, {_fix('b.value')} AS other, {_fix('a.value - b.value')} AS delta, {_fix('abs(a.value - b.value)')} AS abs_delta FROM scores a JOIN scores b USING (variant_id) WHERE a.stat = 'fst1' AND b.stat = 'fst2'")
def compare_variant(c):
    two = scores(c).withColumn("pop", F.col("stat")).withColumn("stat", F.lit("fst"))
    return vb.compare_variants(two, "fst", "fst1", "fst2")


# ---------------------------------------------------------------- summaries of all populations and chromosomes

COLUMNS = ["pi", "theta_w", "tajima_d"]
_summary = f"SELECT * FROM ({ORACLE['pop_summary_all']})"


@query(f" SELECT pop, count(*) AS n_chromosomes, {', '.join(f'{_fix(f"avg({x})")} AS {x}' for x in COLUMNS)} FROM ({_summary}) GROUP BY 1")
def population_means(c):
    from .operators.diversity import pop_summary

    return ph.population_means(rounded(pop_summary(c)), COLUMNS)


@query(" " + " UNION ALL ".join(f"SELECT '{x}' AS stat, pop, NULL AS pop2, chr, CAST({x} AS DOUBLE) AS value FROM ({_summary})" for x in COLUMNS) + f""" UNION ALL SELECT stat, pop1, pop2, chr, value FROM (
WITH s AS (SELECT a.chr, a.pop AS pop1, b.pop AS pop2, 1.0 * a.ac / a.an AS p1, 1.0 * b.ac / b.an AS p2, 1.0 * a.an AS n1, 1.0 * b.an AS n2 FROM variant_pop a JOIN variant_pop b ON a.v = b.v AND a.pop < b.pop),
t AS (SELECT *, 2 * p1 * (1 - p1) * n1 / (n1 - 1) AS h1, 2 * p2 * (1 - p2) * n2 / (n2 - 1) AS h2 FROM s),
f AS (SELECT chr, pop1, pop2, sum((p1 - p2) * (p1 - p2) - h1 / (2 * n1) - h2 / (2 * n2)) AS num, sum((p1 - p2) * (p1 - p2) - h1 / (2 * n1) - h2 / (2 * n2) + (h1 + h2) / 2) AS den, avg(p1 * (1 - p2) + p2 * (1 - p1)) AS dxy, avg((h1 + h2) / 2) AS within FROM t GROUP BY 1, 2, 3)
SELECT chr, pop1, pop2, unnest(['fst_hudson', 'dxy', 'da']) AS stat, unnest([{_fix('CASE WHEN den > 0 THEN num / den ELSE 0 END')}, {_fix('dxy')}, {_fix('dxy - within')}]) AS value FROM f)""")
def run_all(c):
    return ph.run_all(c, COLUMNS).where("stat <> 'fst_wc'")


# ---------------------------------------------------------------- comparisons over all populations


def _garud(i: int) -> str:
    own = GARUD.replace("pop = 'POP0'", f"pop = 'POP{i}'").replace("'POP0' AS population", f"'POP{i}' AS population").replace("g.sample = (h // 2) * 5)", f"g.sample = (h // 2) * 5 + {i})")
    return f"SELECT * FROM (WITH RECURSIVE {COHORT_SQL.strip()}{own} SELECT chr, start, \"end\", population, h12 FROM garud)"


def _scan(i: int) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {COHORT_SQL.strip()}{windowed_sql(50_000, 25_000).replace('POP0', f'POP{i}')} SELECT population, tajima_d, fay_wu_h FROM scan)"


_with = f"WITH RECURSIVE {COHORT_SQL.strip()}"
ORACLE["convergent_sweeps"] = _with + f""", w AS ({' UNION ALL '.join(map(_garud, range(5)))})
SELECT gene, count(DISTINCT population) AS n_groups, max(h12) AS max_h12 FROM has_consequence JOIN variant USING (v) JOIN w USING (chr) WHERE pos BETWEEN start AND "end" AND h12 >= 0.03 GROUP BY 1 HAVING count(DISTINCT population) >= 2"""
ORACLE["temporal_strata"] = _with + f""", w AS ({' UNION ALL '.join(map(_scan, range(5)))}),
sh AS (SELECT population, avg(CAST(tajima_d <= 0.5 AS INT)) AS recent, avg(CAST(fay_wu_h <= -0.5 AS INT)) AS old FROM w GROUP BY 1),
z AS (SELECT *, CASE WHEN stddev_pop(recent) OVER () > 0 THEN (recent - avg(recent) OVER ()) / stddev_pop(recent) OVER () ELSE 0 END AS zr, CASE WHEN stddev_pop(old) OVER () > 0 THEN (old - avg(old) OVER ()) / stddev_pop(old) OVER () ELSE 0 END AS zo FROM sh)
SELECT population, {_fix('recent')} AS recent, {_fix('old')} AS old, {_fix('zr')} AS z_recent, {_fix('zo')} AS z_old, CASE WHEN zr >= zo THEN 'recent' ELSE 'old' END AS layer FROM z"""

# ---------------------------------------------------------------- evidence of several analyses

LINES = {"fst": 0, "n_convergent_genes": 0, "n_groups": 3, "n_go_genes": 0}


@query()
def synthesis(c):
    sweeps = ph.convergent_sweeps(c, rounded(each_population(lambda p: hp.garud_h(c, p, 50_000, 25_000))), 0.03, 2)
    hits = ph.gene_fst(c, "POP0", "POP1").where("fst > 0.003")
    terms = rounded(ph.enrichment(c.has_go_term.withColumnRenamed("go", "term"), hits, c.gene)).where("p <= 0.5")
    return ph.synthesis(ph.pathway_evidence(c, rounded(ph.pathway_fst(c, "POP0", "POP1")), sweeps, terms), LINES, "pathway")


_scaled = ", ".join(f"(row_number() OVER (ORDER BY {x}, pathway) - 1) / greatest(1, count(*) OVER () - 1.0) AS {x}_s" for x in LINES)
_lines = " + ".join(f"CAST({x} > {bound} AS INT)" for x, bound in LINES.items())
ORACLE["synthesis"] = _with + f""", sw AS (SELECT gene, n_groups FROM ({ORACLE['convergent_sweeps']})), go_genes AS (SELECT DISTINCT gene FROM has_go_term WHERE go IN (SELECT term FROM ({ORACLE['go_enrichment']}) WHERE p <= 0.5)),
cv AS (SELECT pathway, count(*) AS n_convergent_genes, count(g.gene) AS n_go_genes, max(n_groups) AS n_groups FROM (SELECT DISTINCT gene, pathway FROM in_pathway) JOIN sw USING (gene) LEFT JOIN go_genes g USING (gene) GROUP BY 1),
ev AS (SELECT pathway, coalesce(fst, 0) AS fst, coalesce(n_convergent_genes, 0) AS n_convergent_genes, coalesce(n_go_genes, 0) AS n_go_genes, coalesce(n_groups, 0) AS n_groups FROM ({ORACLE['pathway_fst']}) FULL JOIN cv USING (pathway)),
sc AS (SELECT *, {_scaled}, {_lines} AS n_lines FROM ev)
SELECT pathway, fst, n_convergent_genes, n_go_genes, n_groups, {', '.join(f'{_fix(f"{x}_s")} AS {x}_scaled' for x in LINES)}, {_fix('(' + ' + '.join(f'{x}_s' for x in LINES) + ') / 4')} AS composite, n_lines, CASE WHEN n_lines >= 3 THEN 'HIGH' WHEN n_lines >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM sc"""
