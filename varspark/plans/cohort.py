"""Genomic tables as DataFrames, and their derivation from the star schema used for tests and benchmarks.

A Cohort is only a holder of tables; any producer (the readers in varspark.sources, Parquet files,
the star schema) can make one. Tables:

variant        v, chr, pos, ref, alt, variant_id, variant_type, ancestral
sample         sample, pop
population     pop, n_samples
genotype       v, sample, gt (1, 2), phase       (absent: homozygous reference)
variant_pop    v, chr, pos, variant_id, variant_type, ancestral, pop, ac, an, het, hom
gene           gene, symbol
has_consequence v, gene, consequence, impact
in_pathway     gene, pathway
has_go_term    gene, go
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES, POPS = 100, 5
SITE = ["v", "chr", "pos", "variant_id", "variant_type", "ancestral"]


@dataclass
class Cohort:
    variant: DataFrame
    sample: DataFrame
    genotype: DataFrame
    gene: DataFrame
    has_consequence: DataFrame
    in_pathway: DataFrame
    has_go_term: DataFrame
    counts: DataFrame | None = None  # variant_pop, where a producer has it already
    _kept: dict = field(default_factory=dict)

    @property
    def population(self) -> DataFrame:
        return self.sample.groupBy("pop").agg(F.count(F.lit(1)).alias("n_samples"))

    @property
    def variant_pop(self) -> DataFrame:
        """Allele counts for each site and population; kept, since most operators start from it."""
        if "counts" not in self._kept:
            self._kept["counts"] = (self.counts if self.counts is not None else count_alleles(self.variant, self.genotype, self.sample)).persist()
        return self._kept["counts"]


def count_alleles(variant: DataFrame, genotype: DataFrame, sample: DataFrame) -> DataFrame:
    """variant_pop for the populations of sample. Populations are few; their table is checked to be small before it is sent around."""
    pops = sample.groupBy("pop").agg((2 * F.count(F.lit(1))).cast("int").alias("an"))
    seen = genotype.join(sample, "sample").groupBy("v", "pop").agg(
        F.sum("gt").cast("int").alias("ac"), F.sum((F.col("gt") == 1).cast("int")).cast("int").alias("het"), F.sum((F.col("gt") == 2).cast("int")).cast("int").alias("hom")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return variant.select(*SITE).crossJoin(pops).join(seen, ["v", "pop"], "left").select(*SITE, "pop", zero("ac"), "an", zero("het"), zero("hom"))


def star_cohort(spark: SparkSession, sf_dir: str) -> Cohort:
    """The cohort derived from the star schema under sf_dir."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, item = t("part"), t("lineitem")
    chrom = F.concat(F.lit("chr"), (F.col("p_partkey") % 4 + 1).cast("string"))
    pos = 1000 + F.floor(F.col("p_partkey") / 4) * 1000 + (F.col("p_partkey") * 37) % 500
    variant = part.select(
        F.col("p_partkey").alias("v"), chrom.alias("chr"), pos.alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"),
        F.concat_ws(":", chrom, pos.cast("string"), F.lit("A"), F.lit("T")).alias("variant_id"),
        F.when(F.col("p_size") % 7 == 0, "INDEL").otherwise("SNP").alias("variant_type"),
        F.when(F.col("p_size") % 3 == 0, "REF").when(F.col("p_size") % 3 == 1, "ALT").alias("ancestral"),
    )
    sample = spark.range(SAMPLES).select(F.col("id").cast("int").alias("sample"), F.concat(F.lit("POP"), (F.col("id") % POPS).cast("string")).alias("pop"))
    carried = item.select("l_orderkey", "l_partkey", "l_linenumber").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    genotype = carried.groupBy(F.col("l_partkey").alias("v"), (F.col("o_custkey") % SAMPLES).cast("int").alias("sample")).agg(
        F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("gt"), (F.max("l_linenumber") % 2).alias("phase")
    )
    effect = F.when(F.col("l_returnflag") == "A", "missense_variant").when(F.col("l_returnflag") == "R", "synonymous_variant").otherwise("intron_variant")
    impact = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "HIGH").otherwise("MODERATE")).when(F.col("l_returnflag") == "R", "LOW").otherwise("MODIFIER")
    name = lambda c: F.concat(F.lit("G"), c.cast("string"))
    edges = item.where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("v"), name(F.col("l_suppkey")).alias("gene")).agg(F.min(effect).alias("consequence"), F.min(impact).alias("impact"))
    supplier = t("supplier").select(name(F.col("s_suppkey")).alias("gene"), F.col("s_name").alias("symbol"), "s_nationkey", "s_suppkey")
    home = supplier.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    in_pathway = home.select("gene", F.explode(F.array("n_name", "r_name")).alias("pathway"))
    go = supplier.select("gene", F.explode(F.array(F.concat(F.lit("BUCKET7_"), (F.col("s_suppkey") % 7).cast("string")), F.concat(F.lit("BUCKET11_"), (F.col("s_suppkey") % 11).cast("string")))).alias("go"))
    return Cohort(variant, sample, genotype, supplier.select("gene", "symbol"), edges, in_pathway, go)


# the same derivation for DuckDB, as common table expressions
COHORT_SQL = """
variant AS (SELECT p_partkey AS v, 'chr' || CAST(p_partkey % 4 + 1 AS VARCHAR) AS chr,
    1000 + CAST(floor(p_partkey / 4.0) AS BIGINT) * 1000 + (p_partkey * 37) % 500 AS pos, 'A' AS ref, 'T' AS alt,
    CASE WHEN p_size % 7 = 0 THEN 'INDEL' ELSE 'SNP' END AS variant_type,
    CASE p_size % 3 WHEN 0 THEN 'REF' WHEN 1 THEN 'ALT' END AS ancestral,
    'chr' || CAST(p_partkey % 4 + 1 AS VARCHAR) || ':' || CAST(1000 + CAST(floor(p_partkey / 4.0) AS BIGINT) * 1000 + (p_partkey * 37) % 500 AS VARCHAR) || ':A:T' AS variant_id FROM part),
sample AS (SELECT CAST(i AS INTEGER) AS sample, 'POP' || CAST(i % 5 AS VARCHAR) AS pop FROM range(100) t(i)),
genotype AS (SELECT l_partkey AS v, CAST(o_custkey % 100 AS INTEGER) AS sample, CAST(least(2, count(*)) AS INTEGER) AS gt, CAST(max(l_linenumber) % 2 AS INTEGER) AS phase
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
seen AS (SELECT v, pop, sum(gt) AS ac, count(*) FILTER (gt = 1) AS het, count(*) FILTER (gt = 2) AS hom FROM genotype JOIN sample USING (sample) GROUP BY 1, 2),
variant_pop AS (SELECT variant.v, chr, pos, variant_id, variant_type, ancestral, p.pop, CAST(coalesce(ac, 0) AS INTEGER) AS ac, p.an, CAST(coalesce(het, 0) AS INTEGER) AS het, CAST(coalesce(hom, 0) AS INTEGER) AS hom
    FROM variant CROSS JOIN (SELECT pop, CAST(2 * count(*) AS INTEGER) AS an FROM sample GROUP BY 1) p LEFT JOIN seen ON seen.v = variant.v AND seen.pop = p.pop),
gene AS (SELECT 'G' || CAST(s_suppkey AS VARCHAR) AS gene, s_name AS symbol FROM supplier),
has_consequence AS (SELECT l_partkey AS v, 'G' || CAST(l_suppkey AS VARCHAR) AS gene,
    min(CASE l_returnflag WHEN 'A' THEN 'missense_variant' WHEN 'R' THEN 'synonymous_variant' ELSE 'intron_variant' END) AS consequence,
    min(CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'HIGH' ELSE 'MODERATE' END WHEN 'R' THEN 'LOW' ELSE 'MODIFIER' END) AS impact
    FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
in_pathway AS (SELECT 'G' || CAST(s_suppkey AS VARCHAR) AS gene, unnest([n_name, r_name]) AS pathway FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
has_go_term AS (SELECT 'G' || CAST(s_suppkey AS VARCHAR) AS gene, unnest(['BUCKET7_' || CAST(s_suppkey % 7 AS VARCHAR), 'BUCKET11_' || CAST(s_suppkey % 11 AS VARCHAR)]) AS go FROM supplier)
"""
