"""Readers for variant calls, sample panels and ancestral sequences, as DataFrames over text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cohort import Cohort

FIXED = ["chr", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]


def read_panel(spark: SparkSession, path: str, stratify_by: str = "population") -> DataFrame:
    """sample, pop, sex (1 male, 2 female, 0 unknown) from a panel (tab) or a pedigree (SampleID column; tab or white space)."""
    lines = spark.read.text(path)
    head = lines.first()
    if head is None:
        raise ValueError(f"{path} is empty")
    head = head[0]
    sep = "\\t" if "\t" in head or "sampleid" not in head.lower() else "\\s+"
    names = [x.lower() for x in (head.split("\t") if sep == "\\t" else head.split())]
    find = lambda *options: next((names.index(x) for x in options if x in names), None)
    sample = find("sampleid", "sample")
    pop = find("super_pop", "superpopulation") if stratify_by == "superpopulation" else find("pop", "population")
    sex = find("sex", "gender")
    if sample is None or pop is None:
        raise ValueError(f"{path} has no sample or population column: {names}")
    field = lambda i: F.split("value", sep)[i]
    said = F.lower(F.trim(field(sex))) if sex is not None else F.lit("")
    code = F.when(said.isin("1", "male"), 1).when(said.isin("2", "female"), 2).otherwise(0)
    return lines.where(F.col("value") != head).where("trim(value) <> ''").select(field(sample).alias("sample"), field(pop).alias("pop"), code.alias("sex"))


def variant_type(ref: Column, alt: Column) -> Column:
    return F.when(alt.startswith("<"), "SV").when((F.length(ref) == 1) & (F.length(alt) == 1), "SNP").otherwise("INDEL")


class Vcf:
    """A variant call file: header facts and the record lines."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.lines = spark, spark.read.text(path)
        head = self.lines.where(F.col("value").startswith("#CHROM")).first()
        if head is None:
            raise ValueError(f"{path} has no #CHROM line")
        self.samples = head[0].split("\t")[9:]
        fields = F.split("value", "\t")
        self.records = self.lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(*(F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(FIXED)), F.slice(fields, 10, max(1, len(self.samples))).alias("calls")).withColumn("pos", F.col("pos").cast("long"))

    def contigs(self) -> DataFrame:
        """chr, length of the contigs that the header declares."""
        own = self.lines.where(F.col("value").startswith("##contig="))
        return own.select(F.regexp_extract("value", "[<,]ID=([^,>]+)", 1).alias("chr"), F.coalesce(F.try_to_number(F.regexp_extract("value", "[<,]length=([0-9]+)", 1), F.lit("9999999999999")).cast("long"), F.lit(0)).alias("length"))

    def info_format(self, key: str) -> str | None:
        """The description of an INFO field of the header."""
        row = self.lines.where(F.col("value").startswith(f"##INFO=<ID={key},")).first()
        return row and row[0]

    def variants(self, include_filtered: bool = False, contigs: list[str] | None = None, region: tuple[str, int, int] | None = None, split: bool = False) -> DataFrame:
        """Records that pass: no other filter than PASS, a real alternative, a listed contig. Of several alternatives each is a row (split), or the record goes.

        allele is the number of the alternative in the record; calls of the others count as reference.
        """
        alts = F.split("alt", ",")
        out = self.records.where(F.lit(split) | (F.size(alts) == 1)).select(*(c for c in self.records.columns if c != "alt"), F.posexplode(alts).alias("allele", "alt"))
        out = out.where(~F.col("alt").isin(".", "<*>", "*")).withColumn("allele", F.col("allele") + 1)
        if not include_filtered:
            out = out.where(F.col("filter").isin("PASS", "."))
        if contigs is not None:
            out = out.where(F.col("chr").isin(contigs))
        if region is not None:
            out = out.where((F.col("chr") == region[0]) & F.col("pos").between(region[1], region[2]))
        return out.withColumn("variant_id", F.concat_ws(":", "chr", F.col("pos").cast("string"), "ref", "alt"))

    def calls(self, variants: DataFrame) -> DataFrame:
        """v, i (place of the sample), a0, a1 (alleles; null missing), haploid."""
        key = F.array_position(F.split("format", ":"), "GT") - 1
        every = variants.where(key >= 0).select(F.col("variant_id").alias("v"), "allele", key.cast("int").alias("k"), F.posexplode("calls").alias("i", "call"))
        parts = F.split(F.get(F.split("call", ":"), F.col("k")), "[|/]")
        allele = lambda j: F.when(F.get(parts, F.lit(j)) != ".", (F.get(parts, F.lit(j)).cast("int") == F.col("allele")).cast("int"))
        return every.select("v", "i", allele(0).alias("a0"), allele(1).alias("a1"), (F.size(parts) == 1).alias("haploid"))


def call_counts(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """v, pop, ac, an, het, hom over called samples; a haploid call is one allele and never heterozygous."""
    missing = F.col("a0").isNull() | (~F.col("haploid") & F.col("a1").isNull())
    n = F.when(missing, 0).when(F.col("haploid"), 1).otherwise(2)
    alt = F.when(missing, 0).otherwise((F.col("a0") > 0).cast("int") + F.when(F.col("haploid"), 0).otherwise((F.col("a1") > 0).cast("int")))
    own = calls.join(F.broadcast(samples.select("i", "pop")), "i")  # one row for each sample of the file
    total = lambda c, name: F.sum(c).cast("int").alias(name)
    return own.groupBy("v", "pop").agg(total(alt, "ac"), total(n, "an"), total(((n == 2) & (alt == 1)).cast("int"), "het"), total(((n > 0) & (alt == n)).cast("int"), "hom"))


def call_rate(calls: DataFrame) -> DataFrame:
    """v, call_rate over all samples of the file."""
    missing = F.col("a0").isNull() | (~F.col("haploid") & F.col("a1").isNull())
    return calls.groupBy("v").agg((1 - F.avg(missing.cast("double"))).alias("call_rate"))


def read_fasta(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """chr, start (from 0), bases: a row for each line of the contigs; contig names them all.

    Lines are placed by the lengths of those before them in their split of the file, and each split by what the splits before it end with.
    """
    from pyspark.sql import Window

    text = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"), F.spark_partition_id().alias("part")).where("length(value) > 0")
    head = F.col("value").startswith(">")
    order = Window.partitionBy("part").orderBy("line")
    name = F.when(head, F.regexp_extract("value", r"^>\s*(\S+)", 1))
    marked = text.select("part", "line", "value", head.alias("head"), F.last(name, True).over(order).alias("chr"), F.count(name).over(order).alias("n"))
    size = F.when(F.col("head"), 0).otherwise(F.length("value"))
    ends = marked.groupBy("part").agg(F.max("n").alias("n"), F.sum(F.when(F.col("n") == 0, size).otherwise(0)).alias("lead"), F.max_by("chr", "line").alias("chr"))
    tail = marked.join(ends.select("part", F.col("n").alias("last")), "part").where("n = last").groupBy("part").agg(F.sum(size).alias("tail"))
    carry, known, done = [], None, 0
    for r in ends.join(tail, "part").orderBy("part").collect():  # a row for each split of the file
        carry.append((r.part, known, done))
        known, done = (r.chr, r.tail) if r.n else (known, done + r.lead)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("part", "n").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = marked.withColumn("before", before).where(~F.col("head")).join(F.broadcast(spark.createDataFrame(carry, "part int, known string, done long")), "part")
    here = F.coalesce("chr", "known") if contig is None else F.lit(contig)
    return placed.select(here.alias("chr"), (F.col("before") + F.when(F.col("n") == 0, F.col("done")).otherwise(0)).cast("long").alias("start"), F.col("value").alias("bases"))


def polarise(variants: DataFrame, lines: DataFrame, bin_size: int = 1000) -> DataFrame:
    """ancestral (REF, ALT or null) and is_polarized (the ancestral base is sure: upper case) from the base at a variant's position on its contig.

    lines: of read_fasta. Lines meet the variants of their bins, and are never taken apart into bases.
    """
    end = F.col("start") + F.length("bases") - 1
    spread = lines.select("chr", "start", "bases", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(end / bin_size))).alias("_bin"))
    near = variants.select("v", "chr", F.col("pos").alias("_pos"), F.floor((F.col("pos") - 1) / bin_size).alias("_bin")).join(spread, ["chr", "_bin"])
    at = F.col("_pos") - 1 - F.col("start")
    found = near.where((at >= 0) & (at < F.length("bases"))).select("v", F.substring("bases", (at + 1).cast("int"), F.lit(1)).alias("base"))
    out = variants.join(found, "v", "left")
    base = F.upper("base")
    ancestral = F.when(base.isin(".", "N", "-"), None).when(base == F.substring("ref", 1, 1), "REF").when(base == F.substring("alt", 1, 1), "ALT")
    sure = F.col("base").rlike("^[ACGT]$")
    return out.withColumn("ancestral", ancestral).withColumn("is_polarized", F.coalesce(sure & F.col("ancestral").isNotNull(), F.lit(False))).drop("base")


def vcf_cohort(spark: SparkSession, vcf_path: str, panel_path: str, stratify_by: str = "population", fasta: str | None = None, annotations: dict[str, DataFrame] | None = None, **options) -> Cohort:
    """A cohort of the samples that both files have. Variants are known by their identifiers (v = variant_id)."""
    vcf = Vcf(spark, vcf_path)
    order = spark.createDataFrame([(i, s) for i, s in enumerate(vcf.samples)], "i int, sample string")
    sample = order.join(read_panel(spark, panel_path, stratify_by), "sample")
    found = vcf.variants(**options).dropDuplicates(["variant_id"])
    calls = vcf.calls(found)
    variant = found.select(F.col("variant_id").alias("v"), "chr", "pos", "ref", "alt", "variant_id", variant_type(F.col("ref"), F.col("alt")).alias("variant_type"))
    variant = polarise(variant, read_fasta(spark, fasta)) if fasta else variant.withColumn("ancestral", F.lit(None).cast("string"))
    both = F.when(F.col("haploid"), 2 * (F.col("a0") > 0).cast("int")).otherwise((F.col("a0") > 0).cast("int") + (F.col("a1") > 0).cast("int"))
    genotype = calls.join(F.broadcast(sample), "i").select("v", "sample", both.alias("gt"), F.coalesce((F.col("a1") > 0).cast("int"), F.lit(0)).alias("phase")).where("gt > 0")
    empty = lambda schema: spark.createDataFrame([], schema)
    notes = {"gene": empty("gene string, symbol string"), "has_consequence": empty("v string, gene string, consequence string, impact string"), "in_pathway": empty("gene string, pathway string"), "has_go_term": empty("gene string, go string")} | (annotations or {})
    counts = variant.select("v", "chr", "pos", "variant_id", "variant_type", "ancestral").join(call_counts(calls, sample), "v")
    return Cohort(variant, sample.select("sample", "pop"), genotype, notes["gene"], notes["has_consequence"], notes["in_pathway"], notes["has_go_term"], counts)
