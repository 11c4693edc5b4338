"""Writers: Parquet cohorts with a manifest, delimited text, BED, and the packed genotype encoding."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cohort import Cohort

TABLES = ["variant", "sample", "genotype", "gene", "has_consequence", "in_pathway", "has_go_term"]


def save_cohort(cohort: Cohort, path: str) -> dict[str, int]:
    """Write all tables (variants and counts by chromosome) and a manifest of row numbers; duplicates and edges without ends are dropped."""
    spark = cohort.variant.sparkSession
    variant = cohort.variant.dropDuplicates(["variant_id"])
    fixed = {
        "variant": variant, "sample": cohort.sample.dropDuplicates(["sample"]), "gene": cohort.gene.dropDuplicates(["gene"]),
        "genotype": cohort.genotype.join(variant, "v", "left_semi"), "has_consequence": cohort.has_consequence.join(variant, "v", "left_semi").join(cohort.gene, "gene", "left_semi"),
        "in_pathway": cohort.in_pathway.join(cohort.gene, "gene", "left_semi"), "has_go_term": cohort.has_go_term.join(cohort.gene, "gene", "left_semi"),
    }
    for name, df in fixed.items():
        (df.repartition("chr").sortWithinPartitions("pos").write.partitionBy("chr") if name == "variant" else df.write).mode("overwrite").parquet(f"{path}/{name}")
    cohort.variant_pop.repartition("chr").sortWithinPartitions("pos").write.partitionBy("chr").mode("overwrite").parquet(f"{path}/variant_pop")
    manifest = {name: spark.read.parquet(f"{path}/{name}").count() for name in [*fixed, "variant_pop"]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_cohort(spark: SparkSession, path: str) -> Cohort:
    return Cohort(*(spark.read.parquet(f"{path}/{name}") for name in TABLES), spark.read.parquet(f"{path}/variant_pop"))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: numbers to six significant digits, lists joined by commas, null as NA."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.format_string("%.6g", c.cast("double"))
            c = F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0+(e|$)", "$1")).otherwise(c)
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(F.coalesce(F.when(F.col(name).isNotNull(), c.cast("string")), F.lit("NA")).alias(name))
    return df.select(*out)


def write_text(df: DataFrame, path: str, kind: str = "tsv") -> None:
    """tsv or csv (with a header) or json (a line for each row)."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind in ("tsv", "csv"):
        as_text(df).write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        raise ValueError("kind is tsv, csv or json")


def write_bed(peaks: DataFrame, path: str, name: str) -> None:
    """Five columns: chromosome, start counted from 0, end, name, score."""
    peaks.select("chr", (F.col("start") - 1).alias("start"), "end", F.lit(name).alias("name"), F.format_string("%.4f", "mean_score").alias("score")).sortWithinPartitions("chr", "start").write.mode("overwrite").csv(path, sep="\t")


# ---------------------------------------------------------------- packed genotypes


def pack(codes, bits: int) -> bytes:
    """Codes of one or two bits, from the lowest bits of each byte on."""
    flat = (np.asarray(codes, np.uint8)[:, None] >> np.arange(bits)) & 1
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | None, n: int, bits: int) -> np.ndarray:
    """The first n codes; what lies beyond the data is 0 (so an absent ploidy array is diploid)."""
    flat = np.unpackbits(np.frombuffer(data or b"", np.uint8), bitorder="little")[: n * bits]
    out = np.zeros(n * bits, np.uint8)
    out[: len(flat)] = flat
    return (out.reshape(n, bits) << np.arange(bits)).sum(axis=1).astype(np.uint8)


def packed_genotypes(cohort: Cohort) -> DataFrame:
    """variant_id, gt_packed (0 reference, 1 het, 2 alternative, 3 missing), phase_packed, ploidy_packed (1 haploid; null where all are diploid).

    Samples in order. Genotypes may have columns haploid and missing (booleans); where they don't, calls are diploid and whole.
    """
    order = cohort.sample.select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("i"))
    n = order.count()
    flag = lambda c: (F.coalesce(F.col(c), F.lit(False)) if c in cohort.genotype.columns else F.lit(False)).alias(c)
    code = F.struct("i", "gt", "phase", flag("haploid"), flag("missing"))
    rows = cohort.genotype.join(F.broadcast(order), "sample").groupBy("v").agg(F.collect_list(code).alias("g"))
    rows = cohort.variant.select("v", "variant_id").join(rows, "v", "left").select("variant_id", "g")

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            i, gt, phase, haploid, missing = (pc.fill_null(x, 0 if x.type != pa.bool_() else False).to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            codes, phases, ploidy = (np.zeros((batch.num_rows, n), np.uint8) for _ in range(3))
            codes[row, i] = np.where(missing, 3, gt)
            phases[row, i] = np.where((gt == 1) & ~missing, phase, 0)
            ploidy[row, i] = haploid
            some = ploidy.any(axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([pack(x, 2) for x in codes], pa.binary()), pa.array([pack(x, 1) for x in phases], pa.binary()),
                pa.array([pack(x, 1) if s else None for x, s in zip(ploidy, some, strict=True)], pa.binary()),
            ], ["variant_id", "gt_packed", "phase_packed", "ploidy_packed"])

    return rows.mapInArrow(run, "variant_id string, gt_packed binary, phase_packed binary, ploidy_packed binary")


# ---------------------------------------------------------------- files that the readers take


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the driver and all executors see (a local one only where that is unset and Spark is one process)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_vcf(cohort: Cohort, path: str) -> None:
    """Phased calls of all samples, with effects as CSQ; a text file for each task, of which one has the header."""
    order = cohort.sample.select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("i"))  # as many rows as samples
    names = [str(r.sample) for r in order.orderBy("i").collect()]
    calls = cohort.genotype.join(F.broadcast(order), "sample").groupBy("v").agg(F.collect_list(F.struct("i", "gt", "phase")).alias("g"))
    entry = F.concat_ws("|", "alt", "consequence", "impact", "symbol", "gene")
    effects = cohort.has_consequence.join(cohort.gene, "gene", "left").join(cohort.variant.select("v", "alt"), "v").groupBy("v").agg(F.concat(F.lit("CSQ="), F.array_join(F.sort_array(F.collect_list(entry)), ",")).alias("info"))
    rows = cohort.variant.select("v", "chr", "pos", "ref", "alt").join(calls, "v", "left").join(effects, "v", "left").select("chr", F.col("pos").cast("string").alias("pos"), "ref", "alt", F.coalesce("info", F.lit(".")).alias("info"), "g")
    n = len(names)

    def lines(batches):
        for batch in batches:
            out = []
            for chr, pos, ref, alt, info, g in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = ["0|0"] * n
                for x in g or ():
                    own[x["i"]] = "1|1" if x["gt"] == 2 else "0|1" if x["phase"] else "1|0"
                out.append("\t".join([chr, pos, ".", ref, alt, ".", "PASS", info, "GT", *own]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    head = ["##fileformat=VCFv4.2", '##INFO=<ID=CSQ,Number=.,Type=String,Description="Effects. Format: Allele|Consequence|IMPACT|SYMBOL|Gene">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    spark = cohort.variant.sparkSession
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).union(rows.mapInArrow(lines, "value string")).write.text(path)


def write_panel(cohort: Cohort, path: str) -> None:
    """sample, pop as tab-separated text with a header."""
    rows = cohort.sample.select(F.concat_ws("\t", F.col("sample").cast("string"), "pop").alias("value"))
    spark = cohort.sample.sparkSession
    spark.createDataFrame([("sample\tpop",)], "value string").union(rows).coalesce(1).write.text(path)


def write_ancestral(cohort: Cohort, path: str, width: int = 1000) -> None:
    """The ancestral bases of the variants as a sequence file with lines of width bases, N elsewhere."""
    base = F.when(F.col("ancestral") == "REF", F.substring("ref", 1, 1)).when(F.col("ancestral") == "ALT", F.substring("alt", 1, 1)).otherwise("N")
    own = cohort.variant.select("chr", F.floor((F.col("pos") - 1) / width).alias("k"), F.struct(((F.col("pos") - 1) % width).cast("int").alias("at"), base.alias("base")).alias("x"))
    own = own.groupBy("chr", "k").agg(F.collect_list("x").alias("xs"))
    ends = own.groupBy("chr").agg(F.max("k").alias("last"))
    every = ends.select("chr", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k")).join(own, ["chr", "k"], "left")
    blank = F.repeat(F.lit("N"), F.lit(width))
    line = F.aggregate(F.coalesce("xs", F.expr("cast(array() as array<struct<at:int,base:string>>)")), blank, lambda s, x: F.overlay(s, x["base"], x["at"] + 1, F.lit(1)))
    rows = every.select("chr", "k", line.alias("value")).union(ends.select("chr", F.lit(-1).cast("long"), F.concat(F.lit(">"), "chr")))
    rows.coalesce(1).sortWithinPartitions("chr", "k").select("value").write.text(path)


def write_annotations(cohort: Cohort, pathways: str, terms: str) -> None:
    """Pathways as six tab-separated columns, terms as four with a header."""
    row = F.concat_ws("\t", "gene", "pathway", F.lit("-"), "pathway", F.lit("IEA"), F.lit("Homo sapiens"))
    cohort.in_pathway.select(row.alias("value")).write.text(pathways)
    spark = cohort.sample.sparkSession
    rows = cohort.has_go_term.select(F.concat_ws("\t", "gene", "go", "go", F.lit("BP")).alias("value"))
    spark.createDataFrame([("gene\tgo\tname\taspect",)], "value string").union(rows).coalesce(1).write.text(terms)


def unpacked_counts(packed: DataFrame, n: int) -> DataFrame:
    """variant_id, ac, het, hom, missing of packed genotypes of n samples."""

    def run(batches):
        for batch in batches:
            codes = np.stack([unpack(x, n, 2) for x in batch.column(batch.schema.get_field_index("gt_packed")).to_pylist()]) if batch.num_rows else np.zeros((0, n), np.uint8)
            het, hom, none = ((codes == k).sum(axis=1) for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in (het + 2 * hom, het, hom, none))], ["variant_id", "ac", "het", "hom", "missing"])

    return packed.mapInArrow(run, "variant_id string, ac long, het long, hom long, missing long")
