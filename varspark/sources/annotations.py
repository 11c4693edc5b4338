"""Readers for variant effects (CSQ and ANN fields), pathway and ontology tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .variants import Vcf

# The order of the leading ANN fields, and the CSQ names of the same and further ones.
ANN = ["allele", "consequence", "impact", "symbol", "gene", "feature_type", "feature", "biotype"]
CSQ = {"Allele": "allele", "Consequence": "consequence", "IMPACT": "impact", "SYMBOL": "symbol", "Gene": "gene", "Feature_type": "feature_type", "Feature": "feature", "BIOTYPE": "biotype", "SIFT": "sift", "PolyPhen": "polyphen", "CADD_PHRED": "cadd_phred", "REVEL": "revel"}


def effect_fields(description: str | None, is_csq: bool) -> dict[str, int]:
    """Places of the fields in an entry. A CSQ description must say its format and have a Gene."""
    if not is_csq:
        return {name: i for i, name in enumerate(ANN)}
    found = re.search(r'Format: ([^">]+)', description or "")
    if not found:
        raise ValueError("the CSQ description has no 'Format: '")
    names = found[1].strip().split("|")
    out = {CSQ[x]: i for i, x in enumerate(names) if x in CSQ}
    if "gene" not in out:
        raise ValueError("CSQ has no Gene field")
    return out


def pred_score(value: Column) -> tuple[Column, Column]:
    """word(number) as word and number; a bare word has no number."""
    split = r"^([^()]+)\(([0-9.eE+-]+)\)$"
    hit = value.rlike(split)
    return F.when(hit, F.regexp_extract(value, split, 1)).otherwise(value), F.when(hit, F.regexp_extract(value, split, 2)).otherwise("")


def allele_matches(allele: Column, ref: Column, alt: Column, is_csq: bool) -> Column:
    """Whether an entry's allele is that of the record: as it stands, or (CSQ) as '-' for a deletion or the inserted bases."""
    same = allele == alt
    if not is_csq:
        return same
    shorter, longer = F.length(ref) > F.length(alt), F.length(alt) > F.length(ref)
    return same | (shorter & (allele == "-")) | (longer & (allele == F.expr(f"substring({_name(alt)}, length({_name(ref)}) + 1)")))


def _name(c: Column) -> str:
    return c._jc.toString()


def read_effects(spark: SparkSession, path: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(gene: gene, symbol, biotype; has_consequence: v, gene, consequence, impact, feature, feature_type, and scores).

    CSQ is preferred over ANN. Entries without a gene, or for another allele, are dropped; of a gene the first
    symbol by position counts. known (column v) keeps only those variants.
    """
    vcf = Vcf(spark, path)
    csq = vcf.info_format("CSQ")
    key = "CSQ" if csq else "ANN"
    if not csq and vcf.info_format("ANN") is None:
        raise ValueError(f"{path} declares neither CSQ nor ANN")
    place = effect_fields(csq, csq is not None)
    records = vcf.records.withColumn("alt", F.explode(F.split("alt", ","))).withColumn("v", F.concat_ws(":", "chr", F.col("pos").cast("string"), "ref", "alt"))
    if known is not None:
        records = records.join(known.select("v").distinct(), "v", "left_semi")
    info = F.concat(F.lit(";"), F.col("info"))
    entries = records.select("v", "chr", "pos", "ref", "alt", F.posexplode(F.split(F.regexp_extract(info, f";{key}=([^;]+)", 1), ",")).alias("n", "entry"))
    field = lambda name: F.coalesce(F.get(F.split("entry", "\\|"), F.lit(place[name])), F.lit("")) if name in place else F.lit("")
    rows = entries.select("*", *(field(x).alias(x) for x in CSQ.values())).where("gene <> ''")
    rows = rows.where(allele_matches(F.col("allele"), F.col("ref"), F.col("alt"), csq is not None))
    order = F.struct("chr", "pos", "n")
    gene = rows.groupBy("gene").agg(F.min_by("symbol", order).alias("symbol"), F.min_by("biotype", order).alias("biotype"))
    (sift, sift_score), (poly, poly_score) = pred_score(F.col("sift")), pred_score(F.col("polyphen"))
    effects = rows.select("v", "gene", "consequence", "impact", "feature", "feature_type", sift_score.alias("sift_score"), sift.alias("sift_pred"), poly_score.alias("polyphen_score"), poly.alias("polyphen_pred"), "cadd_phred", "revel")
    return gene, effects


def read_pathways(spark: SparkSession, path: str, genes: DataFrame | None = None, species: str = "Homo sapiens") -> tuple[DataFrame, DataFrame]:
    """(pathway: pathway_id, name; in_pathway: gene, pathway_id, pathway, evidence) from six tab-separated columns of one species."""
    t = spark.read.csv(path, sep="\t", schema="gene string, pathway_id string, url string, name string, evidence string, species string", quote="").where(F.col("species") == species)
    if genes is not None:
        t = t.join(genes.select("gene").distinct(), "gene", "left_semi")
    pathway = t.groupBy("pathway_id").agg(F.max("name").alias("name"))
    return pathway, t.select("gene", "pathway_id", F.col("name").alias("pathway"), "evidence").dropDuplicates(["gene", "pathway_id"])


def read_go(spark: SparkSession, path: str, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(go_term: go, name, aspect; has_go_term: gene, go) from four tab-separated columns with a header; rows without a term are dropped."""
    t = spark.read.csv(path, sep="\t", header=True, quote="", enforceSchema=True, schema="gene string, go string, name string, aspect string").where("go IS NOT NULL AND go <> '' AND gene IS NOT NULL AND gene <> ''")
    if genes is not None:
        t = t.join(genes.select("gene").distinct(), "gene", "left_semi")
    return t.groupBy("go").agg(F.min("name").alias("name"), F.min("aspect").alias("aspect")), t.select("gene", "go").distinct()
