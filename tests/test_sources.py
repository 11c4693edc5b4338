import pytest
from pyspark.sql import functions as F

from varspark.operators.diversity import diversity
from varspark.operators.haplotypes import site_haplotypes
from varspark.plans.cohort import star_cohort
from varspark.sources.annotations import effect_fields, read_effects, read_go, read_pathways
from varspark.sources.sinks import as_text, load_cohort, pack, packed_genotypes, save_cohort, unpack, write_text
from varspark.sources.variants import Vcf, call_counts, call_rate, polarise, read_fasta, read_panel, vcf_cohort

VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=1000>
##contig=<ID=chr2>
##INFO=<ID=CSQ,Number=.,Type=String,Description="x. Format: Allele|Consequence|IMPACT|SYMBOL|Gene|Feature_type|Feature|BIOTYPE|SIFT|PolyPhen">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	S1	S2	S3	S4	S5
chr1	10	.	A	T	.	PASS	CSQ=T|missense_variant|MODERATE|GA|G1|T|t1|b|deleterious(0.02)|benign,T|intron_variant|MODIFIER|||T|t2|b||	GT:DP	0|1:3	1|1:4	0|0:1	./.:0	1|0:2
chr1	20	.	AC	A	.	.	AC=1;CSQ=-|frameshift_variant|HIGH|GB|G2||||	GT	0	1	1	0	.
chr1	30	.	G	GTT	.	q10	CSQ=TT|x|LOW|GC|G3||||	GT	0|1	0|1	0|1	0|1	0|1
chr1	40	.	G	C,T	.	PASS	.	GT	0|1	0|0	0|0	0|0	0|0
chr1	50	.	G	*	.	PASS	.	GT	0|1	0|0	0|0	0|0	0|0
chr2	5	.	G	<DEL>	.	PASS	.	DP:GT	1:0|1	1:0	1:1	1:.|1	1:0|0
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "a.vcf").write_text(VCF)
    (d / "panel.tsv").write_text("sample\tpop\tsuper_pop\tgender\nS1\tP\tX\tmale\nS2\tP\tX\tfemale\nS3\tQ\tX\t\nS4\tQ\tX\t1\nS9\tQ\tX\t1\n")
    (d / "ped.txt").write_text("FamilyID SampleID Population Superpopulation Sex\nf S1 P X 1\nf S2 Q Y 2\n")
    (d / "anc.fa").write_text(">chr1\nNNNNNNNNNT\nNNNNNNNNNa\n")
    (d / "re.tsv").write_text("G1\tR1\tu\tone\tTAS\tHomo sapiens\nG1\tR1\tu\tone\tIEA\tHomo sapiens\nG2\tR2\tu\ttwo\tTAS\tHomo sapiens\nG1\tR3\tu\tx\tTAS\tMus musculus\nG8\tR2\tu\ttwo\tTAS\tHomo sapiens\n")
    (d / "go.tsv").write_text("gene\tgo_id\tname\tns\nG1\tGO:1\ta\tBP\nG1\t\tb\tBP\nG2\tGO:1\ta\tBP\n")
    return d


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_panels(spark, files):
    assert rows(read_panel(spark, f"{files}/panel.tsv"))[:3] == [("S1", "P", 1), ("S2", "P", 2), ("S3", "Q", 0)]
    assert rows(read_panel(spark, f"{files}/ped.txt", "superpopulation")) == [("S1", "X", 1), ("S2", "Y", 2)]


def test_vcf(spark, files):
    vcf = Vcf(spark, f"{files}/a.vcf")
    assert vcf.samples == ["S1", "S2", "S3", "S4", "S5"]
    assert rows(vcf.contigs()) == [("chr1", 1000), ("chr2", 0)]
    ids = lambda **o: [r.variant_id for r in vcf.variants(**o).orderBy("chr", "pos").collect()]
    assert ids() == ["chr1:10:A:T", "chr1:20:AC:A", "chr2:5:G:<DEL>"]
    assert len(ids(include_filtered=True)) == 4 and ids(contigs=["chr2"]) == ["chr2:5:G:<DEL>"] and ids(region=("chr1", 15, 25)) == ["chr1:20:AC:A"]
    everyone = spark.createDataFrame([(i, "A") for i in range(5)], "i int, pop string")
    calls = vcf.calls(vcf.variants())
    assert rows(call_counts(calls, everyone)) == [("chr1:10:A:T", "A", 4, 8, 2, 1), ("chr1:20:AC:A", "A", 2, 4, 0, 2), ("chr2:5:G:<DEL>", "A", 2, 6, 1, 1)]
    assert {r.v: round(r.call_rate, 3) for r in call_rate(calls).collect()} == {"chr1:10:A:T": 0.8, "chr1:20:AC:A": 0.8, "chr2:5:G:<DEL>": 0.8}


def test_cohort_from_files(spark, files, tmp_path):
    gene, effects = read_effects(spark, f"{files}/a.vcf")
    c = vcf_cohort(spark, f"{files}/a.vcf", f"{files}/panel.tsv", fasta=f"{files}/anc.fa", annotations={"gene": gene, "has_consequence": effects})
    assert rows(c.variant.select("v", "variant_type", "ancestral")) == [("chr1:10:A:T", "SNP", "ALT"), ("chr1:20:AC:A", "INDEL", "REF"), ("chr2:5:G:<DEL>", "SV", None)]
    assert rows(c.variant_pop.where("pop = 'P'").select("v", "ac", "an")) == [("chr1:10:A:T", 3, 4), ("chr1:20:AC:A", 1, 2), ("chr2:5:G:<DEL>", 1, 3)]
    out = diversity(c, "chr1", None, None, "P", consequence="missense_variant").first()
    assert out.n_variants == 1 and out.n_polarized == 1
    save_cohort(c, f"{tmp_path}/c")
    again = load_cohort(spark, f"{tmp_path}/c")
    assert rows(again.variant_pop.select("v", "pop", "ac")) == rows(c.variant_pop.select("v", "pop", "ac"))


def test_effects(spark, files):
    gene, effects = read_effects(spark, f"{files}/a.vcf")
    assert rows(gene.select("gene", "symbol")) == [("G1", "GA"), ("G2", "GB"), ("G3", "GC")]
    assert rows(effects.select("v", "gene", "consequence", "sift_pred", "sift_score", "polyphen_pred", "polyphen_score")) == [
        ("chr1:10:A:T", "G1", "missense_variant", "deleterious", "0.02", "benign", ""),
        ("chr1:20:AC:A", "G2", "frameshift_variant", "", "", "", ""),
        ("chr1:30:G:GTT", "G3", "x", "", "", "", ""),
    ]
    with pytest.raises(ValueError):
        effect_fields("no format here", True)
    with pytest.raises(ValueError):
        effect_fields("Format: Allele|IMPACT", True)
    assert effect_fields(None, False)["gene"] == 4


def test_pathways_and_terms(spark, files):
    genes = spark.createDataFrame([("G1",), ("G2",)], "gene string")
    pathway, edges = read_pathways(spark, f"{files}/re.tsv")
    assert pathway.count() == 2 and edges.count() == 3
    assert read_pathways(spark, f"{files}/re.tsv", genes)[1].count() == 2
    terms, has = read_go(spark, f"{files}/go.tsv", genes)
    assert rows(terms) == [("GO:1", "a", "BP")] and has.count() == 2


def test_fasta(spark, files):
    assert rows(read_fasta(spark, f"{files}/anc.fa")) == [("chr1", 0, "NNNNNNNNNT"), ("chr1", 10, "NNNNNNNNNa")]


def test_fasta_of_several_contigs(spark, tmp_path):
    """Placed across splits of the file; a contig's bases never reach another's variants."""
    bases = {f"c{i}": "".join("ACGTN"[(i * 7 + j * j) % 5] for j in range(130 + 37 * i)) for i in range(6)}
    (tmp_path / "all.fa").write_text("".join(f">{k} x\n" + "".join(b[i : i + 40] + "\n" for i in range(0, len(b), 40)) for k, b in bases.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    try:
        lines = read_fasta(spark, f"{tmp_path}/all.fa")
        got = {}
        for r in lines.orderBy("chr", "start").collect():
            assert len(got.setdefault(r.chr, "")) == r.start
            got[r.chr] += r.bases
        assert got == bases
        sites = [(f"{k}:{i}", k, i, "A", "C") for k, b in bases.items() for i in range(1, len(b) + 1, 3)]
        out = polarise(spark.createDataFrame(sites, "v string, chr string, pos long, ref string, alt string"), lines, 16).collect()
        assert {r.v: r.ancestral for r in out} == {v: {"A": "REF", "C": "ALT"}.get(bases[k][i - 1]) for v, k, i, _, _ in sites}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_multiallelic_split(spark, files):
    vcf = Vcf(spark, f"{files}/a.vcf")
    found = vcf.variants(split=True).where("pos = 40")
    assert rows(found.select("variant_id", "allele")) == [("chr1:40:G:C", 1), ("chr1:40:G:T", 2)]
    everyone = spark.createDataFrame([(i, "A") for i in range(5)], "i int, pop string")
    assert rows(call_counts(vcf.calls(found), everyone).select("v", "ac", "an", "het")) == [("chr1:40:G:C", 1, 10, 1), ("chr1:40:G:T", 0, 10, 0)]


def test_unknown_population(spark):
    c = star_cohort(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="NOPE"):
        diversity(c, "chr1", None, None, "NOPE")
    with pytest.raises(ValueError, match="NOPE"):
        site_haplotypes(c, "NOPE")


def test_text(spark, tmp_path):
    df = spark.sql("SELECT 1.23456789D AS a, CAST(NULL AS INT) AS b, array(1, 2) AS c, 10.0D AS d, 1.5e-9D AS e")
    assert tuple(as_text(df).first()) == ("1.23457", "NA", "1,2", "10", "1.5e-09")
    for kind in ("tsv", "csv", "json"):
        write_text(df.drop("c"), f"{tmp_path}/{kind}", kind)
    assert spark.read.csv(f"{tmp_path}/tsv", sep="\t", header=True).first().b == "NA"


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9])
def test_packing(n):
    codes = [(i * 7 + 1) % 4 for i in range(n)]
    assert len(pack(codes, 2)) == -(-n // 4) and list(unpack(pack(codes, 2), n, 2)) == codes
    assert list(unpack(None, n, 1)) == [0] * n


def test_packed_genotypes(spark):
    c = star_cohort(spark, "/root/testdata/sf0.001")
    row = packed_genotypes(c).where("variant_id = 'chr1:2148:A:T'").first()
    gt = dict(rows(c.genotype.where("v = 4").select("sample", "gt")))
    assert {i: int(x) for i, x in enumerate(unpack(row.gt_packed, 100, 2)) if x} == gt
    assert F is not None
