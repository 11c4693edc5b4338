import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_queries_take_the_whole_table(spark):
    q = entry.queries()
    variants = {r.label: r.n for r in q["inventory"](spark, SF).collect()}["variant"]
    assert q["extract_genotypes"](spark, SF).select("variant_id").distinct().count() == variants
    for name in ("diversity_hwe", "diversity_subset", "divergence_pair", "divergence_pbs", "sfs_facts", "joint_sfs_facts"):
        n = q[name](spark, SF).first()["n_variants"]
        assert n <= variants and (name == "diversity_hwe" or n == variants), name


def test_linked_pairs_of_every_chromosome(spark):
    q = entry.queries()
    of = {r.variant_id: r.chr for r in q["vcf_round_trip"](spark, SF).select("variant_id", "chr").distinct().collect()}
    pairs = [(of[r.variant1], of[r.variant2]) for r in q["ld_pairs"](spark, SF).collect()]
    assert {a for a, _ in pairs} == set(of.values()) and all(a == b for a, b in pairs)
