from collections import defaultdict
from statistics import mean, pstdev

import __spark_entry__ as entry
from varspark.operators import diversity as dv
from varspark.operators import haplotypes as hp
from varspark.operators import posthoc as ph
from varspark.queries_fast import cohort, rounded

SF = "/root/testdata/sf0.001"
POPS = [f"POP{i}" for i in range(5)]


def test_convergent_sweeps(spark):
    c = cohort(spark, SF)
    sites = [(r.gene, r.chr, r.pos) for r in c.has_consequence.join(c.variant, "v").select("gene", "chr", "pos").collect()]
    best = defaultdict(dict)
    for p in POPS:
        for w in rounded(hp.garud_h(c, p, 50_000, 25_000)).where("h12 >= 0.03").collect():
            for gene, chr, pos in sites:
                if chr == w.chr and w.start <= pos <= w.end:
                    best[gene][p] = max(w.h12, best[gene].get(p, 0))
    want = {(g, len(x), max(x.values())) for g, x in best.items() if len(x) >= 2}
    assert {tuple(r) for r in entry.queries()["convergent_sweeps"](spark, SF).select("gene", "n_groups", "max_h12").collect()} == want
    assert max(n for _, n, _ in want) > 1


def test_temporal_strata(spark):
    c = cohort(spark, SF)
    share = {}
    for p in POPS:
        w = rounded(dv.genome_scan(c, p, 50_000, 25_000)).collect()
        t, f = ([x[k] for x in w if x[k] is not None] for k in ("tajima_d", "fay_wu_h"))
        share[p] = mean(x <= 0.5 for x in t), mean(x <= -0.5 for x in f)
    out = {r.population: r for r in entry.queries()["temporal_strata"](spark, SF).collect()}
    assert sorted(out) == POPS and any(abs(r.z_recent) > 0.1 for r in out.values())
    for i, name in enumerate(("recent", "old")):
        x = [s[i] for s in share.values()]
        for p in POPS:
            z = (share[p][i] - mean(x)) / pstdev(x) if pstdev(x) else 0
            assert abs(out[p][name] - share[p][i]) < 2e-6 and abs(out[p][f"z_{name}"] - z) < 2e-6
    for r in out.values():
        assert r.layer == ("recent" if r.z_recent >= r.z_old else "old")


def test_evidence_of_pathways(spark):
    from types import SimpleNamespace

    make = spark.createDataFrame
    c = SimpleNamespace(in_pathway=make([("p1", "a"), ("p1", "b"), ("p1", "b"), ("p2", "b"), ("p3", "z")], "pathway string, gene string"), has_go_term=make([("b", "t1"), ("b", "t2"), ("a", "t9")], "gene string, go string"))
    fst = make([("p1", 0.2), ("p3", 0.1), ("p4", 0.0)], "pathway string, fst double")
    found = ph.pathway_evidence(c, fst, make([("a", 2), ("b", 5)], "gene string, n_groups long"), make([("t1",), ("t2",)], "term string"))
    out = {r.pathway: r for r in ph.synthesis(found, {"fst": 0, "n_convergent_genes": 0, "n_groups": 3, "n_go_genes": 0}, "pathway").collect()}
    assert {k: (r.fst, r.n_convergent_genes, r.n_go_genes, r.n_groups, r.n_lines, r.tier) for k, r in out.items()} == {
        "p1": (0.2, 2, 1, 5, 4, "HIGH"), "p2": (0.0, 1, 1, 5, 3, "HIGH"), "p3": (0.1, 0, 0, 0, 1, "LOW"), "p4": (0.0, 0, 0, 0, 0, "LOW"),
    }
    assert out["p1"].composite > out["p2"].composite > out["p4"].composite and out["p1"].fst_scaled == 1


def test_equal_means_lie_on_the_same_side_of_a_cut(spark):
    from types import SimpleNamespace

    make = spark.createDataFrame
    # the means 0.15 of (0.15) and (0.1, 0.2) are equal, but not if added as doubles: (0.1 + 0.2) / 2 > 0.15
    lies = {1: ["a"], 2: ["c"], 3: ["a", "b"], 4: ["d"], 5: ["e"]}
    c = SimpleNamespace(
        has_consequence=make([(v, f"g{v}", "missense_variant", "HIGH") for v in lies], "v long, gene string, consequence string, impact string"),
        in_pathway=make([(f"g{v}", p) for v, x in lies.items() for p in x], "gene string, pathway string"),
        variant_pop=make([(v, 1, 100) for v in lies], "v long, ac int, an int"),
        genotype=make([(v, v, 1, 0) for v in lies], "v long, sample int, gt int, phase int"),
        sample=make([(v, "POP0") for v in lies], "sample int, pop string"),
    )
    fst = make([("a", 0.1), ("b", 0.2), ("c", 0.15), ("d", 0.5), ("e", 0.6)], "pathway string, fst double")
    out = {r.sample: (r.constrained, r.divergent) for r in ph.pathway_burden(c, fst).collect()}
    assert out == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (0, 1), 5: (0, 1)}
