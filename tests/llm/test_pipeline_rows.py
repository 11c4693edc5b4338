import corpus_pipeline


def test_near_duplicates_go_by_row(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [
        (None, text("a")), (1, text("a")), (None, text("b")), (None, text("c")), (None, text("c") + " more"),  # one null id is linked, others aren't, two only with each other
        (2, text("d")), (3, text("d")), (3, text("e")),  # another row of doc 3 is unlike all
        (4, text("f")), (4, text("f")), (5, None), (None, ""), (None, None),
    ]
    df = spark.createDataFrame([(d, t, "en", f"s{i}", len(t or "")) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    kept = {int(r.source[1:]) for r in out}
    assert len(out) == len(kept) and all((r.doc_id, r.text) == rows[int(r.source[1:])] for r in out)
    assert kept - {3, 4, 8, 9} == {1, 2, 5, 7, 10, 11, 12}
    assert len(kept & {3, 4}) == 1 and len(kept & {8, 9}) == 1


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and further columns: every stage returns the columns of documents and loses no clean row."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(80))
    rows = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "word " * 40_000, "en", "a", 200_000), (None, text("n"), None, "b", 5), (4, text("q"), "de", "c", 1), (4, text("q"), "de", "c", 1), (5, text("r") + "\nshared line of text", "fr", "a", 2), (6, text("s") + "\nshared line of text", "fr", "a", 2)]
    names = "doc_id long, text string, lang string, source string, n_chars long, _file long, unit long, class string"
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], names)
    sf = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    gone = {"near_dedup": 1}  # of the repeated row one stays
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns[:5] == columns and (out.columns == columns or i == 4), name
        assert len(got) == len(rows) - gone.get(name, 0), name
        assert {r.doc_id for r in got} == {r[0] for r in rows}, name
    lines = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf).collect()}
    assert lines[5] == rows[7][1] and lines[6] == text("s")
