from varspark.plans.cohort import star_cohort
from varspark.streaming.windows import window_diversity


def test_stream_equals_batch(spark, tmp_path):
    sites = star_cohort(spark, "/root/testdata/sf0.001").variant_pop.select("chr", "pos", "pop", "ac", "an")
    sites.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(sites.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = window_diversity(stream, 10_000).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((r.chr, r.start, r.pop, r.n_variants, round(r.pi, 9)) for r in df.collect())
    assert rows(spark.table("windows")) == rows(window_diversity(sites, 10_000))
