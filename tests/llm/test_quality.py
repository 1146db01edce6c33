import numpy as np
import pytest
from pyspark.sql import functions as F

from pubspark.llm import quality, shared


@pytest.mark.parametrize("k", [0, 1, 700, 2999])
def test_nth(spark, k):
    values = np.random.default_rng(k).random(3000) ** 3
    rows = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "key long")
    assert np.int64(quality.nth(rows, "key", k)).view(np.float64) == np.sort(values)[k]


def test_forest_and_threshold_come_from_every_labelled_row(spark):
    """Good rows beyond the 20,000 of the smallest hash, which once were all that was learnt from, are of another kind."""
    order = [r.doc_id for r in spark.range(26_000).toDF("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    plain, other = "some words that are as usual as any in a text", "SOME WORDS! THAT! ARE &&&& AS %%%% LOUD AS ANY! IN A TEXT!"
    docs = spark.createDataFrame([(i, plain if k < 20_000 else other) for k, i in enumerate(order)], "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = quality.quality_scores(docs, labels)
    assert got.where("kept").count() >= 26_000 * 0.998
    assert quality.quality_filter(docs, labels).count() == got.where("kept").count()
    # the threshold is the one of all scores, sorted
    seen = docs.select("doc_id", quality.text_stats("text").alias("s"))
    bad = F.col("doc_id") % 50 == 0
    forest = quality.train(seen, labels.withColumn("quality", F.when(bad, 0).otherwise(1)), max_false=0.5)
    rows = seen.select("doc_id", "s.*").toPandas()
    score = forest.score(quality.features({c: rows[c].to_numpy() for c in quality.STATS}))
    off = (rows.doc_id % 50 == 0).to_numpy()
    clean = np.sort(score[~off])
    low = clean[int(np.ceil(len(clean) * 0.5))]
    found = score[off & (score > low)]
    assert forest.threshold == ((low + found.min()) / 2 if len(found) else clean[-1])


def test_what_is_kept_lies_in_few_partitions(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words that are as usual as any in a text "), F.col("id").cast("string")).alias("text")).repartition(24)
        kept = quality.quality_filter(docs, docs.select("doc_id", F.lit(1).alias("quality")))
        assert kept.rdd.getNumPartitions() <= shared.FEWEST and kept.count() >= 600 * 0.99
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
