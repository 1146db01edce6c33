from pyspark.sql import functions as F

from pubspark.llm import components, decontaminate, neardup, quality, shared


def test_a_small_table_has_few_files(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(1000).groupBy((F.col("id") % 500).alias("k")).count()
        few, many = shared.written(rows, 500), shared.written(rows, 500, 20)
        assert len(few.inputFiles()) == shared.FEWEST and len(many.inputFiles()) == 25 and len(shared.written(rows).inputFiles()) == 40
        assert sorted(few.collect()) == sorted(many.collect()) == sorted(rows.collect())
        folders = []
        monkeypatch.setattr(shared, "shared_dir", lambda _, kept=shared.shared_dir: folders.append(kept(spark)) or folders[-1])
        edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 7).alias("b")).repartition(40)
        got = {r.node: r.component for r in components.components(edges, 300).collect()}
        assert got == {i: i - i % 7 for i in range(300) if i < 299 and i - i % 7 + 1 < 300 or i % 7}
        assert folders and all(len(spark.read.parquet(f).inputFiles()) <= shared.FEWEST for f in folders)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_pipeline_s_stages_write_few_files(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folders = []
        monkeypatch.setattr(shared, "shared_dir", lambda _, kept=shared.shared_dir: folders.append(kept(spark)) or folders[-1])
        words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.xxhash64(F.col("id") % 150, k)))
        docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(words, F.when(F.col("id") < 150, " end").otherwise("")).alias("text")).coalesce(2)
        left = neardup.drop_near_duplicates(docs)
        clean = decontaminate.decontaminate(left, spark.createDataFrame([(1, left.first().text)], "item_id long, text string"))
        assert left.count() == 150 and clean.count() == 149
        labels = docs.select("doc_id", (F.col("doc_id") % 20 > 0).cast("int").alias("quality"))
        assert quality.quality_filter(docs, labels).count() > 0
        assert len(folders) > 10 and all(len(spark.read.parquet(f).inputFiles()) <= shared.FEWEST for f in folders)
        assert left.rdd.getNumPartitions() <= shared.FEWEST and clean.rdd.getNumPartitions() <= shared.FEWEST
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
