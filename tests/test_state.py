import json

import pytest
from pyspark.sql import functions as F

from pubspark.operators import service, state


def test_pages_of_json(spark):
    rows = spark.range(600).select(F.col("id").alias("k"))
    parts = list(state.json_pages(rows.repartition(3), {"source": "x"}, "items"))
    got = json.loads("".join(parts))
    assert got["source"] == "x" and sorted(r["k"] for r in got["items"]) == list(range(600)) and len(parts) > 3
    assert json.loads("".join(state.json_pages(rows.limit(0), {}, "items"))) == {"items": []}


def test_records_on_disk_and_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", "<x>1\n2</x>"), ("a", "<y/>"), ("b", "<z/>")], "source string, xml string")
    state.write_records(rows, f"file://{tmp_path}/r")
    got = spark.read.text(f"file://{tmp_path}/r")
    assert sorted((r["source"], r["value"]) for r in got.collect()) == [("a", "<x>1 2</x>"), ("a", "<y/>"), ("b", "<z/>")]
    order = [r[0] for r in state.shuffled(spark.range(50), "id", 3).collect()]
    assert order == [r[0] for r in state.shuffled(spark.range(50).repartition(7), "id", 3).collect()] != sorted(order) and sorted(order) == list(range(50))


def test_guards(spark):
    rows = spark.createDataFrame([("s1",)], "source string")
    assert service.require(rows, "source", "s1").count() == 1
    with pytest.raises(LookupError):
        service.require(rows, "source", "none")
    with pytest.raises(ValueError):
        service.suggest(rows, rows, 2)
    last = spark.sql("SELECT 's1' AS source, timestamp'2024-05-06 07:08:09' AS last_successful_harvest")
    assert state.from_time(last, "s1") == "2024-05-06T07:08:09Z" and state.from_time(last, "other") is None
