import pytest
from pyspark.sql import functions as F

from pubspark.functions import similarity as S
from pubspark.operators import dedup


@pytest.mark.parametrize(
    ("a", "b", "misses", "share"),
    [
        ("one two three", "one two three", 0, 1.0), ("", "one", 0, 0.0), (None, None, 0, 0.0), ("alpha beta", "gammas deltas", 0, 0.0), ("lanterns sailing", "Lanterns, sailing!", 0, 1.0),
        ("sailing lanterns northward", "sailing lan terns northward", 0, 1.0), ("elephant", "elephant crocodile", 0, 0.5),
        ("elephant crocodile marmalade", "elephant transistor marmalade", 0, 1 / 3), ("elephant elephant", "elephant elephant", 0, 0.0),
    ],
)
def test_run_share(a, b, misses, share):
    assert S.run_share(a, b, misses) == pytest.approx(share)


def test_near():
    for a, b, near in (("kitten", "sitting", True), ("abcdefgh", "abxdxfxx", False), ("abc", "xyz", True), ("abcd", "wxyz", False), ("", "abcd", False)):
        assert S._near(a, b) is near


def test_names(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert value(S.same_name(F.lit("JO Waldner"), F.lit("Waldner, Jan-Ove"))) and not value(S.same_name(F.lit("Anna Bo"), F.lit("Bo Erik")))
    assert value(S.same_affiliation(F.lit("Uppsala university"), F.lit("Universitet of Uppsala, university"))) and not value(S.same_affiliation(F.lit("--"), F.lit("a")))
    assert value(S.same_text(F.lit(None).cast("string"), F.lit(""), 0.9)) and not value(S.same_text(F.lit("a"), F.lit(""), 0.1))
    assert value(S.letter_ratio(F.lit("abab"), F.lit("ABBA"))) == 1.0


def test_same_pairs(spark):
    rows = [
        (1, "Sailing with lanterns", "A long summary of the sailing voyage", "2020", ["d1"]), (2, "Sailing with lanterns", "Other words entirely here", "2019", ["d1"]),
        (3, "Sailing with lanterns", "A long summary of the sailing voyage", "2020-05", []), (4, "Sailing with lanterns", None, "2020", ["d2"]), (5, "Editorial", None, "2020", []), (6, "Editorial", None, "2020", []),
        (7, "Volume of tales 1", None, "2020", []), (8, "Volume of tales 2", None, "2020", []), (9, "Volume of tales 2", "", "2020-01", None),
    ]
    df = spark.createDataFrame(rows, "id long, title string, summary string, date string, doi array<string>")
    pairs = spark.createDataFrame([(a, b) for a in range(1, 10) for b in range(a + 1, 10)], "a long, b long")
    assert sorted(map(tuple, dedup.same_pairs(df, pairs, ["doi"]).collect())) == [(1, 2), (1, 3), (8, 9)]


def test_merges(spark):
    s = spark.createDataFrame([(1, 0, 0, "A", "c", "en"), (1, 1, 0, "A", "c", "en"), (1, 1, 1, "A", "d", "en"), (1, 2, 0, "B", "d", "en"), (1, 3, 0, "B", "d", "en")], "cluster_id int, rank int, pos int, label string, code string, language string")
    assert sorted((r.label, r.code) for r in dedup.merge_subjects(s).collect()) == [("A", "c"), ("A", "d"), ("B", "d")]
    p = spark.createDataFrame([(1, 0, "restricted"), (1, 1, "gratis"), (2, 0, "other"), (2, 1, None)], "cluster_id int, rank int, kind string")
    assert sorted(map(tuple, dedup.merge_policies(p).collect())) == [(1, "gratis"), (2, "other")]
    f = spark.createDataFrame([(1, 0, None, "x"), (1, 1, "a", "y"), (1, 2, "b", None)], "cluster_id int, rank int, p string, q string")
    assert tuple(dedup.merge_first(f, ["p", "q"]).first()) == (1, "a", "x")
    i = spark.createDataFrame([(1, 0, 0, "DOI", "a", None), (1, 0, 1, "DOI", "b", None), (1, 1, 0, "DOI", "a", "q"), (1, 1, 1, "DOI", "c", None), (1, 1, 2, "ISI", "d", None), (1, 1, 3, "ISI", "e", None)], "cluster_id int, rank int, pos int, kind string, value string, qualifier string")
    assert sorted((r.kind, r.value, r.qualifier) for r in dedup.merge_ids(i).collect()) == [("DOI", "a", "q"), ("DOI", "b", None), ("ISI", "d", None)]
    assert dedup.merge_status(spark.createDataFrame([(1, 0, "InPrint"), (1, 1, "Published")], "cluster_id int, rank int, status string")).first()["status"] == "Published"
