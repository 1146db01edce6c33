import pytest
from pyspark.sql import functions as F

from pubspark.functions import text


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("k", "kalle", True), ("k", "anna", False), ("ab", "ac", False), ("abc", "abd", True), ("abcd", "abxy", False), ("abcde", "abcxy", True), ("andersson", "anderzonn", True), ("", "", False), ("a", "", False)],
)
def test_name_parts(spark, a, b, same):
    assert value(spark, text.same_name_part(F.lit(a), F.lit(b))) is same


def test_folding_and_keys(spark):
    assert value(spark, text.to_ascii(F.lit("1–2 a⁄b é"))) == "1-2 a/b "
    assert value(spark, text.fold(F.lit("Åsa Éva Ößž"))) == "Asa Eva Oßz"
    assert value(spark, text.local_id_key(F.lit("foo"), F.lit("foo"), F.lit("kalle.ninja"), F.lit("BarFoo"))) == "foo_foo_kalle.ninja_barfoo"
    assert value(spark, text.is_numeral(F.lit("XIV"))) and not value(spark, text.is_numeral(F.lit("xiv")))
    assert value(spark, text.bare_eid(F.lit("2-s2.0-123"))) == "123"


def test_dates_and_titles(spark):
    n = F.lit(None).cast("int")
    assert [value(spark, text.partial_date(F.lit(2020), m, d)) for m, d in ((n, n), (F.lit(3), n), (F.lit(3), F.lit(7)), (n, F.lit(7)))] == ["2020", "2020-03", "2020-03-07", "2020"]
    assert value(spark, text.same_date(F.lit("2020"), F.lit("2020-03-01"))) and not value(spark, text.same_date(F.lit("2020-02"), F.lit("2020-03-01")))
    split = lambda a, b: (value(spark, text.main_title(F.lit(a), F.lit(b).cast("string"))), value(spark, text.sub_title(F.lit(a), F.lit(b).cast("string"))))
    assert split("Main: sub: more", None) == ("Main", "sub: more")
    assert split("Main: sub", "own") == ("Main: sub", "own")
    assert split("Main", "") == ("Main", None)


def test_status_rank(spark):
    ranks = [value(spark, text.status_rank(F.lit(s).cast("string"))) for s in ("Published", "Retracted", "Other", None)]
    assert ranks == [1, 7, 8, 8]
