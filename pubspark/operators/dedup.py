"""Pairs of records that are one publication, and the merge of a group's records.

Pairs come from blocking, never from a cross join. All that SQL can decide is
decided before the words are walked. Merges work on long tables with a map-side
combine on (group, key), so that no group is gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import shared_run
from ..functions.text import is_numeral, same_date, status_rank

# Titles too common to tell publications apart.
POOR_TITLES = [
    "Introduction", "Inledning", "Indledning", "Editorial", "Förord", "Preface", "Introduktion", "Review of", "Foreword", "Recensioner", "Conclusion", "Efterord", "Reply",
    "Book review", "Recension", "Conclusions", "Review", "Erratum", "Commentary", "Guest editorial", "Untitled", "Erratum to", "Editorial Introduction", "Avslutning", "Corrigendum",
    "Afterword", "Response", "Correction to", "Re", "Epilogue", "Från redaktionen", "Kommentar", "Vorwort", "Epilog", "Recension av", "Letter", "In memoriam", "Correction",
    "Debatt", "[Not Available]", "Aktuellt", "Letter to the Editor", "recension", "Discussion", "Slutord", "Note", "Invited", "Comment on",
]


def titles_may_match(a: Column, b: Column) -> Column:
    """Neither is too common, and a number that ends one of two titles of several words ends the other."""
    last = lambda c: F.rtrim(F.translate(F.substring_index(c, " ", -1), "-–.!?", ""))
    several = a.contains(" ") & b.contains(" ")
    numbers = several & (is_numeral(last(a)) | is_numeral(last(b))) & (last(a) != last(b))
    return ~a.isin(POOR_TITLES) & ~b.isin(POOR_TITLES) & ~F.coalesce(numbers, F.lit(False))


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def same_pairs(rows: DataFrame, pairs: DataFrame, id_columns: list[str], doi: str = "doi") -> DataFrame:
    """Pairs (a, b) of ``pairs`` that are one publication by title and identifiers, or by title, summary and date.

    ``rows``: id, title, summary, date (text) and one array for each kind of
    identifier. Two records that both have DOIs need the same ones. Titles need
    more than 0.7 of the words in a run, summaries more than 0.6 with misses;
    two records without summary agree in it, one without does not.
    """
    kept = [F.col(c) for c in ("title", "summary", "date")] + [_set(F.col(c)).alias(c) for c in id_columns]
    side = lambda s: rows.select(F.col("id").alias(s), *(x.alias(f"{s}_{c}") for x, c in zip(kept, ["title", "summary", "date", *id_columns], strict=True)))
    df = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    x, y = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    none = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    shared = reduce(lambda p, q: p | q, ((F.size(x(c)) > 0) & (x(c) == y(c)) for c in id_columns))
    doi_ok = (F.size(x(doi)) == 0) | (F.size(y(doi)) == 0) | (x(doi) == y(doi))
    dates = ~none(x("date")) & ~none(y("date")) & same_date(F.trim(x("date")), F.trim(y("date")))
    maybe = dates & (none(x("summary")) == none(y("summary")))
    df = df.where(doi_ok & titles_may_match(x("title"), y("title")) & (shared | maybe)).withColumn("__ids", shared)
    df = df.withColumn("__title", shared_run(x("title"), y("title"))).where("__title > 0.7")
    by_id, rest = df.where("__ids"), df.where("NOT __ids")
    bare = rest.where(none(x("summary")))
    told = rest.where(~none(x("summary"))).withColumn("__sum", shared_run(x("summary"), y("summary"), 3)).where("__sum > 0.6")
    return reduce(DataFrame.unionByName, (p.select("a", "b") for p in (by_id, bare, told)))


def master(rows: DataFrame) -> DataFrame:
    """The fullest record of each group, from rows (cluster_id, id, size); of equals the least id."""
    return rows.groupBy("cluster_id").agg(F.max_by("id", F.struct("size", (-F.col("id")).alias("__o"))).alias("master"))


#: Kinds of identifier of which a group's record keeps all values.
MANY = ["ISSN", "ISBN", "URI"]


def merge_ids(ids: DataFrame) -> DataFrame:
    """Identifiers of each group's record, from rows (cluster_id, rank, pos, kind, value, qualifier); rank 0 is the master.

    The master's own stay. Others' are added if the group has none of that kind
    yet, or for ``MANY``; a missing qualifier is taken from the next that has one.
    """
    at = F.struct("rank", "pos")
    one = ids.groupBy("cluster_id", "kind", "value").agg(F.min(at).alias("at"), F.min_by("qualifier", F.when(F.col("qualifier").isNotNull(), at)).alias("qualifier"))
    first = one.groupBy("cluster_id", "kind").agg(F.min("at").alias("first"))
    df = one.join(first, ["cluster_id", "kind"])
    return df.where((F.col("at.rank") == 0) | F.col("kind").isin(MANY) | (F.col("at") == F.col("first"))).select("cluster_id", "kind", "value", "qualifier")


def merge_status(rows: DataFrame) -> DataFrame:
    """The status that goes first in each group, from rows (cluster_id, rank, status)."""
    return rows.groupBy("cluster_id").agg(F.min_by("status", F.struct(status_rank(F.col("status")), "rank")).alias("status"))


def merge_classes(rows: DataFrame) -> DataFrame:
    """Codes of each group, from rows (cluster_id, code, auto): automatic ones go where there are manual ones."""
    one = rows.groupBy("cluster_id", "code").agg(F.min(F.col("auto").cast("int")).alias("auto"))
    low = one.groupBy("cluster_id").agg(F.min("auto").alias("low"))
    return one.join(low, "cluster_id").where("auto = low").select("cluster_id", "code", "auto")


def merge_subjects(rows: DataFrame) -> DataFrame:
    """Subjects of each group, from rows (cluster_id, rank, pos, label, code, language): the master's, and others' whose label or code and language are new.

    Equal labels are first combined, so that each (group, label) is one row.
    """
    key = F.coalesce("code", F.lit("")), F.coalesce("language", F.lit(""))
    at = F.struct("rank", "pos")
    one = rows.groupBy("cluster_id", F.coalesce("label", F.lit("")).alias("label"), key[0].alias("code"), key[1].alias("language")).agg(F.min(at).alias("at"))
    by_label = one.groupBy("cluster_id", "label").agg(F.min("at").alias("l"))
    by_code = one.groupBy("cluster_id", "code", "language").agg(F.min("at").alias("c"))
    df = one.join(by_label, ["cluster_id", "label"]).join(by_code, ["cluster_id", "code", "language"])
    return df.where((F.col("at.rank") == 0) | (F.col("l") == F.col("at")) | (F.col("c") == F.col("at"))).select("cluster_id", "label", "code", "language")


def merge_policies(rows: DataFrame) -> DataFrame:
    """Access of each group, from rows (cluster_id, rank, kind): gratis before restricted before all else, then the master's."""
    order = F.when(F.col("kind") == "gratis", 0).when(F.col("kind") == "restricted", 1).otherwise(2)
    return rows.where("kind IS NOT NULL").groupBy("cluster_id").agg(F.min_by("kind", F.struct(order, "rank")).alias("kind"))


def merge_first(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's value in the record of least rank that has one (publication facts, copyright, creator count)."""
    return rows.groupBy("cluster_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in columns))
