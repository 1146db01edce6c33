"""Audits that need other tables: journal levels, open-access links, publisher facts, subject concepts; and affiliations of one body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def journal_level(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """The best level of any of a record's journals in its year (null: none is listed), from rows (id, yr, issn) and (yr, issn, level)."""
    return rows.join(levels.select("yr", "issn", "level"), ["yr", "issn"], "left").groupBy("id").agg(F.max("level").alias("level"))


def merge_affiliations(items: Column, own: str) -> Column:
    """One affiliation for those that name one body in several languages: with one ROR id, or with one id of the ``own``
    source where just two are of it and two languages occur. Merged ones come first, in order; the others stay as they are.

    Items are structs with identifiedBy (@type, value, source.code), nameByLang (a map) and name.
    """
    first = lambda a: F.get(F.coalesce(a["identifiedBy"], F.array()), F.lit(0))
    langs = lambda a: F.coalesce(F.map_keys(a["nameByLang"]), F.array().cast("array<string>"))
    mine = lambda a: F.coalesce(first(a)["source"]["code"] == own, F.lit(False))
    pair = (F.size(F.filter(items, mine)) == 2) & (F.size(F.array_distinct(F.filter(F.transform(items, lambda a: F.get(langs(a), F.lit(0))), lambda x: x.isNotNull()))) == 2)
    named = lambda a: first(a).isNotNull() & (F.size(langs(a)) > 0)
    key = lambda a: F.when(named(a), F.when(first(a)["@type"] == "ROR", F.concat(F.lit("ror "), first(a)["value"])).when(mine(a) & pair, F.concat(F.lit("own "), first(a)["value"])))
    keys = F.array_distinct(F.filter(F.transform(items, key), lambda k: k.isNotNull()))

    def whole(k: Column) -> Column:
        group = F.filter(items, lambda a: key(a) == k)
        entry = lambda a: F.struct(F.get(langs(a), F.lit(0)).alias("key"), F.get(F.map_values(a["nameByLang"]), F.lit(0)).alias("value"))
        entries = F.transform(group, entry)
        last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))  # of a language named twice the last
        return F.get(group, F.lit(0)).withField("nameByLang", F.map_from_entries(last)).withField("name", F.lit(None).cast("string"))

    return F.concat(F.transform(keys, whole), F.filter(items, lambda a: key(a).isNull()))


def expand_subjects(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Subjects of records once each, with the concept's label and those above it: id, code, label, broader, from rows (id, pos, code) and (code, label, broader)."""
    one = rows.groupBy("id", "code").agg(F.min("pos").alias("pos"))
    return one.join(concepts.select("code", "label", "broader"), "code", "left").select("id", "pos", "code", "label", "broader")


def embellish(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """Terms (id, term, note) with their concept's description in place of the address, and their own note: three levels, flattened before the join."""
    up = concepts.select(F.col("code").alias("__c"), F.col("label").alias("broader_label"), F.col("broader").alias("__b"))
    top = concepts.select(F.col("code").alias("__t"), F.col("label").alias("top_label"))
    flat = concepts.join(up, F.col("broader") == F.col("__c"), "left").join(top, F.col("__b") == F.col("__t"), "left").select(F.col("code").alias("term"), "label", "broader_label", "top_label")
    return terms.join(flat, "term", "left").select("id", "term", "label", "broader_label", "top_label", "note")


def open_links(ids: DataFrame, books: DataFrame, articles: DataFrame, have: DataFrame) -> DataFrame:
    """Open-access links to add: id, uri and origin. Books' identifiers first; articles' DOIs where no book is found; none that the record has.

    ``ids``: id, kind, value; ``books``: value, uri; ``articles``: doi, uri; ``have``: id, uri.
    """
    book = ids.where(F.col("kind").isin("ISBN", "DOI")).join(books.groupBy("value").agg(F.min("uri").alias("uri")), "value").groupBy("id").agg(F.min("uri").alias("uri")).withColumn("origin", F.lit("book"))
    other = ids.where("kind = 'DOI'").join(articles.groupBy(F.col("doi").alias("value")).agg(F.min("uri").alias("uri")), "value").groupBy("id").agg(F.min("uri").alias("uri"))
    both = book.unionByName(other.join(book.select("id"), "id", "left_anti").withColumn("origin", F.lit("article")))
    return both.join(have.select("id", "uri").distinct(), ["id", "uri"], "left_anti")


FACTS = ["publisher", "place", "print_date", "online_date", "issn", "summary", "license"]


def publisher_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Records with what they lack from a table of publishers' facts by DOI: id, each fact and ``added``, the codes of those that were added."""
    df = rows.join(facts.select("doi", *(F.col(c).alias(f"__{c}") for c in FACTS)), "doi", "left")
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    new = {c: none(c) & ~none(f"__{c}") for c in FACTS}
    added = F.array_compact(F.array(*(F.when(new[c], F.lit(f"add_{c}")) for c in FACTS)))
    return df.select("id", *(F.when(new[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in FACTS), added.alias("added"))
