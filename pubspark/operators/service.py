"""What the read services answer: single records, rejected records, suggestions and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import search

# The rules' names in both languages.
RULE_LABELS = {
    "recordContentSourceViolation": ("Organisationskod saknas", "Missing organization code"),
    "nameViolation": ("Upphov felaktigt", "Invalid contribution"),
    "titleViolation": ("Titel saknas", "Missing title"),
    "publicationOrOutputTypeViolation": ("Outputtyp/publikationstyp felaktig", "Invalid output/publication type"),
    "contentTypeViolation": ("Innehållstyp felaktig", "Invalid content type"),
    "publicationDateViolation": ("Utgivningsdatum saknas", "Missing publication date"),
    "uriViolation": ("URI saknas", "Missing URI"),
    "languageViolation": ("Språkkod felaktig", "Invalid language code"),
    "relatedItemTypeMissing": ("Värdpublikation saknas", "Missing host publication"),
    "relatedItemTypeViolation": ("Värdpublikation felaktig", "Invalid host publication"),
}


def require(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of a value; an unknown one is an error before anything else runs."""
    out = rows.where(F.col(column) == value)
    if out.isEmpty():
        raise LookupError(f"Not found: {value}")
    return out


def publication(finalized: DataFrame, oai_id: str) -> DataFrame:
    """A merged record's text without the fields of its making, from rows (oai_id, d)."""
    return finalized.where(F.col("oai_id") == oai_id).select("oai_id", F.to_json(F.col("d").dropFields("_publication_ids", "_publication_orgs")).alias("data"))


def processed(converted: DataFrame, oai_id: str) -> DataFrame:
    """A converted record, if it is live."""
    return converted.where((F.col("oai_id") == oai_id) & (F.col("deleted") == 0))


def original(originals: DataFrame, oai_id: str) -> DataFrame:
    """A record's XML as it was harvested."""
    return originals.where(F.col("oai_id") == oai_id).select("oai_id", "xml")


def rejected(rows: DataFrame, harvest_id: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of a harvest's rejected records in order of id: record_id, errors (code, labels) and the harvest's total, from rows (id, harvest_id, oai_id, rejection_cause)."""
    mine = require(rows, "harvest_id", harvest_id)
    labels = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("swe"), F.lit(x[1]).alias("eng")) for kv in RULE_LABELS.items() for x in kv))
    errors = F.transform(F.from_json("rejection_cause", "array<string>"), lambda c: F.struct(c.alias("error_code"), F.try_element_at(labels, c).alias("label")))
    rows = mine.select("id", F.col("oai_id").alias("record_id"), errors.alias("errors"), F.lit(mine.count()).alias("total"))
    return search.page(rows, ["id"], limit, offset)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) > 2))


def learn(examples: DataFrame) -> DataFrame:
    """word, code and weight (the share of the word's texts that have the code), from rows (id, text, code)."""
    each = examples.select("id", "code", F.explode(words_of(F.col("text"))).alias("word")).distinct()
    of_word = each.groupBy("word").agg(F.count_distinct("id").alias("n"))
    return each.groupBy("word", "code").agg(F.count(F.lit(1)).alias("k")).join(of_word, "word").select("word", "code", (F.col("k") / F.col("n")).alias("weight"))


def suggest(texts: DataFrame, weights: DataFrame, level: int, limit: int = 20, threshold: float = 0.1, most: int = 5) -> DataFrame:
    """id, code, score and rank: of each text's ``limit`` best codes over the threshold those of ``level`` digits, ``most`` of them.

    A code's score is the mean weight of the text's words; any table of weights will do.
    """
    if level not in (1, 3, 5):
        raise ValueError("Level must be 1, 3 or 5")
    each = texts.select("id", words_of(F.col("text")).alias("w")).select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    scores = each.join(weights, "word").groupBy("id", "n", "code").agg((F.sum("weight") / F.col("n")).alias("score")).where(F.col("score") >= threshold)
    best = Window.partitionBy("id").orderBy(F.desc("score"), "code")  # a row for each code at most
    top = scores.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= limit).where(F.length("code") == level)
    return top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("id", "code", F.round("score", 6).alias("score"), "rank")


def with_ancestors(codes: Column) -> Column:
    """Codes of three and five digits with those of one and three digits above them."""
    up = lambda c: F.array_compact(F.array(F.when(F.length(c) > 1, F.left(c, F.lit(1))), F.when(F.length(c) > 3, F.left(c, F.lit(3))), c))
    return F.array_distinct(F.flatten(F.transform(codes, up)))


def tree(concepts: DataFrame) -> DataFrame:
    """The top concepts (code, label, narrower), each with those below it down to the third level, from rows (code, label, broader)."""
    def below(df: DataFrame, kids: DataFrame, shape: Column) -> DataFrame:
        sets = kids.groupBy(F.col("broader").alias("__up")).agg(F.sort_array(F.collect_list(shape)).alias("narrower"))
        return df.join(sets, df["code"] == F.col("__up"), "left").drop("__up")

    tops = concepts.where("broader IS NULL")
    second = concepts.join(tops.select(F.col("code").alias("broader")), "broader", "left_semi")
    third = concepts.join(second.select(F.col("code").alias("broader")), "broader", "left_semi")
    second = below(second, third, F.struct("code", "label"))
    return below(tops, second, F.struct("code", "label", "narrower")).select("code", "label", "narrower")
