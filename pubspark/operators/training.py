"""Training text for subject classifiers, and the language that a text is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .service import with_ancestors

# Frequent words of both languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "are", "this", "by", "was", "from"],
    "sv": ["och", "att", "det", "som", "en", "av", "för", "med", "den", "till", "är", "inte", "har", "ett"],
}


def language_scores(text: Column) -> dict[str, Column]:
    """The share of each language's words among all frequent words of the text; 0 without any."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+")

    def among(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(known)))

    n = {k: among(v) for k, v in STOP_WORDS.items()}
    total = sum(n.values(), F.lit(0))
    return {k: F.when(total > 0, x / total).otherwise(F.lit(0.0)) for k, x in n.items()}


def language(text: Column, least: float = 0.5) -> Column:
    """The language of at least that share, the first of equals; null for none."""
    scores = language_scores(text)
    best = F.greatest(*scores.values())
    return F.when(best >= least, F.coalesce(*(F.when(s == best, F.lit(k)) for k, s in scores.items())))


def examples(rows: DataFrame, target: str, low: int = 1, high: int = 5) -> DataFrame:
    """id, text and codes for training, from rows (id, title, summary, keywords, codes).

    Codes are those of ``low`` to ``high`` digits, with those above them. A
    summary counts if it has 50 letters and is in the target language; records
    without code, or with neither such a summary nor a title of 40 letters, are left out.
    """
    codes = F.filter("codes", lambda c: F.length(c).between(low, high))
    summary = F.trim(F.regexp_replace(F.left(F.coalesce("summary", F.lit("")), F.lit(5000)), "\\s+", " "))
    summary = F.when((F.length(summary) >= 50) & F.coalesce(language(summary) == target, F.lit(False)), summary).otherwise("")
    df = rows.withColumn("codes", codes).where(F.size("codes") > 0).withColumn("summary", summary).withColumn("title", F.coalesce("title", F.lit("")))
    df = df.where((F.length("summary") >= 50) | (F.length("title") >= 40))
    return df.select("id", F.concat_ws(" ", "title", "summary", F.array_join("keywords", " ")).alias("text"), F.array_sort(with_ancestors(F.col("codes"))).alias("codes"))
