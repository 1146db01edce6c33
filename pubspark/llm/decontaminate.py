"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a window of ``SPAN`` words of which a fixed mask reads ``1``
positions and ignores the others. The masks leave out every pair of places, so
each window with at most two changed words leaves a seed whole; in items of up
to 16 words every pattern of changes that the verdict allows has such a
window, in longer ones every pattern of less than three changes in eight words.
Seeds of the benchmark are joined with those of every window of every document
(a place is added at both ends of a document, for passages cut there). Hits
only name a diagonal (document place - item place): along it the whole item is
compared with the document, and a document is contaminated if the equal places
on a diagonal number at least ``share`` of the item's words, or of ``enough``
words if the item is longer. Items of under SPAN words must occur exactly.

Words are runs of characters other than space and 0x09-0x0D, in lower case.

Cases: null and empty texts are clean; items without words are not looked for;
rows with one doc_id (null included) share a verdict, each compared on its own;
item_ids may be of any type that sorts, null among them; an item_id with
several texts stands for each; the item with the most equal places is named,
of several the smallest item_id (null before all); other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import TEXTS, tasks, written

SPAN = 8
MASKS = ["11010011", "01111001", "11100101", "00110111", "11101010", "10011101", "01011110", "10101011", "10110110", "01001111", "11110100"]
#: Seeds of a benchmark, or hits, that may be broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 200_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(df: DataFrame, hashes: str, shortest: int, *keep: str) -> DataFrame:
    """A row for each window of ``shortest`` words and more: ``keep``, pos and the hashes w0.. of its words (null after the last one)."""
    n = F.size(hashes) - (shortest - 1)
    parts = F.arrays_zip(*(F.slice(hashes, k + 1, n).alias(f"w{k}") for k in range(SPAN)))
    h = df.where(F.size(hashes) >= shortest).select(*keep, F.posexplode(parts).alias("pos", "__w"))
    return h.select(*keep, "pos", *(F.col("__w")[f"w{k}"].alias(f"w{k}") for k in range(SPAN)))


def _seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """A row for each window and mask that fits in it, with the mask's ``seed``."""
    seeds = [F.xxhash64(F.lit(int(m, 2)), F.lit(len(m)), *(F.col(f"w{k}") for k, x in enumerate(m) if x == "1")) for m in masks]
    return df.withColumn("seed", F.explode(F.array(*(F.when(F.col(f"w{len(m) - 1}").isNotNull(), x) for m, x in zip(masks, seeds, strict=True))))).where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words of the item and n_equal (the most equal places on one diagonal)."""
    texts = benchmark.where("text IS NOT NULL").select(F.col("item_id").alias("__item"), word_hashes(F.col("text")).alias("b")).where(F.size("b") > 0)
    # items are known by their words: equal ones are one
    texts = texts.withColumn("item", F.sha2(F.concat_ws(" ", F.transform("b", lambda x: x.cast("string"))), 256)).groupBy("item").agg(F.min(F.struct("__item")).alias("__least"), F.any_value("b").alias("b"))
    names = texts.select("item", F.col("__least.__item").alias("item_id"), F.size("b").cast("long").alias("n_words"))
    short = sorted(r[0] for r in texts.where(F.size("b") < SPAN).select(F.size("b")).distinct().collect())
    items = _seeds(_windows(texts, "b", SPAN, "item"), MASKS).select("seed", "item", F.col("pos").alias("at"))
    for n in short:
        whole = texts.where(F.size("b") == n)
        items = items.unionByName(_seeds(_windows(whole, "b", n, "item"), ["1" * n]).select("seed", "item", F.col("pos").alias("at")))
    items = items.distinct()
    few = items.count() <= BROADCAST_SEEDS
    edge = F.array(F.lit(0).cast("long"))
    padded = docs.select("doc_id", F.concat(edge, word_hashes(F.col("text")), edge).alias("h"))
    windows = _seeds(_windows(padded, "h", min([SPAN, *short]), "doc_id"), MASKS + ["1" * n for n in short])
    hits = windows.join(F.broadcast(items) if few else items, "seed")
    hits = hits.select("doc_id", "item", (F.col("pos") - 1 - F.col("at")).alias("diagonal"))
    spots = written(hits.distinct(), docs.count()).withColumnRenamed("doc_id", "__id")
    ids = spots.select("__id").distinct()
    if spots.count() <= BROADCAST_SEEDS:
        spots, ids = F.broadcast(spots), F.broadcast(ids)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    met = docs.select("doc_id", "text").join(ids, same, "left_semi").select("doc_id", word_hashes(F.col("text")).alias("h"))
    pairs = met.join(spots, same).join(F.broadcast(texts.select("item", "b")) if few else texts.select("item", "b"), "item")
    equal = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda k: F.get(F.col("h"), k + F.col("diagonal")) == F.get(F.col("b"), k))
    best = pairs.select("doc_id", "item", F.size(equal).cast("long").alias("n_equal")).groupBy("doc_id", "item").agg(F.max("n_equal").alias("n_equal"))
    return best.join(F.broadcast(names) if few else names, "item").select("doc_id", "item_id", "n_words", "n_equal")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, enough: int = 13) -> DataFrame:
    """Of each contaminated document: doc_id, the item with the most equal words (the smallest id of equals), the figures and the number of item_ids."""
    need = F.when(F.col("n_words") < SPAN, F.col("n_words")).otherwise(F.ceil(F.lit(share) * F.least("n_words", F.lit(enough))))
    found = overlaps(docs, benchmark).where(F.col("n_equal") >= need)
    top = F.min(F.struct((-F.col("n_equal")).alias("less"), F.col("item_id"), F.col("n_words")))
    many = F.count_distinct("item_id") + F.max(F.col("item_id").isNull().cast("long"))
    return found.groupBy("doc_id").agg(top.alias("t"), many.alias("n_items")).select("doc_id", F.col("t.item_id").alias("item_id"), F.col("t.n_words").alias("item_words"), (-F.col("t.less")).alias("n_equal"), "n_items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document's doc_id and whether it is contaminated, with the figures of the item found."""
    bad = contaminated(docs, benchmark, **options).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id").join(bad, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), "item_id", "item_words", "n_equal", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The clean documents with all their columns."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("__id"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").coalesce(tasks(docs.count(), TEXTS))
