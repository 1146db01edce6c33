"""Pre-aggregates of live records, and the status reports made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places, 0 where whole is 0 or null."""
    return F.coalesce(F.round(F.when(whole != 0, part / whole * 100), 2), F.lit(0.0))


def stats_converted(live: DataFrame) -> DataFrame:
    """By source and year: records, and how many are open access, peer-reviewed and classified."""
    return live.groupBy("source", "yr").agg(
        F.countDistinct("id").alias("total"),
        F.sum("is_open_access").cast("long").alias("open_access"),
        F.sum("classification_level").cast("long").alias("swedishlist"),
        F.sum("has_ssif_1").cast("long").alias("ssif"),
    )


def year_range(df: DataFrame, start: int | None = None, end: int | None = None, column: str = "yr") -> DataFrame:
    """Both bounds or neither; they are inclusive."""
    if (start is None) != (end is None):
        raise ValueError(f"Missing parameter: '{'to' if end is None else 'from'}'")
    if start is None:
        return df
    if end < start:
        raise ValueError("'to' cannot be before 'from'")
    return df.where(F.col(column).between(start, end))


def datastatus(stats: DataFrame, source: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """By source: sums, each one's share of its source's total, and the source's share of all records."""
    df = year_range(stats, start, end)
    if source is not None:
        df = df.where(F.col("source") == source)
    sums = df.groupBy("source").agg(*(F.sum(c).cast("long").alias(c) for c in ("total", "open_access", "swedishlist", "ssif")))
    everything = F.sum("total").over(Window.partitionBy())  # a row for each source
    return sums.select(
        "source", "total", "open_access", "swedishlist", "ssif",
        *(percent(F.coalesce(F.col(c), F.lit(0)), F.col("total")).alias(f"{c}_pct") for c in ("open_access", "swedishlist", "ssif")),
        percent(F.col("total"), everything).alias("source_pct"),
    )


ENRICHING = ["auto_classify", "add_oa"]


def stats_ssif(ssif: DataFrame) -> DataFrame:
    """By source, year and subject: occurrences."""
    return ssif.groupBy("source", "yr", "value").agg(F.count(F.lit(1)).alias("n"))


def stats_audit_events(audits: DataFrame) -> DataFrame:
    """By source, code and year: valid and invalid results.

    For a creator count and for codes that enrich, true is the good result;
    codes that enrich have no invalid one; for the other checks true is a fault.
    """
    code, true = F.col("audit_code"), F.col("audit_result") == 1
    good = code.isin("creator_count_check", *ENRICHING)
    valid = F.when(good, true).otherwise(~true)
    invalid = F.when(code.isin(*ENRICHING), F.lit(False)).otherwise(~valid)
    return audits.groupBy("source", "audit_code", "yr").agg(F.count_if(valid).alias("valid"), F.count_if(invalid).alias("invalid"))


FIELD_SUMS = {
    "v_invalid": ("validation_status", 0), "v_valid": ("validation_status", 1), "e_unchanged": ("enrichment_status", 0), "e_enriched": ("enrichment_status", 1),
    "e_unsuccessful": ("enrichment_status", 2), "n_unchanged": ("normalization_status", 0), "n_normalized": ("normalization_status", 1),
}


def stats_field_events(info: DataFrame) -> DataFrame:
    """By source, field and year: how many occurrences have each status."""
    return info.groupBy("source", "field_name", "yr").agg(*(F.count_if(F.col(c) == v).alias(k) for k, (c, v) in FIELD_SUMS.items()))


def ssif_shares(ssif: DataFrame, stats: DataFrame) -> DataFrame:
    """By one-digit subject: occurrences and their share of all records (0 where there are none)."""
    total = stats.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("records")).withColumn("k", F.lit(1))  # one row
    return ssif.groupBy("value").agg(F.sum("n").cast("long").alias("n")).withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("value", "n", percent(F.col("n"), F.col("records")).alias("pct"))


def validations(fields: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """By field: invalid values and their share of all invalid ones."""
    sums = year_range(fields, start, end).groupBy("field_name").agg(F.sum("v_invalid").cast("long").alias("n"))
    return sums.select("field_name", "n", percent(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("pct"))


def process_stats(audits: DataFrame, fields: DataFrame, source: str) -> DataFrame:
    """Of one source: the sums of each check and of each field's status, zeros left out."""
    a = audits.where(F.col("source") == source).groupBy("audit_code").agg(F.sum("valid").cast("long").alias("valid"), F.sum("invalid").cast("long").alias("invalid"))
    f = fields.where(F.col("source") == source).groupBy("field_name").agg(*(F.sum(c).cast("long").alias(c) for c in FIELD_SUMS))
    rows = a.selectExpr("'audit' AS kind", "audit_code AS name", "stack(2, 'valid', valid, 'invalid', invalid) AS (status, n)")
    pairs = ", ".join(f"'{c}', {c}" for c in FIELD_SUMS)
    return rows.unionByName(f.selectExpr("'field' AS kind", "field_name AS name", f"stack({len(FIELD_SUMS)}, {pairs}) AS (status, n)")).where("n > 0")


def record_rollup(info: DataFrame) -> DataFrame:
    """Of each record and field over its occurrences: invalid sticks; unsuccessful sticks and enriched beats unchanged; normalised sticks."""
    v, e = F.col("validation_status"), F.col("enrichment_status")
    return info.groupBy("id", "field_name").agg(
        F.when(F.bool_or(v == 0), 0).otherwise(F.max("validation_status")).alias("validation"),
        F.when(F.bool_or(e == 2), 2).when(F.bool_or(e == 1), 1).otherwise(0).alias("enrichment"),
        F.max("normalization_status").alias("normalization"),
    )
