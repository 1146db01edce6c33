"""The harvest's state: purges, resets, caches, lineage, tombstones, counters, change feeds and what is written from them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def purge(originals: DataFrame, last_harvest: DataFrame, derived: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The tables without a source: its originals and time of harvest are gone, all derived tables are to be built anew."""
    kept = lambda df: df.where(~F.col("source").eqNullSafe(F.lit(source)))
    return {"original": kept(originals), "last_harvest": kept(last_harvest)} | {k: v.limit(0) for k, v in derived.items()}


def reset_harvest(last_harvest: DataFrame, source: str) -> DataFrame:
    """The times of harvest without a source's, so that it is harvested whole."""
    return last_harvest.where(~F.col("source").eqNullSafe(F.lit(source)))


def from_time(last_harvest: DataFrame, source: str) -> str | None:
    """From when on a source is harvested: its last success in UTC, None for all."""
    row = last_harvest.where(F.col("source") == source).agg(F.max("last_successful_harvest")).first()
    return row[0].strftime("%Y-%m-%dT%H:%M:%SZ") if row[0] else None


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The old rows, and of the new ones the first of each key that the old ones lack."""
    whole = F.struct(*(F.col(c) for c in new.columns))
    first = new.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.min_by(whole, F.struct(*order)).alias("__r")).select("__r.*")
    return old.unionByName(first.join(old.select(*key), key, "left_anti").select(*old.columns))


def to_reprocess(pending: DataFrame, known: DataFrame) -> DataFrame:
    """Records that lacked an ORCID for a local id which another record has given since: oai_id, from rows (cache_key, oai_id) and (cache_key, orcid, source_oai_id)."""
    return pending.join(known.select("cache_key", "source_oai_id"), "cache_key").where("oai_id <> source_oai_id").select("oai_id").distinct()


def flag(converted: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with should_be_reprocessed set for the given oai_ids."""
    hit = ids.select("oai_id").distinct().withColumn("__hit", F.lit(True))
    again = F.when(F.col("__hit"), 1).otherwise(F.col("should_be_reprocessed"))
    return converted.join(hit, "oai_id", "left").withColumn("should_be_reprocessed", again).drop("__hit")


def tombstone(converted: DataFrame, gone: DataFrame, clusters: DataFrame, lineage: DataFrame, local_ids: DataFrame, children: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """All tables after records are deleted (``gone``: oai_id).

    The records stay as tombstones; live ones of their clusters count as
    modified now; their child rows, clusters and cached ids go; records that
    were enriched from them are flagged, and that lineage goes.
    """
    gone = gone.select("oai_id").distinct()
    ids = converted.join(gone, "oai_id", "left_semi").select("id")
    near = clusters.join(clusters.join(ids, F.col("converted_id") == F.col("id"), "left_semi").select("cluster_id").distinct(), "cluster_id", "left_semi")
    near = near.select(F.col("converted_id").alias("id")).distinct().join(ids, "id", "left_anti").withColumn("__near", F.lit(True))
    fed = lineage.join(gone.withColumnRenamed("oai_id", "source_oai_id"), "source_oai_id", "left_semi").select(F.col("enriched_oai_id").alias("oai_id"))
    df = flag(converted, fed).join(gone.withColumn("__gone", F.lit(True)), "oai_id", "left").join(near, "id", "left")
    df = df.withColumn("modified", F.when(F.coalesce("__gone", "__near"), now).otherwise(F.col("modified"))).withColumn("data", F.when(F.col("__gone").isNull(), F.col("data")))
    df = df.withColumn("deleted", F.when(F.col("__gone"), 1).otherwise(F.col("deleted"))).drop("__gone", "__near")
    left = lambda t: t.join(ids.withColumnRenamed("id", "converted_id"), "converted_id", "left_anti")
    source = gone.withColumnRenamed("oai_id", "source_oai_id")
    tables = {"converted": df.select(*converted.columns), "cluster": left(clusters), "enriched_from_other_record": lineage.join(source, "source_oai_id", "left_anti"), "localid_to_orcid": local_ids.join(source, "source_oai_id", "left_anti")}
    return tables | {k: left(v) for k, v in children.items()}


def harvest_counts(records: DataFrame) -> DataFrame:
    """Of each harvest (harvest_id, source): records seen, deleted, rejected and accepted, from rows with deleted and rejected (0 or 1)."""
    n = lambda c: F.sum(c.cast("long"))
    gone, bad = F.col("deleted") == 1, F.col("rejected") == 1
    return records.groupBy("harvest_id", "source").agg(F.count(F.lit(1)).alias("total"), n(gone).alias("n_deleted"), n(~gone & bad).alias("n_rejected"), n(~gone & ~bad).alias("n_accepted"))


def change_feed(converted: DataFrame, originals: DataFrame, clusters: DataFrame, finalized: DataFrame, since: int) -> DataFrame:
    """What a mirror needs of records modified after ``since`` (-1: all): the master's merged text, a duplicate's own, a tombstone's none."""
    rows = converted.where(F.col("modified") > since) if since != -1 else converted
    df = rows.join(originals.select(F.col("id").alias("original_id"), F.col("data").alias("xml")), "original_id", "left")
    df = df.join(clusters.withColumnRenamed("converted_id", "id"), "id", "left").join(finalized.select(F.col("id").alias("master_id"), "cluster_id", F.col("oai_id").alias("master_oai_id"), F.col("data").alias("merged")), "cluster_id", "left")
    kind = F.when(F.col("deleted") == 1, "deleted").when(F.col("oai_id") == F.col("master_oai_id"), "master").otherwise("duplicate")
    text = F.when(kind == "master", F.col("merged")).when(kind == "duplicate", F.col("data"))
    return df.select("oai_id", "source", kind.alias("kind"), text.alias("data"), F.when(F.col("deleted") != 1, F.col("xml")).alias("xml"), "modified")


def mirror(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The mirror after a feed: changed records replace their rows."""
    return old.join(changes.select("oai_id"), "oai_id", "left_anti").unionByName(changes.select(*old.columns))


def servers(sources: DataFrame, system: str) -> DataFrame:
    """The mirror's registry: a row for each source with its first set's address."""
    return sources.select(F.col("name"), F.get("sets", F.lit(0))["url"].alias("base_url"), F.concat("code", F.lit(f"_{system}")).alias("origin"))


def merged_export(clusters: DataFrame, converted: DataFrame, finalized: DataFrame, single: DataFrame, year: int | None = None) -> DataFrame:
    """A row for each cluster: its master's text, its live publications' texts in order and their number; of one year if asked."""
    rows = clusters.join(converted.where("deleted = 0").select(F.col("id").alias("converted_id"), "oai_id", "data"), "converted_id")
    rows = rows.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("oai_id", "data"))), lambda x: x["data"]).alias("publications"), F.count(F.lit(1)).alias("publication_count"))
    df = finalized.join(rows, "cluster_id").join(single.select(F.col("finalized_id").alias("id"), "yr"), "id", "left")
    return (df if year is None else df.where(F.col("yr") == year)).select("cluster_id", F.col("data").alias("master"), "publications", "publication_count", "yr")


def write_yearly(rows: DataFrame, path: str, first: int = 2012) -> None:
    """Gzipped JSON lines, a folder for each year from ``first`` on."""
    rows.where(F.col("yr") >= first).write.partitionBy("yr").option("compression", "gzip").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 and md5 of each file below a folder, made by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def write_records(rows: DataFrame, path: str) -> None:
    """Each record's XML as it came, a folder for each source, one line each (breaks within become spaces)."""
    rows.select("source", F.regexp_replace("xml", "[\\r\\n]+", " ").alias("value")).write.partitionBy("source").text(path)


def restyle(rows: DataFrame, styles: dict[str, Callable[[Column], Column]], general: tuple[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Each record's XML by its source's style, else by the general one where the address holds its mark; what is no XML stays as it is."""
    out = F.when(F.col("url").contains(general[0]), general[1](F.col("xml"))).otherwise(F.col("xml")) if general else F.col("xml")
    for source, style in styles.items():
        out = F.when(F.col("source") == source, style(F.col("xml"))).otherwise(out)
    return rows.withColumn("xml", F.when(F.trim("xml").startswith("<"), out).otherwise(F.col("xml")))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows in an order that only the seed decides."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def json_pages(rows: DataFrame, head: dict, name: str, every: int = 256) -> Iterator[str]:
    """One JSON object as pieces of text: the head's fields, then the rows under ``name``, ``every`` at a time; the driver holds a partition's rows at most."""
    yield json.dumps(head)[:-1] + (", " if head else "") + json.dumps(name) + ": ["
    part, first = [], True
    for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator():
        part.append(r["j"])
        if len(part) == every:
            yield ("" if first else ",") + ",".join(part)
            part, first = [], False
    yield ("" if first or not part else ",") + ",".join(part) + "]}"
