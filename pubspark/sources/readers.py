"""Readers of files: source registry, OAI records, book list, known identifiers, journal list, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import doab_ids

_REGISTRY = "struct<code:string,name:string,sets:array<struct<url:string,subset:string,metadata_prefix:string,envs:array<string>>>>"
_CONCEPT = "array<struct<`@id`:string,`@type`:string,code:string,prefLabelByLang:map<string,string>,broader:struct<`@id`:string>,`owl:deprecated`:boolean,isReplacedBy:array<struct<`@id`:string>>,narrowMatch:array<struct<`@id`:string>>,closeMatch:array<struct<`@id`:string>>>>"
_RECORD = "header struct<_status:string,identifier:string,datestamp:string,setSpec:array<string>>, metadata string, _corrupt_record string"


def source_sets(spark: SparkSession, path: str, env: str) -> DataFrame:
    """The sets to harvest, one row each: those for all environments and those for this one.

    The file is a JSON object of sources by code, a bounded piece of configuration.
    """
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{_REGISTRY}>")).alias("key", "s"))
    rows = rows.select(F.coalesce("s.code", "key").alias("code"), "s.name", F.explode("s.sets").alias("set"))
    return rows.where("set.envs IS NULL OR array_contains(set.envs, '" + env.replace("'", "''") + "')").select("code", "name", "set.url", "set.subset", "set.metadata_prefix")


def oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of OAI-PMH answers in XML files: oai_id, deleted, datestamp, sets, xml; what can't be parsed is in ``broken``."""
    df = spark.read.format("xml").option("rowTag", "record").option("mode", "PERMISSIVE").schema(_RECORD).load(path)
    return df.select(
        F.col("header.identifier").alias("oai_id"), F.coalesce(F.col("header._status") == "deleted", F.lit(False)).alias("deleted"), F.col("header.datestamp").alias("datestamp"),
        F.col("header.setSpec").alias("sets"), F.col("metadata").alias("xml"), F.col("_corrupt_record").alias("broken"),
    )


def book_list(spark: SparkSession, path: str, isbn: str, doi: str, url: str) -> DataFrame:
    """One address for each identifier of an open-access book list; for repeated ones the greatest address."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    q = lambda c: F.col(f"`{c}`")
    df = df.select(F.explode(doab_ids(F.coalesce(q(isbn), F.lit("")), F.coalesce(q(doi), F.lit("")))).alias("id"), q(url).alias("url"))
    return df.groupBy("id").agg(F.max("url").alias("url"))


def known_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def journal_list(spark: SparkSession, path: str) -> DataFrame:
    """year, issn, level of a journal list; a key listed twice is an error, raised by the rows that it spoils."""
    df = spark.read.csv(path, header=True, sep=";").select(F.col("Year").try_cast("int").alias("year"), F.upper(F.trim("Identifier")).alias("issn"), F.col("Level").try_cast("int").alias("level"))
    rows = df.groupBy("year", "issn").agg(F.first("level").alias("level"), F.count(F.lit(1)).alias("n"))
    bad = F.raise_error(F.concat(F.lit("listed twice: "), F.concat_ws(" ", "year", "issn")))
    return rows.select("year", "issn", F.when(F.col("n") == 1, F.col("level")).otherwise(bad.cast("int")).alias("level"))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of a JSON-LD graph: id, code, labels by language, broader id, replacement and matches."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<`@graph`:{_CONCEPT}>")["@graph"]).alias("c"))
    ids = lambda k: F.transform(F.coalesce(F.col("c")[k], F.array()), lambda x: x["@id"]).alias(k)
    return rows.select(F.col("c.`@id`").alias("id"), "c.code", F.col("c.prefLabelByLang").alias("labels"), F.col("c.broader.`@id`").alias("broader"), ids("isReplacedBy"), ids("narrowMatch"), ids("closeMatch"))


def replacement(rows: DataFrame) -> DataFrame:
    """What a legacy code becomes: its only replacement, else its only narrow match, else its only close match; else itself."""
    only = lambda k: F.when(F.size(k) == 1, F.get(k, F.lit(0)))
    return rows.select("id", F.coalesce(only("isReplacedBy"), only("narrowMatch"), only("closeMatch"), "id").alias("now"))
