"""The queries of the operator inventory and, for each, the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, identifiers, mods, similarity, text
from ..operators import audits, dedup, export, relational, search, stats
from ..streaming import upserts
from .adapter import TABLES, expand

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """A folder's tables and the adapter's views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        text = expand(text)
        used = {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
        for name, df in used.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = expand(oracle)
        return f

    return add


_STATS = """SELECT source, yr, count(DISTINCT id) AS total, cast(sum(is_open_access) AS bigint) AS open_access,
  cast(sum(classification_level) AS bigint) AS swedishlist, cast(sum(has_ssif_1) AS bigint) AS ssif FROM live GROUP BY source, yr"""


@query(_STATS)
def q_stats_converted(t: Tables) -> DataFrame:
    return stats.stats_converted(t.live)


def _datastatus(where: str = "") -> str:
    share = lambda c: f"coalesce(round(coalesce({c}, 0) / total * 100, 2), 0.0) AS {c}_pct"
    return f"""SELECT source, total, open_access, swedishlist, ssif, {share('open_access')}, {share('swedishlist')}, {share('ssif')},
      round(total / sum(total) OVER () * 100, 2) AS source_pct FROM (
      SELECT source, cast(sum(total) AS bigint) AS total, cast(sum(open_access) AS bigint) AS open_access, cast(sum(swedishlist) AS bigint) AS swedishlist, cast(sum(ssif) AS bigint) AS ssif
      FROM ({_STATS}) x {where} GROUP BY source) y"""


@query(_datastatus())
def q_datastatus(t: Tables) -> DataFrame:
    return stats.datastatus(stats.stats_converted(t.live))


@query(_datastatus("WHERE yr BETWEEN 2012 AND 2020 AND source = 'src1'"))
def q_datastatus_year_source(t: Tables) -> DataFrame:
    return stats.datastatus(stats.stats_converted(t.live), "src1", 2012, 2020)


@query("SELECT source, yr, value, count(*) AS n FROM ssif GROUP BY source, yr, value")
def q_stats_ssif(t: Tables) -> DataFrame:
    return stats.stats_ssif(t.ssif)


_SSIF_N = "SELECT value, count(*) AS n FROM ssif GROUP BY value"


@query(f"SELECT value, n, coalesce(round(n / (SELECT count(*) FROM live) * 100, 2), 0.0) AS pct FROM ({_SSIF_N}) x")
def q_datastatus_ssif(t: Tables) -> DataFrame:
    return stats.ssif_shares(stats.stats_ssif(t.ssif), stats.stats_converted(t.live))


_AUDITS = """SELECT source, audit_code, yr,
  cast(sum(CASE WHEN audit_code IN ('creator_count_check', 'auto_classify', 'add_oa') THEN audit_result ELSE 1 - audit_result END) AS bigint) AS valid,
  cast(sum(CASE WHEN audit_code IN ('auto_classify', 'add_oa') THEN 0 WHEN audit_code = 'creator_count_check' THEN 1 - audit_result ELSE audit_result END) AS bigint) AS invalid
  FROM audit_info GROUP BY source, audit_code, yr"""
_FIELDS = "SELECT source, field_name, yr, " + ", ".join(f"cast(sum(CASE WHEN {c} = {v} THEN 1 ELSE 0 END) AS bigint) AS {k}" for k, (c, v) in stats.FIELD_SUMS.items()) + " FROM record_info GROUP BY source, field_name, yr"


@query(_AUDITS)
def q_stats_audit(t: Tables) -> DataFrame:
    return stats.stats_audit_events(t.audit_info)


@query(_FIELDS)
def q_stats_field(t: Tables) -> DataFrame:
    return stats.stats_field_events(t.record_info)


@query(f"SELECT field_name, n, coalesce(round(n / sum(n) OVER () * 100, 2), 0.0) AS pct FROM (SELECT field_name, cast(sum(v_invalid) AS bigint) AS n FROM ({_FIELDS}) x WHERE yr BETWEEN 2012 AND 2020 GROUP BY field_name) y")
def q_validations(t: Tables) -> DataFrame:
    return stats.validations(stats.stats_field_events(t.record_info), 2012, 2020)


_PROCESS = " UNION ALL ".join(
    [f"SELECT 'audit' AS kind, audit_code AS name, '{c}' AS status, cast(sum({c}) AS bigint) AS n FROM ({_AUDITS}) x WHERE source = 'src1' GROUP BY audit_code HAVING sum({c}) > 0" for c in ("valid", "invalid")]
    + [f"SELECT 'field' AS kind, field_name AS name, '{c}' AS status, cast(sum({c}) AS bigint) AS n FROM ({_FIELDS}) x WHERE source = 'src1' GROUP BY field_name HAVING sum({c}) > 0" for c in stats.FIELD_SUMS]
)


@query(_PROCESS)
def q_process_stats(t: Tables) -> DataFrame:
    return stats.process_stats(stats.stats_audit_events(t.audit_info), stats.stats_field_events(t.record_info), "src1")


@query("""SELECT id, field_name, CASE WHEN min(validation_status) = 0 THEN 0 ELSE max(validation_status) END AS validation,
  CASE WHEN max(enrichment_status) = 2 THEN 2 WHEN max(enrichment_status) = 1 THEN 1 ELSE 0 END AS enrichment, max(normalization_status) AS normalization
  FROM (SELECT id % 300 AS id, field_name, validation_status, enrichment_status, normalization_status FROM record_info) x GROUP BY id, field_name""")
def q_record_rollup(t: Tables) -> DataFrame:
    return stats.record_rollup(t.record_info.withColumn("id", F.col("id") % 300))


@query("""SELECT oai_id FROM live WHERE source = 'src1' AND (id IN (SELECT id FROM record_info WHERE (field_name = 'ISBN' AND validation_status = 0) OR (field_name = 'DOI' AND enrichment_status = 1))
  OR id IN (SELECT id FROM audit_info WHERE audit_code = 'ISSN_missing_check' AND audit_result = 1)) ORDER BY oai_id LIMIT 20 OFFSET 3""")
def q_process_export_ids(t: Tables) -> DataFrame:
    fields = search.flag_condition([("ISBN", "validation_status", 0), ("DOI", "enrichment_status", 1)], [])
    audits = search.flag_condition([], [("ISSN_missing_check", 1)])
    hit = t.record_info.where(fields).select("id").unionByName(t.audit_info.where(audits).select("id")).distinct()
    return search.page(t.live.where("source = 'src1'").join(hit, "id", "left_semi").select("oai_id"), ["oai_id"], 20, 3)


_STAR = search.SearchQuery(years=(2011, 2022), flags={"swedish_list": True}, content_marking=["ref", "vet"], publication_status=["published", "submitted", "retracted"], orgs=["src1", "src2", "src3", "src5"], subjects=["1", "2", "4"])
_STAR_SQL = """SELECT finalized_id FROM search_single s WHERE yr BETWEEN 2011 AND 2022 AND swedish_list = 1 AND content_marking IN ('ref', 'vet') AND publication_status IN ('published', 'submitted', 'retracted')
  AND EXISTS (SELECT 1 FROM search_org o WHERE o.finalized_id = s.finalized_id AND o.value IN ('src1', 'src2', 'src3', 'src5')) AND EXISTS (SELECT 1 FROM search_subject o WHERE o.finalized_id = s.finalized_id AND o.value IN ('1', '2', '4'))"""


def _star(t: Tables) -> DataFrame:
    return search.search_ids(t.search_single, _STAR, t.search_creator, t.search_org, t.search_subject, t.search_genre)


@query(f"SELECT c.id, c.oai_id, c.yr FROM live c WHERE c.id IN ({_STAR_SQL})")
def q_search_star(t: Tables) -> DataFrame:
    return t.live.join(_star(t).select(F.col("finalized_id").alias("id")), "id", "left_semi").select("id", "oai_id", "yr")


@query(f"SELECT count(*) AS total FROM ({_STAR_SQL}) x")
def q_search_total(t: Tables) -> DataFrame:
    return _star(t).agg(F.countDistinct("finalized_id").alias("total"))


@query(f"SELECT DISTINCT value FROM search_org WHERE value IN ('src1', 'src2', 'src3', 'src5') AND finalized_id IN ({_STAR_SQL})")
def q_search_orgs(t: Tables) -> DataFrame:
    return search.matching_orgs(_star(t), t.search_org, _STAR.orgs)


@query("SELECT DISTINCT s.finalized_id FROM search_single s JOIN search_creator c ON c.finalized_id = s.finalized_id WHERE c.local_id_by = 'NATION_7' AND c.family_name LIKE 'Customer%'")
def q_search_creator(t: Tables) -> DataFrame:
    who = t.search_creator.where(F.col("family_name").startswith("Customer"))
    return search.search_ids(t.search_single, search.SearchQuery(creator={"local_id_by": "NATION_7"}), who, t.search_org, t.search_subject, t.search_genre).select("finalized_id")


@query("SELECT finalized_id, value FROM search_genre WHERE value = 'publication/economy anodized' OR lower(value) LIKE 'publication/s%' OR lower(value) LIKE 'publication/_mall%'")
def q_genre_prefix(t: Tables) -> DataFrame:
    return t.search_genre.where(search.genre_condition(F.col("value"), ["publication/economy anodized"], ["Publication.S", "publication/_mall/"]))


@query("SELECT id FROM titles WHERE list_contains(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+'), 'and')")
def q_fulltext(t: Tables) -> DataFrame:
    return search.match(t.titles, "title", "The AND").select("id")


@query("""SELECT source, run_id, succeeded, started, first_started, n_runs FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started DESC, run_id DESC) AS rn,
  min(started) OVER (PARTITION BY source) AS first_started, count(*) OVER (PARTITION BY source) AS n_runs FROM runs) x WHERE rn = 1""")
def q_latest_run(t: Tables) -> DataFrame:
    return relational.latest_run(t.runs)


@query("SELECT run_id, started FROM runs WHERE source = 'src3' ORDER BY started DESC, run_id LIMIT 10 OFFSET 20")
def q_run_history_page(t: Tables) -> DataFrame:
    return search.page(t.runs.where("source = 'src3'").select("run_id", "started"), [F.desc("started"), "run_id"], 10, 20)


@query("SELECT record, run_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY run_id) AS rn FROM runs) x WHERE rn = 1")
def q_upsert_first_wins(t: Tables) -> DataFrame:
    return relational.first_wins(t.runs, "record", ["run_id"]).select("record", "run_id", "event_type")


@query("SELECT record, run_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY run_id DESC) AS rn FROM runs) x WHERE rn = 1")
def q_latest_wins(t: Tables) -> DataFrame:
    old = relational.latest_wins(t.runs.where("run_id % 2 = 0"), "record", ["run_id"])
    both = relational.latest_wins(t.runs, "record", ["run_id"])
    return relational.upsert(old, both, "record").select("record", "run_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def q_anti_missing(t: Tables) -> DataFrame:
    return relational.missing(t.customer, t.orders.where("o_orderkey % 5 = 0").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT id, id AS cluster_id FROM live WHERE id NOT IN (SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY id % 100) AS n FROM live) x WHERE n > 9)")
def q_anti_singletons(t: Tables) -> DataFrame:
    live = t.live
    many = live.groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 9")
    return live.withColumn("k", F.col("id") % 100).join(many, "k", "left_anti").select("id", F.col("id").alias("cluster_id"))


@query("SELECT DISTINCT c.c_custkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P' AND c.c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 97 = 0)")
def q_lineage_reprocess(t: Tables) -> DataFrame:
    gone = t.customer.where("c_custkey % 97 = 0").select("c_nationkey").distinct()
    part = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(gone, "c_nationkey", "left_semi").join(part, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT id % 100 AS cluster_id, min(id) AS master, count(*) AS publication_count, max(yr) AS yr FROM live GROUP BY id % 100")
def q_export_dedup(t: Tables) -> DataFrame:
    return export.clusters(t.live.withColumn("cluster_id", F.col("id") % 100)).select("cluster_id", F.col("master").alias("master"), "publication_count", "yr")


@query("SELECT oai_id, yr FROM live WHERE yr = 2015")
def q_export_dup(t: Tables) -> DataFrame:
    return t.live.where("yr = 2015").select("oai_id", "yr")


@query("SELECT oai_id, deleted, modified FROM converted WHERE modified > 20000")
def q_cdc(t: Tables) -> DataFrame:
    return export.changed_since(t.converted, 20000).select("oai_id", "deleted", "modified")


def _issn_sql(x: str) -> str:
    c = f"upper(replace({x}, '-', ''))"
    total = " + ".join(f"{8 - k} * coalesce(try_cast(CASE WHEN substr({c}, {k + 1}, 1) = 'X' THEN '10' ELSE substr({c}, {k + 1}, 1) END AS int), 0)" for k in range(8))
    return f"(regexp_full_match({x}, '[0-9]{{4}}-?[0-9]{{3}}[0-9Xx]') AND ({total}) % 11 = 0)"


def _isbn_sql(x: str) -> str:
    c = f"upper(replace(replace({x}, '-', ''), ' ', ''))"
    at = lambda k: f"coalesce(try_cast(CASE WHEN substr({c}, {k}, 1) = 'X' THEN '10' ELSE substr({c}, {k}, 1) END AS int), 0)"
    ten = " + ".join(f"{11 - k} * {at(k)}" for k in range(1, 11))
    thirteen = " + ".join(f"{1 if k % 2 else 3} * {at(k)}" for k in range(1, 14))
    return f"((regexp_full_match({x}, '([0-9][- ]?){{12}}[0-9]') AND ({thirteen}) % 10 = 0) OR (regexp_full_match({x}, '([0-9][- ]?){{9}}[0-9Xx]') AND ({ten}) % 11 = 0))"


def _orcid_sql(x: str) -> str:
    d = f"upper(replace(regexp_replace({x}, '^https?://orcid\\.org/', ''), '-', ''))"
    total = "0"
    for k in range(15):
        total = f"(({total} + coalesce(try_cast(substr({d}, {k + 1}, 1) AS int), 0)) * 2 % 11)"
    number = f"coalesce(try_cast(substr({d}, 1, 15) AS bigint), 0)"
    return f"(regexp_full_match({x}, '(https?://orcid\\.org/)?[0-9]{{4}}-?[0-9]{{4}}-?[0-9]{{4}}-?[0-9]{{3}}[0-9Xx]') AND ({number} BETWEEN 15000000 AND 35000001 OR {number} BETWEEN 900000000000 AND 900100000000) AND (12 - {total}) % 11 = CASE WHEN substr({d}, 16, 1) = 'X' THEN 10 ELSE coalesce(try_cast(substr({d}, 16, 1) AS int), -1) END)"


def _doi_sql(x: str) -> str:
    return f"(NOT regexp_matches({x}, '[\\p{{Cc}}\\p{{Cf}}\\p{{Z}}]') AND regexp_full_match(regexp_replace({x}, '^https?://(dx\\.)?doi\\.org/', ''), '10\\.[^/]+/.+'))"


def _clean_sql(view: str, valid: Callable[[str], str], recover: str, normal: str) -> str:
    return f"""SELECT id, value, CASE WHEN two THEN {normal} ELSE used END AS new_value, cast(two AS int) AS validation, CASE WHEN one THEN 0 WHEN two THEN 1 ELSE 2 END AS enrichment,
      cast(two AND {normal} <> used AS int) AS normalization FROM (SELECT *, one OR {valid('used')} AS two FROM (SELECT *, CASE WHEN one OR coalesce(f, '') = '' THEN value ELSE f END AS used
      FROM (SELECT id, value, {valid('value')} AS one, {recover} AS f FROM {view}) a) b) c"""


_ISSN_N = "concat(substr(upper(replace(used, '-', '')), 1, 4), '-', substr(upper(replace(used, '-', '')), 5, 4))"
_ORCID_D = "upper(replace(regexp_replace(used, '^https?://orcid\\.org/', ''), '-', ''))"


@query(_clean_sql("issns", _issn_sql, "regexp_extract(value, '(^|[^0-9Xx-])([0-9]{4}-?[0-9]{3}[0-9Xx])($|[^0-9])', 2)", _ISSN_N))
def q_issn(t: Tables) -> DataFrame:
    return identifiers.clean(t.issns, "ISSN")


@query(_clean_sql("isbns", _isbn_sql, "regexp_extract(value, '(^|[^0-9Xx-])(97[89][- ]?([0-9][- ]?){9}[0-9]|([0-9][- ]?){9}[0-9Xx])($|[^0-9])', 2)", "upper(replace(replace(used, '-', ''), ' ', ''))"))
def q_isbn(t: Tables) -> DataFrame:
    return identifiers.clean(t.isbns, "ISBN")


@query(_clean_sql("orcids", _orcid_sql, "regexp_extract(value, '([0-9]{4}-?[0-9]{4}-?[0-9]{4}-?[0-9]{3}[0-9Xx])', 1)", "concat('https://orcid.org/', " + ", '-', ".join(f"substr({_ORCID_D}, {k}, 4)" for k in (1, 5, 9, 13)) + ")"))
def q_orcid(t: Tables) -> DataFrame:
    return identifiers.clean(t.orcids, "ORCID")


@query(_clean_sql("dois", _doi_sql, "regexp_extract(regexp_replace(value, '[\\p{Cc}\\p{Cf}\\p{Z}]', '', 'g'), '(10\\..*)', 1)", "concat('https://doi.org/', regexp_replace(used, '^https?://(dx\\.)?doi\\.org/', ''))"))
def q_doi(t: Tables) -> DataFrame:
    return identifiers.clean(t.dois, "DOI")


@query("SELECT i.id, i.value, CASE WHEN k.v IS NULL THEN 0 ELSE 1 END AS known FROM issns i LEFT JOIN (SELECT DISTINCT value AS v FROM issns WHERE id % 3 = 0) k ON k.v = i.value")
def q_known_ids(t: Tables) -> DataFrame:
    known = t.issns.where("id % 3 = 0").select("value").distinct().withColumn("k", F.lit(1))
    return t.issns.join(known, "value", "left").select("id", "value", F.coalesce("k", F.lit(0)).alias("known"))


_ISSNS = "SELECT id, yr, concat('i', cast(id % 40 AS string)) AS issn FROM live UNION ALL SELECT id, yr, concat('i', cast(id % 7 AS string)) AS issn FROM live"
_LEVELS = "SELECT 2010 + cast(o_orderkey % 15 AS int) AS yr, concat('i', cast(o_orderkey % 50 AS string)) AS issn, max(CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END) AS level FROM orders WHERE o_orderkey % 50 <> 5 GROUP BY 1, 2"


@query(f"SELECT i.id, max(l.level) AS level FROM ({_ISSNS}) i LEFT JOIN ({_LEVELS}) l ON l.yr = i.yr AND l.issn = i.issn GROUP BY i.id")
def q_swedish_list(t: Tables) -> DataFrame:
    return audits.journal_level(t.sql(_ISSNS), t.sql(_LEVELS))


@query("""WITH RECURSIVE up AS (SELECT code, code AS ancestor, broader FROM concepts UNION ALL SELECT u.code, c.code AS ancestor, c.broader FROM up u JOIN concepts c ON c.code = u.broader) SELECT code, ancestor FROM up""")
def q_concept_ancestors(t: Tables) -> DataFrame:
    return relational.ancestors(t.concepts)


_KEYS = "SELECT id, source, key FROM (SELECT id, source, lower(regexp_replace(right(title, 60), '[^AaEeIiOoUuYyÅåÄäÖö]', '', 'g')) AS key FROM titles UNION ALL SELECT id, source, lower(regexp_replace(right(summary, 60), '[^AaEeIiOoUuYyÅåÄäÖö]', '', 'g')) AS key FROM titles) k WHERE length(key) > 4"


def _keys(t: Tables) -> DataFrame:
    rows = t.titles
    both = rows.select("id", "source", relational.blocking_key(F.col("title")).alias("key")).unionByName(rows.select("id", "source", relational.blocking_key(F.col("summary")).alias("key")))
    return both.where("key IS NOT NULL")


@query(_KEYS)
def q_block_keys(t: Tables) -> DataFrame:
    return _keys(t)


_GROUPS = f"SELECT key, count(*) AS n FROM ({_KEYS}) k GROUP BY key HAVING count(*) > 1 AND count(*) < 150"
_PAIRS = f"SELECT DISTINCT a.id AS a, b.id AS b FROM ({_KEYS}) a JOIN ({_KEYS}) b ON a.key = b.key AND a.id < b.id WHERE a.key IN (SELECT key FROM ({_GROUPS}) g)"


@query(_GROUPS)
def q_candidate_groups(t: Tables) -> DataFrame:
    return relational.candidate_groups(_keys(t))


@query(_PAIRS)
def q_candidate_pairs(t: Tables) -> DataFrame:
    return relational.candidate_pairs(_keys(t))


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_PAIRS}) p UNION SELECT b AS a, a AS b FROM ({_PAIRS}) p), r AS (SELECT a AS node, a AS up FROM e UNION SELECT r.node, e.b AS up FROM r JOIN e ON e.a = r.up) SELECT node, min(up) AS component FROM r GROUP BY node""")
def q_components(t: Tables) -> DataFrame:
    return relational.components(relational.candidate_pairs(_keys(t)))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, cast(levenshtein(a.c_name, b.c_name) AS int) AS d FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE levenshtein(a.c_name, b.c_name) <= 2")
def q_levenshtein_pairs(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey", "c_mktsegment")
    return relational.near_names(rows, ["c_nationkey", "c_mktsegment"])


_SIZE = """(4 + CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END + CASE id % 4 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END + CASE WHEN id % 5 = 1 THEN 2 ELSE 1 END + 2 + CASE WHEN id % 6 < 3 THEN 1 ELSE 0 END + CASE WHEN id % 4 = 1 THEN 2 ELSE 1 END)"""


@query(f"SELECT cluster_id, id AS master FROM (SELECT id % 100 AS cluster_id, id, row_number() OVER (PARTITION BY id % 100 ORDER BY {_SIZE} DESC, id) AS rn FROM live) x WHERE rn = 1")
def q_master_pick(t: Tables) -> DataFrame:
    rows = _docs(t).select((F.col("id") % 100).alias("cluster_id"), "id", documents.elements_size(F.col("d")).alias("size"))
    return dedup.master(rows)


@query("SELECT o_orderkey % 10 AS part, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1, 2")
def q_split(t: Tables) -> DataFrame:
    return export.split(t.orders, F.col("o_orderkey") % 10).groupBy("part", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT record, max(run_id) AS run_id FROM runs GROUP BY record")
def q_stream_upsert(t: Tables) -> DataFrame:
    return upserts.stream_latest(t.spark, f"{t.sf_dir}/events.parquet")


@query("SELECT id, regexp_replace(translate(concat(title, ' 1–2 a⁄b é'), '⁄–', '/-'), '[^\\x00-\\x7F]', '', 'g') AS plain FROM titles")
def q_to_ascii(t: Tables) -> DataFrame:
    return t.titles.select("id", text.to_ascii(F.concat("title", F.lit(" 1–2 a⁄b é"))).alias("plain"))


@query("SELECT id, concat_ws('_', source, 'lid', cast(id AS varchar), substr(lower(strip_accents(concat('Åsa É', title))), 1, 32)) AS key FROM titles")
def q_local_id_key(t: Tables) -> DataFrame:
    return t.titles.select("id", text.local_id_key(F.col("source"), F.lit("lid"), F.col("id").cast("string"), F.concat(F.lit("Åsa É"), "title")).alias("key"))


@query("""SELECT a.id AS a, b.id AS b FROM (SELECT n_nationkey AS id, n_regionkey AS r, substr(lower(n_name), 1, cast(1 + n_nationkey % 9 AS int)) AS n FROM nation) a
  JOIN (SELECT n_nationkey AS id, n_regionkey AS r, lower(n_name) AS n FROM nation) b ON a.r = b.r WHERE CASE WHEN least(length(a.n), length(b.n)) = 1 THEN substr(a.n, 1, 1) = substr(b.n, 1, 1)
  ELSE levenshtein(a.n, b.n) <= CASE WHEN least(length(a.n), length(b.n)) > 14 THEN 4 WHEN least(length(a.n), length(b.n)) > 7 THEN 3 WHEN least(length(a.n), length(b.n)) > 4 THEN 2 WHEN least(length(a.n), length(b.n)) > 2 THEN 1 ELSE 0 END END""")
def q_name_parts(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r"), F.lower("n_name").alias("n"))
    a = n.select(F.col("id").alias("a"), "r", F.substring(F.col("n"), F.lit(1), (1 + F.col("id") % 9).cast("int")).alias("x"))
    return a.join(n.select(F.col("id").alias("b"), "r", F.col("n").alias("y")), "r").where(text.same_name_part(F.col("x"), F.col("y"))).select("a", "b")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, left(strftime(o_orderdate, '%Y-%m-%d'), CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS d FROM orders) x WHERE left(d, least(length(d), 7)) = left('1995-03', least(length(d), 7))")
def q_same_date(t: Tables) -> DataFrame:
    n = F.when(F.col("o_orderkey") % 3 == 0, 4).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(10)
    d = F.left(F.date_format("o_orderdate", "yyyy-MM-dd"), n)
    return t.orders.where(text.same_date(d, F.lit("1995-03"))).select("o_orderkey")


@query("""SELECT id, CASE WHEN coalesce(s, '') <> '' THEN m ELSE split_part(m, ':', 1) END AS main, CASE WHEN coalesce(s, '') <> '' THEN s WHEN instr(m, ':') > 0 THEN trim(substr(m, instr(m, ':') + 1), ' ') END AS sub
  FROM (SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE concat(substr(title, 1, 10), ': ', substr(title, 11)) END AS m, CASE WHEN id % 5 = 0 THEN source END AS s FROM titles) x""")
def q_title_split(t: Tables) -> DataFrame:
    m = F.when(F.col("id") % 3 == 0, F.col("title")).otherwise(F.concat(F.substring("title", 1, 10), F.lit(": "), F.expr("substr(title, 11)")))
    s = F.when(F.col("id") % 5 == 0, F.col("source"))
    return t.titles.select("id", text.main_title(m, s).alias("main"), text.sub_title(m, s).alias("sub"))


_STATUS = "CASE id % 5 WHEN 0 THEN 'Published' WHEN 1 THEN 'InPrint' WHEN 2 THEN 'Submitted' WHEN 3 THEN 'Retracted' END"


@query(f"""SELECT cluster_id, status FROM (SELECT id % 400 AS cluster_id, {_STATUS} AS status, row_number() OVER (PARTITION BY id % 400 ORDER BY CASE {_STATUS} WHEN 'Published' THEN 1 WHEN 'InPrint' THEN 3 WHEN 'Submitted' THEN 5 WHEN 'Retracted' THEN 7 ELSE 8 END, id) AS rn FROM live) x WHERE rn = 1""")
def q_status_rank(t: Tables) -> DataFrame:
    rows = t.live.select((F.col("id") % 400).alias("cluster_id"), "id", F.expr(_STATUS).alias("status"))
    return rows.groupBy("cluster_id").agg(F.min_by("status", F.struct(text.status_rank(F.col("status")), "id")).alias("status"))


@query("SELECT id FROM live WHERE id % 100 IN (SELECT id % 100 FROM converted WHERE deleted = 1)")
def q_siblings(t: Tables) -> DataFrame:
    rows = t.converted.select("id", "deleted", (F.col("id") % 100).alias("cluster_id"))
    return relational.siblings(rows).select("id")


def _docs(t: Tables) -> DataFrame:
    return t.publications.select("id", "source", documents.parse(F.col("doc")).alias("d"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN concat('Main ', cast(id AS string), ': Sub') ELSE concat('Main ', cast(id AS string), ': rest') END AS title, yr,
  CASE WHEN id % 2 = 0 THEN concat(cast(yr AS string), '-03') ELSE cast(yr AS string) END AS published, CASE id % 4 WHEN 0 THEN 'ref' WHEN 1 THEN 'vet' END AS marking, CASE id % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'submitted' END AS status,
  CASE id % 5 WHEN 0 THEN 'v:/Published' END AS only_status, CASE WHEN id % 5 > 1 THEN cast(id % 5 - 1 AS int) END AS stated, CASE id % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 END AS level, CASE id % 5 WHEN 2 THEN 'v:/Accepted' END AS version,
  CASE id % 5 WHEN 0 THEN 'u:2' WHEN 1 THEN 'u:3' WHEN 2 THEN 'u:4' END AS locator, CASE WHEN id % 3 = 0 THEN 'Journal' END AS channel, id % 4 IN (0, 3) AS article, cast(CASE WHEN id % 4 < 3 THEN 1 ELSE 0 END AS int) AS n_outputs FROM live""")
def q_accessors(t: Tables) -> DataFrame:
    d = F.col("d")
    return _docs(t).select(
        "id", documents.title(d).alias("title"), documents.publication_year(d).alias("yr"), documents.publication_date(d).alias("published"), documents.content_marking(d).alias("marking"), documents.search_status(d).alias("status"),
        documents.publication_status(d, only=True).alias("only_status"), documents.creator_count(d).alias("stated"), documents.level(d).alias("level"), documents.open_access_version(d).alias("version"), documents.electronic_locator(d).alias("locator"),
        documents.publication_channel(d).alias("channel"), documents.is_article(d).alias("article"), F.size(documents.output_types(d)).alias("n_outputs"),
    )


_EMBARGO = "id % 8 IN (1, 4)"


@query(f"SELECT id, {_EMBARGO} AS embargoed, CASE WHEN {_EMBARGO} THEN false WHEN id % 8 IN (0, 2, 5) THEN true WHEN id % 8 = 3 THEN false ELSE id % 5 = 2 END AS open_access FROM live")
def q_open_access(t: Tables) -> DataFrame:
    d, today = F.col("d"), F.lit("2020-06-30").cast("date")
    return _docs(t).select("id", documents.embargoed(d, today).alias("embargoed"), documents.open_access(d, today).alias("open_access"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,102' WHEN 2 THEN '5,503,50301' ELSE '' END AS subjects, CASE id % 4 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '5' ELSE '' END AS top, id % 4 IN (1, 2) AS classified, id % 4 = 2 AS automatic FROM live""")
def q_subjects(t: Tables) -> DataFrame:
    d = F.col("d")
    return _docs(t).select("id", F.array_join(documents.subjects(d), ",").alias("subjects"), F.array_join(documents.top_subjects(d), ",").alias("top"), documents.is_classified(d).alias("classified"), documents.autoclassified(d).alias("automatic"))


@query("""SELECT id, concat('10.1/', cast(id AS string), CASE WHEN id % 3 = 1 THEN ',10.1/host' ELSE '' END) AS dois, CASE WHEN id % 3 = 0 THEN 's1' ELSE '' END AS issns, CASE id % 3 WHEN 0 THEN 'b2' WHEN 1 THEN 'b2,b3,b1' ELSE '' END AS isbns, CASE WHEN id % 3 = 1 THEN 'Series' ELSE '' END AS series FROM live""")
def q_identifiers(t: Tables) -> DataFrame:
    d = F.col("d")
    joined = [F.array_join(documents.identifiers(d, k), ",").alias(f"{k.lower()}s") for k in ("DOI", "ISSN", "ISBN")]
    return _docs(t).select("id", *joined, F.array_join(documents.series(d), ",").alias("series"))


@query("""SELECT id, 1 AS pos, 'Ann' AS given_name, 'Lee' AS family_name, concat('l', cast(id % 50 AS string)) AS local_id, source AS local_id_by FROM live
  UNION ALL SELECT id, 2 AS pos, CASE WHEN id % 6 = 0 THEN 'ANN' ELSE 'Bo' END AS given_name, 'Lee' AS family_name, concat('l', cast(id % 50 AS string)) AS local_id, source AS local_id_by FROM live WHERE id % 6 < 3""")
def q_creators(t: Tables) -> DataFrame:
    rows = _docs(t).select("id", F.posexplode(documents.creators(F.col("d"))).alias("p", "c"))
    return rows.select("id", (F.col("p") + 1).alias("pos"), *(f"c.{k}" for k in ("given_name", "family_name", "local_id", "local_id_by")))


_COUNT = "(1 + CASE WHEN id % 6 < 3 THEN 1 ELSE 0 END)"


@query(f"""SELECT id, 'creator_count_note_exists' AS audit_code, id % 5 > 1 AS audit_result FROM live UNION ALL SELECT id, 'creator_count_check' AS audit_code, {_COUNT} <= id % 5 - 1 AS audit_result FROM live WHERE id % 5 > 1
  UNION ALL SELECT id, 'contributor_duplicate_check' AS audit_code, id % 6 = 0 AS audit_result FROM live UNION ALL SELECT id, 'SSIF_comprehensive_check' AS audit_code, id % 4 NOT IN (1, 2) AS audit_result FROM live
  UNION ALL SELECT id, 'ISSN_missing_check' AS audit_code, id % 4 IN (0, 3) AND id % 3 <> 0 AND id % 5 <> 1 AS audit_result FROM live""")
def q_record_audits(t: Tables) -> DataFrame:
    checks = documents.audits(F.col("d"))
    every = F.array(*(F.struct(F.lit(k).alias("audit_code"), v.alias("audit_result")) for k, v in checks.items()))
    return _docs(t).select("id", F.explode(F.filter(every, lambda x: x["audit_result"].isNotNull())).alias("a")).select("id", "a.audit_code", "a.audit_result")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--(.|\\n)*?-->|</?[A-Za-z][^>]*(>|$)', '', 'g'), '&quot;', '\"', 'g'), '&nbsp;', ' ', 'g'), '&amp;', '&', 'g'), '[\\x07\\x08\\f\\n\\r\\t\\x0B]+', ' ', 'g'), '[\\x01-\\x1F]', '', 'g'), ' ') AS plain FROM (SELECT page_id, replace(replace(html, '&lt;', '<'), '&gt;', '>') AS html FROM pages) x")
def q_html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.trim(documents.cleaned_text(F.col("html"))).alias("plain"))


@query("SELECT DISTINCT source FROM runs WHERE succeeded = 1")
def q_sources(t: Tables) -> DataFrame:
    return t.runs.where("succeeded = 1").select("source").distinct()


@query("SELECT source, min(started) AS first_started, max(started) AS last_started, count(*) AS n FROM runs GROUP BY source")
def q_run_span(t: Tables) -> DataFrame:
    return t.runs.groupBy("source").agg(F.min("started").alias("first_started"), F.max("started").alias("last_started"), F.count(F.lit(1)).alias("n"))


@query("SELECT id AS id, CASE WHEN id % 2 = 0 THEN cast(yr AS string) ELSE concat(cast(yr AS string), '-02-30') END AS value, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS validation FROM live")
def q_year(t: Tables) -> DataFrame:
    v = F.when(F.col("id") % 2 == 0, F.col("yr").cast("string")).otherwise(F.concat(F.col("yr").cast("string"), F.lit("-02-30")))
    return identifiers.clean(t.live.select("id", v.alias("value")), "publication_year").select("id", "value", "validation")


@query("SELECT c_custkey AS id, cast(c_custkey % 7 - 1 AS string) AS value, CASE WHEN c_custkey % 7 > 1 THEN 1 ELSE 0 END AS validation FROM customer")
def q_creator_count(t: Tables) -> DataFrame:
    return identifiers.clean(t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7 - 1).cast("string").alias("value")), "creator_count").select("id", "value", "validation")


@query("SELECT o_orderkey AS id, cast(o_orderkey AS string) AS value, CASE WHEN length(cast(o_orderkey AS string)) IN (1, 3, 5) AND o_orderkey <> 21101 THEN 1 ELSE 0 END AS validation FROM orders")
def q_ssif(t: Tables) -> DataFrame:
    return identifiers.clean(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("value")), "SSIF").select("id", "value", "validation")


@query("SELECT page_id AS id, url AS value, CASE WHEN regexp_full_match(url, '[\\x00-\\x7F]*') THEN 1 ELSE 0 END AS validation FROM pages WHERE url IS NOT NULL")
def q_uri(t: Tables) -> DataFrame:
    return identifiers.clean(t.pages.where("url IS NOT NULL").select(F.col("page_id").alias("id"), F.col("url").alias("value")), "URI").select("id", "value", "validation")


_ISI = "CASE id % 4 WHEN 0 THEN concat('ISI: ', v) WHEN 1 THEN substr(v, 1, 14) ELSE v END"


@query(f"""SELECT id, {_ISI} AS value, CASE id % 4 WHEN 1 THEN substr(v, 1, 14) ELSE v END AS new_value, CASE id % 4 WHEN 1 THEN 0 ELSE 1 END AS validation, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS enrichment
  FROM (SELECT s_suppkey AS id, concat('000', lpad(cast(s_suppkey AS string), 12, '0')) AS v FROM supplier) x""")
def q_isi(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("000"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("v"))
    return identifiers.clean(rows.select("id", F.expr(_ISI).alias("value")), "ISI").drop("normalization")


@query("""SELECT id, CASE WHEN least(length(a), length(b)) = 0 AND greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 2.0 * list_sum(list_transform(list_distinct(list_filter(regexp_split_to_array(a, ''), lambda c: c <> '')),
  lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) / (length(a) + length(b)) END AS ratio
  FROM (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part) x""")
def q_letter_ratio(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), similarity.letter_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query()
def q_dedup_clusters(t: Tables) -> DataFrame:
    """Groups of records that are one publication: blocked, compared, joined; the longest titles and summaries tell."""
    rows = t.titles.select("id", "title", "summary", F.lit("2020").alias("date"), F.array().cast("array<string>").alias("doi"))
    return relational.components(dedup.same_pairs(rows, relational.candidate_pairs(_keys(t)), ["doi"]))


_MEMBER = """SELECT id % 400 AS cluster_id, id AS rank, k AS pos, CASE k WHEN 0 THEN 'DOI' WHEN 1 THEN 'ISBN' ELSE 'PMID' END AS kind, concat('v', cast((id * 3 + k) % 5 AS string)) AS value, CASE WHEN id % 3 = 0 THEN 'q' END AS qualifier
  FROM live CROSS JOIN (VALUES (0), (1), (2)) AS n(k) WHERE (id + k) % 4 <> 0"""


@query(f"""SELECT cluster_id, kind, value, qualifier FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, kind ORDER BY rank, pos) AS first_of_kind FROM (
  SELECT cluster_id, kind, value, min(rank) AS rank, min(pos) AS pos, min(qualifier) AS qualifier FROM ({_MEMBER}) m GROUP BY cluster_id, kind, value) x) y WHERE kind = 'ISBN' OR first_of_kind = 1""")
def q_merge_ids(t: Tables) -> DataFrame:
    return dedup.merge_ids(t.sql(_MEMBER).withColumn("rank", F.col("rank") + 1))


@query("""SELECT cluster_id, code, auto FROM (SELECT cluster_id, code, min(auto) AS auto, min(min(auto)) OVER (PARTITION BY cluster_id) AS low FROM (SELECT id % 400 AS cluster_id, value AS code, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS auto FROM ssif) x GROUP BY cluster_id, code) y WHERE auto = low""")
def q_merge_classes(t: Tables) -> DataFrame:
    return dedup.merge_classes(t.ssif.select((F.col("id") % 400).alias("cluster_id"), F.col("value").alias("code"), (F.col("id") % 3 == 0).cast("int").alias("auto")))


@query("""SELECT id, field_name, 'validation' AS kind, CASE validation_status WHEN 0 THEN 'invalid' ELSE 'valid' END AS status FROM record_info WHERE field_name = 'ISBN' AND validation_status = 0
  UNION ALL SELECT id, field_name, 'enrichment' AS kind, 'enriched' AS status FROM record_info WHERE field_name = 'DOI' AND enrichment_status = 1""")
def q_flag_rows(t: Tables) -> DataFrame:
    labels = {"validation": {0: "invalid", 1: "valid"}, "enrichment": {0: "unchanged", 1: "enriched", 2: "unsuccessful"}, "normalization": {0: "unchanged", 1: "normalized"}}
    wanted = export.parse_flags("ISBN_invalid,DOI_enriched", ["ISBN", "DOI"], {k: list(v.values()) for k, v in labels.items()})
    return export.flag_rows(t.record_info, wanted, labels)


@query("""SELECT oai_id, CASE WHEN deleted = 0 THEN data END AS data, deleted FROM (SELECT cast(event_id % 500 AS string) AS oai_id, event_type AS data, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS deleted,
  row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id % 2 DESC, event_id) AS rn FROM events) x WHERE rn = 1""")
def q_store(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("event_id") % 500).cast("string").alias("oai_id"), F.col("event_type").alias("data"), (F.col("event_id") % 7 == 0).alias("deleted"), F.col("event_id").alias("seq"))
    empty = rows.select("oai_id", "data", F.col("deleted").cast("int").alias("deleted")).where("false")
    return export.store(export.store(empty, rows.where("seq % 2 = 0")), rows.where("seq % 2 = 1"))


@query("""SELECT concat('oai:', source, ':', cast(id AS string)) AS "recordId", CASE WHEN id % 3 = 0 THEN concat('Main ', cast(id AS string)) ELSE concat('Main ', cast(id AS string)) END AS title, CASE WHEN id % 3 = 0 THEN 'Sub' ELSE 'rest' END AS subtitle, yr AS "publicationYear",
  CASE id % 3 WHEN 0 THEN 'b2' WHEN 1 THEN 'b2,b3,b1' ELSE '' END AS "ISBN", CASE WHEN id % 6 = 0 THEN 'Lee, Ann;Lee, ANN' WHEN id % 6 < 3 THEN 'Lee, Ann;Lee, Bo' ELSE 'Lee, Ann' END AS creators FROM live""")
def q_export_fields(t: Tables) -> DataFrame:
    return export.flat(export.project(_docs(t), ["recordId", "title", "subtitle", "publicationYear", "ISBN", "creators"], F.lit("2020-06-30").cast("date")))


_MODS = """SELECT id, concat('<mods><recordInfo><recordContentSource>', CASE WHEN id % 11 = 0 THEN '-.' ELSE source END, '</recordContentSource></recordInfo><genre authority="types" type="publicationType">', CASE id % 3 WHEN 0 THEN 'art' WHEN 1 THEN 'bok' ELSE 'none' END, '</genre>',
  CASE WHEN id % 2 = 0 THEN '<genre authority="types" type="contentType">ref</genre>' ELSE '' END, '<titleInfo><title>Main ', cast(id AS string), '</title></titleInfo><name type="personal"><namePart>A</namePart><role><roleTerm type="code" authority="marcrelator">', CASE WHEN id % 7 = 0 THEN 'ill' ELSE 'aut' END, '</roleTerm></role></name>',
  CASE WHEN id % 5 = 0 THEN '' ELSE concat('<originInfo><dateIssued>', cast(yr AS string), '</dateIssued></originInfo>') END, CASE WHEN id % 10 = 0 THEN '<note type="publicationStatus">Submitted</note>' ELSE '' END, '<identifier type="uri">u:', cast(id AS string), '</identifier>',
  '<language><languageTerm type="code" authority="iso639-2b">eng</languageTerm></language>', CASE WHEN id % 4 = 0 THEN '<relatedItem type="host"><titleInfo><title>Journal</title></titleInfo></relatedItem>' ELSE '' END, '</mods>') AS xml FROM live"""


@query("""SELECT id, concat(CASE WHEN id % 11 = 0 THEN 'recordContentSourceViolation,' ELSE '' END, CASE WHEN id % 7 = 0 THEN 'nameViolation,' ELSE '' END, CASE WHEN id % 3 = 2 THEN 'publicationOrOutputTypeViolation,' ELSE '' END,
  CASE WHEN id % 2 <> 0 THEN 'contentTypeViolation,' ELSE '' END, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'publicationDateViolation,' ELSE '' END, CASE WHEN id % 3 = 0 AND id % 4 <> 0 AND id % 10 <> 0 THEN 'relatedItemTypeMissing,' ELSE '' END,
  CASE WHEN id % 3 = 1 AND id % 4 = 0 THEN 'relatedItemTypeViolation,' ELSE '' END) AS codes FROM live""")
def q_min_level(t: Tables) -> DataFrame:
    found = F.array_join(mods.violations(mods.parse(F.col("xml")), "own.se", "types"), ",")
    return t.sql(_MODS).select("id", F.when(found == "", "").otherwise(F.concat(found, F.lit(","))).alias("codes"))


@query("""SELECT id, concat('Main ', cast(id AS string)) AS title, CASE WHEN id % 5 <> 0 THEN yr END AS yr, CASE id % 3 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 'v:/output/publication/journal-article' ELSE 'v:/output/publication' END WHEN 1 THEN 'v:/output/publication/book' ELSE '' END AS outputs,
  CASE WHEN id % 10 = 0 THEN 'submitted' ELSE 'published' END AS status, CASE WHEN id % 4 = 0 THEN 'Journal' END AS channel, concat('u:', cast(id AS string)) AS uri FROM live""")
def q_convert(t: Tables) -> DataFrame:
    d = F.col("d")
    rows = t.sql(_MODS).select("id", documents.parse(mods.convert(F.col("id").cast("string"), mods.parse(F.col("xml")), "v:/", "own.se", "types")).alias("d"))
    return rows.select("id", documents.title(d).alias("title"), documents.publication_year(d).alias("yr"), F.array_join(documents.output_types(d), ",").alias("outputs"), documents.search_status(d).alias("status"), documents.publication_channel(d).alias("channel"), documents.archive_uri(d).alias("uri"))


from . import records  # noqa: E402, F401  (registers its queries)
