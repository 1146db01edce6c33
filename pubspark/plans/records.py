"""Queries for the harvest's state, the read services, marts, fields, audits and exports, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents, fields, legacy, text
from ..operators import audits, marts, search, service, state, training
from .catalogue import Tables, _docs, query

TODAY = "2020-06-30"
#: Records of a harvest: some lie in clusters, some are deleted or rejected.
_CONV = """SELECT id, id + 1 AS original_id, oai_id, source, concat('data ', cast(id AS string)) AS data, deleted, modified, 0 AS should_be_reprocessed FROM converted"""
_ORIG = "SELECT id + 1 AS id, concat('<r>', cast(id AS string), '</r>') AS data FROM converted WHERE id % 13 <> 0"
_CLUSTER = "SELECT id % 100 AS cluster_id, id AS converted_id FROM live WHERE id % 3 <> 0"
_FINAL = "SELECT min(id) AS id, id % 100 AS cluster_id, min_by(oai_id, id) AS oai_id, concat('merged ', cast(id % 100 AS string)) AS data FROM live WHERE id % 3 <> 0 GROUP BY id % 100"
_LINEAGE = "SELECT concat('oai:', source, ':', cast(id AS string)) AS source_oai_id, concat('oai:', source, ':', cast(id + 5 AS string)) AS enriched_oai_id FROM converted WHERE id % 7 = 0"
_GONE = "SELECT oai_id FROM live WHERE id % 31 = 0"


@query(f"SELECT * FROM ({_CONV}) c WHERE source <> 'src1'")
def q_purge(t: Tables) -> DataFrame:
    out = state.purge(t.sql(_CONV), t.sql("SELECT DISTINCT source, modified FROM converted"), {"cluster": t.sql(_CLUSTER)}, "src1")
    assert out["cluster"].isEmpty()
    return out["original"]


@query("SELECT source, max(started) AS last_successful_harvest FROM runs WHERE succeeded = 1 AND source <> 'src3' GROUP BY source")
def q_reset_harvest(t: Tables) -> DataFrame:
    last = t.runs.where("succeeded = 1").groupBy("source").agg(F.max("started").alias("last_successful_harvest"))
    return state.reset_harvest(last, "src3")


@query("SELECT key, min(v) AS v FROM (SELECT cast(id % 60 AS string) AS key, id AS v FROM live WHERE id % 2 = 0) a GROUP BY key UNION ALL SELECT key, min(v) AS v FROM (SELECT cast(id % 90 AS string) AS key, id AS v FROM live WHERE id % 2 = 1) b WHERE key NOT IN (SELECT cast(id % 60 AS string) FROM live WHERE id % 2 = 0) GROUP BY key")
def q_insert_or_ignore(t: Tables) -> DataFrame:
    rows = lambda n, odd: t.live.where(F.col("id") % 2 == odd).select((F.col("id") % n).cast("string").alias("key"), F.col("id").alias("v"))
    none = rows(60, 0).limit(0)
    return state.insert_or_ignore(state.insert_or_ignore(none, rows(60, 0), ["key"], ["v"]), rows(90, 1), ["key"], ["v"])


_PENDING = "SELECT concat('k', cast(id % 300 AS string)) AS cache_key, oai_id FROM live WHERE id % 4 = 1"
_KNOWN = "SELECT concat('k', cast(id % 300 AS string)) AS cache_key, concat('0000-', cast(min(id) AS string)) AS orcid, min(oai_id) AS source_oai_id FROM live WHERE id % 4 <> 1 AND id % 300 < 150 GROUP BY id % 300"
_PEOPLE = "SELECT concat('k', cast(id % 300 AS string)) AS cache_key, oai_id, CASE WHEN id % 5 = 0 THEN 'own' END AS orcid FROM live"


@query(f"SELECT c.id, c.oai_id, CASE WHEN c.oai_id IN (SELECT p.oai_id FROM ({_PENDING}) p JOIN ({_KNOWN}) k ON k.cache_key = p.cache_key WHERE p.oai_id <> k.source_oai_id) THEN 1 ELSE 0 END AS should_be_reprocessed FROM ({_CONV}) c")
def q_flag_reprocess(t: Tables) -> DataFrame:
    return state.flag(t.sql(_CONV), state.to_reprocess(t.sql(_PENDING), t.sql(_KNOWN))).select("id", "oai_id", "should_be_reprocessed")


@query(f"""SELECT p.oai_id, p.cache_key, coalesce(p.orcid, k.orcid) AS orcid, CASE WHEN p.orcid IS NOT NULL THEN 'own' WHEN k.orcid IS NOT NULL THEN 'enriched' ELSE 'pending' END AS status,
  CASE WHEN p.orcid IS NULL THEN k.source_oai_id END AS source_oai_id FROM ({_PEOPLE}) p LEFT JOIN ({_KNOWN}) k ON k.cache_key = p.cache_key""")
def q_enrich_local(t: Tables) -> DataFrame:
    return fields.orcids_from_local(t.sql(_PEOPLE), t.sql(_KNOWN))


def _tombs(t: Tables) -> dict[str, DataFrame]:
    local = t.sql(_KNOWN)
    return state.tombstone(t.sql(_CONV), t.sql(_GONE), t.sql(_CLUSTER), t.sql(_LINEAGE), local, {"ssif": t.ssif.withColumnRenamed("id", "converted_id")}, F.lit(999999).cast("long"))


@query(f"""SELECT id, oai_id, CASE WHEN oai_id IN ({_GONE}) THEN NULL ELSE data END AS data, CASE WHEN oai_id IN ({_GONE}) THEN 1 ELSE deleted END AS deleted,
  CASE WHEN oai_id IN ({_GONE}) OR id IN (SELECT converted_id FROM ({_CLUSTER}) x WHERE cluster_id IN (SELECT cluster_id FROM ({_CLUSTER}) y JOIN live l ON l.id = y.converted_id WHERE l.id % 31 = 0)) THEN 999999 ELSE modified END AS modified,
  CASE WHEN oai_id IN (SELECT enriched_oai_id FROM ({_LINEAGE}) z WHERE source_oai_id IN ({_GONE})) THEN 1 ELSE 0 END AS should_be_reprocessed FROM ({_CONV}) c""")
def q_tombstone(t: Tables) -> DataFrame:
    return _tombs(t)["converted"].select("id", "oai_id", "data", "deleted", "modified", "should_be_reprocessed")


@query(f"SELECT id AS converted_id, value FROM ssif WHERE id % 31 <> 0 UNION ALL SELECT converted_id, 'cluster' AS value FROM ({_CLUSTER}) c WHERE converted_id % 31 <> 0")
def q_tombstone_children(t: Tables) -> DataFrame:
    out = _tombs(t)
    return out["ssif"].select("converted_id", "value").unionByName(out["cluster"].select("converted_id", F.lit("cluster").alias("value")))


@query("SELECT id % 9 AS harvest_id, source, count(*) AS total, cast(sum(deleted) AS bigint) AS n_deleted, cast(sum(CASE WHEN deleted = 0 AND id % 7 = 0 THEN 1 ELSE 0 END) AS bigint) AS n_rejected, cast(sum(CASE WHEN deleted = 0 AND id % 7 <> 0 THEN 1 ELSE 0 END) AS bigint) AS n_accepted FROM converted GROUP BY id % 9, source")
def q_harvest_counts(t: Tables) -> DataFrame:
    return state.harvest_counts(t.converted.select((F.col("id") % 9).alias("harvest_id"), "source", "deleted", (F.col("id") % 7 == 0).cast("int").alias("rejected")))


_FEED = f"""SELECT c.oai_id, c.source, CASE WHEN c.deleted = 1 THEN 'deleted' WHEN c.oai_id = f.oai_id THEN 'master' ELSE 'duplicate' END AS kind,
  CASE WHEN c.deleted = 1 THEN NULL WHEN c.oai_id = f.oai_id THEN f.data ELSE c.data END AS data, CASE WHEN c.deleted <> 1 THEN o.data END AS xml, c.modified
  FROM ({_CONV}) c LEFT JOIN ({_ORIG}) o ON o.id = c.original_id LEFT JOIN ({_CLUSTER}) k ON k.converted_id = c.id LEFT JOIN ({_FINAL}) f ON f.cluster_id = k.cluster_id WHERE c.modified > 20000"""


@query(_FEED)
def q_change_feed(t: Tables) -> DataFrame:
    return state.change_feed(t.sql(_CONV), t.sql(_ORIG), t.sql(_CLUSTER), t.sql(_FINAL), 20000)


@query(f"SELECT oai_id, kind FROM ({_FEED}) n UNION ALL SELECT oai_id, 'old' AS kind FROM converted WHERE id % 2 = 0 AND oai_id NOT IN (SELECT oai_id FROM ({_FEED}) n)")
def q_mirror(t: Tables) -> DataFrame:
    feed = state.change_feed(t.sql(_CONV), t.sql(_ORIG), t.sql(_CLUSTER), t.sql(_FINAL), 20000).select("oai_id", "kind")
    return state.mirror(t.converted.where("id % 2 = 0").select("oai_id", F.lit("old").alias("kind")), feed)


@query("SELECT n_name AS name, concat('http://', lower(n_name), '/oai') AS base_url, concat(upper(substr(n_name, 1, 3)), '_SYS') AS origin FROM nation")
def q_servers(t: Tables) -> DataFrame:
    one = F.struct(F.concat(F.lit("http://"), F.lower("n_name"), F.lit("/oai")).alias("url"))
    return state.servers(t.nation.select(F.col("n_name").alias("name"), F.upper(F.substring("n_name", 1, 3)).alias("code"), F.array(one).alias("sets")), "SYS")


@query(f"""SELECT f.cluster_id, f.data AS master, string_agg(c.data, ';' ORDER BY c.oai_id) AS publications, count(*) AS publication_count, max(l.yr) AS yr FROM ({_FINAL}) f JOIN ({_CLUSTER}) k ON k.cluster_id = f.cluster_id
  JOIN ({_CONV}) c ON c.id = k.converted_id AND c.deleted = 0 JOIN live l ON l.id = f.id WHERE l.yr = 2014 GROUP BY f.cluster_id, f.data""")
def q_merged_export(t: Tables) -> DataFrame:
    single = t.search_single
    return state.merged_export(t.sql(_CLUSTER), t.sql(_CONV), t.sql(_FINAL), single, 2014).withColumn("publications", F.array_join("publications", ";"))


@query("SELECT oai_id, data FROM (SELECT oai_id, concat('{\"id\":', cast(id AS string), '}') AS data FROM live) x WHERE oai_id = (SELECT min(oai_id) FROM live)")
def q_publication(t: Tables) -> DataFrame:
    """One merged record without the fields of its making."""
    rows = t.live.select("oai_id", F.struct("id", F.array(F.lit("x")).alias("_publication_ids"), F.array(F.lit("o")).alias("_publication_orgs")).alias("d"))
    return service.publication(rows, rows.agg(F.min("oai_id")).first()[0])


@query("SELECT oai_id, deleted FROM live WHERE oai_id = (SELECT max(oai_id) FROM converted WHERE deleted = 0) UNION ALL SELECT concat('<r>', cast(max(id) AS string), '</r>') AS oai_id, -1 AS deleted FROM converted")
def q_record_reads(t: Tables) -> DataFrame:
    """A processed record, a deleted one (no row) and an original."""
    best = t.live.agg(F.max("oai_id")).first()[0]
    rows = t.sql(_CONV)
    last = rows.agg(F.max_by("oai_id", "id")).first()[0]
    originals = rows.select("oai_id", F.concat(F.lit("<r>"), F.col("id").cast("string"), F.lit("</r>")).alias("xml"))
    gone = rows.where("deleted = 1").agg(F.min("oai_id")).first()[0]
    found = service.processed(rows, best).unionByName(service.processed(rows, gone)).select("oai_id", "deleted")
    return found.unionByName(service.original(originals, last).select(F.col("xml").alias("oai_id"), F.lit(-1).alias("deleted")))


@query("""SELECT id, oai_id AS record_id, CASE WHEN id % 2 = 0 THEN 'titleViolation:Missing title' ELSE 'uriViolation:Missing URI,other:' END AS errors, (SELECT count(*) FROM converted WHERE id % 4 < 2) AS total
  FROM converted WHERE id % 4 < 2 ORDER BY id LIMIT 20 OFFSET 10""")
def q_rejected(t: Tables) -> DataFrame:
    cause = F.when(F.col("id") % 2 == 0, '["titleViolation"]').otherwise('["uriViolation","other"]')
    rows = t.converted.select("id", F.when(F.col("id") % 4 < 2, "h1").otherwise("h2").alias("harvest_id"), "oai_id", cause.alias("rejection_cause"))
    said = F.transform("errors", lambda e: F.concat(e["error_code"], F.lit(":"), F.coalesce(e["label"]["eng"], F.lit(""))))
    return service.rejected(rows, "h1", 20, 10).withColumn("errors", F.array_join(said, ","))


_CODES = "SELECT p_partkey AS id, p_name AS text, CASE p_partkey % 4 WHEN 0 THEN '101' WHEN 1 THEN '102' WHEN 2 THEN '10201' ELSE '5' END AS code FROM part"
_WORDS = "SELECT DISTINCT id, code, w FROM (SELECT id, code, unnest(string_split(lower(text), ' ')) AS w FROM ({0}) c) x WHERE length(w) > 2"


@query(f"""SELECT id, code, round(score, 6) AS score, cast(row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS k FROM (
  SELECT q.id, q.n, g.code, sum(g.weight) / q.n AS score FROM (SELECT id, w, count(*) OVER (PARTITION BY id) AS n FROM ({_WORDS.format(_CODES)}) e) q JOIN (
  SELECT w, code, count(*) * 1.0 / max(n) AS weight FROM (SELECT *, count(DISTINCT id) OVER (PARTITION BY w) AS n FROM ({_WORDS.format(_CODES)}) e) f GROUP BY w, code) g ON g.w = q.w GROUP BY q.id, q.n, g.code) h WHERE score >= 0.1) i WHERE k <= 20 AND length(code) = 3""")
def q_classify(t: Tables) -> DataFrame:
    rows = t.sql(_CODES)
    return service.suggest(rows.select("id", "text"), service.learn(rows), 3)


@query("""SELECT t.code, t.label, string_agg(concat(s.code, '>', k.code), ',' ORDER BY s.code, k.code) AS below FROM concepts t JOIN concepts s ON s.broader = t.code JOIN concepts k ON k.broader = s.code WHERE t.broader IS NULL GROUP BY t.code, t.label""")
def q_tree(t: Tables) -> DataFrame:
    pairs = F.flatten(F.transform("narrower", lambda s: F.transform(s["narrower"], lambda k: F.concat(s["code"], F.lit(">"), k["code"]))))
    return service.tree(t.concepts).select("code", "label", F.array_join(pairs, ",").alias("below"))


_MART = {
    "search_single": "SELECT id AS finalized_id, cast(yr AS string) AS a, CASE id % 4 WHEN 0 THEN 'ref' WHEN 1 THEN 'vet' END AS b, CASE WHEN id % 4 IN (0, 2) THEN '1' ELSE '0' END AS c FROM live",
    "search_doi": "SELECT id AS finalized_id, concat('10.1/', cast(id AS string)) AS a, NULL AS b, NULL AS c FROM live UNION ALL SELECT id, '10.1/host', NULL, NULL FROM live WHERE id % 3 = 1",
    "search_genre_form": "SELECT id AS finalized_id, CASE id % 4 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'edited-book' ELSE 'report' END AS a, NULL AS b, NULL AS c FROM live WHERE id % 4 < 3",
    "search_subject": "SELECT id AS finalized_id, s AS a, NULL AS b, NULL AS c FROM live CROSS JOIN (VALUES (0, '1'), (1, '1'), (1, '102'), (2, '5'), (2, '503'), (2, '50301')) AS v(m, s) WHERE id % 4 = m",
    "search_creator": "SELECT id AS finalized_id, 'Lee' AS a, 'Ann' AS b, concat('l', cast(id % 50 AS string)) AS c FROM live UNION ALL SELECT id, 'Lee', CASE WHEN id % 6 = 0 THEN 'ANN' ELSE 'Bo' END, concat('l', cast(id % 50 AS string)) FROM live WHERE id % 6 < 3",
    "search_org": "SELECT DISTINCT a.id AS finalized_id, b.source AS a, NULL AS b, NULL AS c FROM live a JOIN live b ON a.id % 100 = b.id % 100",
    "search_fulltext": "SELECT id AS finalized_id, CASE WHEN id % 3 = 0 THEN concat('Main ', cast(id AS string), ': Sub') ELSE concat('Main ', cast(id AS string), ': rest') END AS a, '' AS b, NULL AS c FROM live",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS mart, finalized_id, a, b, c FROM ({v}) x" for k, v in _MART.items()))
def q_marts(t: Tables) -> DataFrame:
    rows = _docs(t).select(F.col("id").alias("finalized_id"), (F.col("id") % 100).alias("cluster_id"), "d")
    made = marts.marts(rows, t.live.select("id", "source"), t.live.select((F.col("id") % 100).alias("cluster_id"), F.col("id").alias("converted_id")), F.lit(TODAY).cast("date"), "v:/output/publication/")
    use = {"search_single": ["yr", "content_marking", "swedish_list"], "search_doi": ["value"], "search_genre_form": ["value"], "search_subject": ["value"], "search_creator": ["family_name", "given_name", "local_id"], "search_org": ["value"], "search_fulltext": ["title", "keywords"]}
    out = None
    for k, cols in use.items():
        cells = [F.col(c).cast("string").alias(n) for c, n in zip(cols, "abc")] + [F.lit(None).cast("string").alias(n) for n in "abc"[len(cols) :]]
        df = made[k].select(F.lit(k).alias("mart"), "finalized_id", *cells)
        out = out.unionByName(df) if out is not None else df
    return out


@query("SELECT finalized_id FROM search_single WHERE finalized_id IN (SELECT id FROM live WHERE id % 3 = 1)")
def q_search_doi(t: Tables) -> DataFrame:
    doi = t.live.where("id % 3 = 1").select(F.col("id").alias("finalized_id"), F.lit("10.1/host").alias("value"))
    return search.with_doi(t.search_single, doi, "10.1/host").select("finalized_id")


#: Texts that hold two numbers, one with a flaw, or none.
_NUMBERS = "SELECT a.id AS id, concat(a.value, CASE WHEN a.id % 3 = 0 THEN concat(' and ', b.value) ELSE '' END) AS value FROM {0} a JOIN {0} b ON b.id = CASE WHEN a.id % 2 = 0 THEN a.id ELSE 4 END"
_HIT = {
    "ISSN": "(?:^|[^0-9Xx-])([0-9]{4}-?[0-9]{3}[0-9Xx])(?:$|[^0-9])",
    "ISBN": "(?:^|[^0-9Xx-])(97[89][- ]?(?:[0-9][- ]?){9}[0-9]|(?:[0-9][- ]?){9}[0-9Xx])(?:$|[^0-9])",
}


def _split_sql(view: str, kind: str) -> str:
    return f"""SELECT id, cast(generate_subscripts(hits, 1) AS int) - 1 AS pos, unnest(hits) AS value FROM (SELECT id, CASE WHEN len(h) > 0 THEN h ELSE [value] END AS hits FROM (
      SELECT id, value, regexp_extract_all(value, '{_HIT[kind]}', 1) AS h FROM ({_NUMBERS.format(view)}) x) y) z"""


def _split(t: Tables, view: str, kind: str) -> DataFrame:
    one = F.struct(F.lit(kind).alias("@type"), F.col("value"))
    return t.sql(_NUMBERS.format(view)).select("id", F.posexplode(fields.split(F.array(one), kind)).alias("pos", "x")).select("id", "pos", "x.value")


@query(_split_sql("issns", "ISSN"))
def q_split_issn(t: Tables) -> DataFrame:
    return _split(t, "issns", "ISSN")


@query(_split_sql("isbns", "ISBN"))
def q_split_isbn(t: Tables) -> DataFrame:
    return _split(t, "isbns", "ISBN")


_IDS = "SELECT id, concat('10.', CASE WHEN id % 4 = 0 THEN '' ELSE '12/x' END) AS doi, CASE WHEN id % 5 = 0 THEN '0000-0000' ELSE '1234-5678' END AS issn, CASE WHEN id % 3 = 0 THEN '0000-0002-1825-0097' ELSE 'Ann Lee, 1970' END AS orcid FROM live"


@query(f"""SELECT id, concat_ws(',', CASE WHEN id % 4 <> 0 THEN doi END, CASE WHEN id % 5 = 0 THEN issn END, CASE WHEN id % 3 = 0 THEN orcid ELSE '[redacted]' END) AS kept, concat_ws(',', 'old', CASE WHEN id % 4 = 0 THEN doi END, CASE WHEN id % 5 <> 0 THEN issn END) AS moved FROM ({_IDS}) x""")
def q_move_invalid(t: Tables) -> DataFrame:
    """Invalid identifiers are moved, invalid ORCIDs hidden (0000-0000 is a valid ISSN)."""
    rows = t.sql(_IDS)
    ids = F.array(*(F.struct(F.lit(k).alias("@type"), F.col(c).alias("value")) for k, c in (("DOI", "doi"), ("ISSN", "issn"), ("ORCID", "orcid"))))
    old = F.array(F.struct(F.lit("DOI").alias("@type"), F.lit("old").alias("value")))
    values = lambda c: F.array_join(F.transform(c, lambda x: x["value"]), ",")
    return rows.select("id", values(fields.redacted(fields.without_invalid(ids))).alias("kept"), values(fields.invalid(ids, old)).alias("moved"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN v WHEN 1 THEN concat(v, substr(v, 1, 14), 'x') ELSE v END AS isi, CASE WHEN s_suppkey % 2 = 0 THEN '0000-0002-1' ELSE '1000-0002-1' END AS orcid,
  concat_ws('-', '2020', CASE WHEN s_suppkey % 3 > 0 THEN '03' END, CASE WHEN s_suppkey % 3 > 1 THEN '09' END) AS dated, cast(s_suppkey AS string) AS eid, s_suppkey % 4 = 0 OR s_suppkey % 2 = 1 AS remote
  FROM (SELECT *, concat('000', lpad(cast(s_suppkey AS string), 12, '0')) AS v FROM supplier) x""")
def q_field_repairs(t: Tables) -> DataFrame:
    v, k = F.concat(F.lit("000"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")), F.col("s_suppkey")
    isi = F.when(k % 3 == 0, F.concat(v, v)).when(k % 3 == 1, F.concat(v, F.left(v, F.lit(14)), F.lit("x"))).otherwise(v)
    orcid = F.when(k % 2 == 0, F.lit("000-0002-1")).otherwise(F.lit("1000-0002-1"))
    dated = text.partial_date(F.lit(2020), F.when(k % 3 > 0, 3), F.when(k % 3 > 1, 9))
    remote = F.when(k % 2 == 1, fields.remote(F.lit(None).cast("boolean"), "assume_valid")).otherwise(fields.remote(k % 4 == 0, "known"))
    return t.supplier.select(k.alias("id"), fields.halved(isi).alias("isi"), fields.extended(orcid).alias("orcid"), dated.alias("dated"), text.bare_eid(F.concat(F.lit("2-s2.0-"), k.cast("string"))).alias("eid"), remote.alias("remote"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN 'a,c' WHEN 1 THEN 'a' ELSE '' END AS fields, 'x,B,z' AS updated, 'x,z' AS removed, 'x,y,z,x!' AS copied, 'y' AS second FROM live")
def q_paths(t: Tables) -> DataFrame:
    """Fields without events go; lists are read, changed, cut and added to at a place."""
    ev = lambda cond: F.when(cond, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    each = F.array(*(F.struct(F.lit(n).alias("name"), ev(c).alias("events")) for n, c in (("a", F.col("id") % 3 < 2), ("b", F.lit(False)), ("c", F.col("id") % 3 == 0))))
    items = F.array(*(F.struct(F.lit(x).alias("v")) for x in "xyz"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["v"]), ",")
    return t.live.select(
        "id", F.array_join(F.transform(fields.with_events(each), lambda x: x["name"]), ",").alias("fields"), joined(fields.update_at(items, 1, lambda x: x.withField("v", F.lit("B")))).alias("updated"),
        joined(fields.remove_at(items, 1)).alias("removed"), joined(fields.sibling(items, 0, v=F.lit("x!"))).alias("copied"), fields.read_at(items, 1)["v"].alias("second"),
    )


_SUBJECTS = "SELECT c_custkey AS id, 0 AS pos, concat(cast(1 + c_custkey % 5 AS string), '00') AS code FROM customer UNION ALL SELECT c_custkey AS id, 1 AS pos, cast(1 + c_custkey % 3 AS string) AS code FROM customer UNION ALL SELECT c_custkey AS id, 2 AS pos, cast(1 + c_custkey % 5 AS string) AS code FROM customer"


@query(f"SELECT s.id, min(s.pos) AS pos, s.code, c.label, c.broader FROM ({_SUBJECTS}) s LEFT JOIN concepts c ON c.code = s.code GROUP BY s.id, s.code, c.label, c.broader")
def q_subject_expansion(t: Tables) -> DataFrame:
    return audits.expand_subjects(t.sql(_SUBJECTS), t.concepts)


@query("""WITH RECURSIVE up AS (SELECT code AS term, label, broader, 1 AS k, label AS l FROM concepts UNION ALL SELECT u.term, u.label, c.broader, u.k + 1 AS k, c.label AS l FROM up u JOIN concepts c ON c.code = u.broader)
  SELECT n.n_nationkey AS id, concat(cast(1 + n.n_regionkey AS string), lpad(cast(n.n_nationkey AS string), 2, '0'), '01') AS term, max(u.label) AS label, max(CASE WHEN k = 2 THEN l END) AS broader_label, max(CASE WHEN k = 3 THEN l END) AS top_label, 'auto' AS note
  FROM nation n JOIN up u ON u.term = concat(cast(1 + n.n_regionkey AS string), lpad(cast(n.n_nationkey AS string), 2, '0'), '01') GROUP BY n.n_nationkey, n.n_regionkey""")
def q_embellish(t: Tables) -> DataFrame:
    term = F.concat((1 + F.col("n_regionkey")).cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("01"))
    return audits.embellish(t.nation.select(F.col("n_nationkey").alias("id"), term.alias("term"), F.lit("auto").alias("note")), t.concepts)


_VALUES = "SELECT id, 'ISBN' AS kind, concat('b', cast(id % 50 AS string)) AS value FROM live WHERE id % 2 = 0 UNION ALL SELECT id, 'DOI' AS kind, concat('d', cast(id % 80 AS string)) AS value FROM live"
_BOOKS = "SELECT concat('b', cast(n_nationkey AS string)) AS value, concat('http://book/', cast(n_nationkey AS string)) AS uri FROM nation"
_ARTICLES = "SELECT concat('d', cast(id % 40 AS string)) AS doi, concat('http://article/', cast(id % 40 AS string)) AS uri FROM live WHERE id % 40 > 3"
_HAVE = "SELECT id, concat('http://article/', cast(id % 80 AS string)) AS uri FROM live WHERE id % 9 = 0"


@query(f"""SELECT id, uri, origin FROM (SELECT v.id, CASE WHEN min(b.uri) IS NOT NULL THEN min(b.uri) ELSE min(a.uri) END AS uri, CASE WHEN min(b.uri) IS NOT NULL THEN 'book' ELSE 'article' END AS origin
  FROM ({_VALUES}) v LEFT JOIN ({_BOOKS}) b ON b.value = v.value LEFT JOIN ({_ARTICLES}) a ON a.doi = v.value AND v.kind = 'DOI' GROUP BY v.id) x WHERE uri IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_HAVE}) h WHERE h.id = x.id AND h.uri = x.uri)""")
def q_open_links(t: Tables) -> DataFrame:
    return audits.open_links(t.sql(_VALUES), t.sql(_BOOKS), t.sql(_ARTICLES), t.sql(_HAVE))


_BARE = "SELECT id, concat('d', cast(id % 80 AS string)) AS doi, CASE WHEN id % 2 = 0 THEN 'P' END AS publisher, cast(NULL AS string) AS place, '' AS print_date, cast(NULL AS string) AS online_date, CASE WHEN id % 3 = 0 THEN 'i' END AS issn, cast(NULL AS string) AS summary, 'l' AS license FROM live"
_FACTS = "SELECT concat('d', cast(n_nationkey AS string)) AS doi, 'New' AS publisher, n_name AS place, '2019' AS print_date, cast(NULL AS string) AS online_date, '1234-5679' AS issn, '' AS summary, 'cc' AS license FROM nation"


@query(f"""SELECT b.id, CASE WHEN b.publisher IS NULL THEN f.publisher ELSE b.publisher END AS publisher, f.place, CASE WHEN f.doi IS NULL THEN '' ELSE f.print_date END AS print_date, cast(NULL AS string) AS online_date, coalesce(b.issn, f.issn) AS issn, cast(NULL AS string) AS summary, b.license,
  CASE WHEN f.doi IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.publisher IS NULL THEN 'add_publisher' END, 'add_place', 'add_print_date', CASE WHEN b.issn IS NULL THEN 'add_issn' END) END AS added FROM ({_BARE}) b LEFT JOIN ({_FACTS}) f ON f.doi = b.doi""")
def q_publisher_facts(t: Tables) -> DataFrame:
    return audits.publisher_facts(t.sql(_BARE), t.sql(_FACTS)).withColumn("added", F.array_join("added", ","))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'eng:R0,swe:R1;swe:Other' WHEN 1 THEN 'swe:O0,eng:O1;swe:Plain' WHEN 2 THEN 'swe:O0;swe:O1;swe:Plain' ELSE 'swe:O0;eng:O1;swe:O2' END AS merged FROM live""")
def q_merge_affiliations(t: Tables) -> DataFrame:
    def one(kind: str | None, value: str, source: str | None, lang: str, name: str) -> str:
        ids = f"array(named_struct('@type', '{kind}', 'value', '{value}', 'source', named_struct('code', {f'{source!r}' if source else 'cast(null as string)'})))" if kind else "cast(null as array<struct<`@type`:string,value:string,source:struct<code:string>>>)"
        return f"named_struct('identifiedBy', {ids}, 'nameByLang', map('{lang}', '{name}'), 'name', cast(null as string))"

    cases = [
        [one("ROR", "r", None, "swe", "Rx"), one(None, "", None, "swe", "Other"), one("ROR", "r", None, "eng", "R0"), one("ROR", "r", None, "swe", "R1")],
        [one("URI", "u", "own", "swe", "O0"), one(None, "", None, "swe", "Plain"), one("URI", "u", "own", "eng", "O1")],
        [one("URI", "u", "own", "swe", "O0"), one("URI", "u", "own", "swe", "O1"), one(None, "", None, "swe", "Plain")],
        [one("URI", "u", "own", "swe", "O0"), one("URI", "u", "own", "eng", "O1"), one("URI", "u", "own", "swe", "O2")],
    ]
    items = F.expr("CASE id % 4 " + " ".join(f"WHEN {k} THEN array({', '.join(c)})" for k, c in enumerate(cases)) + " END")
    names = lambda a: F.array_join(F.transform(F.map_entries(a["nameByLang"]), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return t.live.select("id", F.array_join(F.transform(audits.merge_affiliations(items, "own"), names), ";").alias("merged"))


_TRAIN = """SELECT id, CASE WHEN id % 4 = 0 THEN 'short' ELSE 'a title that is long enough to stand by itself' END AS title,
  CASE id % 5 WHEN 0 THEN 'the cat is in the house and that is for the best, as this was written by hand' WHEN 1 THEN 'det är en katt som bor i huset och den har inte gått ut till de andra i dag' WHEN 2 THEN 'n/a' END AS summary, CASE id % 3 WHEN 0 THEN '10201' WHEN 1 THEN '305' ELSE '1020101' END AS code FROM live"""


@query(f"""SELECT id, concat(title, ' ', CASE WHEN id % 5 = 0 THEN summary ELSE '' END, ' k') AS text, CASE WHEN id % 3 = 0 THEN '1,102,10201' ELSE '3,305' END AS codes FROM ({_TRAIN}) x WHERE id % 3 < 2 AND (id % 4 <> 0 OR id % 5 = 0)""")
def q_training(t: Tables) -> DataFrame:
    rows = t.sql(_TRAIN).select("id", "title", "summary", F.array(F.lit("k")).alias("keywords"), F.array("code").alias("codes"))
    return training.examples(rows, "en").withColumn("codes", F.array_join("codes", ","))


@query(f"SELECT id, CASE id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'sv' END AS language FROM ({_TRAIN}) x")
def q_language(t: Tables) -> DataFrame:
    return t.sql(_TRAIN).select("id", training.language(F.col("summary")).alias("language"))


@query("SELECT count(*) AS n, min(yr) AS first, cast(1 AS bigint) AS n_files FROM live WHERE yr = 2013")
def q_yearly_files(t: Tables) -> DataFrame:
    """Yearly files are written, summed by the executors and read back."""
    from uuid import uuid4

    from ..operators.relational import shared_folder

    path = f"{shared_folder(t.spark)}/yearly-{uuid4().hex}"
    state.write_yearly(t.live.where("yr IN (2011, 2013)").select("oai_id", "yr").coalesce(1), path)
    sums = state.checksums(t.spark, path).where(F.length("sha256") == 64).where(F.length("md5") == 32).count()
    rows = t.spark.read.json(path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("yr").cast("int").alias("first")).withColumn("n_files", F.lit(sums).cast("long"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat('<a>', cast(id AS string), '</a>') WHEN id % 3 = 1 THEN concat('<B>', cast(id AS string), '</B>') ELSE cast(id AS string) END AS xml FROM live")
def q_restyle(t: Tables) -> DataFrame:
    raw = F.when(F.col("id") % 3 == 2, F.col("id").cast("string")).otherwise(F.concat(F.lit("<b>"), F.col("id").cast("string"), F.lit("</b>")))
    rows = t.live.select("id", F.when(F.col("id") % 3 == 0, "s").otherwise("other").alias("source"), F.when(F.col("id") % 3 == 1, "http://mark/x").otherwise("http://y").alias("url"), raw.alias("xml"))
    return state.restyle(rows, {"s": lambda x: F.translate(x, "b", "a")}, ("mark", lambda x: F.translate(x, "b", "B"))).select("id", "xml")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'v:/Published' END AS one, CASE WHEN id % 8 IN (0, 1, 2, 3, 4, 5) THEN 1 ELSE 0 END AS has_access, CASE WHEN id % 8 IN (1, 2, 4, 5) THEN 1 ELSE 0 END AS has_embargo FROM live")
def q_policies(t: Tables) -> DataFrame:
    d = F.col("d")
    p = documents.policies(d)
    return _docs(t).select("id", documents.publication_status(d, only=True).alias("one"), (F.size(p["access"]) > 0).cast("int").alias("has_access"), (F.size(p["embargo"]) > 0).cast("int").alias("has_embargo"))


@query("""SELECT id, oai_id AS control, CASE WHEN id % 4 = 0 THEN 'ComponentPart' WHEN id % 4 < 3 THEN 'Monograph' END AS issuance, CASE WHEN id % 2 = 0 THEN '2024' ELSE cast(yr AS string) END AS year, concat('https://doi.org/10.1/', cast(id AS string)) AS related,
  CASE WHEN id % 4 = 1 THEN 'Contribution' ELSE 'PrimaryContribution' END AS first_contribution, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n_hosts, CASE id % 4 WHEN 0 THEN 'art,ref' WHEN 1 THEN 'sam,vet' WHEN 2 THEN 'rap' ELSE '' END AS concepts FROM live""")
def q_legacy(t: Tables) -> DataFrame:
    terms = legacy.Terms("Sys", "SYS", "http://lib/", "v:/output/", "v:/types/", "l:/", "r:/", "s:/uka/", ("s:/uka",), "http://urn/resolve?urn=", "own")
    x = F.col("x")
    rows = t.publications.select("id", legacy.project(legacy.parse(F.col("doc")), terms, F.lit("2024-07-08").cast("date")).alias("x"))
    concepts = F.array_join(F.transform(x["instanceOf"]["subject"], lambda s: s["label"]), ",")
    return rows.select(
        "id", x["meta"]["controlNumber"].alias("control"), x["issuanceType"].alias("issuance"), F.get(x["publication"], F.lit(0))["year"].alias("year"), F.get(F.get(x["relatedTo"], F.lit(0))["uri"], F.lit(0)).alias("related"),
        F.get(x["instanceOf"]["contribution"], F.lit(0))["@type"].alias("first_contribution"), F.coalesce(F.size(x["isPartOf"]), F.lit(0)).alias("n_hosts"), concepts.alias("concepts"),
    )
