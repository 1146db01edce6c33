"""Bibliographic views over the driver's tables, in SQL text that Spark and DuckDB read alike.

The test tables hold no bibliographic records, so identifiers, statuses and
flags are derived from their keys by integer arithmetic. ``{name}`` stands for
a base table or another view; ``expand`` turns a query's text into one
statement with the views it needs as common table expressions.
"""

from __future__ import annotations

import re

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    "converted": """
        SELECT d.doc_id AS id, concat('oai:', d.source, ':', cast(d.doc_id AS string)) AS oai_id, d.source AS source, 2010 + cast(d.doc_id % 15 AS int) AS yr,
          coalesce(l.quality, 0) AS is_open_access,
          CASE d.doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS classification_level,
          CASE WHEN d.doc_id % 4 <> 0 THEN 1 ELSE 0 END AS has_ssif_1,
          CASE WHEN d.doc_id % 29 = 0 THEN 1 ELSE 0 END AS deleted,
          d.doc_id * 37 % 100000 AS modified
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "live": "SELECT * FROM converted WHERE deleted = 0",
    "record_info": """
        SELECT c.id, c.source, c.yr, f.field_name, cast((c.id * 7 + f.k) % 3 AS int) AS validation_status,
          cast((c.id * 5 + f.k) % 3 AS int) AS enrichment_status, cast((c.id + f.k) % 2 AS int) AS normalization_status
        FROM live c CROSS JOIN (VALUES ('ISBN', 0), ('ISSN', 1), ('DOI', 2), ('ISI', 3), ('ORCID', 4), ('URI', 5), ('publication_year', 6), ('creator_count', 7), ('SSIF', 8), ('free_text', 9), ('PersonID', 10)) AS f(field_name, k)
        WHERE (c.id + f.k) % 5 <> 0""",
    "audit_info": """
        SELECT c.id, c.source, c.yr, f.audit_code, cast((c.id + f.k) % 2 AS int) AS audit_result
        FROM live c CROSS JOIN (VALUES ('creator_count_check', 0), ('contributor_duplicate_check', 1), ('SSIF_comprehensive_check', 2), ('ISSN_missing_check', 3), ('auto_classify', 4), ('add_oa', 5)) AS f(audit_code, k)
        WHERE (c.id + f.k) % 4 <> 0""",
    "ssif": "SELECT id, source, yr, cast(1 + id % 6 AS string) AS value FROM live WHERE has_ssif_1 = 1 UNION ALL SELECT id, source, yr, cast(1 + (id + 3) % 6 AS string) AS value FROM live WHERE has_ssif_1 = 1 AND id % 5 = 0",
    "search_single": """
        SELECT id AS finalized_id, yr, CASE id % 4 WHEN 0 THEN 'ref' WHEN 1 THEN 'vet' WHEN 2 THEN 'pop' END AS content_marking,
          CASE id % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'epub' WHEN 2 THEN 'submitted' WHEN 3 THEN 'retracted' END AS publication_status,
          cast(id % 2 AS int) AS swedish_list, is_open_access AS open_access, cast(id % 7 % 2 AS int) AS autoclassified, cast(id % 11 % 2 AS int) AS doaj FROM live""",
    "search_org": "SELECT id AS finalized_id, source AS value FROM live UNION SELECT id AS finalized_id, concat('src', cast(id % 9 AS string)) AS value FROM live",
    "search_subject": "SELECT id AS finalized_id, value FROM ssif",
    "search_genre": "SELECT c.id AS finalized_id, concat('publication/', lower(p.p_type)) AS value FROM live c JOIN part p ON p.p_partkey = 1 + c.id % 200",
    "search_creator": """SELECT c.id AS finalized_id, concat('0000-', lpad(cast(u.c_custkey AS string), 4, '0')) AS orcid, u.c_name AS family_name, n.n_name AS local_id_by, cast(u.c_custkey AS string) AS local_id
        FROM live c JOIN customer u ON u.c_custkey = 1 + c.id % 150 JOIN nation n ON n.n_nationkey = u.c_nationkey""",
    "titles": "SELECT doc_id AS id, source, split_part(coalesce(text, ''), '\n', 1) AS title, substr(coalesce(text, ''), cast(length(split_part(coalesce(text, ''), '\n', 1)) + 2 AS int)) AS summary FROM documents",
    "runs": """SELECT event_id AS run_id, concat('src', cast(user_id % 20 AS string)) AS source, ts AS started, event_type, value,
        CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS succeeded, event_id % 500 AS record FROM events""",
    "issns": """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN concat('ISSN: ', v) WHEN 1 THEN replace(v, '-', '') WHEN 2 THEN concat(substr(v, 1, 8), '!') WHEN 3 THEN lower(v) WHEN 4 THEN concat(v, 'f') ELSE v END AS value FROM (
        SELECT p_partkey, concat(substr(d, 1, 4), '-', substr(d, 5, 3), CASE WHEN p_partkey % 10 = 3 THEN '0' WHEN c = 10 THEN 'X' ELSE cast(c AS string) END) AS v FROM (
        SELECT p_partkey, d, (11 - (8 * cast(substr(d, 1, 1) AS int) + 7 * cast(substr(d, 2, 1) AS int) + 6 * cast(substr(d, 3, 1) AS int) + 5 * cast(substr(d, 4, 1) AS int) + 4 * cast(substr(d, 5, 1) AS int) + 3 * cast(substr(d, 6, 1) AS int) + 2 * cast(substr(d, 7, 1) AS int)) % 11) % 11 AS c
        FROM (SELECT p_partkey, lpad(cast(p_partkey * 7919 % 10000000 AS string), 7, '0') AS d FROM part) x) y) z""",
    "isbns": """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('ISBN ', v) WHEN 1 THEN concat(substr(v, 1, 3), '-', substr(v, 4)) WHEN 2 THEN concat(v, ' (pdf)') WHEN 3 THEN substr(v, 1, 12) ELSE v END AS value FROM (
        SELECT o_orderkey, concat(d, CASE WHEN o_orderkey % 10 = 3 THEN '0' ELSE cast(c AS string) END) AS v FROM (
        SELECT o_orderkey, d, (10 - (cast(substr(d, 1, 1) AS int) + 3 * cast(substr(d, 2, 1) AS int) + cast(substr(d, 3, 1) AS int) + 3 * cast(substr(d, 4, 1) AS int) + cast(substr(d, 5, 1) AS int) + 3 * cast(substr(d, 6, 1) AS int) + cast(substr(d, 7, 1) AS int) + 3 * cast(substr(d, 8, 1) AS int) + cast(substr(d, 9, 1) AS int) + 3 * cast(substr(d, 10, 1) AS int) + cast(substr(d, 11, 1) AS int) + 3 * cast(substr(d, 12, 1) AS int)) % 10) % 10 AS c
        FROM (SELECT o_orderkey, concat('978', lpad(cast(o_orderkey AS string), 9, '0')) AS d FROM orders) x) y) z""",
    "orcids": "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat('ORCID: ', v) WHEN 1 THEN replace(v, '-', '') WHEN 2 THEN concat('http://orcid.org/', v) ELSE v END AS value FROM (SELECT c_custkey, concat('0000-0001-', lpad(cast(5000 + c_custkey % 4000 AS string), 4, '0'), '-', lpad(cast(c_custkey * 31 % 1000 AS string), 3, '0'), cast(c_custkey % 10 AS string)) AS v FROM customer) x",
    "dois": "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN concat('doi:', v) WHEN 1 THEN concat('http://doi.org/', v) WHEN 2 THEN concat(v, ' x') WHEN 3 THEN '10.missing/' WHEN 4 THEN concat('https://doi.org/', v) ELSE v END AS value FROM (SELECT s_suppkey, concat('10.', cast(1000 + s_suppkey AS string), '/abc.', cast(s_suppkey AS string)) AS v FROM supplier) x",
    "publications": """
        SELECT id, source, yr, concat('{"@id":"', oai_id, '","@type":"Instance","instanceOf":{"@type":"Text","hasTitle":[',
            CASE id % 3 WHEN 0 THEN concat('{"@type":"VariantTitle","mainTitle":"V"},{"@type":"Title","mainTitle":"Main ', cast(id AS string), '","subtitle":"Sub"}') ELSE concat('{"@type":"Title","mainTitle":"Main ', cast(id AS string), ': rest"}') END,
            '],"genreForm":[', CASE id % 4 WHEN 0 THEN '{"@id":"v:/swedishlist/non-peer-reviewed"},{"@id":"v:/output/publication/journal-article"},{"@id":"v:/types/ref"}' WHEN 1 THEN '{"@id":"v:/output/publication/edited-book"},{"@id":"v:/types/vet"}' WHEN 2 THEN '{"@id":"v:/swedishlist/peer-reviewed"},{"@id":"v:/output/publication/report"}' ELSE '{"@id":"v:/JournalArticle"}' END,
            '],"hasNote":[', CASE id % 5 WHEN 0 THEN '{"@type":"PublicationStatus","@id":"v:/Published"}' WHEN 1 THEN '{"@type":"PublicationStatus","@id":"v:/Submitted"},{"@type":"PublicationStatus","@id":"v:/Retracted"}' ELSE concat('{"@type":"CreatorCount","label":"', cast(id % 5 - 1 AS string), '"}') END,
            '],"contribution":[{"@type":"Contribution","agent":{"@type":"Person","givenName":"Ann","familyName":"Lee","identifiedBy":[{"@type":"Local","value":"l', cast(id % 50 AS string), '","source":{"@type":"Source","code":"', source, '"}}]},"role":[{"@id":"r:/', CASE id % 4 WHEN 1 THEN 'edt' ELSE 'aut' END, '"}]}',
            CASE WHEN id % 6 < 3 THEN concat(',{"@type":"Contribution","agent":{"@type":"Person","givenName":"', CASE WHEN id % 6 = 0 THEN 'ANN' ELSE 'Bo' END, '","familyName":"Lee","identifiedBy":[{"@type":"Local","value":"l', cast(id % 50 AS string), '","source":{"@type":"Source","code":"', source, '"}}]},"role":[{"@id":"r:/', CASE id % 4 WHEN 1 THEN 'edt' ELSE 'aut' END, '"}]}') ELSE '' END,
            ',{"@type":"Contribution","agent":{"@type":"Organization","name":"Org"},"role":[{"@id":"r:/pbl"}]}],"classification":[', CASE id % 4 WHEN 0 THEN '{"code":"1"}' WHEN 1 THEN '{"code":"102"},{"code":"1"}' WHEN 2 THEN '{"code":"50301","@annotation":{"assigner":{"@id":"v:/autoclassifier"}}}' ELSE '{"code":"9999"}' END,
            ']},"publication":[{"@type":"Publication","date":"', cast(yr AS string), CASE WHEN id % 2 = 0 THEN '-03' ELSE '' END, '"}],"usageAndAccessPolicy":[',
            CASE id % 8 WHEN 0 THEN '{"@id":"p:/oa/gratis"}' WHEN 1 THEN '{"@id":"p:/oa/gratis"},{"@type":"Embargo","endDate":"2030-01-01"}' WHEN 2 THEN '{"@type":"Embargo","endDate":"2001-01-01"},{"@type":"AccessPolicy","label":"gratis"}'
              WHEN 3 THEN '{"@type":"AccessPolicy","label":"restricted"},{"@id":"p:/oa/gratis"}' WHEN 4 THEN '{"@type":"Embargo"},{"@id":"p:/oa/gratis"}' WHEN 5 THEN '{"@type":"Embargo","endDate":"soon"},{"@id":"p:/oa/gratis"}' ELSE '' END,
            '],"electronicLocator":[', CASE id % 5 WHEN 0 THEN '{"@type":"MediaObject","uri":"u:1","usageAndAccessPolicy":[{"@id":"p:/oa/restricted"}]},{"@type":"Resource","uri":"u:2","hasNote":[{"label":"free"}]}' WHEN 1 THEN '{"@type":"Resource","uri":"u:3","hasNote":[{"label":"free/2099-01-01"}]}' WHEN 2 THEN '{"@type":"Resource","uri":"u:4","hasNote":[{"label":"free/2012-01-01"},{"@id":"v:/Accepted"}]}' WHEN 3 THEN '{"@type":"Resource","uri":"","hasNote":[{"label":"free"}]}' ELSE '' END,
            '],"identifiedBy":[{"@type":"DOI","value":"10.1/', cast(id AS string), '"}', CASE WHEN id % 3 = 1 THEN ',{"@type":"ISBN","value":"b1"}' ELSE '' END,
            '],"isPartOf":[', CASE id % 3 WHEN 0 THEN '{"@type":"Dataset","hasTitle":[{"@type":"Title","mainTitle":"Data"}]},{"hasTitle":[{"@type":"Title","mainTitle":"Journal"}],"identifiedBy":[{"@type":"ISSN","value":"s1"},{"@type":"ISBN","value":"b2"}]}' WHEN 1 THEN '{"identifiedBy":[{"@type":"ISBN","value":"b2"},{"@type":"DOI","value":"10.1/host"}],"hasSeries":[{"hasTitle":[{"@type":"Title","mainTitle":"Series"}],"identifiedBy":[{"@type":"ISBN","value":"b3"}]}]}' ELSE '' END,
            ']}') AS doc FROM live""",
    "concepts": """SELECT cast(1 + r_regionkey AS string) AS code, r_name AS label, cast(NULL AS string) AS broader FROM region
        UNION ALL SELECT concat(cast(1 + n_regionkey AS string), lpad(cast(n_nationkey AS string), 2, '0')) AS code, n_name AS label, cast(1 + n_regionkey AS string) AS broader FROM nation
        UNION ALL SELECT concat(cast(1 + n_regionkey AS string), lpad(cast(n_nationkey AS string), 2, '0'), '01') AS code, concat(n_name, ' 1') AS label, concat(cast(1 + n_regionkey AS string), lpad(cast(n_nationkey AS string), 2, '0')) AS broader FROM nation""",
}


def expand(sql: str) -> str:
    """The statement with the views that it names, and those that these name, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    if need and (m := re.match(r"\s*WITH RECURSIVE\s", sql)):
        return f"WITH RECURSIVE {views},\n{sql[m.end():]}"
    return f"WITH {views}\n{sql}" if need else sql
