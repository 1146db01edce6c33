"""DuckDB SQL with the rows of those queries that SQL can express, over whole tables."""

from __future__ import annotations

from .decontaminate import MASKS, SPAN
from .sharding import even_tree
from .urls import RULES

WORD = "[^\\x20\\x09-\\x0D]+"

#: Every 200-byte string of every text that starts at two places; hex digits stand for bytes.
REPEATS = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  raw AS (SELECT r, doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM docs),
  starts AS (SELECT r, unnest(range(n - 199)) AS p, b FROM raw WHERE n >= 200),
  keyed AS (SELECT r, p, md5(array_slice(b, p + 1, p + 200)) AS k FROM starts),
  twice AS (SELECT r, p FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
  edges AS (SELECT r, p, CASE WHEN p - lag(p) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM twice WINDOW w AS (PARTITION BY r ORDER BY p)),
  runs AS (SELECT r, g, min(p) AS a, max(p) + 200 AS e FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM edges) GROUP BY r, g),
  gaps AS (SELECT r, e AS a, coalesce(lead(a) OVER w, NULL) AS e FROM runs WINDOW w AS (PARTITION BY r ORDER BY a) UNION ALL SELECT r, 0, min(a) FROM runs GROUP BY r),
  kept AS (SELECT g.r, string_agg(substr(hex(raw.b), 2 * a + 1, 2 * (coalesce(g.e, n) - a)), '' ORDER BY a) AS h FROM gaps g JOIN raw ON raw.r = g.r GROUP BY g.r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM raw LEFT JOIN kept ON kept.r = raw.r LEFT JOIN (SELECT r, sum(e - a) AS removed, count(*) AS spans FROM runs GROUP BY r) s ON s.r = raw.r"""

#: Components of the pairs whose sets of 5-word shingles are alike enough; ids reach each other by repeated links.
NEAR = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
  sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(array_slice(w, i, i + 4), ' '))) END AS s FROM docs),
  each AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM sets),
  links AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, a.doc_id, a.n, b.r, b.doc_id, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
  least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(l.y, s.doc_id)) AS kept FROM sets s LEFT JOIN least l ON l.x = s.doc_id"""


def _draw(path: str, weight: float | str) -> str:
    """A child's arrival time."""
    return f"-ln((('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, 'null'), ':', {path})), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656) / {weight}"


def shard_sql(shards: int = 24) -> str:
    """The tree of equal racks and regions, level by level; the crc is that of the polynomial 0xEDB88320, by a table made here."""
    tree = even_tree(shards)
    racks, leaves = len(tree[0]), len(tree[0][0])
    region = ", ".join(_draw(f"'{k}'", f"{float(racks * leaves)}") for k in range(len(tree)))
    rack = ", ".join(_draw(f"concat(g, '.{k}')", f"{float(leaves)}") for k in range(racks))
    leaf = ", ".join(_draw(f"concat(g, '.', k, '.{x}')", "1.0") for x in range(leaves))
    first = "list_position({0}, list_min({0})) - 1"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS n FROM range(256) UNION ALL SELECT i, {step} AS c, n + 1 FROM bits WHERE n < 8),
      crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
      docs AS (SELECT row_number() OVER () AS r, doc_id, text, [{region}] AS d, {_draw(f"'{len(tree)}'", "1.0")} AS extra FROM documents),
      regions AS (SELECT *, {first.format('d')} AS g FROM docs),
      racked AS (SELECT *, {first.format(f'[{rack}]')} AS k FROM regions),
      placed AS (SELECT *, {first.format(f'[{leaf}]')} AS x FROM racked),
      summed AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, g * {racks * leaves} + k * {leaves} + x AS shard, extra < list_min(d) AS moved,
        xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
          lambda c, b: xor(c >> 8, list_extract(t, xor(c, b) % 256 + 1))), 4294967295) AS crc FROM placed, crcs)
    SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, CASE WHEN moved THEN {shards} ELSE shard::INT END AS grown_shard FROM summed"""


def decontamination_sql() -> str:
    """Equal words on each diagonal; a diagonal counts if some window of eight item places has all words that one mask reads equal."""
    hit = " OR ".join(f"bits & {int(m, 2)} = {int(m, 2)}" for m in MASKS)
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
      items AS (SELECT min(item_id) AS item_id, w, len(w) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w),
      dw AS (SELECT r, len(w) AS total, unnest(w) AS x, unnest(range(len(w))) AS p FROM docs),
      iw AS (SELECT item_id, n, unnest(w) AS x, unnest(range(n)) AS k FROM items),
      eq AS (SELECT r, item_id, n, total, p - k AS d, list(k) AS ks FROM dw JOIN iw USING (x) GROUP BY r, item_id, n, total, p - k HAVING count(*) >= least(n, 5)),
      marks AS (SELECT r, item_id, n, total, d, unnest(ks) AS k, len(ks) AS n_equal FROM eq WHERE n >= {SPAN}),
      windows AS (SELECT r, item_id, n, total, d, n_equal, s, sum(1 << ({SPAN - 1} - (k - s)))::BIGINT AS bits FROM (SELECT *, unnest(range(greatest(k - {SPAN - 1}, 0), least(k, n - {SPAN}) + 1)) AS s FROM marks)
        WHERE s + d >= -1 AND s + d + {SPAN - 1} <= total GROUP BY r, item_id, n, total, d, n_equal, s),
      found AS (SELECT DISTINCT r, item_id, n, n_equal FROM windows WHERE ({hit}) AND n_equal >= ceil(0.8 * least(n, 13)) UNION SELECT r, item_id, n, len(ks) FROM eq WHERE n < {SPAN} AND len(ks) = n),
      best AS (SELECT doc_id, item_id, n, max(n_equal) AS n_equal FROM found JOIN docs USING (r) GROUP BY doc_id, item_id, n),
      top AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, min(struct_pack(less := -n_equal, item_id := item_id, n := n)) AS t FROM best GROUP BY doc_id)
    SELECT d.doc_id, n_items IS NOT NULL AS contaminated, t.item_id AS item_id, t.n::BIGINT AS item_words, (-t.less)::BIGINT AS n_equal, coalesce(n_items, 0) AS n_items
    FROM docs d LEFT JOIN top ON d.doc_id IS NOT DISTINCT FROM top.doc_id"""


def url_sql(min_count: int = 20, min_confidence: float = 0.8) -> str:
    """The fixed rules, then all sets of tokens that enough bad labelled urls share, grown token by token."""
    fixed = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
      parts AS (SELECT page_id, coalesce(url, '') AS url, coalesce({lower.format("regexp_extract(u, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
      judged AS (SELECT *, CASE {fixed} END AS f, regexp_extract(path, '\\.([A-Za-z0-9]{{1,5}})$', 1) AS ending, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM parts),
      tok AS (SELECT page_id, host, path, f, row_number() OVER () AS r, list_distinct(list_filter(list_concat(
          list_transform(string_split(host, '.'), lambda x: 'host:' || x),
          list_transform(list_filter(string_split(regexp_replace(path, '\\.[A-Za-z0-9]{{1,5}}$', ''), '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '9', 'g')),
          CASE WHEN ending <> '' THEN ['end:' || ending] ELSE [] END,
          list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'key:' || string_split(x, '=')[1])), lambda x: x <> 'host:')) AS ts FROM judged),
      known AS (SELECT r, bad, unnest(ts) AS t FROM tok JOIN (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id) l ON l.doc_id = tok.page_id),
      single AS (SELECT t, list(r) AS every, list(r) FILTER (bad = 1) AS worst FROM known GROUP BY t HAVING sum(bad) >= {min_count}),
      sets AS (SELECT [t] AS s, t AS last, every, worst FROM single UNION ALL SELECT list_append(s, single.t), single.t, list_intersect(sets.every, single.every), list_intersect(sets.worst, single.worst)
        FROM sets JOIN single ON single.t > sets.last WHERE len(list_intersect(sets.worst, single.worst)) >= {min_count} AND len(sets.worst) < {min_confidence} * len(sets.every)),
      rules AS (SELECT s FROM sets WHERE len(worst) >= {min_confidence} * len(every)),
      hits AS (SELECT DISTINCT r FROM tok, rules WHERE f IS NULL AND list_has_all(ts, s))
    SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN r IN (SELECT r FROM hits) THEN 'block' ELSE 'allow' END) AS verdict FROM tok"""


ORACLES = {
    "op4_suffix_dedup": REPEATS,
    "op6_near_duplicates": NEAR,
    "op7_sharding": shard_sql(),
    "op9_decontamination": decontamination_sql(),
    "op10_url_filters": url_sql(),
}
