"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

SQL["op8_decontaminate"] = rf"""
WITH item AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE item_id IS NOT NULL AND len(w) > 0),
bench AS (
  SELECT DISTINCT item_id, least(n, 10) AS len, list_slice(w, i, i + least(n, 10) - 1) AS g
  FROM (SELECT item_id, w, n, unnest(range(1, n - least(n, 10) + 2)) AS i FROM item)),
lens AS (SELECT DISTINCT len FROM bench),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
gram AS (SELECT r, len, i, list_slice(w, i, i + len - 1) AS g FROM (SELECT r, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM doc, lens WHERE len(w) >= len)),
hit AS (SELECT r, gram.len, i, item_id FROM gram JOIN bench ON gram.len = bench.len AND gram.g = bench.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + len)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op1_url_filter"] = rf"""
WITH rule(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT row_number() OVER () AS r, page_id, regexp_replace(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '(?s)[?#].*$', '') AS rest FROM pages),
page AS (SELECT r, page_id, translate(CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END, {_ABC}) AS host,
  CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM page JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM page LEFT JOIN best USING (r)
"""

SQL["op3_warc"] = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM (SELECT *, payload_bytes >= 1000 AND page_id <> last AS again
  FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))
"""

SQL["op4_near_dedup"] = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ABC}), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, r) AS (SELECT doc_id, doc_id FROM doc UNION SELECT x, b FROM reach JOIN edge ON r = a),
comp AS (SELECT x AS doc_id, min(r) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM doc JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SQL["op6_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _pii() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({digits}, i, 1) AS INTEGER)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN (2 * {digit}) // 10 + (2 * {digit}) % 10 ELSE {digit} END)) % 10 = 0"
    plain = "replace(v, ' ', '')"
    chars = f"string_split(substr({plain}, 5) || substr({plain}, 1, 4), '')"
    values = f"list_transform(list_filter({chars}, lambda c: c <> ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    mod = f"list_reduce(list_prepend(0, {values}), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1"
    before = "lower(substr(text, CAST(greatest(s - 40, 0) + 1 AS INTEGER), CAST(least(s, 40) AS INTEGER)))"
    beside = "NOT regexp_matches(substr(text, CAST(s AS INTEGER), 1), '[0-9-]') AND NOT regexp_matches(substr(text, CAST(e + 1 AS INTEGER), 1), '[0-9-]')"
    issued = "substr(v, 1, 3) < '900' AND substr(v, 1, 3) NOT IN ('000', '666') AND substr(v, 5, 2) <> '00' AND substr(v, 8, 4) <> '0000'"
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", f"length({plain}) BETWEEN 15 AND 34 AND {mod}"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{issued} AND (s = 0 OR {beside}) AND regexp_matches({before}, 'ssn|social security|soc sec')"),
    )
    parts = [
        f"""SELECT r, {k} AS k, '{kind}' AS kind, s, e FROM (SELECT r, text, v, s, s + length(v) AS e FROM (
    SELECT r, text, v, sum(length(g) + length(v)) OVER (PARTITION BY r ORDER BY i) - length(v) AS s FROM (
      SELECT r, text, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g, unnest(range(1, len(vs) + 1)) AS i
      FROM (SELECT r, text, regexp_extract_all(text, '{p}') AS vs, regexp_split_to_array(text, '{p}') AS gs FROM doc)))) WHERE {ok}"""
        for k, (kind, p, ok) in enumerate(kinds)
    ]
    said = "kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in kinds[:4])
    return f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(parts)}),
agg AS (SELECT r, {counts}, string_agg({said}, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg({said}, ',' ORDER BY k, s) AS spans FROM span GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in kinds[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN agg USING (r)"""


SQL["op7_pii"] = _pii()
