"""DuckDB SQL of the queries, written apart from their expressions."""

from __future__ import annotations

from docveil.operators import registry as G
from docveil.sinks.html import COLOURS, OTHER

_EDGE = r"""E' \t\r\n.,;:!?"\'`()[]{}<>|'"""
_LINES = r"""line AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE trim(parts[i], E' \t\r\n\f\x0b') <> '')"""
_NUM = "num AS (SELECT CAST(o_orderkey AS BIGINT) AS id, lpad(CAST((CAST(o_orderkey AS BIGINT) * 7919 * 101) % 1000000000 AS VARCHAR), 9, '0') AS d FROM orders)"
_SSN = "substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 4)"
_EIN = "substr(d, 1, 2) || '-' || substr(d, 3, 7)"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _ssn_ok(v: str) -> str:
    d = _digits(v)
    return f"(length({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 3) < '900' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"


def _ein_ok(v: str) -> str:
    return f"(length({_digits(v)}) = 9 AND CAST(substr({_digits(v)}, 1, 2) AS INTEGER) NOT IN {G.V.EIN_UNASSIGNED})"


def _aba_ok(v: str) -> str:
    d = _digits(v)
    at = [f"CAST(substr({d}, {i}, 1) AS INTEGER)" for i in range(1, 10)]
    total = " + ".join(f"{(3, 7, 1)[i % 3]} * {a}" for i, a in enumerate(at))
    prefix = " OR ".join(f"CAST(substr({d}, 1, 2) AS INTEGER) BETWEEN {a} AND {b}" for a, b in G.V.ABA_PREFIXES)
    return f"(CASE WHEN length({d}) = 9 THEN ({prefix}) AND ({total}) % 10 = 0 ELSE false END)"


def _luhn_ok(v: str) -> str:
    d = _digits(v)
    digit = f"CAST(substr({d}, i, 1) AS INTEGER)"
    part = f"CASE WHEN (length({d}) - i) % 2 = 1 THEN (2 * {digit}) // 10 + (2 * {digit}) % 10 ELSE {digit} END"
    return f"(length({d}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: {part})) % 10 = 0)"


def _ip_ok(v: str) -> str:
    return f"(len(list_filter(string_split({v}, '.'), lambda p: CAST(p AS INTEGER) <= 255)) = 4)"


def _iban_ok(v: str) -> str:
    plain = rf"upper(regexp_replace({v}, '\s', '', 'g'))"
    chars = f"list_filter(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: c <> '')"
    values = f"list_transform({chars}, lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    rest = f"list_reduce(list_prepend(0, {values}), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97)"
    return f"(regexp_full_match({plain}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND {rest} = 1)"


_VALID = {G.V.iban_valid: _iban_ok, G.V.ssn_valid: _ssn_ok, G.V.ein_valid: _ein_ok, G.V.aba_valid: _aba_ok, G.V.luhn_valid: _luhn_ok, G.V.ip_valid: _ip_ok}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _near(words: tuple[str, ...]) -> str:
    either = "|".join(w.replace(".", r"\.") for w in words)
    tokens = r"list_filter(regexp_split_to_array(substr(text, 1, CAST(s0 AS INTEGER)), '\s+'), lambda t: t <> '')"
    return f"regexp_matches(lower(array_to_string({tokens}[-5:], ' ')), '(?:^|[^a-z0-9])(?:{either})(?:$|[^a-z0-9])')"


def _detector(source: str, k: int, d: G.Detector) -> str:
    """Trimmed and scored spans of a detector, over lines (doc_id, line_no, text)."""
    re = _quoted(d.pattern)
    ok = _VALID[d.valid]("v") if d.valid else "CAST(NULL AS BOOLEAN)"
    base = f"CAST({d.score} AS DOUBLE)"
    score = f"CASE WHEN {ok} THEN CAST(1.0 AS DOUBLE) WHEN NOT {ok} THEN NULL ELSE least({base} + CASE WHEN {_near(d.context)} THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 1.0) END"
    return f"""
  SELECT doc_id, line_no, CAST({0 if d.deterministic else 1} AS INTEGER) AS det, {k} AS ordinal, '{d.entity}' AS entity_type, CAST(score AS DOUBLE) AS score,
    s0 + length(v) - length(ltrim(v, {_EDGE})) AS st, trim(v, {_EDGE}) AS value
  FROM (SELECT *, {score} AS score FROM (
    SELECT doc_id, line_no, text, v, sum(length(g) + length(v)) OVER (PARTITION BY doc_id, line_no ORDER BY i) - length(v) AS s0
    FROM (SELECT doc_id, line_no, text, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g, unnest(range(1, len(vs) + 1)) AS i
      FROM (SELECT doc_id, line_no, text, regexp_extract_all(text, {re}) AS vs, regexp_split_to_array(text, {re}) AS gs FROM {source}))))
  WHERE score >= 0.35 AND trim(v, {_EDGE}) <> ''"""


def _resolved(source: str, entities: list[str] | None) -> str:
    """CTEs: ``ent``, the resolved entities of ``source`` with places in their lines."""
    parts = "\n  UNION ALL".join(_detector(source, k, d) for k, d in enumerate(G.select(entities)))
    return f"""span AS ({parts}),
picked AS (SELECT doc_id, line_no, list_reduce(list_transform(l, lambda e: [e]), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda c: x[1].st < c.en AND c.st < x[1].en)) > 0 THEN acc ELSE list_concat(acc, x) END) AS es
  FROM (SELECT doc_id, line_no, list({{'st': st, 'en': st + length(value), 'entity_type': entity_type, 'score': score, 'value': value}}
      ORDER BY det, -score, -length(value), st, ordinal) AS l FROM span GROUP BY doc_id, line_no)),
ent AS (SELECT doc_id, line_no, CAST(e.st AS BIGINT) AS st, CAST(e.en AS BIGINT) AS en, e.entity_type AS entity_type, e.score AS score, e.value AS value
  FROM (SELECT doc_id, line_no, unnest(es) AS e FROM picked))"""


def _placed(source: str, entities: list[str] | None) -> str:
    return f"""{_resolved(source, entities)},
off AS (SELECT doc_id, line_no, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM {source}),
placed AS (SELECT doc_id, line_no, entity_type, o + st AS s, o + en AS e, score, value, st, en FROM ent JOIN off USING (doc_id, line_no))"""


def _prefix(own: dict[str, str]) -> str:
    return "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (G.PREFIX | own).items()) + " ELSE entity_type END"


def _key(mask: str = "CAST(NULL AS VARCHAR)", **own: str) -> str:
    return f"""val AS (SELECT doc_id, entity_type, value, min({{'s': s, 'e': e}}) AS first, count(*) AS occurrences, {mask} AS mask, {_prefix(own)} AS prefix FROM placed GROUP BY doc_id, entity_type, value),
key AS (SELECT doc_id, entity_type, value, first, occurrences,
  coalesce(mask, '[' || prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY mask IS NOT NULL, first.s, first.e, entity_type, value) || ']') AS token FROM val)"""


_CASES = ["US_SSN", "US_DOB", "US_COURT_DOCKET", "US_BANK_ROUTING", "US_EIN", "US_BAR_NUMBER"]
_CASE_LINES = f"""built AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS k, o_orderdate AS day,
    lpad(CAST((CAST(o_orderkey AS BIGINT) * 7919 * 101) % 1000000000 AS VARCHAR), 9, '0') AS d FROM orders),
line AS (SELECT doc_id, CAST(k * 3 + i AS INTEGER) AS line_no, CASE i
    WHEN 0 THEN 'Plaintiff SSN ' || {_SSN} || ', DOB ' || strftime(day, '%m/%d/%Y') || '.'
    WHEN 1 THEN 'Case No. 1:' || strftime(day, '%y') || '-cv-' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || '; routing ' || d
    ELSE 'Employer EIN ' || {_EIN} || ', Bar No. ' || substr(d, 1, 7) END AS text
  FROM built, (VALUES (0), (1), (2)) AS t(i))"""
_BASE = f"WITH {_LINES}, {_placed('line', None)}"


def _rewritten(token: str, gap: str = "{}") -> str:
    """CTE ``part``: the pieces of lines with an entity, and the place after the last one."""
    return f"""lagged AS (SELECT *, coalesce(lag(en) OVER (PARTITION BY doc_id, line_no ORDER BY st), 0) AS prev FROM {token}),
part AS (SELECT doc_id, line_no, string_agg({gap.format("substr(text, CAST(prev + 1 AS INTEGER), CAST(st - prev AS INTEGER))")} || token, '' ORDER BY st) AS head, max(en) AS en
  FROM lagged JOIN line USING (doc_id, line_no) GROUP BY doc_id, line_no)"""


_IDENTITY_LINES = """made AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, lpad(CAST((CAST(c_custkey AS BIGINT) * 7919 * 101) % 1000000000 AS VARCHAR), 9, '0') AS d,
    DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS day FROM customer),
line AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, CASE i
    WHEN 0 THEN 'Born ' || strftime(day, '%B %-d, %Y')
    WHEN 1 THEN 'Date of birth: ' || strftime(day, '%-d %b %Y') || '.'
    WHEN 2 THEN 'IBAN ' || CASE WHEN doc_id % 3 = 1 THEN 'GB33BUKB20201555555555' ELSE 'GB33BUKB2020155555' || substr(d, 1, 4) END
    WHEN 3 THEN 'Account ' || d || '; passport no. A' || substr(d, 1, 8)
    WHEN 4 THEN 'ITIN 9' || substr(d, 1, 2) || '-7' || substr(d, 3, 1) || '-' || substr(d, 4, 4)
    WHEN 5 THEN 'Driver license K' || d || ' at https://x.example/' || d
    WHEN 6 THEN 'Bitcoin wallet 1' || replace(d || d || d, '0', 'x')
    ELSE 'Call 212-555-' || substr(d, 1, 4) || ' or (212) 555-' || substr(d, 5, 4) END AS text
  FROM made, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS t(i))"""
_REC = f"""{_NUM},
ex AS (SELECT 'LOCATION' AS t, n_name AS v FROM nation UNION ALL SELECT 'US_SSN', {_SSN} FROM num),
de AS (SELECT 'GPE' AS t, CASE WHEN n_nationkey % 2 = 0 THEN '  ' || lower(n_name) || ' state ' ELSE reverse(n_name) END AS v FROM nation
  UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'US_SSN' ELSE 'US_EIN' END, CASE WHEN id % 3 = 0 THEN d ELSE d || '0' END FROM num),
exn AS (SELECT t, v, t = 'US_SSN' AS numeric, CASE WHEN t = 'US_SSN' THEN {_digits("v")} ELSE lower(trim(v)) END AS n FROM ex),
den AS (SELECT t, v, {_digits("v")} AS dg, lower(trim(v)) AS tx FROM de),
pair AS (SELECT DISTINCT exn.t, exn.v, den.t AS dt FROM exn JOIN den ON dg = n WHERE exn.numeric AND n <> ''
  UNION SELECT DISTINCT exn.t, exn.v, den.t FROM (SELECT * FROM exn WHERE NOT numeric) exn JOIN den ON (tx = n OR (length(tx) >= 4 AND length(n) >= 4 AND (contains(tx, n) OR contains(n, tx))))),
seen AS (SELECT t, v, true AS vh, bool_or(dt = t OR (t = 'LOCATION' AND dt = 'GPE')) AS th FROM pair GROUP BY t, v),
hit AS (SELECT t, v, n, coalesce(vh, false) AS vh, coalesce(th, false) AS th FROM (SELECT t, v, count(*) AS n FROM ex GROUP BY t, v) LEFT JOIN seen USING (t, v))"""
_RECALL = f"""s AS (SELECT coalesce(t, 'ALL') AS entity_type, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(CASE WHEN vh THEN n ELSE 0 END) AS BIGINT) AS value_hits, CAST(sum(CASE WHEN th THEN n ELSE 0 END) AS BIGINT) AS typed_hits FROM hit GROUP BY ROLLUP (t))"""


def _escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _simple() -> dict[str, str]:
    num = f"WITH {_NUM} SELECT id"
    out = {
        "lines": f"WITH {_LINES} SELECT doc_id, line_no, text FROM line",
        "global_offsets": f"WITH {_LINES} SELECT doc_id, line_no, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM line",
        "validate_ssn": f"{num}, {_SSN} AS value, {_ssn_ok(_SSN)} AS ok FROM num",
        "validate_ein": f"{num}, {_EIN} AS value, {_ein_ok(_EIN)} AS ok FROM num",
        "validate_aba": f"{num}, d AS value, {_aba_ok('d')} AS ok FROM num",
        "validate_luhn": f"WITH {_NUM}, x AS (SELECT id, '4111 11' || substr(d, 1, 2) || ' ' || substr(d, 3, 4) || ' 111' || substr(d, 9, 1) AS value FROM num) SELECT id, value, {_luhn_ok('value')} AS ok FROM x",
        "validate_iban": f"""WITH {_NUM}, x AS (SELECT id, CASE WHEN id % 50 = 1 THEN 'GB33BUKB20201555555555' ELSE 'GB33BUKB2020155555' || substr(d, 1, 4) END AS value FROM num)
SELECT id, value, CAST(replace(replace(replace(replace(substr(value, 5) || substr(value, 1, 4), 'B', '11'), 'U', '30'), 'K', '20'), 'G', '16') AS HUGEINT) % 97 = 1 AS ok FROM x""",
        "mask_ssn": f"{num}, {_SSN} AS value, 'XXX-XX-' || right(d, 4) AS mask FROM num",
        "mask_account": f"{num}, CASE WHEN substr(d, 9, 1) = '0' THEN 'A12' ELSE 'DE 44 ' || d END AS value, CASE WHEN substr(d, 9, 1) = '0' THEN '****' ELSE '****' || right(d, 4) END AS mask FROM num",
        "mask_birth_year": r"""SELECT id, value, nullif(regexp_extract(value, '\b(\d{4})\b', 1), '') AS mask
FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%-m-%-d-%y') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS value FROM orders)""",
        "mask_initials": "SELECT CAST(c_custkey AS BIGINT) AS id, c_name || '  ' || lower(c_mktsegment) || ' 9x' AS value, upper(substr(c_name, 1, 1)) || '.' || upper(substr(c_mktsegment, 1, 1)) || '.' AS mask FROM customer",
        "trim_spans": f"SELECT id, CAST(length(raw) - length(ltrim(raw, {_EDGE})) AS BIGINT) AS start, trim(raw, {_EDGE}) AS value FROM (SELECT CAST(c_custkey AS BIGINT) AS id, ' (\"' || c_name || '.' || c_mktsegment || '.\"), ' AS raw FROM customer)",
        "resolve_overlaps": """WITH x AS (SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS ordinal, CAST(l_partkey % 40 AS BIGINT) AS st, CAST(l_suppkey % 9 + 1 AS BIGINT) AS n, l_partkey % 2 AS det, l_suppkey % 5 AS s FROM lineitem),
p AS (SELECT id, list_reduce(list_transform(l, lambda e: [e]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: x[1].st < c.en AND c.st < x[1].en)) > 0 THEN acc ELSE list_concat(acc, x) END) AS es
  FROM (SELECT id, list({'st': st, 'en': st + n, 'ordinal': ordinal} ORDER BY det, -s, -n, st, ordinal, st + n) AS l FROM x GROUP BY id))
SELECT id, e.st AS start, e.en AS "end", e.ordinal AS ordinal FROM (SELECT id, unnest(es) AS e FROM p)""",
        "find_runs": f"""WITH {_NUM}, v AS (SELECT id AS doc_id, {_SSN} AS value FROM num)
SELECT doc_id, value, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, CAST(10 * a AS DOUBLE) AS x0, CAST(72 AS DOUBLE) AS y0, CAST(10 * b + 9 AS DOUBLE) AS x1, CAST(84 AS DOUBLE) AS y1
FROM (SELECT doc_id, value, a, b FROM v, (VALUES (1, 3), (6, 6)) AS t(a, b) UNION ALL SELECT doc_id, 'seen', 4, 4 FROM v)""",
        "run_counts": f"WITH {_NUM} SELECT id AS doc_id, {_SSN} AS value, CAST(2 AS BIGINT) AS n_runs FROM num UNION ALL SELECT id, 'seen', 1 FROM num UNION ALL SELECT id, 'unseen', 0 FROM num",
        "recall_by_type": f"WITH {_REC}, {_RECALL} SELECT *, CAST(value_hits AS DOUBLE) / expected AS value_recall, CAST(typed_hits AS DOUBLE) / expected AS typed_recall FROM s",
        "recall_report": f"WITH {_REC}, {_RECALL} SELECT entity_type, expected, value_hits, typed_hits, printf('%.2f', CAST(value_hits AS DOUBLE) / expected) AS value_recall, printf('%.2f', CAST(typed_hits AS DOUBLE) / expected) AS typed_recall FROM s",
        "missed_labels": f"WITH {_REC} SELECT t AS entity_type, v AS value, n FROM hit WHERE NOT vh",
        "precision": f"""WITH {_REC}, digits AS (SELECT DISTINCT n AS dg FROM exn WHERE numeric AND n <> ''), texts AS (SELECT DISTINCT n FROM exn WHERE NOT numeric),
near AS (SELECT DISTINCT tx FROM den JOIN texts ON tx = n OR (length(tx) >= 4 AND length(n) >= 4 AND (contains(tx, n) OR contains(n, tx)))),
ok AS (SELECT dg IN (SELECT dg FROM digits) OR tx IN (SELECT tx FROM near) AS hit FROM den)
SELECT count(*) AS detected, count(*) FILTER (hit) AS true_hits, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS "precision" FROM ok""",
        "evaluate_cases": f"""WITH {_CASE_LINES}, {_resolved("line", _CASES)},
num AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, lpad(CAST((CAST(o_orderkey AS BIGINT) * 7919 * 101) % 1000000000 AS VARCHAR), 9, '0') AS d FROM orders),
ex AS (SELECT doc_id, 'US_SSN' AS t, {_SSN} AS v, d AS n FROM num UNION ALL SELECT doc_id, 'US_EIN', {_EIN}, d FROM num UNION ALL SELECT doc_id, 'US_BANK_NUMBER', reverse(d), reverse(d) FROM num),
seen AS (SELECT DISTINCT doc_id, {_digits("value")} AS n FROM ent), typed AS (SELECT DISTINCT doc_id, {_digits("value")} AS n, entity_type AS t FROM ent),
hit AS (SELECT t, count(*) AS n, (doc_id, n) IN (SELECT (doc_id, n) FROM seen) AS vh, (doc_id, n, t) IN (SELECT (doc_id, n, t) FROM typed) AS th FROM ex GROUP BY ALL), {_RECALL}
SELECT *, CAST(value_hits AS DOUBLE) / expected AS value_recall, CAST(typed_hits AS DOUBLE) / expected AS typed_recall FROM s""",
        "detect_identities": f'WITH {_IDENTITY_LINES}, {_resolved("line", None)} SELECT doc_id, line_no, entity_type, st AS start, en AS "end", score, value FROM ent',
        "placeholder_cases": f"""WITH {_CASE_LINES}, {_placed("line", _CASES)}, {_key(US_SSN="TAXPAYER", US_DOB="BIRTH")} SELECT doc_id, token AS placeholder, entity_type, value AS original_value, occurrences FROM key""",
        "policy_masks": """WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, lpad(CAST((CAST(c_custkey AS BIGINT) * 7919) % 100000000 AS VARCHAR), 8, '0') AS d, c_name, c_mktsegment FROM customer)
SELECT id, 'US_SSN' AS entity_type, d AS value, 'XXX-XX-' || right(d, 4) AS mask FROM c UNION ALL SELECT id, 'US_ITIN', '9' || d, 'XXX-XX-' || right(d, 4) FROM c
UNION ALL SELECT id, 'CREDIT_CARD', '4111 1111 ' || d, '****' || right(d, 4) FROM c UNION ALL SELECT id, 'IBAN_CODE', 'GB33BUKB' || d, '****' || right(d, 4) FROM c
UNION ALL SELECT id, 'US_BANK_NUMBER', substr(d, 1, 3), '****' FROM c UNION ALL SELECT id, 'LOCATION', c_mktsegment, '[ADDRESS_REDACTED]' FROM c UNION ALL SELECT id, 'GPE', c_name, '[ADDRESS_REDACTED]' FROM c
UNION ALL SELECT id, 'PERSON_MINOR', c_name || ' ' || c_mktsegment, upper(substr(c_name, 1, 1)) || '.' || upper(substr(c_mktsegment, 1, 1)) || '.' FROM c
UNION ALL SELECT id, 'US_DOB', '1/2/' || substr(d, 1, 4), substr(d, 1, 4) FROM c UNION ALL SELECT id, 'ORG', c_name, NULL FROM c""",
        "splice_overlaps": """WITH x AS (SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_partkey % 50 AS INTEGER) AS st, CAST(l_partkey % 50 + l_suppkey % 9 + 1 AS INTEGER) AS en, '[' || CAST(l_linenumber AS VARCHAR) || ']' AS tok FROM lineitem),
t AS (SELECT id, rpad(CAST(id AS VARCHAR), 60, 'abcdefghij') AS text, list({'out': '', 'at': 60, 'st': st, 'en': en, 'tok': tok, 'text': rpad(CAST(id AS VARCHAR), 60, 'abcdefghij')} ORDER BY st DESC, en, tok) AS l FROM x GROUP BY id),
r AS (SELECT id, text, list_reduce(list_prepend({'out': '', 'at': 60, 'st': 0, 'en': 0, 'tok': '', 'text': text}, l), lambda a, s: CASE WHEN s.en <= a.at
  THEN {'out': s.tok || substr(s.text, s.en + 1, a.at - s.en) || a.out, 'at': s.st, 'st': s.st, 'en': s.en, 'tok': s.tok, 'text': s.text} ELSE a END) AS a FROM t)
SELECT id, substr(text, 1, a.at) || a.out AS text FROM r""",
        "detect_cases": f'WITH {_CASE_LINES}, {_resolved("line", _CASES)} SELECT doc_id, line_no, entity_type, st AS start, en AS "end", score, value FROM ent',
        "document_entities": f'{_BASE} SELECT doc_id, line_no, entity_type, s AS start, e AS "end", score, value FROM placed',
        "placeholder_key": f"{_BASE}, {_key()} SELECT doc_id, token AS placeholder, entity_type, value AS original_value, occurrences, first.s AS first_start FROM key",
        "counts_by_type": f"{_BASE}, {_key()} SELECT doc_id, entity_type, count(*) AS n_values FROM key GROUP BY doc_id, entity_type",
        "totals": f"{_BASE}, {_key()} SELECT doc_id, count(*) AS n_values FROM key GROUP BY doc_id",
        "chips": f"{_BASE}, {_key()} SELECT entity_type, count(*) AS n_values FROM key GROUP BY entity_type",
        "dictionary": """SELECT id AS doc_id, 'PERSON' AS entity_type, s AS start, s + length(v) AS "end", v AS value
FROM (SELECT CAST(c_custkey AS BIGINT) AS id, unnest([{'s': 6, 'v': c_name}, {'s': 21 + length(c_name) + length(c_mktsegment), 'v': 'Bank of the ' || c_name}, {'s': 33 + length(c_name) + length(c_mktsegment), 'v': c_name}], recursive := true) FROM customer)""",
        "key_csv": f"""{_BASE}, {_key()}, q AS (SELECT doc_id, first.s AS s, token, entity_type, token || ',' || entity_type || ',' || CASE WHEN regexp_matches(value, '[",]') THEN '"' || replace(value, '"', '""') || '"' ELSE value END || ',' || occurrences AS line FROM key)
SELECT doc_id, 'placeholder,entity_type,original_value,occurrences' || chr(13) || chr(10) || string_agg(line || chr(13) || chr(10), '' ORDER BY s, token, entity_type) AS csv FROM q GROUP BY doc_id""",
        "redaction_pairs": f"{_BASE}, {_key()} SELECT doc_id, value AS original_value, arg_min(token, {{'s': first.s, 'e': first.e, 't': entity_type}}) AS token, min(first.s) AS first_start FROM key GROUP BY doc_id, value",
        "anonymized_text": f"""{_BASE}, {_key()}, tok AS (SELECT placed.*, token FROM placed JOIN key USING (doc_id, entity_type, value)), {_rewritten("tok")}
SELECT doc_id, string_agg(coalesce(head || substr(text, CAST(en + 1 AS INTEGER)), text), chr(10) ORDER BY line_no) AS text FROM line LEFT JOIN part USING (doc_id, line_no) GROUP BY doc_id""",
        "reidentify": f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM line GROUP BY doc_id",
        "court_key": f"""WITH {_CASE_LINES}, {_placed("line", _CASES)},
{_key("CASE WHEN entity_type = 'US_SSN' THEN 'XXX-XX-' || right(" + _digits("value") + ", 4) WHEN entity_type = 'US_DOB' THEN nullif(regexp_extract(value, '" + chr(92) + "b(" + chr(92) + "d{4})" + chr(92) + "b', 1), '') END")}
SELECT doc_id, token AS placeholder, entity_type, value AS original_value, occurrences, count(*) OVER (PARTITION BY doc_id, token) > 1 AS is_ambiguous FROM key""",
    }
    types = dict.fromkeys(d.entity for d in G.DETECTORS)
    case = lambda f: "CASE entity_type " + " ".join(f"WHEN '{t}' THEN '{f(t)}'" for t in types) + " END"
    titles = case(lambda t: " ".join(w.capitalize() for w in t.removeprefix("US_").split("_")))
    mark = f"""'<mark style="background:' || {case(lambda t: COLOURS.get(t, OTHER))} || '" title="' || {titles} || ' ' || printf('%.2f', score) || '">' || {_escape("value")} || '</mark>'"""
    out["highlighted_html"] = f"""WITH {_LINES}, {_resolved("line", None)}, tok AS (SELECT *, {mark} AS token FROM ent), {_rewritten("tok", _escape("{}"))}
SELECT doc_id, line_no, coalesce(head || {_escape("substr(text, CAST(en + 1 AS INTEGER))")}, {_escape("text")}) AS html FROM line LEFT JOIN part USING (doc_id, line_no)"""
    out["anonymized_html"] = rf"""SELECT doc_id, regexp_replace({_escape("text")}, '(\[?[A-Z][A-Z_]*_\d+\]?|XXX-XX-[0-9X]{{4}}|\*{{4}}(?:\d{{4}})?|\[ADDRESS_REDACTED\])', '<mark>\1</mark>', 'g') AS html FROM ({out["anonymized_text"]})"""
    for name, entity in (("detect_email", "EMAIL_ADDRESS"), ("detect_phone", "PHONE_NUMBER"), ("detect_ip", "IP_ADDRESS"), ("detect_card_luhn", "CREDIT_CARD")):
        (d,) = G.select([entity])
        out[name] = f'WITH {_LINES}, span AS ({_detector("line", 0, d)}) SELECT doc_id, line_no, CAST(st AS BIGINT) AS start, CAST(st + length(value) AS BIGINT) AS "end", score, value FROM span'
    return out


SQL: dict[str, str] = _simple()
