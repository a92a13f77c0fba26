"""DuckDB SQL for the registered queries: written for that engine, on the same derived tables.

RE2 has no look-around, so patterns are in their RE2 form or are kept apart by conditions.
"""

from __future__ import annotations

from idweft.functions import patterns as P
from idweft.sources.cards import cards_sql

CARDS = f"WITH {cards_sql(duck=True)}"
TEXT = """WITH text_lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
text_rows AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS text FROM text_lines),
text_regions AS (SELECT doc_id, CAST(pos AS INT) AS region_idx, text, (50 + (doc_id * 7 + pos * 13) % 51) / CAST(100 AS DOUBLE) AS conf,
  0 AS x1, CAST(pos * 20 AS INT) AS y1, CAST(length(text) * 8 AS INT) AS x2, CAST(pos * 20 + 16 AS INT) AS y2 FROM text_rows)"""
DOCS = f"""{CARDS},
docs AS (SELECT doc_id, upper(string_agg(text, chr(10) ORDER BY region_idx)) AS t FROM card_regions WHERE text <> '' GROUP BY doc_id),
spaced AS (SELECT *, regexp_replace(t, '\\s+', '', 'g') AS ns FROM docs)"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_signatures = ", ".join(f"({q(d)}, {q(k)}, {q(''.join(k.split()))}, {w})" for d, k, w in P.SIGNATURES)
_epic = r"(^|[^A-Z0-9])([A-Z]{3}\d{7})([^A-Z0-9]|$)"
_legacy = rf"(?:DLF)?(?:{P.DL_STATES})[\s-]?\d{{12}}([^\d]|$)"
_masked = r"(^|[^A-Z0-9])[X×*•#]{4}[ \t]?[X×*•#]{4}[ \t]?(\d{4})([ \t]?[^\d \t]|[ \t]?$)"
_order = "CASE doc_type " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(P.DOC_TYPES)) + " END"
SCORES = f"""{DOCS},
signatures(doc_type, keyword, keyword_ns, weight) AS (VALUES {_signatures}),
points AS (
  SELECT doc_id, doc_type, weight AS w FROM spaced JOIN signatures ON contains(t, keyword) OR contains(ns, keyword_ns)
  UNION ALL SELECT doc_id, 'VOTER_ID', 50 FROM docs WHERE regexp_matches(t, {q(_epic)})
  UNION ALL SELECT doc_id, 'DRIVING_LICENSE', 60 FROM docs WHERE regexp_matches(t, {q(P.DL_MODERN)})
  UNION ALL SELECT doc_id, 'DRIVING_LICENSE', 60 FROM docs WHERE regexp_matches(t, {q(_legacy)})
  UNION ALL SELECT doc_id, 'PAN', 50 FROM docs WHERE regexp_matches(t, {q(P.PAN)})
  UNION ALL SELECT doc_id, 'AADHAAR', 50 FROM docs WHERE regexp_matches(regexp_replace(t, {q(_legacy)}, ' ', 'g'), {q(P.AADHAAR_RE2)}) OR regexp_matches(t, {q(_masked)}) OR regexp_matches(t, {q(r"(?m)^[^A-Z0-9a-z_X×*•#]*[X×*•#]{4}[ ]?[X×*•#]{4}$")})
  UNION ALL SELECT doc_id, 'AADHAAR', 30 FROM docs WHERE regexp_matches(t, {q(P.VID_LABEL)})
  UNION ALL SELECT doc_id, 'PASSPORT', 80 FROM docs WHERE regexp_matches(t, 'P<[A-Z]{{3}}') OR regexp_matches(t, 'P<<[A-Z]')
  UNION ALL SELECT doc_id, 'PASSPORT', 30 FROM docs WHERE regexp_matches(t, {q(rf"\b{P.PASSPORT}\b")})
  UNION ALL SELECT doc_id, d, 0 FROM docs, (VALUES ('PAN')) v(d)),
sums AS (SELECT doc_id, doc_type, sum(w) AS s FROM points GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, {_order}) AS rn FROM sums),
classes AS (SELECT doc_id, CASE WHEN s > 0 THEN doc_type ELSE 'UNKNOWN' END AS doc_type, CAST(s AS BIGINT) AS score FROM ranked WHERE rn = 1)"""
IDS = f"""{SCORES},
raw_ids AS (SELECT doc_id, doc_type, t, CASE doc_type
  WHEN 'PAN' THEN regexp_extract(t, {q(P.PAN)})
  WHEN 'AADHAAR' THEN regexp_extract(t, {q(P.AADHAAR_RE2)}, 1)
  WHEN 'VOTER_ID' THEN regexp_extract(t, {q(_epic)}, 2)
  WHEN 'PASSPORT' THEN regexp_extract(t, {q(P.PASSPORT)})
  WHEN 'DRIVING_LICENSE' THEN regexp_extract(t, {q(rf"({P.DL_MODERN}|(?:DLF)?(?:{P.DL_STATES})[\s-]?\d{{12}}|{P.VEHICLE})")}) ELSE '' END AS id FROM docs JOIN classes USING (doc_id)),
ids AS (SELECT doc_id, doc_type, t, nullif(trim(regexp_replace(id, '\\s+', ' ', 'g')), '') AS extracted_id FROM raw_ids)"""
MASK = """CASE WHEN doc_type = 'AADHAAR' THEN 'XXXX XXXX ' || right(regexp_replace(extracted_id, '[^0-9]', '', 'g'), 4)
  WHEN doc_type = 'PAN' THEN left(extracted_id, 2) || 'XXXXX' || right(extracted_id, 3)
  ELSE repeat('X', greatest(0, length(extracted_id) - 4)) || right(extracted_id, 4) END"""
OUTCOMES = "WITH outcomes AS (SELECT event_id AS doc_id, ts, CASE WHEN event_type = 'error' THEN [" + ", ".join(q(c) for c, _, _ in P.ERROR_CODES) + "][CAST(event_id % 8 + 1 AS INT)] END AS error_code, value AS elapsed_sec FROM events)"
_kinds = "['aadhaar', ' PAN ', 'voter_id', 'Passport', 'driving-license', 'visa', '']"
UPLOADS = f"WITH uploads AS (SELECT page_id AS doc_id, CAST(strlen(html) AS BIGINT) AS n_bytes, {_kinds}[CAST(page_id % 7 + 1 AS INT)] AS doc_type FROM pages)"
_types = ", ".join("(" + ", ".join(map(q, row)) + ")" for row in P.DOC_TYPE_ROWS)
_codes = ", ".join(f"({q(c)}, {s}, {str(r).lower()})" for c, s, r in P.ERROR_CODES)
TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_long = "|".join(sorted((s for s in P.SURNAMES if len(s) >= 5), key=lambda w: (-len(w), w)))
_all = "|".join(sorted(P.SURNAMES, key=lambda w: (-len(w), w)))
_dmy = r"(^|[^A-Za-z0-9_])(\d{1,2}/\d{1,2}/\d{4})([^A-Za-z0-9_]|$)"


def name(column: str) -> str:
    """A card's name with its parts told apart and in title case (names here are of plain capitals)."""
    token = f"CASE WHEN length(w) >= 5 AND regexp_full_match(w, '[A-Za-z]+') THEN regexp_replace(w, '(?i)^(?:(.)({_long})|(.{{2,}}?)({_all}))$', '\\1\\3 \\2\\4') ELSE w END"
    spaced = f"regexp_replace(trim(regexp_replace({column}, '\\s+', ' ', 'g')), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    joined = f"array_to_string(list_transform(string_split({spaced}, ' '), lambda w: {token}), ' ')"
    return TITLE.format(joined)


_pan_name = f"length(trim(text)) >= 3 AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, {q(P.PAN_LABELS)}) AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.85 * length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
PAN_NAMES = f"""{DOCS},
dates AS (SELECT doc_id, regexp_extract(t, {q(_dmy)}, 2) AS dob FROM docs),
lines AS (SELECT r.*, dob, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, region_idx) AS rn FROM card_regions r JOIN dates USING (doc_id)),
anchors AS (SELECT doc_id, min(rn) AS spot FROM lines WHERE dob <> '' AND contains(text, dob) GROUP BY doc_id),
above AS (SELECT l.*, row_number() OVER (PARTITION BY doc_id ORDER BY rn DESC) AS n FROM lines l JOIN anchors USING (doc_id) WHERE rn < spot AND {_pan_name}),
named AS (SELECT d.doc_id, d.dob, f.text AS father, f.conf AS father_conf, h.text AS holder, h.conf AS holder_conf FROM dates d LEFT JOIN above f ON f.doc_id = d.doc_id AND f.n = 1 LEFT JOIN above h ON h.doc_id = d.doc_id AND h.n = 2)"""
_pct = lambda c: f"CAST(round_even(coalesce({c}, 0) * 100, 0) AS INT)"
_holds = "contains(upper(regexp_replace(text, '\\s+', '', 'g')), upper(regexp_replace({0}, '\\s+', '', 'g')))"


def conf_of(value: str, table: str) -> str:
    """Confidence of the first line that holds a value of ``table`` (doc_id, value)."""
    return f"SELECT doc_id, arg_min(conf, region_idx) AS conf FROM {table} JOIN card_regions USING (doc_id) WHERE {value} <> '' AND {_holds.format(value)} GROUP BY doc_id"


PAN_SQL = f"""{PAN_NAMES},
pans AS (SELECT doc_id, regexp_extract(t, {q(P.PAN)}) AS pan FROM docs),
pan_conf AS ({conf_of("pan", "pans")}), dob_conf AS ({conf_of("dates.dob", "dates")}),
pan_rows AS (SELECT n.doc_id, pan AS pan_number, {_pct("p.conf")} AS pan_number_confidence, {name("coalesce(holder, '')")} AS full_name, {_pct("holder_conf")} AS full_name_confidence,
  {name("coalesce(father, '')")} AS father_name, {_pct("father_conf")} AS father_name_confidence, dob, {_pct("b.conf")} AS dob_confidence
  FROM named n JOIN pans USING (doc_id) LEFT JOIN pan_conf p ON p.doc_id = n.doc_id LEFT JOIN dob_conf b ON b.doc_id = n.doc_id)"""
HITS = f"""{IDS},
words AS (SELECT r.*, i.doc_type, regexp_replace(upper(r.text), '[^A-Z0-9]', '', 'g') AS word, regexp_replace(upper(coalesce(extracted_id, '')), '[^A-Z0-9]', '', 'g') AS clean FROM card_regions r JOIN ids i USING (doc_id)),
hits AS (SELECT *, length(word) AS n_chars FROM words WHERE word <> '' AND (
  CASE doc_type WHEN 'PAN' THEN regexp_matches(upper(text), {q(P.PAN)}) WHEN 'AADHAAR' THEN regexp_matches(upper(text), {q(P.AADHAAR_RE2)}) WHEN 'VOTER_ID' THEN regexp_matches(upper(text), {q(_epic)})
    WHEN 'PASSPORT' THEN regexp_matches(upper(text), {q(P.PASSPORT)}) WHEN 'DRIVING_LICENSE' THEN regexp_matches(upper(text), {q(f"{P.DL_MODERN}|{_legacy}|{P.VEHICLE}")}) ELSE false END
  OR (clean <> '' AND (contains(word, clean) OR (length(word) >= 6 AND contains(clean, word)) OR (doc_type = 'AADHAAR' AND length(word) >= 4 AND regexp_full_match(word, '[0-9]+') AND contains(clean, word))))))"""
BACKS = " + ".join(f"CAST(contains(ns, {q(k)}) AS INT)" for k in P.PASSPORT_BACK_KEYS)
_lists = "[' 4, 5 ,4', '', '0', '-1', 'a', '4,x', '1,2,3,4,5', '3', '1,,2']"
MASKED_LINE = f"""one AS (SELECT doc_id, arg_min(regexp_extract(text, {q(_masked)}, 2), region_idx) AS value, arg_min(conf, region_idx) AS conf FROM card_regions WHERE regexp_matches(text, {q(_masked)}) GROUP BY doc_id),
heads AS (SELECT * FROM card_regions WHERE regexp_full_match(text, 'XXXX ?XXXX')),
two AS (SELECT h.doc_id, arg_min(o.text, (h.region_idx, o.region_idx)) AS value, arg_min(least(h.conf, o.conf), (h.region_idx, o.region_idx)) AS conf FROM heads h JOIN card_regions o ON h.doc_id = o.doc_id AND h.region_idx <> o.region_idx
  WHERE regexp_full_match(trim(o.text), '[0-9]{{4}}') AND least(h.y2, o.y2) - greatest(h.y1, o.y1) >= 0.5 * least(greatest(h.y2 - h.y1, 1), o.y2 - o.y1) AND o.x1 BETWEEN h.x2 - greatest(h.y2 - h.y1, 1) AND h.x2 + 3 * greatest(h.y2 - h.y1, 1) GROUP BY h.doc_id)"""
ORIENT = """WITH {cards}, sums AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN x2 - x1 >= 1.5 * (y2 - y1) THEN x2 - x1 ELSE 0 END) AS wide, sum(CASE WHEN y2 - y1 >= 1.5 * (x2 - x1) THEN y2 - y1 ELSE 0 END) AS tall,
  sum(CASE WHEN x2 - x1 >= 1.5 * (y2 - y1) AND cls_label = '180' THEN x2 - x1 ELSE 0 END) AS turned FROM card_regions GROUP BY doc_id)
SELECT doc_id, CASE WHEN wide >= 3 * tall AND wide > 0 THEN 'wide' WHEN tall >= 3 * wide AND tall > 0 THEN 'tall' END AS direction,
  CAST(CASE WHEN n < 3 OR NOT (wide >= 3 * tall AND wide > 0) THEN NULL WHEN turned <= 0.3 * wide THEN 0 WHEN turned >= 0.7 * wide THEN 180 END AS INT) AS angle FROM sums"""

_redactions = (
    (r"([^0-9])[0-9]{4}(\s?)[0-9]{4}(\s?)[0-9]{4}(\s?)([0-9]{4})([^0-9])", r"\1XXXX\2XXXX\3XXXX\4\5\6"),
    (r"([^0-9 \t]|[^0-9][ \t])[0-9]{4}(\s?)[0-9]{4}(\s?)([0-9]{4})([^0-9 \t]|[ \t][^0-9])", r"\1XXXX\2XXXX\3\4\5"),
    (r"([^A-Z0-9])([A-Z]{2})[A-Z]{3}[0-9]{2}([0-9]{2}[A-Z])([^A-Z0-9])", r"\1\2XXXXX\3\4"),
    (r"([^A-Z0-9])[A-Z]{3}[0-9]{3}([0-9]{4})([^A-Z0-9])", r"\1XXXXXX\2\3"),
    (r"[A-Z]{2}([\s-]?)[0-9]{2}([\s-]?)[0-9]{7}([0-9]{4})([^0-9])", r"XX\1XX\2XXXXXXX\3\4"),
)


def _redaction() -> str:
    """Each rule twice: a match takes its neighbours with it, so of two in a row one is left."""
    t = "' ' || text || ' '"
    for rx, mask in _redactions:
        if rx.startswith("[A-Z]"):  # not after a letter or digit
            rx, mask = f"([^A-Z0-9]){rx}", r"\1" + "".join(c if not (c.isdigit() and mask[i - 1] == "\\") else str(int(c) + 1) for i, c in enumerate(mask))
        for _ in range(2):
            t = f"regexp_replace({t}, {q(rx)}, {q(mask)}, 'g')"
    return f"WITH r AS (SELECT doc_id, text, {t} AS t FROM documents) SELECT doc_id, t <> ' ' || text || ' ' AS redacted, sha256(t[2:length(t) - 1]) AS text_sha256 FROM r"


ORACLE_SQL = {
    "reading_order": f"{TEXT} SELECT doc_id, region_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, region_idx) AS INT) AS rn FROM text_regions",
    "document_confidence": f"{TEXT} SELECT doc_id, round(avg(CASE WHEN conf > 0 THEN conf END), 6) AS avg_confidence, count(*) AS n_regions FROM text_regions GROUP BY doc_id",
    "gate_split": f"{TEXT} SELECT doc_id, count(*) FILTER (conf >= 0.7) AS n_kept, count(*) FILTER (conf < 0.7) AS n_dropped FROM text_regions GROUP BY doc_id",
    "weak_regions": f"{TEXT} SELECT doc_id, region_idx, conf FROM text_regions WHERE conf < 0.75",
    "valid_regions": f"{TEXT} SELECT doc_id, region_idx FROM text_regions WHERE (x2 - x1) * (y2 - y1) > 0",
    "accept_recovered": f"{TEXT} SELECT doc_id, region_idx, CAST(length(trim(text)) AS INT) AS n_chars FROM text_regions WHERE conf >= 0.9 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')",
    "drop_duplicate_pin_lines": f"{CARDS}, pins AS (SELECT *, regexp_extract(text, '(^|[^A-Za-z0-9_])([0-9]{{6}})([^A-Za-z0-9_]|$)', 2) AS pin, regexp_matches(text, '[A-Za-z]{{3,}}') AS worded FROM card_regions) SELECT doc_id, region_idx FROM pins p WHERE worded OR NOT EXISTS (SELECT 1 FROM pins w WHERE w.doc_id = p.doc_id AND w.worded AND w.pin <> '' AND w.pin = p.pin)",
    "uncovered_boxes": f"""{CARDS}, moved AS (SELECT doc_id, region_idx, x1 + region_idx * 9 % 40 AS x1, x2, y1 - 45 + region_idx % 3 * 8 AS y1 FROM card_regions WHERE conf < 0.75),
dropped AS (SELECT *, y1 + 24 AS y2 FROM moved), kept AS (SELECT * FROM card_regions WHERE conf >= 0.75)
SELECT doc_id, region_idx FROM dropped d WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = d.doc_id AND (
  (CAST(trunc((d.x1 + d.x2) / 2) AS INT) BETWEEN k.x1 AND k.x2 AND CAST(trunc((d.y1 + d.y2) / 2) AS INT) BETWEEN k.y1 AND k.y2)
  OR greatest(0, least(d.x2, k.x2) - greatest(d.x1, k.x1)) * greatest(0, least(d.y2, k.y2) - greatest(d.y1, k.y1)) >= 0.4 * greatest(1, (d.x2 - d.x1) * (d.y2 - d.y1))))""",
    "add_recovered": f"{CARDS}, top AS (SELECT doc_id, max(region_idx) FILTER (conf >= 0.7) AS m FROM card_regions GROUP BY doc_id) SELECT doc_id, CAST(region_idx AS INT) AS region_idx, text FROM card_regions WHERE conf >= 0.7 UNION ALL SELECT doc_id, CAST(coalesce(m, -1) + row_number() OVER (PARTITION BY doc_id ORDER BY region_idx) AS INT), text FROM card_regions JOIN top USING (doc_id) WHERE conf < 0.7",
    "apply_fallback": f"{CARDS} SELECT doc_id, region_idx, CASE WHEN better THEN lower(text) ELSE text END AS text, round(CASE WHEN better THEN conf + (doc_id % 3 - 1) * 0.25 ELSE conf END, 6) AS conf, CASE WHEN better THEN 'surya' ELSE engine END AS engine FROM (SELECT *, conf < 0.75 AND region_idx % 3 <> 0 AND conf + (doc_id % 3 - 1) * CAST(0.25 AS DOUBLE) >= conf AS better FROM card_regions)",
    "orientation_vote": ORIENT.format(cards=cards_sql(duck=True)),
    "orientation_score": f"{CARDS}, sums AS (SELECT doc_id, count(*) FILTER (x2 - x1 > y2 - y1) * avg(conf) * sum(length(text)) AS a, count(*) FILTER (x1 + 24 - x1 > 200) * avg(conf) * sum(length(text)) AS b FROM card_regions GROUP BY doc_id) SELECT doc_id, CAST(CASE WHEN a >= b THEN 0 ELSE 90 END AS INT) AS angle, round(greatest(a, b), 4) AS orientation_score FROM sums",
    "first_match": f"{TEXT}, hits AS (SELECT doc_id, region_idx, conf, regexp_extract(text, '\\b\\d{{4,}}\\b') AS value FROM text_regions WHERE regexp_matches(text, '\\b\\d{{4,}}\\b')) SELECT doc_id, arg_min(value, region_idx) AS value, arg_min(conf, region_idx) AS conf FROM hits GROUP BY doc_id",
    "admit_uploads": f"{UPLOADS} SELECT doc_id, n_bytes, CASE WHEN n_bytes = 0 OR n_bytes > 3000 THEN 'invalid_upload' END AS error_code, CAST(CASE WHEN n_bytes = 0 THEN 400 WHEN n_bytes > 3000 THEN 413 ELSE 200 END AS INT) AS status_code FROM uploads",
    "doc_type_lookup": f"{UPLOADS}, kinds(k, internal_type, display_name, id_field) AS (VALUES {_types}) SELECT doc_id, internal_type, display_name, id_field, CASE WHEN internal_type IS NULL THEN 'invalid_upload' END AS error_code FROM uploads LEFT JOIN kinds ON k = replace(lower(trim(doc_type)), '_', '-')",
    "page_requests": f"""WITH requests AS (SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN 'scan.png' ELSE 'scan.PDF' END AS file_name, {_lists}[CAST(page_id % 9 + 1 AS INT)] AS p, page_id % 6 AS page_count FROM pages),
parts AS (SELECT *, list_filter(list_transform(string_split(p, ','), lambda x: trim(x)), lambda x: x <> '') AS xs FROM requests),
checked AS (SELECT *, len(xs) = 0 OR len(list_filter(xs, lambda x: NOT regexp_full_match(x, '0*[1-9][0-9]*'))) > 0 OR len(list_distinct(xs)) > 4 AS bad FROM parts),
rows AS (SELECT doc_id, file_name, page_count, bad, 0 AS request_no, NULL::INT AS page FROM checked WHERE bad
  UNION ALL SELECT doc_id, file_name, page_count, bad, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS INT), page FROM (SELECT doc_id, file_name, page_count, bad, CAST(x AS INT) AS page, min(i) AS spot FROM (SELECT *, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM checked WHERE NOT bad) GROUP BY ALL))
SELECT doc_id, CAST(request_no AS INT) AS request_no, page, CASE WHEN bad OR file_name = 'scan.png' OR page > page_count THEN 'invalid_upload' END AS error_code, CAST(CASE WHEN file_name = 'scan.png' THEN 415 WHEN bad OR page > page_count THEN 400 ELSE 200 END AS INT) AS status_code FROM rows""",
    "page_lines": f"{TEXT} SELECT doc_id, region_idx AS line_no, round_even(conf / 3, 4) AS confidence, x2 FROM text_regions WHERE trim(text) <> ''",
    "classify_documents": f"{SCORES} SELECT doc_id, doc_type, score FROM classes",
    "extract_id": f"{IDS} SELECT doc_id, doc_type, extracted_id FROM ids",
    "masked_id": f"{IDS} SELECT doc_id, doc_type, extracted_id, {MASK} AS masked_id FROM ids",
    "route_side": f"{SCORES} SELECT doc_id, doc_type, CASE WHEN doc_type = 'PASSPORT' THEN CASE WHEN {BACKS} >= 2 THEN 'back' ELSE 'front' END WHEN doc_type = 'VOTER_ID' THEN CASE WHEN contains(t, 'ADDRESS') AND NOT regexp_matches(replace(t, 'ELECTORAL', ''), 'ELECTOR|EPIC|PHOTO\\s*IDENTITY') THEN 'back' ELSE 'front' END ELSE '' END AS side FROM classes JOIN spaced USING (doc_id)",
    "type_mismatch": f"{SCORES} SELECT doc_id, c.doc_type AS intended, s.doc_type AS actual, CASE WHEN c.doc_type <> s.doc_type THEN 'document_mismatch' END AS error_code FROM classes s JOIN cards c ON c.k = s.doc_id",
    "id_hits": f"{HITS} SELECT doc_id, region_idx, CAST(n_chars AS INT) AS n_chars, doc_type FROM hits",
    "merge_gap": f"{HITS}, tall AS (SELECT doc_id, any_value(doc_type) AS doc_type, list_sort(list(y2 - y1)) AS h FROM hits GROUP BY doc_id) SELECT doc_id, CAST(CASE WHEN doc_type = 'AADHAAR' THEN greatest(22, floor(h[len(h) // 2 + 1] * CAST(1.2 AS DOUBLE))) ELSE 22 END AS INT) AS gap FROM tall",
    "masked_id_find": f"{CARDS}, {MASKED_LINE} SELECT * FROM one UNION ALL SELECT * FROM two WHERE doc_id NOT IN (SELECT doc_id FROM one)",
    "names_above_dob": f"{PAN_NAMES} SELECT doc_id, {name(chr(99) + 'oalesce(holder, ' + chr(39) * 2 + ')')} AS full_name, {name(chr(99) + 'oalesce(father, ' + chr(39) * 2 + ')')} AS father_name FROM named",
    "extract_pan": f"{PAN_SQL} SELECT * FROM pan_rows",
    "confidence_lookup": f"{IDS}, got AS ({conf_of('extracted_id', 'ids')}) SELECT doc_id, extracted_id AS value, coalesce(conf, 0.0) AS conf FROM ids LEFT JOIN got USING (doc_id)",
    "mrz_fields": f"""{DOCS}, mrz AS (SELECT doc_id, text AS line1 FROM card_regions WHERE regexp_matches(text, '^P[A-Z<]') AND contains(text, '<<') AND length(text) >= 28),
two AS (SELECT doc_id, text AS line2 FROM card_regions WHERE regexp_matches(text, '^[A-Z]{{1,2}}\\d{{6,7}}') AND length(text) >= 28),
parts AS (SELECT doc_id, line1, line2, string_split(substr(line1, 6), '<<') AS p, regexp_extract(line2, '([A-Z]{{3}})(\\d{{6}})\\d?([MF<])(\\d{{6}})', 2) AS b, regexp_extract(line2, '([A-Z]{{3}})(\\d{{6}})\\d?([MF<])(\\d{{6}})', 3) AS sex, regexp_extract(line2, '([A-Z]{{3}})(\\d{{6}})\\d?([MF<])(\\d{{6}})', 4) AS e FROM mrz JOIN two USING (doc_id))
SELECT doc_id, line1, line2, 'P' AS type_of_passport, substr(line1, 3, 3) AS country, {TITLE.format("p[1]")} AS surname, {TITLE.format("p[2]")} AS given_name, regexp_extract(line2, '^[A-Z]{{1,2}}\\d{{6,7}}') AS passport_num,
  b[5:6] || '/' || b[3:4] || '/' || CASE WHEN b[1:2] <= '30' THEN '20' ELSE '19' END || b[1:2] AS dob, sex, e[5:6] || '/' || e[3:4] || '/20' || e[1:2] AS doe FROM parts""",
    "outcome_report": f"{OUTCOMES} SELECT coalesce(error_code, '') AS error_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(elapsed_sec), 6) AS mean_sec, quantile_disc(elapsed_sec, 0.5) AS p50_sec, quantile_disc(elapsed_sec, 0.95) AS p95_sec, max(elapsed_sec) AS max_sec FROM outcomes GROUP BY 1",
    "error_status": f"{OUTCOMES}, codes(error_code, http_status, retryable) AS (VALUES {_codes}) SELECT doc_id, o.error_code, CAST(coalesce(http_status, 200) AS INT) AS http_status, coalesce(retryable, false) AS retryable FROM outcomes o LEFT JOIN codes USING (error_code)",
    "outcome_windows": f"{OUTCOMES} SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(error_code) AS n_failed, count(*) FILTER (error_code = 'timeout') AS n_timeouts, round(count(error_code) / count(*), 6) AS failure_rate FROM outcomes GROUP BY 1",
    "value_after": f"{CARDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, region_idx) AS rn FROM card_regions), a AS (SELECT doc_id, min(rn) AS spot FROM o WHERE regexp_matches(text, '(?i)OLD\\s*PASSPORT') GROUP BY doc_id) SELECT doc_id, trim(text) AS value, conf FROM o JOIN a USING (doc_id) WHERE rn = spot + 1 AND NOT regexp_matches(text, {q(P.PASSPORT_LABELS)})",
    "redact_text": _redaction(),
    "identity_groups": f"{DOCS}, numbers AS (SELECT doc_id, regexp_replace(regexp_extract(t, {q(P.AADHAAR_RE2)}, 1), '\\s+', '', 'g') AS number FROM docs) SELECT sha256(number) AS uniqueness_id, count(*) AS n_docs, min(doc_id) AS first_doc_id FROM numbers WHERE number <> '' GROUP BY 1",
    "passport_address": f"""{CARDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, region_idx) AS rn FROM card_regions),
starts AS (SELECT doc_id, min(rn) AS spot FROM o WHERE regexp_matches(text, '(?i)ADDRESS') GROUP BY doc_id),
under AS (SELECT o.*, sum(CAST(regexp_matches(text, {q(P.PASSPORT_ADDRESS_STOP)}) AS INT)) OVER (PARTITION BY doc_id ORDER BY rn) AS stops FROM o JOIN starts USING (doc_id) WHERE rn > spot),
blocks AS (SELECT doc_id, string_agg(trim(text), ', ' ORDER BY rn) AS address, avg(conf) AS conf FROM under WHERE stops = 0 GROUP BY doc_id)
SELECT doc_id, address, round(conf, 6) AS conf, regexp_extract(address, {q(r"(?:PIN[:\s]*|\b)([0-9]{6})\b")}, 1) AS pin, coalesce(list_filter([{", ".join(q(x) for x in P.PASSPORT_STATES)}], lambda x: contains(upper(address), x))[1], '') AS state FROM blocks""",
    "unlabelled_block": f"""{DOCS}, keys AS (SELECT doc_id, regexp_extract(t, {q(rf"((?:DLF)?(?:{P.DL_STATES})[\s-]?[0-9]{{12}})(?:[^0-9]|$)")}, 1) AS key FROM docs),
anchors AS (SELECT r.* FROM card_regions r JOIN keys USING (doc_id) WHERE key <> '' AND contains(regexp_replace(upper(text), '[^A-Z0-9]', '', 'g'), key)),
col AS (SELECT r.*, coalesce(lag(r.y2) OVER (PARTITION BY r.doc_id ORDER BY r.y1, r.x1), a.y2) AS y0, a.y2 - a.y1 AS h FROM card_regions r JOIN anchors a USING (doc_id) WHERE r.region_idx <> a.region_idx AND abs(r.x1 - a.x1) <= greatest(1.5 * (a.y2 - a.y1), 0.12 * (a.x2 - a.x1)) AND r.y1 >= a.y1 + 0.5 * (a.y2 - a.y1)),
walk AS (SELECT *, sum(CAST(y1 - y0 > 1.5 * h OR regexp_matches(text, {q(P.DL_ADDRESS_STOP)}) OR regexp_matches(text, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}') AS INT)) OVER (PARTITION BY doc_id ORDER BY y1, x1) AS stops FROM col)
SELECT doc_id, string_agg(text, ' | ' ORDER BY y1, x1) AS texts FROM walk WHERE stops = 0 GROUP BY doc_id""",
    "address_span": f"""{DOCS}, numbers AS (SELECT doc_id, regexp_replace(regexp_extract(t, {q(P.AADHAAR_RE2)}, 1), '[^0-9]', '', 'g') AS number FROM docs),
o AS (SELECT r.*, number, regexp_replace(text, '[^0-9]', '', 'g') AS digits, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, region_idx) AS rn FROM card_regions r JOIN numbers USING (doc_id)),
starts AS (SELECT doc_id, min(rn) AS spot FROM o WHERE regexp_matches(text, {q(P.ADDRESS_LABEL)}) GROUP BY doc_id),
labels AS (SELECT o.*, trim(regexp_replace(regexp_extract(text, {q("(?i)(?:A[D0O]{1,2}R[A-Z]*S{1,2})(.*)$")}, 1), '^[\\s:.)-]*', '')) AS tail FROM o JOIN starts ON o.doc_id = starts.doc_id AND rn = spot),
same AS (SELECT o.*, length(o.digits) >= 11 OR (o.number <> '' AND contains(o.digits, o.number)) OR regexp_matches(o.text, {q(P.ADDRESS_FOOTER)}) AS stop, regexp_matches(o.text, '\\b[0-9]{{6}}\\b') AS pin FROM o JOIN labels l ON o.doc_id = l.doc_id AND o.rn > l.rn AND o.x1 BETWEEN l.x1 - 2 * (l.y2 - l.y1) AND l.x1 + 6 * (l.y2 - l.y1)),
walk AS (SELECT *, sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY rn) AS stops, coalesce(sum(CAST(pin AS INT)) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pins FROM same),
parts AS (SELECT doc_id, rn, text, conf FROM walk WHERE stops = 0 AND pins = 0 UNION ALL SELECT doc_id, rn, tail, conf FROM labels WHERE tail <> '')
SELECT doc_id, string_agg(text, ' | ' ORDER BY rn) AS parts, round(avg(conf), 6) AS conf FROM parts GROUP BY doc_id""",
    "gender_after_label": f"""{CARDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, region_idx) AS rn FROM card_regions),
n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY rn) AS next_text, lead(conf) OVER (PARTITION BY doc_id ORDER BY rn) AS next_conf, upper(regexp_extract(text, '(?i)(?:GEND[EO]R|SEX)(.*)', 1)) AS tail FROM o),
g AS (SELECT doc_id, rn, CASE WHEN contains(tail, 'TRANS') THEN 'T' WHEN regexp_matches(tail, 'F[E3]MA[LI1|]?E') THEN 'F' WHEN regexp_matches(tail, 'MA[LI1|]?E') THEN 'M' ELSE '' END AS own, CASE WHEN contains(upper(next_text), 'TRANS') THEN 'T' WHEN regexp_matches(upper(next_text), 'F[E3]MA[LI1|]?E') THEN 'F' WHEN regexp_matches(upper(next_text), 'MA[LI1|]?E') THEN 'M' ELSE '' END AS other, conf, next_conf FROM n WHERE regexp_matches(text, '(?i)(?:GEND[EO]R|SEX)'))
SELECT doc_id, arg_min(CASE WHEN own <> '' THEN own ELSE other END, rn) AS value, arg_min(CASE WHEN own <> '' THEN conf ELSE next_conf END, rn) AS conf FROM g WHERE own <> '' OR other <> '' GROUP BY doc_id""",
    "label_value_pairs": f"""{CARDS}, hit AS (SELECT doc_id, min(region_idx) AS i FROM card_regions WHERE regexp_matches(text, {q(P.DL_BLOOD)}) GROUP BY doc_id),
l AS (SELECT r.*, regexp_replace(regexp_replace(text, '(?i)^.*?(?:BLOOD\\s*GRP|BLOOD\\s*GROUP|\\bBG\\b)', ''), '^[ :./-]+|[ :./-]+$', '', 'g') AS tail FROM card_regions r JOIN hit ON r.doc_id = hit.doc_id AND region_idx = i),
c AS (SELECT l.doc_id, o.text, o.conf, row_number() OVER (PARTITION BY l.doc_id ORDER BY abs((o.y1 + o.y2) / 2 - (l.y1 + l.y2) / 2), o.region_idx) AS n FROM l JOIN card_regions o ON o.doc_id = l.doc_id AND o.region_idx <> l.region_idx AND o.x1 + o.x2 > l.x1 + l.x2 AND abs((o.y1 + o.y2) / 2 - (l.y1 + l.y2) / 2) <= greatest(1.6 * (l.y2 - l.y1), 50)
  WHERE regexp_matches(trim(o.text), '(?i)^(?:(?:AB|A|B|O)\\s*[+-]|NOT|NIL)'))
SELECT l.doc_id, CASE WHEN tail <> '' THEN tail ELSE c.text END AS value, CASE WHEN tail <> '' THEN l.conf ELSE c.conf END AS conf FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.n = 1 WHERE tail <> '' OR c.text IS NOT NULL""",
    "contract_json": f"""{PAN_SQL} SELECT doc_id, '{{"data":{{"ocr_fields":[{{"document_type":"pan","pan_number":{{"value":"' || pan_number || '","confidence":' || pan_number_confidence || '}},"full_name":{{"value":"' || full_name || '","confidence":' || full_name_confidence || '}},"father_name":{{"value":"' || father_name || '","confidence":' || father_name_confidence || '}},"dob":{{"value":"' || dob || '","confidence":' || dob_confidence || '}}}}]}},"status_code":200,"message_code":"success","message":null,"success":true}}' AS json FROM pan_rows""",
}
