"""DuckDB SQL for the extraction jobs and what they are made of; see :mod:`idweft.plans.oracles`.

Every rule is written over lines as rows, with windows and joins, where the library works on
an array of lines for each document.
"""

from __future__ import annotations

from idweft.functions import patterns as P
from idweft.plans import oracles
from idweft.plans.oracles import DOCS, IDS, MASK, MASKED_LINE, TEXT, TITLE, conf_of, name, q
from idweft.sources.cards import truth_sql

AS_OF_YEAR = 2026
_pct = lambda c: f"CAST(round_even(coalesce({c}, 0) * 100, 0) AS INT)"
_letters = "length(regexp_replace(trim(text), '[^\\p{L}]', '', 'g'))"
_capitals = "length(regexp_replace(trim(text), '[^\\p{Lu}]', '', 'g'))"
_latin = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
AADHAAR_NAME = f"length(trim(text)) >= 4 AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, {q(P.AADHAAR_LABELS)}) AND {_letters} >= 4 AND {_letters} > 0.8 * length(trim(text))"
PASSPORT_NAME = f"length(trim(text)) >= 4 AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, {q(P.PASSPORT_NOT_NAME)}) AND {_letters} >= 4 AND {_capitals} > 0.85 * {_letters}"
LICENCE_NAME = f"NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(trim(text), '(?i)^(?:AB|A|B|O)\\s*[+\\-]?\\s*(?:VE)?$') AND NOT regexp_matches(text, {q(P.DL_NOISE)}) AND {_latin} >= 3"
ADDRESS_LINE = f"(regexp_matches(text, {q(P.ADDRESS_MARKERS)}) OR regexp_matches(text, {q(P.CITY_PIN)}) OR regexp_matches(text, {q(P.PIN)}))"
_words = "regexp_extract_all(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+')"
GARBAGE = f"""(regexp_matches(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '\\p{{L}}') OR ({_latin} > 0 AND len(list_filter({_words}, lambda w: length(w) >= 3 AND regexp_matches(w, '(?i)[AEIOUY]'))) = 0
  AND NOT regexp_matches(trim(text), {q(P.LABEL_ONLY)}) AND ({ADDRESS_LINE} OR {_latin} >= 3)))"""
ORDERED = f"{DOCS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, region_idx) AS rn FROM card_regions)"
NAMED = f"""named_lines AS (SELECT *, {AADHAAR_NAME} AS ok FROM o),
anchors AS (SELECT doc_id, min(rn) AS spot, arg_min(x1, rn) AS ax1, arg_min(x2, rn) AS ax2 FROM o WHERE regexp_matches(text, {q(P.DOB_ANCHOR)}) GROUP BY doc_id),
tiers AS (SELECT n.doc_id, text, conf, CASE WHEN rn < spot AND least(x2, ax2) > greatest(x1, ax1) THEN -2000 - rn WHEN rn < spot THEN -1000 - rn ELSE rn END AS place,
  CASE WHEN rn < spot AND least(x2, ax2) > greatest(x1, ax1) THEN 1 WHEN rn < spot THEN 2 ELSE 3 END AS tier FROM named_lines n LEFT JOIN anchors USING (doc_id) WHERE ok),
anchored AS (SELECT doc_id, arg_min(text, (tier, place)) AS name_text, arg_min(conf, (tier, place)) AS name_conf FROM tiers GROUP BY doc_id)"""

# ---- the ladder of birth dates: a line holds one date at most
_rx_gender = r"(?i)(FEMALE|TRANSGENDER|MALE)(?:[^A-Z]|$)"
_ok = lambda iso: f"(CAST(left({iso}, 4) AS INT) BETWEEN 1900 AND {AS_OF_YEAR} AND substr({iso}, 6, 2) BETWEEN '01' AND '12' AND substr({iso}, 9, 2) BETWEEN '01' AND '31')"
DOB = f"""text_lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS no FROM docs),
raw_dates AS (SELECT doc_id, no, regexp_extract(line, {q(P.FULL_DATE)}) AS raw, line FROM text_lines WHERE regexp_matches(line, {q(P.FULL_DATE)})),
iso_dates AS (SELECT *, regexp_extract(raw, '[0-9]{{4}}$') || '-' || lpad(regexp_extract(raw, '^([0-9]+).([0-9]+)', 2), 2, '0') || '-' || lpad(regexp_extract(raw, '^([0-9]+)', 1), 2, '0') AS iso, right(split_part(line, raw, 1), 24) AS ctx FROM raw_dates),
good AS (SELECT *, regexp_matches(ctx, {q(P.ISSUE_LABEL)}) AS issue, count(*) OVER (PARTITION BY doc_id) AS n_good FROM iso_dates WHERE {_ok("iso")}),
s1 AS (SELECT doc_id, arg_min(iso, no) AS value, arg_min(raw, no) AS raw FROM good WHERE NOT issue AND regexp_matches(ctx, {q(P.DOB_LABEL)}) GROUP BY doc_id),
loose AS (SELECT doc_id, regexp_extract(t, {q(P.DOB_LOOSE)}, 1) AS raw, regexp_replace(regexp_extract(t, {q(P.DOB_LOOSE)}, 1), '[^0-9]', '', 'g') AS d FROM docs),
s2 AS (SELECT * FROM (SELECT doc_id, d[5:8] || '-' || d[3:4] || '-' || d[1:2] AS value, raw FROM loose WHERE length(d) >= 8) WHERE {_ok("value")}),
s3 AS (SELECT doc_id, regexp_extract(t, {q(P.DOB_YEAR)}, 1) AS value, regexp_extract(t, {q(P.DOB_YEAR)}, 1) AS raw FROM docs WHERE regexp_matches(t, {q(P.DOB_YEAR)})),
s4 AS (SELECT doc_id, arg_min(iso, (iso, no)) AS value, arg_min(raw, (iso, no)) AS raw FROM good WHERE n_good >= 2 AND NOT issue GROUP BY doc_id),
placed AS (SELECT g.doc_id, g.no, g.iso, g.raw FROM good g JOIN card_regions x ON x.doc_id = g.doc_id AND contains(upper(x.text), g.raw) JOIN card_regions s ON s.doc_id = g.doc_id AND regexp_matches(s.text, {q(_rx_gender)})
  WHERE NOT issue AND s.y1 - x.y1 > 0 AND s.y1 - x.y1 <= 2.5 * greatest(1, x.y2 - x.y1) AND abs(s.x1 - x.x1) <= 3 * greatest(1, x.y2 - x.y1)),
s5 AS (SELECT doc_id, arg_min(iso, no) AS value, arg_min(raw, no) AS raw FROM placed GROUP BY doc_id),
steps AS (SELECT doc_id, 1 AS step, value, raw FROM s1 UNION ALL SELECT doc_id, 2, value, raw FROM s2 UNION ALL SELECT doc_id, 3, value, raw FROM s3 UNION ALL SELECT doc_id, 4, value, raw FROM s4 UNION ALL SELECT doc_id, 5, value, raw FROM s5),
dob AS (SELECT d.doc_id, coalesce(arg_min(value, step), '') AS dob, coalesce(min(step) = 3, false) AS yob, coalesce(arg_min(raw, step), '') AS raw, CAST(coalesce(min(step), 0) AS INT) AS step FROM docs d LEFT JOIN steps USING (doc_id) GROUP BY d.doc_id)"""
NUMBERS = f"""{MASKED_LINE},
printed AS (SELECT doc_id, regexp_replace(regexp_extract(t, {q(P.AADHAAR_RE2)}, 1), '\\s+', '', 'g') AS printed FROM docs),
masked AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE doc_id NOT IN (SELECT doc_id FROM one)),
printed_conf AS ({conf_of("printed", "printed")}),
numbers AS (SELECT p.doc_id, printed = '' AND m.value IS NOT NULL AS is_masked, CASE WHEN printed <> '' THEN printed WHEN m.value IS NOT NULL THEN 'XXXXXXXX' || m.value ELSE '' END AS number,
  CASE WHEN printed <> '' THEN c.conf WHEN m.value IS NOT NULL THEN m.conf ELSE 0 END AS number_conf FROM printed p LEFT JOIN masked m USING (doc_id) LEFT JOIN printed_conf c ON c.doc_id = p.doc_id)"""
_hindi = " ".join(f"WHEN regexp_matches(t, {q(rx)}) THEN regexp_extract(t, {q(rx)})" for rx, _ in P.GENDER_WORDS)
_hindi_code = " ".join(f"WHEN regexp_matches(word, {q(rx)}) THEN {q(code)}" for rx, code in P.GENDER_WORDS)
GENDERS = f"""words AS (SELECT doc_id, CASE WHEN regexp_matches(t, {q(_rx_gender)}) THEN upper(regexp_extract(t, {q(_rx_gender)}, 1)) {_hindi} ELSE '' END AS word FROM docs), word_conf AS ({conf_of("word", "words")}),
genders AS (SELECT w.doc_id, CASE WHEN word = 'MALE' THEN 'M' WHEN word = 'FEMALE' THEN 'F' WHEN word = 'TRANSGENDER' THEN 'T' {_hindi_code} ELSE '' END AS gender, coalesce(conf, 0.0) AS gender_conf FROM words w LEFT JOIN word_conf USING (doc_id))"""
FRONT = f"""{ORDERED}, {NAMED}, {DOB}, {NUMBERS}, {GENDERS}, dob_conf AS ({conf_of("raw", "(SELECT doc_id, raw FROM dob) AS raws")}),
front AS (SELECT d.doc_id, {name("coalesce(name_text, '')")} AS full_name, {_pct("name_conf")} AS full_name_confidence, gender, {_pct("gender_conf")} AS gender_confidence, dob, {_pct("b.conf")} AS dob_confidence, yob,
  number AS aadhaar_number, {_pct("number_conf")} AS aadhaar_number_confidence, is_masked, CASE WHEN number <> '' AND NOT is_masked THEN sha256(number) ELSE '' END AS uniqueness_id
  FROM dob d JOIN numbers n USING (doc_id) JOIN genders g USING (doc_id) LEFT JOIN anchored a USING (doc_id) LEFT JOIN dob_conf b USING (doc_id))"""


# ---- addresses
def spans(number: str) -> str:
    """Labelled spans and marked clusters; ``number`` is SQL for the document's own digits."""
    return f"""own AS (SELECT doc_id, {number} AS number FROM docs),
clean AS (SELECT o.*, number, regexp_replace(text, '[^0-9]', '', 'g') AS digits, regexp_extract(text, {q(P.PIN)}, 1) AS pin, regexp_matches(text, '[A-Za-z]{{3,}}') AS worded FROM o JOIN own USING (doc_id) WHERE NOT {GARBAGE}),
english AS (SELECT *, length(digits) >= 11 OR (number <> '' AND contains(digits, number)) AS is_number FROM clean c WHERE worded OR NOT EXISTS (SELECT 1 FROM clean w WHERE w.doc_id = c.doc_id AND w.worded AND w.pin <> '' AND w.pin = c.pin)),
starts AS (SELECT doc_id, min(rn) AS spot FROM english WHERE regexp_matches(text, {q(P.ADDRESS_LABEL)}) GROUP BY doc_id),
labels AS (SELECT e.*, trim(regexp_replace(regexp_extract(text, {q("(?i)(?:A[D0O]{1,2}R[A-Z]*S{1,2})(.*)$")}, 1), '^[\\s:.)-]*', '')) AS tail FROM english e JOIN starts ON e.doc_id = starts.doc_id AND rn = spot),
under AS (SELECT e.*, sum(CAST(e.is_number OR regexp_matches(e.text, {q(P.ADDRESS_FOOTER)}) AS INT)) OVER (PARTITION BY e.doc_id ORDER BY e.rn) AS stops,
  coalesce(sum(CAST(e.pin <> '' AS INT)) OVER (PARTITION BY e.doc_id ORDER BY e.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pins
  FROM english e JOIN labels l ON e.doc_id = l.doc_id AND e.rn > l.rn AND trim(e.text) <> '' AND e.x1 BETWEEN l.x1 - 2 * greatest(l.y2 - l.y1, 1) AND l.x1 + 6 * greatest(l.y2 - l.y1, 1)),
span_rows AS (SELECT doc_id, rn, trim(text) AS part, conf FROM under WHERE stops = 0 AND pins = 0 UNION ALL SELECT doc_id, rn, tail, conf FROM labels WHERE tail <> '' AND NOT (length(regexp_replace(tail, '[^0-9]', '', 'g')) >= 11 OR (number <> '' AND contains(regexp_replace(tail, '[^0-9]', '', 'g'), number)))),
span AS (SELECT doc_id, 1 AS labelled, list(part ORDER BY rn) AS parts, avg(conf) AS conf FROM span_rows GROUP BY doc_id),
steps_x AS (SELECT *, CAST(x1 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x1, y1, region_idx) > 120 AS INT) AS wide FROM english WHERE trim(text) <> '' AND NOT is_number AND NOT regexp_matches(text, {q(P.ADDRESS_FOOTER)}) AND {ADDRESS_LINE}),
columns_x AS (SELECT *, sum(coalesce(wide, 0)) OVER (PARTITION BY doc_id ORDER BY x1, y1, region_idx) AS col FROM steps_x),
by_column AS (SELECT doc_id, col, list(trim(text) ORDER BY y1, x1, region_idx) AS parts, avg(conf) AS conf, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, col) AS n FROM columns_x GROUP BY doc_id, col),
cluster AS (SELECT doc_id, 0 AS labelled, parts, conf FROM by_column WHERE n = 1),
joined AS (SELECT *, regexp_replace(trim(regexp_replace(trim(array_to_string(parts, ', '), ' ,'), '(?:\\s*,\\s*)+', ', ', 'g'), ' ,'), '\\s+', ' ', 'g') AS address FROM (SELECT * FROM span UNION ALL SELECT * FROM cluster)),
block AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY regexp_matches(address, {q(P.PIN)}) DESC, labelled DESC, length(address) DESC) AS n FROM joined)"""


ADDRESSES = f"{ORDERED}, {spans(f'regexp_replace(regexp_extract(t, {q(P.AADHAAR_RE2)}, 1), {q("[^0-9]")}, {q("")}, {q("g")})')}, best AS (SELECT doc_id, parts, conf, address FROM block WHERE n = 1)"
_states = ", ".join(q(s) for s in P.STATES)
_care = r"(?i)(?:^|[^A-Z])(?:([CSDWH])\s*[/\\|.]\s*[O0]\.?|(SON|DAUGHTER|WIFE|HUSBAND|CARE)\s+OF\b)\s*[:：.\-]?\s*"


def parts_of(address: str, parts: str) -> str:
    """The parts of an address as select items."""
    relation = f"upper(regexp_extract({address}, {q(_care + '([A-Za-z .]*)')}, 1) || regexp_extract({address}, {q(_care + '([A-Za-z .]*)')}, 2))"
    guardian = f"trim(regexp_extract({address}, {q(_care + '([A-Za-z .]*)')}, 3))"
    house = f"regexp_extract({address}, {q(P.HOUSE_NUMBER)}, 1)"
    lead = f"list_filter({parts}, lambda p: NOT regexp_matches(p, '(?i)^(?:C/O|S/O|D/O|W/O)'))[1]"
    place = lambda rx: f"regexp_extract({address}, {q(f'(?i)(?:^|, ?){rx}[ .:-]*(?:, )?([A-Za-z][A-Za-z .]*?) *(?:,|$)')}, 1)"
    return f"""regexp_extract({address}, {q(P.PIN)}, 1) AS zip, {TITLE.format(guardian)} AS care_of, CASE WHEN {guardian} = '' OR {relation} IN ('S', 'D', 'SON', 'DAUGHTER') THEN 'father' WHEN {relation} IN ('W', 'WIFE') THEN 'husband' ELSE 'care_of' END AS relation,
  CASE WHEN contains(upper({address}), 'INDIA') THEN 'INDIA' ELSE '' END AS country, {TITLE.format(f"coalesce(list_filter([{_states}], lambda s: contains(upper({address}), s))[1], '')")} AS state,
  regexp_replace(CASE WHEN {house} <> '' THEN {house} ELSE coalesce(regexp_extract({lead}, {q(P.LEADING_NUMBER)}, 1), '') END, '^[A-Za-z]-?', '') AS house_number,
  {TITLE.format(place("DIST"))} AS district, {TITLE.format(place("VTC"))} AS city"""




def ratios(alias: str, pairs: str) -> str:
    """``<alias> (a, b, ratio)`` for the distinct string pairs of ``pairs`` (a, b), by matching blocks.

    The longest common stretch, the leftmost in a and then in b of equal ones; then the same to
    the left of it and to the right of it, and so on. (Strings of 200 letters and more would
    leave out popular ones; none here is so long.)
    """
    inside = f"{alias}_spans x JOIN {alias}_runs r ON r.a = x.a AND r.b = x.b AND r.i >= x.alo AND r.i < x.ahi AND r.j >= x.blo AND r.j < x.bhi"
    size = "least(r.m, x.ahi - r.i, x.bhi - r.j)"
    best = f"SELECT x.a, x.b, alo, ahi, blo, bhi, arg_max({{'i': r.i, 'j': r.j, 'k': {size}}}, [{size}, -r.i, -r.j]) AS s FROM {inside} GROUP BY x.a, x.b, alo, ahi, blo, bhi"
    return f"""{alias}_cells AS (SELECT a, b, i, j FROM (SELECT a, b, i, unnest(range(length(b))) AS j FROM (SELECT DISTINCT a, b, unnest(range(length(a))) AS i FROM {pairs})) WHERE a[i + 1] = b[j + 1]),
{alias}_runs AS MATERIALIZED (SELECT a, b, i, j, count(*) OVER (PARTITION BY a, b, i - j, island ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island FROM {alias}_cells)),
{alias}_spans AS (SELECT DISTINCT a, b, 0::BIGINT AS alo, length(a) AS ahi, 0::BIGINT AS blo, length(b) AS bhi FROM {pairs}
  UNION ALL SELECT a, b, CASE side WHEN 0 THEN alo ELSE s.i + s.k END, CASE side WHEN 0 THEN s.i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE s.j + s.k END, CASE side WHEN 0 THEN s.j ELSE bhi END FROM ({best}), (VALUES (0), (1)) sides(side)
  WHERE CASE side WHEN 0 THEN s.i > alo AND s.j > blo ELSE s.i + s.k < ahi AND s.j + s.k < bhi END),
{alias}_sums AS (SELECT a, b, sum(s.k) AS m FROM ({best}) GROUP BY a, b),
{alias} AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(m, 0) / (length(a) + length(b)) END AS ratio FROM (SELECT DISTINCT a, b FROM {pairs}) LEFT JOIN {alias}_sums USING (a, b))"""


_listed = ", ".join(f"({i}, {q(''.join(c for c in x if c.isalpha()))}, {q(x.title())})" for i, x in enumerate(P.STATES))


def repaired(source: str) -> str:
    """``repaired (doc_id, address)`` of ``source``: in the last three parts, the first run of words that is like a state.

    Windows of three words, two and one as rows, joined to the states on initial and length.
    """
    return f"""states(place, letters, name) AS (VALUES {_listed}),
segments AS (SELECT doc_id, len(p) AS n_parts, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS part FROM (SELECT doc_id, string_split(address, ',') AS p FROM {source})),
words_of AS (SELECT doc_id, pos, regexp_extract_all(part, '[A-Za-z]+|[^A-Za-z]+') AS w FROM segments WHERE pos > n_parts - 3),
windows AS (SELECT doc_id, pos, size, i, w, array_to_string(w[i:i + 2 * size - 2], '') AS run FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words_of), (VALUES (3), (2), (1)) sizes(size) WHERE i + 2 * size - 2 <= len(w)),
keyed AS MATERIALIZED (SELECT *, upper(regexp_replace(run, '\\s', '', 'g')) AS a FROM windows WHERE regexp_full_match(run, '[A-Za-z][A-Za-z\\s]*[A-Za-z]')),
near AS MATERIALIZED (SELECT k.*, s.letters AS b, s.place, s.name FROM keyed k JOIN states s ON left(a, 1) = left(letters, 1) AND abs(length(a) - length(letters)) <= 2 WHERE length(a) >= 5),
{ratios("likeness", "near")},
read_states AS (SELECT doc_id, pos, size, i, w, name FROM near JOIN likeness USING (a, b) WHERE ratio >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY size DESC, i, place) = 1),
repaired AS (SELECT g.doc_id, string_agg(CASE WHEN name IS NULL THEN part ELSE array_to_string(w[1:i - 1], '') || name || array_to_string(w[i + 2 * size - 1:], '') END, ',' ORDER BY g.pos) AS address FROM segments g LEFT JOIN read_states r ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY g.doc_id)"""


_recursive = lambda sql: sql.replace("WITH", "WITH RECURSIVE", 1)
BACK = f"""{ORDERED}, {NUMBERS}, {spans("(SELECT regexp_replace(number, '[^0-9]', '', 'g') FROM numbers WHERE numbers.doc_id = docs.doc_id)")},
{repaired("(SELECT * FROM block WHERE n = 1)")},
back AS (SELECT doc_id, r.address, parts, conf FROM block JOIN repaired r USING (doc_id) WHERE n = 1)"""

# ---- passport and voter card
_labelled = lambda rx: f"regexp_extract(t, {q(f'(?i){rx}[:' + chr(92) + f's]*({P.FULL_DATE})')}, 1)"
_place_of = lambda what: f"upper(regexp_replace(trim(regexp_extract(t, {q(f'(?i)PLACE{chr(92)}s*OF{chr(92)}s*{what}[:{chr(92)}s]*([A-Z, ]+)')}, 1)), ',+$', ''))"
_mrz = r"([A-Z]{3})(\d{6})\d?([MF<])(\d{6})"
_pick = lambda *cs: f"coalesce({', '.join(f'nullif({c}, {q("")})' for c in cs)}, '')"
_mrz_day = lambda c, century: f"CASE WHEN {c} <> '' THEN {c}[5:6] || '/' || {c}[3:4] || '/' || {century} || {c}[1:2] ELSE '' END"
BACK_SIDE = f"({oracles.BACKS}) >= 2"
PASSPORT_FRONT = f"""{DOCS}, zone AS (SELECT doc_id, regexp_replace(unnest(string_split(t, chr(10))), '\\s+', '', 'g') AS line, unnest(range(len(string_split(t, chr(10))))) AS no FROM docs),
first_line AS (SELECT doc_id, arg_min(line, no) AS line1 FROM zone WHERE regexp_matches(line, '^P[A-Z<]') AND contains(line, '<<') AND length(line) >= 28 GROUP BY doc_id),
second_line AS (SELECT doc_id, arg_min(line, no) AS line2 FROM zone WHERE regexp_matches(line, '^[A-Z]{{1,2}}\\d{{6,7}}') AND length(line) >= 28 GROUP BY doc_id),
fronts AS (SELECT s.doc_id, s.t, coalesce(line1, '') AS line1, coalesce(line2, '') AS line2 FROM spaced s LEFT JOIN first_line USING (doc_id) LEFT JOIN second_line USING (doc_id) WHERE NOT ({BACK_SIDE})),
days AS (SELECT doc_id, unnest(regexp_extract_all(t, {q(rf"\b{P.FULL_DATE}\b")})) AS day, unnest(range(len(regexp_extract_all(t, {q(rf"\b{P.FULL_DATE}\b")})))) AS no FROM fronts),
oldest AS (SELECT doc_id, arg_min(day, (regexp_extract(day, '\\d{{4}}'), no)) AS day FROM days GROUP BY doc_id),
read_zone AS (SELECT f.*, regexp_extract(line1[3:], '^[A-Z]{{3}}') AS country1, string_split(line1[6:], '<<') AS names, regexp_extract(line2, '^([A-Z]{{1,2}}\\d{{6,7}})', 1) AS number,
  regexp_extract(line2, {q(_mrz)}, 1) AS country2, regexp_extract(line2, {q(_mrz)}, 2) AS birth, regexp_extract(line2, {q(_mrz)}, 3) AS sex, regexp_extract(line2, {q(_mrz)}, 4) AS expiry, upper(regexp_extract(t, '(?i)\\b(MALE|FEMALE)\\b', 1)) AS printed, coalesce(day, '') AS day FROM fronts f LEFT JOIN oldest USING (doc_id)),
fields AS (SELECT *, {_pick("number", "regexp_extract(t, '" + chr(92) + "b([A-Z]{1,2}" + chr(92) + "d{6,7})" + chr(92) + "b', 1)")} AS passport, line1[1:8] AS zone_key, {_labelled("DATE" + chr(92) + "s*OF" + chr(92) + "s*ISSUE")} AS doi, {_place_of("BIRTH")} AS born_in, {_place_of("ISSUE")} AS issued_in FROM read_zone),
passport_conf AS ({conf_of("passport", "(SELECT doc_id, passport FROM fields) AS p")}), zone_conf AS ({conf_of("zone_key", "(SELECT doc_id, zone_key FROM fields) AS z")}), doi_conf AS ({conf_of("doi", "(SELECT doc_id, doi FROM fields) AS d")}),
born_conf AS ({conf_of("born_in", "(SELECT doc_id, born_in FROM fields) AS b")}), issued_conf AS ({conf_of("issued_in", "(SELECT doc_id, issued_in FROM fields) AS i")}),
sure AS (SELECT f.*, {_pick("country2", "country1")} AS country, CASE WHEN sex <> '' THEN sex WHEN printed = 'MALE' THEN 'M' WHEN printed = 'FEMALE' THEN 'F' ELSE '' END AS gender0, {_pct("coalesce(p.conf, z.conf)")} AS base, {_pct("d.conf")} AS doi_c, {_pct("b.conf")} AS born_c, {_pct("i.conf")} AS issued_c
  FROM fields f LEFT JOIN passport_conf p USING (doc_id) LEFT JOIN zone_conf z USING (doc_id) LEFT JOIN doi_conf d USING (doc_id) LEFT JOIN born_conf b USING (doc_id) LEFT JOIN issued_conf i USING (doc_id))"""
_front_fields = {
    "country_code": "country", "dob": _pick(_mrz_day("birth", "CASE WHEN birth[1:2] <= '30' THEN '20' ELSE '19' END"), _labelled(r"(?:DATE\s*OF\s*BIRTH|BIRTH)"), "day"), "doe": _pick(_mrz_day("expiry", "'20'"), _labelled(r"DATE\s*OF\s*EXPIRY")),
    "gender": "CASE WHEN gender0 IN ('M', 'F') THEN gender0 ELSE '' END", "given_name": TITLE.format("coalesce(names[2], '')"), "nationality": "CASE WHEN country = 'IND' THEN 'INDIAN' ELSE '' END", "passport_num": "passport",
    "surname": TITLE.format("coalesce(names[1], '')"), "mrz_line_1": "line1", "mrz_line_2": "line2", "type_of_passport": "line1[1:1]",
}
_front_select = ", ".join(f"{sql} AS {field}, base AS {field}_confidence" for field, sql in _front_fields.items())
VOTER_FRONT = f"""{ORDERED}, fronts AS (SELECT doc_id, t, regexp_extract(t, {q(oracles._epic)}, 2) AS epic, regexp_extract(t, {q(P.VOTER_DOB)}, 1) AS raw, upper(regexp_extract(t, '(?i)\\b(MALE|FEMALE|TRANSGENDER)\\b', 1)) AS word FROM docs WHERE NOT contains(t, 'ADDRESS') OR regexp_matches(replace(t, 'ELECTORAL', ''), 'ELECTOR|EPIC|PHOTO\\s*IDENTITY')),
born AS (SELECT doc_id, CASE WHEN raw <> '' THEN regexp_extract(raw, '\\d{{4}}$') || '-' || lpad(regexp_extract(raw, '^\\d+.(\\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(raw, '^\\d+'), 2, '0') ELSE '' END AS dob FROM fronts),
cards_found AS (SELECT doc_id, coalesce(list_filter(regexp_extract_all(t, {q(rf"\b({P.FULL_DATE})\b")}), lambda d: d <> raw)[1], '') AS card FROM fronts),
relations AS (SELECT *, CASE WHEN regexp_matches(text, {q(P.VOTER_PARENT)}) THEN regexp_extract(text, {q(P.VOTER_PARENT)}, 1) ELSE regexp_extract(text, {q(P.VOTER_PARENT_GARBLED)}, 1) END AS relation FROM o),
parents AS (SELECT doc_id, arg_min(relation, rn) AS relation, arg_min(conf, rn) AS conf FROM relations WHERE trim(relation) <> '' GROUP BY doc_id),
printed AS (SELECT doc_id, arg_min(regexp_extract(trim(text), {q(P.VOTER_NAME)}, 1), rn) AS own, arg_min(conf, rn) AS conf FROM o WHERE NOT regexp_matches(text, '(?i)FATH|HUSB|MOTH') AND trim(regexp_extract(trim(text), {q(P.VOTER_NAME)}, 1)) <> '' GROUP BY doc_id),
epic_rows AS (SELECT o.doc_id, min(rn) AS spot FROM o JOIN fronts USING (doc_id) WHERE epic <> '' AND contains(upper(text), epic) GROUP BY o.doc_id),
guesses AS (SELECT o.doc_id, arg_min(text, CASE WHEN rn < spot THEN -rn ELSE rn END) AS text, arg_min(conf, CASE WHEN rn < spot THEN -rn ELSE rn END) AS conf FROM o LEFT JOIN epic_rows USING (doc_id) WHERE NOT regexp_matches(text, {q(P.VOTER_HEADER)}) AND {AADHAAR_NAME} GROUP BY o.doc_id),
fuzzy AS (SELECT doc_id, value, conf FROM ({oracles.ORACLE_SQL["gender_after_label"].replace(oracles.CARDS, "WITH gender_start AS (SELECT 1)")})),
raw_conf AS ({conf_of("raw", "(SELECT doc_id, raw FROM fronts) AS r")}), card_conf AS ({conf_of("card", "cards_found")}), word_conf AS ({conf_of("word", "(SELECT doc_id, word FROM fronts) AS w")}), epic_conf AS ({conf_of("epic", "(SELECT doc_id, epic FROM fronts) AS e")}),
aged AS (SELECT doc_id, dob, CASE WHEN dob <> '' THEN {AS_OF_YEAR} - CAST(dob[1:4] AS INT) - CAST(101 < CAST(dob[6:7] AS INT) * 100 + CAST(dob[9:10] AS INT) AS INT) END AS years FROM born)"""

# ---- attempts: both reads of a document stand as documents of their own, numbered 2 k and 2 k + 1
def _both_reads(sql: str) -> str:
    lines = "attempt_lines AS (SELECT * REPLACE (doc_id * 2 + CAST(attempt = 'full' AS BIGINT) AS doc_id) FROM attempt_regions), docs AS (SELECT doc_id"
    cards, mark, rest = sql.rpartition("docs AS (SELECT doc_id")
    rest = rest.replace("FROM card_regions", "FROM attempt_lines").replace("JOIN card_regions", "JOIN attempt_lines")
    return cards + (lines if mark else "") + rest


ATTEMPTS = f"""{_both_reads(IDS)}, {_both_reads(MASKED_LINE)}, sizes AS (SELECT doc_id, CAST(count(*) AS INT) AS n_regions, avg(CASE WHEN conf > 0 THEN conf END) AS avg_confidence FROM attempt_lines GROUP BY doc_id),
shown_digits AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE doc_id NOT IN (SELECT doc_id FROM one)),
attempts AS (SELECT i.doc_id // 2 AS doc_id, i.doc_id % 2 AS is_full, i.doc_type AS actual, c.doc_type AS intended, c.k % 6 = 0 AS did_crop, n_regions, avg_confidence,
  CASE WHEN i.doc_type = c.doc_type THEN coalesce(extracted_id, '') ELSE '' END AS extracted, CASE WHEN i.doc_type = c.doc_type AND i.doc_type = 'AADHAAR' AND extracted_id IS NULL THEN coalesce(m.value, '') ELSE '' END AS masked4
  FROM ids i JOIN cards c ON c.k = i.doc_id // 2 JOIN sizes USING (doc_id) LEFT JOIN shown_digits m ON m.doc_id = i.doc_id),
found AS (SELECT doc_id, bool_or(did_crop) AS did_crop, max(is_full) AS has_full, bool_or(is_full = 0 AND extracted <> '') AS crop_id, bool_or(is_full = 1 AND extracted <> '') AS full_id, bool_or(is_full = 0 AND masked4 <> '') AS crop_masked, bool_or(is_full = 1 AND masked4 <> '') AS full_masked FROM attempts GROUP BY doc_id),
chosen AS (SELECT *, CAST(NOT crop_id AND did_crop AND has_full = 1 AND (full_id OR (full_masked AND NOT crop_masked)) AS BIGINT) AS is_full FROM found),
verified AS (SELECT a.*, f.did_crop AND NOT crop_id AND has_full = 1 AS retried, CASE WHEN extracted = '' AND masked4 <> '' THEN 'XXXX XXXX ' || masked4 ELSE extracted END AS number FROM attempts a JOIN chosen f USING (doc_id, is_full)),
outcomes AS (SELECT *, CASE WHEN actual <> intended THEN 'document_mismatch' WHEN number = '' THEN 'id_not_found' END AS error_code FROM verified)"""

# ---- masking: hits in (y, x) order, each joined to the growing box or beginning the next one
_FOLD = """ordered_hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, y2, x2) AS n FROM hits),
gaps AS (SELECT doc_id, any_value(doc_type) AS kind, CASE WHEN any_value(doc_type) = 'AADHAAR' THEN greatest(22, floor(list_sort(list(y2 - y1))[count(*) // 2 + 1] * 1.2)) ELSE 22 END AS gap FROM hits GROUP BY doc_id),
fold AS (SELECT doc_id, n, 0 AS box_no, x1, y1, x2, y2 FROM ordered_hits WHERE n = 1
  UNION ALL SELECT doc_id, n, box_no + CAST(NOT joins AS INT), CASE WHEN joins THEN least(x1, bx1) ELSE bx1 END, CASE WHEN joins THEN least(y1, by1) ELSE by1 END, CASE WHEN joins THEN greatest(x2, bx2) ELSE bx2 END, CASE WHEN joins THEN greatest(y2, by2) ELSE by2 END
  FROM (SELECT f.doc_id, h.n, box_no, f.x1, f.y1, f.x2, f.y2, h.x1 AS bx1, h.y1 AS by1, h.x2 AS bx2, h.y2 AS by2, least(h.y2, f.y2) - greatest(h.y1, f.y1) >= 0.4 * greatest(1, f.y2 - f.y1) AND h.x1 <= f.x2 + gap AS joins FROM fold f JOIN ordered_hits h ON h.doc_id = f.doc_id AND h.n = f.n + 1 JOIN gaps g ON g.doc_id = f.doc_id)),
boxes AS (SELECT doc_id, CAST(box_no AS INT) AS box_no, arg_max(x1, n) AS x1, arg_max(y1, n) AS y1, arg_max(x2, n) AS x2, arg_max(y2, n) AS y2 FROM fold GROUP BY doc_id, box_no)"""
PIECES = _recursive(oracles.HITS).replace(
    "words AS (SELECT r.*",
    """pieces AS (SELECT doc_id, region_idx * 10 + i AS region_idx, conf, string_split(text, ' ')[i + 1] AS text, CAST(40 + i * (60 + doc_id % 4 * 10) AS INT) AS x1, CAST(y1 + i * (doc_id % 3) * 7 AS INT) AS y1, CAST(88 + i * (60 + doc_id % 4 * 10) AS INT) AS x2, CAST(y2 + i * (doc_id % 3) * 7 AS INT) AS y2
  FROM card_regions, (VALUES (0), (1), (2)) v(i) WHERE regexp_full_match(text, '[0-9]{4} [0-9]{4} [0-9]{4}')), words AS (SELECT r.*""",
).replace("FROM card_regions r JOIN ids i", "FROM pieces r JOIN ids i")
_fields = " ".join(f"WHEN {q(row[1])} THEN {q(row[3])}" for row in P.DOC_TYPE_ROWS)
RECTS = f"""{_recursive(oracles.HITS)}, {_FOLD},
inside AS (SELECT b.*, kind, max(CASE WHEN ok THEN h.conf END) AS conf, coalesce(sum(CASE WHEN ok THEN n_chars END), 0) AS n_chars
  FROM (SELECT b.*, kind FROM boxes b JOIN gaps USING (doc_id)) b LEFT JOIN (SELECT doc_id AS hit_doc, conf, n_chars, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM hits) h ON h.hit_doc = b.doc_id, LATERAL (SELECT cx BETWEEN b.x1 AND b.x2 AND cy BETWEEN b.y1 AND b.y2 AS ok) GROUP BY ALL),
sheet AS (SELECT doc_id, max(x2) + 20 AS width, max(y2) + 20 AS height FROM card_regions GROUP BY doc_id),
padded AS (SELECT i.*, greatest(4, CAST(floor((y2 - y1) * 0.18) AS INT)) AS pad, width, height FROM inside i JOIN sheet USING (doc_id)),
framed AS (SELECT *, greatest(0, x1 - pad) AS bx1, greatest(0, y1 - pad) AS by1, least(width - 1, x2 + pad) AS rx2, least(height - 1, y2 + pad) AS ry2 FROM padded),
rects AS (SELECT doc_id, CASE kind {_fields} ELSE 'id_number' END AS field, bx1 AS x1, by1 AS y1, least(rx2, greatest(bx1 + 1, CASE WHEN kind = 'AADHAAR' THEN rx2 - CAST(floor((rx2 - bx1) * 0.34) AS INT) ELSE CAST(round_even(x2 - 4 * ((x2 - x1) / greatest(n_chars, 1)), 0) AS INT) END)) AS x2, ry2 AS y2, coalesce(conf, 0.0) AS conf FROM framed)"""

# ---- driving licence
def iso(c: str) -> str:
    """A date with a numeric or named month as ISO; '' if it is none."""
    numeric, named = r"^\s*(\d{1,2})[/\-.\s]+(\d{1,2})[/\-.\s]+(\d{4})", r"^\s*(\d{1,2})[/\-.\s]*([A-Za-z]{3,})[/\-.\s]*(\d{4})"
    months = ", ".join(q(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split())
    made = lambda rx, month: f"CASE WHEN CAST(regexp_extract({c}, {q(rx)}, 1) AS INT) BETWEEN 1 AND 31 AND {month} BETWEEN 1 AND 12 THEN regexp_extract({c}, {q(rx)}, 3) || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({c}, {q(rx)}, 1), 2, '0') ELSE '' END"
    return f"CASE WHEN regexp_matches({c}, {q(numeric)}) THEN {made(numeric, f'CAST(regexp_extract({c}, {q(numeric)}, 2) AS INT)')} WHEN regexp_matches({c}, {q(named)}) THEN {made(named, f'coalesce(list_position([{months}], lower(left(regexp_extract({c}, {q(named)}, 2), 3))), 0)')} ELSE '' END"


_blood = "(regexp_matches(trim(text), '(?i)^(?:AB|A|B|O)\\s*[+\\-]') OR regexp_matches(trim(text), '(?i)^(?:NOT|NIL)'))"
LICENCE_ADDRESS = f"(trim(text) <> '' AND NOT regexp_matches(trim(text), {q(P.DL_ADDRESS_STOP)}) AND NOT regexp_matches(trim(text), '^[\\d/\\-.\\s]+$') AND {iso('trim(text)')} = '' AND NOT {_blood} AND ({_latin} >= 4 OR regexp_matches(text, '\\d{{3}}')))"
_tail = lambda rx: f"regexp_replace(regexp_extract(text, {q(f'(?s)^.*?(?:(?i:{rx}))(.*)$')}, 1), '^[ \\t:.\\-/]+|[ \\t:.\\-/]+$', '', 'g')"
_worded = lambda c: f"CASE WHEN regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') THEN {c} ELSE '' END"


def label_rows(alias: str, test: str, tail_rx: str) -> str:
    """The first line of each document that passes, with what is behind the label, its centre and height."""
    return f"{alias} AS (SELECT * EXCLUDE (n), {_worded('behind')} AS tail FROM (SELECT *, {_tail(tail_rx)} AS behind, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(y2 - y1, 1) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY region_idx) AS n FROM card_regions WHERE {test}) WHERE n = 1)"


def pairs(alias: str, test: str, tail_rx: str, accept: str = "true") -> str:
    """``<alias>_pair (doc_id, value, conf, ...)``: behind the label, else right of it and vertically nearest."""
    return f"""{label_rows(alias, test, tail_rx)},
{alias}_beside AS (SELECT l.doc_id, r.text, r.conf, r.x1, row_number() OVER (PARTITION BY l.doc_id ORDER BY abs((r.y1 + r.y2) / 2 - l.cy), r.region_idx) AS n FROM {alias} l JOIN (SELECT * FROM card_regions WHERE {accept}) r ON r.doc_id = l.doc_id AND r.region_idx <> l.region_idx AND (r.x1 + r.x2) / 2 > l.cx AND abs((r.y1 + r.y2) / 2 - l.cy) <= greatest(1.6 * l.h, 50)),
{alias}_pair AS (SELECT l.doc_id, l.region_idx, l.x1, l.x2, l.y1, l.h, CASE WHEN tail <> '' THEN tail ELSE trim(coalesce(b.text, '')) END AS value, CASE WHEN tail <> '' OR b.text IS NULL THEN l.conf ELSE b.conf END AS conf, CASE WHEN tail <> '' OR b.text IS NULL THEN l.x1 ELSE b.x1 END AS anchor_x FROM {alias} l LEFT JOIN {alias}_beside b ON b.doc_id = l.doc_id AND b.n = 1)"""


def under(alias: str, label: str, accept: str) -> str:
    """The topmost accepted line printed under a label, left-aligned with it."""
    return f"{alias} AS (SELECT doc_id, text, conf FROM (SELECT l.doc_id, r.text, r.conf, row_number() OVER (PARTITION BY l.doc_id ORDER BY r.y1, r.region_idx) AS n FROM {label} l JOIN (SELECT * FROM card_regions WHERE {accept}) r ON r.doc_id = l.doc_id AND r.region_idx <> l.region_idx AND r.y1 >= l.y2 - 0.3 * l.h AND r.y1 - l.y2 <= 1.5 * l.h AND abs(r.x1 - l.x1) <= 1.5 * l.h) WHERE n = 1)"


_name_test = "regexp_matches(text, '(?i)\\bNAME\\b') AND NOT regexp_matches(text, '(?i)MAKER|MODEL')"
_nearest = lambda alias, source, test: f"{alias} AS (SELECT doc_id, arg_min(text, (cy, region_idx)) AS text, arg_min(conf, (cy, region_idx)) AS conf, min(cy) AS cy FROM {source} WHERE {test} GROUP BY doc_id)"
_guardian = lambda c: name(f"regexp_replace(trim({c}, ' :./'), '^(?:[DWM]\\s*)*O[Ff]([A-Z]|\\s+|$)\\s*', '\\1')")
LICENCE_NAMES = f"""{label_rows("name_label", _name_test, P.DL_NAME_GLUE[4:])}, {label_rows("guard_label", f"regexp_matches(text, {q(P.DL_GUARDIAN)})", P.DL_GUARDIAN[4:])},
refs AS (SELECT d.doc_id, coalesce(n.cx, g.cx) AS ref_x, coalesce(n.region_idx, -1) AS name_idx, coalesce(g.region_idx, -1) AS guard_idx, coalesce(n.tail, '') AS name_tail, coalesce(g.tail, '') AS guard_tail, n.conf AS name_label_conf, g.conf AS guard_label_conf,
  n.doc_id IS NOT NULL AND coalesce(n.tail, '') = '' AS need, n.cy - greatest(1.3 * n.h, 36) AS name_floor, g.cy - greatest(1.3 * g.h, 36) AS guard_floor FROM docs d LEFT JOIN name_label n USING (doc_id) LEFT JOIN guard_label g USING (doc_id)),
value_column AS (SELECT r.doc_id, text, conf, region_idx, (y1 + y2) / 2 AS cy, refs.* EXCLUDE (doc_id) FROM card_regions r JOIN refs USING (doc_id) WHERE region_idx <> name_idx AND region_idx <> guard_idx AND x1 > ref_x AND {LICENCE_NAME}),
{_nearest("in_column", "value_column", "need AND cy >= name_floor")}, {under("below_name", "name_label", LICENCE_NAME)}, {under("below_guard", "guard_label", LICENCE_NAME)},
spots_l AS (SELECT r.*, c.text AS column_text, c.conf AS column_conf, CASE WHEN need AND c.doc_id IS NULL THEN b.text END AS under_text, CASE WHEN need AND c.doc_id IS NULL THEN b.conf END AS under_conf, coalesce(c.cy, guard_floor, -1) AS base FROM refs r LEFT JOIN in_column c USING (doc_id) LEFT JOIN below_name b USING (doc_id)),
{_nearest("lower_line", "(SELECT v.*, base, under_text FROM value_column v JOIN spots_l s USING (doc_id)) AS v", "under_text IS NULL AND guard_tail = '' AND cy > base + 6")},
licence_names AS (SELECT s.doc_id, {name("CASE WHEN name_tail <> '' THEN name_tail ELSE trim(coalesce(column_text, under_text, '')) END")} AS name, CASE WHEN name_tail <> '' THEN name_label_conf ELSE coalesce(column_conf, under_conf, 0.0) END AS name_conf,
  {_guardian("CASE WHEN guard_tail <> '' THEN guard_tail ELSE trim(coalesce(CASE WHEN under_text IS NOT NULL THEN bg.text END, lo.text, '')) END")} AS guardian, CASE WHEN guard_tail <> '' THEN guard_label_conf ELSE coalesce(CASE WHEN under_text IS NOT NULL THEN bg.conf END, lo.conf, 0.0) END AS guardian_conf
  FROM spots_l s LEFT JOIN below_guard bg USING (doc_id) LEFT JOIN lower_line lo USING (doc_id))"""
LICENCE_ADDRESSES = f"""{pairs("addr", f"regexp_matches(text, {q(P.DL_ADDRESS)})", P.DL_ADDRESS[4:], LICENCE_ADDRESS)},
addr_top AS (SELECT *, anchor_x > x2 - 8 AS own_column, CASE WHEN anchor_x > x2 - 8 THEN y1 - greatest(1.5 * h, 45) ELSE y1 - 5 END AS top FROM addr_pair),
addr_lines AS (SELECT r.doc_id, trim(r.text) AS part, r.conf, row_number() OVER w AS n, coalesce(r.y1 - lag(r.y2) OVER w > 55, false) AS gap FROM (SELECT * FROM card_regions WHERE {LICENCE_ADDRESS}) r JOIN addr_top a ON a.doc_id = r.doc_id AND r.region_idx <> a.region_idx AND r.y1 >= top AND abs(r.x1 - anchor_x) <= 90 WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.y1, r.x1, r.region_idx)),
addr_kept AS (SELECT doc_id, n, part, conf, sum(CAST(gap AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS gaps FROM addr_lines),
addr_rows AS (SELECT doc_id, n, part, conf FROM addr_kept WHERE gaps = 0 UNION ALL SELECT doc_id, 0, value, conf FROM addr_top WHERE NOT own_column AND value <> ''),
addr_full AS (SELECT doc_id, trim(regexp_replace(regexp_replace(string_agg(part, ', ' ORDER BY n), '\\s*,\\s*', ', ', 'g'), ',\\s*,', ',', 'g'), ' ,') AS value, arg_min(conf, n) AS conf FROM addr_rows GROUP BY doc_id),
licence_addresses AS (SELECT a.doc_id, coalesce(f.value, a.value) AS address, coalesce(f.conf, CASE WHEN a.value <> '' THEN a.conf ELSE 0 END) AS conf FROM addr_pair a LEFT JOIN addr_full f USING (doc_id))"""

_legacy_number = rf"((?:DLF)?(?:{P.DL_STATES})[\s-]?\d{{12}})(?:[^\d]|$)"
_birth = rf"(?i)(?:DOB|DATE\s*OF\s*BIRTH|BIRTH)[:\s]*({P.DL_DATE})"
_glued = lambda i: rf"(?i){P.DL_ISSUE_LABELS[i]}\s*[:\-]?\s*{P.DL_DATE_TOKEN}"
_issue = range(len(P.DL_ISSUE_LABELS))
_kept_date = "day <> '' AND day <> born"
LICENCE = f"""{DOCS}, {LICENCE_NAMES}, {LICENCE_ADDRESSES}, {pairs("blood", f"regexp_matches(text, {q(P.DL_BLOOD)})", P.DL_BLOOD[4:], _blood)},
raw_numbers AS (SELECT doc_id, t, {_pick(f"regexp_extract(t, {q(P.DL_MODERN)})", f"regexp_extract(t, {q(_legacy_number)}, 1)", f"regexp_extract(t, {q(rf'{chr(92)}b({P.VEHICLE}){chr(92)}b')}, 1)")} AS raw FROM docs),
licence_numbers AS (SELECT *, regexp_replace(raw, '[^A-Z0-9]', '', 'g') AS number, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM raw_numbers),
years AS (SELECT *, CASE WHEN y BETWEEN 1950 AND {AS_OF_YEAR} THEN y ELSE 0 END AS issue_year FROM (SELECT *, CASE length(d) WHEN 13 THEN CAST(d[3:6] AS INT) WHEN 12 THEN CAST(d[9:12] AS INT) ELSE 0 END AS y FROM licence_numbers)),
text_lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS no FROM docs),
told AS (SELECT *, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(10), '') AS earlier, regexp_extract(line, {q(P.DL_DATE)}) AS date FROM text_lines),
dates AS (SELECT doc_id, no, date, {iso("date")} AS day, right(earlier || split_part(line, date, 1), 30) AS ctx FROM told WHERE date <> ''),
oldest AS (SELECT doc_id, arg_min(day, (day, date, ctx)) AS day, arg_min(date, (day, date, ctx)) AS date FROM dates JOIN years USING (doc_id) WHERE day <> '' AND NOT regexp_matches(ctx, {q(P.DL_ISSUE_NEAR)}) AND NOT (issue_year > 0 AND CAST(day[1:4] AS INT) > issue_year - 16) GROUP BY doc_id),
birth_labels AS (SELECT doc_id, regexp_extract(t, {q(_birth)}, 1) AS labelled FROM docs), birth_days AS (SELECT doc_id, labelled, {iso("labelled")} AS day FROM birth_labels),
births AS (SELECT b.doc_id, CASE WHEN b.day <> '' THEN b.day ELSE coalesce(o.day, '') END AS born, CASE WHEN b.day <> '' THEN labelled ELSE coalesce(o.date, '') END AS printed FROM birth_days b LEFT JOIN oldest o USING (doc_id)),
birth_conf AS ({conf_of("printed", "births")}), raw_conf AS ({conf_of("raw", "(SELECT doc_id, raw FROM years) AS y")}),
{", ".join(pairs(f"issue{i}", f"regexp_matches(text, {q('(?i)' + P.DL_ISSUE_LABELS[i])})", P.DL_ISSUE_LABELS[i]) for i in _issue)},
issue_found AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS step, region_idx, {iso(f'regexp_extract(text, {q(_glued(i))}, 1)')} AS day, conf FROM card_regions WHERE regexp_matches(text, {q(_glued(i))})" for i in _issue)}
  UNION ALL {" UNION ALL ".join(f"SELECT doc_id, {i + 5}, 0, {iso(f'regexp_replace(value, {q("^[:" + chr(92) + "s]+")}, {q("")})')}, conf FROM issue{i}_pair" for i in _issue)}),
issued AS (SELECT doc_id, arg_min(day, (step, region_idx)) AS day, arg_min(conf, (step, region_idx)) AS conf FROM issue_found JOIN births USING (doc_id) WHERE {_kept_date} GROUP BY doc_id),
bare AS (SELECT y.doc_id, raw, n.name = '' AND n.guardian = '' AND coalesce(a.address, '') = '' AS bare FROM years y JOIN licence_names n USING (doc_id) LEFT JOIN licence_addresses a USING (doc_id)),
number_lines AS (SELECT * FROM (SELECT r.*, greatest(y2 - y1, 1) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY region_idx) AS n FROM card_regions r JOIN bare USING (doc_id) WHERE bare AND raw <> '' AND contains(regexp_replace(upper(text), '[^A-Z0-9]', '', 'g'), regexp_replace(raw, '[^A-Z0-9]', '', 'g'))) WHERE n = 1),
column_under AS (SELECT r.*, coalesce(r.y1 - coalesce(lag(r.y2) OVER w, a.y2) > 1.5 * a.h, false) OR regexp_matches(r.text, {q(P.DL_ADDRESS_STOP)}) OR {iso("r.text")} <> '' AS stop, row_number() OVER w AS n FROM card_regions r JOIN number_lines a ON a.doc_id = r.doc_id AND r.region_idx <> a.region_idx AND abs(r.x1 - a.x1) <= greatest(1.5 * a.h, 0.12 * (a.x2 - a.x1)) AND r.y1 >= a.y1 + 0.5 * a.h WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.y1, r.x1, r.region_idx)),
walk_under AS (SELECT *, sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS stops, {LICENCE_NAME} AS is_name, {LICENCE_ADDRESS} OR regexp_matches(trim(text), '^[\\d/\\-]{{2,}}$') AS is_part FROM column_under),
heads_under AS (SELECT doc_id, CASE WHEN bool_or(n = 1 AND is_name) THEN 1 + CAST(bool_or(n = 2 AND is_name) AS INT) ELSE 0 END AS n_names, max(text) FILTER (n = 1) AS one_text, max(conf) FILTER (n = 1) AS one_conf, max(text) FILTER (n = 2) AS two_text, max(conf) FILTER (n = 2) AS two_conf FROM walk_under WHERE stops = 0 GROUP BY doc_id),
rest_under AS (SELECT doc_id, string_agg(trim(text), ', ' ORDER BY n) AS address, min(conf) AS conf FROM walk_under JOIN heads_under USING (doc_id) WHERE stops = 0 AND n > n_names AND n_names > 0 AND is_part GROUP BY doc_id),
late_dates AS (SELECT y.doc_id, no, regexp_extract(line, {q(P.FULL_DATE)}) AS date FROM text_lines l JOIN years y USING (doc_id) JOIN births b USING (doc_id) WHERE regexp_matches(line, {q(P.FULL_DATE)}) AND {iso(f"regexp_extract(line, {q(P.FULL_DATE)})")} NOT IN ('', born) AND issue_year > 0 AND CAST(regexp_extract({iso(f"regexp_extract(line, {q(P.FULL_DATE)})")}, '^\\d{{4}}') AS INT) = issue_year),
late AS (SELECT doc_id, arg_min(date, no) AS date FROM late_dates GROUP BY doc_id), late_conf AS ({conf_of("date", "late")}),
licences AS (SELECT y.doc_id, number AS license_number, {_pct("c.conf")} AS license_number_confidence, CASE WHEN coalesce(n_names, 0) > 0 THEN {name("trim(coalesce(one_text, ''))")} ELSE n.name END AS name, CASE WHEN coalesce(n_names, 0) > 0 THEN {_pct("one_conf")} ELSE {_pct("name_conf")} END AS name_confidence,
  CASE WHEN coalesce(n_names, 0) > 1 THEN {name("trim(coalesce(two_text, ''))")} ELSE guardian END AS swd, CASE WHEN coalesce(n_names, 0) > 1 THEN {_pct("two_conf")} ELSE {_pct("guardian_conf")} END AS swd_confidence, born AS dob, {_pct("bc.conf")} AS dob_confidence,
  trim(regexp_replace(coalesce(b.value, ''), '^[:\\s.]+', '')) AS blood_group, {_pct("b.conf")} AS blood_group_confidence, coalesce(r.address, a.address, '') AS address, {_pct("coalesce(r.conf, a.conf)")} AS address_confidence,
  CASE WHEN i.day IS NOT NULL THEN i.day WHEN l.date IS NOT NULL THEN {iso("l.date")} ELSE '' END AS issue_date, CASE WHEN i.day IS NOT NULL THEN {_pct("i.conf")} ELSE {_pct("lc.conf")} END AS issue_date_confidence
  FROM years y JOIN licence_names n USING (doc_id) JOIN births USING (doc_id) LEFT JOIN licence_addresses a USING (doc_id) LEFT JOIN blood_pair b USING (doc_id) LEFT JOIN raw_conf c USING (doc_id) LEFT JOIN birth_conf bc USING (doc_id) LEFT JOIN issued i USING (doc_id) LEFT JOIN heads_under USING (doc_id) LEFT JOIN rest_under r USING (doc_id) LEFT JOIN late l USING (doc_id) LEFT JOIN late_conf lc USING (doc_id))"""

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | {
    "drop_script_garbage": f"{TEXT} SELECT doc_id, count(*) AS n_lines FROM text_regions WHERE NOT {GARBAGE} GROUP BY doc_id",
    "name_above": f"{ORDERED}, {NAMED} SELECT doc_id, {name('coalesce(name_text, ' + q('') + ')')} AS value, coalesce(name_conf, 0.0) AS conf FROM docs LEFT JOIN anchored USING (doc_id)",
    "passport_back_names": f"""{ORDERED}, spots AS (SELECT doc_id, min(rn) AS spot FROM o WHERE regexp_matches(text, '(?i)ADDRESS') GROUP BY doc_id),
found AS (SELECT o.doc_id, text, row_number() OVER (PARTITION BY o.doc_id ORDER BY rn) AS n FROM o LEFT JOIN spots USING (doc_id) WHERE rn < coalesce(spot, 1000) AND {PASSPORT_NAME})
SELECT doc_id, {", ".join(f"{name(f'coalesce(max(text) FILTER (n = {i}), {q("")})')} AS {who}" for i, who in ((1, "father"), (2, "mother"), (3, "spouse")))} FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id""",
    "dob_ladder": f"{ORDERED}, {DOB} SELECT doc_id, dob, yob, raw, step FROM dob",
    "extract_aadhaar_front": f"{FRONT} SELECT * FROM front",
    "accuracy_report": _recursive(f"""{FRONT}, {spans("(SELECT regexp_replace(number, '[^0-9]', '', 'g') FROM numbers WHERE numbers.doc_id = docs.doc_id)")},
{repaired("(SELECT * FROM block WHERE n = 1)")}, truth AS ({truth_sql(duck=True)}),
wide AS (SELECT *, CASE field WHEN 'aadhaar_number' THEN aadhaar_number WHEN 'dob' THEN dob WHEN 'full_name' THEN full_name WHEN 'address' THEN b.address ELSE gender END AS got FROM truth LEFT JOIN front USING (doc_id) LEFT JOIN repaired b USING (doc_id)),
compared AS MATERIALIZED (SELECT field, regexp_replace(lower(coalesce(got, '')), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(want), '[^a-z0-9]', '', 'g') AS b FROM wide),
addresses AS MATERIALIZED (SELECT a, b FROM compared WHERE field = 'address'), {ratios("address_ratio", "addresses")},
marked AS (SELECT field, CASE WHEN field = 'address' THEN ratio >= 0.9 ELSE c.a = c.b END AS ok, CASE WHEN field = 'address' THEN ratio END AS ratio FROM compared c LEFT JOIN address_ratio r ON c.a = r.a AND c.b = r.b)
SELECT coalesce(field, 'ALL') AS field, count(*) FILTER (ok) AS ok, count(*) AS n, round(avg(ratio), 6) AS mean_similarity FROM marked GROUP BY ROLLUP (field)"""),
    "address_clusters": f"{ADDRESSES} SELECT doc_id, array_to_string(parts, ' | ') AS parts, round(conf, 6) AS conf FROM cluster",
    "best_address": f"{ADDRESSES} SELECT doc_id, address, round(conf, 6) AS conf FROM best",
    "split_address": f"{ADDRESSES} SELECT doc_id, address, {parts_of('address', 'parts')} FROM best",
    "state_repair": _recursive(f"{ADDRESSES}, {repaired('best')} SELECT doc_id, address FROM repaired"),
    "aadhaar_sides": f"""{ORDERED}, {DOB}, {GENDERS}, {NUMBERS}, {spans("(SELECT regexp_replace(number, '[^0-9]', '', 'g') FROM numbers WHERE numbers.doc_id = docs.doc_id)")},
sides AS (SELECT doc_id, number, step > 0 OR gender <> '' AS front, doc_id IN (SELECT doc_id FROM block) AS back FROM dob JOIN genders USING (doc_id) JOIN numbers USING (doc_id))
SELECT doc_id, 'aadhaar_front_bottom' AS document_type, number AS aadhaar_number FROM sides WHERE front OR NOT back UNION ALL SELECT doc_id, 'aadhaar_back', number FROM sides WHERE back""",
    "extract_aadhaar_back": _recursive(f"{BACK} SELECT doc_id, number AS aadhaar_number, {_pct('number_conf')} AS aadhaar_number_confidence, is_masked, address, {parts_of('address', 'parts')}, {_pct('conf')} AS address_confidence FROM back JOIN numbers USING (doc_id)"),
    "extract_voter_back": _recursive(f"""{ORDERED}, {spans("''")}, {repaired("(SELECT * FROM block WHERE n = 1)")}, sides AS (SELECT doc_id FROM docs WHERE contains(t, 'ADDRESS') AND NOT regexp_matches(replace(t, 'ELECTORAL', ''), 'ELECTOR|EPIC|PHOTO\\s*IDENTITY')),
back AS (SELECT doc_id, r.address, parts, conf FROM sides LEFT JOIN repaired r USING (doc_id) LEFT JOIN (SELECT * EXCLUDE (address) FROM block WHERE n = 1) USING (doc_id))
SELECT * EXCLUDE (care_of, relation) FROM (SELECT doc_id, coalesce(address, '') AS address, {parts_of("coalesce(address, '')", "parts")}, {_pct('conf')} AS address_confidence FROM back)"""),
    "extract_passport_front": f"{PASSPORT_FRONT} SELECT doc_id, {_front_select}, doi, doi_c AS doi_confidence, born_in AS place_of_birth, born_c AS place_of_birth_confidence, issued_in AS place_of_issue, issued_c AS place_of_issue_confidence FROM sure",
    "extract_passport_back": f"""{ORDERED}, backs AS (SELECT doc_id, t, regexp_extract(t, {q(r"\b([A-Z]{2}\d{13,14})\b")}, 1) AS file FROM spaced WHERE {BACK_SIDE}), file_conf AS ({conf_of("file", "(SELECT doc_id, file FROM backs) AS f")}),
spots AS (SELECT doc_id, min(rn) AS spot FROM o WHERE regexp_matches(text, '(?i)ADDRESS') GROUP BY doc_id),
people AS (SELECT o.doc_id, text, conf, row_number() OVER (PARTITION BY o.doc_id ORDER BY rn) AS n FROM o LEFT JOIN spots USING (doc_id) WHERE rn < coalesce(spot, 1000) AND {PASSPORT_NAME}),
three AS (SELECT doc_id, {", ".join(f"{name(f'coalesce(max(text) FILTER (n = {i}), {q("")})')} AS {who}, {_pct(f'max(conf) FILTER (n = {i})')} AS {who}_confidence" for i, who in ((1, "father"), (2, "mother"), (3, "spouse")))} FROM people GROUP BY doc_id),
old AS ({oracles.ORACLE_SQL["value_after"].replace(oracles.CARDS, "WITH old_start AS (SELECT 1)")}), home AS ({oracles.ORACLE_SQL["passport_address"].replace(oracles.CARDS, "WITH home_start AS (SELECT 1)").replace("round(conf, 6) AS conf", "conf")})
SELECT doc_id, coalesce(address, '') AS address, {_pct("h.conf")} AS address_confidence, father, father_confidence, mother, mother_confidence, file AS file_num, {_pct("f.conf")} AS file_num_confidence, coalesce(o.value, '') AS old_passport_num, {_pct("o.conf")} AS old_passport_num_confidence,
  coalesce(h.pin, '') AS pin, CASE WHEN coalesce(h.pin, '') <> '' THEN {_pct("h.conf")} ELSE 0 END AS pin_confidence, spouse, spouse_confidence FROM backs JOIN three USING (doc_id) LEFT JOIN file_conf f USING (doc_id) LEFT JOIN old o USING (doc_id) LEFT JOIN home h USING (doc_id)""",
    "extract_voter_front": f"""{VOTER_FRONT} SELECT f.doc_id, CASE WHEN p.own IS NOT NULL THEN {name("coalesce(p.own, '')")} ELSE {name("coalesce(g.text, '')")} END AS full_name, {_pct("coalesce(p.conf, g.conf)")} AS full_name_confidence, coalesce(CAST(years AS VARCHAR), '') AS age, CASE WHEN years IS NOT NULL THEN {_pct("r.conf")} ELSE 0 END AS age_confidence,
  {name("coalesce(q.relation, '')")} AS care_of, {_pct("q.conf")} AS care_of_confidence, dob, {_pct("r.conf")} AS dob_confidence, CASE WHEN card <> '' THEN regexp_extract(card, '\\d{{4}}$') || '-' || lpad(regexp_extract(card, '^\\d+.(\\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(card, '^\\d+'), 2, '0') ELSE '' END AS doc, {_pct("c.conf")} AS doc_confidence,
  CASE word WHEN 'MALE' THEN 'M' WHEN 'FEMALE' THEN 'F' WHEN 'TRANSGENDER' THEN 'T' ELSE coalesce(z.value, '') END AS gender, CASE WHEN word <> '' THEN {_pct("w.conf")} ELSE {_pct("z.conf")} END AS gender_confidence, epic AS epic_number, {_pct("e.conf")} AS epic_number_confidence
  FROM fronts f JOIN aged USING (doc_id) JOIN cards_found USING (doc_id) LEFT JOIN printed p USING (doc_id) LEFT JOIN guesses g USING (doc_id) LEFT JOIN parents q USING (doc_id) LEFT JOIN raw_conf r USING (doc_id) LEFT JOIN card_conf c USING (doc_id) LEFT JOIN word_conf w USING (doc_id) LEFT JOIN fuzzy z USING (doc_id) LEFT JOIN epic_conf e USING (doc_id)""",
    "choose_attempt": f"{ATTEMPTS} SELECT doc_id, CASE WHEN is_full = 1 THEN 'full' ELSE 'crop' END AS attempt FROM chosen",
    "verify_outcomes": f"""{ATTEMPTS}, shown AS (SELECT *, actual AS doc_type, number AS extracted_id FROM outcomes)
SELECT doc_id, intended, actual, CASE WHEN is_full = 1 THEN 'full' ELSE 'crop' END AS attempt, CASE WHEN error_code IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status, error_code, CASE WHEN error_code IS NULL THEN number END AS extracted_id, CASE WHEN error_code IS NULL THEN {MASK} END AS masked_id,
  error_code IS NULL AND extracted = '' AND masked4 <> '' AS already_masked, round(avg_confidence, 6) AS avg_confidence, 'rapidocr' AS engine, 'located ' || n_regions || ' regions; surya_fallback=no; retry_uncropped=' || CASE WHEN retried THEN 'yes' ELSE 'no' END AS reason FROM shown""",
    "failure_json": f"""{ATTEMPTS}, codes(error_code, http_status, retryable) AS (VALUES {oracles._codes})
SELECT doc_id, '{{"data":{{}},"status_code":' || http_status || ',"message_code":"failed","message":"' || CASE WHEN error_code = 'document_mismatch' THEN 'Expected ' || intended || ', got ' || actual ELSE 'ID extraction failed' END || '","success":false,"error_code":"' || error_code || '"}}' AS json FROM outcomes JOIN codes USING (error_code)""",
    "mask_boxes_merged": f"{PIECES}, {_FOLD} SELECT doc_id, box_no, x1, y1, x2, y2 FROM boxes",
    "mask_rects": f"{RECTS} SELECT doc_id, field, x1, y1, x2, y2, conf FROM rects",
    "mask_report": f"""{RECTS}, {MASKED_LINE}, digits4 AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE doc_id NOT IN (SELECT doc_id FROM one)),
spots AS (SELECT doc_id, list({{'field': field, 'bbox': [x1, y1, x2 - x1, y2 - y1], 'confidence': round_even(conf, 2)}} ORDER BY field, x1, y1) AS regions FROM rects GROUP BY doc_id),
judged AS (SELECT i.doc_id, doc_type, extracted_id IS NOT NULL AS has_id, extracted_id IS NULL AND doc_type = 'AADHAAR' AND value IS NOT NULL AS already, coalesce(regions, []) AS found FROM ids i LEFT JOIN spots USING (doc_id) LEFT JOIN digits4 USING (doc_id)),
listed AS (SELECT *, CASE WHEN already THEN list_transform(found, lambda x: {{'field': 'vid', 'bbox': x.bbox, 'confidence': x.confidence}}) WHEN has_id THEN found ELSE [] END AS regions FROM judged)
SELECT doc_id, has_id OR already AS document_detected, already AS already_masked, CAST(to_json(regions) AS VARCHAR) AS masked_regions, CAST(len(regions) AS INT) AS n_regions, NOT already AND len(regions) = 0 AS withheld,
  CASE WHEN already THEN 'Aadhaar number is already masked on the document' WHEN len(regions) > 0 THEN NULL WHEN has_id THEN 'Identity number found but could not be localized for masking' ELSE 'No ' || doc_type || ' identity number located' END AS message FROM listed""",
    "outcome_code_windows": f"{oracles.OUTCOMES}, codes(code, http_status, retryable) AS (VALUES ('', 200, false), {oracles._codes}) SELECT date_trunc('hour', ts) AS window_start, code AS error_code, CAST(http_status AS INT) AS http_status, retryable, count(*) AS n, round(avg(elapsed_sec), 6) AS mean_sec FROM outcomes JOIN codes ON code = coalesce(error_code, '') GROUP BY ALL",
    "outcome_sliding": f"{oracles.OUTCOMES} SELECT time_bucket(INTERVAL 15 MINUTE, ts) - back * INTERVAL 15 MINUTE AS window_start, count(*) AS n, count(error_code) AS n_failed, count(*) FILTER (error_code = 'timeout') AS n_timeouts, round(count(error_code) / count(*), 6) AS failure_rate FROM outcomes, range(4) r(back) GROUP BY 1",
    "outcome_alerts": f"{oracles.OUTCOMES} SELECT date_trunc('hour', ts) - back * INTERVAL 1 HOUR AS window_start, count(*) AS n, count(error_code) AS n_failed, count(*) FILTER (error_code = 'timeout') AS n_timeouts, round(count(error_code) / count(*), 6) AS failure_rate FROM outcomes, range(6) r(back) GROUP BY 1 HAVING count(*) >= 5 AND count(error_code) / count(*) > 0.22",
    "identity_contracts": f"""{IDS}, kinds(k, internal, display, id_field) AS (VALUES {oracles._types})
SELECT doc_id, doc_type, extracted_id, CASE WHEN extracted_id IS NOT NULL THEN {MASK} END AS masked_id, CASE WHEN extracted_id IS NULL THEN 'id_not_found' END AS error_code,
  CASE WHEN extracted_id IS NULL THEN '{{"data":{{}},"status_code":400,"message_code":"failed","message":"ID extraction failed","success":false,"error_code":"id_not_found"}}'
  ELSE '{{"data":{{"ocr_fields":[{{"document_type":"' || k || '","id_field":"' || id_field || '","id_number":"' || extracted_id || '"}}]}},"status_code":200,"message_code":"success","message":null,"success":true}}' END AS json FROM ids LEFT JOIN kinds ON internal = doc_type""",
    "dedup_horizon": """WITH RECURSIVE seen AS (SELECT event_id AS doc_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
kept AS (SELECT user_id, n, ts FROM seen WHERE n = 1
  UNION ALL SELECT k.user_id, min(s.n), arg_min(s.ts, s.n) FROM kept k JOIN seen s ON s.user_id = k.user_id AND s.ts > k.ts + INTERVAL 1 DAY GROUP BY k.user_id, k.n)
SELECT doc_id, s.ts, sha256(CAST(user_id AS VARCHAR)) AS uniqueness_id FROM seen s SEMI JOIN kept USING (user_id, n)""",
    "normalised_text": """WITH w AS (SELECT doc_id, text, replace(replace(replace(replace(translate(text, '0123456789.,:!', '０１２３４５６７８９．，：！'), 'fi', 'ﬁ'), 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), 'kg', '㎏') AS wide FROM documents)
SELECT doc_id, CAST(length(wide) AS INT) AS n_wide, CAST(length(nfc_normalize(text)) AS INT) AS n_chars, sha256(nfc_normalize(text)) AS text_sha256 FROM w""",
    "regions_round_trip": f"""{oracles.CARDS}, cases AS (SELECT *, (doc_id * 7 + region_idx) % 29 AS c FROM card_regions)
SELECT doc_id, 'good' AS state, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY region_idx)) AS text_sha256 FROM cases WHERE c NOT IN (1, 3, 5) GROUP BY doc_id
UNION ALL SELECT NULL, CASE c WHEN 1 THEN 'not json' WHEN 3 THEN 'no key' ELSE 'no box' END, count(*), '' FROM cases WHERE c IN (1, 3, 5) GROUP BY ALL""",
    "uploads_scanned": f"{oracles.CARDS} SELECT doc_id % 8 AS folder, '.txt' AS suffix, CAST(sum(1 + coalesce(strlen(text), 0)) AS BIGINT) AS n_bytes FROM card_regions GROUP BY ALL",
    "truth_round_trip": f"""{oracles.CARDS}, truth AS ({truth_sql(duck=True)})
SELECT 'card_' || doc_id AS doc_id, side, field, want FROM truth WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0
UNION ALL SELECT NULL, 'damaged', 'lines', CAST(count(DISTINCT doc_id) AS VARCHAR) FROM truth WHERE doc_id % 13 = 0 OR doc_id % 17 = 0 HAVING count(*) > 0""",
    "value_below": f"{DOCS}, {label_rows('people_label', "regexp_matches(text, '(?i)^Name of (?:Father|Mother)$')", 'NAME')}, {under('below_label', 'people_label', LICENCE_NAME)} SELECT doc_id, trim(text) AS value, conf FROM below_label",
    "licence_names": f"{DOCS}, {LICENCE_NAMES} SELECT * FROM licence_names",
    "licence_address": f"{DOCS}, {LICENCE_ADDRESSES} SELECT * FROM licence_addresses WHERE address <> ''",
    "extract_licence": f"{LICENCE} SELECT * FROM licences",
}


def contract(name: str, job: str, fields: str) -> str:
    """The contracts of a job's rows, from its own oracle; a field with a star has a confidence."""
    one = lambda f: f"'{f[:-1]}': {{'value': {f[:-1]}, 'confidence': {f[:-1]}_confidence}}" if f.endswith("*") else f"'{f}': {f}"
    body = f"CAST(to_json({{'document_type': {q(name)}, {', '.join(map(one, fields.split()))}}}) AS VARCHAR)"
    shell = f"""'{{"data":{{"ocr_fields":[' || {body} || ']}},"status_code":200,"message_code":"success","message":null,"success":true}}'"""
    return f"SELECT doc_id, {q(name)} AS document_type, {shell} AS json FROM ({ORACLE_SQL[job]})"


_parts = "zip care_of relation country state house_number district city"
ORACLE_SQL["contracts_all"] = " UNION ALL ".join(
    (
        contract("pan", "extract_pan", "pan_number* full_name* father_name* dob*"),
        contract("aadhaar_front_bottom", "extract_aadhaar_front", "full_name* gender* dob* yob aadhaar_number* is_masked uniqueness_id"),
        contract("aadhaar_back", "extract_aadhaar_back", f"aadhaar_number* is_masked address* {_parts}"),
        contract("passport_front", "extract_passport_front", "country_code* dob* doe* doi* gender* given_name* nationality* passport_num* place_of_birth* place_of_issue* surname* mrz_line_1* mrz_line_2* type_of_passport*"),
        contract("passport_back", "extract_passport_back", "address* father* mother* file_num* old_passport_num* pin* spouse*"),
        contract("driving_license", "extract_licence", "license_number* name* swd* dob* blood_group* address* issue_date*"),
        contract("voter_front", "extract_voter_front", "full_name* age* care_of* dob* doc* gender* epic_number*"),
        contract("voter_back", "extract_voter_back", "address* zip country state house_number district city"),
    )
)
