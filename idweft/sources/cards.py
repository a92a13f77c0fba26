"""Card-shaped documents derived row by row from ``customer``: pure arithmetic on the key.

One text makes the SQL of both dialects, so that Spark and DuckDB derive the same rows.
Names and numbers are invented.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idweft.sources.scratch import once

GIVEN = ("AARAV", "ISHAAN", "KABIR", "MEERA", "NISHA", "POOJA", "RAHUL", "TANVI")
FAMILY = ("GUPTA", "VERMA", "SHARMA", "PATIL", "PALANDE", "KULKARNI", "REDDY", "SINGH")
TYPES = ("AADHAAR", "PAN", "VOTER_ID", "DRIVING_LICENSE", "PASSPORT")
#: State names as they are printed on the backs, most of them garbled, and what they stand for. The
#: last ones stay as they are: a town like a state's name, and a state in other letters.
PRINTED_STATES = (
    "West Sengal", "Punjab", "UtarPradesh", "Gjarat", "Karnatka", "Tamil Nadv", "Maharashtre", "Rajasthaan", "Telangama", "Andhra Pradech",
    "Himachal Pradeh", "Jharkhamd", "Chhatisgarh", "Jammu and Kashmlr", "Haryali", "MADHYA PRADESH",
)
MEANT_STATES = (
    "West Bengal", "Punjab", "Uttar Pradesh", "Gujarat", "Karnataka", "Tamil Nadu", "Maharashtra", "Rajasthan", "Telangana", "Andhra Pradesh",
    "Himachal Pradesh", "Jharkhand", "Chhattisgarh", "Jammu And Kashmir", "Haryali", "Madhya Pradesh",
)
CARE_OF = ("S/O: ", "W/O: ", "C/O: ", "D/O: ", "Wife of ", "H/O: ", "Son of ")


class Dialect:
    """What the two engines write differently."""

    def __init__(self, duck: bool):
        self.duck = duck

    def div(self, a, b):
        return f"({a} // {b})" if self.duck else f"({a} div {b})"

    def pick(self, words, i):
        items = ", ".join(f"'{w}'" for w in words)
        return f"list_extract([{items}], CAST({i} AS INT) + 1)" if self.duck else f"element_at(array({items}), CAST({i} AS INT) + 1)"

    def day(self, n):
        return f"(DATE '1960-01-01' + CAST({n} AS INT))" if self.duck else f"date_add(DATE '1960-01-01', CAST({n} AS INT))"

    def date(self, d, java, c):
        return f"strftime({d}, '{c}')" if self.duck else f"date_format({d}, '{java}')"

    def pad(self, n, width):
        return f"lpad(CAST({n} AS VARCHAR(40)), {width}, '0')" if self.duck else f"lpad(CAST({n} AS STRING), {width}, '0')"

    def line(self, text, x, row):
        return f"{{'t': {text}, 'x': {x}, 'r': {row}}}" if self.duck else f"named_struct('t', {text}, 'x', {x}, 'r', {row})"

    def lines(self, *rows):
        """Rows are (text SQL, x, row number); the row number goes up by one where it is left out."""
        got, r = [], -1
        for text, x, *row in rows:
            r = row[0] if row else r + 1
            got.append(self.line(text, x, r))
        return f"[{', '.join(got)}]" if self.duck else f"array({', '.join(got)})"

    def unnest(self, source):
        if self.duck:
            return f"SELECT * EXCLUDE (lines), unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM {source}"
        return f"SELECT *, pos, line FROM {source} LATERAL VIEW posexplode(lines) e AS pos, line"


def cards_sql(duck: bool) -> str:
    """A WITH list of ``cards`` (one row a document) and ``card_regions``; ``customer`` must be a view."""
    d = Dialect(duck)
    dmy = lambda x: d.date(x, "dd/MM/yyyy", "%d/%m/%Y")
    dash = lambda x: d.date(x, "dd-MM-yyyy", "%d-%m-%Y")
    ymd = lambda x: d.date(x, "yyMMdd", "%y%m%d")
    num = "substr(aadhaar, 1, 4) || ' ' || substr(aadhaar, 5, 4) || ' ' || substr(aadhaar, 9, 4)"
    issue, dob = "issue_day", "birth_day"
    sex = "CASE WHEN k % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END"
    both_sexes = f"CASE WHEN {d.div('k', 20)} % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'पुरुष' ELSE 'महिला' END ELSE {sex} END"
    year_only = f"{d.div('k', 20)} % 4 = 2"
    wrapped = f"{d.div('k', 5)} % 3 = 1"
    state = d.pick(PRINTED_STATES, d.div("k", 7) + f" % {len(PRINTED_STATES)}") + " || ' - ' || CASE WHEN k % 3 = 0 THEN '713205' ELSE '140301' END"
    name, father = "given || ' ' || family", "parent || ' ' || family"
    care = d.pick(CARE_OF, d.div("k", 5) + f" % {len(CARE_OF)}")
    town = f"CASE WHEN {wrapped} THEN 'VTC: Kharar, DIST:' ELSE 'VTC: Kharar, DIST: Mohali' END"
    last = f"CASE WHEN {wrapped} THEN 'Mohali, ' ELSE '' END || {state}"
    back = [("'Unique Identification Authority of India'", 40), ("'Address:'", 40), (f"{care} || {father} || ', House No 12'", 40), (town, 40), (last, 40), ("'help@uidai.gov.in'", 40)]
    layouts = {
        ("AADHAAR", 0): [("'GOVERNMENT OF INDIA'", 40), (name, 40), (f"'DOB: ' || {dmy(dob)}", 40), (both_sexes, 40), (num, 40), *back],
        ("AADHAAR", 1): [("'GOVERNMENT OF INDIA'", 40), ("given || family", 40), (f"CASE WHEN {year_only} THEN 'Year of Birth: ' || CAST(year({dob}) AS VARCHAR(4)) ELSE 'D0B:' || {dmy(dob)} END", 40), (sex, 40), ("'XXXX XXXX ' || substr(aadhaar, 9, 4)", 40), *back],
        ("AADHAAR", 2): [("'GOVERNMENT OF INDIA'", 40), (name, 40), (f"'9000:' || {dmy(dob)}", 40), (sex, 40), ("'XXXX XXXX'", 40), ("substr(aadhaar, 9, 4)", 160, 4), ("'help@uidai.gov.in'", 40, 5)],
        ("PAN", 0): [("'INCOME TAX DEPARTMENT'", 40), ("'GOVT. OF INDIA'", 300, 0), (name, 40, 1), (father, 40), (dmy(dob), 40), ("'Permanent Account Number'", 40), ("pan", 40)],
        ("PAN", 1): [("'INCOME TAX DEPARTMENT'", 40), ("given || family", 40), ("parent || family", 40), (dmy(dob), 40), ("'Permanent Account Number'", 40), ("pan", 40)],
        ("PAN", 2): [("'INCOME TAX DEPARTMENT'", 40), (name, 40), (father, 40), (dmy(dob), 40), ("'Permanent Account Number'", 40), ("pan", 300, 4)],
        ("VOTER_ID", 0): [("'ELECTION COMMISSION OF INDIA'", 40), ("epic", 300), (f"'ELECTOR''SNAME:' || {name}", 40), (f"'Father''s Name: ' || {father}", 40), (f"'Gender: ' || {sex}", 40), (f"'Date of Birth / Age : ' || {dash(dob)}", 40)],
        ("VOTER_ID", 1): [("epic", 40), ("'Address: House No 12 Gandhi Road'", 40), ("'Sector 7, Tehsil Kharar'", 40), ("'Dist Mohali, Punjab - 140301'", 40), ("'Electoral Registration Officer'", 40)],
        ("VOTER_ID", 2): [("'ELECTION COMMISSION OF INDIA'", 40), ("epic", 300), (name, 40), (f"'HUSBAND''S NAME:' || {father}", 40), ("'Sex'", 40), ("'gw/MaIe'", 300, 4), (f"'Age : ' || {dash(dob)}", 40, 5), (dash(issue), 40)],
        ("DRIVING_LICENSE", 0): [("'DRIVING LICENCE'", 40), ("'DL No'", 40), ("dl", 300, 1), ("'NAME'", 40, 2), (name, 300, 2), ("'S/O'", 40, 3), (father, 300, 3), ("'DOB'", 40, 4), (dash(dob), 300, 4), ("'Blood Grp'", 40, 5), ("'B+'", 300, 5), ("'Address'", 40, 6), ("'House 12 Sector 7'", 300, 6), ("'Kharar Mohali 140301'", 300, 7), ("'Issue Date'", 40, 8), (dash(issue), 300, 8)],
        ("DRIVING_LICENSE", 1): [("'DRIVING LICENCE'", 40), ("'DLNO' || dl", 40), (f"'NAME ' || {name}", 40), (f"'S/DOf ' || {father}", 40), (f"'DOB:' || {dash(dob)}", 40), ("'BG: O+'", 40), ("'Add: 45 MG Road'", 40), ("'Pune Maharashtra 411001'", 40), (f"'Issue Date ' || {d.date(issue, 'dd-MMM-yyyy', '%d-%b-%Y')}", 40)],
        ("DRIVING_LICENSE", 2): [("'DRIVING LICENCE'", 40), ("'DLFAP' || substr(dl, 8, 8) || substr(dl, 5, 4)", 40), (name, 40), (father, 40), ("'7-34'", 40), ("'RUDRUR VILLAGE'", 40), (dash(issue), 300, 7)],
        ("PASSPORT", 0): [("'REPUBLIC OF INDIA'", 40), ("'PASSPORT'", 40), ("'Place of Birth: MOHALI'", 40), ("'Place of Issue: CHANDIGARH'", 40), (f"'Date of Issue: ' || {dmy(issue)}", 40), ("rpad('P<IND' || family || '<<' || given, 44, '<')", 40), (f"rpad(passport || '<0IND' || {ymd(dob)} || '0' || substr({sex}, 1, 1) || {ymd(issue)} || '0', 44, '<')", 40)],
        ("PASSPORT", 1): [("'Name of Father'", 40), (father, 40), ("'Name of Mother'", 40), ("parent || ' DEVI'", 40), ("'Address'", 40), ("'12 Rose Lane, Kharar'", 40), ("'PIN:140301, PUNJAB, INDIA'", 40), ("'Old Passport No'", 40), ("passport", 40), ("'File No'", 40), (f"'CH' || {d.pad('k', 13)}", 40)],
        ("PASSPORT", 2): [("'REPUBLIC OF INDIA'", 40), ("'PASSPORT'", 40), ("passport", 300), (f"'Date of Birth ' || {dmy(dob)}", 40), (sex, 40), (f"'Date of Expiry ' || {dmy(issue)}", 40)],
    }
    # a branch for each class: as one expression they would be too large for one generated method
    cases = {t: " ".join(f"WHEN layout = {v} THEN {d.lines(*rows)}" for (u, v), rows in layouts.items() if u == t) for t in TYPES}
    branches = " UNION ALL ".join(f"SELECT *, CASE {case} END AS lines FROM cards WHERE shown = '{t}'" for t, case in cases.items())
    letters = "'0123456789', 'ABCDEFGHIJ'"
    ten = "100000000000"
    return f"""
card_keys AS (
  SELECT c_custkey AS k, {d.pick(TYPES, "c_custkey % 5")} AS doc_type, CAST({d.div("c_custkey", 5)} % 4 AS INT) AS variant,
    {d.pick(GIVEN, "c_custkey % 8")} AS given, {d.pick(FAMILY, d.div("c_custkey", 8) + " % 8")} AS family, {d.pick(GIVEN, d.div("c_custkey", 3) + " % 8")} AS parent,
    {d.day("(c_custkey * 37) % 14000")} AS birth_day, {d.day("(c_custkey * 37) % 14000 + 7000 + c_custkey % 2000")} AS issue_day,
    '2' || {d.pad(f"({d.div('c_custkey', 10)} * 7919) % {ten}", 11)} AS aadhaar,
    translate({d.pad("c_custkey % 100000", 5)}, {letters}) || {d.pad("c_custkey % 10000", 4)} || 'K' AS pan,
    translate({d.pad("c_custkey % 1000", 3)}, {letters}) || {d.pad("(c_custkey * 31) % 10000000", 7)} AS epic,
    'A' || {d.pad("c_custkey % 10000000", 7)} AS passport
  FROM customer),
cards AS (
  SELECT *, 'HR41' || CAST(year(issue_day) AS VARCHAR(4)) || {d.pad("k % 10000000", 7)} AS dl,
    CASE WHEN variant = 3 THEN {d.pick(TYPES, "(k + 1) % 5")} ELSE doc_type END AS shown, CASE WHEN variant = 3 THEN 0 ELSE variant END AS layout
  FROM card_keys),
card_lines AS ({branches}),
card_rows AS ({d.unnest("card_lines")}),
card_regions AS (
  SELECT k AS doc_id, 'crop' AS attempt, CAST(pos AS INT) AS region_idx, line.t AS text,
    (50 + (k * 7 + pos * 13) % 51) / CAST(100 AS DOUBLE) AS conf, CAST(line.x AS INT) AS x1,
    CAST(40 + 45 * line.r + CASE WHEN variant = 2 AND line.x = 300 THEN 6 ELSE 0 END AS INT) AS y1, CAST(line.x + 12 * length(line.t) AS INT) AS x2,
    CAST(40 + 45 * line.r + CASE WHEN variant = 2 AND line.x = 300 THEN 6 ELSE 0 END + 24 AS INT) AS y2, 'rapidocr' AS engine,
    CASE WHEN k % 11 = 0 THEN '180' ELSE '0' END AS cls_label, CAST(0.95 AS DOUBLE) AS cls_score
  FROM card_rows),
attempt_regions AS (
  SELECT * FROM card_regions WHERE NOT (doc_id % 6 = 0 AND region_idx % 2 = 0)
  UNION ALL
  SELECT doc_id, 'full' AS attempt, region_idx, text, conf, x1, y1, x2, y2, engine, cls_label, cls_score FROM card_regions WHERE doc_id % 6 = 0)"""


def _view(spark: SparkSession, sf_dir: str, name: str, columns: str = "*") -> DataFrame:
    sql = f"WITH {cards_sql(duck=False)} SELECT {columns} FROM {name}"

    source = f"{sf_dir}/customer.parquet"

    def make() -> DataFrame:
        keys = spark.read.parquet(source).select("c_custkey")
        return spark.sql(sql.replace("FROM customer)", "FROM {keys})"), keys=keys)

    return once(spark, make, source, sql)


def card_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines of one read of every card."""
    return _view(spark, sf_dir, "card_regions")


def attempt_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two reads where the crop lost lines."""
    return _view(spark, sf_dir, "attempt_regions")


def card_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, doc_type, did_crop``: what each card was uploaded as."""
    return _view(spark, sf_dir, "cards", "k AS doc_id, doc_type, k % 6 = 0 AS did_crop")


def card_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the Aadhaar cards, one in ten altered; of the addresses some are somewhat longer."""
    return _view(spark, sf_dir, f"({truth_sql(duck=False)}) t")


def truth_sql(duck: bool) -> str:
    """Labels ``doc_id, side, field, want``; ``cards`` must be there.

    Eleven letters that no address holds leave its similarity just above 0.9, sixteen just below.
    """
    d = Dialect(duck)
    day, m = d.date("birth_day", "yyyy-MM-dd", "%Y-%m-%d"), d.div("k", 20)
    meant = d.pick(MEANT_STATES, d.div("k", 7) + f" % {len(MEANT_STATES)}") + " || ' - ' || CASE WHEN k % 3 = 0 THEN '713205' ELSE '140301' END"
    address = f"{d.pick(CARE_OF, d.div('k', 5) + f' % {len(CARE_OF)}')} || parent || ' ' || family || ', House No 12, VTC: Kharar, DIST: Mohali, ' || {meant}"
    return f"""
SELECT k AS doc_id, 'front' AS side, 'aadhaar_number' AS field, CASE WHEN k % 10 = 0 THEN '0' || aadhaar ELSE aadhaar END AS want FROM cards WHERE shown = 'AADHAAR' AND layout = 0
UNION ALL SELECT k, 'front', 'dob', CASE WHEN (k + 1) % 10 = 0 THEN '1901-01-01' WHEN layout = 1 AND {m} % 4 = 2 THEN substr({day}, 1, 4) ELSE {day} END FROM cards WHERE shown = 'AADHAAR' AND layout < 2
UNION ALL SELECT k, 'front', 'full_name', CASE WHEN (k + 2) % 10 = 0 THEN 'NOBODY' ELSE given || ' ' || family END FROM cards WHERE shown = 'AADHAAR' AND layout = 0
UNION ALL SELECT k, 'front', 'gender', CASE WHEN (k + 3) % 10 = 0 THEN 'T' WHEN k % 2 = 0 THEN 'M' ELSE 'F' END FROM cards WHERE shown = 'AADHAAR'
UNION ALL SELECT k, 'back', 'address', CASE WHEN k % 9 = 0 THEN 'NOWHERE' ELSE {address} || CASE k % 9 WHEN 1 THEN ' qqqqqqqqqqq' WHEN 2 THEN ' qqqqqqqqqqqqqqqq' ELSE '' END END FROM cards WHERE shown = 'AADHAAR' AND layout < 2"""
