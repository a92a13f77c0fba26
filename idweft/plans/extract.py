"""Extraction jobs: regions in, one typed row for each document out.

Each job is one shuffle (a document's lines into an array) and functions of that array.
Every field comes as a value and its confidence; what isn't found is '' with confidence 0.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweft.functions import columns as C
from idweft.functions import patterns as P
from idweft.operators import blocks as B
from idweft.operators import classify as K
from idweft.operators import pairing as R
from idweft.operators.pages import before, conf_for, conf_of, first, let, pages, place, staged, stages_of, text_of

Keys = tuple[str, ...]
AS_OF = dt.date(2026, 1, 1)


def _columns(fields: dict[str, tuple[Column, Column | None]]) -> dict[str, Column]:
    """One column for each value, and ``<name>_confidence`` (0 to 100) where it has one."""
    out = {}
    for name, (value, conf) in fields.items():
        out[name] = value
        if conf is not None:
            out[f"{name}_confidence"] = C.confidence(conf)
    return out


def _wide(page: DataFrame, keys: Keys, fields: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    return page.select(*keys, *[c.alias(n) for n, c in _columns(fields).items()])


def _staged(page: DataFrame, keys: Keys, make: Callable[..., list[dict[str, Column]]], *args) -> DataFrame:
    """``page`` with each stage's columns added, ``keys`` and those of the last one selected."""
    *stages, last = stages_of(page, make, *args)
    for stage in stages:
        page = page.withColumns(stage)
    return page.select(*keys, *[c.alias(n) for n, c in last.items()])


def extract_pan(regions: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    page = pages(regions, keys)
    number, dob = C.found(page.full_text, P.PAN), C.found(page.full_text, P.PAN_DATE, 1)
    page = page.withColumn("number", number).withColumn("dob", dob)
    father, holder = R.above_dob(page.ordered, page.dob)
    return _wide(page, keys, {
        "pan_number": (page.number, conf_for(page.lines, page.number)), "full_name": (C.clean_name(text_of(holder)), conf_of(holder)),
        "father_name": (C.clean_name(text_of(father)), conf_of(father)), "dob": (page.dob, conf_for(page.lines, page.dob)),
    })


# ---- Aadhaar


def dated(full_text: Column, rx: str, context: int, same_line: bool) -> Column:
    """Every match of a date pattern with the text before it: ``array<struct<raw, context>>``."""
    gaps, hits = F.split(full_text, rx, -1), F.regexp_extract_all(full_text, F.lit(rx), F.lit(0))

    def one(hit: Column, i: Column) -> Column:
        earlier = F.concat(F.array_join(F.transform(F.slice(hits, F.lit(1), i), lambda h, k: F.concat(F.get(gaps, k), h)), ""), F.get(gaps, i))
        near = F.element_at(F.split(earlier, "\n"), -1) if same_line else earlier
        return F.struct(hit.alias("raw"), F.right(near, F.lit(context)).alias("context"))

    return F.transform(hits, one)


def dob_steps(lines: Column, full_text: Column, as_of: Column) -> list[Column]:
    """The steps of the birth-date ladder, each ``struct<value, yob, raw>`` or null.

    A labelled date; labelled digits without separators; a labelled year; the earliest of two
    or more dates that isn't an issue date; a date right above the gender line.
    """
    ok = lambda iso: C.plausible_dob(iso, as_of)
    dates = F.transform(dated(full_text, P.FULL_DATE, 24, True), lambda d: F.struct(C.dmy_to_iso(d["raw"]).alias("iso"), d["raw"].alias("raw"), d["context"].alias("context")))
    good = F.filter(dates, lambda d: ok(d["iso"]))
    issue = lambda d: d["context"].rlike(P.ISSUE_LABEL)
    step = lambda test, value, yob, raw: F.when(test, F.struct(value.alias("value"), F.lit(yob).alias("yob"), raw.alias("raw")))
    labelled = F.get(F.filter(good, lambda d: d["context"].rlike(P.DOB_LABEL) & ~issue(d)), 0)
    loose = C.found(full_text, P.DOB_LOOSE, 1)
    digits, year = C.dob_from_digits(loose, as_of), C.found(full_text, P.DOB_YEAR, 1)
    oldest = F.get(F.array_sort(F.transform(F.filter(good, lambda d: ~issue(d)), lambda d, i: F.struct(d["iso"].alias("iso"), i.alias("i"), d["raw"].alias("raw")))), 0)
    genders = F.filter(lines, lambda x: x["text"].rlike(P.GENDER))

    def above_gender(d: Column) -> Column:
        def near(x: Column) -> Column:
            h = F.greatest(F.lit(1), x["y2"] - x["y1"])
            return F.contains(F.upper(x["text"]), d["raw"]) & F.exists(genders, lambda g: (g["y1"] - x["y1"] > 0) & (g["y1"] - x["y1"] <= 2.5 * h) & (F.abs(g["x1"] - x["x1"]) <= 3 * h))

        return F.exists(lines, near)

    placed = F.get(F.filter(good, lambda d: ~issue(d) & above_gender(d)), 0)
    return [
        step(labelled.isNotNull(), labelled["iso"], False, labelled["raw"]), step(digits != "", digits, False, loose), step(ok(year), year, True, year),
        step((F.size(good) >= 2) & oldest.isNotNull(), oldest["iso"], False, oldest["raw"]), step(placed.isNotNull(), placed["iso"], False, placed["raw"]),
    ]


def extract_dob(regions: DataFrame, keys: Keys = ("doc_id",), as_of: dt.date = AS_OF) -> DataFrame:
    """``keys, dob, yob, raw, step``: the first step of the ladder that finds a date."""
    page = pages(regions, keys)
    steps = dob_steps(page.lines, page.full_text, F.lit(as_of))
    number = F.coalesce(*[F.when(s.isNotNull(), i + 1) for i, s in enumerate(steps)], F.lit(0))
    best = page.select(*keys, F.coalesce(*steps).alias("b"), number.alias("step"))
    return best.select(*keys, C.blank(F.col("b.value")).alias("dob"), F.coalesce("b.yob", F.lit(False)).alias("yob"), C.blank(F.col("b.raw")).alias("raw"), "step")


def _aadhaar(regions: DataFrame, keys: Keys, as_of: dt.date) -> DataFrame:
    """What both sides need: the number, the birth date, the gender, and the address block."""
    return staged(pages(regions, keys), _aadhaar_stages, as_of)


def _aadhaar_stages(as_of: dt.date) -> list[dict[str, Column]]:
    text, lines = F.col("full_text"), F.col("lines")
    stages = [{"masked": R.masked_number(lines), "printed": F.regexp_replace(C.found(text, P.AADHAAR), r"\s+", ""), "born": F.coalesce(*dob_steps(lines, text, F.lit(as_of))), "english": B.english_lines(F.col("ordered"))}]
    is_masked = (F.col("printed") == "") & (F.col("masked.value") != "")
    stages.append({"is_masked": is_masked})
    number = F.when(F.col("is_masked"), F.concat(F.lit("XXXXXXXX"), F.col("masked.value"))).otherwise(F.col("printed"))
    words = C.found(text, P.GENDER, 1)
    hindi = F.array(*[F.struct(C.found(text, rx).alias("word"), F.lit(code).alias("code")) for rx, code in P.GENDER_WORDS])
    other = F.get(F.filter(hindi, lambda h: h["word"] != ""), 0)
    stages.append({
        "number": number, "number_conf": F.when(F.col("is_masked"), F.col("masked.conf")).otherwise(conf_for(lines, F.col("printed"))),
        "gender_word": F.when(words != "", words).otherwise(C.blank(other["word"])), "sex": F.when(words != "", C.gender_code(words)).otherwise(C.blank(other["code"])),
    })
    return stages + _block_stages("number")


def _block_stages(number: str | None = None) -> list[dict[str, Column]]:
    """The address block of a page with ``english`` lines; ``number`` names the column of its own number."""
    own = F.col(number) if number else F.lit("")
    return [*B.normal_lines("english"), {"span": B.labelled_span(F.col("english"), own), "cluster": B.marked_cluster(F.col("english"), own)}, {"block": B.best_block(F.col("span"), F.col("cluster"))}]


def _front_stages(salt: str) -> list[dict[str, Column]]:
    lines, name = F.col("lines"), F.col("name_line")
    unique = F.when(F.col("is_masked"), "").otherwise(C.uniqueness_id(F.col("number"), salt))
    return [{"name_line": R.anchored_name(F.col("ordered"))}, _columns({
        "full_name": (C.clean_name(text_of(name)), conf_of(name)), "gender": (F.col("sex"), conf_for(lines, F.col("gender_word"))),
        "dob": (C.blank(F.col("born.value")), conf_for(lines, C.blank(F.col("born.raw")))), "yob": (F.coalesce(F.col("born.yob"), F.lit(False)), None),
        "aadhaar_number": (F.col("number"), F.col("number_conf")), "is_masked": (F.col("is_masked"), None), "uniqueness_id": (unique, None),
    })]


def extract_aadhaar_front(regions: DataFrame, keys: Keys = ("doc_id",), as_of: dt.date = AS_OF, salt: str = "") -> DataFrame:
    return _staged(_aadhaar(regions, keys, as_of), keys, _front_stages, salt)


def _address(page: DataFrame, keys: Keys, extra: list[str]) -> DataFrame:
    """Address and parts of a page with ``block``; state names are repaired before they are read."""
    rows = page.select(*keys, *extra, C.blank(F.col("block.address")).alias("address"), F.col("block.parts").alias("parts"), F.coalesce("block.conf", F.lit(0.0)).alias("conf"))
    rows = B.split_address(B.repair_states(rows))
    return rows.withColumn("address_confidence", C.confidence(F.col("conf"))).drop("parts", "conf")


def extract_aadhaar_back(regions: DataFrame, keys: Keys = ("doc_id",), as_of: dt.date = AS_OF) -> DataFrame:
    """Rows of documents with an address only."""
    page = _aadhaar(regions, keys, as_of)
    page = page.withColumn("aadhaar_number", page.number).withColumn("aadhaar_number_confidence", C.confidence(page.number_conf))
    return _address(page.filter("block is not null"), keys, ["aadhaar_number", "aadhaar_number_confidence", "is_masked"])


def aadhaar_sides(regions: DataFrame, keys: Keys = ("doc_id",), as_of: dt.date = AS_OF) -> DataFrame:
    """``keys, document_type, aadhaar_number``: a row for each side shown; the front if neither is."""
    page = _aadhaar(regions, keys, as_of).select(*keys, "number", (F.col("born").isNotNull() | (F.col("sex") != "")).alias("front"), F.col("block").isNotNull().alias("back"))
    side = lambda test, name: page.filter(test).select(*keys, F.lit(name).alias("document_type"), F.col("number").alias("aadhaar_number"))
    return side("front or not back", "aadhaar_front_bottom").unionByName(side("back", "aadhaar_back"))


# ---- passport


def extract_passport_front(regions: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    page = pages(regions, keys)
    page = page.filter(K.passport_side(page.full_text) == "front")
    text = page.full_text
    line1, line2 = C.mrz_lines(text)
    page = page.withColumn("line1", line1).withColumn("line2", line2)
    type_, country1, surname, given = C.mrz_names(page.line1)
    number, country2, birth, sex, expiry = C.mrz_numbers(page.line2)
    date = P.FULL_DATE
    pick = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    years = F.transform(F.regexp_extract_all(text, F.lit(rf"\b{date}\b"), F.lit(0)), lambda d, i: F.struct(F.regexp_extract(d, r"(\d{4})", 1).alias("y"), i.alias("i"), d.alias("d")))
    labelled = lambda rx: C.found(text, P.DATE_AFTER.format(label=rx, date=date), 1)
    place_of = lambda what: F.upper(F.regexp_replace(F.trim(C.found(text, P.PLACE_AFTER.format(what=what), 1)), ",+$", ""))
    printed = C.found(text, P.SEX_WORD, 1)
    gender = pick(sex, F.when(printed == "MALE", "M").when(printed == "FEMALE", "F").otherwise(""))
    page = page.withColumn("passport", pick(number, C.found(text, P.PASSPORT_WORD, 1)))
    base = conf_for(page.lines, page.passport, F.when(page.line1 != "", conf_for(page.lines, F.substring(page.line1, 1, 8))).otherwise(0.0))
    country = pick(country2, country1)
    page = page.withColumn("base", base)
    doi, birth_place, issue_place = labelled(P.ISSUE_DATE_LABEL), place_of("BIRTH"), place_of("ISSUE")
    b = page.base
    return _wide(page, keys, {
        "country_code": (country, b), "dob": (pick(C.mrz_date(birth), labelled(P.BIRTH_LABEL), C.blank(F.array_min(years)["d"])), b),
        "doe": (pick(C.mrz_date(expiry, expiry=True), labelled(P.EXPIRY_LABEL)), b), "doi": (doi, conf_for(page.lines, doi)),
        "gender": (F.when(gender.isin("M", "F"), gender).otherwise(""), b), "given_name": (given, b), "nationality": (F.when(country == "IND", "INDIAN").otherwise(""), b),
        "passport_num": (page.passport, b), "place_of_birth": (birth_place, conf_for(page.lines, birth_place)), "place_of_issue": (issue_place, conf_for(page.lines, issue_place)),
        "surname": (surname, b), "mrz_line_1": (page.line1, b), "mrz_line_2": (page.line2, b), "type_of_passport": (type_, b),
    })


def mrz_fields(regions: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    """Both machine-readable lines and what they hold, of documents that show the first one."""
    page = pages(regions, keys)
    line1, line2 = C.mrz_lines(page.full_text)
    page = page.select(*keys, line1.alias("line1"), line2.alias("line2")).filter("line1 <> ''")
    names = dict(zip(("type_of_passport", "country", "surname", "given_name"), C.mrz_names(page.line1), strict=True))
    number, _, birth, sex, expiry = C.mrz_numbers(page.line2)
    return page.select(*keys, "line1", "line2", *[c.alias(n) for n, c in names.items()], number.alias("passport_num"), C.mrz_date(birth).alias("dob"), sex.alias("sex"), C.mrz_date(expiry, expiry=True).alias("doe"))


def extract_passport_back(regions: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    page = pages(regions, keys)
    page = page.filter(K.passport_side(page.full_text) == "back")
    page = page.withColumn("file", C.found(page.full_text, P.FILE_NUMBER, 1)).withColumn("block", B.back_address(page.ordered))
    full = F.regexp_replace(C.blank(F.array_join("block.parts", ", ")), r"^[ ,]+|[ ,]+$", "")
    page = page.withColumn("address", full).withColumn("conf", F.when(full != "", F.col("block.conf")).otherwise(0.0))
    pin = F.concat(C.found(page.address, P.PIN_LABELLED, 1), C.found(page.address, P.PIN_LABELLED, 2))
    father, mother, spouse = R.back_names(page.ordered)
    old = R.next_value(page.ordered, P.OLD_PASSPORT)
    name = lambda x: (C.clean_name(text_of(x)), conf_of(x))
    return _wide(page, keys, {
        "address": (page.address, page.conf), "father": name(father), "mother": name(mother), "file_num": (page.file, conf_for(page.lines, page.file)),
        "old_passport_num": (old["value"], old["conf"]), "pin": (pin, F.when(pin != "", page.conf)), "spouse": name(spouse),
    })


# ---- driving licence


def licence_dob(lines: Column, full_text: Column, issue_year: Column) -> Column:
    """``struct<value, conf>``: a labelled date, else the earliest that can be a birth date."""
    labelled = C.found(full_text, P.DATE_AFTER.format(label=P.DL_BIRTH_LABEL, date=P.DL_DATE), 1)
    first_iso = C.to_iso_date(labelled)
    rows = F.transform(dated(full_text, P.DL_DATE, 30, False), lambda d: F.struct(C.to_iso_date(d["raw"]).alias("iso"), d["raw"].alias("raw"), d["context"].alias("context")))
    late = lambda iso: (issue_year > 0) & (F.substring(iso, 1, 4).cast("int") > issue_year - 16)
    rows = F.filter(rows, lambda d: (d["iso"] != "") & ~d["context"].rlike(P.DL_ISSUE_NEAR))
    best = F.array_min(F.filter(rows, lambda d: ~late(d["iso"])))
    value = F.when(first_iso != "", F.struct(first_iso.alias("value"), conf_for(lines, labelled).alias("conf")))
    return F.coalesce(value, F.struct(C.blank(best["iso"]).alias("value"), conf_for(lines, C.blank(best["raw"])).alias("conf")))


def licence_issue_date(lines: Column, dob: Column, pairs: Column) -> Column:
    """``struct<value, conf>``: by label in order, first dates behind all labels, then beside them (``pairs``)."""
    dated_ = lambda text, conf: F.struct(C.to_iso_date(text).alias("value"), conf.alias("conf"))
    behind = [rf"(?i){x}\s*[:\-]?\s*{P.DL_DATE_TOKEN}" for x in P.DL_ISSUE_LABELS]
    # of every line what stands behind each label, then what stands beside the labels, in one list by rank
    n = len(behind)
    tokens = F.transform(lines, lambda x, i: F.transform(F.array(*[F.regexp_extract(x["text"], rx, 1) for rx in behind]), lambda t, k: F.struct(k.alias("k"), i.alias("i"), t.alias("t"), x["conf"].alias("conf"))))
    beside = F.transform(pairs, lambda p, k: F.struct((k + n).alias("k"), F.lit(0).alias("i"), F.regexp_replace(p["value"], r"^[:\s]+", "").alias("t"), p["conf"].alias("conf")))
    told = F.filter(F.concat(F.flatten(tokens), beside), lambda x: x["t"] != "")
    read = F.filter(F.transform(told, lambda x: F.struct(x["k"].alias("k"), x["i"].alias("i"), dated_(x["t"], x["conf"]).alias("d"))), lambda x: (x["d"]["value"] != "") & (x["d"]["value"] != dob))
    return F.coalesce(F.array_min(read)["d"], F.struct(F.lit("").alias("value"), F.lit(0.0).alias("conf")))


#: The labels of a licence and what a value beside each has to be; those of the issue date come first.
_LICENCE_LABELS: dict = dict.fromkeys([f"(?i){x}" for x in P.DL_ISSUE_LABELS]) | {P.DL_BLOOD: C.is_blood_group, P.DL_ADDRESS: C.is_licence_address}


def _licence_stages(as_of: dt.date) -> list[dict[str, Column]]:
    """The job's columns by stage, each in terms of those before it."""
    text, lines = F.col("full_text"), F.col("lines")
    n_issue = len(P.DL_ISSUE_LABELS)
    pick = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    raw = pick(C.found(text, P.DL_MODERN), C.found(text, P.DL_LEGACY), C.found(text, rf"\b({P.VEHICLE})\b", 1))
    stages = [{"raw": raw, "table": R.labelled(lines, _LICENCE_LABELS)}]
    stages.append({"number": F.regexp_replace("raw", "[^A-Z0-9]", "")})
    stages.append({"issue_year": C.licence_issue_year(F.col("number"), F.lit(as_of)), "named": R.licence_name_lines(lines), "addr": B.licence_address_of(lines, F.get("table", n_issue + 1)), "blood": F.get("table", n_issue)})
    stages.append({"born": licence_dob(lines, text, F.col("issue_year"))})
    stages.append({"issued": licence_issue_date(lines, F.col("born.value"), F.slice("table", 1, n_issue))})
    # a layout without labels: names and then the address, straight under the number
    bare = (F.col("named.name") == "") & (F.col("named.guardian") == "") & (F.col("addr.value") == "")
    # a lost label: a date in the year that the number encodes
    dates = F.transform(F.regexp_extract_all(text, F.lit(P.FULL_DATE), F.lit(0)), lambda d: F.struct(d.alias("raw"), C.to_iso_date(d).alias("iso")))
    unlabelled = F.filter(dates, lambda d: (d["iso"] != "") & (d["iso"] != F.col("born.value")) & (F.substring(d["iso"], 1, 4).cast("int") == F.col("issue_year")))
    stages.append({"bare": bare, "under": F.when(bare, B.block_under_number(lines, F.col("raw"))), "late": F.when(F.col("issue_year") > 0, F.get(unlabelled, 0))})
    is_name = lambda x: x.isNotNull() & F.coalesce(C.is_licence_name(text_of(x)), F.lit(False))
    one, two = F.get("under", 0), F.get("under", 1)
    names = let(is_name(one), lambda a: F.when(a & is_name(two), 2).when(a, 1).otherwise(0))
    stages.append({"n_names": F.when(F.col("bare"), names).otherwise(0)})
    rest = F.slice("under", F.col("n_names") + 1, F.greatest(F.size("under"), F.lit(0)))
    stages.append({"rest": F.filter(rest, lambda x: C.is_licence_address(x["text"]) | F.trim(x["text"]).rlike(P.BARE_DIGITS))})
    has, found_under = F.col("n_names") > 0, (F.col("n_names") > 0) & (F.size("rest") > 0)
    late = C.blank(F.col("late.raw"))
    use_late = (F.col("issued.value") == "") & (late != "")
    fields = {
        "license_number": (F.col("number"), conf_for(lines, F.col("raw"))),
        "name": (F.when(has, C.clean_name(F.trim(text_of(one)))).otherwise(F.col("named.name")), F.when(has, conf_of(one)).otherwise(F.col("named.name_conf"))),
        "swd": (F.when(F.col("n_names") > 1, C.clean_name(F.trim(text_of(two)))).otherwise(F.col("named.guardian")), F.when(F.col("n_names") > 1, conf_of(two)).otherwise(F.col("named.guardian_conf"))),
        "dob": (F.col("born.value"), F.col("born.conf")), "blood_group": (F.trim(F.regexp_replace(F.col("blood.value"), r"^[:\s.]+", "")), F.col("blood.conf")),
        "address": (F.when(found_under, F.array_join(F.transform("rest", lambda x: F.trim(x["text"])), ", ")).otherwise(F.col("addr.value")), F.when(found_under, F.array_min(F.transform("rest", lambda x: x["conf"]))).otherwise(F.col("addr.conf"))),
        "issue_date": (F.when(use_late, F.col("late.iso")).otherwise(F.col("issued.value")), F.when(use_late, conf_for(lines, late)).otherwise(F.col("issued.conf"))),
    }
    return [*stages, _columns(fields)]


def extract_licence(regions: DataFrame, keys: Keys = ("doc_id",), as_of: dt.date = AS_OF) -> DataFrame:
    return _staged(pages(regions, keys), keys, _licence_stages, as_of)


# ---- voter card


def extract_voter_front(regions: DataFrame, keys: Keys = ("doc_id",), as_of: dt.date = AS_OF) -> DataFrame:
    page = pages(regions, keys)
    page = page.filter(K.voter_side(page.full_text) == "front")
    text = page.full_text
    raw = C.found(text, P.VOTER_DOB, 1)
    page = page.withColumn("epic", C.found(text, P.EPIC)).withColumn("raw", raw).withColumn("dob", F.when(raw != "", C.dmy_to_iso(raw)).otherwise(""))
    dob_conf = conf_for(page.lines, page.raw)
    word = C.found(text, P.ANY_SEX_WORD, 1)
    fuzzy = R.voter_gender(page.ordered)
    years = C.age(page.dob, F.lit(as_of))

    def relation(x: Column) -> Column:
        own = F.regexp_extract(x["text"], P.VOTER_PARENT, 1)
        return F.when(own != "", own).otherwise(F.regexp_extract(x["text"], P.VOTER_PARENT_GARBLED, 1))

    parent = first(page.ordered, lambda x: F.trim(relation(x)) != "")
    own_name = lambda x: F.regexp_extract(F.trim(x["text"]), P.VOTER_NAME, 1)
    named = first(page.ordered, lambda x: ~x["text"].rlike(P.VOTER_RELATIVE) & (F.trim(own_name(x)) != ""))
    at = place(page.ordered, lambda x: (page.epic != "") & F.contains(F.upper(x["text"]), page.epic))
    over = F.element_at(F.filter(before(page.ordered, at), lambda x: C.is_voter_name(x["text"])), -1)
    over = F.when(F.exists(before(page.ordered, at), lambda x: C.is_voter_name(x["text"])), over)
    guess = F.coalesce(over, first(page.ordered, lambda x: C.is_voter_name(x["text"])))
    name = F.when(named.isNotNull(), C.clean_name(own_name(named))).otherwise(C.clean_name(text_of(guess)))
    card = C.blank(F.get(F.filter(F.regexp_extract_all(text, F.lit(rf"\b({P.FULL_DATE})\b"), F.lit(1)), lambda d: d != page.raw), 0))
    return _wide(page, keys, {
        "full_name": (name, F.coalesce(named["conf"], guess["conf"])), "age": (years, F.when(years != "", dob_conf)), "care_of": (C.clean_name(relation(parent)), conf_of(parent)),
        "dob": (page.dob, dob_conf), "doc": (C.dmy_to_iso(card), conf_for(page.lines, card)),
        "gender": (F.when(word != "", C.gender_code(word)).otherwise(fuzzy["value"]), F.when(word != "", conf_for(page.lines, word)).otherwise(fuzzy["conf"])), "epic_number": (page.epic, conf_for(page.lines, page.epic)),
    })


def extract_voter_back(regions: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    page = pages(regions, keys)
    page = staged(page.filter(K.voter_side(page.full_text) == "back"), _voter_block_stages)
    return _address(page, keys, []).drop("care_of", "relation")


def _voter_block_stages() -> list[dict[str, Column]]:
    return [{"english": B.english_lines(F.col("ordered"))}, *_block_stages()]


JOBS = {
    "PAN": (extract_pan,), "AADHAAR": (extract_aadhaar_front, extract_aadhaar_back), "PASSPORT": (extract_passport_front, extract_passport_back),
    "DRIVING_LICENSE": (extract_licence,), "VOTER_ID": (extract_voter_front, extract_voter_back),
}
#: Jobs by the name that their contract carries.
CONTRACT_JOBS = {
    "pan": extract_pan, "aadhaar_front_bottom": extract_aadhaar_front, "aadhaar_back": extract_aadhaar_back, "passport_front": extract_passport_front, "passport_back": extract_passport_back,
    "driving_license": extract_licence, "voter_front": extract_voter_front, "voter_back": extract_voter_back,
}
