"""Column functions: names, dates, machine-readable lines, predicates on a line's text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.functions import patterns as P


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once and named, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def found(text: Column, rx: str, group: int = 0) -> Column:
    """First match of a pattern, '' if there is none or the text is null."""
    return F.regexp_extract(blank(text), rx, group)


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def confidence(c: Column) -> Column:
    """0..1 as a whole percentage, halves to even; null is 0."""
    return F.bround(F.coalesce(c, F.lit(0.0)) * 100).cast("int")


def field(value: Column, conf: Column) -> Column:
    """``struct<value, confidence>``."""
    return F.struct(blank(value).alias("value"), confidence(conf).alias("confidence"))


def title(c: Column) -> Column:
    """A capital at the start of every run of letters, small letters after it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def _by_length(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


#: A given name of two letters or more before a surname, or one before a long surname.
SURNAME_SPLIT = rf"(?i)^(?:(.)({_by_length(s for s in P.SURNAMES if len(s) >= 5)})|(.{{2,}}?)({_by_length(P.SURNAMES)}))$"


def split_surname(token: Column) -> Column:
    """Splits a glued name before the longest known surname at its end."""
    return F.regexp_replace(token, SURNAME_SPLIT, "$1$3 $2$4")


def clean_name(c: Column) -> Column:
    """One space between words, glued words split, every word with a capital."""
    spaced = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(blank(c), r"\s+", " ")), "(?<=[a-z])(?=[A-Z])", " "), r"\s+", " ")
    whole = lambda t: (F.length(t) >= 5) & t.rlike(r"^\p{L}+$")
    return title(F.array_join(F.transform(F.split(spaced, " "), lambda t: F.when(whole(t), split_surname(t)).otherwise(t)), " "))


# ---- dates as strings; only ranges are checked, as on the cards


def _groups(c: Column, rx: str, n: int) -> Column:
    """The groups 1 to n of a pattern's first match as an array."""
    return F.array(*[F.regexp_extract(c, rx, g) for g in range(1, n + 1)])


def dmy_to_iso(c: Column) -> Column:
    """``d/m/yyyy`` with / - or . as ISO; anything else is returned as it is."""
    rx = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
    iso = lambda p: F.concat(p[2], F.lit("-"), F.lpad(p[1], 2, "0"), F.lit("-"), F.lpad(p[0], 2, "0"))
    return let(c, lambda x: F.when(x.rlike(rx), let(_groups(x, rx, 3), iso)).otherwise(x))


def _month(name: Column) -> Column:
    names = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    at = F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(name, 1, 3)))
    return F.when(name.rlike(r"^\d"), F.try_to_number(name, F.lit("99")).cast("long")).otherwise(at)


def to_iso_date(c: Column) -> Column:
    """A date with a numeric or named month as ISO; '' if it is none."""
    numeric, named = r"^\s*(\d{1,2})[/\-.\s]+(\d{1,2})[/\-.\s]+(\d{4})", r"^\s*(\d{1,2})[/\-.\s]*([A-Za-z]{3,})[/\-.\s]*(\d{4})"

    def iso(day: Column, month: Column, year: Column) -> Column:
        made = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
        return F.when(F.try_to_number(day, F.lit("99")).cast("int").between(1, 31) & month.between(1, 12), made).otherwise("")

    read = lambda p: let(_month(p[1]), lambda m: iso(p[0], m, p[2]))
    return let(blank(c), lambda x: F.when(x.rlike(numeric), let(_groups(x, numeric, 3), read)).when(x.rlike(named), let(_groups(x, named, 3), read)).otherwise(""))


def plausible_dob(iso: Column, as_of: Column) -> Column:
    """``yyyy-mm-dd`` or ``yyyy`` from 1900 to the year of ``as_of``."""
    rx = r"^(\d{4})(?:-(\d{2})-(\d{2}))?$"
    day = lambda p: (p[1] == "") | (p[1].between("01", "12") & p[2].between("01", "31"))
    test = lambda p: (p[0] != "") & F.try_to_number(p[0], F.lit("9999")).cast("int").between(1900, F.year(as_of)) & day(p)
    return F.coalesce(let(_groups(iso, rx, 3), test), F.lit(False))


def dob_from_digits(c: Column, as_of: Column) -> Column:
    """ISO date of the first eight digits as DDMMYYYY, if it can be a birth date."""
    d = F.regexp_replace(blank(c), r"\D", "")
    iso = F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2))
    return F.when((F.length(d) >= 8) & plausible_dob(iso, as_of), iso).otherwise("")


def age(iso: Column, as_of: Column) -> Column:
    """Whole years to ``as_of`` as a string, '' without a date or outside 0 to 149."""
    rx = r"^(\d{4})-(\d{2})-(\d{2})"
    part = lambda p, g: F.try_to_number(p[g], F.lit("9999")).cast("int")
    before = lambda p: (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (part(p, 1) * 100 + part(p, 2))
    years = let(_groups(blank(iso), rx, 3), lambda p: F.year(as_of) - part(p, 0) - before(p).cast("int"))
    return let(years, lambda y: F.when(y.between(0, 149), y.cast("string")).otherwise(""))


def mrz_date(c: Column, expiry: bool = False) -> Column:
    """``yymmdd`` as ``dd/mm/yyyy``: an expiry is in the 2000s, a birth from '31 in the 1900s."""
    year = F.substring(c, 1, 2)
    century = F.lit("20") if expiry else F.when(year <= "30", "20").otherwise("19")
    return F.when(c.rlike(r"^\d{6}$"), F.concat(F.substring(c, 5, 2), F.lit("/"), F.substring(c, 3, 2), F.lit("/"), century, year)).otherwise("")


def licence_issue_year(number: Column, as_of: Column) -> Column:
    """The year that a licence number encodes; 0 if it can't be read."""
    d = F.regexp_replace(blank(number), r"\D", "")
    year = F.when(F.length(d) == 13, F.substring(d, 3, 4)).when(F.length(d) == 12, F.substring(d, 9, 4))
    year = F.try_to_number(year, F.lit("9999")).cast("int")
    return F.when(year.between(1950, F.year(as_of)), year).otherwise(0)


# ---- machine-readable lines


def mrz_lines(full_text: Column) -> tuple[Column, Column]:
    """The two lines of the machine-readable zone, '' each if missing."""
    lines = F.transform(F.split(F.upper(full_text), "\n"), lambda s: F.regexp_replace(s, r"\s+", ""))
    long = lambda s: F.length(s) >= 28
    first = F.get(F.filter(lines, lambda s: s.rlike("^P[A-Z<]") & s.contains("<<") & long(s)), 0)
    second = F.get(F.filter(lines, lambda s: s.rlike(r"^[A-Z]{1,2}\d{6,7}") & long(s)), 0)
    return blank(first), blank(second)


def mrz_names(line: Column) -> tuple[Column, Column, Column, Column]:
    """Type, country, surname and given name of the first line."""
    tail = F.substring(line, F.lit(3), F.length(line))
    country = F.regexp_extract(tail, r"^([A-Z]{3})", 1)
    rest = F.when(country != "", F.substring(tail, F.lit(4), F.length(tail))).otherwise(F.regexp_replace(tail, "^<+", ""))
    parts = F.filter(F.split(rest, "<<"), lambda s: s != "")
    name = lambda i: clean_name(F.regexp_replace(blank(F.get(parts, i)), "<", " "))
    real = F.length(line) >= 5
    return tuple(F.when(real, c).otherwise("") for c in (F.substring(line, 1, 1), country, name(0), name(1)))


def mrz_numbers(line: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Number, country, birth, sex and expiry of the second line."""
    rx = r"([A-Z]{3})(\d{6})\d?([MF<])(\d{6})"
    return (found(line, r"^([A-Z]{1,2}\d{6,7})", 1), *(found(line, rx, g) for g in (1, 2, 3, 4)))


# ---- what a line can be


def _capitals(t: Column, least: float) -> Column:
    n = F.length(letters(t))
    return F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) > n * least


def is_pan_name(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) >= 3) & ~t.rlike(r"\d") & ~t.rlike(P.PAN_LABELS) & (F.length(letters(t)) >= 3) & _capitals(t, 0.85)


def is_aadhaar_name(text: Column) -> Column:
    t = F.trim(text)
    n = F.length(letters(t))
    return (F.length(t) >= 4) & ~t.rlike(r"\d") & ~t.rlike(P.AADHAAR_LABELS) & (n >= 4) & (n > F.length(t) * 0.8)


def is_voter_name(text: Column) -> Column:
    return ~text.rlike(P.VOTER_HEADER) & is_aadhaar_name(text)


def is_passport_name(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) >= 4) & ~t.rlike(r"\d") & ~t.rlike(P.PASSPORT_NOT_NAME) & (F.length(letters(t)) >= 4) & _capitals(t, 0.85)


def is_licence_name(text: Column) -> Column:
    t = F.trim(text)
    latin = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return ~t.rlike(r"\d") & ~t.rlike(r"(?i)^(?:AB|A|B|O)\s*[+\-]?\s*(?:VE)?$") & ~t.rlike(P.DL_NOISE) & (latin >= 3)


def is_blood_group(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"(?i)^(?:AB|A|B|O)\s*[+\-]") | t.rlike("(?i)^(?:NOT|NIL)")


def is_licence_address(text: Column) -> Column:
    t = F.trim(text)
    latin = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return (t != "") & ~t.rlike(P.DL_ADDRESS_STOP) & ~t.rlike(r"^[\d/\-.\s]+$") & (to_iso_date(t) == "") & ~is_blood_group(t) & ((latin >= 4) | t.rlike(r"\d{3}"))


def is_address_line(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(P.ADDRESS_MARKERS) | t.rlike(P.CITY_PIN) | t.rlike(P.PIN)


def is_script_garbage(text: Column) -> Column:
    """Lines that a Latin reader makes of another script."""
    foreign = text.rlike(r"[\p{L}&&[^\x00-\x7F]]")
    words = F.regexp_extract_all(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", "\u0001"), F.lit("[A-Za-z]+"), F.lit(0))
    real = F.exists(words, lambda w: (F.length(w) >= 3) & w.rlike("(?i)[AEIOUY]"))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    empty = (latin > 0) & ~real & ~F.trim(text).rlike(P.LABEL_ONLY) & (is_address_line(text) | (latin >= 3))
    return foreign | empty


# ---- small ones


def clean_guardian(c: Column) -> Column:
    """A guardian's name without what is left of its label."""
    t = F.regexp_replace(blank(c), r"^[ :./]+|[ :./]+$", "")
    return clean_name(F.regexp_replace(t, r"^(?:[DWM]\s*)*O[Ff](?=[A-Z]|\s|$)\s*", ""))


def gender_code(word: Column) -> Column:
    w = F.upper(word)
    return F.when(w == "MALE", "M").when(w == "FEMALE", "F").when(w == "TRANSGENDER", "T").otherwise("")


def comparable(c: Column) -> Column:
    """Text as it is compared with labelled truth."""
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


#: Full-width forms (U+FF01 to U+FF5E) stand this far behind ASCII; so does their space, apart.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0"
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE[:-2]) + "  "
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def half_width(c: Column) -> Column:
    """Full-width characters, their spaces and Latin ligatures as compatibility normalizing gives them."""
    plain = lambda x: reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), _LIGATURES, F.translate(x, _WIDE, _NARROW))
    return let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), plain(x)).otherwise(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normal_forms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda row: None if row is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in row])


def nfkc_all(texts: Column) -> Column:
    """Compatibility normal form of every string of an array; only arrays with non-ASCII text go to Python.

    Python's own tables, in Arrow batches: Arrow's kernel of that name leaves accents apart.
    """
    foreign = F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7F]"))
    return F.coalesce(_normal_forms.asNondeterministic()(F.when(foreign, texts)), texts)


def nfkc(text: Column) -> Column:
    """Compatibility normal form of a string; null stays null."""
    return F.get(nfkc_all(F.array(text)), 0)


def uniqueness_id(number: Column, salt: str = "") -> Column:
    """SHA-256 of a number (personal data still: twelve digits can be tried out; give a salt)."""
    return F.when(number != "", F.sha2(F.concat(F.lit(salt), number), 256)).otherwise("")


def strip_id(c: Column) -> Column:
    return F.regexp_replace(F.upper(blank(c)), "[^A-Z0-9]", "")


def mask_id(value: Column, doc_type: Column) -> Column:
    """The number as it may be shown: only its last characters."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(doc_type == "AADHAAR", F.concat(F.lit("XXXX XXXX "), F.right(digits, F.lit(4))))
        .when(doc_type == "PAN", F.concat(F.left(value, F.lit(2)), F.lit("XXXXX"), F.right(value, F.lit(3))))
        .otherwise(F.concat(F.repeat(F.lit("X"), F.greatest(F.lit(0), F.length(value) - 4)), F.right(value, F.lit(4))))
    )


def states_in(text: Column, states=P.STATES) -> Column:
    """The first listed state that an upper-cased text holds, ''."""
    return blank(F.get(F.filter(F.array(*map(F.lit, states)), lambda s: F.contains(F.upper(text), s)), 0))
