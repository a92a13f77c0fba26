"""Address blocks: where they begin and end, which of two to trust, and their parts."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.functions import columns as C
from idweft.functions import patterns as P
from idweft.operators.pages import after, first, height, let, pages, place, staged, text_of, until
from idweft.operators.pairing import paired

COLUMN_GAP = 120


def is_number_line(text: Column, number: Column) -> Column:
    """Identity numbers stand near an address and never belong to it."""
    digits = F.regexp_replace(text, r"\D", "")
    own = F.regexp_replace(C.blank(number), r"\D", "")
    return (F.length(digits) >= 11) | ((own != "") & F.contains(digits, own))


def english_lines(ordered: Column) -> Column:
    """Lines without script garbage, and without a bare PIN that a worded line repeats."""
    worded = lambda x: x["text"].rlike("[A-Za-z]{3,}")
    pin = lambda x: F.regexp_extract(x["text"], P.PIN, 1)

    def alone(clean: Column) -> Column:
        known = F.filter(F.transform(F.filter(clean, worded), pin), lambda p: p != "")
        return let(known, lambda k: F.filter(clean, lambda x: worded(x) | ~F.array_contains(k, pin(x))))

    return let(F.filter(ordered, lambda x: ~C.is_script_garbage(x["text"])), alone)


def normal_lines(column: str) -> list[dict[str, Column]]:
    """Stages that put the texts of a column of lines in compatibility normal form."""
    texts = C.nfkc_all(F.transform(column, lambda x: x["text"]))
    zipped = let(F.struct(column, "texts_"), lambda s: F.transform(s[column], lambda x, i: x.withField("text", F.get(s["texts_"], i))))
    return [{"texts_": texts}, {column: zipped}]


def _block(rows: Column) -> Column:
    """``struct<parts, conf>`` of rows ``(t, c)``; null without rows."""

    def made(r: Column) -> Column:
        mean = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["c"]) / F.size(r)
        return F.when(F.size(r) > 0, F.struct(F.transform(r, lambda x: x["t"]).alias("parts"), mean.alias("conf")))

    return let(rows, made)


def _row(x: Column) -> Column:
    return F.struct(F.trim(x["text"]).alias("t"), x["conf"].alias("c"))


def labelled_span(lines: Column, number: Column) -> Column:
    """Lines from the printed label down to a PIN, in its own column.

    A line of another column is passed over; a number or a footer ends the walk before it,
    a PIN after it. Text behind the label is the first part and ends nothing.
    """
    none = F.array().cast("array<struct<t:string,c:double>>")

    def from_label(at: Column, label: Column) -> Column:
        tail = F.trim(F.regexp_replace(F.regexp_extract(text_of(label), rf"(?s)^.*?(?:(?i:{P.ADDRESS_LABEL[4:]}))(.*)$", 1), r"^[\s:.\-)）]*", ""))
        opening = let(tail, lambda t: F.when((t != "") & ~is_number_line(t, number), F.array(F.struct(t.alias("t"), label["conf"].alias("c")))).otherwise(none))
        h = height(label)
        column = F.filter(after(lines, at), lambda x: (F.trim(x["text"]) != "") & x["x1"].between(label["x1"] - 2 * h, label["x1"] + 6 * h))
        walk = until(column, lambda x: is_number_line(x["text"], number) | x["text"].rlike(P.ADDRESS_FOOTER))
        walk = until(walk, lambda x: x["text"].rlike(P.PIN), keep_stop=True)
        return _block(F.concat(opening, F.transform(walk, _row)))

    return let(place(lines, lambda x: x["text"].rlike(P.ADDRESS_LABEL)), lambda at: F.when(at.isNotNull(), let(F.get(lines, at), lambda label: from_label(at, label))))


def marked_cluster(lines: Column, number: Column) -> Column:
    """The largest column of lines with address markers, the leftmost of equal ones."""
    keep = lambda x: (F.trim(x["text"]) != "") & ~is_number_line(x["text"], number) & ~x["text"].rlike(P.ADDRESS_FOOTER) & C.is_address_line(x["text"])
    by_x = F.array_sort(F.transform(F.filter(lines, keep), lambda x: F.struct(x["x1"].alias("x1"), x["y1"].alias("y1"), x["region_idx"].alias("i"), F.trim(x["text"]).alias("t"), x["conf"].alias("c"))))

    def largest(marked: Column, starts: Column) -> Column:
        columns = F.transform(starts, lambda s, k: F.slice(marked, s + 1, F.coalesce(F.get(starts, k + 1), F.size(marked)) - s))
        best = F.array_max(F.transform(columns, lambda c, k: F.struct(F.size(c).alias("n"), (-k).alias("k"), c.alias("c"))))["c"]
        return _block(F.array_sort(F.transform(best, lambda x: F.struct(x["y1"].alias("y1"), x["x1"].alias("x1"), x["i"].alias("i"), x["t"].alias("t"), x["c"].alias("c")))))

    def columns_of(marked: Column) -> Column:
        # a column begins where the step from the line to its left is too wide
        starts = F.filter(F.transform(marked, lambda x, i: F.when((i == 0) | (x["x1"] - F.get(marked, i - 1)["x1"] > COLUMN_GAP), i)), lambda i: i.isNotNull())
        return F.when(F.size(marked) > 0, let(starts, lambda s: largest(marked, s)))

    return let(by_x, columns_of)


# ---- one address string and its parts


def joined(parts: Column) -> Column:
    """Lines as one string: one comma between them, one space between words, half-width marks."""
    edge = r"^[ ,]+|[ ,]+$"
    full = F.regexp_replace(C.half_width(F.array_join(parts, ", ")), edge, "")
    full = F.regexp_replace(F.regexp_replace(full, r"(?:\s*,\s*)+", ", "), edge, "")
    return F.regexp_replace(full, r"\s+", " ")


_LISTED = [(re.sub("[^A-Z]", "", s), s.title()) for s in P.STATES]
#: A state name begins with a state's initial and is as long, give or take two; five letters at least.
_LEAST_LETTERS, _MORE_OR_LESS = 5, 2


@lru_cache(maxsize=1 << 16)
def listed_state(key: str) -> str | None:
    """The first listed state that a run of letters is like; each run is compared once in a worker."""
    near = ((k, name) for k, name in _LISTED if k[0] == key[0] and abs(len(k) - len(key)) <= _MORE_OR_LESS)
    return next((name for k, name in near if SequenceMatcher(None, key, k).ratio() >= 0.80), None)


#: Initial and length of every run that a state is near to, and what exact names are read as.
_NEAR = sorted({f"{k[0]}{n}" for k, _ in _LISTED for n in range(max(_LEAST_LETTERS, len(k) - _MORE_OR_LESS), len(k) + _MORE_OR_LESS + 1)})
_EXACT = {k: listed_state(k) for k, _ in _LISTED if len(k) >= _LEAST_LETTERS}


def _state_runs(tokens: Column) -> Column:
    """Runs of words that may be a state: ``array<struct<n, i, key>>`` in the order in which they are tried.

    Three words, then two, then one, from the left; of each the number of words, the first
    token's place and its letters. Nothing behind an exact name can count, so it ends there.
    """

    def of_length(n: int) -> Column:
        def run(t: Column, i: Column) -> Column:
            rest = [F.get(tokens, i + j) for j in range(1, 2 * n - 1)]
            apart = [F.trim(F.regexp_replace(x, r"\s", "")) == "" for x in rest[::2]]
            key = F.upper(F.concat(t, *rest[1::2]))
            return F.struct(F.lit(n).alias("n"), i.alias("i"), F.when(reduce(lambda a, b: a & b, apart, t.rlike("^[A-Za-z]")), key).alias("key"))

        return F.transform(tokens, run)

    near = lambda key: F.concat(F.left(key, F.lit(1)), F.length(key).cast("string")).isin(_NEAR)
    # n edits between two strings leave a matching ratio of at most 1 - n / (their letters)
    like = lambda key: F.exists(F.array(*[F.lit(k) for k, _ in _LISTED]), lambda s: (F.left(s, F.lit(1)) == F.left(key, F.lit(1))) & (F.levenshtein(key, s) * 5 <= F.length(key) + F.length(s)))
    runs = F.filter(F.concat(*[of_length(n) for n in (3, 2, 1)]), lambda r: near(r["key"]) & like(r["key"]))
    return until(runs, lambda r: r["key"].isin(*_EXACT), keep_stop=True)


def state_candidates(address: Column) -> Column:
    """``array<struct<tokens, runs>>`` of an address's last three parts: its words and gaps, and :func:`_state_runs`."""
    parts = F.split(address, ",")
    tail = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3))
    tokens = lambda p: F.regexp_extract_all(p, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.transform(tail, lambda p: let(tokens(p), lambda t: F.struct(t.alias("tokens"), _state_runs(t).alias("runs"))))


def asked_states(candidates: Column) -> Column:
    """The runs of letters whose likeness to a state has to be measured: none that is a state's own name."""
    keys = F.flatten(F.transform(candidates, lambda c: F.transform(c["runs"], lambda r: r["key"])))
    return F.array_distinct(F.filter(keys, lambda k: ~k.isin(*_EXACT)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def listed_states(keys: pd.Series) -> pd.Series:
    """The state that each run of letters is like, or null, in Arrow batches."""
    return keys.map(lambda row: None if row is None else [listed_state(k) for k in row])


def repair_states(addresses: DataFrame, column: str = "address") -> DataFrame:
    """``addresses`` with garbled state names in the last three parts of an address put right.

    Runs of three words, then two, then one are tried from the left; the first listed state of
    the same initial, about the same length and a matching ratio of 0.8 replaces the run. The
    candidates are a join of word windows with the 33 states on (initial, length), which is
    made within the row, as both sides are few: no exchange, no key, and an address that has
    none passes by. Only their letters go to Python, each garbled name once for a worker;
    a state's exact name is looked up here. A null address stays null.
    """
    return staged(addresses, _repair_stages, column).drop("tried_", "asked_", "told_")


def _repair_stages(column: str) -> list[dict[str, Column]]:
    names = F.create_map(*[F.lit(x) for pair in _EXACT.items() for x in pair])
    # as if not deterministic, so that no filter on the address takes the call along and asks again
    told = listed_states.asNondeterministic()(F.when(F.size("asked_") > 0, F.col("asked_")))

    def read(part: Column, state: Column) -> Column:
        name = lambda r: F.coalesce(F.element_at(names, r["key"]), F.get(state["told_"], F.array_position(state["asked_"], r["key"]).cast("int") - 1))
        hits = F.filter(F.transform(part["runs"], lambda r: F.struct(r["i"].alias("i"), r["n"].alias("n"), name(r).alias("name"))), lambda h: h["name"].isNotNull())
        tokens = part["tokens"]
        put = lambda h: F.concat(F.slice(tokens, F.lit(1), h["i"]), F.array(h["name"]), F.slice(tokens, h["i"] + 2 * h["n"], F.size(tokens)))
        return F.array_join(let(F.get(hits, 0), lambda h: F.when(h.isNotNull(), put(h)).otherwise(tokens)), "")

    parts = F.split(column, ",")
    head = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 3))
    # what Python answered is an argument, as no function of an array may hold a call of it
    tail = let(F.struct("tried_", "asked_", "told_"), lambda state: F.transform(state["tried_"], lambda part: read(part, state)))
    # an address without a candidate is as it was
    some = F.exists("tried_", lambda p: F.size(p["runs"]) > 0)
    whole = F.when(some, F.array_join(F.concat(head, tail), ",")).otherwise(F.col(column))
    return [{"tried_": state_candidates(F.col(column))}, {"asked_": asked_states(F.col("tried_"))}, {"told_": told}, {column: whole}]


def care_of(full: Column) -> tuple[Column, Column]:
    """Name and relation after the first prefix that a name of three letters follows."""
    pieces, hits = F.split(full, P.CARE_OF, -1), F.regexp_extract_all(full, F.lit(P.CARE_OF), F.lit(0))
    # the rest of the text behind a prefix: to the first comma, house label or digit
    keys = [F.regexp_extract_all(full, F.lit(P.CARE_OF), F.lit(g)) for g in (1, 2, 3)]

    def read(hit: Column, i: Column) -> Column:
        rest = F.array_join(F.slice(F.flatten(F.transform(hits, lambda h, k: F.array(h, F.get(pieces, k + 1)))), 2 * i + 2, F.lit(1 << 20)), "")
        name = F.get(F.split(rest, P.CARE_OF_END, 2), 0)
        name = F.get(F.split(name, r"\.(?!\s)", 2), 0)
        name = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z .]", " "), r"^[ .]+|[ .]+$", "")
        key = F.upper(F.concat(*[F.coalesce(F.get(k, i), F.lit("")) for k in keys]))
        return F.when(F.length(C.letters(name)) >= 3, F.struct(name.alias("name"), key.alias("key")))

    got = F.get(F.filter(F.transform(hits, read), lambda x: x.isNotNull()), 0)
    key = got["key"]
    relation = F.when(got.isNull() | key.isin("S", "D", "SON", "DAUGHTER"), "father").when(key.isin("W", "WIFE"), "husband").otherwise("care_of")
    return C.clean_name(got["name"]), relation


def labelled_place(segments: Column, label_rx: str, skip_rx: str | None = None) -> Column:
    """The place named behind a label, or in the next part where the label ends its own."""
    edge = "^[ .:-]+|[ .:-]+$"

    def read(seg: Column, i: Column) -> Column:
        rest = F.regexp_extract(seg, rf"(?s)^.*?(?:(?i:{label_rx[4:]}))(.*)$", 1)
        own = F.regexp_replace(rest, edge, "")
        value = F.when(own == "", F.regexp_replace(C.blank(F.get(segments, i + 1)), edge, "")).otherwise(own)
        test = seg.rlike(label_rx) & value.rlike(P.PLACE)
        return F.when(test & ~seg.rlike(skip_rx) if skip_rx else test, value)

    return C.clean_name(F.get(F.filter(F.transform(segments, read), lambda x: x.isNotNull()), 0))


def address_parts(full: Column, parts: Column) -> dict[str, Column]:
    """PIN, care-of, country, state, house number, district and city of an address."""
    segments = F.filter(F.split(full, r"\s*,\s*"), lambda s: F.trim(s) != "")
    name, relation = care_of(full)
    leading = F.get(F.filter(parts, lambda p: ~p.rlike(P.CARE_OF_LEAD)), 0)
    house = C.found(full, P.HOUSE_NUMBER, 1)
    house = F.when(house != "", house).otherwise(C.found(leading, P.LEADING_NUMBER, 1))
    suffix = F.get(F.filter(F.transform(segments, lambda s: F.regexp_extract(F.trim(s), P.CITY_SUFFIX, 1)), lambda s: (s != "") & s.rlike(P.PLACE)), 0)
    town = labelled_place(segments, P.TOWN)
    return {
        "zip": C.found(full, P.PIN, 1), "care_of": name, "relation": relation,
        "country": F.when(F.contains(F.upper(full), F.lit("INDIA")), "INDIA").otherwise(""),
        "state": F.initcap(C.states_in(full)), "house_number": F.regexp_replace(house, "^[A-Za-z]-?", ""),
        "district": labelled_place(segments, P.DISTRICT, P.SUB_DISTRICT), "city": F.when(town != "", town).otherwise(C.clean_name(suffix)),
    }


def split_address(addresses: DataFrame) -> DataFrame:
    """Adds the parts of ``address`` to a table with ``address`` and ``parts`` (its lines)."""
    return staged(addresses, _part_stages)


def _part_stages() -> list[dict[str, Column]]:
    return [{k: C.blank(c) for k, c in address_parts(F.col("address"), F.col("parts")).items()}]


def best_block(span: Column, cluster: Column) -> Column:
    """``struct<parts, conf, address>``: with a PIN, then the labelled one, then the longer."""

    def rank(block: Column, labelled: int) -> Column:
        made = lambda b, full: F.struct(full.rlike(P.PIN).cast("int").alias("pin"), F.lit(labelled).alias("labelled"), F.length(full).alias("n"), b["parts"].alias("parts"), b["conf"].alias("conf"), full.alias("address"))
        return let(block, lambda b: F.when(b.isNotNull(), let(joined(b["parts"]), lambda full: made(b, full))))

    best = F.array_max(F.filter(F.array(rank(span, 1), rank(cluster, 0)), lambda x: x.isNotNull()))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["parts"].alias("parts"), b["conf"].alias("conf"), b["address"].alias("address"))))


def _blocks(regions: DataFrame, find: Callable[[Column, Column], Column], keys: tuple[str, ...], number: Column | None) -> DataFrame:
    page = pages(regions, keys)
    num = number if number is not None else C.found(page.full_text, P.AADHAAR)
    got = page.select(*keys, let(english_lines(page.ordered), lambda x: let(num, lambda n: find(x, n))).alias("b")).filter("b is not null")
    return got.select(*keys, F.col("b.parts").alias("parts"), F.col("b.conf").alias("conf"))


def address_span(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",), number: Column | None = None) -> DataFrame:
    """``keys, parts, conf`` of documents with an address label: see :func:`labelled_span`."""
    return _blocks(regions, labelled_span, keys, number)


def address_clusters(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",), number: Column | None = None) -> DataFrame:
    """``keys, parts, conf`` of documents with marker lines: see :func:`marked_cluster`."""
    return _blocks(regions, marked_cluster, keys, number)


def best_address(spans: DataFrame, clusters: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, parts, conf, address``: one block for each document, the better of two tables."""
    both = spans.withColumn("labelled", F.lit(1)).unionByName(clusters.withColumn("labelled", F.lit(0))).withColumn("address", joined(F.col("parts")))
    order = Window.partitionBy(*keys).orderBy(F.col("address").rlike(P.PIN).desc(), F.desc("labelled"), F.length("address").desc())
    return both.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(*keys, "parts", "conf", "address")


# ---- passport and licence


def back_address(ordered: Column) -> Column:
    """``struct<parts, conf>`` of the lines after ADDRESS up to the next label of the back."""
    at = place(ordered, lambda x: x["text"].rlike(P.ADDRESS_WORD))
    lines = lambda i: until(F.filter(after(ordered, i), lambda x: F.trim(x["text"]) != ""), lambda x: x["text"].rlike(P.PASSPORT_ADDRESS_STOP))
    return let(at, lambda i: F.when(i.isNotNull(), _block(F.transform(lines(i), _row))))


def passport_address(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, address, conf, pin, state``: see :func:`back_address`."""
    page = pages(regions, keys)
    got = page.select(*keys, back_address(page.ordered).alias("b"))
    full = F.regexp_replace(C.blank(F.array_join("b.parts", ", ")), r"^[ ,]+|[ ,]+$", "")
    pin = F.coalesce(F.nullif(F.regexp_extract(full, P.PIN_LABELLED, 1), F.lit("")), F.regexp_extract(full, P.PIN_LABELLED, 2))
    return got.select(*keys, full.alias("address"), F.coalesce("b.conf", F.lit(0.0)).alias("conf"), pin.alias("pin"), C.states_in(full, P.PASSPORT_STATES).alias("state"))


def licence_address_of(lines: Column, entry: Column | None = None) -> Column:
    """``struct<value, conf>`` of a licence's address; ``entry`` is that of :func:`~idweft.operators.pairing.labelled`, if at hand.

    The value column is that of the line paired with the label. Its address lines are taken
    from the label's row (or somewhat above, where the value has a column of its own) to a
    gap of more than 55 px; a value behind the label comes first.
    """

    def gather(label: Column, pair: Column) -> Column:
        anchor = pair["line"]
        own_column = anchor["x1"] > label["x2"] - 8
        top = F.when(own_column, label["y1"] - F.greatest(height(label) * 1.5, F.lit(45.0))).otherwise(label["y1"] - 5)
        column = F.array_sort(F.filter(lines, lambda x: (x["region_idx"] != label["region_idx"]) & (x["y1"] >= top) & (F.abs(x["x1"] - anchor["x1"]) <= 90) & C.is_licence_address(x["text"])))

        def to_gap(c: Column) -> Column:
            wide = F.array_min(F.filter(F.transform(c, lambda x, i: F.when((i > 0) & (x["y1"] - F.get(c, i - 1)["y2"] > 55), i)), lambda i: i.isNotNull()))
            return F.transform(F.slice(c, F.lit(1), F.coalesce(wide, F.size(c))), _row)

        glued = F.when(~own_column & (pair["value"] != ""), F.array(F.struct(pair["value"].alias("t"), pair["conf"].alias("c")))).otherwise(F.array().cast("array<struct<t:string,c:double>>"))
        single = F.struct(C.blank(pair["value"]).alias("value"), F.when(C.blank(pair["value"]) != "", pair["conf"]).otherwise(0.0).alias("conf"))

        def whole(rows: Column) -> Column:
            full = F.regexp_replace(F.array_join(F.transform(rows, lambda r: r["t"]), ", "), r"\s*,\s*", ", ")
            full = F.regexp_replace(F.regexp_replace(full, r",\s*,", ","), r"^[ ,]+|[ ,]+$", "")
            return F.when(F.size(rows) > 0, F.struct(full.alias("value"), F.get(rows, 0)["c"].alias("conf")))

        return F.coalesce(F.when(label.isNotNull() & anchor.isNotNull(), let(F.concat(glued, let(column, to_gap)), whole)), single)

    if entry is not None:
        return let(entry, lambda e: gather(e["label"], e))
    label = first(lines, lambda x: x["text"].rlike(P.DL_ADDRESS))
    return let(label, lambda x: let(paired(lines, P.DL_ADDRESS, C.is_licence_address), lambda p: gather(x, p)))


def licence_address(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, address, conf``: see :func:`licence_address_of`."""
    page = pages(regions, keys)
    got = page.select(*keys, licence_address_of(page.lines).alias("a"))
    return got.select(*keys, F.col("a.value").alias("address"), F.col("a.conf").alias("conf"))


def block_under_number(lines: Column, number: Column) -> Column:
    """Lines of the number's own column under it, to a wide gap, a marker or a date."""
    key = C.strip_id(number)

    def under(anchor: Column) -> Column:
        h = height(anchor)
        near = F.greatest(1.5 * h, 0.12 * (anchor["x2"] - anchor["x1"]))
        column = F.array_sort(F.filter(lines, lambda x: (x["region_idx"] != anchor["region_idx"]) & (F.abs(x["x1"] - anchor["x1"]) <= near) & (x["y1"] >= anchor["y1"] + 0.5 * h)))

        def walk(c: Column) -> Column:
            above = lambda i: F.when(i == 0, anchor["y2"]).otherwise(F.get(c, i - 1)["y2"])
            stop = F.array_min(F.filter(F.transform(c, lambda x, i: F.when((x["y1"] - above(i) > 1.5 * h) | x["text"].rlike(P.DL_ADDRESS_STOP) | (C.to_iso_date(x["text"]) != ""), i)), lambda i: i.isNotNull()))
            return F.slice(c, F.lit(1), F.coalesce(stop, F.size(c)))

        return F.when(anchor.isNotNull(), let(column, walk))

    anchor = F.when(key != "", first(lines, lambda x: F.contains(C.strip_id(x["text"]), key)))
    return F.coalesce(let(anchor, under), F.slice(lines, 1, 0))


def unlabelled_block(regions: DataFrame, number_rx: str = P.DL_LEGACY, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, texts`` under the number of a licence without labels: see :func:`block_under_number`."""
    page = pages(regions, keys)
    block = block_under_number(page.lines, C.found(page.full_text, number_rx))
    return page.select(*keys, F.transform(block, lambda x: x["text"]).alias("texts"))
