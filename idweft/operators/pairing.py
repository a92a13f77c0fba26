"""Finding a value by where it stands: beside, below or above a label.

Each rule is a function of a document's line array (see :mod:`idweft.operators.pages`), and a
table operator of the same meaning that gives one row for each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweft.functions import columns as C
from idweft.functions import patterns as P
from idweft.operators.pages import after, before, centre_x, centre_y, conf_for, conf_of, first, height, let, nearest, pages, place, text_of

Test = Callable[[Column], Column]
VALUE_EDGE = r"^[ \t:.\-/]+|[ \t:.\-/]+$"


def _result(value: Column, conf: Column, line: Column) -> Column:
    return F.struct(C.blank(value).alias("value"), conf.alias("conf"), line.alias("line"))


def glued_tail(line: Column, label_rx: str) -> Column:
    """What follows the label on its own line, '' unless it holds a letter or digit."""
    rest = F.regexp_replace(F.regexp_extract(text_of(line), rf"(?s)^.*?(?:{_inner(label_rx)})(.*)$", _groups(label_rx) + 1), VALUE_EDGE, "")
    return F.when(rest.rlike(r"[\p{L}\p{N}]"), rest).otherwise("")


def _inner(rx: str) -> str:
    """The pattern with a leading flag as an inline group."""
    return f"(?i:{rx[4:]})" if rx.startswith("(?i)") else rx


def _groups(rx: str) -> int:
    import re

    return re.compile(rx).groups


def paired(lines: Column, label_rx: str, accept: Test | None = None, clean: Test | None = None) -> Column:
    """``struct<value, conf, line>`` of the first line with the label.

    The text behind the label wins. Else it is the line whose centre is right of the label's
    and vertically nearest, within 1.6 label heights and at least 50 px. If nothing is found
    the value is '' with the label's confidence.
    """

    def beside(label: Column, tail: Column) -> Column:
        band = F.greatest(height(label) * 1.6, F.lit(50.0))
        dy = lambda x: F.abs(centre_y(x) - centre_y(label))

        def fits(x: Column) -> Column:
            right = (x["region_idx"] != label["region_idx"]) & (centre_x(x) > centre_x(label)) & (dy(x) <= band)
            return right & accept(F.trim(x["text"])) if accept else right

        def chosen(best: Column) -> Column:
            value = F.when(tail != "", tail).otherwise(F.trim(text_of(best)))
            value = let(value, lambda v: F.when(v != "", clean(v)).otherwise("")) if clean else value
            line = F.when((tail != "") | best.isNull(), label).otherwise(best)
            return _result(value, conf_of(line), line)

        return F.when(label.isNotNull(), let(nearest(lines, fits, dy), chosen)).otherwise(_result(F.lit(""), F.lit(0.0), label))

    label = first(lines, lambda x: x["text"].rlike(label_rx))
    return let(label, lambda x: let(glued_tail(x, label_rx), lambda t: beside(x, t)))


def labelled(lines: Column, labels: dict[str, Test | None]) -> Column:
    """A table of a page's labels, read by all fields: ``array<struct<label, tail, value, conf, line>>``.

    One entry for each of ``labels`` (a pattern, and what a value beside it must be), in their
    order, as :func:`paired` finds it; ``label`` is null where the page doesn't have it. Every
    line is tested once for each label and each kind of value, and one expression pairs them all.
    """
    tests = list({id(t): t for t in labels.values() if t}.values())
    none = F.lit(None).cast("string")

    def mark(x: Column) -> Column:
        kinds = F.array(F.lit(True), *[t(F.trim(x["text"])) for t in tests])
        tails = F.array(*[F.when(x["text"].rlike(rx), glued_tail(x, rx)).otherwise(none) for rx in labels])
        return F.struct(x.alias("line"), kinds.alias("kinds"), tails.alias("tails"))

    def entry(marked: Column, k: Column, kind: Column) -> Column:
        def beside(m: Column) -> Column:
            label, tail = m["line"], F.get(m["tails"], k)
            dy = lambda x: F.abs(centre_y(x["line"]) - centre_y(label))
            fits = lambda x: (x["line"]["region_idx"] != label["region_idx"]) & (centre_x(x["line"]) > centre_x(label)) & (dy(x) <= F.greatest(height(label) * 1.6, F.lit(50.0))) & F.get(x["kinds"], kind)
            ranked = F.transform(F.filter(marked, fits), lambda x: F.struct(dy(x).alias("d"), x["line"]["region_idx"].alias("i"), x["line"].alias("line")))
            chosen = lambda best: F.struct(label.alias("label"), tail.alias("tail"), C.blank(F.when(tail != "", tail).otherwise(F.trim(text_of(best)))).alias("value"), conf_of(F.when((tail != "") | best.isNull(), label).otherwise(best)).alias("conf"), F.when((tail != "") | best.isNull(), label).otherwise(best).alias("line"))
            return let(F.array_min(ranked)["line"], chosen)

        def missing(m: Column) -> Column:
            return F.struct(m["line"].alias("label"), F.lit("").alias("tail"), F.lit("").alias("value"), F.lit(0.0).alias("conf"), m["line"].alias("line"))

        return let(first(marked, lambda x: F.get(x["tails"], k).isNotNull()), lambda m: F.when(m.isNotNull(), beside(m)).otherwise(missing(m)))

    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(1 + [id(x) for x in tests].index(id(t)) if t else 0).alias("kind")) for k, t in enumerate(labels.values())])
    return let(F.transform(lines, mark), lambda marked: F.transform(asked, lambda a: entry(marked, a["k"], a["kind"])))


def _as_table(regions: DataFrame, found: Callable[[DataFrame], Column], keys: tuple[str, ...]) -> DataFrame:
    page = pages(regions, keys)
    got = page.select(*keys, found(page).alias("got"))
    return got.select(*keys, F.col("got.value").alias("value"), F.col("got.conf").alias("conf"))


def pair_label_value(regions: DataFrame, label_rx: str, accept: Test | None = None, clean: Test | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, value, conf``: see :func:`paired`. ``accept`` and ``clean`` map Columns to Columns."""
    return _as_table(regions, lambda p: paired(p.lines, label_rx, accept, clean), keys)


def below(lines: Column, label: Column, accept: Test) -> Column:
    """The topmost accepted line printed under a label, left-aligned with it."""
    h = height(label)
    close = lambda x: (x["y1"] >= label["y2"] - 0.3 * h) & (x["y1"] - label["y2"] <= 1.5 * h) & (F.abs(x["x1"] - label["x1"]) <= 1.5 * h)
    return nearest(lines, lambda x: (x["region_idx"] != label["region_idx"]) & close(x) & accept(F.trim(x["text"])), lambda x: x["y1"])


def value_below(regions: DataFrame, label_rx: str, accept: Test = C.is_licence_name, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, value, conf`` of the line under the first line with the label."""

    def find(p: DataFrame) -> Column:
        label = first(p.lines, lambda x: x["text"].rlike(label_rx))
        line = below(p.lines, label, accept)
        return _result(F.trim(text_of(line)), conf_of(line), line)

    return _as_table(regions, find, keys)


def masked_number(lines: Column) -> Column:
    """``struct<value, conf, line>``: last four digits of an issuer-masked number.

    On one line, or the masked groups on one and the digits on a line to its right.
    """
    whole = first(lines, lambda x: x["text"].rlike(P.MASKED_AADHAAR))
    heads = F.filter(lines, lambda x: F.trim(x["text"]).rlike(P.MASK_PREFIX))

    def digits(head: Column) -> Column:
        h = height(head)

        def beside(x: Column) -> Column:
            shared = F.least(head["y2"], x["y2"]) - F.greatest(head["y1"], x["y1"])
            level = shared >= 0.5 * F.least(h, x["y2"] - x["y1"])
            return (x["region_idx"] != head["region_idx"]) & F.trim(x["text"]).rlike(r"^\d{4}$") & level & x["x1"].between(head["x2"] - h, head["x2"] + 3 * h)

        tail = first(lines, beside)
        return F.when(tail.isNotNull(), _result(F.trim(tail["text"]), F.least(head["conf"], tail["conf"]), head))

    split = F.get(F.filter(F.transform(heads, digits), lambda x: x.isNotNull()), 0)
    one = F.when(whole.isNotNull(), _result(F.regexp_extract(text_of(whole), P.MASKED_AADHAAR, 1), conf_of(whole), whole))
    return F.coalesce(one, split, _result(F.lit(""), F.lit(0.0), whole))


def find_masked_id(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, value, conf``: see :func:`masked_number`."""
    return _as_table(regions, lambda p: masked_number(p.lines), keys)


def confidence_of(regions: DataFrame, values: DataFrame, default: float = 0.0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``values`` (``keys, value``) with ``conf`` of the first region that holds the value."""
    return values.join(pages(regions, keys).select(*keys, "lines"), list(keys), "left").withColumn("conf", conf_for(F.col("lines"), F.col("value"), default)).drop("lines")


# ---- names above and below


def above_dob(ordered: Column, dob: Column) -> tuple[Column, Column]:
    """Nearest and next name line above the line with the date: father and holder."""
    at = place(ordered, lambda x: (dob != "") & F.contains(x["text"], dob))
    names = F.reverse(F.filter(before(ordered, at), lambda x: C.is_pan_name(x["text"])))
    return F.get(names, 0), F.get(names, 1)


def names_above_dob(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, full_name, father_name`` from the two name lines nearest above the date."""
    page = pages(regions, keys)
    father, holder = above_dob(page.ordered, C.found(page.full_text, P.PAN_DATE, 1))
    return page.select(*keys, C.clean_name(text_of(holder)).alias("full_name"), C.clean_name(text_of(father)).alias("father_name"))


def anchored_name(ordered: Column, anchor_rx: str = P.DOB_ANCHOR, accept: Test = C.is_aadhaar_name) -> Column:
    """The nearest name line above the anchor, of its own column if there is one; else the first name."""
    at = place(ordered, lambda x: x["text"].rlike(anchor_rx))
    anchor = F.get(ordered, at)
    names = F.reverse(F.filter(before(ordered, at), lambda x: accept(x["text"])))
    same = first(names, lambda x: F.least(x["x2"], anchor["x2"]) - F.greatest(x["x1"], anchor["x1"]) > 0)
    return F.coalesce(same, F.get(names, 0), first(ordered, lambda x: accept(x["text"])))


def name_above(regions: DataFrame, anchor_rx: str = P.DOB_ANCHOR, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, value, conf``: see :func:`anchored_name`."""

    def find(p: DataFrame) -> Column:
        line = anchored_name(p.ordered, anchor_rx)
        return _result(C.clean_name(text_of(line)), conf_of(line), line)

    return _as_table(regions, find, keys)


def next_value(ordered: Column, label_rx: str) -> Column:
    """``struct<value, conf, line>`` of the next line with text, unless it is a label."""
    at = place(ordered, lambda x: x["text"].rlike(label_rx))
    line = first(after(ordered, at), lambda x: F.trim(x["text"]) != "")
    line = F.when(~text_of(line).rlike(P.PASSPORT_LABELS), line)
    return _result(F.trim(text_of(line)), conf_of(line), line)


def value_after(regions: DataFrame, label_rx: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, value, conf``: see :func:`next_value`."""
    return _as_table(regions, lambda p: next_value(p.ordered, label_rx), keys)


def back_names(ordered: Column) -> tuple[Column, Column, Column]:
    """First three name lines above the address: father, mother, spouse."""
    at = F.coalesce(place(ordered, lambda x: x["text"].rlike(P.ADDRESS_WORD)), F.size(ordered))
    names = F.filter(before(ordered, at), lambda x: C.is_passport_name(x["text"]))
    return F.get(names, 0), F.get(names, 1), F.get(names, 2)


def passport_back_names(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, father, mother, spouse``: see :func:`back_names`."""
    page = pages(regions, keys)
    return page.select(*keys, *[C.clean_name(text_of(x)).alias(n) for n, x in zip(("father", "mother", "spouse"), back_names(page.ordered), strict=True)])


def voter_gender(ordered: Column) -> Column:
    """``struct<value, conf, line>``: a misread gender behind its label, or on the next line."""

    def code(t: Column) -> Column:
        up, got = F.upper(t), F.lit("")
        for rx, c in reversed(P.FUZZY_GENDER):
            got = F.when(up.rlike(rx), c).otherwise(got)
        return got

    def read(x: Column, i: Column) -> Column:
        tail, following = code(F.regexp_extract(x["text"], P.VOTER_GENDER_LABEL, 1)), F.get(ordered, i + 1)
        own = _result(tail, conf_of(x), x)
        other = _result(code(text_of(following)), conf_of(following), following)
        return F.when(x["text"].rlike(P.VOTER_GENDER_LABEL), F.when(tail != "", own).otherwise(other))

    hit = F.get(F.filter(F.transform(ordered, read), lambda x: C.blank(x["value"]) != ""), 0)
    return F.coalesce(hit, _result(F.lit(""), F.lit(0.0), F.get(ordered, F.lit(-1))))


def gender_after_label(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, value, conf``: see :func:`voter_gender`."""
    return _as_table(regions, lambda p: voter_gender(p.ordered), keys)


# ---- licence: names by their order in the value column


def licence_name_lines(lines: Column, name_entry: Column | None = None, guard_entry: Column | None = None) -> Column:
    """``struct<name, name_conf, guardian, guardian_conf>``; the entries are those of :func:`labelled`, where they are at hand.

    A value behind the label wins. Else the holder is the first name-like line right of the
    label column from a row height above the label on, and the guardian the next one lower.
    Where values stand under their labels, both are looked up there.
    """
    by_label = lambda rx: first(lines, lambda x: x["text"].rlike(rx))
    floor = lambda label: centre_y(label) - F.greatest(height(label) * 1.3, F.lit(36.0))
    none = F.lit(-1)

    def found(name_label: Column, guard_label: Column, name_tail: Column, guard_tail: Column) -> Column:
        ref = F.coalesce(name_label, guard_label)
        is_label = lambda x: (x["region_idx"] == F.coalesce(name_label["region_idx"], none)) | (x["region_idx"] == F.coalesce(guard_label["region_idx"], none))
        column = F.filter(lines, lambda x: ~is_label(x) & (x["x1"] > centre_x(ref)) & C.is_licence_name(x["text"]))

        def choose(c: Column, in_column: Column, under: Column) -> Column:
            under_guard = F.when(under.isNotNull() & (guard_tail == ""), below(lines, guard_label, C.is_licence_name))
            base = F.when(in_column.isNotNull(), centre_y(in_column)).when(guard_label.isNotNull(), floor(guard_label)).otherwise(F.lit(-1.0))
            lower = F.when(under.isNull() & (guard_tail == ""), nearest(c, lambda x: centre_y(x) > base + 6, centre_y))
            name_line, guard_line = F.coalesce(in_column, under), F.coalesce(under_guard, lower)
            return F.struct(
                C.clean_name(F.when(name_tail != "", name_tail).otherwise(F.trim(text_of(name_line)))).alias("name"), F.when(name_tail != "", conf_of(name_label)).otherwise(conf_of(name_line)).alias("name_conf"),
                C.clean_guardian(F.when(guard_tail != "", guard_tail).otherwise(F.trim(text_of(guard_line)))).alias("guardian"), F.when(guard_tail != "", conf_of(guard_label)).otherwise(conf_of(guard_line)).alias("guardian_conf"),
            )

        need = (name_tail == "") & name_label.isNotNull()
        in_column = lambda c: F.when(need, nearest(c, lambda x: centre_y(x) >= floor(name_label), centre_y))
        under = lambda i: F.when(need & i.isNull(), below(lines, name_label, C.is_licence_name))
        return let(column, lambda c: let(in_column(c), lambda i: let(under(i), lambda u: choose(c, i, u))))

    if name_entry is not None:
        return let(F.struct(name_entry.alias("n"), guard_entry.alias("g")), lambda e: found(e["n"]["label"], e["g"]["label"], C.blank(e["n"]["tail"]), C.blank(e["g"]["tail"])))
    tails = lambda n, g: let(glued_tail(n, P.DL_NAME_GLUE), lambda a: let(glued_tail(g, P.DL_GUARDIAN), lambda b: found(n, g, a, b)))
    return let(by_label(P.DL_NAME_LABEL), lambda n: let(by_label(P.DL_GUARDIAN), lambda g: tails(n, g)))


def licence_names(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, name, name_conf, guardian, guardian_conf``: see :func:`licence_name_lines`."""
    page = pages(regions, keys)
    return page.select(*keys, licence_name_lines(page.lines).alias("got")).select(*keys, "got.*")


def first_match(regions: DataFrame, rx: str, group: int = 0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, value, conf`` of the first region in input order that matches."""
    hits = regions.filter(C.blank(F.col("text")).rlike(rx))
    return hits.groupBy(*keys).agg(F.min_by(F.struct(F.regexp_extract("text", rx, group).alias("value"), F.coalesce("conf", F.lit(0.0)).alias("conf")), "region_idx").alias("m")).select(*keys, "m.*")
