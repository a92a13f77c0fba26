"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex is expanded into the literal stretches that every match must hold, and
these into a Boolean query over trigrams. An index of postings (trigram, document) answers
the queries by intersection; the regex then verifies the candidates. A rule without a
mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweft.llm.storage import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` of it has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of keys that the base kinds do not name.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:long,place:int,kind:string,end:long>"
_GAP = "\0"
#: A class of more characters than this, or a product of more strings, counts as a gap.
_MOST_CHARS, _MOST_STRINGS = 8, 256


def _expansions(parsed) -> list[str]:
    """Strings that cover all matches of a parsed regex; a gap stands for anything."""
    found = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= _MOST_CHARS:
            more = [chr(c) for _, c in arg]
        elif name == "SUBPATTERN":
            more = _expansions(arg[-1])
        elif name == "BRANCH":
            more = [x for part in arg[1] for x in _expansions(part)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, part = arg
            once = _expansions(part)
            if (least, most) == (0, 1):
                more = ["", *once]
            else:
                more = [_GAP] if least == 0 else ([] if least > 1 else once) + [a + _GAP + b for a, b in product(once, once)]
        else:
            more = [_GAP]
        found = [a + b for a, b in product(found, dict.fromkeys(more))]
        if len(found) > _MOST_STRINGS:
            found = [_GAP]
    return found


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that a match holds; [] if any text may match."""
    sets = set()
    for text in _expansions(re._parser.parse(regex)):
        sets.add(frozenset(part[i : i + 3] for part in text.lower().split(_GAP) for i in range(len(part) - 2)))
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(trigram, doc_key)`` of the given trigrams over the lower-cased texts."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return docs.select(F.col(id_col).alias("doc_key"), low.alias("low")).select(F.explode(held).alias("trigram"), "doc_key")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """Documents whose postings satisfy some rule's query: ``doc_key, rules`` (a bit for each rule)."""
    queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
    bits = {t: i for i, t in enumerate(sorted({t for q in queries.values() for s in q for t in s}))}
    words = range(max(bits.values(), default=0) // 62 + 1)
    place = F.create_map(*[F.lit(x) for t, i in bits.items() for x in (t, i)])
    of = postings.withColumn("place", F.element_at(place, F.col("trigram")))
    masks = of.groupBy("doc_key").agg(*[F.bit_or(F.when(F.expr(f"place div 62 = {w}"), F.expr("shiftleft(1L, int(place % 62))")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words])

    def holds(trigrams: frozenset[str]) -> Column:
        need = {w: sum(1 << bits[t] % 62 for t in trigrams if bits[t] // 62 == w) for w in words}
        return reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(n).cast("long")) == F.lit(n).cast("long") for w, n in need.items() if n])

    flag = reduce(Column.__add__, [F.when(reduce(Column.__or__, map(holds, q)), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in queries.items() if q])
    return masks.select("doc_key", flag.alias("rules")).filter("rules > 0")


def rule_spans(text: Column, order: int, rule: Rule) -> Column:
    """Array of ``(start, place, kind, end)`` of a rule's counted matches, in code points.

    Splitting at the matches gives the text between them, so each start is a running sum
    of lengths. The pattern is applied as it is, and short matches are dropped after it.
    """
    rx = F.lit(rule.regex)
    gaps, matches = F.split(text, rule.regex, -1), F.regexp_extract_all(text, rx, F.lit(0))
    tested = matches if rule.group == 0 else F.regexp_extract_all(text, rx, F.lit(rule.group))
    rows = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"), tested.alias("part"))

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        start = at + F.length(row["gap"])
        end = start + F.length(row["hit"])
        span = F.struct(start.cast("long").alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        return F.coalesce(end, start).cast("long"), F.when(row["hit"].isNotNull() & (F.length(row["part"]) >= rule.least), span)

    return folded(rows, step, SPAN)


def folded(items: Column, step, kind: str) -> Column:
    """What ``step(at, item)`` gives along an array, without the nulls: ``at`` is a running number.

    ``step`` returns the next ``at`` and an element of type ``kind`` or null. A growing array is
    copied for each element that it takes, so elements gather in blocks of about the square
    root of their number, and the blocks in an outer array.
    """
    let = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    many_of = lambda x: F.ceil(F.sqrt(F.size(x))).cast("int")

    def block(x: Column, at: Column, first: Column, n: Column) -> Column:
        empty = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def one(state: Column, item: Column) -> Column:
            after, found = step(state["at"], item)
            return let(found, lambda f: F.struct(after.alias("at"), F.when(f.isNotNull(), F.concat(state["out"], F.array(f))).otherwise(state["out"]).alias("out")))

        return F.aggregate(F.slice(x, first, n), empty, one)

    def blocks(x: Column, n: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        merge = lambda state, first: let(block(x, state["at"], first, n), lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(F.sequence(F.lit(1), F.size(x), n), none, merge, lambda state: F.flatten(state["out"]))

    return let(items, lambda x: F.when(F.size(x) > 0, let(many_of(x), lambda n: blocks(x, n))).otherwise(F.array().cast(f"array<{kind}>")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as the rules are listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of every whole text: ``id_col, text_col, found`` (array of spans, see :func:`rule_spans`).

    A null text counts as empty and gives an empty array, as does a text without secrets.
    Null, tied and repeated ids keep their rows (postings are joined null-safely and hold
    an id once). Columns other than the two and those in ``keep`` are left out.
    """
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({t for q in queries for s in q for t in s})
    held = {f"kept_{i}": name for i, name in enumerate(keep)}
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("doc_text"), *[F.col(name).alias(k) for k, name in held.items()])
    postings = written(trigram_index(rows, trigrams, "doc_key", "doc_text"), "trigram_index")
    flagged = written(candidates(postings, rules).withColumnRenamed("doc_key", "flagged_key"), "candidates")
    text = F.coalesce(F.col("doc_text"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        asked = F.col("rules").bitwiseAND(F.lit(1 << i)) != 0 if query else F.lit(True)
        shortest = f"{rule.regex[:-1]}{{{rule.least}}}" if rule.group == 0 and rule.regex.endswith("]+") and rule.regex.startswith("[") else rule.regex
        found.append(F.when(asked & text.rlike(shortest), rule_spans(text, i, rule)).otherwise(none))
    joined = rows.join(flagged, F.col("doc_key").eqNullSafe(F.col("flagged_key")), "left")
    return joined.select(F.col("doc_key").alias(id_col), F.col("doc_text").alias(text_col), *[F.col(k).alias(name) for k, name in held.items()], F.concat(*found).alias("found"))


#: Characters of the pieces that a text is read in where parts of it are taken.
_PIECE = 4_096


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap are replaced as one.

    The text is cut into pieces first, so that what stands between two spans is found without
    counting its characters from the start.
    """
    let = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    clear = lambda at, x: (F.greatest(at, x["end"]), F.when(x["start"] >= at, F.struct(at.alias("from"), x["start"].alias("to"))))

    def part(pieces: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / _PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, F.floor(end / _PIECE).cast("int") - first + 1), "")
        return F.substring(held, (begin - F.lit(_PIECE) * first + 1).cast("int"), (end - begin).cast("int"))

    def whole(pieces: Column) -> Column:
        between = F.transform(folded(F.array_sort(found), clear, "struct<from:long,to:long>"), lambda g: part(pieces, g["from"], g["to"]))
        last = F.array_max(F.transform(found, lambda x: x["end"]))
        return F.array_join(F.concat(between, F.array(part(pieces, last, F.length(text).cast("long")))), mark)

    return F.when(F.size(found) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), whole))
