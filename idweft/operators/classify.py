"""Document classes by weighted signatures, and the number that belongs to a class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweft.functions import columns as C
from idweft.functions import patterns as P

SPLIT_MASK = r"(?m)^\W*[X×*•#]{4}\s?[X×*•#]{4}\W*$"


def signatures(spark) -> DataFrame:
    """``doc_type, keyword, keyword_ns, weight``: 34 rows."""
    table = spark.createDataFrame(list(P.SIGNATURES), "doc_type string, keyword string, weight int")
    return table.withColumn("keyword_ns", F.regexp_replace("keyword", r"\s+", ""))


def _bonus(text: Column) -> dict[str, Column]:
    add = lambda test, n: F.when(test, n).otherwise(0)
    no_licence = F.regexp_replace(text, P.DL_LEGACY, " ")
    return {
        "VOTER_ID": add(text.rlike(P.EPIC), 50),
        "DRIVING_LICENSE": add(text.rlike(P.DL_MODERN), 60) + add(text.rlike(P.DL_LEGACY), 60),
        "PAN": add(text.rlike(P.PAN), 50),
        "AADHAAR": add(no_licence.rlike(P.AADHAAR) | text.rlike(P.MASKED_AADHAAR.removeprefix("(?i)")) | text.rlike(SPLIT_MASK), 50) + add(text.rlike(P.VID_LABEL), 30),
        "PASSPORT": add(text.rlike("P<[A-Z]{3}") | text.rlike("P<<[A-Z]"), 80) + add(text.rlike(rf"\b{P.PASSPORT}\b"), 30),
    }


def score_documents(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, doc_type, score`` for every class: keyword weights and pattern bonuses.

    ``docs`` has ``keys, full_text``. A keyword counts in the text or, without spaces, in
    the text without spaces. The keywords are joined once, broadcast (34 rows).
    """
    text = F.upper(C.blank(F.col("full_text")))
    base = docs.select(*keys, text.alias("t_"), F.regexp_replace(text, r"\s+", "").alias("ns_"))
    table = signatures(docs.sparkSession)
    hits = base.join(F.broadcast(table), F.contains(F.col("t_"), F.col("keyword")) | F.contains(F.col("ns_"), F.col("keyword_ns")))
    hits = hits.select(*keys, "doc_type", F.col("weight").cast("long").alias("score"))
    kinds = F.array(*[F.struct(F.lit(k).alias("doc_type"), c.cast("long").alias("score")) for k, c in _bonus(F.col("t_")).items()])
    bonus = base.select(*keys, F.explode(kinds).alias("b")).select(*keys, "b.*")
    return hits.unionByName(bonus).groupBy(*keys, "doc_type").agg(F.sum("score").alias("score"))


def keyword_score(text: Column, doc_type: str) -> Column:
    """The keyword part of one class's score, as a function of the text."""
    ns = F.regexp_replace(text, r"\s+", "")
    rows = [(k, w) for d, k, w in P.SIGNATURES if d == doc_type]
    return reduce(Column.__add__, [F.when(F.contains(text, F.lit(k)) | F.contains(ns, F.lit("".join(k.split()))), w).otherwise(0) for k, w in rows])


def class_of(text: Column) -> Column:
    """The class of an upper-cased text as one expression: no join, no shuffle."""
    bonus = _bonus(text)
    scored = [F.struct((keyword_score(text, d) + bonus[d]).cast("long").alias("s"), F.lit(-i).alias("p"), F.lit(d).alias("d")) for i, d in enumerate(P.DOC_TYPES)]
    best = F.array_max(F.array(*scored))
    return F.when(best["s"] > 0, best["d"]).otherwise("UNKNOWN")


def classify(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, doc_type, score``: the best class; ties in the fixed order, UNKNOWN without a score."""
    order = F.create_map(*[F.lit(x) for i, d in enumerate(P.DOC_TYPES) for x in (d, -i)])
    best = score_documents(docs, keys).groupBy(*keys).agg(F.max(F.struct("score", F.element_at(order, F.col("doc_type")).alias("p"), "doc_type")).alias("b"))
    return best.select(*keys, F.when(F.col("b.score") > 0, F.col("b.doc_type")).otherwise("UNKNOWN").alias("doc_type"), F.col("b.score").alias("score"))


def id_of(full_text: Column, doc_type: Column) -> Column:
    """First number of a class in the text, inner white space as one space; null if none."""
    got = F.lit(None).cast("string")
    for kind, rx in P.ID_BY_TYPE.items():
        got = F.when(doc_type == kind, F.regexp_extract(F.upper(C.blank(full_text)), rx, 0)).otherwise(got)
    got = F.trim(F.regexp_replace(got, r"\s+", " "))
    return F.when(got != "", got)


def extract_id(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, doc_type, extracted_id`` of ``docs`` (``keys, full_text, doc_type``)."""
    return docs.select(*keys, "doc_type", id_of(F.col("full_text"), F.col("doc_type")).alias("extracted_id"))


def passport_side(full_text: Column) -> Column:
    """'back' if two or more of the back's labels are there."""
    ns = C.squeeze(full_text)
    hits = reduce(Column.__add__, [F.contains(ns, F.lit(k)).cast("int") for k in P.PASSPORT_BACK_KEYS])
    return F.when(hits >= 2, "back").otherwise("front")


def voter_side(full_text: Column) -> Column:
    """'back' for an address without the front's words."""
    up = F.upper(full_text)
    return F.when(F.contains(up, F.lit("ADDRESS")) & ~up.rlike(P.VOTER_FRONT), "back").otherwise("front")


def route_side(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, doc_type, side``: passports and voter cards by side, '' for other classes."""
    kind, text = F.col("doc_type"), C.blank(F.col("full_text"))
    return docs.select(*keys, "doc_type", F.when(kind == "PASSPORT", passport_side(text)).when(kind == "VOTER_ID", voter_side(text)).otherwise("").alias("side"))
