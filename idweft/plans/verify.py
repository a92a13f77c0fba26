"""From the attempts at a document to its outcome, and reports on outcomes and accuracy."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.functions import columns as C
from idweft.functions import patterns as P
from idweft.operators import classify as K
from idweft.operators import pairing as R
from idweft.operators.pages import pages
from idweft.operators.regions import full_is_better

KEYS = ("doc_id", "attempt")


def read_attempts(regions: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each attempt: class, number, masked digits and confidence.

    ``requests`` has ``doc_id, doc_type, did_crop``. A number is read only from a document
    of the requested class.
    """
    # dealt by document, so that its attempts and its request meet without another exchange
    dealt = regions.repartition("doc_id")
    page = pages(dealt, KEYS, second=F.max(F.coalesce(F.col("engine") == "surya", F.lit(False))))
    conf = F.filter(F.transform("lines", lambda x: x["conf"]), lambda c: c > 0)
    page = page.select(
        *KEYS, "second", K.class_of(page.full_text).alias("actual"), "full_text", R.masked_number(page.lines)["value"].alias("last4"), F.size("lines").alias("n_regions"),
        (F.aggregate(conf, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(conf), F.lit(0))).alias("avg_confidence"),
    )
    page = page.join(requests.select("doc_id", F.col("doc_type").alias("intended"), "did_crop"), "doc_id")
    same = F.col("actual") == F.col("intended")
    number = F.when(same, K.id_of(F.col("full_text"), F.col("actual")))
    page = page.withColumn("extracted", C.blank(number))
    return page.withColumn("masked4", F.when(same & (F.col("actual") == "AADHAAR") & (F.col("extracted") == ""), F.col("last4")).otherwise("")).drop("last4", "full_text")


def verify_documents(regions: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each document: status, error code, number as shown, and what was decided."""
    attempts = read_attempts(regions, requests)
    row = F.struct(*[F.col(c) for c in attempts.columns if c != "doc_id"])
    of = lambda name: F.max(F.when(F.col("attempt") == name, row)).alias(name)
    both = attempts.groupBy("doc_id").agg(of("crop"), of("full"))
    both = both.withColumn("fulls", F.col("full").isNotNull()).withColumn("crop_id", C.blank(F.col("crop.extracted")))
    row = both.select("doc_id", "fulls", "crop_id", F.when(full_is_better(F.col("crop"), F.col("full")), F.col("full")).otherwise(F.col("crop")).alias("row"))
    row = row.filter("row is not null").select("doc_id", "fulls", "crop_id", "row.*")
    masked = (F.col("extracted") == "") & (F.col("masked4") != "")
    number = F.when(masked, F.concat(F.lit("XXXX XXXX "), F.col("masked4"))).otherwise(F.col("extracted"))
    error = F.when(F.col("actual") != F.col("intended"), "document_mismatch").when(number == "", "id_not_found")
    ok = error.isNull()
    retried = F.col("did_crop") & (F.col("crop_id") == "") & F.col("fulls")
    word = lambda test: F.when(test, "yes").otherwise("no")
    reason = F.concat(F.lit("located "), F.col("n_regions").cast("string"), F.lit(" regions; surya_fallback="), word(F.col("second")), F.lit("; retry_uncropped="), word(retried))
    return row.select(
        "doc_id", "intended", "actual", "attempt", F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"), error.alias("error_code"),
        F.when(ok, number).alias("extracted_id"), F.when(ok, C.mask_id(number, F.col("actual"))).alias("masked_id"), (ok & masked).alias("already_masked"),
        "avg_confidence", F.when(F.col("second"), "rapidocr+surya").otherwise("rapidocr").alias("engine"), reason.alias("reason"),
    )


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching ratio of two strings, from 0 to 1, in Arrow batches."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def accuracy_report(scored: DataFrame, address_ok: float = 0.90) -> DataFrame:
    """``field, ok, n, mean_similarity`` for each field, and for all in the row ALL.

    ``scored`` has ``field, want, got``. Fields are equal after normalising; an address counts
    from a similarity of ``address_ok`` on. Only addresses pass through the similarity.
    """
    rows = scored.withColumn("w", C.comparable(F.col("want"))).withColumn("g", C.comparable(F.col("got")))
    exact = rows.filter("field <> 'address'").select("field", (F.col("w") == F.col("g")).alias("ok"), F.lit(None).cast("double").alias("sim"))
    address = rows.filter("field = 'address'").select("field", similarity("g", "w").alias("sim"))
    both = exact.unionByName(address.select("field", (F.col("sim") >= address_ok).alias("ok"), "sim"))
    return both.rollup("field").agg(F.count_if("ok").alias("ok"), F.count("*").alias("n"), F.avg("sim").alias("mean_similarity")).select(F.coalesce("field", F.lit("ALL")).alias("field"), "ok", "n", "mean_similarity")


def masked_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_type, extracted_id, masked_id`` of ``doc_id, full_text``: the shortest useful job."""
    kind = K.class_of(F.col("full_text"))
    got = docs.withColumn("doc_type", kind).withColumn("extracted_id", K.id_of(F.col("full_text"), F.col("doc_type")))
    return got.select("doc_id", "doc_type", "extracted_id", C.mask_id(F.col("extracted_id"), F.col("doc_type")).alias("masked_id"))


ID_FIELDS = {row[1]: row[3] for row in P.DOC_TYPE_ROWS}
