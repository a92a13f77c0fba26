"""Filters, admission, scores and small joins over recognised lines and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idweft.functions import patterns as P
from idweft.functions.columns import blank, is_script_garbage, uniqueness_id
from idweft.schema import KEYS

GATE, WEAK = 0.5, 0.75
#: Percentiles miss their rank by one part in this many.
ACCURACY = 100_000


# ---- admission


def admit_uploads(uploads: DataFrame, max_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """Adds ``error_code, status_code``: an empty upload is 400, one over the cap 413."""
    n = F.coalesce("n_bytes", F.lit(0))
    bad = (n == 0) | (n > max_bytes)
    return uploads.withColumn("error_code", F.when(bad, "invalid_upload")).withColumn("status_code", F.when(n == 0, 400).when(n > max_bytes, 413).otherwise(200))


def doc_types(spark) -> DataFrame:
    return spark.createDataFrame(list(P.DOC_TYPE_ROWS), "request_key string, internal_type string, display_name string, id_field string")


def normalise_doc_type(requests: DataFrame, column: str = "doc_type") -> DataFrame:
    """Adds ``internal_type, display_name, id_field, error_code``; an unknown type is an error."""
    key = F.regexp_replace(F.lower(F.trim(blank(F.col(column)))), "_", "-")
    joined = requests.withColumn("request_key", key).join(F.broadcast(doc_types(requests.sparkSession)), "request_key", "left")  # five rows
    return joined.withColumn("error_code", F.when(F.col("internal_type").isNull(), "invalid_upload"))


def error_status(outcomes: DataFrame) -> DataFrame:
    """Adds ``http_status, retryable`` of the error code; 200 and false without one."""
    codes = outcomes.sparkSession.createDataFrame(list(P.ERROR_CODES), "error_code string, http_status int, retryable boolean")
    joined = outcomes.join(F.broadcast(codes), "error_code", "left")  # eight rows
    none = F.col("error_code").isNull()
    return joined.withColumn("http_status", F.when(none, 200).otherwise(F.coalesce("http_status", F.lit(500)))).withColumn("retryable", F.coalesce("retryable", F.lit(False)))


def admit_page_requests(requests: DataFrame) -> DataFrame:
    """Adds ``error_code, status_code`` to expanded requests: no PDF is 415, a page too far 400."""
    pdf = F.lower(blank(F.col("file_name"))).endswith(".pdf")
    far = F.col("page") > F.col("page_count")
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(~pdf | far, "invalid_upload")
    return requests.withColumn("status_code", F.when(~pdf, 415).when(F.col("error_code").isNotNull() | far, 400).otherwise(200)).withColumn("error_code", code)


# ---- line filters


def valid_regions(regions: DataFrame) -> DataFrame:
    """Regions with an area."""
    return regions.filter("x2 > x1 and y2 > y1")


def split_by_gate(regions: DataFrame, gate: float = GATE) -> tuple[DataFrame, DataFrame]:
    """Lines at or above the recognition gate, and those below it."""
    conf = F.coalesce("conf", F.lit(0.0))
    return regions.filter(conf >= gate), regions.filter(conf < gate)


def weak_regions(regions: DataFrame, threshold: float = WEAK) -> DataFrame:
    """Lines that a second engine should read."""
    return regions.filter(F.coalesce("conf", F.lit(0.0)) < threshold)


def accept_recovered(regions: DataFrame, gate: float = GATE) -> DataFrame:
    """Second reads that are sure enough and hold a letter or digit; texts are trimmed."""
    return regions.withColumn("text", F.trim(blank(F.col("text")))).filter((F.coalesce("conf", F.lit(0.0)) >= gate) & F.col("text").rlike(r"[\p{L}\p{N}]"))


def drop_script_garbage(regions: DataFrame) -> DataFrame:
    return regions.filter(~is_script_garbage(blank(F.col("text"))))


def drop_duplicate_pin_lines(regions: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Drops a line without words whose PIN also stands on a line with words."""
    pin = F.regexp_extract(blank(F.col("text")), P.PIN, 1)
    worded = blank(F.col("text")).rlike("[A-Za-z]{3,}")
    rows = regions.withColumn("pin_", pin).withColumn("worded_", worded)
    known = rows.filter(F.col("worded_") & (F.col("pin_") != "")).select(*keys, "pin_").distinct()
    bare = rows.filter(~F.col("worded_")).join(known, [*keys, "pin_"], "left_anti")
    return rows.filter("worded_").unionByName(bare).drop("pin_", "worded_")


# ---- second reads


def covers(own: str, other: str) -> Column:
    """Whether box ``own`` is covered by ``other``: its centre inside, or 40 % of its area."""
    c = lambda a, n: F.col(f"{a}.{n}")
    cx, cy = (F.expr(f"({own}.{a}1 + {own}.{a}2) div 2") for a in "xy")
    inside = cx.between(c(other, "x1"), c(other, "x2")) & cy.between(c(other, "y1"), c(other, "y2"))
    shared = [F.greatest(F.lit(0), F.least(c(own, f"{a}2"), c(other, f"{a}2")) - F.greatest(c(own, f"{a}1"), c(other, f"{a}1"))) for a in "xy"]
    area = F.greatest(F.lit(1), (c(own, "x2") - c(own, "x1")) * (c(own, "y2") - c(own, "y1")))
    return inside | (shared[0] * shared[1] >= 0.4 * area)


def uncovered_boxes(dropped: DataFrame, kept: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Dropped lines that no kept line covers."""
    same = [F.col(f"d.{k}") == F.col(f"k.{k}") for k in keys]
    on = covers("d", "k")
    for s in same:
        on = s & on
    return dropped.alias("d").join(kept.alias("k"), on, "left_anti")


def add_recovered(kept: DataFrame, recovered: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Recovered lines after the kept ones; their ``region_idx`` goes on from the largest."""
    rows = kept.withColumn("later_", F.lit(0)).unionByName(recovered.withColumn("later_", F.lit(1)))
    all_lines = Window.partitionBy(*keys)
    top = F.coalesce(F.max(F.when(F.col("later_") == 0, F.col("region_idx"))).over(all_lines), F.lit(-1))
    rank = F.row_number().over(Window.partitionBy(*keys, "later_").orderBy("region_idx"))
    return rows.withColumn("region_idx", F.when(F.col("later_") == 0, F.col("region_idx")).otherwise(top + rank).cast("int")).drop("later_")


def apply_fallback(regions: DataFrame, fallback: DataFrame, keys: tuple[str, ...] = (*KEYS, "region_idx"), engine: str = "surya") -> DataFrame:
    """Takes a second engine's text where it is not blank and at least as sure."""
    other = fallback.select(*keys, F.col("text").alias("text_"), F.coalesce("conf", F.lit(0.0)).alias("conf_"))
    joined = regions.join(other, list(keys), "left")
    better = (F.trim(blank(F.col("text_"))) != "") & (F.col("conf_") >= F.coalesce("conf", F.lit(0.0)))
    take = lambda new, old: F.when(better, new).otherwise(F.col(old)).alias(old)
    new = {"text": F.col("text_"), "conf": F.col("conf_"), "engine": F.lit(engine)}
    return joined.select(*[take(new[c], c) if c in new else F.col(c) for c in regions.columns])


# ---- document scores


def document_confidence(regions: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, avg_confidence`` over lines with a confidence above 0, and ``n_regions``."""
    return regions.groupBy(*keys).agg(F.avg(F.when(F.col("conf") > 0, F.col("conf"))).alias("avg_confidence"), F.count("*").alias("n_regions"))


def orientation_vote(regions: DataFrame, keys: tuple[str, ...] = KEYS, dominance: float = 3.0, vote: float = 0.3, sure: float = 0.9) -> DataFrame:
    """``keys, angle``: the angle that stands a page upright, null where lines don't agree."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    wide, tall = w >= 1.5 * h, h >= 1.5 * w
    total = lambda test, x: F.coalesce(F.sum(F.when(test, x)), F.lit(0))
    certain = F.coalesce(F.col("cls_score") >= sure, F.lit(False))
    turned = certain & (F.col("cls_label") == "180")
    sums = regions.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[total(test & more, x).alias(f"{a}_{b}") for a, test, x in (("wide", wide, w), ("tall", tall, h)) for b, more in (("all", F.lit(True)), ("sure", certain), ("turned", turned))],
    )
    direction = F.when((F.col("wide_all") >= dominance * F.col("tall_all")) & (F.col("wide_all") > 0), "wide").when((F.col("tall_all") >= dominance * F.col("wide_all")) & (F.col("tall_all") > 0), "tall")
    pick = lambda b: F.when(F.col("direction") == "wide", F.col(f"wide_{b}")).otherwise(F.col(f"tall_{b}"))
    share = F.when(pick("sure") > 0, pick("turned") / pick("sure"))
    upright, flipped = F.when(F.col("direction") == "wide", 0).otherwise(270), F.when(F.col("direction") == "wide", 180).otherwise(90)
    angle = F.when((F.col("n") < 3) | F.col("direction").isNull(), None).when(share <= vote, upright).when(share >= 1 - vote, flipped)
    return sums.withColumn("direction", direction).select(*keys, "direction", angle.cast("int").alias("angle"))


def orientation_score(regions_by_angle: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, angle, orientation_score``: the best of the angles that were read, the first on a tie.

    A score is the number of wide lines times the mean confidence times the text's length.
    """
    conf = F.coalesce(F.avg("conf"), F.lit(0.0))
    wide = F.count_if((F.col("x2") - F.col("x1")) > (F.col("y2") - F.col("y1")))
    by_angle = regions_by_angle.groupBy(*keys, "angle").agg((wide * conf * F.sum(F.length(blank(F.col("text"))))).alias("s"))
    best = F.max(F.struct("s", (-F.col("angle")).alias("a")))
    return by_angle.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.a")).cast("int").alias("angle"), F.col("b.s").alias("orientation_score"))


# ---- attempts and reports


def full_is_better(crop: Column, full: Column) -> Column:
    """Whether the full frame's read is taken, of two structs with ``did_crop, extracted, masked4``.

    Null is an attempt that was not made, '' is not found.
    """
    has = lambda row, c: F.coalesce(row[c] != "", F.lit(False))
    found = has(full, "extracted") | (has(full, "masked4") & ~has(crop, "masked4"))
    return ~has(crop, "extracted") & F.coalesce(crop["did_crop"], F.lit(False)) & full.isNotNull() & found


def choose_attempt(attempts: DataFrame) -> DataFrame:
    """``doc_id, attempt``: the cropped read, unless only the full frame found the number.

    ``attempts`` has ``doc_id, attempt, did_crop, extracted, masked4``; see :func:`full_is_better`.
    """
    of = lambda name: F.max(F.when(F.col("attempt") == name, F.struct("did_crop", "extracted", "masked4")))
    got = attempts.groupBy("doc_id").agg(of("crop").alias("crop"), of("full").alias("full"))
    return got.select("doc_id", F.when(full_is_better(F.col("crop"), F.col("full")), "full").otherwise("crop").alias("attempt"))


def check_type(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``doc_id, intended, actual, error_code``: a document of another type than requested."""
    joined = docs.select("doc_id", F.col("doc_type").alias("actual")).join(requests.select("doc_id", F.col("doc_type").alias("intended")), "doc_id")
    return joined.select("doc_id", "intended", "actual", F.when(~F.col("actual").eqNullSafe(F.col("intended")), "document_mismatch").alias("error_code"))


def identity_groups(numbers: DataFrame, salt: str = "") -> DataFrame:
    """``uniqueness_id, n_docs, first_doc_id`` over unmasked numbers (``doc_id, number, is_masked``)."""
    real = numbers.filter((blank(F.col("number")) != "") & ~F.coalesce("is_masked", F.lit(False)))
    return real.groupBy(uniqueness_id(F.col("number"), salt).alias("uniqueness_id")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id"))


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Counts, share and latency (mean, median, 95th percentile, most) by error code; '' is success."""
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return outcomes.groupBy(blank(F.col("error_code")).alias("error_code")).agg(F.count("*").alias("n"), (F.count("*") / total).alias("share"), F.avg("elapsed_sec").alias("mean_sec"), F.percentile_approx("elapsed_sec", 0.5, ACCURACY).alias("p50_sec"), F.percentile_approx("elapsed_sec", 0.95, ACCURACY).alias("p95_sec"), F.max("elapsed_sec").alias("max_sec"))


def score_predictions(truth: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("doc_id", "side", "field")) -> DataFrame:
    """Truth with ``got``; a field that was not predicted is ''."""
    return truth.join(predictions.select(*keys, F.col("got")), list(keys), "left").withColumn("got", blank(F.col("got")))
