"""The registered queries of the card library, on data derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idweft.functions import columns as C
from idweft.functions import patterns as P
from idweft.operators import blocks, classify, masking, pages, pairing, regions
from idweft.plans import extract, verify
from idweft.sources import cards, readers, scratch, sinks
from idweft.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = ("doc_id",)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.regions_from_text(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.full_text(cards.card_regions(spark, sf_dir), K)


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.masked_ids(_docs(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c, _, _ in P.ERROR_CODES])
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").alias("doc_id"), "ts", F.when(F.col("event_type") == "error", F.element_at(codes, (F.col("event_id") % 8 + 1).cast("int"))).alias("error_code"), F.col("value").alias("elapsed_sec"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("aadhaar", " PAN ", "voter_id", "Passport", "driving-license", "visa", "")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.octet_length("html").cast("long").alias("n_bytes"), F.element_at(kinds, (F.col("page_id") % 7 + 1).cast("int")).alias("doc_type"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array(*map(F.lit, (" 4, 5 ,4", "", "0", "-1", "a", "4,x", "1,2,3,4,5", "3", "1,,2")))
    n = F.col("page_id")
    name = F.when(n % 5 == 0, "scan.png").otherwise("scan.PDF")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(n.alias("doc_id"), name.alias("file_name"), F.element_at(lists, (n % 9 + 1).cast("int")).alias("pages"), (n % 6).cast("int").alias("page_count"))


# ---- lines


@query
def reading_order(spark, sf_dir):
    return pages.reading_order(_text(spark, sf_dir)).select("doc_id", "region_idx", "rn")


@query
def document_confidence(spark, sf_dir):
    return regions.document_confidence(_text(spark, sf_dir), K).select("doc_id", F.round("avg_confidence", 6).alias("avg_confidence"), "n_regions")


@query
def gate_split(spark, sf_dir):
    kept, dropped = regions.split_by_gate(_text(spark, sf_dir), 0.7)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    return count(kept, "n_kept").join(count(dropped, "n_dropped"), "doc_id", "full").select("doc_id", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))


@query
def weak_regions(spark, sf_dir):
    return regions.weak_regions(_text(spark, sf_dir)).select("doc_id", "region_idx", "conf")


@query
def valid_regions(spark, sf_dir):
    return regions.valid_regions(_text(spark, sf_dir)).select("doc_id", "region_idx")


@query
def accept_recovered(spark, sf_dir):
    return regions.accept_recovered(_text(spark, sf_dir), 0.9).select("doc_id", "region_idx", F.length("text").alias("n_chars"))


@query
def drop_script_garbage(spark, sf_dir):
    return regions.drop_script_garbage(_text(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query
def drop_duplicate_pin_lines(spark, sf_dir):
    return regions.drop_duplicate_pin_lines(cards.card_regions(spark, sf_dir)).select("doc_id", "region_idx")


@query
def uncovered_boxes(spark, sf_dir):
    kept, dropped = regions.split_by_gate(cards.card_regions(spark, sf_dir), 0.75)
    moved = dropped.withColumn("x1", (F.col("x1") + F.col("region_idx") * 9 % 40).cast("int")).withColumn("y1", (F.col("y1") - 45 + F.col("region_idx") % 3 * 8).cast("int")).withColumn("y2", (F.col("y1") + 24).cast("int"))
    return regions.uncovered_boxes(moved, kept).select("doc_id", "region_idx")


@query
def add_recovered(spark, sf_dir):
    kept, dropped = regions.split_by_gate(cards.card_regions(spark, sf_dir), 0.7)
    return regions.add_recovered(kept, dropped).select("doc_id", "region_idx", "text")


@query
def apply_fallback(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    second = rows.filter("conf < 0.75").select("doc_id", "attempt", "region_idx", F.when(F.col("region_idx") % 3 == 0, " ").otherwise(F.lower("text")).alias("text"), (F.col("conf") + (F.col("doc_id") % 3 - 1) * 0.25).alias("conf"))
    return regions.apply_fallback(rows, second).select("doc_id", "region_idx", "text", F.round("conf", 6).alias("conf"), "engine")


@query
def orientation_vote(spark, sf_dir):
    return regions.orientation_vote(cards.card_regions(spark, sf_dir), K)


@query
def orientation_score(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    turned = rows.withColumn("angle", F.lit(0)).unionByName(rows.withColumn("angle", F.lit(90)).withColumn("x2", F.col("x1") + 24).withColumn("y2", F.col("y1") + 200))
    return regions.orientation_score(turned).select("doc_id", "angle", F.round("orientation_score", 4).alias("orientation_score"))


@query
def first_match(spark, sf_dir):
    return pairing.first_match(_text(spark, sf_dir), r"\b\d{4,}\b").select("doc_id", "value", "conf")


# ---- admission


@query
def admit_uploads(spark, sf_dir):
    return regions.admit_uploads(_uploads(spark, sf_dir), 3_000).select("doc_id", "n_bytes", "error_code", "status_code")


@query
def doc_type_lookup(spark, sf_dir):
    return regions.normalise_doc_type(_uploads(spark, sf_dir)).select("doc_id", "internal_type", "display_name", "id_field", "error_code")


@query
def page_requests(spark, sf_dir):
    return regions.admit_page_requests(readers.expand_page_requests(_requests(spark, sf_dir))).select("doc_id", "request_no", "page", "error_code", "status_code")


@query
def page_lines(spark, sf_dir):
    lines = _text(spark, sf_dir).select("doc_id", F.col("region_idx").alias("line_no"), "text", (F.col("conf") / 3).alias("confidence"), F.array("x1", "y1", "x2", "y2").cast("array<double>").alias("bbox"))
    return readers.clean_page_lines(lines).select("doc_id", "line_no", "confidence", F.element_at("bbox", 3).alias("x2"))


# ---- classes and numbers


@query
def classify_documents(spark, sf_dir):
    return classify.classify(_docs(spark, sf_dir))


@query
def extract_id(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("doc_type", classify.class_of(F.col("full_text")))
    return classify.extract_id(docs)


@query
def masked_id(spark, sf_dir):
    return _ids(spark, sf_dir)


@query
def route_side(spark, sf_dir):
    return classify.route_side(_docs(spark, sf_dir).withColumn("doc_type", classify.class_of(F.col("full_text"))))


@query
def type_mismatch(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", classify.class_of(F.col("full_text")).alias("doc_type"))
    return regions.check_type(docs, cards.card_requests(spark, sf_dir))


@query
def verify_outcomes(spark, sf_dir):
    out = verify.verify_documents(cards.attempt_regions(spark, sf_dir), cards.card_requests(spark, sf_dir))
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def choose_attempt(spark, sf_dir):
    return regions.choose_attempt(verify.read_attempts(cards.attempt_regions(spark, sf_dir), cards.card_requests(spark, sf_dir)))


@query
def identity_groups(spark, sf_dir):
    front = extract.extract_aadhaar_front(cards.card_regions(spark, sf_dir))
    return regions.identity_groups(front.select("doc_id", F.col("aadhaar_number").alias("number"), "is_masked"))


# ---- masking


@query
def id_hits(spark, sf_dir):
    return masking.id_hits(cards.card_regions(spark, sf_dir), _ids(spark, sf_dir)).select("doc_id", "region_idx", "n_chars", "doc_type")


def _pieces(spark, sf_dir):
    """Cards whose number stands in three boxes of one row."""
    rows = cards.card_regions(spark, sf_dir).filter(F.col("text").rlike(r"^\d{4} \d{4} \d{4}$"))
    part = rows.select("doc_id", "attempt", "region_idx", "conf", "y1", "y2", F.posexplode(F.split("text", " ")).alias("i", "text"))
    x = (40 + F.col("i") * (60 + F.col("doc_id") % 4 * 10)).cast("int")
    return part.select("doc_id", "attempt", (F.col("region_idx") * 10 + F.col("i")).alias("region_idx"), "text", "conf", x.alias("x1"), (F.col("y1") + F.col("i") * (F.col("doc_id") % 3) * 7).cast("int").alias("y1"), (x + 48).alias("x2"), (F.col("y2") + F.col("i") * (F.col("doc_id") % 3) * 7).cast("int").alias("y2"))


@query
def mask_boxes_merged(spark, sf_dir):
    return masking.merge_boxes(masking.id_hits(_pieces(spark, sf_dir), _ids(spark, sf_dir))).drop("doc_type")


@query
def merge_gap(spark, sf_dir):
    return masking.merge_gap(masking.id_hits(cards.card_regions(spark, sf_dir), _ids(spark, sf_dir)))


def _sizes(rows):
    return rows.groupBy("doc_id").agg((F.max("x2") + 20).alias("width"), (F.max("y2") + 20).alias("height"))


@query
def mask_rects(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    return masking.mask_rects(rows, _ids(spark, sf_dir), _sizes(rows))


@query
def mask_report(spark, sf_dir):
    out = masking.mask_pages(cards.card_regions(spark, sf_dir))
    return out.withColumn("masked_regions", F.to_json("masked_regions"))


@query
def masked_id_find(spark, sf_dir):
    return pairing.find_masked_id(cards.card_regions(spark, sf_dir)).filter("value <> ''")


@query
def redact_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return masking.redact_text(docs).select("doc_id", "redacted", F.sha2("text", 256).alias("text_sha256"))


# ---- pairing


@query
def label_value_pairs(spark, sf_dir):
    return pairing.pair_label_value(cards.card_regions(spark, sf_dir), P.DL_BLOOD, C.is_blood_group).filter("value <> ''")


@query
def value_below(spark, sf_dir):
    return pairing.value_below(cards.card_regions(spark, sf_dir), r"(?i)^Name of (?:Father|Mother)$").filter("value <> ''")


@query
def confidence_lookup(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    values = _ids(spark, sf_dir).select("doc_id", F.col("extracted_id").alias("value"))
    return pairing.confidence_of(rows, values)


@query
def names_above_dob(spark, sf_dir):
    return pairing.names_above_dob(cards.card_regions(spark, sf_dir))


@query
def name_above(spark, sf_dir):
    return pairing.name_above(cards.card_regions(spark, sf_dir))


@query
def value_after(spark, sf_dir):
    return pairing.value_after(cards.card_regions(spark, sf_dir), r"(?i)OLD\s*PASSPORT").filter("value <> ''")


@query
def passport_back_names(spark, sf_dir):
    return pairing.passport_back_names(cards.card_regions(spark, sf_dir))


@query
def gender_after_label(spark, sf_dir):
    return pairing.gender_after_label(cards.card_regions(spark, sf_dir)).filter("value <> ''")


@query
def licence_names(spark, sf_dir):
    return pairing.licence_names(cards.card_regions(spark, sf_dir))


# ---- addresses


def _flat(df):
    return df.select("doc_id", F.array_join("parts", " | ").alias("parts"), F.round("conf", 6).alias("conf"))


@query
def address_span(spark, sf_dir):
    return _flat(blocks.address_span(cards.card_regions(spark, sf_dir)))


@query
def address_clusters(spark, sf_dir):
    return _flat(blocks.address_clusters(cards.card_regions(spark, sf_dir)))


@query
def best_address(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    return blocks.best_address(blocks.address_span(rows), blocks.address_clusters(rows)).select("doc_id", "address", F.round("conf", 6).alias("conf"))


@query
def split_address(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    best = blocks.best_address(blocks.address_span(rows), blocks.address_clusters(rows))
    return blocks.split_address(best).drop("parts", "conf")


@query
def state_repair(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    best = blocks.best_address(blocks.address_span(rows), blocks.address_clusters(rows)).select("doc_id", "address")
    return blocks.repair_states(best)


@query
def passport_address(spark, sf_dir):
    return blocks.passport_address(cards.card_regions(spark, sf_dir)).filter("address <> ''").withColumn("conf", F.round("conf", 6))


@query
def licence_address(spark, sf_dir):
    return blocks.licence_address(cards.card_regions(spark, sf_dir)).filter("address <> ''")


@query
def unlabelled_block(spark, sf_dir):
    return blocks.unlabelled_block(cards.card_regions(spark, sf_dir)).filter("size(texts) > 0").select("doc_id", F.array_join("texts", " | ").alias("texts"))


# ---- jobs


@query
def extract_pan(spark, sf_dir):
    return extract.extract_pan(cards.card_regions(spark, sf_dir))


@query
def dob_ladder(spark, sf_dir):
    return extract.extract_dob(cards.card_regions(spark, sf_dir))


@query
def extract_aadhaar_front(spark, sf_dir):
    return extract.extract_aadhaar_front(cards.card_regions(spark, sf_dir))


@query
def extract_aadhaar_back(spark, sf_dir):
    return extract.extract_aadhaar_back(cards.card_regions(spark, sf_dir))


@query
def aadhaar_sides(spark, sf_dir):
    return extract.aadhaar_sides(cards.card_regions(spark, sf_dir))


@query
def extract_passport_front(spark, sf_dir):
    return extract.extract_passport_front(cards.card_regions(spark, sf_dir))


@query
def extract_passport_back(spark, sf_dir):
    return extract.extract_passport_back(cards.card_regions(spark, sf_dir))


@query
def mrz_fields(spark, sf_dir):
    return extract.mrz_fields(cards.card_regions(spark, sf_dir))


@query
def extract_licence(spark, sf_dir):
    return extract.extract_licence(cards.card_regions(spark, sf_dir))


@query
def extract_voter_front(spark, sf_dir):
    return extract.extract_voter_front(cards.card_regions(spark, sf_dir))


@query
def extract_voter_back(spark, sf_dir):
    return extract.extract_voter_back(cards.card_regions(spark, sf_dir))


# ---- reports and contracts


@query
def accuracy_report(spark, sf_dir):
    rows = cards.card_regions(spark, sf_dir)
    front = extract.extract_aadhaar_front(rows)
    got = front.select("doc_id", F.lit("front").alias("side"), F.explode(F.create_map(*[x for f in ("aadhaar_number", "dob", "full_name", "gender") for x in (F.lit(f), F.col(f))])).alias("field", "got"))
    back = extract.extract_aadhaar_back(rows).select("doc_id", F.lit("back").alias("side"), F.lit("address").alias("field"), F.col("address").alias("got"))
    out = verify.accuracy_report(regions.score_predictions(cards.card_truth(spark, sf_dir), got.unionByName(back)))
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query
def outcome_report(spark, sf_dir):
    return regions.outcome_report(_outcomes(spark, sf_dir)).select("error_code", "n", F.round("share", 6).alias("share"), F.round("mean_sec", 6).alias("mean_sec"), "p50_sec", "p95_sec", "max_sec")


@query
def error_status(spark, sf_dir):
    return regions.error_status(_outcomes(spark, sf_dir)).select("doc_id", "error_code", "http_status", "retryable")


@query
def outcome_windows(spark, sf_dir):
    return streams.outcome_windows(_outcomes(spark, sf_dir)).withColumn("failure_rate", F.round("failure_rate", 6))


@query
def outcome_code_windows(spark, sf_dir):
    return streams.outcome_codes(_outcomes(spark, sf_dir)).withColumn("mean_sec", F.round("mean_sec", 6))


@query
def outcome_sliding(spark, sf_dir):
    return streams.outcome_windows(_outcomes(spark, sf_dir), "1 hour", slide="15 minutes").withColumn("failure_rate", F.round("failure_rate", 6))


@query
def outcome_alerts(spark, sf_dir):
    windows = streams.outcome_windows(_outcomes(spark, sf_dir), "6 hours", slide="1 hour")
    return streams.outcome_alerts(windows, 0.22, 5).withColumn("failure_rate", F.round("failure_rate", 6))


@query
def identity_contracts(spark, sf_dir):
    return streams.extract_stream(_docs(spark, sf_dir), text_col="full_text")


@query
def dedup_horizon(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_id").alias("doc_id"), "ts", C.uniqueness_id(F.col("user_id").cast("string")).alias("uniqueness_id"))
    return streams.dedup_within(rows, 86_400)


@query
def normalised_text(spark, sf_dir):
    """Texts in full-width marks and digits, ligatures and parted accents, and their normal form."""
    wide = F.translate("text", "0123456789.,:!", "０１２３４５６７８９．，：！")
    for plain, other in (("fi", "ﬁ"), ("é", "e\u0301"), ("ü", "u\u0308"), ("kg", "㎏")):
        wide = F.replace(wide, F.lit(plain), F.lit(other))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", wide.alias("wide"))
    return docs.select("doc_id", F.length("wide").alias("n_wide"), C.nfkc(F.col("wide")).alias("t")).select("doc_id", "n_wide", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def _stored(df, name):
    """A folder of text lines in the session's shared folder."""
    path = f"{scratch.folder(df.sparkSession)}/idweft-{uuid.uuid4().hex}/{name}"
    df.write.text(path)
    return path


@query
def regions_round_trip(spark, sf_dir):
    """Cards as JSON lines, some cut short and some without a key or box, read again."""
    rows = cards.card_regions(spark, sf_dir)
    case = (F.col("doc_id") * 7 + F.col("region_idx")) % 29
    hit = lambda c, n: F.when(case != n, F.col(c)).alias(c)
    body = F.to_json(F.struct(hit("doc_id", 3), "attempt", "region_idx", "text", "conf", "x1", hit("y1", 5), "x2", "y2", "engine", "cls_label", "cls_score"))
    lines = rows.select(F.when(case == 1, F.left(body, F.length(body) - 9)).otherwise(body).alias("value"))
    good, bad = readers.read_regions_json(spark, _stored(lines, "regions"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_idx", "text"))), lambda x: x["text"]), "\n")
    kept = good.groupBy("doc_id").agg(F.lit("good").alias("state"), F.count("*").alias("n"), F.sha2(text, 256).alias("text_sha256"))
    lost = bad.groupBy(F.col("reason").alias("state")).agg(F.count("*").alias("n"), F.lit("").alias("text_sha256"))
    return kept.unionByName(lost.withColumn("doc_id", F.lit(None).cast("long")))


@query
def uploads_scanned(spark, sf_dir):
    """Lines of cards stored as files in eight folders; the bytes that a scan lists for each."""
    path = f"{scratch.folder(spark)}/idweft-{uuid.uuid4().hex}/uploads"
    cards.card_regions(spark, sf_dir).select("text", (F.col("doc_id") % 8).alias("folder")).write.partitionBy("folder").text(path)
    folder = F.regexp_extract("path", r"/folder=(\d+)/", 1).cast("long")
    return readers.scan_uploads(spark, path).groupBy(folder.alias("folder"), "suffix").agg(F.sum("n_bytes").alias("n_bytes"))


@query
def truth_round_trip(spark, sf_dir):
    """Labels as one JSON map a document, some of them damaged, read again."""
    truth = cards.card_truth(spark, sf_dir)
    side = truth.groupBy("doc_id", "side").agg(F.map_concat(F.create_map(F.lit("side"), F.col("side")), F.map_from_entries(F.collect_list(F.struct("field", "want")))).alias("labels"))
    body = F.to_json(F.create_map(F.concat(F.lit("card_"), F.col("doc_id").cast("string")), F.collect_list("labels")))
    lines = side.groupBy("doc_id").agg(body.alias("json")).select(F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("{"), F.col("json"))).when(F.col("doc_id") % 17 == 0, F.replace("json", F.lit('"side":'), F.lit('"page":'))).otherwise(F.col("json")).alias("value"))
    good, bad = readers.read_truth_lines(spark, _stored(lines, "truth"))
    return good.unionByName(bad.groupBy(F.lit(None).cast("string").alias("doc_id")).agg(F.lit("damaged").alias("side"), F.lit("lines").alias("field"), F.count("*").cast("string").alias("want")))


@query
def contract_json(spark, sf_dir):
    return sinks.to_contract(extract.extract_pan(cards.card_regions(spark, sf_dir)), "pan")


@query
def contracts_all(spark, sf_dir):
    """The contract of every job over every document that it takes, the class of the card not asked."""
    rows, out = cards.card_regions(spark, sf_dir), None
    for name, job in extract.CONTRACT_JOBS.items():
        one = sinks.to_contract(job(rows), name).select("doc_id", F.lit(name).alias("document_type"), "json")
        out = one if out is None else out.unionByName(one)
    return out


@query
def failure_json(spark, sf_dir):
    out = verify.verify_documents(cards.attempt_regions(spark, sf_dir), cards.card_requests(spark, sf_dir))
    return sinks.failure_contract(out.withColumn("message", F.when(F.col("error_code") == "document_mismatch", F.concat(F.lit("Expected "), F.col("intended"), F.lit(", got "), F.col("actual"))).otherwise("ID extraction failed")))
