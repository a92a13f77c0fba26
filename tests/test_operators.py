"""Operators on small hand-made documents, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from idweft import schema as S
from idweft.functions import columns as C
from idweft.functions import patterns as P
from idweft.operators import blocks, classify, masking, pages, pairing, regions
from idweft.plans import extract, verify
from idweft.sources import readers, scratch, sinks
from idweft.streaming import streams


def lines(spark, *rows, doc=1):
    """Rows are (text, x1, y1[, width[, conf]]) in input order."""
    out = []
    for i, (text, x, y, *more) in enumerate(rows):
        w = more[0] if more else 10 * len(text or "")
        out.append((doc, "crop", i, text, more[1] if len(more) > 1 else 0.9, x, y, x + w, y + 20, "rapidocr", "0", 0.95, None, None))
    return spark.createDataFrame(out, S.REGIONS)


def one(df):
    return df.collect()[0]


def test_masked_number_in_two_regions(spark):
    assert one(pairing.find_masked_id(lines(spark, ("XXXX XXXX", 10, 10, 90), ("4270", 110, 12))))["value"] == "4270"
    assert one(pairing.find_masked_id(lines(spark, ("XXXX XXXX", 10, 10, 90), ("4270", 400, 12))))["value"] == ""
    assert one(pairing.find_masked_id(lines(spark, ("no: XXXX XXXX 4270", 10, 10))))["value"] == "4270"


def test_pairing_prefers_glued_then_nearest(spark):
    glued = lines(spark, ("BG: O+", 10, 10), ("A-", 200, 10))
    assert one(pairing.pair_label_value(glued, r"(?i)\bBG\b"))["value"] == "O+"
    split = lines(spark, ("BG", 10, 10), ("low", 200, 45), ("A-", 200, 14), ("left", 0, 10, 5))
    assert one(pairing.pair_label_value(split, r"(?i)\bBG\b"))["value"] == "A-"
    empty = one(pairing.pair_label_value(lines(spark, ("BG", 10, 10, 20, 0.7)), r"(?i)\bBG\b"))
    assert (empty["value"], empty["conf"]) == ("", 0.7)


def test_vid_is_no_aadhaar_number(spark):
    docs = spark.createDataFrame([(1, "VID : 9146 3489 2265 9361\nAADHAAR"), (2, "2345 6789 0123"), (3, "DLFAP025184122010 DRIVING LICENCE"), (4, "nothing")], "doc_id long, full_text string")
    got = {r["doc_id"]: (r["doc_type"], r["extracted_id"]) for r in verify.masked_ids(docs).collect()}
    assert got == {1: ("AADHAAR", None), 2: ("AADHAAR", "2345 6789 0123"), 3: ("DRIVING_LICENSE", "DLFAP025184122010"), 4: ("UNKNOWN", None)}
    assert {r["doc_id"]: r["doc_type"] for r in classify.classify(docs).collect()} == {k: v[0] for k, v in got.items()}


def test_boxes_merge_and_keep_four_visible(spark):
    rows = lines(spark, ("2345", 40, 100, 40), ("6789", 95, 101, 40), ("0123", 150, 99, 40), ("0123", 40, 300, 40))
    ids = spark.createDataFrame([(1, "AADHAAR", "2345 6789 0123")], "doc_id long, doc_type string, extracted_id string")
    boxes = masking.merge_boxes(masking.id_hits(rows, ids)).orderBy("box_no").collect()
    assert [(b["x1"], b["x2"]) for b in boxes] == [(40, 190), (40, 80)]
    sizes = spark.createDataFrame([(1, 600, 400)], "doc_id long, width int, height int")
    for r in masking.mask_rects(rows, ids, sizes).collect():
        assert 0 <= r["x1"] < r["x2"] < 600 and 0 <= r["y1"] < r["y2"] < 400 and r["x2"] < 190


def test_mask_report_fails_closed(spark):
    ids = spark.createDataFrame([(1, "PAN", "ABCDE1234F"), (2, "PAN", None), (3, "AADHAAR", None)], "doc_id long, doc_type string, extracted_id string")
    none = spark.createDataFrame([], "doc_id long, field string, x1 int, y1 int, x2 int, y2 int, conf double")
    masked = spark.createDataFrame([(3, "4270")], "doc_id long, value string")
    got = {r["doc_id"]: (r["withheld"], r["already_masked"], r["document_detected"]) for r in masking.mask_report(ids, none, masked).collect()}
    assert got == {1: (True, False, True), 2: (True, False, False), 3: (False, True, True)}


def test_pages_are_masked_in_one_pass_as_by_tables(spark):
    rng, df = random.Random(8), None
    texts = ["UIDAI AADHAAR", "2345", "6789", "0123", "2345 6789 0123", "XXXX XXXX 4270", "INCOME TAX PAN", "ABCDE1234F", "VID : 9146 3489 2265 9361", "A1234567 PASSPORT", "", None, "HR41 20220002435 DRIVING LICENCE"]
    for doc in range(40):
        part = lines(spark, *[(rng.choice(texts), rng.randrange(0, 300), rng.randrange(0, 120), rng.randrange(20, 90), rng.random()) for _ in range(rng.randint(1, 9))], doc=doc)
        df = part if df is None else df.unionByName(part)
    df = df.coalesce(2).cache()
    sizes = df.groupBy("doc_id").agg((F.max("x2") + 20).alias("width"), (F.max("y2") + 20).alias("height"))
    ids = verify.masked_ids(pages.full_text(df, ("doc_id",)).join(df.select("doc_id").distinct(), "doc_id", "right"))
    joined = masking.mask_report(ids, masking.mask_rects(df, ids, sizes), pairing.find_masked_id(df))
    assert sorted(map(str, masking.mask_pages(df).collect())) == sorted(map(str, joined.collect()))


def test_table_of_labels_equals_single_pairs(spark):
    rng = random.Random(3)
    texts = ["BG: O+", "BG", "A-", "Address", "Add: 12 Rose Lane", "House 12 Sector 7", "Issue Date", "DOI 01-02-2010", "09-Aug-2022", "ID:", "", "Nil"]
    labels = {P.DL_BLOOD: C.is_blood_group, P.DL_ADDRESS: C.is_licence_address, r"(?i)ISSUE\s*DATE": None, r"(?i)\bDOI\b": None}
    df = None
    for doc in range(30):
        part = lines(spark, *[(rng.choice(texts), rng.randrange(0, 300), rng.randrange(0, 150)) for _ in range(rng.randint(1, 8))], doc=doc)
        df = part if df is None else df.unionByName(part)
    page = pages.pages(df.coalesce(2))
    one = lambda x: F.struct(x["value"].alias("value"), x["conf"].alias("conf"))
    both = page.select(F.transform(pairing.labelled(F.col("lines"), labels), one).alias("a"), F.array(*[one(pairing.paired(F.col("lines"), rx, test)) for rx, test in labels.items()]).alias("b"))
    assert both.filter("a <> b").count() == 0 and both.count() == 30


def test_derived_tables_follow_their_source(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    read = lambda: scratch.once(spark, lambda: spark.read.parquet(path), path, "x").count()
    spark.range(5).write.parquet(path)
    assert read() == 5 and read() == 5
    spark.range(9).write.mode("overwrite").parquet(path)
    assert read() == 9


def test_merging_is_idempotent_and_ignores_row_order(spark):
    rng = random.Random(4)
    rows = [("234567890123", rng.randrange(0, 300), rng.randrange(0, 200), rng.randrange(20, 90)) for _ in range(40)]
    ids = spark.createDataFrame([(1, "PASSPORT", "234567890123")], "doc_id long, doc_type string, extracted_id string")
    hits = masking.id_hits(lines(spark, *rows), ids)
    first = sorted(tuple(r) for r in masking.merge_boxes(hits).drop("box_no").collect())
    again = sorted(tuple(r) for r in masking.merge_boxes(hits.orderBy(F.rand(3))).drop("box_no").collect())
    assert first == again
    order = lines(spark, *rows).orderBy(F.rand(5))
    assert one(pages.full_text(order))["full_text"] == one(pages.full_text(lines(spark, *rows)))["full_text"]


def test_state_names_are_repaired(spark):
    rows = [("A, West Sengal - 713205",), ("UtarPradesh",), ("Bihari Lal, Gali 4, Kharar, Gjarat - 3",), ("Goaa, x",), (None,), ("",)]
    got = [r[0] for r in blocks.repair_states(spark.createDataFrame(rows, "address string")).collect()]
    assert got == ["A, West Bengal - 713205", "Uttar Pradesh", "Bihari Lal, Gali 4, Kharar, Gujarat - 3", "Goaa, x", None, ""]


def test_care_of_and_places(spark):
    full = "S/O: R. K. Mehta, House No 12/4, VTC:, Nana Chiloda, SUB DIST: Dehgam, DIST:, Ahmedabad, Gujarat - 382330, INDIA"
    df = spark.createDataFrame([(full, [full])], "address string, parts array<string>")
    r = one(blocks.split_address(df))
    assert (r["care_of"], r["relation"], r["house_number"], r["city"], r["district"], r["state"], r["zip"], r["country"]) == ("R. K. Mehta", "father", "12/4", "Nana Chiloda", "Ahmedabad", "Gujarat", "382330", "INDIA")


def test_second_reads(spark):
    kept = lines(spark, ("a", 0, 0, 100), ("b", 0, 50, 100))
    dropped = lines(spark, ("c", 10, 5, 50), ("d", 0, 200, 50))
    left = regions.uncovered_boxes(dropped, kept)
    assert [r["text"] for r in left.collect()] == ["d"]
    assert sorted((r["region_idx"], r["text"]) for r in regions.add_recovered(kept, left).collect()) == [(0, "a"), (1, "b"), (2, "d")]
    assert [r["text"] for r in regions.accept_recovered(lines(spark, (" x ", 0, 0, 9, 0.6), ("--", 0, 0, 9, 0.9), ("y", 0, 0, 9, 0.4))).collect()] == ["x"]


def test_attempt_choice(spark):
    rows = [(1, "crop", True, "", ""), (1, "full", False, "X", ""), (2, "crop", True, "A", ""), (2, "full", False, "B", ""), (3, "crop", False, "", ""), (3, "full", False, "B", ""), (4, "crop", True, "", ""), (4, "full", False, "", "12"), (5, "crop", True, "", "12"), (5, "full", False, "", "12")]
    got = regions.choose_attempt(spark.createDataFrame(rows, "doc_id long, attempt string, did_crop boolean, extracted string, masked4 string"))
    assert {r["doc_id"]: r["attempt"] for r in got.collect()} == {1: "full", 2: "crop", 3: "crop", 4: "full", 5: "crop"}


def test_dob_steps(spark):
    texts = {1: ["DOB: 01/02/1990", "Issue Date: 05/06/2015"], 2: ["D0B：2102/2002"], 3: ["Year of Birth: 1985"], 4: ["03/04/1970", "05/06/2015"], 5: ["9000:30/07/1995", "MALE"], 6: ["05/06/2015"], 7: ["Issued 05/06/2015", "DOB 01/01/2090"]}
    df = None
    for doc, rows in texts.items():
        part = lines(spark, *[(t, 40, 40 + 30 * i) for i, t in enumerate(rows)], doc=doc)
        df = part if df is None else df.unionByName(part)
    got = {r["doc_id"]: (r["dob"], r["step"]) for r in extract.extract_dob(df).collect()}
    assert got == {1: ("1990-02-01", 1), 2: ("2002-02-21", 2), 3: ("1985", 3), 4: ("1970-04-03", 4), 5: ("1995-07-30", 5), 6: ("", 0), 7: ("", 0)}


def test_accuracy(spark):
    rows = [("dob", "1990-01-01", "1990-01-01"), ("dob", "x", ""), ("address", "12 Rose Lane", "12 rose lane."), ("address", "12 Rose Lane", "other")]
    got = {r["field"]: (r["ok"], r["n"]) for r in verify.accuracy_report(spark.createDataFrame(rows, "field string, want string, got string")).collect()}
    assert got == {"dob": (1, 2), "address": (1, 2), "ALL": (2, 4)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"123")
    got = {r["file_name"]: (r["suffix"], r["n_bytes"]) for r in readers.scan_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": (".pdf", 3)}
    (tmp_path / "t.json").write_text('{"f1": [{"side": "front", "dob": "1990"}, {"side": "back", "zip": "", "care_of": "x"}]}')
    truth = {tuple(r) for r in readers.read_truth(spark, str(tmp_path / "t.json")).collect()}
    assert truth == {("f1", "front", "dob", "1990"), ("f1", "back", "zip", ""), ("f1", "back", "care_of", "x")}
    lines(spark, ("a", 0, 0)).write.parquet(f"{tmp_path}/r")
    assert readers.read_regions(spark, f"{tmp_path}/r").count() == 1
    sinks.write_contract(spark.createDataFrame([(1, "{}")], "doc_id long, json string"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()[0] == "{}"


@pytest.mark.parametrize("raw,pages_", [(" 4, 5 ,4", [4, 5]), ("", None), ("0", None), ("-1", None), ("a", None), ("4,x", None), ("1,2,3,4,5", None), ("3", [3])])
def test_page_lists(spark, raw, pages_):
    df = spark.createDataFrame([(1, "a.pdf", raw, 9)], S.PAGE_REQUESTS)
    got = readers.expand_page_requests(df).orderBy("request_no").collect()
    assert [r["page"] for r in got] == (pages_ or [None]) and (got[0]["error_code"] is None) == bool(pages_)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.sql("SELECT id AS doc_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(id * 7 AS INT),0) AS ts, IF(id % 3 = 0, 'timeout', NULL) AS error_code, concat('id ABCDE1234F ', id % 5) AS text, concat('u', id % 5) AS uniqueness_id FROM range(60)")
    for i in range(4):
        events.filter(f"doc_id div 15 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    redacted = run(streams.redact_stream(stream()), "redacted")
    assert sorted(r["text"] for r in redacted.collect()) == sorted(r["text"] for r in masking.redact_text(events).collect())
    windows = run(streams.outcome_windows(stream(), "1 hour", "1 hour"), "windows").collect()
    batch = {r["window_start"]: tuple(r) for r in streams.outcome_windows(events, "1 hour").collect()}
    assert windows and all(batch[r["window_start"]] == tuple(r) for r in windows)
    assert run(streams.dedup_stream(stream(), "10 days"), "unique").count() == 5
