"""Where a number stands on a page, and the rectangles and texts that hide it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweft.functions import columns as C
from idweft.functions import patterns as P
from idweft.operators.classify import class_of, id_of
from idweft.operators.pages import let, pages, staged, stages_of
from idweft.operators.pairing import masked_number

PAD_RATIO, VISIBLE_RATIO, MERGE_GAP = 0.18, 0.34, 22
BOX = "struct<y1:int,x1:int,y2:int,x2:int>"


def is_id_hit(text: Column, doc_type: Column, id_clean: Column) -> Column:
    """Whether a line holds the number or part of it."""
    up, word = F.upper(C.blank(text)), C.strip_id(text)
    by_type = F.lit(False)
    for kind, rx in P.ID_BY_TYPE.items():
        by_type = F.when(doc_type == kind, up.rlike(rx)).otherwise(by_type)
    aadhaar = doc_type == "AADHAAR"
    known = id_clean != ""
    part = F.contains(word, id_clean) | ((F.length(word) >= 6) & F.contains(id_clean, word)) | (aadhaar & (F.length(word) >= 4) & word.rlike(r"^\d+$") & F.contains(id_clean, word))
    return (word != "") & (by_type | (aadhaar & up.rlike(P.VID)) | (known & part))


def id_hits(regions: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Regions that hold the number of their document, with ``n_chars`` and ``doc_type``.

    ``ids`` has ``keys, doc_type, extracted_id`` (null or '' where no number is known).
    """
    joined = regions.join(ids.select(*keys, "doc_type", "extracted_id"), list(keys))
    hit = is_id_hit(F.col("text"), F.col("doc_type"), C.strip_id(F.col("extracted_id")))
    return joined.filter(hit).withColumn("n_chars", F.length(C.strip_id(F.col("text")))).drop("extracted_id")


def merge_gap(hits: DataFrame, keys: tuple[str, ...] = ("doc_id",), gap: int = MERGE_GAP) -> DataFrame:
    """``keys, gap``: for an Aadhaar number 1.2 times the upper median height, if that is more."""
    tall = F.array_sort(F.collect_list(F.col("y2") - F.col("y1")))
    scaled = F.floor(F.element_at(tall, F.expr("int(count(*) div 2) + 1")) * 1.2).cast("int")
    return hits.groupBy(*keys).agg(F.when(F.first("doc_type") == "AADHAAR", F.greatest(F.lit(gap), scaled)).otherwise(F.lit(gap)).alias("gap"))


def _fold(boxes: Column, gap: Column) -> Column:
    """Boxes in (y, x) order merged one after another, the growing box with the next one."""
    start = F.struct(F.lit(None).cast(BOX).alias("cur"), F.array().cast(f"array<{BOX}>").alias("done"))

    def step(s: Column, b: Column) -> Column:
        c = s["cur"]
        shared = F.least(b["y2"], c["y2"]) - F.greatest(b["y1"], c["y1"])
        joins = (shared >= 0.4 * F.greatest(F.lit(1), c["y2"] - c["y1"])) & (b["x1"] <= c["x2"] + gap)
        both = F.struct(F.least(c["y1"], b["y1"]).alias("y1"), F.least(c["x1"], b["x1"]).alias("x1"), F.greatest(c["y2"], b["y2"]).alias("y2"), F.greatest(c["x2"], b["x2"]).alias("x2"))
        return (
            F.when(c.isNull(), F.struct(b.alias("cur"), s["done"].alias("done")))
            .when(joins, F.struct(both.alias("cur"), s["done"].alias("done")))
            .otherwise(F.struct(b.alias("cur"), F.concat(s["done"], F.array(c)).alias("done")))
        )

    return F.aggregate(boxes, start, step, lambda s: F.concat(s["done"], F.filter(F.array(s["cur"]), lambda x: x.isNotNull())))


def _merged(hits: DataFrame, keys: tuple[str, ...], gap: int) -> DataFrame:
    """``keys, doc_type, hits, boxes``: a document's hits in (y, x) order, and the boxes made of them.

    The order matters, so a document's hits (fewer than a page's lines) are folded in one array.
    """
    lo, hi = (lambda a: F.least(f"{a}1", f"{a}2").alias(f"{a}1")), (lambda a: F.greatest(f"{a}1", f"{a}2").alias(f"{a}2"))
    hit = F.struct(lo("y"), lo("x"), hi("y"), hi("x"), F.expr("(x1 + x2) div 2").alias("cx"), F.expr("(y1 + y2) div 2").alias("cy"), F.coalesce("conf", F.lit(0.0)).alias("conf"), "n_chars", (F.col("y2") - F.col("y1")).alias("tall"))
    rows = hits.groupBy(*keys).agg(F.first("doc_type").alias("doc_type"), F.array_sort(F.collect_list(hit)).alias("hits"))
    tall = F.array_sort(F.transform("hits", lambda h: h["tall"]))
    scaled = F.floor(F.get(tall, F.expr("size(hits) div 2").cast("int")) * 1.2).cast("int")
    rows = rows.withColumn("gap", F.when(F.col("doc_type") == "AADHAAR", F.greatest(F.lit(gap), scaled)).otherwise(F.lit(gap)))
    boxes = F.transform("hits", lambda h: F.struct(h["y1"].alias("y1"), h["x1"].alias("x1"), h["y2"].alias("y2"), h["x2"].alias("x2")))
    return rows.select(*keys, "doc_type", "hits", _fold(boxes, F.col("gap")).alias("boxes"))


def merge_boxes(hits: DataFrame, keys: tuple[str, ...] = ("doc_id",), gap: int = MERGE_GAP) -> DataFrame:
    """``keys, box_no, x1, y1, x2, y2, doc_type``: hits of one row joined across the gap."""
    rows = _merged(hits, keys, gap).select(*keys, "doc_type", F.posexplode("boxes").alias("box_no", "b"))
    return rows.select(*keys, "doc_type", "box_no", "b.x1", "b.y1", "b.x2", "b.y2")


def box_stats(hits: DataFrame, keys: tuple[str, ...] = ("doc_id",), gap: int = MERGE_GAP) -> DataFrame:
    """Merged boxes with ``conf`` (best) and ``n_chars`` (sum) of the hits whose centre is inside."""
    rows = _merged(hits, keys, gap).select(*keys, "doc_type", "hits", F.posexplode("boxes").alias("box_no", "b"))
    inside = F.filter("hits", lambda h: h["cx"].between(F.col("b.x1"), F.col("b.x2")) & h["cy"].between(F.col("b.y1"), F.col("b.y2")))
    rows = rows.select(*keys, "doc_type", "box_no", "b.x1", "b.y1", "b.x2", "b.y2", inside.alias("inside"))
    conf = F.coalesce(F.array_max(F.transform("inside", lambda h: h["conf"])), F.lit(0.0))
    return rows.withColumn("conf", conf).withColumn("n_chars", F.aggregate("inside", F.lit(0), lambda n, h: n + h["n_chars"])).drop("inside")


def mask_rects(regions: DataFrame, ids: DataFrame, page_sizes: DataFrame, keys: tuple[str, ...] = ("doc_id",), pad_ratio: float = PAD_RATIO, visible: float = VISIBLE_RATIO, gap: int = MERGE_GAP) -> DataFrame:
    """``keys, field, x1, y1, x2, y2, conf``: what to black out so that four characters stay.

    ``page_sizes`` has ``keys, width, height``.
    """
    hits = id_hits(regions, ids, keys)
    boxes = box_stats(hits, keys, gap).join(page_sizes.select(*keys, "width", "height"), list(keys))
    pad = F.greatest(F.lit(4), ((F.col("y2") - F.col("y1")) * pad_ratio).cast("int"))
    boxes = boxes.withColumn("bx1", F.greatest(F.lit(0), F.col("x1") - pad)).withColumn("by1", F.greatest(F.lit(0), F.col("y1") - pad))
    boxes = boxes.withColumn("rx2", F.least(F.col("width") - 1, F.col("x2") + pad)).withColumn("ry2", F.least(F.col("height") - 1, F.col("y2") + pad))
    glyph = (F.col("x2") - F.col("x1")) / F.greatest(F.col("n_chars"), F.lit(1))
    right = F.when(F.col("doc_type") == "AADHAAR", F.col("rx2") - ((F.col("rx2") - F.col("bx1")) * visible).cast("int")).otherwise(F.bround(F.col("x2") - 4 * glyph).cast("int"))
    return boxes.select(*keys, _field_of(F.col("doc_type")).alias("field"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"), F.least(F.col("rx2"), F.greatest(F.col("bx1") + 1, right)).alias("x2"), F.col("ry2").alias("y2"), "conf")


def mask_report(ids: DataFrame, rects: DataFrame, masked: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, document_detected, already_masked, masked_regions, n_regions, withheld, message``.

    ``ids`` has one row for each document, ``masked`` its issuer-masked digits (``keys, value``).
    A document whose number can't be placed is withheld: no rectangle is never a pass.
    """
    box = F.struct("field", F.array("x1", "y1", (F.col("x2") - F.col("x1")), (F.col("y2") - F.col("y1"))).alias("bbox"), F.bround("conf", 2).alias("confidence"))
    regions = rects.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("regions"))
    row = ids.select(*keys, "doc_type", "extracted_id").join(regions, list(keys), "left").join(masked.select(*keys, F.col("value").alias("last4")), list(keys), "left")
    return row.select(*keys, *[c.alias(n) for n, c in _report().items()])


_SPOTS = "array<struct<field:string,bbox:array<int>,confidence:double>>"


def _report() -> dict[str, Column]:
    """The report of a row with ``doc_type, extracted_id, last4, regions``."""
    has_id = C.blank(F.col("extracted_id")) != ""
    already = ~has_id & (F.col("doc_type") == "AADHAAR") & (C.blank(F.col("last4")) != "")
    spots = F.coalesce("regions", F.array().cast(_SPOTS))
    spots = F.when(already, F.transform(spots, lambda x: x.withField("field", F.lit("vid")))).when(has_id, spots).otherwise(F.slice(spots, 1, 0))
    withheld = ~already & (F.size(spots) == 0)
    message = F.when(already, "Aadhaar number is already masked on the document").when(withheld & has_id, "Identity number found but could not be localized for masking").when(withheld, F.concat(F.lit("No "), F.col("doc_type"), F.lit(" identity number located")))
    return {"document_detected": has_id | already, "already_masked": already, "masked_regions": spots, "n_regions": F.size(spots), "withheld": withheld, "message": message}


def mask_pages(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",), margin: int = 20, pad_ratio: float = PAD_RATIO, visible: float = VISIBLE_RATIO, gap: int = MERGE_GAP) -> DataFrame:
    """:func:`mask_report` straight from recognised lines, in one pass: one shuffle and no join.

    Class, number, hits, merged boxes, rectangles and issuer-masked digits are all read from the
    page's own array of lines; a page is as large as its lines and ``margin`` pixels more.
    """
    size = {"width": F.max("x2") + margin, "height": F.max("y2") + margin}
    page = staged(pages(regions, keys, **size), _mask_stages, pad_ratio, visible, gap)
    *_, report = stages_of(page, _mask_stages, pad_ratio, visible, gap)
    return page.select(*keys, *report)


def _mask_stages(pad_ratio: float, visible: float, gap: int) -> list[dict[str, Column]]:
    text, lines, kind = F.col("full_text"), F.col("lines"), F.col("doc_type")
    stages = [{"doc_type": class_of(text), "last4": masked_number(lines)["value"]}, {"extracted_id": id_of(text, kind)}, {"clean": C.strip_id(F.col("extracted_id"))}]

    def hit(x: Column) -> Column:
        low, high = F.least, F.greatest
        box = [low(x["y1"], x["y2"]).alias("y1"), low(x["x1"], x["x2"]).alias("x1"), high(x["y1"], x["y2"]).alias("y2"), high(x["x1"], x["x2"]).alias("x2")]
        centre = lambda a, b: F.floor((a + b) / 2).cast("int")
        return F.struct(*box, centre(x["x1"], x["x2"]).alias("cx"), centre(x["y1"], x["y2"]).alias("cy"), x["conf"].alias("conf"), F.length(C.strip_id(x["text"])).alias("n_chars"), (x["y2"] - x["y1"]).alias("tall"))

    stages.append({"hits": F.array_sort(F.transform(F.filter(lines, lambda x: is_id_hit(x["text"], kind, F.col("clean"))), hit))})
    tall = F.array_sort(F.transform("hits", lambda h: h["tall"]))
    scaled = F.floor(F.get(tall, F.expr("size(hits) div 2").cast("int")) * 1.2).cast("int")
    stages.append({"gap_": F.when(kind == "AADHAAR", F.greatest(F.lit(gap), scaled)).otherwise(F.lit(gap))})
    stages.append({"boxes": _fold(F.transform("hits", lambda h: F.struct(h["y1"].alias("y1"), h["x1"].alias("x1"), h["y2"].alias("y2"), h["x2"].alias("x2"))), F.col("gap_"))})

    def spot(b: Column) -> Column:
        inside = F.filter("hits", lambda h: h["cx"].between(b["x1"], b["x2"]) & h["cy"].between(b["y1"], b["y2"]))
        stats = F.struct(F.coalesce(F.array_max(F.transform(inside, lambda h: h["conf"])), F.lit(0.0)).alias("conf"), F.aggregate(inside, F.lit(0), lambda n, h: n + h["n_chars"]).alias("n_chars"), F.greatest(F.lit(4), ((b["y2"] - b["y1"]) * pad_ratio).cast("int")).alias("pad"))

        def frame(s: Column) -> Column:
            left, top = F.greatest(F.lit(0), b["x1"] - s["pad"]), F.greatest(F.lit(0), b["y1"] - s["pad"])
            edge, foot = F.least(F.col("width") - 1, b["x2"] + s["pad"]), F.least(F.col("height") - 1, b["y2"] + s["pad"])
            glyph = (b["x2"] - b["x1"]) / F.greatest(s["n_chars"], F.lit(1))
            right = F.when(kind == "AADHAAR", edge - ((edge - left) * visible).cast("int")).otherwise(F.bround(b["x2"] - 4 * glyph).cast("int"))
            wide = F.least(edge, F.greatest(left + 1, right)) - left
            return F.struct(_field_of(kind).alias("field"), F.array(left, top, wide, foot - top).alias("bbox"), F.bround(s["conf"], 2).alias("confidence"))

        return let(stats, frame)

    stages.append({"regions": F.array_sort(F.transform("boxes", spot))})
    return [*stages, _report()]


def _field_of(doc_type: Column) -> Column:
    fields = F.create_map(*[F.lit(x) for row in P.DOC_TYPE_ROWS for x in (row[1], row[3])])
    return F.coalesce(F.element_at(fields, doc_type), F.lit("id_number"))


#: Numbers in running text, the longest form first, so that no shorter rule reads a part of it.
TEXT_RULES = (
    (r"(?<!\d)\d{4}(\s?)\d{4}(\s?)\d{4}(\s?)(\d{4})(?!\d)", "XXXX$1XXXX$2XXXX$3$4"),
    (r"(?<!\d)(?<!\d[ \t])\d{4}(\s?)\d{4}(\s?)(\d{4})(?![ \t]?\d)", "XXXX$1XXXX$2$3"),
    (r"(?<![A-Z0-9])([A-Z]{2})[A-Z]{3}[0-9]{2}([0-9]{2}[A-Z])(?![A-Z0-9])", "$1XXXXX$2"),
    (r"(?<![A-Z0-9])[A-Z]{3}\d{3}(\d{4})(?![A-Z0-9])", "XXXXXX$1"),
    (r"(?<![A-Z0-9])[A-Z]{2}([\s-]?)\d{2}([\s-]?)\d{7}(\d{4})(?!\d)", "XX$1XX$2XXXXXXX$3"),
)


def redacted_text(text: Column) -> Column:
    """The text with every number masked but for its last characters."""
    for rx, mask in TEXT_RULES:
        text = F.regexp_replace(text, rx, mask)
    return text


def redact_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with numbers in ``text_col`` masked, and ``redacted`` where one was."""
    clean = redacted_text(F.col(text_col))
    return df.withColumn("redacted", ~clean.eqNullSafe(F.col(text_col))).withColumn(text_col, clean)
