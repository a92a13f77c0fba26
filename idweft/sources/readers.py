"""Sources: recognised lines, texts as lines, uploads, page requests, labelled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idweft import schema as S
from idweft.functions.columns import blank

MAX_PAGES = 4


def read_regions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recognised lines, with the schema as it is written down; ``fmt`` is parquet or json."""
    return spark.read.schema(S.REGIONS).format(fmt).load(path)


def read_regions_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recognised lines from JSON texts, one a line: the good ones, and a table of the damaged.

    The second has ``file, value, reason``: ``not json`` where a line can't be read as one
    region, ``no key`` without document or place, ``no box`` without all four numbers. Blank
    lines are neither. One damaged line costs nothing but itself.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    got = lines.withColumn("r", F.from_json("value", f"{S.REGIONS}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    boxed = F.col("r.x1").isNotNull() & F.col("r.y1").isNotNull() & F.col("r.x2").isNotNull() & F.col("r.y2").isNotNull()
    reason = F.when(F.col("r").isNull() | F.col("r.broken").isNotNull(), "not json").when(F.col("r.doc_id").isNull() | F.col("r.region_idx").isNull(), "no key").when(~boxed, "no box")
    judged = got.withColumn("reason", reason)
    return judged.filter("reason is null").select("r.*").drop("broken"), judged.filter("reason is not null").select("file", "value", "reason")


def regions_from_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One region for each line of a text; boxes by line number and length. A null text has none."""
    doc = F.col(id_col).cast("long")
    lines = df.select(doc.alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("region_idx", "text"))
    conf = (50 + (F.col("doc_id") * 7 + F.col("region_idx") * 13) % 51) / F.lit(100.0)
    y = F.col("region_idx") * 20
    return lines.select("doc_id", F.lit("crop").alias("attempt"), "region_idx", "text", conf.alias("conf"), F.lit(0).alias("x1"), y.alias("y1"), (F.length("text") * 8).alias("x2"), (y + 16).alias("y2"), F.lit("rapidocr").alias("engine"))


def scan_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, file_name, suffix, n_bytes, modified`` of files; their content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.select("path", name.alias("file_name"), F.when(suffix == "", ".jpg").otherwise(F.lower(suffix)).alias("suffix"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def expand_page_requests(requests: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``'4, 5 ,4'`` as one row for each page: ``..., request_no, page, error_code``.

    Blanks are dropped, pages are 1-based and kept once, in their order. A list with a bad
    part, no page, or more than ``max_pages`` pages is one row with an error and no page.
    """
    parts = F.filter(F.transform(F.split(blank(F.col("pages")), ","), lambda p: F.trim(p)), lambda p: p != "")
    bad = F.exists("parts_", lambda p: ~p.rlike(r"^0*[1-9]\d{0,8}$"))
    numbers = F.array_distinct(F.transform(F.filter("parts_", lambda p: p.rlike(r"^0*[1-9]\d{0,8}$")), lambda p: p.cast("int")))
    rows = requests.withColumn("parts_", parts).withColumn("bad_", bad | (F.size("parts_") == 0)).withColumn("numbers_", numbers)
    rows = rows.withColumn("bad_", F.col("bad_") | (F.size("numbers_") > max_pages))
    pages = F.when(F.col("bad_"), F.array(F.lit(None).cast("int"))).otherwise(F.col("numbers_"))
    out = rows.select("*", F.posexplode(pages).alias("request_no", "page")).withColumn("error_code", F.when(F.col("bad_"), "invalid_upload"))
    return out.drop("parts_", "bad_", "numbers_")


def clean_page_lines(lines: DataFrame) -> DataFrame:
    """Lines with text, the confidence to four places, boxes in whole pixels; weak lines stay."""
    rows = lines.filter(F.trim(blank(F.col("text"))) != "").withColumn("confidence", F.bround(F.coalesce("confidence", F.lit(0.0)), 4))
    return rows.withColumn("bbox", F.transform("bbox", lambda v: v.cast("int")))


_TRUTH = "map<string,array<map<string,string>>>"


def _truth_rows(maps: DataFrame) -> DataFrame:
    docs = maps.select(F.explode("labels").alias("doc_id", "sides"))
    sides = docs.select("doc_id", F.explode("sides").alias("s")).select("doc_id", F.col("s")["side"].alias("side"), F.explode("s").alias("field", "want"))
    return sides.filter("field <> 'side'")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A label map ``{file: [{side, field: value, ...}]}`` as ``doc_id, side, field, want``."""
    return _truth_rows(spark.read.text(path, wholetext=True).select(F.from_json("value", _TRUTH).alias("labels")))


def read_truth_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label maps, one a line, as :func:`read_truth` gives them, and the damaged lines (``file, value``).

    A map that can't be read, or has a document without sides or a label without side, is
    damaged as a whole.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    got = lines.withColumn("labels", F.from_json("value", _TRUTH))
    whole = lambda sides: sides.isNotNull() & F.forall(sides, lambda s: F.element_at(s, "side").isNotNull())
    good = F.coalesce(F.forall(F.map_values("labels"), whole) & (F.size("labels") > 0), F.lit(False))
    judged = got.withColumn("good", good)
    return _truth_rows(judged.filter("good")), judged.filter("not good").select("file", "value")
