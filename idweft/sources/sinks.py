"""Sinks: one JSON contract for each document, for successes and for failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweft.functions import patterns as P
from idweft.functions.columns import blank
from idweft.operators.regions import error_status

KEEP_NULLS = {"ignoreNullFields": "false"}


def envelope(data: Column, *, success: bool, status: Column, message: Column, message_code: str) -> list[Column]:
    return [data.alias("data"), status.alias("status_code"), F.lit(message_code).alias("message_code"), message.alias("message"), F.lit(success).alias("success")]


def to_contract(fields: DataFrame, document_type: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, json`` of a wide extraction table.

    A column with a ``<name>_confidence`` beside it becomes ``{value, confidence}``; others
    stand as they are. A field that wasn't found is '' with confidence 0, never left out.
    """
    names = [c for c in fields.columns if c not in keys and not c.endswith("_confidence")]

    def one(name: str) -> Column:
        conf = f"{name}_confidence"
        return F.struct(blank(F.col(name)).alias("value"), F.col(conf).alias("confidence")).alias(name) if conf in fields.columns else F.col(name)

    document = F.struct(F.lit(document_type).alias("document_type"), *map(one, names))
    data = F.struct(F.array(document).alias("ocr_fields"))
    body = F.struct(*envelope(data, success=True, status=F.lit(200), message=F.lit(None).cast("string"), message_code="success"))
    return fields.select(*keys, F.to_json(body, KEEP_NULLS).alias("json"))


def failure_contract(outcomes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, json`` of failed documents (``keys, error_code, message``): empty data, and why."""
    rows = error_status(outcomes.filter("error_code is not null"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    body = F.struct(*envelope(empty, success=False, status=F.col("http_status"), message=blank(F.col("message")), message_code="failed"), F.col("error_code"))
    return rows.select(*keys, F.to_json(body, KEEP_NULLS).alias("json"))


def identity_contract(doc_type: Column, number: Column, error_code: Column) -> Column:
    """The contract of a whole text as one expression: its class and number, or why there is none."""
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for row in P.DOC_TYPE_ROWS for x in (row[1], row[i])]), doc_type)
    status = F.element_at(F.create_map(*[F.lit(x) for code, http, _ in P.ERROR_CODES for x in (code, http)]), error_code)
    document = F.struct(of(0).alias("document_type"), of(3).alias("id_field"), number.alias("id_number"))
    found = F.struct(*envelope(F.struct(F.array(document).alias("ocr_fields")), success=True, status=F.lit(200), message=F.lit(None).cast("string"), message_code="success"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    failed = F.struct(*envelope(empty, success=False, status=status, message=F.lit("ID extraction failed"), message_code="failed"), error_code.alias("error_code"))
    return F.when(error_code.isNull(), F.to_json(found, KEEP_NULLS)).otherwise(F.to_json(failed, KEEP_NULLS))


def write_contract(contracts: DataFrame, path: str) -> None:
    """One JSON text a line, in files of Spark's choice."""
    contracts.select(F.col("json").alias("value")).write.text(path)
