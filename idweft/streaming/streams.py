"""Jobs over streams. The library's windows, watermarks and late data are its own, on its own tables.

Each job takes a table as well and then gives what a stream of its rows ends with.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from idweft.functions import patterns as P
from idweft.functions.columns import blank, mask_id
from idweft.operators import classify as K
from idweft.operators.masking import redact_text
from idweft.sources.sinks import identity_contract


def redact_stream(sdf: DataFrame, text_col: str = "text") -> DataFrame:
    """Numbers in a stream of whole texts masked row by row; stateless, append mode."""
    return redact_text(sdf, text_col)


def extract_stream(sdf: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, doc_type, extracted_id, masked_id, error_code, json`` of whole texts, row by row.

    The class of the text, its number and what may be shown of it, and the contract with one
    or the failure without; a text of no class or without its number is ``id_not_found``.
    Stateless, append mode. A null text counts as empty.
    """
    text = F.upper(blank(F.col(text_col)))
    rows = sdf.select(F.col(id_col).alias("key_"), text.alias("text_")).withColumn("doc_type", K.class_of(F.col("text_")))
    rows = rows.withColumn("extracted_id", K.id_of(F.col("text_"), F.col("doc_type")))
    rows = rows.withColumn("error_code", F.when(blank(F.col("extracted_id")) == "", "id_not_found"))
    return rows.select(F.col("key_").alias(id_col), "doc_type", "extracted_id", mask_id(F.col("extracted_id"), F.col("doc_type")).alias("masked_id"), "error_code", identity_contract(F.col("doc_type"), F.col("extracted_id"), F.col("error_code")).alias("json"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts a query that writes every batch to its own folder ``path/batch_id=N``.

    A batch that is run again after a failure has the same rows and takes the place of its
    first attempt, so a restart from the checkpoint gives no row twice and loses none.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_batches` wrote, with ``batch_id``."""
    return spark.read.option("basePath", path).parquet(path)


# ---- outcomes by windows of event time


def _windows(outcomes: DataFrame, size: str, watermark: str, slide: str | None):
    rows = outcomes.withWatermark("ts", watermark) if outcomes.isStreaming else outcomes
    return rows, (F.window("ts", size, slide) if slide else F.window("ts", size)).alias("w")


def outcome_windows(outcomes: DataFrame, size: str = "1 hour", watermark: str = "2 hours", slide: str | None = None) -> DataFrame:
    """``window_start, n, n_failed, n_timeouts, failure_rate`` for each window of event time.

    On a stream a window is final once the watermark passes its end; rows later than that
    are dropped. The same call on a table gives all windows. With ``slide`` windows overlap.
    """
    rows, window = _windows(outcomes, size, watermark, slide)
    failed = F.count_if(blank(F.col("error_code")) != "")
    got = rows.groupBy(window).agg(F.count("*").alias("n"), failed.alias("n_failed"), F.count_if(F.col("error_code") == "timeout").alias("n_timeouts"))
    return got.select(F.col("w.start").alias("window_start"), "n", "n_failed", "n_timeouts", (F.col("n_failed") / F.col("n")).alias("failure_rate"))


def outcome_codes(outcomes: DataFrame, size: str = "1 hour", watermark: str = "2 hours", slide: str | None = None) -> DataFrame:
    """``window_start, error_code, http_status, retryable, n, mean_sec``: every code counted apart.

    A success is the code '' with status 200; a code that isn't listed keeps its name, without
    status. State is one row for each window and code, partly summed before it is dealt.
    """
    rows, window = _windows(outcomes, size, watermark, slide)
    got = rows.groupBy(window, blank(F.col("error_code")).alias("error_code")).agg(F.count("*").alias("n"), F.avg("elapsed_sec").alias("mean_sec"))
    known = lambda i, kind: F.element_at(F.create_map(*[F.lit(x) for row in (("", 200, False), *P.ERROR_CODES) for x in (row[0], row[i])]), F.col("error_code")).cast(kind)
    return got.select(F.col("w.start").alias("window_start"), "error_code", known(1, "int").alias("http_status"), known(2, "boolean").alias("retryable"), "n", "mean_sec")


def outcome_alerts(windows: DataFrame, most_failed: float = 0.2, least_rows: int = 10) -> DataFrame:
    """Windows of :func:`outcome_windows` with enough rows whose failure rate is above a limit."""
    return windows.filter((F.col("n") >= least_rows) & (F.col("failure_rate") > most_failed))


# ---- one row for each identity within a horizon


def dedup_stream(sdf: DataFrame, horizon: str = "1 day", key: str = "uniqueness_id") -> DataFrame:
    """The first row of each identity within a horizon of event time (column ``ts``), in order of arrival.

    What it keeps depends on the batches that rows come in; :func:`dedup_within` does not.
    """
    return sdf.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key])


def _kept(times: list, state: int | None, horizon: int) -> tuple[list[bool], int | None]:
    """Which of ascending times begin anew: later than the last kept one by more than the horizon."""
    out = []
    for t in times:
        out.append(state is None or t > state + horizon)
        if out[-1]:
            state = t
    return out, state


def dedup_within(df: DataFrame, horizon_sec: int, key: str = "uniqueness_id", order: str = "doc_id", watermark: str = "2 days", parts: int | None = None) -> DataFrame:
    """The rows of each identity that are no repeats: none kept within ``horizon_sec`` before them.

    Rows are taken in order of event time (``ts``, ties by ``order``): the first is kept, then
    the next that is later than the last kept one by more than the horizon, and so on. Rows
    whose ``ts`` or ``key`` is null are left out. A table is dealt by identity and sorted, and
    read through with one time of state: an identity with very many rows is one task's, but is
    not gathered. A stream holds an identity's rows until the watermark passes them, so it
    keeps the same rows whatever order and batches they come in, but for those that come
    later than the watermark and are dropped.
    """
    rows, horizon = df.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()), horizon_sec * 1_000_000
    return _dedup_stream(rows, horizon, key, order, watermark) if df.isStreaming else _dedup_table(rows, horizon, key, order, parts)


def _dedup_table(rows: DataFrame, horizon: int, key: str, order: str, parts: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            keys, times = batch.column(key).to_pylist(), batch.column("ts").cast(pa.int64()).to_pylist()
            mask, begin = [], 0
            while begin < len(keys):
                end = begin + 1
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                if keys[begin] != current:
                    current, last = keys[begin], None
                kept, last = _kept(times[begin:end], last, horizon)
                mask += kept
                begin = end
            yield batch.filter(pa.array(mask, pa.bool_()))

    dealt = rows.repartition(parts, key) if parts else rows.repartition(key)
    return dealt.sortWithinPartitions(key, "ts", order).mapInArrow(run, rows.schema)


def _micros(rows: DataFrame) -> Column:
    """Event time as the watermark counts it, whatever the session's time zone."""
    if dict(rows.dtypes)["ts"] == "timestamp_ntz":
        return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return F.unix_micros("ts")


def _dedup_stream(rows: DataFrame, horizon: int, key: str, order: str, watermark: str) -> DataFrame:
    names = rows.columns

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, None)
        waiting = ([pickle.loads(held)] if held else []) + [f for f in frames if len(f)]
        waiting = pd.concat(waiting, ignore_index=True) if waiting else pd.DataFrame(columns=[*names, "micros_"])
        passed = state.getCurrentWatermarkMs()
        ready = waiting["micros_"].astype("int64") <= passed * 1_000
        due, rest = waiting[ready].sort_values(["micros_", order]), waiting[~ready]
        kept, last = _kept(due["micros_"].tolist(), last, horizon)
        state.update((last, pickle.dumps(rest) if len(rest) else None))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["micros_"].min() // 1_000) + 1, passed + 1))
        yield due[pd.Series(kept, index=due.index, dtype=bool)][names]

    grouped = rows.withColumn("micros_", _micros(rows)).withWatermark("ts", watermark).groupBy(key)
    return grouped.applyInPandasWithState(run, rows.schema, "last long, held binary", "append", GroupStateTimeout.EventTimeTimeout)
