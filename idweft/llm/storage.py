"""Tables written between the steps of an operator.

They go to the folder that the session names in ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set in local mode (tests), a local one is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/idweft-{uuid.uuid4().hex}/{name}"


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None, by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: the lineage is cut there.

    ``batch_rows`` bounds the rows that go to Python at once while it is written, for tables
    of texts, whose batches would else be as large as the texts are long. ``by`` are columns
    whose values get a folder each; ``codec`` compresses the files, by default the session's.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_BATCH_ROWS)
    if batch_rows:
        spark.conf.set(_BATCH_ROWS, min(batch_rows, int(before)))
    try:
        df.write.partitionBy(*by).parquet(path, compression=codec)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` returned, once all that reads them is itself written."""
    for table in tables:
        spark, path = table.sparkSession, table.written_to
        path = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
