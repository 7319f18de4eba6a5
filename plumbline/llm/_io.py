"""Shared helpers of the corpus operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into lists and arrays at a time.
CHUNK_BYTES = 2 << 20
#: Bytes of the Arrow batches in which an executor hands rows to Python while a table is stored; Spark's own limit is 64 MB, held several times over on either side.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's own reader (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the one that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where driver and executors
    are one process, as in tests, an unset one becomes a folder below /tmp; on a
    cluster that is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file:///tmp/checkpoints/plumbline"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends there."""
    path = shared_dir(df.sparkSession, what)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES meanwhile, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables made by stored(), once nothing that is still to run reads them."""
    for df in tables:
        if df is not None and (path := df.__dict__.pop("stored_at", None)):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices that hold about `most` bytes of the named column (a single longer text stands alone)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers live on, and later stages need the memory
