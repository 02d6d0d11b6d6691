"""Helpers that the operators share: cut lineage, scan texts in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in unit tests.
LOCAL_CHECKPOINTS = "/tmp/specaudit-checkpoints"
#: ASCII white space of the contracts, ``[\x20\x09-\x0D]``.
SPACES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a session of one machine may lack it."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


_written: list[DataFrame] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    _written.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no pending plan reads any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """How many tables have been written so far; see :func:`sweep`."""
    return len(_written)


def sweep(since: int, *keep: DataFrame) -> None:
    """Delete the tables written since a mark, but for ``keep``; for callers that have stored what they need of them."""
    discard(*(df for df in _written[since:] if all(df is not k for k in keep)))
    _written[since:] = [df for df in _written[since:] if any(df is k for k in keep)]


#: Rows of an Arrow batch.  Texts are long: Spark's 10,000 rows would be tens of MB a batch, several times over in the JVM and in Python.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch, which bound it where texts are very long: a worker holds a batch as Arrow and as Python objects, and what it makes of them.
BATCH_BYTES = 16 << 20
_BYTES, _SPARKS_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for this session: rows unless they are fewer already, bytes unless the session has a bound of its own."""
    now = int(spark.conf.get(_ROWS, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if spark.conf.get(_BYTES) == _SPARKS_BYTES:
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) under fixed names; other columns, clashing names included, stay behind."""
    small_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def total_cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
