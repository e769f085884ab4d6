"""Helpers the operators share: staged tables, bounded broadcasts, row filters, the held-out rule."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after a count has shown that its rows, at so much for a column, take at most so many bytes.
BROADCAST_BYTES, COLUMN_BYTES, TEXT_BYTES = 64_000_000, 16, 200


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; ``/tmp/checkpoints`` where unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage ends there and a lost executor loses nothing.

    The application's folder goes when its driver ends; :func:`discard` removes a table that is no longer read.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/columnloom/{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(spark, own)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove staged tables that nothing reads any more (frames that aren't staged are left alone)."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path:
            files, at = _file_system(table.sparkSession, path)
            files.delete(at, True)


def _scans_parquet(df: DataFrame) -> bool:
    """Whether ``df`` only selects and filters the rows of one Parquet scan."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "parquet" in node.toString().split("\n")[0].rsplit("]", 1)[-1].lower()


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a unique long column ``key`` that stays a row's own in every scan, however the files are split.

    Over a Parquet scan the key is the number of the file, by path, and the row's place in it. Any other ``df`` is staged
    once with its keys.
    """
    if not _scans_parquet(df):
        return staged(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
    spark, path, row = df.sparkSession, fresh(df, "path"), fresh(df, "row")
    found = sorted(r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect())
    placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    if len(found) > 1:
        numbers = spark.createDataFrame([(p, i << 40) for i, p in enumerate(found)], f"`{path}` string, `{key}` long")
        return placed.join(small_side(numbers, len(found)), path).withColumn(key, F.col(key) + F.col(row)).drop(path, row)
    return placed.withColumn(key, F.col(row)).drop(path, row)


def small_side(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are few enough, else as it is (a shuffle join follows).

    For keys, numbers and short names only: other columns have no bound that a count could show.
    """
    width = COLUMN_BYTES + sum(TEXT_BYTES if kind in ("string", "binary") else COLUMN_BYTES for _, kind in df.dtypes)
    return F.broadcast(df) if n_rows * width <= BROADCAST_BYTES else df


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside moves to Python in batches of at most ``rows`` rows, so that texts take little memory there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and the next task may be the JVM's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of each batch with about ``max_bytes`` of text (one row at least), so work memory has a bound."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
    release()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_rows(df: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``drop``; ``drop`` must be a staged table of distinct keys.

    The key list is broadcast only when counted small, so the (wide) rows of ``df`` move only when it is large.
    """
    return df.join(small_side(drop.select(key), drop.count()), key, "left_anti")
