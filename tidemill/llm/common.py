"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a local folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage ends here and a lost
    executor costs no work that is done."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes after which a batch of rows goes to a Python worker, where the session says nothing else.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get by bytes, not by rows alone: texts may be long. What the session has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim; nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def released(work: Callable[[Iterator], Iterator], *caches: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """work on the batches of a task; then caches are emptied, and the worker, which goes on to other work, gives back the memory that it has freed."""

    @wraps(work)
    def whole(batches):
        try:
            yield from work(batches)
        finally:
            for clear in caches:
                clear()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return whole


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(divisor)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A few rows as a native table of literals."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)])
    made = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


#: Up to so many ids (8 bytes each) are broadcast to select rows; more go through a shuffle join.
BROADCAST_IDS = 1_000_000


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores before it as long as a column is called so or begins so."""
    while any(c.lower().startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def only_ids(rows: DataFrame, ids: DataFrame, id_col: str, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """rows whose id_col is in ids.id (left_semi) or isn't (left_anti); ids is broadcast if a count shows it small."""
    name = free_name("__id", rows.columns)
    ids = ids.select(F.col("id").alias(name))
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, F.col(id_col) == F.col(name), how)


#: Up to so many rows of a small table with one row for each key are broadcast.
BROADCAST_ROWS = 200_000


def joined_by(rows: DataFrame, values: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of the row of values (one for each key) whose key is equal, nulls alike; rows must have such a row.

    values is broadcast if a count shows it small. Else no key of rows is spread over more than its share: the join is one
    that adaptive execution splits where a key is hot.
    """
    name = free_name("__key", [*rows.columns, *values.columns])
    values = values.withColumnRenamed(key, name)
    few = values.limit(most + 1).count() <= most
    return rows.join(F.broadcast(values) if few else values, rows[key].eqNullSafe(values[name])).drop(name)
