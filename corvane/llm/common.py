"""Helpers that several operators share: tables, the shared folder, written tables."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that a task turns into Python objects at a time.
ROWS_AT_ONCE = 512


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most ``rows`` rows, so that a task holds the objects of one part and not of ten thousand texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidied(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with a worker that gives free memory back to the system when its task ends.

    Workers live on, idle ones too; what Arrow and the C library keep of a task's batches counts against the executor
    and is of no use to the stages after it.
    """

    @functools.wraps(run)
    def whole(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
            if trim:
                trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which
    goes when Python ends; a cluster without it is an error, since executors
    would not see each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.TemporaryDirectory(prefix="corvane-")
    atexit.register(own.cleanup)
    spark.conf.set("spark.checkpoint.dir", f"file://{own.name}")
    return f"file://{own.name}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.startswith(shared_dir(spark)) or path.startswith(shared_dir(spark).replace("file://", "file:")):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salted_join(rows: DataFrame, single: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """``rows`` with the one row of ``single`` of the same ``key`` (inner), dealt by key and salt.

    Many rows of one key go to ``salts`` tasks instead of one; ``single`` is copied as often.
    """
    salt = "_salt"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copied = single.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, salt]).drop(salt)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
