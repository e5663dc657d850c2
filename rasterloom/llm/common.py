"""What the training-data operators share: shared folders, parallelism and names."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space and the five controls from tab to carriage return.
WHITESPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch of texts, set only where the session leaves Spark's own bound of 64 MB.
BATCH_BYTES = 2 << 20

#: Used only where spark.checkpoint.dir is unset, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of its own only where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", root := LOCAL_SHARED)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table that materialise wrote and df reads; nothing may read it afterwards."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Texts reach Python in batches of about BATCH_BYTES, whatever their lengths: a batch is held several times over on its way."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """What a worker has freed goes back to the system, as Arrow and the C library else keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus: the fixed folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


_memos: dict[str, Callable[[], None]] = {}


def only_memo(owner: str, clear: Callable[[], None] | None = None) -> None:
    """A Python worker outlives its stage: when an operator's task begins, what others remember there is dropped."""
    if others := [k for k in _memos if k != owner]:
        for other in others:
            _memos.pop(other)()
        give_back()
    if clear:
        _memos[owner] = clear


def single_threaded() -> None:
    """Keep native libraries inside a task to the core that the task has."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
