"""What several operators of this package need: cutting lineage, and shipping Python code to executors."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this package travel to the executors by value: no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules["fathomline.llm"])

#: Words of the n-gram and mixing operators.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a folder of its own, which is written back to the session's
    setting; a cluster without the setting is an error, since its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/fathomline-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back: later stages survive lost executors.

    The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Sets the session to send Python at most so many rows at once, unless its setting was changed: rows hold whole texts, and
    a batch is in memory several times over."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name) == usual:
        spark.conf.set(name, rows)


def process_cache(name: str) -> dict:
    """A dict that lasts as long as this Python worker, whatever is unpickled again for each task."""
    return sys.__dict__.setdefault("_fathomline_caches", {}).setdefault(name, {})


def tidy(batches: Iterator, cache: str = "") -> Iterator:
    """The batches; first frees what other operators keep in this Python worker, and last gives free memory back.

    Workers outlive stages, and their memory is the executor's.
    """
    caches = sys.__dict__.setdefault("_fathomline_caches", {})
    for other in [k for k in caches if k != cache]:
        del caches[other]
    yield from batches
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)
