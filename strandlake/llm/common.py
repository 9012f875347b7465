"""Helpers that the training-data operators share: words, shared folders, checkpoints."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a new one if it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = jvm.get() if jvm.isDefined() else tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(given)
    return given


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, as a URI."""
    base = shared_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    """Written to the shared folder and read again: lineage ends, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the folders of a saved table that no later step reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more; call it when what was made of them is saved."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


#: What worker processes remember between tasks, by owner; each entry forgets it.
CACHES: dict[str, Callable[[], object]] = {}


def keep_only(owner: str | None = None) -> None:
    """At the start of a task: forgets what other operators' tasks left in this worker process, and gives the memory back."""
    import ctypes

    import pyarrow as pa

    for name, forget in CACHES.items():
        if name != owner:
            forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
