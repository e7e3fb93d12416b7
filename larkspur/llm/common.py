"""What the operators of this subpackage share: tables, shared scratch space, lambda bindings."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word in every contract that says so: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset and all run on one machine (tests) a folder of our own is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    if not _written:
        atexit.register(_remove_scratch)
    _written.append(path := f"{scratch_root(spark)}/larkspur/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    return path


def _remove_scratch() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended before Python does
        for path in _written:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: the rows go to a Parquet table in the shared folder and are read again, so a lost executor costs no more than the rest of a stage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds `value` once, so that higher-order functions inside `body` don't evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
