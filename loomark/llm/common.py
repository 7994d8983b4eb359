"""Helpers of the training-data operators: shared folder, hashing of rows, reading tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores is dealt to all of them; any other stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but those used under a name of its own, so that none clashes with an operator's; and a function
    that gives a result its names back. Of a column that the operator adds and one of docs by its name, the new one stays."""
    names = docs.columns
    own = [n if n in used and names.index(n) == i else f"_aside_{i}" for i, n in enumerate(names)]

    def back(out: DataFrame) -> DataFrame:
        new = [c for c in out.columns if c not in own]
        taken = {c.lower() for c in new}
        held = [F.col(o).alias(n) for o, n in zip(own, names) if o in out.columns and n.lower() not in taken]
        return out.select(*held, *new)

    return docs.toDF(*own), back


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, one of our own."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not held:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
        held = tempfile.mkdtemp(prefix="loomark-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomark/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str, path: str | None = None, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: later reads don't recompute it,
    also after an executor is lost. Returns the reread frame and its path."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").options(**({"compression": compression} if compression else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() has a fast way for pure ASCII; translate() keeps other letters."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Lower the session's Arrow batches to so many rows and bytes, where they are larger: a task then holds few long texts at
    once, in the executor and in its Python worker. Results do not depend on it."""
    key = "spark.sql.execution.arrow."
    if int(spark.conf.get(f"{key}maxRecordsPerBatch")) > rows:
        spark.conf.set(f"{key}maxRecordsPerBatch", str(rows))
    held = spark.conf.get(f"{key}maxBytesPerBatch")
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > size:
        spark.conf.set(f"{key}maxBytesPerBatch", f"{size}b")
