"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than the space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
WHITESPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset on a single machine is a temporary folder made; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        global _OWN
        found = _OWN = _OWN or tempfile.mkdtemp(prefix="cellflow-")
    return found.rstrip("/")


_OWN = ""


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of stored() frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of stored input that a task of a shuffle gets.
TASK = 32 << 20


def tasks_for(df: DataFrame) -> int:
    """How many tasks a shuffle of something like df's size gets: spark.sql.shuffle.partitions or, if that is more, one for each TASK bytes that df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # frames made in memory have no size
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, -(-known // TASK)))


def released() -> None:
    """Give memory that a worker's task has freed back to the system (Python, Arrow and glibc keep it otherwise)."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_keys() -> tuple[Column, Column]:
    """Columns none and id that stand for doc_id in equi-joins and groups: null ids equal each other and no other id."""
    return F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")


def one_row(docs: DataFrame, *keys: Column) -> DataFrame:
    """The keys and row (a struct of all columns of docs), one for each combination of keys: that with the smallest hash of its columns but text.

    Rows are brought down to one per task before they are shuffled by the keys, so that a row repeated any number of
    times is no task's burden.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    told = [F.col(f"`{c}`") for c, t in docs.dtypes if c != "text" and not any(x in t for x in ("map<", "variant"))]
    keyed = docs.select(*keys, row, F.xxhash64(*told, F.lit(0)).alias("order"))
    return keyed.groupBy(*[c for c in keyed.columns if c not in ("row", "order")]).agg(F.min_by("row", "order").alias("row"))


def running_sum(df: DataFrame, group: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Exclusive running sum of value within each group, in order of (bucket, *order).

    Two levels, so that a group which holds most of the rows is still spread over its
    buckets: sums per (group, bucket), their running sum, then a window per (group, bucket).
    group must not be null. Rows equal in (bucket, *order) come in any order; give a total
    order where that matters.
    """
    offset, own = f"__{name}_offset", f"__{name}_value"
    df = df.withColumn(own, value)
    per_bucket = df.groupBy(group, bucket).agg(F.sum(own).alias(offset))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn(offset, F.coalesce(F.sum(offset).over(before), F.lit(0)))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(name, F.coalesce(F.sum(own).over(within), F.lit(0)))
        .join(per_bucket.hint("merge"), [group, bucket])
        .withColumn(name, F.col(name) + F.col(offset))
        .drop(own, offset)
    )


def ship(module: str) -> None:
    """Send the module's functions to the executors by value, so that they need no copy of this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
