"""Exact duplicates through a persistent index of text digests.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch is reduced to
one row per digest, the digests that the index lacks are found by a sort-merge anti-join
(the index side needs no shuffle), and they are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_keys, one_row, shared_dir, stored, text_of

#: A digest is hot from this share of a batch's rows on, so at most 1 / HOT_SHARE are hot.
HOT_SHARE = 0.002


class DigestIndex:
    """Digests of all texts seen so far: digest binary, keep_id long, group_size long.

    path None makes a new index in the shared folder. An existing folder is opened again
    with the same number of buckets, which is why that number is part of the interface.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame) -> None:
        """Add the rows of batch (digest, keep_id, group_size; one per digest) whose digest is new."""
        new = batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table, path=self.path)
        )
        self.spark.catalog.refreshTable(self.table)


    def drop(self) -> None:
        """Remove the index, files and all."""
        files = self.read()
        self.spark.sql(f"DROP TABLE {self.table}")
        discard(files)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest: 32 bytes of SHA-256 over the whole text in UTF-8 (null as empty)."""
    return docs.select("doc_id", F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"))


def classify(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept; the index grows by the new digests.

    Of equal texts in a batch the row with the largest doc_id stays (null ids are smaller than
    any other); texts that the index already held stay with the row kept then, so all their rows
    in this batch are dropped. Of rows repeated with the same id and text, one stays. A null text
    equals an empty one. group_size counts the rows of the batch that first brought the text.
    Other columns of docs are ignored.
    """
    return _classified(digests(docs), index)


def classify_in_batches(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """classify() of batches one after the other, each against the index that those before it left.

    Batches are ranges of digests, so equal texts come in one batch and the result is that of classify() at once, while
    a batch and what is appended for it are bounded by the number of batches. The texts are read once.
    """
    rows = stored(digests(docs), "digests")
    out = None
    for k in range(batches):
        part = rows.where(F.pmod(F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int"), F.lit(batches)) == k)
        found = _classified(part, index)
        out = found if out is None else out.unionByName(found)
    return out


def _classified(rows: DataFrame, index: DigestIndex) -> DataFrame:
    batch = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    before = index.read().count()
    known = index.read().select("digest", F.lit(True).alias("old")) if before else None
    if known is not None:  # taken before the batch is added
        old = batch.select("digest").join(known.hint("merge"), "digest").select("digest", "old")
        old = stored(old, "known-digests")
    index.append(batch)
    kept_rows = index.read()
    # rows repeated with one id and text are counted once and expanded again
    each = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("times"))
    total = each.agg(F.sum("times")).first()[0] or 0
    # at most 1 / HOT_SHARE digests can be hot in this batch, whatever the index holds
    hot = each.groupBy("digest").agg(F.sum("times").alias("n")).where(F.col("n") >= max(1000, int(total * HOT_SHARE))).select("digest")
    cold = each.join(hot.hint("broadcast"), "digest", "left_anti").join(kept_rows.hint("merge"), "digest")
    hot = kept_rows.join(hot.hint("broadcast"), "digest")
    out = cold.unionByName(each.join(hot.hint("broadcast"), "digest"))
    out = out.withColumn("old", F.lit(False)) if known is None else out.join(old.hint("merge"), "digest", "left").withColumn("old", F.coalesce("old", F.lit(False)))
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
        "doc_id", "digest", "keep_id", "group_size", (~F.col("old") & (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")
    )


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, with all their columns; same rules as classify().

    Rows with one id and text count as one, that with the smallest hash of its other columns. They are brought down to
    one before the shuffle, and texts are shuffled once.
    """
    keys = ["digest", "none", "id"]
    keep = classify(docs.select("doc_id", "text"), index).where("kept").select("digest", *id_keys())
    once = one_row(docs, F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"), *id_keys())
    return once.join(keep.hint("merge"), keys, "left_semi").select("row.*")
