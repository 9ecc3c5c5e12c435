"""Slot aggregates of a stream of records: an extension for data that keeps arriving.

Records of a slot are added up as they come; a slot is given out once the watermark has passed
its end, and later records for it are dropped. Slots have unequal lengths, so groups are the
slots' own starts, with the watermark on the records' time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files as they appear in path."""
    return spark.readStream.schema(schema).parquet(path)


def slot_sums(records: DataFrame, late: str = "2 hours", cell: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """cell, op_date, slot, records, mean_value, max_value of a stream (or of a table, where the watermark has no effect).

    Groups also carry a four-hour window of record time, whose end lets Spark drop a slot's state.
    A slot of another length, or one that begins between windows, gives a row per window; the rows add up.
    """
    r = records.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    r = r.withColumns({"slot": S.slot(ts), "op_date": S.operating_date(ts)})
    groups = r.groupBy(F.window("__at", "4 hours", startTime="2 hours").alias("__w"), F.col(cell), "op_date", "slot")
    return groups.agg(F.count(F.lit(1)).alias("records"), F.sum(value).alias("sum_value"), F.max(value).alias("max_value")).select(cell, "op_date", "slot", "records", "sum_value", "max_value")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for the files that are there, as a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
