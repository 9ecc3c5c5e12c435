"""Readers and writers: Parquet, CSV with and without a byte-order mark, month files, reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """A Parquet scan, pruned to columns; with a schema, nothing is inferred."""
    found = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return found.select(*columns) if columns else found


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the footer alone."""
    return spark.read.parquet(path).columns


def between(frame: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows with start <= ts < end; over a Parquet scan the predicate reaches the row groups."""
    return frame.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def months(first: date, last: date) -> list[date]:
    """First days of all months from that of first to that of last."""
    n = (last.year - first.year) * 12 + last.month - first.month
    return [date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1) for i in range(n + 1)]


def month_of(path: str | Path, pattern: str = r"_(\d{4})-(\d{2})\.parquet$") -> date:
    found = re.search(pattern, str(path))
    if not found:
        raise ValueError(f"no month in {path}")
    return date(int(found[1]), int(found[2]), 1)


def month_files(spark: SparkSession, folder: str, first: date, last: date, prefix: str = "") -> dict[date, str]:
    """Path of each month's file; a missing month is an error. Listed by Spark's file system, so any store does."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [str(s.getPath()) for s in listed]
    found = {month_of(n): n for n in names if re.search(rf"{re.escape(prefix)}.*_\d{{4}}-\d{{2}}\.parquet$", n)}
    wanted = months(first, last)
    if missing := [m for m in wanted if m not in found]:
        raise FileNotFoundError(f"no file for {', '.join(f'{m:%Y-%m}' for m in missing)}")
    return {m: found[m] for m in wanted}


def drifting(spark: SparkSession, paths: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Files whose columns agree by name and not by type: each is read by itself, cast and put together."""
    frames = []
    for p in paths:
        f = spark.read.parquet(p)
        if missing := sorted(set(types) - set(f.columns)):
            raise ValueError(f"{p} lacks {', '.join(missing)}")
        frames.append(f.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def lookup_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A semicolon CSV with a header; a byte-order mark and spaces about names are dropped, all columns are text."""
    found = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    found = found.toDF(*[c.lstrip("﻿").strip() for c in found.columns])
    if missing := [c for c in required if c not in found.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found.select(*required)


def written_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV that this package wrote earlier, mark or none."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def write_csv(frame: DataFrame, path: str, mark: bool = False) -> None:
    """A folder of CSV parts with headers; with mark, each begins with a byte-order mark, as spreadsheets want it."""
    if mark:
        frame = frame.withColumnRenamed(frame.columns[0], "\ufeff" + frame.columns[0])
    frame.write.mode("overwrite").csv(path, header=True)


def report_csv(frame: DataFrame, path: str, limit: int = 100_000) -> None:
    """One local CSV file with a byte-order mark, for a small result: more than limit rows are an error (write_csv() has no such limit)."""
    rows = frame.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write_csv() has no such limit")
    rows.to_csv(path, index=False, encoding="utf-8-sig")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; on a single machine without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cellflow-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sample(frame: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order of keys."""
    return frame.orderBy(*keys).limit(n)


def markdown(frame: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table, pipes escaped; more than limit rows are an error."""
    rows = frame.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(map(cell, frame.columns)) + " |", "|" + "---|" * len(frame.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A Markdown report of texts and small results."""
    parts = [f"# {title}\n"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n{body if isinstance(body, str) else markdown(body)}")
    return "\n".join(parts)


def slot_log(spark: SparkSession, folder: str) -> DataFrame:
    """The bundled events as a log of cells: cell, ts, value, kind, slot, op_date, ord."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("cell"), "ts", "value", F.col("event_type").alias("kind"))
    e = e.withColumn("slot", S.slot("ts")).withColumn("op_date", S.operating_date("ts"))
    return e.withColumn("ord", S.absolute_order("op_date", "slot"))
