"""Sinks: atomic rewrites, upserts, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.curation import upsert


def _paths(spark: SparkSession, *paths: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    found = [make(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), found


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` beside the table and rename it into place, so that it may read the table that it replaces."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, (target, new, gone) = _paths(spark, path, staged, old)
    had = fs.exists(target)
    if had and not fs.rename(target, gone):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, target):
        if had:
            fs.rename(gone, target)
        raise OSError(f"can't replace {path}")
    if had:
        fs.delete(gone, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, (target,) = _paths(spark, path)
    return fs.exists(target)


def upsert_table(updates: DataFrame, path: str, key: list[str], keep_old_where_null: list[str] | None = None) -> None:
    """Replace and add rows by key in a Parquet table; it is made if it isn't there."""
    spark = updates.sparkSession
    rows = updates.dropDuplicates(key)
    replace_table(upsert(spark.read.parquet(path), rows, key, keep_old_where_null) if exists(spark, path) else rows, path)


def csv_report(df: DataFrame, path: str) -> None:
    """A report with a header and the mark by which spreadsheets know UTF-8, as files of one folder."""
    first = df.columns[0]
    df.withColumnRenamed(first, f"\ufeff{first}").write.mode("overwrite").csv(path, header=True)


def log_answer(spark: SparkSession, path: str, question: str, answer: str) -> int:
    """Append an answer with the next number."""
    last = spark.read.parquet(path).agg(F.max("n")).first()[0] if exists(spark, path) else 0
    number = (last or 0) + 1
    spark.createDataFrame([(number, question, answer)], "n long, question string, answer string").write.mode("append").parquet(path)
    return number
