"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.storage import discard, fresh_path, shared_dir
from twinsift.storage import kept as stored

__all__ = ["WORD", "discard", "double_array", "fresh_path", "hex_bucket", "long_array", "partitions", "shared_dir", "stored", "table", "words"]

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def double_array(values: list[float]) -> Column:
    """A constant array; one foldable literal, so that plans stay small."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def long_array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def hex_bucket(value: Column, digits: int) -> Column:
    """The first hex digits of a value's MD5 as a number: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
