"""Places in an order within each key, without one task for a whole key.

A window by key sorts all rows of the key in one task, and of kinds of media there are four. Here rows are
partitioned by ranges of key and whole order, so a key is spread over as many tasks as it has rows for; each partition
is sorted and written as its own folder. A row's place is its number within its partition, plus the rows of its key in
earlier partitions. There are at most as many counts as partitions and keys together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.storage import fresh_path

#: Rows of a task.
ROWS = 2_000_000


@dataclass(frozen=True)
class Listing:
    """Rows in order, in folders by part, with their number `r_at` in the part; and of each key and part the first number,
    the rows and the rows before it."""

    rows: DataFrame
    spans: DataFrame
    by: list[str]
    place: str

    def _placed(self, spans: DataFrame) -> DataFrame:
        own = [c for c in self.rows.columns if c not in ("r_part", "r_at")]
        same = reduce(lambda a, b: a & b, (self.rows[c].eqNullSafe(spans[f"r_key{i}"]) for i, c in enumerate(self.by)), F.col("r_part") == F.col("r_span"))
        number = F.col("r_at") - F.col("r_first") + F.col("r_before") + 1
        return self.rows.join(spans, same).select(*own, number.alias(self.place))

    def all(self) -> DataFrame:
        return self._placed(self.spans)

    def between(self, low: int, high: int) -> DataFrame:
        """Rows of places low to high of each key; only folders that hold some of them are read."""
        hit = self.spans.where((F.col("r_before") < high) & (F.col("r_before") + F.col("r_n") >= low))
        return self._placed(hit).where(F.col(self.place).between(low, high))


def listing(rows: DataFrame, by: list[str], order: list[Column], place: str = "place", rows_a_task: int = ROWS) -> Listing:
    """rows in the order (which should tell any two rows of a key apart), ready for places and pages.

    Null keys are a key of their own; an empty table is an empty listing; a column named as the place is replaced. Columns
    that start with r_ are not allowed."""
    spark = rows.sparkSession
    if taken := [c for c in rows.columns if c.startswith("r_")]:
        raise ValueError(f"columns of the listing's own names: {taken}")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_a_task))
    keys = [F.col(c).asc_nulls_first() for c in by]
    ordered = rows.drop(place).repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    path = fresh_path(spark, "listing")
    ordered.withColumn("r_part", F.spark_partition_id()).withColumn("r_at", F.monotonically_increasing_id()).write.partitionBy("r_part").parquet(path)
    schema = ordered.select("*", F.lit(0).alias("r_part"), F.lit(0).cast("long").alias("r_at")).schema
    found = spark.read.schema(schema).parquet(path)
    counts = found.groupBy(*by, "r_part").agg(F.min("r_at").alias("r_first"), F.count("*").alias("r_n"))
    before = F.sum("r_n").over(Window.partitionBy(*by).orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1))
    named = [F.col(c).alias(f"r_key{i}") for i, c in enumerate(by)]
    spans = counts.select(*named, F.col("r_part").alias("r_span"), "r_first", "r_n", F.coalesce(before, F.lit(0)).alias("r_before"))
    return Listing(found, spans, by, place)


def after(rows: DataFrame, order: list[tuple[str, bool]], last: dict | None, size: int) -> DataFrame:
    """The next `size` rows after the row `last` (None: from the start) in the order of (column, descending).

    A seek instead of an offset: rows before `last` are filtered out, by the scan as far as the first column tells, and of the
    others each task keeps `size`. Columns of the order hold no nulls."""
    if last is not None:
        beyond, tied = F.lit(False), F.lit(True)
        for name, down in order:
            value = F.lit(last[name])
            beyond = beyond | (tied & (F.col(name) < value if down else F.col(name) > value))
            tied = tied & (F.col(name) == value)
        first, down = order[0]
        rows = rows.where(F.col(first) <= last[first] if down else F.col(first) >= last[first]).where(beyond)
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)).limit(size)
