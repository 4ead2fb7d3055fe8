"""Sharding (operator 10): rows in the order of a Hilbert curve over their metadata, cut into even runs.

Each dimension (a number, or a whole string) is quantised into 2^bits bins at quantiles of all rows. The bins are a point, the point a place on the Hilbert
curve, and the rows are sorted by that place over all partitions; neighbours on the curve are near in
every dimension, so a shard's rows span few bins and min/max statistics prune files by any of them.

The law is `bytes`: the sorted rows are cut near where the running size passes each nth part of the total.
Rows of one group (equal texts) stand together, since the group has one place (the least of its rows' places),
and stay in one shard where the group is no larger than twice the largest row or an eighth of a shard: cuts move
to the nearer edge, so a shard's size is off by no more than that half at either end. Larger groups are cut
between rows.

Only running sums by partition and at most shards - 1 cuts come to the driver.

Defined cases: null texts have no bytes; null metadata is the first bin; ties on the curve go by text,
then doc_id; repeated rows count as they are; fewer rows than shards leave shards empty; an empty table
gives an empty result; other columns are carried, but for names starting with `s_`, which are the
operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.common import partitions, stored

SHARDS, BITS, SLACK = 24, 5, 1 / 8


def _text_edges(df: DataFrame, column: str, n: int) -> list[str]:
    """The values of a string column at which every nth part of the rows begins, by counts of all its values.

    Values are counted, sorted over all partitions and summed up within each; sums by partition and the at most n
    values are all that comes to the driver."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("")).alias("s_value")
    counts = df.groupBy(value).agg(F.count("*").alias("s_n")).repartitionByRange(partitions(df.sparkSession), "s_value")
    counts = stored(counts.withColumn("s_part", F.spark_partition_id()), "values")
    parts = counts.groupBy("s_part").agg(F.sum("s_n").alias("n")).orderBy("s_part").collect()  # one row a partition
    total, offsets = 0, []
    for r in parts:
        offsets.append((r["s_part"], total))
        total += r["n"]
    if not total:
        return []
    upto = F.sum("s_n").over(Window.partitionBy("s_part").orderBy("s_value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("s_offset")
    placed_ = counts.join(F.broadcast(df.sparkSession.createDataFrame(offsets, "s_part int, s_offset long")), "s_part").withColumn("s_upto", upto)
    passed = lambda c: F.floor(c * F.lit(n) / F.lit(float(total)))
    found = placed_.where(passed(F.col("s_upto")) > passed(F.col("s_upto") - F.col("s_n"))).select("s_value").collect()
    return sorted((r["s_value"] for r in found), key=str.encode)


def bins(df: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """The bin (int) of each row in each dimension, by approximate quantiles of numbers and quantiles of strings; null is in the first."""
    n = 1 << bits
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
    edges: dict[str, list] = {}
    if numbers:
        found = df.agg(*(F.percentile_approx(number(c), [i / n for i in range(1, n)], 2000).alias(f"e{i}") for i, c in enumerate(numbers))).first()
        edges = {c: sorted(set(found[i] or [])) for i, c in enumerate(numbers)}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    edges |= {c: _text_edges(df, c, n) for c in columns if c not in edges}
    value = lambda c: number(c) if c in numbers else text(c)
    return [sum((F.when(value(c) >= F.lit(e), 1).otherwise(0) for e in edges[c][: n - 1]), F.lit(0)).cast("int") for c in columns]


def hilbert(points, bits: int):
    """Place on the Hilbert curve of each row of an (n, d) array of bins: transposed Gray code, from the highest bit down."""
    import numpy as np

    x = points.astype(np.int64).copy()
    d = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            up = (x[:, i] >> b) & 1 == 1
            x[up, 0] ^= low  # turn over
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = (place << 1) | ((x[:, i] >> b) & 1)
    return place


def placed(docs: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """docs with s_place, the Hilbert index of their bins."""
    made = docs.select("*", F.array(*bins(docs, columns, bits)).alias("s_point"))
    schema = T.StructType([*docs.schema.fields, T.StructField("s_place", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            points = batch.column(batch.schema.get_field_index("s_point")).flatten().to_numpy().reshape(-1, len(columns)) if len(batch) else np.zeros((0, len(columns)), np.int64)
            yield batch.drop_columns(["s_point"]).append_column("s_place", pa.array(hilbert(points, bits), pa.int64()))

    return made.mapInArrow(run, schema)


def shard(docs: DataFrame, columns: list[str], size: str, group: str, shards: int = SHARDS, bits: int = BITS, slack: float = SLACK) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard).

    size: a column of row sizes (long); group: a column whose equal values (64-bit hashes or more) belong together.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = placed(docs.select(*keep), columns, bits)
    # A group of several places takes the least; single rows need no second look, but which are single takes the counts.
    rows = stored(rows, "places")
    several = rows.groupBy(group).agg(F.min("s_place").alias("s_least"), F.max("s_place").alias("s_most")).where("s_least < s_most").select(F.col(group).alias("s_group"), "s_least")
    moved = rows.join(several, F.col(group) == F.col("s_group"), "left").withColumn("s_place", F.coalesce("s_least", "s_place")).drop("s_group", "s_least")
    tie = F.xxhash64(*(F.col(c) for c in keep))
    ordered = moved.withColumn("s_tie", tie).repartitionByRange(partitions(spark), "s_place", group, "s_tie").sortWithinPartitions("s_place", group, "s_tie").drop("s_tie")
    schema = T.StructType([*ordered.schema.fields, T.StructField("s_part", T.IntegerType()), T.StructField("s_rank", T.LongType()), T.StructField("s_upto", T.LongType())])

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, rank, upto = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = len(batch)
            sums = upto + np.cumsum(batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False))
            out = batch.append_column("s_part", pa.array(np.full(n, part), pa.int32())).append_column("s_rank", pa.array(rank + np.arange(n), pa.int64()))
            yield out.append_column("s_upto", pa.array(sums, pa.int64()))
            rank, upto = rank + n, int(sums[-1]) if n else upto

    local = stored(ordered.mapInArrow(summed, schema), "order")
    parts = [(r["s_part"], r["n"], r["b"]) for r in local.groupBy("s_part").agg(F.count("*").alias("n"), F.max("s_upto").alias("b")).orderBy("s_part").collect()]  # one row a partition
    before, n, b = [], 0, 0
    for part, rows_, bytes_ in parts:
        before.append((part, n, b))
        n, b = n + rows_, b + bytes_
    offsets = spark.createDataFrame(before, "s_part int, s_n long, s_b long")
    all_ = local.join(F.broadcast(offsets), "s_part").withColumn("s_upto", F.col("s_upto") + F.col("s_b")).withColumn("s_rank", F.col("s_rank") + F.col("s_n")).withColumn("s_from", F.col("s_upto") - F.col(size))
    cuts = _cuts(all_, size, group, b, shards, slack)
    number = sum((F.when(F.col("s_from") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    out = all_.withColumn("shard", number)
    starts = out.groupBy("shard").agg(F.min("s_rank").alias("s_first"))
    return out.join(F.broadcast(starts), "shard").withColumn("slot", F.col("s_rank") - F.col("s_first")).select(*keep, "shard", "slot")


def _cuts(rows: DataFrame, size: str, group: str, total: int, shards: int, slack: float) -> list[int]:
    """Running sizes at which a new shard begins: even parts, moved to a row's or a small group's edge."""
    wanted = [-(-total * i // shards) for i in range(1, shards)]
    if not total:
        return []
    hit = F.lit(False)
    for w in wanted:
        hit = hit | ((F.col("s_from") < w) & (F.col("s_upto") >= w))
    at = rows.where(hit).select("s_place", group, "s_from", "s_upto").collect()  # at most shards - 1 rows, each over a cut
    # The group's extent: its rows are neighbours.
    keys = rows.sparkSession.createDataFrame([(r["s_place"], r[group]) for r in at], rows.select(F.col("s_place").alias("k_place"), F.col(group).alias("k_group")).schema).distinct()
    span = {(r["s_place"], r[group]): (r["a"], r["b"]) for r in rows.join(F.broadcast(keys), (F.col("s_place") == F.col("k_place")) & F.col(group).eqNullSafe(F.col("k_group"))).groupBy("s_place", group).agg(F.min("s_from").alias("a"), F.max("s_upto").alias("b")).collect()}
    largest = rows.agg(F.max(size)).first()[0]
    room = max(2 * largest, int(slack * total / shards))
    cuts = []
    for w in wanted:
        r = next(r for r in at if r["s_from"] < w <= r["s_upto"])
        a, b = span[(r["s_place"], r[group])]
        if b - a > room:
            a, b = r["s_from"], r["s_upto"]
        cuts.append(a if w - a < b - w else b)
    return cuts


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its rows in slot order; very large shards are several files, each a run of slots."""
    n = partitions(sharded.sparkSession)
    sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("text_hash")
    )
    out = shard(rows, ["lang", "source", "n_chars"], "size", "text_hash")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
