"""SimHash near-duplicates (operator 3): deletion-variant signatures over two segments.

A fingerprint's 64 bits are cut into two segments of 32, fewer than the bits that may differ plus one:
of two fingerprints within 2 bits, one segment differs by at most 1 bit. So each segment is indexed
under its 32 variants with one bit struck out; fingerprints that share a variant are joined on equality
and verified. All of this works on distinct fingerprints: copies of a text count once.

Segment values that more than `crowd` fingerprints hold (families of near copies) would give large
buckets. They leave the segment index and use its exact limit case, one segment of all 64 bits: two
fingerprints are within 2 bits if and only if the sets "itself and its 64 one-bit neighbours" meet, and
no point is in more than 65 such sets. Fingerprints one bit from a crowded segment go through both, so
no link is lost and no bucket is larger than 2 * crowd or 65.

Up to `bits` differing bits are found by bits // 2 + 1 segments in the same way. The second route is that of 2 bits:
beyond, pairs that only meet in crowded values are missing, and the caller needs another way to them (see nearcopies).

Defined cases: null and empty texts have no words and the fingerprint 0, linked like any other; fewer
than `shingle` words count as one shingle; a null doc_id can't name a component (it takes the smallest
known one, or null if there is none); repeated rows keep their rows and share a component; an empty
table gives an empty result; other columns are carried and may have any names but `fingerprint`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.common import stored
from twinsift.operators.graph import components

SHINGLE, SEED, CROWD, BITS = 3, 42, 64, 2
SLICE = 1 << 16  # shingles whose bits are counted at once
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As a signed 64-bit number."""
    import itertools

    import numpy as np
    import xxhash

    w = text.translate(LOWER).split() if text else []
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    h = map(xxhash.xxh64_intdigest, grams, itertools.repeat(seed))
    return voted((np.fromiter(itertools.islice(h, SLICE), dtype="<u8") for _ in range(0, n, SLICE)), n)


def voted(parts: Iterable, n: int) -> int:
    """The bits that are set in over half of n hashes, given in arrays; as a signed 64-bit number."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for part in parts:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep_text: bool = True, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with `fingerprint` (long) in place of a column of that name, with or without the text."""
    docs = docs.drop("fingerprint") if text != "fingerprint" else docs
    schema = T.StructType([f for f in docs.schema.fields if keep_text or f.name != text] + [T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            out = batch if keep_text else batch.drop_columns([text])
            yield out.append_column("fingerprint", pa.array([fingerprint(x.as_py(), shingle, seed) for x in values], pa.int64()))

    return docs.mapInArrow(run, schema)


def links(prints: DataFrame, crowd: int = CROWD, bits: int = BITS) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints whose links have all the components of "2 bits or fewer differ".

    With more `bits`: all pairs that differ in so many at most and share no more than crowded segment values (see above)."""
    parts = bits // 2 + 1
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    held = lambda i: F.shiftrightunsigned("fingerprint", 64 - sum(widths[: i + 1])).bitwiseAND(F.lit((1 << widths[i]) - 1))
    cut = F.array(*(F.struct(F.lit(i).alias("s"), F.lit(widths[i] - 1).alias("last"), held(i).alias("v")) for i in range(parts)))
    segments = prints.select("fingerprint", F.explode(cut).alias("x")).select("fingerprint", "x.s", "x.last", "x.v")
    crowded = stored(segments.groupBy("s", "v").count().where(F.col("count") > crowd).select("s", "v"), "crowded")
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.col("v").bitwiseXOR(bit(j)))
    # Spark sizes exploded rows like those they come from, up to 64 times too low: without the hints it would broadcast them all.
    near = crowded.select("s", F.explode(F.concat(F.array("v"), flips)).alias("v")).distinct().hint("merge")

    variants = segments.join(crowded, ["s", "v"], "left_anti").select(
        "fingerprint",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda j: bit(F.lit(37)) * F.col("s") + bit(F.lit(32)) * j + F.col("v").bitwiseAND(F.bitwise_not(bit(j))))).alias("key"),
    )
    other = variants.select(F.col("fingerprint").alias("g"), F.col("key").alias("k2")).hint("merge")
    differ = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("g")))
    cold = variants.join(other, (F.col("key") == F.col("k2")) & (F.col("fingerprint") < F.col("g")) & (differ <= bits)).select(F.col("fingerprint").alias("u"), F.col("g").alias("v"))

    if bits > 2:
        return cold.distinct()
    around = F.concat(F.array("fingerprint"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.col("fingerprint").bitwiseXOR(bit(j))))
    members = segments.join(near, ["s", "v"], "left_semi").select("fingerprint").distinct()
    stars = members.select("fingerprint", F.explode(around).alias("z")).groupBy("z").agg(F.array_sort(F.collect_set("fingerprint")).alias("all")).where(F.size("all") > 1)  # at most 65
    hot = stars.select(F.col("all")[0].alias("u"), F.explode(F.slice("all", 2, 64)).alias("v"))
    return cold.unionByName(hot).distinct()


def groups(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(fingerprint, root, component_id) from rows (doc_id, fingerprint): the component of each distinct fingerprint."""
    each = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    found = components(links(each.select("fingerprint"), crowd))
    each = each.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    linked = stored(each, "linked")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.select("fingerprint", "root").join(names, "root")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One document of each component: that with the smallest doc_id (then fingerprint); repeated rows count once."""
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("k_row"))  # the row is one value, so no name clashes
    narrow = stored(with_fingerprint(rows.select("doc_id", "text"), keep_text=False), "narrow")
    found = groups(narrow, crowd)
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fingerprint"))
    keep = stored(narrow.distinct().join(found.select("fingerprint", "root"), "fingerprint").groupBy("root").agg(F.min(best).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.fingerprint").alias("k_fp")), "keep")
    one = with_fingerprint(rows, keep_text=False).join(keep, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("fingerprint") == F.col("k_fp")), "left_semi").dropDuplicates(["doc_id", "fingerprint"])
    return one.select("k_row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(with_fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False), "narrow")
    found = groups(docs)
    return docs.join(found, "fingerprint").select("doc_id", hexed(F.col("fingerprint")).alias("fingerprint"), "component_id")
