"""Phrase collocations by hashed bucket counts and Apriori pruning (operator 13).

Texts become blocks once: of one language each, a dictionary of words and the numbers of the words in order, with breaks
between pieces. Single words are counted exactly from the dictionaries. Then phrases of 2, 3 and 4 words, one pass over
the blocks each:

* while phrases of a length are counted, the phrases one word longer are counted by buckets of their hash (in the
  first pass those of two words), only where both of their parts passed. A task adds up its own buckets, which stop at
  `least`; sums of such numbers say exactly whether a bucket holds `least` phrases or more;
* the buckets that do are broadcast as a bitmap, and so are the hashes of the frequent phrases one word
  shorter. Only places whose bucket is set and whose two shorter parts are frequent (Apriori) are counted exactly,
  in the task first, then by (language, phrase). Hashes only spare work: the counts are those of words.

The rest are joins: each candidate is cut after each word, the counts of both parts give its score; candidates
inside longer ones that are about as frequent are dropped; the first of each language are ranked in two steps.

Bounds: bitmaps have at most 2^`WIDEST` bits (2 MB) whatever the input: about a bit for 32 bytes, beyond that only
Apriori prunes. They alone are collected and broadcast. A task holds a block of about `BLOCK` characters (at least one
text), blocks begun of other languages up to four times that, and a byte for each bucket. The parts of
candidates that are single words are salted; frequent phrases and words are pre-aggregated in the tasks.

Defined cases: null texts are empty and have no words; null lang is `und`; texts without words add nothing; very
long texts are one block; repeated rows count as often as they occur; ties in score go by count, then by the phrase's
bytes, ties between cuts to the shorter first part; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import discard, partitions, stored, table

LEAST, LONGEST, TOP, INSIDE, SCALE = 30, 4, 2000, 80, 2_000_000
BLOCK, CHUNK, NARROWEST, WIDEST = 1 << 21, 4096, 16, 24
SALTS = 16
BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = bytes.maketrans(BREAKS, b"\xff" * len(BREAKS))

BLOCKS = "lang string, words array<string>, counts array<long>, ids binary, names binary, chunk int, cells binary, n long"
COUNTS = "lang string, phrase string, chunk int, cells binary, n long"


def _numbered(texts: list[str]):
    """The distinct words of texts, and the number of each word in order; -1 between pieces. 0xFF is in no UTF-8 text."""
    import numpy as np

    words = "\n".join(texts).encode().lower().translate(_BREAK).replace(b"\xff", b" \xff ").split()
    slots: dict[bytes, int] = {b"\xff": -1}
    ids = np.fromiter((slots.setdefault(w, len(slots) - 1) for w in words), np.int32, len(words))
    del slots[b"\xff"]
    return list(slots), ids


def _mixed(x):
    """Spreads the bits of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]):
    import zlib

    import numpy as np
    import xxhash

    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _hashes(each, k: int) -> list:
    """each: the hash of the word at every place. The hashes of the phrases of 1 to k words from every place on."""
    import numpy as np

    out = [each]
    for j in range(1, k):
        out.append(_mixed(out[-1][: max(len(each) - j, 0)] * np.uint64(0x9E3779B97F4A7C15) + each[j:]))
    return out


class _Cells:
    """Bucket counts of a task, which stop at `least`."""

    def __init__(self, bits: int, least: int) -> None:
        import numpy as np

        self.mask, self.least = np.uint64((1 << bits) - 1), least
        self.cells = np.zeros(1 << bits, np.uint8 if least < 256 else np.uint32)

    def add(self, hashes) -> None:
        import numpy as np

        found, n = np.unique(hashes & self.mask, return_counts=True)
        found = found.astype(np.int64)
        self.cells[found] = np.minimum(self.cells[found] + np.minimum(n, self.least), self.least)

    def rows(self, schema) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        chunks = self.cells.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        for a in range(0, len(used), 1024):
            part = used[a : a + 1024]
            columns = {"chunk": pa.array(part, pa.int32()), "cells": pa.array([pack(chunks[i].tobytes()) for i in part], pa.binary()), "n": pa.array(np.ones(len(part), np.int64))}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(part), f.type)) for f in schema], schema=schema)


def _is_set(bitmap, hashes):
    """Whether the bucket of each hash is in the bitmap (a bit for each bucket)."""
    import numpy as np

    at = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _cells_type(least: int) -> str:
    return "<u1" if least < 256 else "<u4"


def _bitmap(chunks: DataFrame, bits: int, least: int) -> bytes:
    """A bit for each bucket that holds `least` or more, from rows (chunk, cells, n: how often this row). Its size is that of the buckets."""
    kind = _cells_type(least)

    def added(last: bool):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import zstandard

            sums: dict = {}
            pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for chunk, cells, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    more = np.minimum(np.frombuffer(unpack(cells), kind).astype(np.int64) * min(n, least), least)
                    sums[chunk] = (np.minimum(sums[chunk] + more, least) if chunk in sums else more).astype(kind)
            for chunk, cells in sums.items():
                held = np.packbits(cells >= least).tobytes() if last else pack(cells.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([held], pa.binary()), pa.array([1], pa.int64())], ["chunk", "cells", "n"])

        return run

    schema, spark = "chunk int, cells binary, n long", chunks.sparkSession
    once = chunks.select("chunk", "cells", "n").mapInArrow(added(False), schema)
    whole = bytearray((1 << bits) // 8)
    for row in once.repartition(partitions(spark), "chunk").mapInArrow(added(True), schema).collect():
        whole[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = row["cells"]
    return bytes(whole)


def _blocks(docs: DataFrame, bits: int, least: int, block: int) -> DataFrame:
    """Blocks of words, and bucket counts of phrases of two words."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        cells, packed = _Cells(bits, least), zstandard.ZstdCompressor(level=1).compress
        schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary()), ("names", pa.binary()), ("chunk", pa.int32()), ("cells", pa.binary()), ("n", pa.int64())])
        begun: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str):
            texts = begun.pop(lang)
            sizes.pop(lang)
            words, ids = _numbered(texts)
            if not words:
                return
            each = np.append(_word_hashes(lang, words), np.uint64(0))[ids]
            good = ids >= 0
            if len(ids) > 1:
                cells.add(_hashes(each, 2)[1][good[:-1] & good[1:]])
            counts = np.bincount(ids[good], minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), *(pa.array([packed(x)], pa.binary()) for x in (ids.tobytes(), b"\n".join(words))), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([1], pa.int64())],
                schema=schema,
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                begun.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= block:
                    yield from flush(lang)
                elif sum(sizes.values()) >= 4 * block:
                    yield from flush(max(sizes, key=sizes.get))
        for lang in list(begun):
            yield from flush(lang)
        yield from cells.rows(schema)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, BLOCKS)


def _pass(blocks: DataFrame, k: int, shorter: bytes, buckets: bytes, bits: int, least: int, last: bool) -> DataFrame:
    """Phrases of k words that may be frequent, counted by block, and bucket counts of those of k + 1 words."""
    context = blocks.sparkSession.sparkContext
    told = context.broadcast((shorter, buckets))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        unpacked = zstandard.ZstdDecompressor().decompress
        parts_set, own_set = (np.frombuffer(b, np.uint8) for b in told.value)
        cells = None if last else _Cells(bits, least)
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("chunk", pa.int32()), ("cells", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for row in range(batch.num_rows):
                lang, ids = batch.column(0)[row].as_py(), np.frombuffer(unpacked(batch.column(2)[row].as_py()), np.int32)
                names = unpacked(batch.column(1)[row].as_py()).split(b"\n")
                words = pa.array(names, pa.string())
                if len(ids) < k:
                    continue
                each = np.append(_word_hashes(lang, names), np.uint64(0))[ids]
                hashes, whole = _hashes(each, k if last else k + 1), ids >= 0
                for j in range(1, k - 1):
                    whole = whole[: len(ids) - j] & (ids[j:] >= 0)
                part = whole & _is_set(parts_set, hashes[k - 2])
                place = part[:-1] & part[1:]
                place[place] = _is_set(own_set, hashes[k - 1][place])
                if not last:
                    cells.add(hashes[k][place[:-1] & place[1:]])
                at = np.flatnonzero(place)
                if not len(at):
                    continue
                # Equal phrases have equal keys: the words' numbers side by side, or the number of the first part among its like.
                width, key = len(words).bit_length(), ids[at].astype(np.int64)
                used = width
                for j in range(1, k):
                    if used + width > 62:
                        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                        used = len(at).bit_length()
                    key, used = key << width | ids[at + j], used + width
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(ids[at[first] + j])) for j in range(k)), " ")
                for a in range(0, len(n), 20_000):
                    m = min(20_000, len(n) - a)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), phrase[a : a + m].cast(pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(n[a : a + m], pa.int64())], schema=schema)
        if not last:
            yield from cells.rows(schema)

    found = blocks.where("chunk is null").select("lang", "names", "ids").mapInArrow(run, COUNTS)
    # Buckets of tasks that are alike are one row with a number; the others stay as they are.
    return found.groupBy("lang", "phrase", "chunk", "cells").agg(F.sum("n").alias("n")).where(f"chunk is not null or n >= {least}")


def _marks(frequent: DataFrame, bits: int, least: int) -> DataFrame:
    """Buckets of frequent phrases (lang, phrase)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cells, schema = _Cells(bits, 1), pa.schema([("chunk", pa.int32()), ("cells", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            langs: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                langs.setdefault(lang, []).append(phrase.encode().split(b" "))
            for lang, phrases in langs.items():
                each = _word_hashes(lang, [w for p in phrases for w in p]).reshape(len(phrases), -1)
                found = each[:, 0]
                for j in range(1, each.shape[1]):
                    found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + each[:, j])
                cells.add(found)
        yield from cells.rows(schema)

    return frequent.select("lang", "phrase").mapInArrow(run, "chunk int, cells binary, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of up to `longest` words that occur `least` times or more, and (lang, n), all words."""
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(WIDEST, max(NARROWEST, (size // 64).bit_length()))
    blocks = stored(_blocks(docs, bits, least, block), "blocks")
    each = blocks.where("chunk is null").select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = stored(each.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("n")), "words")
    totals = stored(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found = stored(counted.where(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("k"), "n"), "frequent")
    out, buckets = found, _bitmap(blocks.where("chunk is not null"), bits, least)
    discard(counted)
    for k in range(2, longest + 1):
        shorter = _bitmap(_marks(found, bits, least), bits, 1)
        made = stored(_pass(blocks, k, shorter, buckets, bits, least, k == longest), "passed")
        found = made.where("chunk is null").select("lang", "phrase", F.lit(k).alias("k"), "n")
        out = out.unionByName(found)
        if k < longest:
            buckets = _bitmap(made.where("chunk is not null"), bits, least)
    discard(blocks)
    return out, totals


def _scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) by the lowest-scoring cut of each phrase of two words or more."""
    cut = F.split("phrase", " ")
    rows = frequent.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    rows = rows.select("*", F.concat_ws(" ", F.slice(cut, 1, F.col("at"))).alias("first"), F.concat_ws(" ", F.slice(cut, F.col("at") + 1, F.col("k") - F.col("at"))).alias("rest"))
    # A common word is a part of very many phrases.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumns({"first_salt": F.when(F.col("at") == 1, salt).otherwise(0), "rest_salt": F.when(F.col("k") - F.col("at") == 1, salt).otherwise(0)})
    salts = F.when(F.col("k") == 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    counts = frequent.select("lang", F.col("phrase").alias("part"), "n", F.explode(salts).alias("salt"))
    for name, out in (("first", "l"), ("rest", "r")):
        rows = rows.join(counts.select("lang", F.col("part").alias(name), F.col("n").alias(out), F.col("salt").alias(f"{name}_salt")), ["lang", name, f"{name}_salt"])
    score = F.expr(f"cast(cast(a as decimal(20,0)) * cast({SCALE} as decimal(8,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = rows.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "l", "r", "a", "k")).alias("b"))
    return best.select("lang", "phrase", "b.k", "b.a", "b.l", "b.r", "b.score")


def _inside(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a longer candidate that holds the phrase."""
    cut = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.concat_ws(" ", F.slice(cut, i, m)))))
    held = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    return held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **more) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language."""
    frequent, totals = frequent_phrases(docs, least, longest, **more)
    scored = stored(_scored(frequent), "scored")
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    left = scored.join(_inside(scored), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", INSIDE)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # First of a part of each language, then of those.
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    some = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""WITH piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM piece GROUP BY lang),
gram AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws)-k+2)) AS i FROM piece, range(1, {LONGEST + 1}) r(k))),
freq AS (SELECT lang, k, phrase, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM freq WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.k, c.a, f.a AS l, g.a AS r, j, CAST(CAST({SCALE} AS HUGEINT)*c.a // (CAST(f.a AS HUGEINT)+g.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN freq f ON f.lang=c.lang AND f.phrase=array_to_string(c.ws[1:j], ' ') JOIN freq g ON g.lang=c.lang AND g.phrase=array_to_string(c.ws[j+1:c.k], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM cut) WHERE b = 1),
held AS (SELECT lang, array_to_string(ws[i:i+m-1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, k, a, m, unnest(range(1, k-m+2)) AS i FROM cand, range(2, {LONGEST}) r(m) WHERE m < k) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM best b JOIN total t ON t.lang=b.lang LEFT JOIN held h ON h.lang=b.lang AND h.phrase=b.phrase WHERE h.longer IS NULL OR 100*CAST(h.longer AS HUGEINT) < {INSIDE}*CAST(a AS HUGEINT)) WHERE rank <= {TOP}"""
