"""Substring deduplication (operator 5): fixed-block anchors, extended to exact repeats.

A word is removed if some window of `length` consecutive words that covers it also starts earlier
(smaller doc_id, or the same document at an earlier word). Rows are dealt into batches of about `BATCH`
words by a hash, and texts are shuffled once; every later step is about hashes of that shuffle's batches.

1. Anchors. Blocks of half the window (10 of 20 words) at every tenth word of every document are the
   index; every rolling window of 10 words of every document probes it. A repeated stretch of 20 words
   holds a whole block of the other occurrence, so each repeat has a hit. A batch sends its distinct
   hashes, sorted, as differences, to buckets by their first bits (a passage in a third of the rows is one
   entry a batch); a bucket answers with one bit for each entry: is there a block of that hash elsewhere?
   An entry has 28 bits beyond the bucket's, so about one in two thousand hits is false and costs a check.
2. Extension. The windows of 20 words that hold a hit are compared by 104-bit hashes in the same way: the
   earliest start of each wins, all others are repeats. Those that are later than one of the same batch
   are known there; of each other the bucket answers with its place if it is later than another batch's.
   Neighbouring windows join into maximal stretches.

Nothing is kept but shuffle files; a lost executor costs its tasks. Rows of a batch are put in order by
doc_id and text, so a batch that is read again has the same places.

Defined cases: null and empty texts have no words; texts shorter than a window stay; null doc_ids come
after all others, and rows with the same doc_id and start are not earlier than each other, so repeated
rows keep or lose the same words; very long texts are used whole; an empty table gives an empty result;
other columns are carried, but for names starting with `x_`, which are the operator's own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.common import partitions

LENGTH, BATCH, LEAST, BUCKET, KEPT = 20, 1 << 19, 1 << 15, 1_000_000, 60_000
LAST = (1 << 63) - 1
REST = 28  # bits of an anchor's hash beyond its bucket's
BASES = (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # of blocks, and of windows twice


class _Hashes(dict):
    """64-bit hashes of words, kept for one batch."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h


def _rolled(w, length: int, base: int):
    """A hash of each window of `length` word hashes."""
    import numpy as np

    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = w[:n].copy(), np.uint64(base)
    for k in range(1, length):
        out *= b
        out += w[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def _packed(values) -> bytes:
    """Whole numbers by byte planes, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unpacked(data: bytes, kind: str):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


ROWS = "x_bucket long, x_batch long, x_kind string, x_a binary, x_b binary, x_c binary, x_d binary"
NAMES = [f.split()[0] for f in ROWS.split(", ")]


def _table(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] if i < len(r) else b"" for r in rows], t) for i, t in enumerate(kinds)], NAMES)


def _read(table):
    """Rows of a batch in order: which row each is, its doc_id (null last) and its text."""
    texts = table.column("text").to_pylist()
    ids = [LAST if i is None else int(i) for i in table.column("doc_id").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or ""))
    return order, [ids[i] for i in order], [(texts[i] or "").encode() for i in order]


class _Batch:
    """Hashes of the words of a batch, laid end to end, and its anchors: distinct block hashes in order."""

    def __init__(self, table, block: int) -> None:
        import numpy as np

        _, self.ids, texts = _read(table)
        known, found = _Hashes(), []
        for t in texts:
            w = t.split()
            found.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
        self.lens = np.array([len(w) for w in found], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.words = np.concatenate(found) if found else np.zeros(0, np.uint64)
        del found
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.lens)  # within the document
        self.left = np.repeat(self.lens, self.lens) - self.place
        r = _rolled(self.words, block, BASES[0])
        at = np.flatnonzero(self.left[: len(r)] >= block)
        order = np.argsort(r[at], kind="stable")
        self.at, r = at[order], r[at[order]]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        self.times = np.diff(np.append(head, len(r)))
        self.hashes = r[head]
        self.is_block = np.add.reduceat((self.place[self.at] % block == 0).astype(np.int64), head) > 0 if len(r) else np.zeros(0, bool)

    def cut(self, bits: int):
        """Where each bucket's anchors begin."""
        import numpy as np

        return np.searchsorted(self.hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _anchors(bits: int, block: int) -> Callable:
    """One batch: its anchors for each bucket."""

    def run(table):
        import numpy as np

        batch = table.column("x_batch")[0].as_py()
        own = _Batch(table, block)
        cut = own.cut(bits)
        rest = ((own.hashes >> np.uint64(64 - bits - REST)) & np.uint64((1 << REST) - 1)).astype("<u4")
        rows = []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[b], cut[b + 1])
            rows.append((b, batch, "find", _packed(np.diff(rest[s], prepend=np.uint32(0))), np.packbits(own.is_block[s]).tobytes()))
        return _table(rows)

    return run


def _elsewhere(table):
    """One bucket: for each anchor of each batch, whether another batch has a block of its hash."""
    import numpy as np

    batches, a, b = (table.column(c).to_pylist() for c in ("x_batch", "x_a", "x_b"))
    bucket = table.column("x_bucket")[0].as_py()
    rest = [np.cumsum(_unpacked(x, "<u4"), dtype=np.uint32) for x in a]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(r)) for x, r in zip(b, rest, strict=True)]
    ends = np.cumsum([len(r) for r in rest])
    rest, flags = np.concatenate(rest), np.concatenate(flags).astype(np.int64)
    order = np.argsort(rest, kind="stable")
    rest = rest[order]
    at = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
    blocks = np.repeat(np.add.reduceat(flags[order], at), np.diff(np.append(at, len(rest))))
    found = np.zeros(len(rest), bool)
    found[order] = blocks > flags[order]
    return _table([(bucket, batch, "hits", np.packbits(x).tobytes()) for batch, x in zip(batches, np.split(found, ends[:-1]), strict=True)])


def _windows(bits: int, length: int, block: int) -> Callable:
    """One batch and the answers to its anchors: windows that hold a hit, by hash; and those known to be later."""

    def run(table, answers):
        import numpy as np

        if not table.num_rows:
            return _table([])
        batch = table.column("x_batch")[0].as_py()
        own = _Batch(table, block)
        cut = own.cut(bits)
        hit = own.is_block & (own.times > 1)
        for b, mask in zip(answers.column("x_bucket").to_pylist(), answers.column("x_a").to_pylist(), strict=True):
            hit[cut[b] : cut[b + 1]] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=int(cut[b + 1] - cut[b])).astype(bool)
        p = own.at[np.repeat(hit, own.times)]
        # A window holds the block from p if it starts at p - (length - block) to p, in the same document.
        mark = np.bincount(p - np.minimum(own.place[p], length - block), minlength=len(own.words) + 1) - np.bincount(p + 1, minlength=len(own.words) + 1)
        k = np.flatnonzero((np.cumsum(mark)[: len(own.words)] > 0) & (own.left >= length))
        if not len(k):
            return _table([])
        g1, g2 = (_rolled(own.words, length, base)[k] for base in BASES[1:])
        ids, starts = np.repeat(np.array(own.ids, np.int64), own.lens)[k], own.place[k]
        order = np.argsort(g1, kind="stable")  # documents are in order, so the first of each hash is the earliest
        g1, g2, ids, starts, k = g1[order], g2[order], ids[order], starts[order], k[order]
        head = np.concatenate([[True], g1[1:] != g1[:-1]])
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(g1)))
        sent = (ids == np.repeat(ids[at], n)) & (starts == np.repeat(starts[at], n))  # the earliest, and its ties by doc_id
        later = np.sort(k[~sent])
        first = np.flatnonzero(np.diff(later, prepend=-2) > 1)
        runs = np.stack([later[first], np.diff(np.append(first, len(later)))], axis=1).astype("<u4")
        rows = [(batch & ((1 << bits) - 1), batch, "later", runs.tobytes())] if len(runs) else []
        g1, g2, ids, starts, k = g1[sent], g2[sent], ids[sent], starts[sent], k[sent]
        cut = np.searchsorted(g1 >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        rest = ((g1 >> np.uint64(32 - bits)) & np.uint64((1 << 32) - 1)).astype("<u4")
        ids, places = ids.astype("<i8"), np.stack([starts, k], axis=1).astype("<u4").view("<u8").reshape(-1)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[b], cut[b + 1])
            rows.append((b, batch, "find", _packed(np.diff(rest[s], prepend=np.uint32(0))), _packed(g2[s]), _packed(ids[s]), _packed(places[s])))
        return _table(rows)

    return run


def _later(table):
    """One bucket: places of windows that start earlier in another batch."""
    import numpy as np

    out, found = [], []
    for bucket, batch, kind, a, b, c, d in zip(*(table.column(x).to_pylist() for x in NAMES), strict=True):
        if kind == "find":
            found.append((batch, np.cumsum(_unpacked(a, "<u4"), dtype=np.uint32), _unpacked(b, "<u8"), _unpacked(c, "<i8"), _unpacked(d, "<u8").view("<u4").reshape(-1, 2)))
        else:
            out.append((bucket, batch, kind, a))
    if found:
        rest, g2, ids = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
        start, place = np.concatenate([x[4] for x in found]).T
        who = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
        order = np.lexsort((start, ids, g2, rest))
        rest, g2, ids, start, place, who = (x[order] for x in (rest, g2, ids, start, place, who))
        at = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (g2[1:] != g2[:-1])]))
        n = np.diff(np.append(at, len(rest)))
        late = np.flatnonzero((ids != np.repeat(ids[at], n)) | (start != np.repeat(start[at], n)))
        late = late[np.argsort(who[late], kind="stable")]
        for k, x in zip(*np.unique(who[late], return_index=True), strict=True):
            own = np.sort(place[late[x:][who[late[x:]] == k]])
            out.append((0, found[k][0], "places", _packed(np.diff(own, prepend=np.uint32(0)).astype("<u4"))))
    return _table(out)


def _finished(length: int, own: list[str], made: list[T.StructField], finish: Callable) -> Callable:
    """One batch and what is known of its windows: its rows with the columns made."""

    def run(table, answers):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        order, _, texts = _read(table)
        split = [t.split() for t in texts]
        ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        mark = np.zeros((int(ends[-1]) if len(ends) else 0) + 1, np.int64)
        for kind, a in zip(answers.column("x_kind").to_pylist(), answers.column("x_a").to_pylist(), strict=True):
            if kind == "later":
                runs = np.frombuffer(a, "<u4").reshape(-1, 2).astype(np.int64)
                begin, end = runs[:, 0], runs.sum(axis=1) + length - 1
            else:
                begin = np.cumsum(_unpacked(a, "<u4"), dtype=np.int64)
                end = begin + length
            np.add.at(mark, begin, 1)
            np.add.at(mark, end, -1)
        gone = np.split(np.cumsum(mark)[:-1] > 0, ends[:-1])
        values: list = [None] * len(order)
        for row, text, words, lost in zip(order, texts, split, gone, strict=False):
            values[row] = finish(text, words, lost)
        out = table.select(own)
        for i, f in enumerate(made):
            out = out.append_column(f.name, pa.array([v[i] for v in values], to_arrow_type(f.dataType)))
        return out

    return run


def _free(name: str, columns: list[str]) -> str:
    """name, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def removed(docs: DataFrame, finish: Callable, made: list[T.StructField], length: int = LENGTH, batch_words: int = BATCH, bucket_words: int = BUCKET) -> DataFrame:
    """docs with the columns `made`: finish(text, its words, which of them are removed) of each row gives their values.

    A made column takes the place of one of its name; all others are carried, whatever their names."""
    clash = [c for c in docs.columns if c.lower() == "x_batch"]
    if clash:
        hidden = _free("x_carried", [*docs.columns, *(f.name for f in made)])
        out = removed(docs.withColumnRenamed(clash[0], hidden), finish, made, length, batch_words, bucket_words)
        return out.withColumnRenamed(hidden, clash[0])
    block = length // 2
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    # Small tables have smaller batches, so that all tasks have some.
    batches = max(1, math.ceil(words / batch_words), min(4 * partitions(docs.sparkSession), int(words / LEAST)))
    bits = max(1, min(30, math.ceil(math.log2(max(2, words / bucket_words)))))
    own = [c for c in docs.columns if c not in {f.name for f in made}]
    # Repeated rows are spread by the partition they come from.
    dealt = docs.withColumn("x_batch", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches)))
    by_batch = dealt.groupBy("x_batch")
    found = by_batch.applyInArrow(_anchors(bits, block), ROWS)
    hits = found.groupBy("x_bucket").applyInArrow(_elsewhere, ROWS)
    windows = by_batch.cogroup(hits.groupBy("x_batch")).applyInArrow(_windows(bits, length, block), ROWS)
    late = windows.groupBy("x_bucket").applyInArrow(_later, ROWS)
    schema = T.StructType([*(docs.schema[c] for c in own), *made])
    return by_batch.cogroup(late.groupBy("x_batch")).applyInArrow(_finished(length, own, made, finish), schema)


def _rest(text: bytes, words: list[bytes], gone) -> tuple:
    """The text without the removed words (null where nothing is removed)."""
    return (b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode() if gone.any() else None,)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, their texts without repeated stretches (what is left of a changed text is joined by spaces)."""
    rest = _free("x_rest", docs.columns)
    out = removed(docs, _rest, [T.StructField(rest, T.StringType())], length)
    return out.withColumn("text", F.coalesce(rest, "text")).select(*docs.columns)


def _digest(text: bytes, words: list[bytes], gone) -> tuple:
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return removed(docs, _digest, made).select("doc_id", "n_words", "n_removed", "kept_sha256")
