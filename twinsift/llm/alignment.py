"""Alignment of two tokenizers' ids over the same bytes, by distinct segments (operator 11).

A is a byte-level vocabulary over a space and the text, B a SentencePiece model over the text (it puts the space there
itself). Texts are cut before runs of white space across which neither vocabulary can merge; that is verified from
the pieces of both, and A's words never reach across the start of such a run. So tokens, groups and links of a text are those
of its segments, one after the other:

1. documents become blocks: a dictionary of segments and the numbers of the segments in order, written once. Each
   dictionary is dealt out to buckets by the segments' hash, a row for each bucket;
2. in a bucket the distinct segments of all blocks are tokenised and aligned once. Groups end where tokens of A and B both
   end; the last tokens of a group are its link, as they are the two whose byte ranges end together;
3. links are counted by id pair, weighted with how often their segment occurs: in the bucket first, then over all. The
   counts are joined back to the buckets, where each segment gets the number of its links that are the best of
   their B id, and the sum of their counts;
4. the alignments are joined back to the blocks, and the documents of a block are composed from them.

Bounds: a block holds about `BLOCK` characters (at least one document), and there is a bucket for each `BUCKET` bytes of
text, so the distinct segments that meet in one do not grow; a segment has at most one entry for each block, an id
pair at most one for each bucket, so common ones are no hot keys. Nothing is collected or broadcast but the size of the input.

Result: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`: ids of A and B).

Defined cases: null and empty texts, and texts whose bytes either tokenizer changes (U+2581 is a space to B) have no
tokens: zeros, an empty string, and no part in the counts; special tokens' strings are plain text; repeated rows and equal
or null doc_ids give a row each and count each; very long texts are one block (without white space one segment); ties
between the best pairs of a B id all count; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import sentencepieces
from twinsift.llm.common import stored, table
from twinsift.llm.segments import Cutter, splitters
from twinsift.llm.tokens import BYTES, vocabulary_path

A, B = "byte_bpe_50k.json", sentencepieces.VOCABULARY
BLOCK, BUCKET, JOINED = 1 << 22, 1 << 23, 1 << 16


class Both:
    """Both vocabularies, and how texts are cut for them."""

    def __init__(self, a: str, b: str) -> None:
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepieces.model(b)
        self.a.encode_special_tokens = True
        described = json.loads(self.a.to_str())
        before = described.get("pre_tokenizer") or {}
        if described.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("the first vocabulary must be byte-level, with its words cut by the usual pattern and nothing changed")
        back = {chr(c): b for b, c in BYTES.items()}
        byte = lambda name: bytes(back.get(c, ord(c)) for c in name)
        names = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = byte(name)
        if len({x for x in self.bytes_a if len(x) == 1}) != 256:
            raise ValueError("the first vocabulary lacks bytes")
        self.sizes_a = np.array(list(map(len, self.bytes_a)), np.int64)
        plain = [x.decode(errors="replace") for i, x in enumerate(self.b.bytes) if i not in self.b.special]
        self.splitters = splitters([x.decode(errors="replace") for x in self.bytes_a] + plain)
        self.cut = Cutter(self.splitters)

    def segments(self, text: str | None) -> list[str]:
        """The segments of a space and the text; none where B changes the text."""
        mark, normalise = sentencepieces.SPACE, self.b.normalise
        if not text or mark in text or not (normalise.plain or normalise(text)[0].replace(mark, " ") == " " + text):
            return []
        return self.cut(" " + text)

    def of_a(self, segments: list[str]) -> list[list[int]]:
        """A's ids of segments. Those that start with a splitter and end otherwise are laid end to end: A cuts there as well."""
        import numpy as np

        out: list = [None] * len(segments)
        line, size = [], 0

        def put() -> None:
            ids = self.a.encode("".join(segments[i] for i in line), add_special_tokens=False).ids
            ends = np.cumsum(self.sizes_a[np.array(ids, np.int64)])
            stops = np.searchsorted(ends, np.cumsum([len(segments[i].encode()) for i in line])) + 1
            at = 0
            for i, stop in zip(line, stops.tolist(), strict=True):
                out[i], at = ids[at:stop], stop

        for i, segment in enumerate(segments):
            if segment[0] in self.splitters and not segment[-1].isspace():
                line.append(i)
                size += len(segment)
                if size >= JOINED:
                    put()
                    line, size = [], 0
            else:
                out[i] = self.a.encode(segment, add_special_tokens=False).ids
        if line:
            put()
        return out

    def align(self, segments: list[str]):
        """For each segment: tokens of A, of B, groups as text; then the links' ids and the number of links of each."""
        import numpy as np

        mark = sentencepieces.SPACE
        of_a = self.of_a(segments)
        of_b = self.b.merging.encode([s.replace(" ", mark) for s in segments], num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        ids_a, ids_b = (np.fromiter((i for x in y for i in x), np.int64) for y in (of_a, of_b))
        whole = "".join(segments).encode()
        for ids, by in ((ids_a, self.bytes_a), (ids_b, self.b.bytes)):
            if b"".join(map(by.__getitem__, ids.tolist())) != whole:
                raise RuntimeError("a tokenizer changed the bytes of a text that it should keep")
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.b.sizes[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        n = np.diff(np.searchsorted(common, ends_a[np.cumsum(n_a) - 1], side="right"), prepend=0)
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, a, b = [], 0, 0
        for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            groups.append((names_a[a] if x == a + 1 else ",".join(names_a[a:x])) + "|" + (names_b[b] if y == b + 1 else ",".join(names_b[b:y])))
            a, b = x, y
        texts, at = [], 0
        for k in n.tolist():
            texts.append(";".join(groups[at : at + k]))
            at += k
        return n_a, n_b, texts, ids_a[at_a], ids_b[at_b], n


_both: dict[tuple[str, str], Both] = {}


def both(a: str, b: str) -> Both:
    """One for each Python worker, kept between tasks."""
    if (a, b) not in _both:
        _both[a, b] = Both(a, b)
    return _both[a, b]


BLOCKS = "block long, doc_ids array<long>, sizes array<int>, ids binary, bucket int, at binary, segments array<string>, counts binary"
MET = "bucket int, block long, at binary, codes binary, n_a binary, n_b binary, n binary, links binary, groups binary, pair int, a int, b int, count long"
ANSWERS = "block long, at binary, numbers binary, sums binary, groups binary"
COMPOSED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _schema(kind: str):
    """The Arrow schema of a list of names and types as above."""
    import pyarrow as pa

    known = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], known[f.split()[1]]) for f in kind.split(", ")])


def _batch(schema, rows: int, **columns):
    """A batch with the columns given; the others are null."""
    import pyarrow as pa

    held = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([held(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _blocks(docs: DataFrame, a: str, b: str, size: int, buckets: int) -> DataFrame:
    """Rows of two kinds: a block's documents, and the part of its dictionary in one bucket."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        from pyspark import TaskContext

        own, schema, number, begun, total = both(a, b), _schema(BLOCKS), TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator:
            slots: dict[str, int] = {}
            sizes, ids = [], []
            for _, text in begun:
                parts = own.segments(text)
                sizes.append(len(parts))
                ids.extend([slots.setdefault(p, len(slots)) for p in parts])
            ids = np.array(ids, np.int32)
            yield _batch(schema, 1, block=[number], doc_ids=[[d for d, _ in begun]], sizes=[sizes], ids=[_packed(ids.tobytes())])
            if not slots:
                return
            counts, found = np.bincount(ids, minlength=len(slots)), list(slots)
            of = np.fromiter((zlib.crc32(p.encode()) for p in found), np.int64, len(found)) % buckets
            order = np.argsort(of, kind="stable")
            stops = np.append(np.flatnonzero(np.diff(of[order])) + 1, len(order)).tolist()
            start = 0
            for stop in stops:
                part = order[start:stop]
                start = stop
                yield _batch(schema, 1, block=[number], bucket=[int(of[part[0]])], at=[_packed(np.diff(part, prepend=0).astype(np.int32).tobytes())], segments=[[found[i] for i in part.tolist()]], counts=[_packed(counts[part].astype(np.int64).tobytes())])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begun.append((doc_id, text.as_py()))
                # An empty text has its share too, so that a block has a bounded number of documents.
                total += len(begun[-1][1] or "") + 64
                if total >= size:
                    yield from flush()
                    number, begun, total = number + 1, [], 0
        if begun:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def _met(dictionaries: DataFrame, a: str, b: str) -> DataFrame:
    """By bucket: the alignments of its segments, which of them each block has, and how often ids are linked in it."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        own, schema = both(a, b), _schema(MET)
        bucket = [table.column("bucket")[0].as_py()]
        lists = table.column("segments").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        codes, segments = coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_pylist()
        weights = np.frombuffer(b"".join(map(_unpacked, table.column("counts").to_pylist())), np.int64)
        times = np.zeros(len(segments), np.int64)
        np.add.at(times, codes, weights)
        n_a, n_b, texts, link_a, link_b, n = own.align(segments)
        pairs, links = np.unique(link_a << 32 | link_b, return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, links, np.repeat(times, n))
        out = [_batch(schema, 1, bucket=bucket, **{c: [_packed(x.astype(np.int32).tobytes())] for c, x in (("n_a", n_a), ("n_b", n_b), ("n", n), ("links", links))}, groups=[_packed("\n".join(texts).encode())])]
        stops = np.cumsum(lists.value_lengths().to_numpy())
        of = [_packed(codes[stop - k : stop].tobytes()) for stop, k in zip(stops.tolist(), lists.value_lengths().to_pylist(), strict=True)]
        out.append(_batch(schema, len(of), bucket=bucket * len(of), block=table.column("block").to_pylist(), at=table.column("at").to_pylist(), codes=of))
        out.append(_batch(schema, len(pairs), bucket=bucket * len(pairs), pair=np.arange(len(pairs)), a=pairs >> 32, b=pairs & 0xFFFFFFFF, count=count))
        return pa.Table.from_batches(out)

    return dictionaries.select("bucket", "block", "at", "segments", "counts").groupBy("bucket").applyInArrow(run, MET)


def pair_counts(met: DataFrame) -> DataFrame:
    """(a, b, count, best) of id pairs that are linked: in how many links of the corpus, and whether no other pair of b has more."""
    pairs = met.groupBy("a", "b").agg(F.sum("count").alias("count"))
    highest = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _answers(key, met, rated):
    """The alignments of a bucket's segments with their links' counts, for each of its blocks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    order = np.argsort(rated.column("pair").to_numpy())
    best, count = (rated.column(c).to_numpy()[order].astype(np.int64) for c in ("best", "count"))
    of = met.filter(pc.is_valid(met.column("n")))
    n_a, n_b, n, links = (np.frombuffer(_unpacked(of.column(c)[0].as_py()), np.int32) for c in ("n_a", "n_b", "n", "links"))
    upto = np.append(0, np.cumsum(n))
    sums = [np.diff(np.append(0, np.cumsum(x[links]))[upto]) for x in (best, count)]
    numbers, sums = np.stack([n_a, n_b, n]).astype(np.int32), np.stack(sums).astype(np.int64)
    groups, schema, out = _unpacked(of.column("groups")[0].as_py()).split(b"\n"), _schema(ANSWERS), []
    for row in met.filter(pc.is_valid(met.column("block"))).select(["block", "at", "codes"]).to_pylist():
        codes = np.frombuffer(_unpacked(row["codes"]), np.int32)
        held = _packed(b"\n".join([groups[i] for i in codes.tolist()]))
        out.append(_batch(schema, 1, block=[row["block"]], at=[row["at"]], numbers=[_packed(numbers[:, codes].tobytes())], sums=[_packed(sums[:, codes].tobytes())], groups=[held]))
    return pa.Table.from_batches(out, schema)


def _composed(key, blocks, parts):
    """The documents of one block from the alignments of its segments."""
    import numpy as np
    import pyarrow as pa

    at = [np.cumsum(np.frombuffer(_unpacked(x), np.int32)) for x in parts.column("at").to_pylist()]
    size = sum(map(len, at))
    numbers, texts = np.zeros((5, size), np.int64), np.empty(size, object)
    for where, some, sums, groups in zip(at, *(parts.column(c).to_pylist() for c in ("numbers", "sums", "groups")), strict=True):
        numbers[:3, where] = np.frombuffer(_unpacked(some), np.int32).reshape(3, -1)
        numbers[3:, where] = np.frombuffer(_unpacked(sums), np.int64).reshape(2, -1)
        texts[where] = _unpacked(groups).decode().split("\n")
    texts, rows = texts.tolist(), []
    for doc_ids, sizes, ids in zip(*(blocks.column(c).to_pylist() for c in ("doc_ids", "sizes", "ids")), strict=True):
        ids, at = np.frombuffer(_unpacked(ids), np.int32), 0
        upto = [np.append(0, np.cumsum(x[ids])) for x in numbers]
        for doc_id, n in zip(doc_ids, sizes, strict=True):
            a, b, groups, best, total = (int(u[at + n] - u[at]) for u in upto)
            rows.append((doc_id, a, b, groups, groups, best, total, ";".join([texts[i] for i in ids[at : at + n].tolist()])))
            at += n
    schema = _schema(COMPOSED)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def align(docs: DataFrame, a: str = A, b: str = B, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of docs (doc_id, text)."""
    a, b, spark = vocabulary_path(a), vocabulary_path(b), docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = stored(_blocks(docs, a, b, block, max(1, -(-size // bucket))), "blocks")
    met = stored(_met(blocks.where("bucket is not null"), a, b), "aligned")
    again = lambda df: spark.read.schema(df.schema).parquet(df.kept_at)
    linked = met.where("pair is not null").select("bucket", "pair", "a", "b", "count")
    rated = linked.drop("count").join(pair_counts(linked), ["a", "b"]).select("bucket", "pair", "count", "best")
    aligned = again(met).where("pair is null").select("bucket", "block", "at", "codes", "n_a", "n_b", "n", "links", "groups")
    answers = aligned.groupBy("bucket").cogroup(rated.groupBy("bucket")).applyInArrow(_answers, ANSWERS)
    of_blocks = again(blocks).where("bucket is null").select("block", "doc_ids", "sizes", "ids")
    return of_blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_composed, COMPOSED)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
