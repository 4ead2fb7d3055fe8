"""Token-id files (operator 4): whole texts as ids, in ascending doc_id order, coded in blocks.

write() sorts the documents over all partitions, turns each text into ids with an end id, and writes a
table of blocks (Parquet rows: part, block, the ids before it in its part, the documents it holds and
the coded bytes, see idcoder). A block holds whole documents, is coded from an empty model and has its
own checksums, so blocks can be read, checked and coded anew alone. Spark's writer commits the files:
a lost executor costs its tasks only. read() decodes the blocks and gives each document its place in
the whole; of all data only the number of ids in each part is brought together.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids follow
each other in the order of their texts' hashes, repeated rows one after the other; an empty table gives
a table without blocks; other columns are not stored. A very long text makes a larger block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import fresh_path, partitions
from twinsift.llm.tokens import parts, pieces, vocabulary_path

BLOCK_IDS, VOCABULARY_SIZE = 1 << 21, 49_408
BLOCKS = "part int, block int, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, coded binary"


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS, vocabulary_size: int = VOCABULARY_SIZE) -> None:
    file = vocabulary_path(vocabulary) if vocabulary else vocabulary_path()

    def coded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from twinsift.llm import idcoder

        of_all, end = pieces(file).of_all, np.array([end_id], "<u4").tobytes()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, size = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([before], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())), "coded": pa.array([idcoder.encode(ids, vocabulary_size)], pa.binary()),
                }
            )

        for batch in batches:
            for some in parts(batch):
                all_ids, ends, _, _, first = of_all(some.column(1))
                at, bits = np.concatenate([[0], ends])[first].tolist(), memoryview(all_ids.tobytes())
                for i, doc_id in enumerate(some.column(0).to_pylist()):
                    held += [bytes(bits[4 * at[i] : 4 * at[i + 1]]), end]
                    doc_ids.append(doc_id)
                    lengths.append(at[i + 1] - at[i] + 1)
                    size += lengths[-1]
                    if size >= block_ids:
                        yield row()
                        block, before = block + 1, before + size
                        doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield row()

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(coded, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian 32-bit) of each document."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row a part: the ids before it.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p_before"))

    def decoded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from twinsift.llm import idcoder

        for batch in batches:
            for part, before, doc_ids, lengths, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                ids = memoryview(idcoder.decode(data.as_py()).tobytes())
                n = np.array(lengths.as_py(), dtype=np.int64)
                at = np.cumsum(n) - n
                bits = [bytes(ids[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part.as_py()] * len(n), pa.int32()), "doc_id": doc_ids.values, "at": pa.array(at + before.as_py()), "n_tokens": pa.array(n),
                        "ids_crc32": pa.array([zlib.crc32(b) for b in bits], pa.int64()), "ids": pa.array(bits, pa.binary()),
                    }
                )

    docs = blocks.select("part", "before", "doc_ids", "lengths", "coded").mapInArrow(decoded, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("at") + F.col("p_before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-file")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read(spark, path).drop("ids")
