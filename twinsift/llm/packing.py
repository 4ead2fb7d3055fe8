"""Packing (operator 6): token sequences of at most `window`, in document order, by dynamic programming.

Documents are sorted by doc_id over all partitions, turned into ids and laid end to end. Cuts may fall at
document ends (free), sentence ends (a small penalty) and, only inside sentences longer than a window, at
every `HARD_STEP` ids (a larger one). The cuts of a stretch minimise padding plus penalties: the best cost
up to a cut is window - cut + penalty plus the least of (cost + place) over the cuts within a window
before it, kept by a monotone queue; sequences whose length is a power of two (256 at least) need no
padding, only a small price for being short, and are looked up beside it. A stretch is about `stretch` ids; its last sequence is left to the next one, so only
a partition's last sequence may end early. Nothing but the rows of a partition is brought together.

Result: one row a piece (a document's ids in one sequence): doc_id, start, length, ids_crc32, doc_tokens,
sequence_id (partition and number, ascending with doc_id), offset, ids (binary, little-endian 32-bit).

Defined cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids and
repeated rows follow each other, each packed on its own; a document longer than a window becomes several
pieces; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.common import partitions
from twinsift.llm.tokens import parts, pieces, vocabulary_path

WINDOW, STRETCH, HARD_STEP = 2048, 1 << 20, 32
SENTENCE, HARD, SHORT = 4.0, 64.0, 1 / 64
ENDS = (".", "!", "?", '."', '!"', '?"', ".)", "…")


def cuts(places: list[int], penalties: list[float], window: int) -> list[int]:
    """Indices of the chosen cuts (the first, place 0, left out; the last is always chosen).

    places ascend from 0 and no two neighbours are more than a window apart.
    """
    m = len(places)
    at = {p: i for i, p in enumerate(places)}
    powers = [1 << k for k in range(8, window.bit_length()) if 1 << k < window]
    cost, back, queue = [0.0] * m, [0] * m, deque()
    key = [0.0] * m  # cost + place
    for j in range(1, m):
        i, p = j - 1, places[j]
        while queue and key[queue[-1]] >= key[i]:
            queue.pop()
        queue.append(i)
        while p - places[queue[0]] > window:
            queue.popleft()
        best = queue[0]
        value = key[best] + window - p
        for power in powers:
            k = at.get(p - power)
            if k is not None and cost[k] + (window - power) * SHORT < value:
                best, value = k, cost[k] + (window - power) * SHORT
        cost[j], back[j] = value + penalties[j], best
        key[j] = cost[j] + p
    chosen, j = [], m - 1
    while j:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


def _with_bounds(texts, kept, end: bytes) -> Iterator:
    """Of each text of an Arrow array: its ids with the end id, and its sentence ends (in ids; the document's end left out)."""
    import numpy as np

    ids, ends, codes, names, first = kept.of_all(texts)
    upto = np.concatenate([[0], ends])
    at, bits = upto[first].tolist(), memoryview(ids.tobytes())
    stops = np.flatnonzero(np.fromiter((w.endswith(ENDS) for w in names), bool, len(names))[codes])
    places, own = ends[stops], np.searchsorted(stops, first).tolist()
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        bounds = np.unique(places[own[i] : own[i + 1]] - a)
        yield bytes(bits[4 * a : 4 * b]) + end, bounds[(bounds > 0) & (bounds < b - a)]


class _Stretch:
    """Documents laid end to end; what the last flush left over stays."""

    def __init__(self, window: int, sequence: int) -> None:
        self.window, self.sequence = window, sequence
        self.docs, self.size = [], 0  # docs: [doc_id, ids, start of these ids in the document, bounds, ids of the document]

    def add(self, doc_id, ids: bytes, bounds) -> None:
        self.docs.append((doc_id, ids, 0, bounds, len(ids) // 4))
        self.size += len(ids) // 4

    def flush(self, last: bool) -> list[tuple]:
        import numpy as np

        if not self.docs:
            return []
        places, penalties, at = [0], [0.0], 0
        for _, ids, start, bounds, _ in self.docs:
            n = len(ids) // 4
            own = [*(b for b in (bounds - start).tolist() if 0 < b < n), n]
            before = 0
            for b in own:
                if b - before > self.window:
                    hard = range(before + HARD_STEP, b, HARD_STEP)
                    places.extend(at + h for h in hard)
                    penalties.extend([HARD] * len(hard))
                places.append(at + b)
                penalties.append(SENTENCE)
                before = b
            penalties[-1] = 0.0
            at += n
        chosen = [places[j] for j in cuts(places, penalties, self.window)]
        if not last and len(chosen) > 1:
            chosen.pop()
        out, k, room_from = [], 0, 0
        at, left = 0, []
        for doc_id, ids, start, bounds, total in self.docs:
            n, a = len(ids) // 4, 0
            while a < n and k < len(chosen):
                b = min(n, chosen[k] - at)
                part = ids[4 * a : 4 * b]
                out.append((doc_id, start + a, b - a, zlib.crc32(part), total, self.sequence + k, at + a - room_from, part))
                a = b
                if at + b == chosen[k]:
                    room_from = chosen[k]
                    k += 1
            if a < n:
                left.append((doc_id, ids[4 * a :], start + a, bounds, total))
            at += n
        self.sequence += len(chosen)
        self.docs, self.size = left, sum(len(x[1]) // 4 for x in left)
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = 1, stretch: int = STRETCH) -> DataFrame:
    file = vocabulary_path(vocabulary) if vocabulary else vocabulary_path()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        kept, end = pieces(file), np.array([end_id], "<u4").tobytes()
        laid = _Stretch(window, TaskContext.get().partitionId() << 40)
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.binary()]

        def rows(out: list[tuple]) -> Iterator:
            for i in range(0, len(out), 5000):
                part = out[i : i + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate(kinds)], names)

        for batch in batches:
            for part in parts(batch):
                for doc_id, (ids, bounds) in zip(part.column(0).to_pylist(), _with_bounds(part.column(1), kept, end), strict=True):
                    laid.add(doc_id, ids, bounds)
                    if laid.size >= stretch:
                        yield from rows(laid.flush(False))
        yield from rows(laid.flush(True))

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return ordered.mapInArrow(run, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("ids")
