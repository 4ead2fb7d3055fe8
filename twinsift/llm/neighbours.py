"""Approximate nearest neighbours (operator 1): a hierarchical k-means tree, searched best bin first.

The tree is fitted on at most `SAMPLE` rows (in the order of a hash of their ids), the same bound for any
table; every row is then put into its leaf. A query walks the tree through a priority queue of nodes by
distance to their centres, which gives it the leaves in the order it would visit them. How many it visits
is calibrated: for at most `PROBES` queries the exact neighbours are found by brute force over all rows,
and the number of leaf visits is widened until the share of those neighbours in the visited leaves (the
recall) reaches `RECALL`. Then all queries visit that many leaves; if need be all of them, which is exact.

A query also carries a bound: its k-th distance to the sample rows of the first leaves it visits. Those are
candidates too, so nothing farther can be among its k nearest, and leaves answer with nearer rows only.

Leaves meet queries by an equality join of blocks: a leaf's rows and a leaf's queries are cut into blocks
of about `BLOCK` by a hash, so a crowded leaf is many small tasks. Distances are Euclidean, in double
precision, on the original vectors.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components, vectors of another
length than most, and rows without id take no part; equal distances go by the smaller id; rows that repeat
an id are candidates each, but not for the query of that id, whose vector is then the least of them; fewer
than k candidates give as many; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import stored

K, SAMPLE, BRANCHES, LEAF, PROBES, RECALL, BLOCK = 10, 32_768, 12, 32, 256, 0.97, 4096


def usable(vector: Column) -> Column:
    """Not null, not zero, only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """Nodes: centres (an array of the children's centres) and children (numbers); leaves have a leaf number."""

    def __init__(self, ids, sample, branches: int = BRANCHES, leaf: int = LEAF) -> None:
        import numpy as np

        self.centres, self.children, self.leaf, self.leaves = [], [], [], 0
        self.random = np.random.default_rng(1)
        self.grow(np.asarray(sample, dtype=np.float64), branches, leaf)
        # The sample by leaf, for bounds.
        self.rows, self.ids = np.asarray(sample, dtype=np.float64), np.asarray(ids, dtype=np.int64)
        at = self.place(self.rows)
        order = np.argsort(at, kind="stable")
        self.rows, self.ids, self.cut = self.rows[order], self.ids[order], np.searchsorted(at[order], np.arange(self.leaves + 1))

    def bound(self, query_id: int, query, leaves: list[int], k: int, most: int = 4096) -> float:
        """The k-th distance to sample rows of the first leaves, infinite if they are too few."""
        import numpy as np

        parts, n = [], 0
        for leaf in leaves:
            parts.append(np.arange(self.cut[leaf], self.cut[leaf + 1]))
            n += len(parts[-1])
            if n >= most:
                break
        at = np.concatenate(parts)
        at = at[self.ids[at] != query_id]
        if len(at) < k:
            return float("inf")
        d = np.sqrt(((self.rows[at] - query) ** 2).sum(axis=1))
        return float(np.partition(d, k - 1)[k - 1]) * (1 + 1e-12)

    def grow(self, rows, branches: int, leaf: int) -> int:
        import numpy as np

        me = len(self.centres)
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        if len(rows) > leaf:
            centres = rows[self.random.choice(len(rows), branches, replace=False)]
            for _ in range(8):
                near = nearest(rows, centres)
                centres = np.stack([rows[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
            near = nearest(rows, centres)
            used = np.unique(near)
            if len(used) > 1:
                self.centres[me] = centres[used]
                self.children[me] = [self.grow(rows[near == c], branches, leaf) for c in used]
                return me
        self.leaf[me] = self.leaves
        self.leaves += 1
        return me

    def place(self, rows):
        """The leaf of each row."""
        import numpy as np

        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            near = nearest(rows[at], self.centres[node])
            todo += [(child, at[near == c]) for c, child in enumerate(self.children[node]) if (near == c).any()]
        return out

    def visits(self, query) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            d = ((self.centres[node] - query) ** 2).sum(axis=1)
            for x, child in zip(d.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (x, child))


def nearest(rows, centres):
    import numpy as np

    out = np.zeros(len(rows), np.int64)
    norms = (centres**2).sum(axis=1)
    for i in range(0, len(rows), 8192):
        out[i : i + 8192] = (norms - 2 * rows[i : i + 8192] @ centres.T).argmin(axis=1)
    return out


def matrix(column):
    """An Arrow list column without nulls as a float64 matrix."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)


def closest(queries, query_ids, rows, ids, k: int, bounds=None):
    """For each query the k nearest rows of a block within its bound, ties by id: lists (query, row, distance)."""
    import numpy as np

    found = []
    norms = (rows**2).sum(axis=1)
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        rough = norms + (q**2).sum(axis=1)[:, None] - 2 * q @ rows.T
        rough[query_ids[i : i + 256, None] == ids[None, :]] = np.inf
        bound = np.partition(rough, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        # Rounding moves the rough values by less than this; the exact distances decide.
        bound = bound + 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)) + norms.max())
        for j in range(len(q)):
            at = np.flatnonzero((rough[j] <= bound[j]) & np.isfinite(rough[j]))
            exact = np.sqrt(((rows[at] - q[j]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], exact))[:k]
            if bounds is not None:
                best = best[exact[best] <= bounds[i + j]]
            found += [(i + j, int(at[b]), float(exact[b])) for b in best]
    return found


FOUND = "query_id long, vec_id long, score double"


def _table(found, query_ids, ids):
    import pyarrow as pa

    return pa.table({"query_id": pa.array([int(query_ids[q]) for q, _, _ in found], pa.int64()), "vec_id": pa.array([int(ids[r]) for _, r, _ in found], pa.int64()), "score": pa.array([s for _, _, s in found], pa.float64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute(rows: DataFrame, probes: list, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of (id, vector), over all rows (vec_id, embedding)."""
    import numpy as np

    ids, vectors = np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.float64)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            if len(b):
                own = b.column(0).to_numpy(zero_copy_only=False)
                yield from _table(closest(vectors, ids, matrix(b.column(1)), own, k), ids, own).to_batches()

    return _best(rows.select("vec_id", "embedding").mapInArrow(run, FOUND), k)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, recall: float = RECALL, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest of the visited leaves. Both: vec_id, embedding."""
    spark = vectors.sparkSession
    tidy = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, asked = tidy(vectors), tidy(queries)
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most is None:
        return empty
    rows, asked = (x.where(F.size("embedding") == most["d"]) for x in (rows, asked))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    by_hash = [F.xxhash64("vec_id"), F.col("vec_id")]
    fitted = rows.orderBy(*by_hash).limit(sample).collect()  # the bounded sample
    tree = Tree([r["vec_id"] for r in fitted], [r["embedding"] for r in fitted])
    del fitted
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def placed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            leaf = shared.value.place(matrix(b.column(1))) if len(b) else np.zeros(0, np.int64)
            yield b.append_column("leaf", pa.array(leaf, pa.int64()))

    index = stored(rows.mapInArrow(placed, "vec_id long, embedding array<double>, leaf long"), "index")

    # Calibration: at which visit does each exact neighbour's leaf come?
    tried = [(r["vec_id"], r["embedding"]) for r in asked.orderBy(*by_hash).limit(probes).collect()]
    if not tried:
        return empty
    true = brute(rows, tried, k)
    leaf_of = index.select(F.col("vec_id").alias("i"), "leaf").groupBy("i").agg(F.min("leaf").alias("leaf"))
    where = true.join(leaf_of, F.col("vec_id") == F.col("i")).select("query_id", "leaf").collect()  # probes * k rows
    order = {q: {leaf: n for n, leaf in enumerate(tree.visits(v))} for q, v in tried}
    at = [order[r["query_id"]][r["leaf"]] for r in where]
    visits = 1
    while visits < tree.leaves and sum(a < visits for a in at) < recall * len(at):
        visits = min(tree.leaves, visits + max(1, visits // 4))

    def walked(batches: Iterator) -> Iterator:
        import itertools

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                asked_ids, vectors_ = part.column(0).to_pylist(), matrix(part.column(1))
                leaves = [list(itertools.islice(shared.value.visits(v), visits)) for v in vectors_]
                far = [shared.value.bound(q, v, x, k) for q, v, x in zip(asked_ids, vectors_, leaves, strict=True)]
                n = np.repeat(np.arange(len(part)), [len(x) for x in leaves])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(n)) for c in (0, 1)), pa.array(list(itertools.chain(*leaves)), pa.int64()), pa.array(np.array(far)[n], pa.float64())], ["vec_id", "embedding", "leaf", "far"])

    visited = stored(asked.mapInArrow(walked, "vec_id long, embedding array<double>, leaf long, far double"), "visits")
    # Blocks by leaf: at most one row a leaf, and the number of leaves is bounded by the sample.
    n_rows = {r["leaf"]: -(-r["count"] // block) for r in index.groupBy("leaf").count().collect()}
    n_asked = {r["leaf"]: -(-r["count"] // block) for r in visited.groupBy("leaf").count().collect()}
    sizes = spark.createDataFrame([(leaf, n_rows[leaf], n_asked[leaf]) for leaf in n_rows if leaf in n_asked], "leaf long, n_rows long, n_asked long")
    own = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = visited.join(F.broadcast(sizes), "leaf").withColumn("qb", own("n_asked")).select("leaf", "qb", every("n_rows").alias("rb"), "vec_id", "embedding", "far")
    right = index.join(F.broadcast(sizes), "leaf").withColumn("rb", own("n_rows")).select("leaf", every("n_asked").alias("qb"), "rb", "vec_id", "embedding")

    def meet(asked_, rows_):
        if not len(asked_) or not len(rows_):
            return _table([], [], [])
        query_ids, ids = (x.column("vec_id").to_numpy() for x in (asked_, rows_))
        return _table(closest(matrix(asked_.column("embedding")), query_ids, matrix(rows_.column("embedding")), ids, k, asked_.column("far").to_numpy()), query_ids, ids)

    met = left.groupBy("leaf", "qb", "rb").cogroup(right.groupBy("leaf", "qb", "rb")).applyInArrow(meet, FOUND)
    return _best(met, k)




def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
