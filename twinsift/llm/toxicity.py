"""Toxicity (operator 2): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings and endings. The vocabulary is the `TERMS` terms whose presence tells
most about the label (chi-square) in the fitted sample, at most `EXAMPLES` labelled documents (in the order
of a hash of their ids); their document frequencies are counted over all documents. The examples' unit
vectors are stored by term, in blocks of `BLOCK` examples with each block's largest weight. A document's
bounds for all blocks are one product of its weights with those; blocks are read by falling bound, and the
rest only if their bound reaches the k-th best cosine found: the k nearest are exact.

The votes of the nearest, weighted by closeness, are turned into a chance by monotone (isotonic) regression
on the examples themselves, each judged by all others. Documents without any term get the toxic share of
the examples without any. Evidence: the nearest examples' doc_ids.

Defined cases: null and empty texts have no terms (and so the score of such examples); labels without
doc_id or label are left out, of contradictory labels the larger counts, of several documents with a
labelled id the least text; without any labelled example every score is 0; ties among examples go by
their place in the sample; repeated rows are scored alike; very long texts are used whole; an empty table
gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES, TERMS, LEAST, CHI, K, BLOCK = 8192, 2048, 4, 20.0, 24, 64
FRONTS, BACKS, STRIP = (4, 5, 6, 7), (5,), ".,!?;:\"'()[]{}*#%&$|<>-_"


def terms(word: str) -> list[str]:
    """Of one word, as it stands between spaces."""
    w = word.strip(STRIP)
    return [w, *(f"^{w[:n]}" for n in FRONTS if len(w) > n), *(f"{w[-n:]}$" for n in BACKS if len(w) > n)] if w else []


class Known(dict):
    """Numbers of a word's known terms."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = tuple(self.vocabulary[t] for t in terms(word) if t in self.vocabulary)
        return found

    def counts(self, text: str | None) -> Counter:
        out: Counter = Counter()
        for word, n in Counter((text or "").lower().split()).items():
            for t in self[word]:
                out[t] += n
        return out


class Index:
    """Unit vectors by term, in blocks of neighbouring examples, with the largest weight of each block."""

    def __init__(self, vectors: list[tuple], n_terms: int, block: int = BLOCK) -> None:
        import numpy as np

        self.n, self.block = len(vectors), block
        blocks = max(1, -(-self.n // block))
        who = np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(vectors)] or [np.zeros(0)]).astype(np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)]).astype(np.float64)
        cell = term * blocks + who // block
        order = np.argsort(cell, kind="stable")
        self.who, self.weight = who[order], weight[order]
        self.start = np.searchsorted(cell[order], np.arange(n_terms * blocks + 1)).reshape(-1)
        self.most = np.zeros(n_terms * blocks)
        np.maximum.at(self.most, cell, weight)
        self.most = self.most.reshape(n_terms, blocks)
        self.blocks = blocks

    def scores(self, t, w, chosen):
        """Examples of the chosen blocks with any of the terms, and their cosines."""
        import numpy as np

        cell = (t[:, None] * self.blocks + chosen[None, :]).reshape(-1)
        a, n = self.start[cell], self.start[cell + 1] - self.start[cell]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(a - (upto - n), n)
        who, inverse = np.unique(self.who[at], return_inverse=True)
        return who, np.bincount(inverse, self.weight[at] * np.repeat(np.repeat(w, len(chosen)), n), minlength=len(who))

    def nearest(self, t, w, k: int):
        """The k nearest examples with a cosine over 0: (numbers, cosines), exact."""
        import numpy as np

        bound = w @ self.most[t]
        order = np.argsort(-bound, kind="stable")
        first = order[: max(1, 2 * k // self.block + 4)]
        who, s = self.scores(t, w, first[bound[first] > 0])
        least = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else 0.0
        rest = order[len(first) :]
        rest = rest[(bound[rest] > 0) & (bound[rest] >= least - 1e-12)]
        if len(rest):
            more, s2 = self.scores(t, w, rest)
            who, s = np.concatenate([who, more]), np.concatenate([s, s2])
        best = np.lexsort((who, -s))[:k]
        return who[best], s[best]


class Model:
    def __init__(self, vocabulary: dict[str, int], idf, ids: list, labels: list[int], counts: list[dict[int, int]], k: int = K) -> None:
        import numpy as np

        self.vocabulary, self.idf, self.ids, self.k = vocabulary, idf, ids, k
        self.labels = np.array(labels, np.float64)
        vectors = [self.vector(c) for c in counts]
        self.index = Index(vectors, max(1, len(vocabulary)))
        bare = self.labels[[not len(t) for t, _ in vectors]] if len(labels) else self.labels
        self.base = (self.labels.mean() if len(labels) else 0.0)
        self.none = (bare.sum() + self.base) / (len(bare) + 1) if len(labels) else 0.0
        # Each example judged by the others.
        votes = [(self.vote(t, w, i)[0], y) for i, ((t, w), y) in enumerate(zip(vectors, self.labels, strict=True)) if len(t)]
        self.at, self.chance = isotonic(votes)

    def vector(self, counts: dict[int, int]):
        """Terms and weights of a unit vector."""
        import numpy as np

        t = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[x] for x in t.tolist()], np.float64))) * self.idf[t] if len(t) else np.zeros(0)
        return t, w / np.sqrt((w**2).sum()) if len(t) else w

    def vote(self, t, w, without: int = -1):
        import numpy as np

        who, s = self.index.nearest(t, w, self.k + (without >= 0))
        if without >= 0:
            s = s[who != without][: self.k]
            who = who[who != without][: self.k]
        closeness = 1 / (1.02 - np.minimum(s, 1.0))
        return float((closeness @ self.labels[who] + self.base) / (closeness.sum() + 1)), who

    def score(self, counts: dict[int, int]) -> tuple[float, list]:
        import numpy as np

        if not counts or not len(self.labels):
            return float(self.none), []
        vote, who = self.vote(*self.vector(counts))
        return float(np.interp(vote, self.at, self.chance)), [self.ids[i] for i in who[:5].tolist()]


def isotonic(votes: list[tuple[float, float]]):
    """Pool-adjacent-violators on (vote, label); points and chances to interpolate between."""
    import numpy as np

    pools: list[list[float]] = []  # votes' sum, labels' sum, number
    for v, y in sorted(votes):
        pools.append([v, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [x + z for x, z in zip(pools[-1], a, strict=True)]
    at = np.array([p[0] / p[2] for p in pools] or [0.0])
    return at, np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools] or [0.0])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, n_terms: int = TERMS, k: int = K) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic; only the rows to learn from. The sample is bounded by `examples`."""
    import numpy as np

    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).select(F.col("doc_id").alias("l_id"), "toxic")
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))

    def seen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df, pos = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = {t for w in set((text.as_py() or "").lower().split()) for t in terms(w)}
                df.update(own)
                if y:
                    pos.update(own)
        keys = list(df)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "n": pa.array([df[t] for t in part], pa.int64()), "pos": pa.array([pos[t] for t in part], pa.int64())})

    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, p = float(size["n"]), float(size["pos"])
    by_term = texts.select("text", "toxic").mapInArrow(seen, "term string, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= LEAST)
    a, m = F.col("pos").cast("double"), F.col("n").cast("double")
    # Of the two-by-two table of term and label.
    chi = n * (a * (n - p) - (m - a) * p) * (a * (n - p) - (m - a) * p) / F.greatest(F.lit(1.0), m * (n - m) * F.lit(p * (n - p)))
    vocabulary = {r["term"]: i for i, r in enumerate(by_term.withColumn("chi", chi).where(F.col("chi") >= CHI).orderBy(F.desc("chi"), "term").limit(n_terms).collect())}

    def frequencies(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, df, rows = Known(vocabulary), Counter(), 0
        for b in batches:
            for text in b.column(0):
                rows += 1
                df.update({t for w in set((text.as_py() or "").lower().split()) for t in known[w]})
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *df], pa.int64()), "n": pa.array([rows, *df.values()], pa.int64())})

    counted = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a known term
    idf = np.array([math.log((1 + counted.get(-1, 0)) / (1 + counted.get(i, 0))) + 1 for i in range(len(vocabulary))])

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Known(vocabulary)
        for b in batches:
            c = [known.counts(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(x) for x in c], pa.list_(pa.int64())), pa.array([list(x.values()) for x in c], pa.list_(pa.int64()))], ["doc_id", "toxic", "terms", "times"])

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(counts, "doc_id long, toxic int, terms array<bigint>, times array<bigint>").orderBy("doc_id").collect()  # the bounded sample
    return Model(vocabulary, idf, [r["doc_id"] for r in rows], [int(r["toxic"] > 0) for r in rows], [dict(zip(r["terms"], r["times"], strict=True)) for r in rows], k)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence (doc_ids of the nearest examples) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the number of terms

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        known = Known(m.vocabulary)
        for b in batches:
            out = [m.score(known.counts(x.as_py())) for x in b.column(1)]
            s = [x for x, _ in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([e for _, e in out], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, evidence array<bigint>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out)
    return scored(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")
