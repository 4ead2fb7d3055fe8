"""The registered queries and the pipeline's stages on the smallest tables, against plain-Python versions."""

from __future__ import annotations

import brute
import pytest
from test_near_copies import kept as near_kept


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, small, name):
    from twinsift.llm import catalog

    return catalog.QUERIES[name](spark, small).collect()


def test_op3(spark, small, texts):
    prints = {d: brute.fingerprint(t) for d, t in texts.items()}
    named = brute.components(list(prints.items()))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, small, "op3_simhash")}
    assert got == {d: (f"{f:016x}", named[f]) for d, f in prints.items()}


def test_op4_and_op6(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in sorted(texts.items())}
    at, want = 0, {}
    for d, x in ids.items():
        want[d] = (at, len(x) + 1, brute.ids_crc([*x, 2]))
        at += len(x) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, small, "op4_token_file")} == want
    pieces = run(spark, small, "op6_packing")
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, mine in by_doc.items():
        whole, at = [*ids[d], 1], 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole) and r["ids_crc32"] == brute.ids_crc(whole[at : at + r["length"]])
            at += r["length"]
        assert at == len(whole)
    padding = 0
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.05 * sum(len(x) + 1 for x in ids.values())


def test_op5(spark, small, texts):
    rows = sorted(texts.items())
    want = {d: b for (d, _), b in zip(rows, brute.substrings(rows), strict=True)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, small, "op5_substring_dedup")} == want


def test_op9(spark, small, texts):
    got = run(spark, small, "op9_quality_rules")
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {d: brute.base_counts(t) for d, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got)
    # Held against the labels: good documents that pass the base rules stay, bad ones go.
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for quality, kept in ((1, True), (0, False)):
        those = [r["kept"] for r in got if good.get(r["doc_id"]) == quality and not (quality and r["base_failed"])]
        assert sum(x == kept for x in those) >= 0.95 * len(those)


def test_op2_on_held_out_documents(spark, small):
    """Documents whose labels were not learned from: toxic ones score higher than others."""
    import zlib

    from twinsift.llm import catalog

    where = f"{small}/../sf0.1"
    got = {r["doc_id"]: r for r in catalog.QUERIES["op2_toxicity"](spark, where).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in got.items())
    yes, no = ([r["score"] for d, r in got.items() if r["held_out"] and toxic.get(d) == y] for y in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    assert better >= 0.93 and sum(s >= 0.5 for s in yes) >= 0.8 * len(yes) and sum(s >= 0.5 for s in no) <= 0.05 * len(no)


def test_op1_recall(spark, small):
    import numpy as np

    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = {}
    for r in run(spark, small, "op1_nearest_neighbours"):
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = []
    for q, mine in found.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & set(mine)) / 10)
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s in mine.items())
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 100 == 0) and sum(hits) / len(hits) >= 0.9


def test_op10(spark, small, texts):
    import zlib

    got = run(spark, small, "op10_hilbert_shards")
    sizes = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes.setdefault(r["shard"], []).append(r)
    assert len(got) == len(texts) and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in sizes.values())


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p
    from twinsift.llm import mixing, quality
    from twinsift.llm.common import stored, table

    docs = table(spark, small, "documents")
    labels = table(spark, small, "labels")
    columns = docs.columns
    kept = stored(p.quality_rules(spark, docs, small), "t1")
    judged = quality.judge(docs, quality.fit(docs, labels)).select("doc_id", "kept").collect()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged if r["kept"]} and kept.columns == columns

    single = stored(p.near_duplicates(spark, kept, small), "t2")
    # Five-word shingles, a similarity of 0.8 or more.
    assert sorted(r["doc_id"] for r in single.collect()) == near_kept([(r["doc_id"], r["text"]) for r in kept.collect()]) and single.columns == columns

    short = stored(p.repeated_passages(spark, single, small), "t3")
    rows = sorted((r["doc_id"], r["text"]) for r in single.collect())
    want = {d: b[0] - b[1] for (d, _), b in zip(rows, brute.substrings(rows), strict=True)}
    assert {r["doc_id"]: len(brute.words(r["text"])) for r in short.collect()} == want and short.columns == columns

    mixed = stored(p.source_mix(spark, short, small), "t4")
    leaf = {}
    for r in mixing.with_leaf(short).collect():
        k = (r["m_domain"], r["m_lang"], r["m_source"])
        leaf[k] = leaf.get(k, 0) + r["m_tokens"]
    plan, took, most = brute.budgets(leaf, mixing.SHARE, mixing.EPOCHS, mixing.WEIGHTS), {}, 0
    for r in mixing.with_leaf(mixed).collect():
        k = (r["m_domain"], r["m_lang"], r["m_source"])
        took[k] = took.get(k, 0) + r["m_tokens"]
        most = max(most, r["m_tokens"])
    assert all(0 <= plan[k] - took.get(k, 0) for k in plan) and mixed.columns == columns

    pieces = p.packed(spark, mixed, small).collect()
    assert sum(r["start"] == 0 for r in pieces) == mixed.count()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
