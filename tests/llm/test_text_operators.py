"""Operators 11 to 13 against the libraries and plain versions."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers
import pytest

from twinsift.llm import alignment, collocations, segments, sentencepieces
from twinsift.llm.catalog import QUERIES

SHAPE = "doc_id long, lang string, text string"
PARTS = ["a", "b", "  ", " ", "\n", "\t", "é", "\U0001f9ff", "▁", "\x00", "<0x41>", "<s>", "<|endoftext|>", "ﬁ", "Ａ", "①", "́", "　", "\xa0", "\r", "\x0b", "\x1c", "\x85", ";", "한", "the", "'s", "42"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def rows_of(texts):
    return [(i, "en", t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepieces.VOCABULARY))


def offsets(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def own_offsets(model, text):
    ids, starts, ends, _ = model.encode([text])
    return list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True))


def decoded(model, ids):
    import numpy as np

    return model.decode(np.array(ids, np.int64), [len(ids)])[0]


def test_spans_equal_the_library(library):
    model = sentencepieces.model(public_tokenizers.path(sentencepieces.VOCABULARY))
    texts = odd_texts(1500)
    for text in texts:
        assert own_offsets(model, text) == offsets(library, text), repr(text)
    ids, _, _, counts = model.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t)] and counts.sum() == len(ids)
    r = random.Random(2)
    for _ in range(1500):
        some = [r.choice([r.randrange(32000), r.randrange(300), 28705]) for _ in range(r.randint(1, 6))]
        assert decoded(model, some) == library.decode(some)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [b"", bytes([4 << 3, 1]), bytes([3 << 3, 0]), bytes([5 << 3, 0])])
def test_compiled_maps(rule, flags):
    """The same model with the library's own compiled maps: longest keys, spaces squeezed, no space before, spaces as they are."""
    import sentencepiece

    from twinsift.llm.sentencepieces import _fields, _message

    with open(public_tokenizers.path(sentencepieces.VOCABULARY), "rb") as file:
        raw = file.read()
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    data = raw + _message(3, _message(2, dict(_fields(spec))[2]) + flags)
    model, library = sentencepieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in odd_texts(300, 3):
        assert own_offsets(model, text) == offsets(library, text), repr(text)
        ids = library.encode(text)
        assert decoded(model, ids) == library.decode(ids)


def sentencepiece_brute(library, text):
    ids = library.encode(text or "")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))


def test_sentencepiece_query(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["op12_sentencepiece"](spark, small).collect())
    assert got == sorted((d["doc_id"], *sentencepiece_brute(library, d["text"])) for d in docs)


def test_sentencepiece_small_cases(spark, library, monkeypatch):
    long = "word " * 200_000 + "x" * 300_000
    rows = [(1, "en", None), (2, None, ""), (None, "en", "a b"), (3, "en", "a b"), (3, "en", "a b"), (4, "en", long), *((i + 10, "en", t) for i, t in enumerate(odd_texts(60, 5)))]
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 ids", "2 starts", "3 decoded")
    found = sentencepieces.encode(docs)
    assert found.columns == ["doc_id", "ids", "starts", "ends"]
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in found.select("doc_id", "ids").collect()), key=key)
    assert got == sorted(((i, library.encode(t or "")) for i, _, t in rows), key=key)
    back = {r["doc_id"]: r["decoded"] for r in sentencepieces.decode(found).collect()}
    assert back[4] == long and back[1] == "" and back[None] == "a b"
    assert sentencepieces.encode(docs.limit(0)).count() == 0
    model = sentencepieces.model(public_tokenizers.path(sentencepieces.VOCABULARY))
    assert [model.encode([t])[0].tolist() for t in odd_texts(40, 6)] == [library.encode(t) for t in odd_texts(40, 6)]
    monkeypatch.setattr(sentencepieces, "BATCH", 50)
    assert {r["doc_id"]: r["decoded"] for r in sentencepieces.decode(sentencepieces.encode(docs)).collect()} == back


def test_cuts_follow_the_vocabularies():
    assert segments.splitters(["a", " b", "\n\n", ";\r"]) == " \n\t"
    assert segments.splitters(["a b", "c\t"]) == "\n"
    cut = segments.Cutter(" \n")
    assert cut("a  b\n c") == ["a", "  b", "\n c"] and cut(" ") == [" "] and cut("") == []
    assert cut("a\xa0 b c") == ["a\xa0 b", " c"]
    with pytest.raises(ValueError):
        segments.Cutter("")


def alignment_brute(rows):
    """Whole texts by both libraries, links by their ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B))
    ranks = {}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        for line in file:
            word, rank = line.split()
            ranks[int(rank)] = base64.b64decode(word)
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made, pairs = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(ranks[i] for i in ids_a) != whole or b"".join(map(piece, ids_b)) != whole:
            ids_a = ids_b = []
        ends = lambda ids, of: list(itertools.accumulate(len(of(i)) for i in ids))
        ends_a, ends_b = ends(ids_a, ranks.__getitem__), ends(ids_b, piece)
        at_a, at_b = ({e: k for k, e in enumerate(x)} for x in (ends_a, ends_b))
        common = sorted(set(ends_a) & set(ends_b))
        links = [(ids_a[at_a[e]], ids_b[at_b[e]]) for e in common]
        pairs.update(links)
        groups, x, y = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, ids_a[x : at_a[e] + 1])) + "|" + ",".join(map(str, ids_b[y : at_b[e] + 1])))
            x, y = at_a[e] + 1, at_b[e] + 1
        made.append((doc_id, len(ids_a), len(ids_b), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return [(i, n_a, n_b, len(links), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), groups) for i, n_a, n_b, links, groups in made]


def test_alignment_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = alignment_brute([(d["doc_id"], d["text"]) for d in docs])
    got = sorted(tuple(r) for r in QUERIES["op11_alignment"](spark, small).collect())
    assert got == sorted((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want)


def test_alignment_small_cases(spark):
    long = "word " * 3000 + "éx" * 3000
    rows = [(1, "en", None), (2, None, ""), (None, "en", "a b▁c"), (3, "en", "a b"), (3, "en", "a b"), (4, "en", long), (5, "en", " "), *((i + 10, "en", t) for i, t in enumerate(odd_texts(150, 7)))]
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 block", "'x' groups", "3 segment")
    key = lambda r: (r[0] is None, r)
    want = sorted(alignment_brute([(i, t) for i, _, t in rows]), key=key)
    assert want[-1][1:] == (0, 0, 0, 0, 0, 0, "")
    assert sorted((tuple(r) for r in alignment.align(docs).collect()), key=key) == want
    assert sorted((tuple(r) for r in alignment.align(docs, block=500, bucket=300).collect()), key=key) == want
    assert alignment.align(docs.limit(0)).count() == 0


def collocations_brute(rows, least, top):
    import re

    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {p: n for p, n in counts.items() if n >= least}
    scored, out = {}, {}
    for (lang, p), a in frequent.items():
        if len(p) > 1:
            scored[lang, p] = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
    longer = Counter()
    for lang, p in scored:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], frequent[lang, p])
    for (lang, p), (score, _, left, right) in scored.items():
        if 100 * longer[lang, p] < 80 * frequent[lang, p]:
            out.setdefault(lang, []).append((-score, -frequent[lang, p], " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows(n=400, seed=3):
    r = random.Random(seed)
    words = ["New", "york", "CITY", "of", "the", "Été", "x\x1cy", "ｚ", "\U0001f9ff", "a"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", " \t", ". ", ",", "\n", "\x0b"]) for _ in range(r.randint(0, 40))) + r.choice(["", "New York City Hall", "york  new"])
    return [(i, r.choice(["en", "en", "en", "de", None, ""]), r.choice([None, "", *[text()] * 20])) for i in range(n)]


@pytest.mark.parametrize("more", [{}, {"block": 300, "bits": 16}, {"bits": 12}])
def test_collocations_equal_brute_force(spark, more):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 phrase", "2 n", "3 chunk").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=40, **more).collect())
    assert got == collocations_brute([(lang, t) for _, lang, t in rows], 5, 40)
    assert len(got) > 100


def test_collocations_small_cases(spark):
    long = "alpha beta gamma delta epsilon " * 40_000
    rows = [(1, "en", None), (2, None, ""), (3, "en", long), (4, "fr", "a b " * 29), (None, None, "q r. " * 30), (None, None, "q r. " * 30)]
    docs = spark.createDataFrame(rows, SHAPE)
    want = collocations_brute([(lang, t) for _, lang, t in rows], 30, 2000)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == want
    assert ("und", 1, "q r", 60, 60, 60, 120, 1_000_000) in want and not [w for w in want if w[0] == "fr"]
    assert collocations.collocations(docs.limit(0)).count() == 0
    # Sums of two counts beyond 64 bits.
    huge = 6_000_000_000_000_000_000
    frequent = spark.createDataFrame([("en", "a", 1, huge), ("en", "b", 1, huge + 7), ("en", "a b", 2, huge - 1)], "lang string, phrase string, k int, n long")
    assert [tuple(r) for r in collocations._scored(frequent).select("a", "l", "r", "score").collect()] == [(huge - 1, huge, huge + 7, 2_000_000 * (huge - 1) // (2 * huge + 7))]
