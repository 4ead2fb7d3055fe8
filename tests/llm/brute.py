"""Plain-Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text.encode()) if text else []


def fingerprint(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """rows: (doc_id, fingerprint); {fingerprint: smallest doc_id reachable}."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for d, f in rows:
        r = find(f)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return {f: least.get(find(f)) for f in prints}


def substrings(rows, length=20):
    """rows: (doc_id, text); for each row (n_words, n_removed, sha256 of what is kept)."""
    place = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            at = (place(d), i)
            if k not in first or at < first[k]:
                first[k] = at
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (place(d), i):
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def ids_crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = [x.decode() for x in words(t)]
    lines = [x for x in t.split("\n") if words(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def budgets(leaf, share, epochs, weights):
    """Water filling down the tree, one saturated child after the other."""
    levels = ["m_domain", "m_lang", "m_source"]

    def place(keys, depth, budget, out):
        if depth == 3:
            out[keys[0]] = budget
            return
        kids = {}
        for k in keys:
            kids.setdefault(k[depth], []).append(k)
        w = {c: weights[levels[depth]].get(c, 1) for c in kids}
        can = {c: epochs * sum(leaf[k] for k in kids[c]) if w[c] else 0 for c in kids}
        left, open_, got = budget, set(kids), {}
        while open_:
            total = sum(w[c] for c in open_)
            full = {c for c in open_ if can[c] * total <= w[c] * left}
            if not full:
                got |= {c: w[c] * left // total for c in open_}
                break
            for c in full:
                got[c] = can[c]
                left -= can[c]
            open_ -= full
        for c in kids:
            place(kids[c], depth + 1, got[c], out)

    out = {}
    if leaf:
        place(list(leaf), 0, int(sum(leaf.values()) * share), out)
    return out
