"""Cutting texts into segments that a tokenizer treats apart from each other, and putting arrays of segments together.

A segment is a run of splitters (white space) and the run of other characters after it. A vocabulary in which no piece
holds a splitter after another character never merges across the start of such a run, so a text's pieces are those
of its segments, one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

SPLITTERS = " \n\t"


def splitters(pieces: Iterable[str], wanted: str = SPLITTERS) -> str:
    """Those of the wanted characters that follow nothing but white space in any piece."""
    pieces, found = list(pieces), wanted
    while True:
        # No cut follows white space of any kind, so only other characters count.
        inner = re.compile(rf"[^\s{re.escape(found)}]([{re.escape(found)}])") if found else None
        bad = {m for p in pieces for m in inner.findall(p)} if inner else set()
        if not bad:
            return found
        found = "".join(c for c in found if c not in bad)


class Cutter:
    """Cuts before runs of splitters; a run that another kind of white space precedes goes with that one."""

    def __init__(self, found: str) -> None:
        if not found:
            raise ValueError("the vocabularies merge across every kind of white space")
        kind = re.escape(found)
        self._plain = re.compile(f"[{kind}]*[^{kind}]+|[{kind}]+").findall
        self._other = re.compile(rf"[^\S{kind}]").search
        self._exact = re.compile(rf"(?<=[^\s{kind}])(?=[{kind}])").split

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        return self._exact(text) if self._other(text) else self._plain(text)


def gathered(starts, lengths, index):
    """Places in flat arrays of the stretches (starts, lengths) numbered by index, one stretch after the other."""
    import numpy as np

    n = lengths[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts[index] - (ends - n), n)
