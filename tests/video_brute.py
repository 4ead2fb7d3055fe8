"""Whether two videos' frames are alike, in plain Python.

Frames are parallel arrays: hashes (-1 for an invalid frame) and colours (24 numbers a frame).
"""

from __future__ import annotations

from twinsift import schema

SPREAD = 2  # frames between matches


def _alike(kind: str, ha: int, ca, hb: int, cb) -> tuple[int, int] | None:
    """(distance, colour distance) of two frames that are similar."""
    import numpy as np

    most, direct, ranges = schema.LIMITS[kind]
    d = ((ha ^ hb) & ((1 << 64) - 1)).bit_count()
    if d >= most:
        return None
    c = int(np.add.accumulate(np.abs(np.asarray(ca) - np.asarray(cb)))[-1])
    return (d, c) if d <= direct or any(low <= d <= high and c <= limit for low, high, limit in ranges) else None


def _needed(kind: str, comparable: int) -> tuple[int, int]:
    """Matches and span that are asked for."""
    if comparable <= 2:
        return 1, 0
    if comparable <= 5:
        return 2, 1
    percent = 45 if kind == "SCREEN_RECORDING" else 35
    return max(3, -(-comparable * percent // 100)), SPREAD


def alike(kind: str, source_a: str, a, colors_a, source_b: str, b, colors_b) -> bool:
    """Frames of a (the later scanned) against those of b."""
    good_a, good_b = ([i for i, h in enumerate(x) if h != schema.INVALID_HASH] for x in (a, b))
    if not good_a or not good_b:
        return False
    if source_a == source_b == "REFERENCE_FRAMES":
        pairs = []
        for i in good_a:
            for j in good_b:
                if found := _alike(kind, a[i], colors_a[i], b[j], colors_b[j]):
                    pairs.append((*found, abs(i - j), i, j))
        matches, span = _needed(kind, min(len(good_a), len(good_b)))
        used: list[tuple[int, int]] = []
        for _, _, _, i, j in sorted(pairs, key=lambda p: p[:3]):
            if all(i != x and j != y for x, y in used):
                used.append((i, j))
        # More matches only widen both spans, so the end decides.
        spans = [max(side) - min(side) for side in zip(*used, strict=True)] if used else [0]
        return bool(used) and len(used) >= matches and min(spans) >= span
    single_a, single_b = (s == "SYSTEM_THUMBNAIL" and len(g) == 1 for s, g in ((source_a, good_a), (source_b, good_b)))
    if single_a or single_b:
        return single_a and single_b and _alike(kind, a[good_a[0]], colors_a[good_a[0]], b[good_b[0]], colors_b[good_b[0]]) is not None
    free, matched = list(good_b), []
    for i in good_a:
        j = next((j for j in free if _alike(kind, a[i], colors_a[i], b[j], colors_b[j])), None)
        if j is not None:
            free.remove(j)
            matched.append(i)
    return len(matched) >= 2 and matched[-1] - matched[0] >= SPREAD
