"""Comparing pictures tile by tile: inside a task as arrays, with the same numbers as the column expressions give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift import schema

STRIP, CHANNELS = 1 << 20, 24
FOUND = "id long, b_id long, distance int, colors long"


def _limits(kind: str):
    """The most that colours may differ at each distance of hashes; -1 where no colour helps, or none is asked."""
    import numpy as np

    most, direct, ranges = schema.LIMITS[kind]
    out = np.full(65, -1)
    for low, high, c in ranges:
        out[low : high + 1] = np.maximum(out[low : high + 1], c)
    out[most:] = out[: direct + 1] = -1
    return out


def close_colors(kind: str, hash_a, color_a, hash_b, color_b, triangle: bool, direct: bool = False):
    """Places (i, j) of pairs that are alike by their colours, with both distances. Colours: a row for each channel.

    triangle: both sides are the same rows, each pair is taken once. Differences add up in the order of the channels, and
    pairs that are past their limit are dropped on the way. direct: pairs that are alike by their hashes alone are found too."""
    import numpy as np

    limits, out = _limits(kind).astype(float), []
    if direct:
        limits[: schema.LIMITS[kind][1] + 1] = np.inf
    step = max(1, STRIP // max(1, len(hash_b)))
    for a in range(0, len(hash_a), step):
        first = a if triangle else 0
        distance = np.bitwise_count(hash_a[a : a + step, None] ^ hash_b[None, first:])
        i, j = np.nonzero(limits[distance] >= 0)
        d = distance[i, j].astype(np.int32)
        i, j = i + a, j + first
        if triangle:
            up = i < j
            i, j, d = i[up], j[up], d[up]
        bound, total = limits[d] + 1, np.zeros(len(i))
        for k in range(CHANNELS):
            total += np.abs(color_a[k][i] - color_b[k][j])
            if k % 6 == 5:
                good = (total < bound) | np.isinf(bound)
                i, j, d, bound, total = i[good], j[good], d[good], bound[good], total[good]
        out.append((i, j, d, np.nan_to_num(total).astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def pictures(table):
    """Hashes and colours (a row for each channel) of an Arrow table's pictures."""
    import numpy as np

    hashes = table.column("image_hash").to_numpy().view(np.uint64)
    lists = table.column("color_hash").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) == CHANNELS * len(hashes) and (sizes == CHANNELS).all():
        return hashes, np.ascontiguousarray(flat.reshape(-1, CHANNELS).T)
    # Other lengths: what is not there makes the sum no number, which is below no limit.
    colors, at = np.full((CHANNELS, len(hashes)), np.nan), 0
    for n, size in enumerate(sizes.tolist()):
        colors[: min(size, CHANNELS), n] = flat[at : at + size][:CHANNELS]
        at += size
    return hashes, colors


def tiles(rows: DataFrame, keys: list[str], kind: str, direct: bool = False) -> DataFrame:
    """Pairs of pictures in each tile. rows: keys, role (0 on both sides, 1 left, 2 right), id, image_hash, color_hash.

    direct: also those that are alike by their hashes alone."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        role, ids = table.column("role").to_numpy(), table.column("id").to_numpy()
        hashes, colors = pictures(table)
        left, right = np.flatnonzero(role <= 1), np.flatnonzero(role != 1)
        triangle = bool((role == 0).any())
        i, j, d, c = close_colors(kind, hashes[left], colors[:, left], hashes[right], colors[:, right], triangle, direct)
        a, b = ids[left][i], ids[right][j]
        return pa.table({"id": pa.array(a, pa.int64()), "b_id": pa.array(b, pa.int64()), "distance": pa.array(d, pa.int32()), "colors": pa.array(c, pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, FOUND)


def judged(columns):
    """recording, later and earlier of the pairs of videos that meet the rule of alike_videos; columns: a match each."""
    import numpy as np

    later, earlier, recording, needed, spread, d, c, i, j = columns
    order = np.lexsort((j, i, np.abs(i - j), c, d, earlier, later))
    later, earlier, kind, needed, spread, i, j = (x[order] for x in (later, earlier, recording, needed, spread, i, j))
    new = np.append(True, (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(later)))
    used_a, used_b = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    one = np.int64(1)
    for r in range(int(size.max())):
        pair = np.flatnonzero(size > r)
        at = start[pair] + r
        bit_a, bit_b = one << i[at].astype(np.int64), one << j[at].astype(np.int64)
        free = (used_a[pair] & bit_a == 0) & (used_b[pair] & bit_b == 0)
        used_a[pair[free]] |= bit_a[free]
        used_b[pair[free]] |= bit_b[free]

    def span(bits):
        return np.floor(np.log2(bits.astype(float))) - np.floor(np.log2((bits & -bits).astype(float)))

    good = (np.bitwise_count(used_a) >= needed[start]) & (np.minimum(span(used_a), span(used_b)) >= spread[start])
    return kind[start][good], later[start][good], earlier[start][good]


def alike_videos(matches: DataFrame, tasks: int) -> DataFrame:
    """(kind, later_id, earlier_id) of pairs of videos of REFERENCE_FRAMES whose matches meet the rule, one batch of pairs at a time.

    matches: kind, later_id, earlier_id, needed, spread, distance, colors, i, j. Of each pair the closest match comes first,
    and a match counts while both of its frames are free; the frames used must be `needed` and lie `spread` apart."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept: list | None = None
        names = ["recording", "later_id", "earlier_id"]
        pack = lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            if not len(columns[0]):
                continue
            # The last pair may go on in the next batch.
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            kept = [x[last] for x in columns]
            if not last.all():
                yield pack(judged([x[~last] for x in columns]))
        if kept is not None and len(kept[0]):
            yield pack(judged(kept))

    columns = ["later_id", "earlier_id", (F.col("kind") == "SCREEN_RECORDING").cast("long").alias("recording"), *(F.col(c).cast("int").alias(c) for c in ("needed", "spread", "distance", "colors", "i", "j"))]
    sorted_ = matches.select(*columns).repartition(tasks, "later_id", "earlier_id").sortWithinPartitions("later_id", "earlier_id")
    found = sorted_.mapInArrow(run, "recording long, later_id long, earlier_id long")
    return found.select(F.when(F.col("recording") == 1, "SCREEN_RECORDING").otherwise("VIDEO").alias("kind"), "later_id", "earlier_id")
