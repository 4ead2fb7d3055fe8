"""Anchor groups: direct similarity only, never chains.

Visiting assets in rank order, an asset not yet taken becomes an anchor and takes its neighbours that are
still free. That is the lexicographically first maximal independent set: an asset is an anchor if none of its
lower-ranked neighbours is one. It is found in parallel rounds: each round, free assets without a free
lower-ranked neighbour become anchors and their neighbours are settled. A chain in the order of ranks settles
only one anchor a round, so after a few rounds the components of what is left are taken: those of at most
`TOGETHER` edges are finished by the sequential rule, each in one task; only larger ones need more rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift import schema
from twinsift.operators import covering
from twinsift.operators.graph import components
from twinsift.storage import discard, kept

ROUNDS, TOGETHER = 3, 500_000


def scan_rank(assets: DataFrame, family: str) -> DataFrame:
    """(asset_id, order): images from the oldest, videos from the newest; ties go by media_store_id, newest first.

    Only assets that may be compared have a rank. The order is a struct, compared as it stands: no global sort or row
    number is needed.
    """
    from twinsift.operators import joins

    assets = joins.comparable(assets)
    if family in ("PHOTO", "SCREENSHOT"):
        order = F.struct(F.col("created_at_ms").alias("a"), (-F.col("media_store_id")).alias("b"), F.col("asset_id").alias("c"))
    else:
        order = F.struct((-F.col("date_added_s")).alias("a"), (-F.col("media_store_id")).alias("b"), F.col("asset_id").alias("c"))
    return assets.select("asset_id", order.alias("order"))


def _in_order(table):
    """The anchors of one component, by the sequential rule."""
    import numpy as np
    import pyarrow as pa

    u, v = (table.column(c).to_numpy() for c in ("u", "v"))
    order = np.lexsort([table.column(f"u_order_{c}").to_numpy() for c in "cba"] )
    by = np.argsort(u, kind="stable")
    u_sorted, v_sorted = u[by], v[by]
    _, first = np.unique(u[order], return_index=True)
    settled, anchors = set(), []
    for x in u[order[np.sort(first)]].tolist():
        if x not in settled:
            anchors.append(x)
            lo, hi = np.searchsorted(u_sorted, [x, x + 1])
            settled.update(v_sorted[lo:hi].tolist())
    return pa.table({"asset_id": pa.array(anchors, pa.int64())})


def anchor_groups(ranks: DataFrame, edges: DataFrame, rounds: int = ROUNDS, together: int = TOGETHER) -> DataFrame:
    """(group_id, asset_id, is_anchor) of groups of two or more; group_id is the anchor's asset_id."""
    both = edges.select(F.col("first_asset_id").alias("u"), F.col("second_asset_id").alias("v")).where("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    a, b = ranks.select(F.col("asset_id").alias("u"), F.col("order").alias("u_order")), ranks.select(F.col("asset_id").alias("v"), F.col("order").alias("v_order"))
    arcs = kept(both.join(a, "u").join(b, "v"), "arcs")
    free, chosen, done = arcs, arcs.select(F.col("u").alias("asset_id")).limit(0), 0
    while not free.isEmpty():
        if done >= rounds:
            # Small components of what is left are finished at once.
            roots = components(free.select("u", "v"))
            placed = free.join(roots, F.col("u") == F.col("node"))
            placed = kept(placed.join(placed.groupBy("root").agg(F.count("*").alias("n")), "root").drop("node"), "placed")
            small = placed.where(F.col("n") <= together).select("root", "u", "v", *(F.col(f"u_order.{c}").alias(f"u_order_{c}") for c in "abc"))
            chosen = chosen.unionByName(kept(small.groupBy("root").applyInArrow(_in_order, "asset_id long"), "anchors"))
            free = placed.where(F.col("n") > together).drop("root", "n")
            rounds = 2 * done + 1
            if free.isEmpty():
                break
        # Free assets, all of whose free neighbours rank higher.
        first = free.groupBy("u").agg(F.min(F.when(F.col("v_order") < F.col("u_order"), 0).otherwise(1)).alias("first")).where("first = 1").select("u")
        found = kept(first.withColumnRenamed("u", "asset_id"), "anchors")
        taken = free.join(found, F.col("u") == F.col("asset_id"), "left_semi").select(F.col("v").alias("asset_id"))
        settled = kept(taken.unionByName(found).distinct(), "settled")
        rest = free.join(settled, F.col("u") == F.col("asset_id"), "left_anti").join(settled, F.col("v") == F.col("asset_id"), "left_anti")
        rest = kept(rest, "free")
        # An asset whose neighbours were all settled by others is an anchor too, and may rank before those others.
        lone = free.select(F.col("u").alias("asset_id")).distinct().join(settled, "asset_id", "left_anti").join(rest.select(F.col("u").alias("asset_id")), "asset_id", "left_anti")
        chosen = chosen.unionByName(found).unionByName(kept(lone, "lone"))
        discard(settled, *([free] if done and hasattr(free, "kept_at") else []))
        free, done = rest, done + 1
    chosen = kept(chosen, "chosen")
    held = arcs.join(chosen, F.col("v") == F.col("asset_id"), "left_semi").join(chosen.withColumnRenamed("asset_id", "x"), F.col("u") == F.col("x"), "left_anti")
    members = held.groupBy("u").agg(F.min(F.struct("v_order", "v")).alias("best")).select(F.col("best.v").alias("group_id"), F.col("u").alias("asset_id"), F.lit(False).alias("is_anchor"))
    anchors = members.select("group_id").distinct().select("group_id", F.col("group_id").alias("asset_id"), F.lit(True).alias("is_anchor"))
    return members.unionByName(anchors)


def first_seen(assets: DataFrame) -> DataFrame:
    """(asset_id, order) by the numbers that assets got when they were first seen: the order of groups while a scan runs."""
    zero = F.lit(0).cast("long")
    return assets.select("asset_id", F.struct(F.col("asset_id").alias("a"), zero.alias("b"), zero.alias("c")).alias("order"))


def compared(assets: DataFrame, ranks: DataFrame, kind: str, members: DataFrame | None = None, block: int = covering.BLOCK, sparse: int = covering.SPARSE) -> DataFrame:
    """Anchor groups of one image kind by comparing, without stored edges; duplicates of others take no part.

    members (group_id, asset_id), each asset once: only members of one group are compared."""
    from twinsift.operators import joins

    rows = joins.candidates(assets, kind).join(ranks, "asset_id")
    rows = rows.withColumn("place", F.lit(0)) if members is None else rows.join(members.withColumnRenamed("group_id", "place"), "asset_id")
    if members is None:
        edges = lambda rest: joins.similar_pairs(rest.withColumnRenamed("version", "algorithm_version"), rest.withColumnRenamed("version", "algorithm_version"), kind)
    else:
        edges = lambda rest: joins.placed_pairs(rest.withColumnRenamed("asset_id", "id"), ["place", "version"], kind)
    return covering.groups(rows, covering.Pictures(kind), edges, block, sparse)


def snapshot_groups(assets: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Groups as shown during a scan: the same rule on the edges found so far between active assets, in first-seen order.

    Without edges the assets, which are photos then, are compared. Duplicates of others are not in similar groups."""
    from twinsift.operators import joins

    if edges is None:
        return compared(assets, first_seen(assets), "PHOTO")
    live = joins.live_edges(edges, assets)
    twins = joins.duplicate_groups(assets).select(F.col("asset_id").alias("id"))
    for end in ("first_asset_id", "second_asset_id"):
        live = live.join(twins, F.col(end) == F.col("id"), "left_anti")
    return anchor_groups(first_seen(assets), live)


def groups_of(assets: DataFrame, kind: str, edges: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Similar groups of one image kind: by the edges given; where there are none, by the members of stored groups
    (category, kind, group_id, asset_id), verified again; where no such group has two active members, by comparing all anew."""
    from twinsift.operators import joins

    own = assets.where(F.col("kind") == kind)
    if edges is not None and not edges.where(F.col("kind") == kind).isEmpty():
        return anchor_groups(scan_rank(own, kind), joins.live_edges(edges.where(F.col("kind") == kind), own))
    if stored is not None:
        members = kept(joins.stored_members(stored, own, [kind]), "stored")
        if not members.isEmpty():
            if members.groupBy("asset_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                return compared(own, scan_rank(own, kind), kind, members)
            return anchor_groups(scan_rank(own, kind), joins.verified_edges(members, own, kind))
    return compared(own, scan_rank(own, kind), kind)


def video_groups_of(videos: DataFrame, frames: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Similar groups of videos and recordings together, by stored groups as in groups_of, or by comparing all anew."""
    from twinsift.operators import joins

    if stored is not None:
        members = kept(joins.stored_members(stored, videos, schema.FAMILIES["VIDEO"]), "stored")
        if not members.isEmpty():
            return anchor_groups(scan_rank(videos, "VIDEO"), joins.video_edges(videos, frames, candidates=joins.stored_pairs(members, videos)))
    return videos_compared(videos, frames)


def videos_compared(videos: DataFrame, frames: DataFrame, band: bool | None = None, block: int = 1024, sparse: int = covering.SPARSE) -> DataFrame:
    """Anchor groups of videos by comparing; without a band and with frames of REFERENCE_FRAMES only, no edges are stored."""
    from twinsift.operators import joins

    ranks = scan_rank(videos, "VIDEO")
    banded = not videos.where(joins.has_band(videos)).isEmpty() if band is None else band
    if banded or not frames.where("source <> 'REFERENCE_FRAMES'").isEmpty():
        return anchor_groups(ranks, joins.video_edges(videos, frames, band))
    rows = joins.clips(videos, frames).join(ranks, "asset_id").withColumn("place", F.lit(0))
    edges = lambda rest: covering.clip_pairs(kept(rest, "clips"), covering.BLOCK).select(F.col("id").alias("first_asset_id"), F.col("b_id").alias("second_asset_id"))
    return covering.groups(rows, covering.Clips(), edges, block, sparse)


def pruned(items: DataFrame) -> DataFrame:
    """Groups of two or more only."""
    n = F.count("*").over(Window.partitionBy("category", "group_id"))
    return items.withColumn("q_n", n).where("q_n > 1").drop("q_n")


def image_items(assets: DataFrame, kind: str) -> DataFrame:
    """Duplicate and similar group items of one image kind."""
    from twinsift.operators import joins

    own = assets.where(F.col("kind") == kind)
    duplicates = joins.duplicate_groups(own).select(F.lit("DUPLICATE").alias("category"), "kind", "group_id", "asset_id", (F.col("asset_id") == F.col("group_id")).alias("is_anchor"))
    similar = groups_of(own, kind)
    return duplicates.unionByName(similar.select(F.lit("SIMILAR").alias("category"), F.lit(kind).alias("kind"), "group_id", "asset_id", "is_anchor"))


def video_items(videos: DataFrame, frames: DataFrame, band: bool | None = None) -> DataFrame:
    """Similar groups of videos and recordings together; all count as videos."""
    from twinsift.operators import joins

    found = videos_compared(videos, frames, band)
    return found.select(F.lit("SIMILAR").alias("category"), F.lit("VIDEO").alias("kind"), "group_id", "asset_id", "is_anchor")
