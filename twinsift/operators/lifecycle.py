"""The asset table's life: reuse of fingerprints, upserts, deletion and its undoing, sweeps, guarded commits.

Tables are not changed in place: each function returns the next version, from joins of the old one with a
batch or a list of requests; the caller writes it (or merges it, where a catalog can).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, RESTORE, FINALIZE, RECOVER = "mark_pending", "restore", "finalize", "recover_stale"
STALE_MS = 10 * 60 * 1000


def reuse(scanned: DataFrame, state: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """scanned assets (asset_id, source_signature, algorithm_version) with needs_fingerprint and skip.

    state: the stored rows. A fingerprint is reused if it is there and signature and version are the same; rows on
    their way to deletion are skipped.
    """
    old = state.select("asset_id", F.col("source_signature").alias("o_signature"), F.col("algorithm_version").alias("o_version"), F.col("state").alias("o_state"))
    has = fingerprints.select("asset_id").distinct().withColumn("o_has", F.lit(True))
    rows = scanned.join(old, "asset_id", "left").join(has, "asset_id", "left")
    same = F.coalesce(F.col("o_has") & (F.col("o_signature") == F.col("source_signature")) & (F.col("o_version") == F.col("algorithm_version")), F.lit(False))
    skip = F.coalesce(F.col("o_state").isin("DELETE_PENDING", "DELETED"), F.lit(False))
    return rows.withColumns({"needs_fingerprint": ~same & ~skip, "skip": skip}).drop("o_signature", "o_version", "o_state", "o_has")


def upsert(state: DataFrame, scanned: DataFrame, scan: str) -> DataFrame:
    """state with the scanned rows in place of those of the same key (media_store_id, kind); the revision counts changes."""
    key = ["media_store_id", "kind"]
    old = state.select(*key, F.col("asset_id").alias("o_id"), F.col("revision").alias("o_revision"), F.col("state").alias("o_state"), F.col("source_signature").alias("o_signature"), F.col("fingerprint_status").alias("o_status"))
    same = F.coalesce(F.col("o_signature") == F.col("source_signature"), F.lit(False))
    fresh = scanned.join(old, key, "left").withColumns(
        {
            "asset_id": F.coalesce("o_id", "asset_id"),
            "revision": F.coalesce(F.col("o_revision") + F.when(same, 0).otherwise(1), F.lit(1)).cast("long"),
            "state": F.coalesce("o_state", F.lit("ACTIVE")),
            "fingerprint_status": F.when(same, F.col("o_status")).otherwise(F.lit("PENDING")),
            "last_seen_scan": F.lit(scan),
        }
    )
    return state.join(scanned.select(*key), key, "left_anti").unionByName(fresh.select(*state.columns))


def request_states(state: DataFrame, requests: DataFrame) -> DataFrame:
    """state after mark and restore requests (asset_id, action); a changed row's revision grows by one."""
    wanted = requests.groupBy("asset_id").agg(F.max(F.when(F.col("action") == MARK, 1).otherwise(0)).alias("q_mark"), F.max(F.when(F.col("action") == RESTORE, 1).otherwise(0)).alias("q_restore"))
    rows = state.join(wanted, "asset_id", "left")
    marked = (F.coalesce("q_mark", F.lit(0)) == 1) & (F.col("state") == "ACTIVE")
    held = marked | (F.col("state") == "DELETE_PENDING")
    restored = (F.coalesce("q_restore", F.lit(0)) == 1) & held
    return rows.withColumns(
        {
            "revision": F.col("revision") + F.when(marked, 1).otherwise(0) + F.when(restored, 1).otherwise(0),
            "fingerprint_status": F.when(restored, F.lit("PENDING")).otherwise(F.col("fingerprint_status")),
            "state": F.when(restored, F.lit("ACTIVE")).when(marked, F.lit("DELETE_PENDING")).otherwise(F.col("state")),
        }
    ).select(*state.columns)


def is_stale(owner: str | None, session: str | None, own_session: str, age_ms: int) -> bool:
    """Whether pending deletions were left behind: no owner, another session, or ten minutes old."""
    return owner is None or session != own_session or age_ms >= STALE_MS


def recover(state: DataFrame) -> DataFrame:
    """All pending deletions undone."""
    pending = F.col("state") == "DELETE_PENDING"
    return state.withColumns({"revision": F.col("revision") + F.when(pending, 1).otherwise(0), "fingerprint_status": F.when(pending, "PENDING").otherwise(F.col("fingerprint_status")), "state": F.when(pending, "ACTIVE").otherwise(F.col("state"))})


def without_assets(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """fingerprints, edges and items without the assets; then items without groups that are left with one."""
    ids = gone.select("asset_id")
    out = dict(tables)
    if "fingerprints" in out:
        out["fingerprints"] = out["fingerprints"].join(ids, "asset_id", "left_anti")
    if "edges" in out:
        out["edges"] = without_edges(out["edges"], ids)
    if "items" in out:
        left = out["items"].join(ids, "asset_id", "left_anti")
        full = left.groupBy("category", "group_id").count().where("count > 1").select("category", "group_id")
        out["items"] = left.join(full, ["category", "group_id"], "left_semi")
    return out


def without_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of the assets."""
    return edges.join(ids, F.col("first_asset_id") == F.col("asset_id"), "left_anti").join(ids, F.col("second_asset_id") == F.col("asset_id"), "left_anti")


def finalize(state: DataFrame, requested: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Edges of the requested assets go in any case, the assets (and what hangs on them) only where pending."""
    gone = state.join(requested.select("asset_id"), "asset_id", "left_semi").where("state = 'DELETE_PENDING'")
    out = without_assets(gone, tables)
    if "edges" in out:
        out["edges"] = without_edges(out["edges"], requested.select("asset_id"))
    return state.join(gone.select("asset_id"), "asset_id", "left_anti"), out


def sweep(state: DataFrame, scan: str, full_scan: bool, full_access: bool, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """After a full scan with full access, rows that it did not see go, but for pending deletions."""
    if not (full_scan and full_access):
        return state, tables
    unseen = state.where((F.col("state") != "DELETE_PENDING") & (F.col("last_seen_scan").isNull() | (F.col("last_seen_scan") != scan)))
    return state.join(unseen.select("asset_id"), "asset_id", "left_anti"), without_assets(unseen, tables)


def committed(results: DataFrame, state: DataFrame) -> DataFrame:
    """Results (asset_id, revision, ...) of fingerprinting that may be written: the row is active and unchanged since."""
    now = state.where("state = 'ACTIVE'").select("asset_id", "revision")
    return results.join(now, ["asset_id", "revision"], "left_semi")


def replaced(fingerprints: DataFrame, results: DataFrame) -> DataFrame:
    """fingerprints with results in place of older ones."""
    return fingerprints.join(results.select("asset_id"), "asset_id", "left_anti").unionByName(results.select(*fingerprints.columns))
