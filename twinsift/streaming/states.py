"""The life of assets as keyed state of a stream: requests, guarded commits and the recovery of forgotten deletions.

Events (EVENT) of an asset carry growing event_ids, and times that do not fall. The state of an asset is its row and the last
event_id, in the state store; a change is one row of the log that the stream writes. What the rules say of each action:

    seen          a new asset is ACTIVE with revision 1; another signature adds 1 to the revision and asks for a new fingerprint
    commit        a fingerprint is taken only if the asset is ACTIVE and still has the revision that the event names
    mark_pending  ACTIVE becomes DELETE_PENDING, revision + 1
    restore       DELETE_PENDING becomes ACTIVE, revision + 1, and asks for a new fingerprint; so does recover (another session began)
    finalize      DELETE_PENDING becomes DELETED; an asset that is seen again goes on with the next revision

A pending deletion is recovered ten minutes after its mark, at once if the mark has no session: by a timer when the watermark
passes that time, or before an event that is not earlier than it. So the result does not depend on how events fall into batches.

Defined cases: an event whose event_id is not above the asset's last one is a replay and changes nothing (it is not in the log);
events without asset_id, event_id, at or action are left out; other actions, and requests for an asset that was never seen, are refused; an event more than
`delay` older than the latest one is dropped by Spark, which counts it in the progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from twinsift.operators.lifecycle import FINALIZE, MARK, RESTORE, STALE_MS
from twinsift.storage import exists

EVENT = "asset_id long, event_id long, at timestamp, action string, revision long, session string, source_signature string, image_hash long"
LOG = "asset_id long, n long, event_id long, at_ms long, action string, accepted boolean, state string, revision long, fingerprint_status string, image_hash long"
ROW = "n long, event_id long, state string, revision long, fingerprint_status string, source_signature string, image_hash long, due_ms long"
SEEN, COMMIT, RECOVER, RECOVERED = "seen", "commit", "recover", "recover_stale"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def after(row: dict, event: dict) -> tuple[dict, bool]:
    """The row after an event and whether the event was accepted."""
    action, state = event["action"], row["state"]
    active, pending = state == "ACTIVE", state == "DELETE_PENDING"
    again = {"state": "ACTIVE", "revision": row["revision"] + 1, "fingerprint_status": "PENDING", "due_ms": None}
    if action == SEEN:
        signature = event["source_signature"]
        if state in (None, "DELETED"):
            return row | again | {"source_signature": signature, "image_hash": None}, True
        changed = signature is None or signature != row["source_signature"]
        return row | ({"revision": row["revision"] + 1, "fingerprint_status": "PENDING", "source_signature": signature} if changed else {}), True
    if action == COMMIT and active and event["revision"] == row["revision"]:
        return row | {"fingerprint_status": "DONE", "image_hash": event["image_hash"]}, True
    if action == MARK and active:
        due = event["at_ms"] + (STALE_MS if event["session"] is not None else 0)
        return row | {"state": "DELETE_PENDING", "revision": row["revision"] + 1, "due_ms": due}, True
    if action in (RESTORE, RECOVER, RECOVERED) and pending:
        return row | again, True
    if action == FINALIZE and pending:
        return row | {"state": "DELETED", "due_ms": None}, True
    return row, False


def _change(event: dict, row: dict, accepted: bool) -> dict:
    return {"event_id": event.get("event_id"), "at_ms": event["at_ms"], "action": event["action"], "accepted": accepted} | {c: row[c] for c in ("n", "state", "revision", "fingerprint_status", "image_hash")}


def fold(row: dict, events: list[dict]) -> tuple[dict, list[dict]]:
    """The row after an asset's events in order of event_id, and the changes as rows of the log."""
    log = []

    def apply(event: dict) -> None:
        nonlocal row
        row, accepted = after(row, event)
        row = row | {"n": row["n"] + 1}
        log.append(_change(event, row, accepted))

    for event in sorted(events, key=lambda e: e["event_id"]):
        if row["event_id"] is not None and event["event_id"] <= row["event_id"]:
            continue
        if row["due_ms"] is not None and event["at_ms"] >= row["due_ms"]:
            apply({"at_ms": row["due_ms"], "action": RECOVERED})
        apply(event)
        row = row | {"event_id": event["event_id"]}
    return row, log


UNSEEN = {"n": 0, "event_id": None, "state": None, "revision": 0, "fingerprint_status": None, "source_signature": None, "image_hash": None, "due_ms": None}
FIELDS = list(UNSEEN)
COLUMNS = [c.split()[0] for c in LOG.split(", ")]


class AssetStates(StatefulProcessor):
    """One row of state for each asset and at most one timer, of its pending deletion."""

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", ROW)

    def _read(self) -> dict:
        found = self.row.get()
        return UNSEEN if found is None else dict(zip(FIELDS, found, strict=True))

    def _write(self, old: dict, new: dict) -> None:
        if old["due_ms"] != new["due_ms"]:
            if old["due_ms"] is not None:
                self.handle.deleteTimer(old["due_ms"])
            if new["due_ms"] is not None:
                self.handle.registerTimer(new["due_ms"])
        self.row.update(tuple(new[c] for c in FIELDS))

    def _out(self, key, change: dict) -> Row:
        return Row(**{c: key[0] if c == "asset_id" else change[c] for c in COLUMNS})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self._read()
        new, log = fold(old, [r.asDict() for r in rows])
        if log:
            self._write(old, new)
        for change in log:
            yield self._out(key, change)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = self._read()
        if row["due_ms"] is not None and row["due_ms"] <= expiredTimerInfo.getExpiryTimeInMs():
            new, accepted = after(row, {"action": RECOVERED, "at_ms": row["due_ms"]})
            new = new | {"n": row["n"] + 1}
            self.row.update(tuple(new[c] for c in FIELDS))  # the timer is gone
            yield self._out(key, _change({"at_ms": row["due_ms"], "action": RECOVERED}, new, accepted))

    def close(self) -> None:
        pass


def state_changes(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The log (LOG) of a stream of events (EVENT; other columns are not read)."""
    rows = events.where("asset_id is not null and event_id is not null and at is not null and action is not null").withWatermark("at", delay)
    rows = rows.select("asset_id", "at", F.unix_millis("at").alias("at_ms"), "event_id", "action", "revision", "session", "source_signature", "image_hash")
    return rows.groupBy("asset_id").transformWithState(AssetStates(), LOG, "append", "eventTime")


def stream_states(spark: SparkSession, source: str, log: str, checkpoint: str, delay: str = "1 minute", every: str | None = None, files_per_batch: int | None = None):
    """A streaming query from a folder of events to the folder `log`; a batch is written under its number, so a replay overwrites itself.

    every: how often new files are taken; by default what is there is taken once. States lie in the checkpoint, so a later start goes on."""
    reader = spark.readStream.schema(EVENT)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # the query keeps the settings of its start
    try:
        return state_changes(rows, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(PROVIDER, before)


def current(spark: SparkSession, log: str) -> DataFrame:
    """The assets as the log leaves them: one aggregation by asset, the last change counts; deleted ones and those never seen are not there."""
    rows = spark.read.schema(LOG).parquet(log) if exists(spark, log) else spark.createDataFrame([], LOG)
    last = rows.groupBy("asset_id").agg(F.max_by(F.struct("state", "revision", "fingerprint_status", "image_hash"), "n").alias("r")).select("asset_id", "r.*")
    return last.where("state <> 'DELETED'")
