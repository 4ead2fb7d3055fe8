"""The life of assets as state of a stream, against a plain fold over each asset's events."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from twinsift.streaming import states

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BIG = (1 << 62) + 1  # not a double


def brute(events, end):
    """asset_id: (state, revision, status, hash) after all events, and the recovery of what is due by `end` minutes."""
    rows = {}
    for asset, _, minute, action, revision, session, signature, print_ in sorted(events, key=lambda e: (e[0], e[1])):
        r = rows.setdefault(asset, dict(s=None, v=0, f=None, sig=None, h=None, due=None))
        if r["due"] is not None and minute >= r["due"]:
            r.update(s="ACTIVE", v=r["v"] + 1, f="PENDING", due=None)
        if action == "seen":
            if r["s"] in (None, "DELETED"):
                r.update(s="ACTIVE", v=r["v"] + 1, f="PENDING", sig=signature, h=None)
            elif signature != r["sig"]:
                r.update(v=r["v"] + 1, f="PENDING", sig=signature)
        elif action == "commit" and r["s"] == "ACTIVE" and r["v"] == revision:
            r.update(f="DONE", h=print_)
        elif action == "mark_pending" and r["s"] == "ACTIVE":
            r.update(s="DELETE_PENDING", v=r["v"] + 1, due=minute + (10 if session else 0))
        elif action in ("restore", "recover") and r["s"] == "DELETE_PENDING":
            r.update(s="ACTIVE", v=r["v"] + 1, f="PENDING", due=None)
        elif action == "finalize" and r["s"] == "DELETE_PENDING":
            r.update(s="DELETED", due=None)
    for r in rows.values():
        if r["due"] is not None and r["due"] <= end:
            r.update(s="ACTIVE", v=r["v"] + 1, f="PENDING", due=None)
    return {a: (r["s"], r["v"], r["f"], r["h"]) for a, r in rows.items() if r["s"] not in (None, "DELETED")}


def write(spark, events, path):
    rows = [(a, e, START + timedelta(minutes=m), x, v, s, g, h) for a, e, m, x, v, s, g, h in events]
    spark.createDataFrame(rows, states.EVENT).coalesce(2).write.mode("append").parquet(path)


def test_stream_equals_a_fold_and_goes_on_after_a_restart(spark, tmp_path):
    rng, events, number = random.Random(4), [], defaultdict(int)

    def add(asset, minute, action, revision=None, session="a", signature=None, print_=None):
        number[asset] += 1
        events.append((asset, number[asset], minute, action, revision, session, signature, print_))

    for minute in range(30):
        for asset in range(12):
            if rng.random() < 0.5:
                action = rng.choice(("seen", "seen", "commit", "commit", "mark_pending", "mark_pending", "restore", "recover", "finalize", "unknown"))
                add(asset, minute, action, rng.randrange(1, 6), rng.choice(("a", None)), rng.choice("xy"), BIG + asset)
    add(50, 0, "seen", signature="x")
    add(50, 1, "mark_pending")  # no event follows: only the timer recovers it
    add(51, 0, "seen", signature="x")
    add(51, 29, "mark_pending")  # not due at the end
    add(52, 0, "seen", signature="x")
    add(52, 1, "mark_pending")
    add(52, 12, "commit", 1, print_=7)  # of the revision before the deletion: refused
    add(52, 13, "commit", 3, print_=BIG)
    add(53, 3, "restore")  # never seen
    place = lambda name: f"file://{tmp_path}/{name}"
    for low, high in ((0, 8), (8, 20), (20, 30)):  # each is a start on the same checkpoint
        part = [e for e in events if low <= e[2] < high]
        write(spark, part + rng.sample(part, 5), place("events"))  # some come twice
        states.stream_states(spark, place("events"), place("log"), place("checkpoint")).awaitTermination()
    found = {r["asset_id"]: tuple(r)[1:] for r in states.current(spark, place("log")).collect()}
    assert found == brute(events, 28)
    assert found[50] == ("ACTIVE", 3, "PENDING", None) and found[51][0] == "DELETE_PENDING" and found[52] == ("ACTIVE", 3, "DONE", BIG)
    log = spark.read.schema(states.LOG).parquet(place("log"))
    assert log.where("asset_id = 50 and action = 'recover_stale' and event_id is null").count() == 1
    assert log.where("asset_id = 52 and action = 'commit'").orderBy("n").select("accepted").toPandas()["accepted"].tolist() == [False, True]
    assert log.where("not accepted and action = 'unknown'").count() > 0
    # Events that came before change nothing.
    write(spark, [e for e in events if e[2] >= 28], place("events"))
    states.stream_states(spark, place("events"), place("log"), place("checkpoint")).awaitTermination()
    assert {r["asset_id"]: tuple(r)[1:] for r in states.current(spark, place("log")).collect()} == found
    assert spark.read.schema(states.LOG).parquet(place("log")).count() == log.count()


def test_nothing_to_do(spark, tmp_path):
    place = lambda name: f"file://{tmp_path}/{name}"
    assert states.current(spark, place("log")).count() == 0
    spark.createDataFrame([(None, 1, START, "seen", None, None, None, None), (1, None, START, "seen", None, None, None, None), (1, 2, START, None, None, None, None, None)], states.EVENT).withColumn("extra", F.lit(1)).write.parquet(place("events"))
    states.stream_states(spark, place("events"), place("log"), place("checkpoint")).awaitTermination()
    assert states.current(spark, place("log")).count() == 0
