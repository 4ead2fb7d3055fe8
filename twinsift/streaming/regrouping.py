"""Groups kept up to date in a stream: only what a batch changes is visited again.

Groups are the lexicographically first independent set (operators/grouping.py): whether an asset is an anchor depends on
its earlier neighbours only. After inserts and deletes the assets whose neighbours came or went are visited in the order of
ranks: one that waits for no earlier one is decided anew, and if its answer changes, its later neighbours are visited
too. A long chain of changes would take a round for each link: after ROUNDS rounds the components that hold what is
left are grouped as a whole. Then the members next to changed anchors choose their group again. The groups are those of a
full rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators import categories, grouping, joins
from twinsift.operators.graph import components
from twinsift.storage import discard, exists, kept
from twinsift.streaming.incremental import incremental_edges

ROUNDS = 6
ASSET = "asset_id long, kind string, state string, size_bytes long, width int, height int, is_edited boolean, image_hash long, color_hash array<double>, created_at_ms long, date_added_s long"
STATE = ASSET + ", live boolean, is_anchor boolean, group_id long, visited boolean"


def regrouped(nodes: DataFrame, edges: DataFrame, touched: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(asset_id, is_anchor, group_id, visited) of the nodes after a change; an anchor without members is its own group.

    nodes: asset_id, order, and as they were before the change is_anchor and group_id (null for new ones). edges
    (first_asset_id, second_asset_id): those between nodes, after the change. touched (asset_id): at least the new nodes and those
    whose edges came or went. visited: whether the answer was looked at again."""
    a = nodes.select(F.col("asset_id").alias("u"), F.col("order").alias("u_order"))
    b = nodes.select(F.col("asset_id").alias("v"), F.col("order").alias("v_order"))
    both = edges.select(F.col("first_asset_id").alias("u"), F.col("second_asset_id").alias("v")).where("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    arcs = kept(both.join(a, "u").join(b, "v"), "stream-arcs")
    earlier = arcs.where("v_order < u_order").select("u", "v")
    base = kept(nodes.select("asset_id", "order", F.coalesce("is_anchor", F.lit(False)).alias("was"), "group_id"), "stream-base")
    first = kept(touched.select("asset_id").distinct().join(base.select("asset_id"), "asset_id", "left_semi"), "stream-dirty")
    # What is decided so far: the base, overlaid by `seen`.
    dirty, seen, done = first, kept(base.select("asset_id", F.col("was").alias("now")).limit(0), "stream-seen"), 0
    while not dirty.isEmpty():
        if done >= rounds:
            roots = kept(components(arcs.select("u", "v")), "stream-roots")
            hit = roots.join(dirty, F.col("node") == F.col("asset_id"), "left_semi").select("root").distinct()
            whole = kept(roots.join(hit, "root").select(F.col("node").alias("asset_id")), "stream-whole")
            inside = edges.join(whole, F.col("first_asset_id") == F.col("asset_id"), "left_semi")
            found = grouping.anchor_groups(base.select("asset_id", "order"), inside).select("asset_id", "is_anchor")
            # Those in no group of two have all their neighbours in other groups: anchors of none.
            rest = whole.join(found, "asset_id", "left").select("asset_id", F.coalesce("is_anchor", F.lit(True)).alias("now"))
            alone = dirty.join(whole, "asset_id", "left_anti").select("asset_id", F.lit(True).alias("now"))
            seen = kept(seen.join(rest, "asset_id", "left_anti").unionByName(rest).join(alone, "asset_id", "left_anti").unionByName(alone), "stream-seen")
            break
        now = base.join(seen, "asset_id", "left").select("asset_id", F.coalesce("now", "was").alias("is_anchor"))
        around = earlier.join(dirty, F.col("u") == F.col("asset_id"), "left_semi")
        around = around.join(now.where("is_anchor").select(F.col("asset_id").alias("x")), F.col("v") == F.col("x"), "left").join(dirty.select(F.col("asset_id").alias("y")), F.col("v") == F.col("y"), "left")
        marks = around.groupBy(F.col("u").alias("asset_id")).agg(F.max(F.col("x").isNotNull()).alias("covered"), F.max(F.col("y").isNotNull()).alias("waits"))
        ready = dirty.join(marks, "asset_id", "left").where(~F.coalesce("waits", F.lit(False))).select("asset_id", (~F.coalesce("covered", F.lit(False))).alias("now"))
        ready = kept(ready.join(now, "asset_id"), "stream-ready")
        flipped = ready.where(F.col("now") != F.col("is_anchor")).select("asset_id")
        later = earlier.join(flipped, F.col("v") == F.col("asset_id"), "left_semi").select(F.col("u").alias("asset_id"))
        last_dirty, last_seen = dirty, seen
        dirty = kept(dirty.join(ready, "asset_id", "left_anti").unionByName(later).distinct(), "stream-dirty")
        seen = kept(seen.join(ready, "asset_id", "left_anti").unionByName(ready.select("asset_id", "now")), "stream-seen")
        discard(ready, last_seen, *([last_dirty] if done else []))
        done += 1
    final = kept(base.join(seen, "asset_id", "left").select("asset_id", "order", F.coalesce("now", "was").alias("is_anchor"), "group_id", (F.coalesce("now", "was") != F.col("was")).alias("flipped"), F.col("now").isNotNull().alias("seen")), "stream-final")
    # Members choose again where an anchor beside them came or went, or their edges did.
    ids = final.where("flipped").select("asset_id")
    beside = arcs.join(ids, F.col("v") == F.col("asset_id"), "left_semi").select(F.col("u").alias("asset_id"))
    again = kept(first.unionByName(ids).unionByName(beside).unionByName(final.where("seen").select("asset_id")).distinct(), "stream-again")
    anchors = final.where("is_anchor").select(F.col("asset_id").alias("x"))
    best = arcs.join(again, F.col("u") == F.col("asset_id"), "left_semi").join(anchors, F.col("v") == F.col("x"), "left_semi").groupBy(F.col("u").alias("asset_id")).agg(F.min(F.struct("v_order", "v")).alias("best"))
    out = final.join(again.withColumn("visited", F.lit(True)), "asset_id", "left").join(best, "asset_id", "left")
    group = F.when(F.col("is_anchor"), F.col("asset_id")).when(F.col("visited"), F.col("best.v")).otherwise(F.col("group_id"))
    return out.select("asset_id", "is_anchor", group.alias("group_id"), F.coalesce("visited", F.lit(False)).alias("visited"))


def groups(state: DataFrame) -> DataFrame:
    """(kind, group_id, asset_id, is_anchor) of the groups of two or more."""
    live = state.where("live")
    several = live.groupBy("kind", "group_id").agg(F.count("*").alias("n")).where("n > 1").select("kind", "group_id")
    return live.join(several, ["kind", "group_id"], "left_semi").select("kind", "group_id", "asset_id", "is_anchor")


def items(state: DataFrame) -> DataFrame:
    """Items of the duplicate and similar groups, as grouping.image_items gives them."""
    twins = joins.duplicate_groups(state.drop("group_id")).select(F.lit("DUPLICATE").alias("category"), "kind", "group_id", "asset_id", (F.col("asset_id") == F.col("group_id")).alias("is_anchor"))
    return twins.unionByName(groups(state).select(F.lit("SIMILAR").alias("category"), "kind", "group_id", "asset_id", "is_anchor"))


def _step(state: DataFrame, edges: DataFrame, batch: DataFrame, kinds: tuple[str, ...], rounds: int, edges_path: str) -> DataFrame:
    """The next state, after a batch of assets that are new, deleted or restored."""
    spark, fields = state.sparkSession, [f.split()[0] for f in ASSET.split(", ")]
    # Of several rows of an asset in one batch a deletion counts.
    batch = kept(batch.groupBy("asset_id").agg(F.max_by(F.struct(*fields), F.struct(F.col("state") != "ACTIVE", F.xxhash64(*fields))).alias("row")).select("row.*"), "stream-batch")
    fresh = kept(batch.join(state.select("asset_id"), "asset_id", "left_anti").select(*fields), "stream-fresh")
    new = None
    for kind in kinds:
        # Whatever their state: an asset that comes back has its edges.
        part = incremental_edges(fresh.drop("state"), state.select(*fields).drop("state"), kind)
        new = part if new is None else new.unionByName(part)
    new.write.mode("overwrite").parquet(edges_path)
    pairs = edges.unionByName(spark.read.parquet(edges_path).select(*edges.columns))
    asked = batch.select("asset_id", F.col("state").alias("asked"))
    was = state.select(*fields, F.col("live").alias("was_live"), "is_anchor", "group_id").join(asked, "asset_id", "left").withColumn("state", F.coalesce("asked", "state")).drop("asked")
    empty = fresh.withColumns({"was_live": F.lit(False), "is_anchor": F.lit(None).cast("boolean"), "group_id": F.lit(None).cast("long")})
    rows = was.unionByName(empty)
    twins = joins.duplicate_groups(rows.drop("group_id")).select("asset_id").withColumn("twin", F.lit(True))
    live = (F.col("state") == "ACTIVE") & F.col("kind").isin(*kinds) & F.col("twin").isNull()
    rows = kept(rows.join(twins, "asset_id", "left").withColumn("live", live).drop("twin"), "stream-rows")
    alive = rows.where("live").select(F.col("asset_id").alias("id"))
    held = kept(pairs.join(alive, F.col("first_asset_id") == F.col("id"), "left_semi").join(alive, F.col("second_asset_id") == F.col("id"), "left_semi"), "stream-live")
    moved = kept(rows.where("live <> was_live").select(F.col("asset_id").alias("id")), "stream-moved")
    ends = [pairs.join(moved, F.col(x) == F.col("id"), "left_semi").select(F.col(y).alias("asset_id")) for x, y in (("first_asset_id", "second_asset_id"), ("second_asset_id", "first_asset_id"))]
    touched = moved.select(F.col("id").alias("asset_id")).unionByName(ends[0]).unionByName(ends[1])
    before = lambda c: F.when(F.col("was_live"), F.col(c)).alias(c)
    nodes = grouping.first_seen(rows.where("live")).join(rows.select("asset_id", before("is_anchor"), before("group_id")), "asset_id")
    found = regrouped(nodes, held, touched, rounds)
    return rows.drop("is_anchor", "group_id", "was_live").join(found, "asset_id", "left").withColumn("visited", F.coalesce("visited", F.lit(False)))


def stream_groups(spark: SparkSession, source: str, folder: str, checkpoint: str, kinds: tuple[str, ...] = ("PHOTO", "SCREENSHOT"), files_per_batch: int = 1, rounds: int = ROUNDS):
    """A streaming query over a folder of asset rows (ASSET): after each micro-batch its groups and seven category rows.

    A row of a new asset_id is an insert; a row of a known one sets its state (ACTIVE or not), its fingerprint stays. Under
    folder, by batch: state (STATE, all assets), edges (the new ones) and categories. A batch is written
    from those before it only, so that a replayed one overwrites itself with the same rows; states older than the one
    before are deleted. Groups are in the order in which assets were first seen, without duplicates of others, as in snapshot_groups.
    """

    def step(batch: DataFrame, number: int) -> None:
        at = lambda name, n: f"{folder}/{name}/batch={n}"
        state = spark.read.schema(STATE).parquet(at("state", number - 1)) if number and exists(spark, at("state", number - 1)) else spark.createDataFrame([], STATE)
        some = number and exists(spark, f"{folder}/edges")
        columns = "category string, kind string, first_asset_id long, second_asset_id long"
        edges = spark.read.schema(columns + ", batch long").parquet(f"{folder}/edges").where(F.col("batch") < number).drop("batch") if some else spark.createDataFrame([], columns)
        _step(state, edges, batch, kinds, rounds, at("edges", number)).select(*(f.split()[0] for f in STATE.split(", "))).write.mode("overwrite").parquet(at("state", number))
        new = spark.read.schema(STATE).parquet(at("state", number))
        categories.category_rollup(items(new), new.drop("group_id")).write.mode("overwrite").parquet(at("categories", number))
        if number > 1 and exists(spark, at("state", number - 2)):
            old = spark.read.schema(STATE).parquet(at("state", number - 2))
            old.kept_at = at("state", number - 2)
            discard(old)

    rows = spark.readStream.schema(ASSET).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
