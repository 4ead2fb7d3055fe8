"""From groups to what is shown: group statistics, ungrouped assets, the best copy, pages, roll-up, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift import schema
from twinsift.operators import ranks

# For each product category its kinds and its group category.
PRODUCT = {
    "SIMILAR": (["PHOTO"], "SIMILAR"),
    "DUPLICATES": (["PHOTO", "SCREENSHOT"], "DUPLICATE"),
    "SIMILAR_SCREENSHOTS": (["SCREENSHOT"], "SIMILAR"),
    "SIMILAR_VIDEOS": (["VIDEO", "SCREEN_RECORDING"], "SIMILAR"),
    "OTHER_SCREENSHOTS": (["SCREENSHOT"], "OTHER"),
    "OTHER_VIDEOS": (["VIDEO", "SCREEN_RECORDING"], "OTHER"),
    "OTHER": (["PHOTO"], "OTHER"),
}


def latest() -> Column:
    return F.max(F.greatest(F.col("created_at_ms"), F.col("date_added_s") * 1000))


def active(assets: DataFrame) -> DataFrame:
    return assets.where("state = 'ACTIVE'")


def group_stats(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Of each group with two or more active members: number, size, oldest, latest."""
    rows = items.select("category", F.col("kind").alias("group_kind"), "group_id", "asset_id").join(active(assets), "asset_id")
    return rows.groupBy("category", "group_kind", "group_id").agg(F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"), F.min("created_at_ms").alias("oldest_ms"), latest().alias("latest_ms")).where("items > 1")


def group_list(stats: DataFrame, n: int | None = None) -> DataFrame:
    """Groups as listed: by category, the most members and the latest first."""
    out = stats.orderBy("category", F.desc("items"), F.desc("latest_ms"), "group_id")
    return out.limit(n) if n is not None else out


def ungrouped(assets: DataFrame, items: DataFrame, kinds: list[str], excluded: list[str], chat: str = "ANY") -> DataFrame:
    """Active assets of the kinds that are in no group of the excluded categories; chat: ANY, ONLY or NON chat media."""
    rows = active(assets).where(F.col("kind").isin(kinds)).join(items.where(F.col("category").isin(excluded)).select("asset_id"), "asset_id", "left_anti")
    if chat != "ANY":
        rows = rows.where(F.col("chat_source").isNotNull() if chat == "ONLY" else F.col("chat_source").isNull())
    return rows


def others(assets: DataFrame, items: DataFrame) -> DataFrame:
    """Ungrouped assets of all kinds with the kind they are listed under; videos are excluded by similar groups only."""
    images = ungrouped(assets, items, ["PHOTO", "SCREENSHOT"], ["SIMILAR", "DUPLICATE"])
    clips = ungrouped(assets, items, ["VIDEO", "SCREEN_RECORDING"], ["SIMILAR"])
    return images.withColumn("group_kind", F.col("kind")).unionByName(clips.withColumn("group_kind", F.lit("VIDEO")))


def other_stats(assets: DataFrame, items: DataFrame) -> DataFrame:
    return others(assets, items).groupBy("group_kind").agg(F.count("*").alias("items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(latest(), F.lit(0)).alias("latest_ms"))


def page(assets: DataFrame, size: int, number: int) -> DataFrame:
    """A page of assets, newest first."""
    rows = assets.orderBy(F.desc("created_at_ms"), F.desc("date_added_s"), F.desc("media_store_id"))
    return rows.offset(size * number).limit(size)


def deep_page(assets: DataFrame, size: int, number: int) -> DataFrame:
    """The same page within each kind, with places; of the ordered listing only the parts that hold the page are read."""
    return ranks.listing(assets, ["kind"], [F.desc(c) for c in TIME]).between(size * number + 1, size * (number + 1))


def page_after(assets: DataFrame, size: int, last: dict | None = None) -> DataFrame:
    """The next page of assets, newest first, after the last row of the page before (None: the first page)."""
    return ranks.after(assets, [(c, True) for c in TIME], last, size)


BEST = [F.desc, ("quality_score", "is_favorite", "is_edited", "pixels", "size_bytes", "created_at_ms")]
TIME = ("created_at_ms", "date_added_s", "media_store_id")


def ranked_items(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Active members with place 1 for the best of each group, then the newest first. assets need quality_score."""
    rows = items.select("category", F.col("kind").alias("group_kind"), "group_id", "asset_id").join(active(assets).withColumn("pixels", F.col("width").cast("long") * F.col("height")), "asset_id")
    group = Window.partitionBy("category", "group_id")
    best = F.row_number().over(group.orderBy(*(F.desc(c) for c in (*BEST[1], *TIME))))
    rows = rows.withColumn("is_best", best == 1).withColumn("n", F.count("*").over(group)).where("n > 1")
    return rows.withColumn("place", F.row_number().over(group.orderBy(F.desc("is_best"), *(F.desc(c) for c in TIME)))).drop("n", "pixels")


def previews(items: DataFrame, assets: DataFrame, n: int) -> DataFrame:
    """The first n members of each group."""
    return ranked_items(items, assets).where(F.col("place") <= n)


def similar_previews(items: DataFrame) -> DataFrame:
    """Similar items without assets that are duplicates of others."""
    duplicates = items.where("category = 'DUPLICATE'").select("asset_id")
    return items.where("category = 'SIMILAR'").join(duplicates, "asset_id", "left_anti")


def default_selection(items: DataFrame, assets: DataFrame) -> DataFrame:
    """All but the best of each group."""
    return ranked_items(items, assets).where(~F.col("is_best"))


def selection_totals(selected: DataFrame) -> DataFrame:
    """What deleting the selection would free; an asset counts once."""
    once = selected.groupBy("asset_id").agg(F.max("size_bytes").alias("size_bytes"))
    return once.agg(F.count("*").alias("items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def product_dimension(spark) -> DataFrame:
    rows = [(i, name, kind, PRODUCT[name][1]) for i, name in enumerate(schema.PRODUCT_CATEGORIES) for kind in PRODUCT[name][0]]
    return spark.createDataFrame(rows, "position int, product string, group_kind string, category string")


def category_rollup(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Always seven rows in their fixed order: groups, assets, bytes, latest."""
    stats = group_stats(items, assets).groupBy("category", "group_kind").agg(F.count("*").alias("groups"), F.sum("items").alias("items"), F.sum("bytes").alias("bytes"), F.max("latest_ms").alias("latest_ms"))
    rest = other_stats(assets, items).select(F.lit("OTHER").alias("category"), "group_kind", F.lit(1).cast("long").alias("groups"), "items", "bytes", "latest_ms")
    joined = F.broadcast(product_dimension(items.sparkSession)).join(stats.unionByName(rest), ["category", "group_kind"], "left")  # seven categories
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return joined.groupBy("position", "product").agg(zero("groups"), zero("items"), zero("bytes"), F.coalesce(F.max("latest_ms"), F.lit(0)).alias("latest_ms"))


def merged(live: DataFrame, cached: DataFrame) -> DataFrame:
    """Per product category the live row where it holds anything, else the cached one."""
    a = live.where("items > 0")
    return a.unionByName(cached.join(a.select("product"), "product", "left_anti").select(*a.columns))


def category_groups(stats: DataFrame) -> DataFrame:
    """Groups with their place in the category, the latest first."""
    return ranks.listing(stats, ["category", "group_kind"], [F.desc("latest_ms"), F.desc("group_id")]).all()


def display_order(assets: DataFrame) -> DataFrame:
    """Assets with their place among those of their kind, as displayed."""
    shown = F.greatest("created_at_ms", F.col("date_added_s") * 1000)
    return ranks.listing(assets, ["kind"], [F.desc(shown), F.desc("created_at_ms"), F.desc("media_store_id")]).all()


def scalar_counts(items: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: all groups, and active assets."""
    groups = items.select("category", "kind", "group_id").distinct().agg(F.count("*").alias("groups"))
    return groups.crossJoin(active(assets).agg(F.count("*").alias("active_assets")))  # one row with one row


def group_totals(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Of each group, whatever the state of its members: number, size, latest."""
    rows = items.select("category", F.col("kind").alias("group_kind"), "group_id", "asset_id").join(assets, "asset_id")
    return rows.groupBy("category", "group_kind", "group_id").agg(F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"), latest().alias("latest_ms"))
