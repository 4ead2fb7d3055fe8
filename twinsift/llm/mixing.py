"""Mixing sources to target weights (operator 8): budgets down a domain-language-source tree.

The target is a number of tokens. It goes down the tree level by level: the children of a node share its
budget by weight, and no child gets more than its whole subtree can give (its tokens times `epochs`). A
child that can't take its share leaves the rest to its siblings (by weight again, until the node's budget
is placed), so a shortage moves up only when all of the siblings are full. That is water filling: with the
children sorted by capacity over weight, those before a certain one are full and the others share what is
left; windows over each node's children find it in exact integers.

A leaf takes its documents in seeded orders: whole epochs as its budget allows, then of the next
epoch's own order the longest prefix whose tokens fit the budget. Orders are by the MD5 of seed, epoch,
doc_id and a hash of the text. A prefix is found without sorting a leaf: tokens are summed by slices
(the hash's first digits), the slice that holds the budget's end is found from the sums, and only its
rows are sorted.

Defined cases: a null domain, language or source is a leaf of its own name "null"; null and empty texts
have no tokens and come with the epoch they are in; a leaf without tokens takes no documents; equal rows
count each; weights not given are 1, weights of 0 get nothing; an empty table gives an empty result; other
columns are carried, but for names starting with `m_`, which are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import WORD, stored

SEED, EPOCHS, SHARE, DIGITS = 7, 3, 0.6, 3
WEIGHTS = {"m_domain": {"web0": 4, "web1": 3, "web2": 2, "web3": 1}, "m_lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "m_source": {}}
LEVELS = ["m_domain", "m_lang", "m_source"]
D = "decimal(38,0)"


def tokens(text: Column) -> Column:
    """Words of a text (long)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    """documents has no domain: sources fall into four by their number."""
    return F.concat(F.lit("web"), F.coalesce(F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("long") % 4, F.lit(0)).cast("string"))


def with_leaf(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c), F.lit("null"))
    return docs.withColumns({"m_domain": domain(F.col("source")), "m_lang": name("lang"), "m_source": name("source"), "m_tokens": tokens(F.col("text"))})


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast(D)


def budgets(leaves: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """leaves (the levels, m_have) with m_budget (long): tokens to take of each leaf."""
    sums = leaves
    can = leaves.withColumn("m_can", (F.col("m_have") * epochs).cast(D))
    total = leaves.agg(F.floor(F.coalesce(F.sum("m_have"), F.lit(0)) * F.lit(share)).cast("long")).first()[0]
    given = None
    for depth, level in enumerate(LEVELS):
        above = LEVELS[:depth]
        node = can.groupBy(*LEVELS[: depth + 1]).agg(F.sum("m_can").cast(D).alias("m_can")).withColumn("m_weight", weight(level, weights))
        node = node.withColumn("m_can", F.when(F.col("m_weight") == 0, F.lit(0)).otherwise(F.col("m_can")).cast(D))
        node = node.join(given, above) if above else node.withColumn("m_budget", F.lit(total).cast(D))
        filled = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        order = filled.orderBy(F.when(F.col("m_weight") == 0, F.lit(0.0)).otherwise(F.col("m_can").cast("double") / F.col("m_weight").cast("double")), level)
        upto = F.sum("m_can").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rest = F.sum("m_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        node = node.withColumns({"m_left": (F.col("m_budget") - F.coalesce(upto, F.lit(0))).cast(D), "m_rest": rest.cast(D)})
        # Full if its equal share of what is left is no less than it has.
        node = node.withColumn("m_full", F.col("m_can") * F.col("m_rest") <= F.col("m_weight") * F.col("m_left"))
        # The others share by weight what the full ones leave.
        node = node.withColumns(
            {
                "m_left": (F.col("m_budget") - F.coalesce(F.sum(F.when(F.col("m_full"), F.col("m_can"))).over(filled), F.lit(0))).cast(D),
                "m_rest": F.sum(F.when(~F.col("m_full"), F.col("m_weight"))).over(filled).cast(D),
            }
        )
        took = F.when(F.col("m_full"), F.col("m_can")).otherwise(F.expr(f"cast(m_weight * m_left div m_rest as {D})"))
        given = node.select(*LEVELS[: depth + 1], F.greatest(F.lit(0).cast(D), F.least(F.col("m_can"), took)).cast(D).alias("m_budget"))
    return sums.join(given, LEVELS).withColumn("m_budget", F.col("m_budget").cast("long"))


def mixed(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS, seed: int = SEED, digits: int = DIGITS) -> DataFrame:
    """The chosen rows of docs, with the levels, m_tokens and m_epoch; a row comes once for each epoch that takes it."""
    own = docs.columns
    marked = with_leaf(docs)
    ids = marked.select(*LEVELS, "m_tokens", F.col("doc_id").alias("m_id"), F.md5("text").alias("m_text"))
    narrow = stored(ids, "mix")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("m_tokens").alias("m_have"))
    plan = stored(budgets(leaves, share, epochs, weights).withColumns({"m_whole": F.when(F.col("m_have") > 0, F.floor(F.col("m_budget") / F.greatest(F.col("m_have"), F.lit(1)))).otherwise(0).cast("int")}).withColumn("m_part", F.col("m_budget") - F.col("m_whole") * F.col("m_have")), "mix-plan")
    key = lambda epoch, doc_id, text: F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("null"))))
    part = narrow.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, LEVELS).where("m_part > 0").withColumn("m_key", key(F.col("m_whole"), F.col("m_id"), F.col("m_text"))).withColumn("m_slice", F.substring("m_key", 1, digits))
    slices = part.groupBy(*LEVELS, "m_slice").agg(F.sum("m_tokens").alias("m_sum"), F.first("m_part").alias("m_part"))
    slices = slices.withColumn("m_before", F.coalesce(F.sum("m_sum").over(Window.partitionBy(*LEVELS).orderBy("m_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The slice in which the budget ends, of each leaf.
    ends = stored(slices.where("m_before <= m_part and m_before + m_sum > m_part").select(*LEVELS, F.col("m_slice").alias("m_end"), "m_before"), "mix-ends")
    inside = part.join(ends, LEVELS).where("m_slice = m_end")
    order = Window.partitionBy(*LEVELS, "m_slice").orderBy("m_key", "m_id", "m_text")
    upto = inside.withColumn("m_upto", F.col("m_before") + F.sum("m_tokens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    stop = upto.where("m_upto > m_part").groupBy(*LEVELS).agg(F.min("m_key").alias("m_stop"))
    stops = stored(plan.join(stop, LEVELS, "left").select(*LEVELS, "m_whole", "m_part", "m_stop"), "mix-stops")
    small = stops.count() <= 10_000
    rows = marked.join(F.broadcast(stops) if small else stops, LEVELS).withColumn("m_key", key(F.col("m_whole"), F.col("doc_id"), F.md5("text")))
    more = (F.col("m_part") > 0) & (F.col("m_stop").isNull() | (F.col("m_key") < F.col("m_stop")))
    times = F.col("m_whole") + F.when(more, 1).otherwise(0)
    taken = rows.where(times > 0).withColumn("m_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return taken.select(*own, *LEVELS, "m_tokens", "m_epoch")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), F.col("m_epoch").alias("epoch"), F.col("m_tokens").alias("n_tokens"))
