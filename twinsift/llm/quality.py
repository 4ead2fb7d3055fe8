"""Quality rules (operator 9): counts by rule, then a hashed n-gram log-likelihood ratio.

An n-gram is a run of `order` neighbouring words in one of two forms, hashed into `buckets`: the words whole,
and their shapes, where each run of letters is one sign that tells how it is cased and each run of digits another, while
marks stay as they are (so "Whole", "whole", "WHOLE!!" and "who$$$" are different and "whole", "other" are not). Two
multinomials over the buckets are counted: one over the trusted documents (labels.quality = 1), one over
every document. A document's score is the mean log ratio of the two
over its n-grams, so length does not matter; it is kept when the score reaches a threshold that the
trusted documents' own scores fix: their mean less `z` standard deviations, never above 0.

Everything is DataFrame functions: no Python runs on the executors.

Defined cases: null and empty texts have no words and fail the base rules (n_words < 50); texts
shorter than the order have score 0; an empty table gives an empty result; repeated rows are judged
alike, each on its own; without any trusted document every score is 0 and the base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import double_array, words

ORDER, BUCKETS, Z = 2, 1 << 14, 4.0
SENT = 1 << 20  # trusted ids that are broadcast; more are merged with the documents
SHORT = 1 << 12  # words up to which a window's hash (51 bits) and number share one long


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with q_words (array) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, n = F.col("q_words"), F.col("n_words").cast("int")
    three = lambda i: F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    every = F.sequence(F.lit(0), n - 3)
    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    same_words = lambda i, j: three(i).eqNullSafe(three(j))
    # Short texts: a window's hash with its number in the low bits; one primitive sort brings equal windows together.
    low = (1 << SHORT.bit_length()) - 1
    packed = F.transform(every, lambda i: hashed(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    number = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    s = F.col("q_sorted")
    alike = lambda x, y: F.coalesce((x.bitwiseXOR(y) >= 0) & (x.bitwiseXOR(y) <= low), F.lit(False)) & same_words(number(x), number(y))
    again = F.transform(F.filter(s, lambda x, i: alike(x, F.get(s, i - 1)) | alike(x, F.get(s, i + 1))), lambda x: number(x).cast("long"))
    # Long texts: whole hashes beside the numbers.
    pairs = F.transform(every, lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))
    t_ = F.col("q_pairs")
    alike_ = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)) & same_words(x["i"], y["i"])
    again_ = F.transform(F.filter(t_, lambda x, i: alike_(x, F.get(t_, i - 1)) | alike_(x, F.get(t_, i + 1))), lambda x: x["i"].cast("long"))
    at = F.sort_array(F.when(F.col("n_words") <= SHORT, again).otherwise(again_))
    none = F.expr("cast(array() as array<bigint>)")
    no_pairs = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return (
        docs.withColumn("q_words", words(F.col(text)))
        .withColumn("q_lines", lines)
        .withColumns(
            {
                "n_words": F.size("q_words").cast("long"),
                "word_chars": F.length(F.array_join("q_words", "")).cast("long"),
                "n_symbols": (F.size(F.split(t, r"[#*$%&|<>]")) - 1).cast("long"),
                "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            }
        )
        .drop("q_lines")
        .withColumn("q_sorted", F.when(F.col("n_words").between(3, SHORT), F.sort_array(packed)).otherwise(none))
        .withColumn("q_pairs", F.when(F.col("n_words") > SHORT, F.sort_array(pairs)).otherwise(no_pairs))
        .withColumn("n_repeat_words", F.when(F.col("n_words") >= 3, covered).otherwise(F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("q_sorted", "q_pairs")
    )


def shape(text: Column) -> Column:
    """How a text is written: runs of capitals, of other letters and of digits are one sign each; all else stays."""
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{L}&&[^A]]+", "a"), (r"[0-9]+", "0")):
        text = F.regexp_replace(text, pattern, sign)
    return text


def _bucket(form: str, x: Column, i: Column, order: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(form), *(F.get(x, i + k) for k in range(order))), F.lit(buckets)).cast("int")


def grams(w: Column, shapes: Column, order: int, buckets: int) -> Column:
    """Buckets of each run of whole words, then of each run of their shapes."""
    n = F.size(w) - order
    run = lambda form, x: F.transform(F.sequence(F.lit(0), n), lambda i: _bucket(form, x, i, order, buckets))
    return F.when(n >= 0, F.concat(run("word", w), run("shape", shapes))).otherwise(F.expr("cast(array() as array<int>)"))


def prepared(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """docs without the text, with the base counts and q_grams: once stored, all that fit_prepared() and judge_prepared() read."""
    out = base_counts(docs).withColumn("q_shapes", words(shape(F.col("text"))))
    return out.withColumn("q_grams", grams(F.col("q_words"), F.col("q_shapes"), order, buckets)).drop("q_words", "q_shapes", "text")


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, buckets: int = BUCKETS, z: float = Z) -> dict:
    """The model of fit_prepared() from texts, which are read anew where their n-grams are wanted."""
    w = _marked(docs, "text", labels).select("q_trusted", words(F.col("text")).alias("q_words"), words(shape(F.col("text"))).alias("q_shapes"))
    return _fitted(w.select("q_trusted", grams(F.col("q_words"), F.col("q_shapes"), order, buckets).alias("q_grams")), order, buckets, z)


def fit_prepared(ready: DataFrame, labels: DataFrame, order: int = ORDER, buckets: int = BUCKETS, z: float = Z) -> dict:
    """Weights by bucket and the threshold, from all trusted documents and all rows."""
    return _fitted(_marked(ready, "q_grams", labels), order, buckets, z)


def _marked(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """The column of each row, and q_trusted: 1 for trusted documents."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("q_id")).distinct().withColumn("q_trusted", F.lit(1))
    trusted = trusted.hint("broadcast" if trusted.count() <= SENT else "merge")
    return rows.select("doc_id", column).join(trusted, F.col("doc_id") == F.col("q_id"), "left").select(column, F.coalesce("q_trusted", F.lit(0)).alias("q_trusted"))


def _fitted(w: DataFrame, order: int, buckets: int, z: float) -> dict:
    # Not explode(): its filter of empty arrays would be pushed into the n-grams, and each of them would cut the text into words anew.
    found = w.select("q_trusted", F.explode_outer("q_grams").alias("g")).where("g is not null")
    counts = found.groupBy("g").agg(F.count("*").alias("raw"), F.sum("q_trusted").alias("good")).collect()  # at most `buckets` rows
    raw, good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    weights = [0.0] * buckets
    if good:
        weights = [math.log((raw + buckets) / (good + buckets))] * buckets
        for r in counts:
            weights[r["g"]] = math.log((r["good"] + 1) / (good + buckets)) - math.log((r["raw"] + 1) / (raw + buckets))
    model = {"order": order, "buckets": buckets, "weights": weights, "threshold": 0.0}
    own = w.where("q_trusted = 1").select(mean_weight(F.col("q_grams"), model).alias("s")).agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    if good and own["m"] is not None:
        model["threshold"] = min(0.0, own["m"] - z * own["d"])
    return model


def mean_weight(found: Column, model: dict) -> Column:
    """The mean weight of n-grams that are at hand as an array."""
    weights = double_array(model["weights"])
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, g: a + F.get(weights, g)) / F.size(found)).otherwise(F.lit(0.0))


def score(w: Column, shapes: Column, model: dict) -> Column:
    """The mean weight of the n-grams, added up without an array of them."""
    weights, order, buckets = double_array(model["weights"]), model["order"], model["buckets"]
    n = F.size(w) - order
    weight = lambda form, x, i: F.get(weights, _bucket(form, x, i, order, buckets))
    total = F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda a, i: a + weight("word", w, i) + weight("shape", shapes, i))
    return F.when(n >= 0, total / (2 * (n + 1))).otherwise(F.lit(0.0))


def judge(docs: DataFrame, model: dict) -> DataFrame:
    """docs with the base counts, quality_score and kept. A clashing column is replaced by the operator's own; others stay.

    To filter by kept, use accepted(): a filter right on this would be pushed into the nested expressions.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"]
    own = [c for c in docs.columns if c not in made]
    out = base_counts(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("q_doc"), "text"))
    out = out.withColumn("q_shapes", words(shape(F.col("text")))).withColumn("quality_score", score(F.col("q_words"), F.col("q_shapes"), model))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= F.lit(model["threshold"])))
    return out.select("q_doc.*", *made)


def judge_prepared(ready: DataFrame, model: dict) -> DataFrame:
    """Rows of prepared() with quality_score and kept in place of q_grams."""
    out = ready.withColumn("quality_score", mean_weight(F.col("q_grams"), model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= F.lit(model["threshold"]))).drop("q_grams")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    # The row number keeps the filter above the projection: pushed below it, it would repeat every nested expression.
    judged = judge(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_own"), "text"), model).select("q_own", "kept", F.monotonically_increasing_id().alias("q_row"))
    return judged.where("kept and q_row >= 0").select("q_own.*")
