"""URL filters (operator 7): rules by host and path, then logistic regression on hashed character n-grams.

A rule (allow or block) fits its host and all subdomains where the url's path starts with the rule's
path; the longest rule wins. Urls that no rule fits are judged by a logistic regression on hashed
n-grams (3 to 5 characters) of host and path, trained from a small labelled table (at most `MOST`
rows; by default a table made by a rule, half of whose telling words stand in hosts and half in paths). Everything runs in the JVM: column functions, HashingTF and LogisticRegression.

Defined cases: a null url or one without "://" has an empty host and path and gets the method's
verdict (allow, as nothing speaks against it); an empty table gives an empty result; repeated rows are
judged alike; very long urls are used whole; other columns are carried, and the operator's own columns
replace columns of the same name.
"""

from __future__ import annotations

import itertools

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, MOST = 1 << 14, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The words of the labelled table: what unwanted and wanted sites call themselves, and names that say nothing.
UNWANTED = "casino poker slots jackpot betting sportsbet pills viagra pharmacy adult xxx escort cams spam clickbait adserver tracker banner warez crack payday lottery prizes winner replica".split()
WANTED = "library museum university weather garden recipes history science hospital council archive school theatre orchestra railway observatory botany chemistry physics philosophy poetry maps hiking chess carpentry market bakery".split()
NEUTRAL = "hartfield oakridge linwood marlow kestrel brightwater fenwick ashcombe dunmore westbrook larkspur copperhill quayside maplegrove silverbirch redstone holloway penrose elmhurst gladstone rosebank windmere farrow calder".split()
SYLLABLES = "bra cle dor fin gal hum kel mor nor pel quin ros sal tur vel wim".split()
PLAIN = ["/", "/index.html", "/en/1.html", "/2024/05/12/", "/page/3", "/de/345", "/a/b", "/fr/20/"]
HOST_FORMS, PATH_FORMS = ["{0}", "{0}-online", "best{0}", "{0}s-24", "the-{0}", "my-{0}-hub"], ["/{0}/", "/{0}-1.html", "/go/{0}s/2", "/new/{0}"]
FRONTS, ENDS = ["", "www.", "m.", "blog."], ["com", "net", "org", "example.com", "example.net", "example.org"]


def table_rows() -> list[tuple[str, float]]:
    """(url, blocked) by a rule: a telling word in the host before a plain path, or in the path after a neutral host; and neutral both.

    All else (subdomains, endings, plain paths, neutral names) goes round in turn, so that it comes with either label alike."""
    rows, n = [], 0
    for words_, blocked in ((UNWANTED, 1.0), (WANTED, 0.0)):
        for w in words_:
            for host, front in itertools.product(HOST_FORMS, FRONTS):
                rows.append((f"https://{front}{host.format(w)}.{ENDS[n % 6]}{PLAIN[n % 8]}", blocked))
                n += 1
            for path, end in itertools.product(PATH_FORMS, ENDS):
                rows.append((f"https://{FRONTS[n % 4]}{NEUTRAL[n % 24]}.{end}{path.format(w)}", blocked))
                n += 1
    names = NEUTRAL * 8 + [a + b for a in SYLLABLES for b in SYLLABLES]
    rows += [(f"https://{FRONTS[i % 4]}{name}.{ENDS[i % 6]}{PLAIN[(i + i // 8) % 8]}", 0.0) for i, name in enumerate(names)]
    # Where nothing is said, nothing is unwanted: this sets the intercept, so that plain n-grams need no weight of their own.
    return rows + [("", 0.0)] * 200


def labelled(spark: SparkSession) -> DataFrame:
    """The small table: (url, blocked)."""
    return spark.createDataFrame(table_rows(), "url string, blocked double")


def with_parts(df: DataFrame) -> DataFrame:
    """df with host and path."""
    part = lambda k: F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return df.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """n-grams of the marked host and path; each knows which of the two it is from."""
    def pieces(mark: str, text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.concat(F.lit(mark), F.substring(text, k, F.lit(n))))

    found = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), F.regexp_replace(path, "[0-9]", "0"), F.lit("$")))):
        for n in sizes:
            found.append(F.when(F.length(text) >= n, pieces(mark, text, n)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*found))


def features(df: DataFrame) -> DataFrame:
    """df with host, path and u_features."""
    return HashingTF(inputCol="u_grams", outputCol="u_features", numFeatures=BUCKETS, binary=True).transform(with_parts(df).withColumn("u_grams", grams(F.col("host"), F.col("path")))).drop("u_grams")


def fit(table: DataFrame, strength: float = 0.0002) -> LogisticRegressionModel:
    """table: (url, blocked 0 or 1), small. One partition, so the sums have one order."""
    rows = features(table.where("url is not null and blocked is not null").limit(MOST).coalesce(1)).select("u_features", F.col("blocked").cast("double").alias("label"))
    return LogisticRegression(featuresCol="u_features", regParam=strength, maxIter=50, standardization=False, aggregationDepth=2).fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, block_chance and verdict."""
    pages = pages.drop("host", "path", "rule", "verdict", "block_chance", "u_features", "u_grams")
    model = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol("u_probability")
    scored = model.transform(features(pages)).withColumn("block_chance", vector_to_array("u_probability")[1]).drop("u_features", "u_probability")
    rule = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(labelled(spark))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "block_chance")
