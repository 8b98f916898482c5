"""URL filter: rules first, then a logistic regression on hashed character n-grams.

Host and path are taken from the text after the first ``://``. A rule names a
host and the start of a path; it fits that host and all its subdomains, and
the longest fitting rule decides. All other URLs are judged by a model over
character n-grams of host and path, hashed into a fixed number of places and
trained by Spark ML on a small labelled table.

Only SQL functions and Spark ML are used. Defined results: a URL that is null
or holds no ``://`` has an empty host and path, fits no rule and, as there is
nothing to judge, is allowed with score 0. Repeated rows are each judged; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that n-grams are hashed into, and the lengths of the n-grams.
PLACES, GRAMS = 1 << 16, (3, 4, 5)
#: A URL is blocked above this probability: below one half, as blocked sites are named by few n-grams of their own.
BLOCK_ABOVE = 0.3

# The rules (host, start of the path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# The sites that a person has labelled, and the forms in which their URLs are met.
BLOCKED_SITES = (
    "cheap-pills pills-online best-pharmacy-pills cheap-meds casino-win online-casino casino-jackpot win-casino-slots "
    "free-bets bets-now sport-free-bets betting-tips-win adult-x adult-cams xxx-adult hot-adult-x "
    "spam-farm link-farm-spam seo-spam spam-links-farm ads-track track-ads-click adtracker click-ads "
    "free-money-now get-rich-fast cheap-watches loans-cheap win-free-phone cheap-replica"
).split()
ALLOWED_SITES = (
    "thern tionsh thering thand theres tionble library university museum weather "
    "kitchen history tiontion government ththen garden city-maps theatre school open-source "
    "thorin encyclopedia science-journal nature-photo books music-archive health-clinic language travel news-daily"
).split()
PREFIXES, DOMAINS = ("", "www.", "blog.", "m."), (".example.com", ".example.net", ".example.org", ".test")
PATHS = ("/en/12", "/de/4.html", "/fr/9?page=2", "/es/7", "/en/88#top", "/fr/61/", "/en/5?utm_source=feed", "/", "/page")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: each site in three forms, the same forms for either label. 1: block, 0: allow."""
    out = []
    for label, sites in ((1, BLOCKED_SITES), (0, ALLOWED_SITES)):
        for i, site in enumerate(sites):
            for k in range(3):
                out.append((f"http://{PREFIXES[(i + k) % 4]}{site}{DOMAINS[(i // 4 + 3 * k) % 4]}{PATHS[(2 * i + 5 * k) % 9]}", label))
    return out


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams(mark: str, text: Column) -> Column:
    """Marked character n-grams of a host or path, with its two ends."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    each = [
        F.when(F.length(text) + 2 < n, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)), lambda i, n=n: F.concat(F.lit(mark), framed.substr(i, F.lit(n))))
        )
        for n in GRAMS
    ]
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*each))


def with_features(urls: DataFrame, url: str, places: int) -> DataFrame:
    """Add __host, __path and the hashed n-gram vector __features."""
    parts = urls.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    # Digits carry no meaning beyond being digits.
    plain = parts.withColumn("__grams", F.concat(ngrams("h", F.col("__host")), ngrams("p", F.regexp_replace("__path", "[0-9]+", "0"))))
    return HashingTF(numFeatures=places, binary=True, inputCol="__grams", outputCol="__features").transform(plain).drop("__grams")


def train_filter(labelled: DataFrame, url: str = "url", label: str = "label", places: int = PLACES) -> LogisticRegressionModel:
    """The model of a labelled table (label 1: block)."""
    rows = with_features(labelled.select(F.col(url).alias("__url"), F.col(label).cast("double").alias("__label")), "__url", places)
    return LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", regParam=0.0005, maxIter=60).fit(rows)


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def rule_column(rules: tuple, host: Column, path: Column) -> Column:
    """The number of the longest fitting rule, or null. Rules of equal length: the one named first."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][0] + rules[i][1]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)) for i in order for h, p, _ in [rules[i]]]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, url: str = "url", rules: tuple = RULES, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """Add host, path, rule, verdict and block_score to the pages, replacing columns of these names."""
    places = model.numFeatures
    scored = model.transform(with_features(pages.withColumn("__url", F.col(url)), "__url", places))
    score = F.when((F.col("__host") == "") & (F.col("__path") == ""), F.lit(0.0)).otherwise(vector_to_array("__probability")[1])
    number = rule_column(rules, F.col("__host"), F.col("__path"))
    names = F.array(*[F.lit(h + p) for h, p, _ in rules])
    verdicts = F.array(*[F.lit(v) for *_, v in rules])
    out = scored.withColumns({"block_score": score, "__rule": number}).withColumns(
        {
            "host": F.col("__host"),
            "path": F.col("__path"),
            "rule": F.when(F.col("__rule").isNotNull(), F.element_at(names, F.col("__rule") + 1)),
            "verdict": F.when(F.col("__rule").isNotNull(), F.element_at(verdicts, F.col("__rule") + 1)).when(F.col("block_score") > block_above, "block").otherwise("allow"),
        }
    )
    return out.drop("__url", "__host", "__path", "__features", "__raw", "__probability", "__prediction", "__rule")
