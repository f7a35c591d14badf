"""URL verdicts: host and path rules first, else a logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions and Spark ML inside the JVM. The page's body is never read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions.text import let

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)

#: A small labelled URL table, made by rule: name stems, each in a few host and path shapes.
BLOCK_STEMS = (
    "casino", "poker", "free-bets", "betting", "jackpot", "slots", "cheap-pills", "pills", "viagra", "pharma-deals", "adult", "adult-x",
    "xxx", "porn", "escort", "spam", "spam-farm", "link-farm", "ads", "ads-track", "adserver", "tracker", "click-bait", "payday-loan",
    "fake-watches", "replica", "crack-serial", "warez", "torrent-hack", "win-prize",
)
ALLOW_STEMS = (
    "news", "blog", "docs", "wiki", "library", "museum", "school", "university", "science", "history", "garden", "weather", "recipes",
    "music", "travel", "health", "city", "council", "forum", "journal", "press", "archive", "research", "maths", "physics", "code",
    "community", "art", "books", "radio", "thread", "other", "weekly", "reader", "northern", "station", "letter", "theatre", "nation", "ether",
)
SHAPES = ("https://{}.example.com/en/12", "http://www.{}.example.net/de/7.html", "https://m.{}.example.org/fr/431")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): label 1 is to be blocked. 210 rows made by rule, none null and none twice; they depend on no table."""
    rows = [(shape.format(stem), label) for label, stems in ((1.0, BLOCK_STEMS), (0.0, ALLOW_STEMS)) for stem in stems for shape in SHAPES]
    pairs = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows])
    return spark.range(1).select(F.inline(pairs))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without one."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none; ``rules`` are (verdict, host/path).

    A rule fits its host and every subdomain where the path starts with the rule's. Of two of one length the one
    with the longer host wins, then the smaller text.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), [-ord(c) for c in r[1]]))
    for said, text in order:
        domain, _, tail = text.partition("/")
        fits = ((host_ == domain) | host_.endswith(f".{domain}")) & path_.startswith(f"/{tail}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(host_: Column, path_: Column) -> Column:
    """Character n-grams of host and path with digits folded, each part between marks; the work grows with the length."""
    text = F.concat(F.lit("^"), host_, F.lit("|"), F.regexp_replace(path_, "[0-9]", "0"), F.lit("$"))

    def of(chars: Column, n: int) -> Column:
        last = F.size(chars) - (n - 1)
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.lit(f"{n}:"), F.array_join(F.slice(chars, i, F.lit(n)), "")))

    return let(F.split(text, ""), lambda chars: F.concat(*[of(chars, n) for n in GRAMS]))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features", binary=True).transform(
        df.withColumn("grams", grams(F.col("host"), F.col("path")))
    )


def train(labelled: DataFrame, most_rows: int = 10_000, ridge: float = 0.02) -> LogisticRegressionModel | None:
    """Fits the regression on at most ``most_rows`` labelled urls, the first in hash order; None where no row can be used.

    Rows with a null url or a label other than 0 and 1 are left out. With one class alone the model gives every url that class.
    A url that has both labels counts as both; a repeated row counts as often as it occurs.
    """
    rows = labelled.where("url is not null and label in (0, 1)").orderBy(F.xxhash64("url"), "url", "label").limit(most_rows)
    rows = rows.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("label").cast("double"))
    if rows.isEmpty():
        return None
    return LogisticRegression(regParam=ridge, elasticNetParam=0.0, maxIter=50, standardization=False).fit(_features(rows).select("features", "label"))


def verdicts(
    pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, threshold: float = 0.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages``; only page_id and url are read.

    ``rule`` is null where none fits; then the verdict is ``block`` where the regression's chance reaches
    ``threshold``; without a usable label the score is null and the verdict is ``allow``. A null url, or one without
    ``://``, has an empty host and path. Repeated rows are judged alike; urls of any length are read whole.
    """
    model = train(labelled)
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if model is None:
        scored = parts.withColumn("score", F.lit(None).cast("double"))
    else:
        # A model of the one class 0 has no second probability.
        scored = model.transform(_features(parts)).withColumn("score", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
