"""URL filter: rules first, then logistic regression on character n-grams.

Only DataFrame and SQL functions are used. Host and path are taken apart by
fixed positions; their character n-grams are hashed into buckets; the weights
are fitted in the JVM to a small labelled table.

Of rules that are equally long the later one in the list decides; a url of any
length is taken apart whole.

Defined results: a null url, or one without ``://``, has an empty host and path
and no n-grams, so that the model's bias alone decides; repeated rows come back
repeated; an empty table gives an empty table; an empty labelled table blocks
nothing; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAMS, STEPS, PENALTY = 1 << 14, (3, 4), 40, 2e-4
#: Most rules, as they become one expression, and most labelled urls.
MOST_RULES, MOST_LABELLED = 1000, 2000


def taken_apart(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (else null) and its verdict."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{MOST_RULES} rules at most")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """The distinct character n-grams, those of host and path apart."""
    found = F.concat(*(_grams_of(text, tag) for tag, text in (("h", host), ("p", path))))
    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def _grams_of(text: Column, tag: str) -> Column:
    letters = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    # As the variable of an outer transform, the letters are taken apart once.
    of_all = lambda every: F.concat(*(F.filter(F.transform(every, _gram(every, n, tag)), lambda g: g.isNotNull()) for n in GRAMS))
    return F.flatten(F.transform(F.array(letters), of_all))


def _gram(letters: Column, n: int, tag: str):
    """For a letter and its place: the n-gram that starts there, or null."""
    return lambda letter, i: F.concat(F.lit(tag), letter, *(F.get(letters, i + k) for k in range(1, n)))


class UrlModel:
    """Logistic regression on hashed n-grams, trained from a small table.

    ``labelled`` has url and block (1 or 0). ``MOST_LABELLED`` distinct rows are
    used at most, the first in the order of a hash. Without any, nothing is
    blocked.
    """

    def __init__(self, labelled: DataFrame):
        host, path = taken_apart(F.col("url").cast("string"))
        rows = labelled.where("url is not null and block is not null").select("url", F.col("block").cast("double").alias("label")).distinct()
        rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED).select(grams(host, path).alias("grams"), "label").cache()
        self.hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="hashed")
        self.model = None
        try:
            if not rows.isEmpty():
                regression = LogisticRegression(featuresCol="hashed", labelCol="label", probabilityCol="chance", maxIter=STEPS, regParam=PENALTY, standardization=False)
                self.model = regression.fit(self.hashed.transform(rows))
        finally:
            rows.unpersist()

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with host and path, plus p_block."""
        if self.model is None:
            return rows.withColumn("p_block", F.lit(0.0))
        found = self.model.transform(self.hashed.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))))
        return found.withColumn("p_block", F.get(vector_to_array("chance"), 1)).drop("grams", "hashed", "chance", "rawPrediction", "prediction")


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row."""
    host, path = taken_apart(F.col("url").cast("string"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("said"))
    learnt = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return model.scored(parts).select("page_id", "host", "path", "rule", F.coalesce("said", learnt).alias("verdict"), "p_block")


#: The small labelled table: general words that hosts are named after.
BLOCKED = ("casino", "poker", "betting", "bets", "slots", "lottery", "spam", "spammer", "bulkmail", "pills", "pharma", "viagra", "meds", "adult", "xxx", "cams", "escorts", "ads", "adserver", "tracker", "tracking", "clicks", "popups", "malware", "phishing", "warez", "cracks", "torrents", "loans", "payday", "replica", "jackpot")
ALLOWED = ("blog", "news", "docs", "wiki", "library", "museum", "school", "science", "weather", "garden", "history", "recipes", "travel", "music", "books", "health", "cooking", "photos", "university", "government", "parks", "family", "research", "maps", "language", "gallery", "theatre", "culture", "nature", "forum", "letters", "radio")
JOINED = ("{}", "my{}", "the-{}", "{}-online", "{}1", "best{}")
PATHS = ("en/{}", "fr/{}.html", "de/{}/", "es/{}?page=2")


def labelled_table(spark: SparkSession) -> DataFrame:
    """url, block: a few hundred urls around the words above."""
    rows = []
    for block, words in ((1, BLOCKED), (0, ALLOWED)):
        for i, word in enumerate(words):
            for k, path in enumerate(PATHS):
                host = f"{('', 'www.', 'm.', 'web.')[(i + k) % 4]}{JOINED[(i + k) % len(JOINED)].format(word)}.example.{('com', 'net', 'org')[(i + k) % 3]}"
                rows.append(f"('http://{host}/{path.format(17 * (i + 1) + k)}', {block}.0D)")
    return spark.sql(f"select * from values {', '.join(rows)} as t(url, block)")
