"""URL filters: host and path rules, then logistic regression on hashed n-grams."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4)
BUCKETS = 4096
DECAY = 1e-3
BLOCK_AT = 0.5

#: The rules of the production query as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The words that labelled_urls makes its hosts of.
UNWANTED = "casino poker jackpot betting pills viagra pharma replica loans payday crypto adult xxx cams escort spam farm clickbait malware phishing warez torrent keygen cheap bonus win free hot fast easy".split()
ORDINARY = "news library recipes garden science museum weather forum history city school wiki travel music sport health books maps water bridge river market open daily local world green north home art".split()
SYLLABLES = "an be con de er fi ga ha in ka li mo na on per qui ra sa ter tion un ver wi xa yo za the st ing ou".split()
TABLE_ROWS = 800


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; '' without ://."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct (rule, verdict), or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    found = None
    for rule_host, rule_path, verdict in longest_first:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def grams(host: Column, path: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """The distinct character n-grams of host and of path, each marked with its side."""

    def of(text: Column, side: str, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.concat(F.lit(side), F.substring(text, at, F.lit(n))))

    return F.array_distinct(F.concat(*[of(F.concat(F.lit("^"), text, F.lit("$")), side, n) for side, text in (("h", host), ("p", path)) for n in sizes]))


def train(labelled: DataFrame, buckets: int = BUCKETS, decay: float = DECAY) -> PipelineModel:
    """Logistic regression on hashed n-grams, fitted to labelled (url, blocked 0 or 1)."""
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("double").alias("label"))
    hashed = HashingTF(inputCol="grams", outputCol="counts", numFeatures=buckets, binary=True)
    unit = Normalizer(inputCol="counts", outputCol="features")
    fit = LogisticRegression(regParam=decay, maxIter=100)
    return Pipeline(stages=[hashed, unit, fit]).fit(rows.select("label", grams(F.col("host"), F.col("path")).alias("grams")).coalesce(1))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, url_col: str = "url", block_at: float = BLOCK_AT) -> DataFrame:
    """pages' rows as (record struct, host, path, rule, verdict, score).

    The longest fitting rule decides; without one the trained model does (score is its
    probability of block, given for every row).  A null url, or one without ://, has
    empty host and path, fits no rule and gets the model's verdict on no n-grams.  Very
    long URLs are judged whole.  Repeated rows are judged each; an empty table gives no
    rows.  pages' own columns stay inside record, so that no name can clash.
    """
    model = train(labelled)
    url = F.col(f"record.`{url_col}`")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("record"))
    rows = rows.select("record", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rows = rows.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    rows = model.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path"))))
    rows = rows.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= block_at, "block").otherwise("allow"))
    return rows.select("record", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")


def labelled_urls(spark: SparkSession, rows: int = TABLE_ROWS) -> DataFrame:
    """(url, blocked) rows, half of them unwanted, made from words by seeded hashes of the row number.

    Hosts are two words with a hyphen, or two to three syllables; an unwanted one has two
    different UNWANTED words, a wanted one ORDINARY words or syllables.  Subdomains, ends,
    schemes, languages, page numbers and queries are dealt alike to both, so that they
    tell nothing.  No row comes from a table that is judged.
    """
    def pick(words: list[str], salt: int) -> Column:
        return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int"))

    blocked = (F.col("id") % 2).cast("int")
    step = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(len(UNWANTED) - 1)) + 1  # to another word
    second = F.get(F.array(*[F.lit(w) for w in UNWANTED]), F.pmod(F.xxhash64("id", F.lit(1)) + step, F.lit(len(UNWANTED))).cast("int"))
    bad = F.concat(pick(UNWANTED, 1), F.lit("-"), second)
    plain = F.concat(pick(ORDINARY, 3), F.lit("-"), pick(ORDINARY, 4))
    made = F.concat(pick(SYLLABLES, 5), pick(SYLLABLES, 6), pick([*SYLLABLES, *[""] * 20], 7))
    good = F.when(F.col("id") % 4 == 0, plain).otherwise(made)
    host = F.concat(pick(["", "www.", "m.", "blog."], 8), F.when(blocked == 1, bad).otherwise(good), pick([".org", ".net", ".com", ".info", ".example.org", ".example.net", ".example.com"], 9))
    page = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(9999)).cast("string")
    path = F.concat(F.lit("/"), pick(["en", "de", "es", "fr"], 11), F.lit("/"), page, pick(["", "/", ".html"], 12), pick(["", "#top", "?page=2"], 13))
    return spark.range(rows).select(F.concat(pick(["http://", "https://"], 14), host, path).alias("url"), blocked.alias("blocked"))


def op6_ngram_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = filter_urls(pages, labelled_urls(spark))
    return found.select(F.col("record.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score")
