"""The corpus pipeline: documents through five training-data operators in turn.

Defined cases: a null or empty text has no letter and goes in the first stage, as does
every text without one.  If no document is labelled with a language, only these go; if no
quality is labelled, the base rules alone decide.  A null id is kept like any other and
stays alone in the near-duplicate stage; of rows with equal id and text one stays.  Very
long texts are read whole, and packing cuts them into pieces.  Other columns, whatever
their names, come through unchanged up to the last stage.  An empty table gives no rows.

The stages lower the session's spark.sql.execution.arrow.maxBytesPerBatch to 1 MB: they hold
whole texts, in the JVM and in Python, on executors that may have 3 GB for two cores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import language_id, packing, pii, quality, simhash
from keyloom.llm.common import discard, documents, small_batches, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a likely language."""
    small_batches(spark)
    network = language_id.train(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, network)
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= language_id.reject_below(network))
    return found.where(sure).select("record.*")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules or the quality model reject."""
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge_quality(docs, model).where("kept").select("record.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash group."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put each span's kind in its place; n_chars follows the text."""
    found = pii.personal_spans(docs)
    text = F.when(F.col("record.text").isNotNull(), pii.masked(F.col("record.text"), F.col("spans")))
    changed = found.select("record", text.alias("masked"))
    own = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return changed.select(*[own.get(c, F.col(f"record.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' tokens into sequences of 2048; each piece holds its ids."""
    small_batches(spark)
    return packing.pack_documents(docs).withColumn("length", F.col("length").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", filter_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Learned models decide in the first two stages, so no SQL restates the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents; what a stage keeps is written before the next, and goes after it."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
