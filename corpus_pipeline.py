"""A training-data pipeline over the table documents: five stages, each a table that the next one reads.

Toxic documents go; of each group of near copies one document stays; personal data becomes pseudonyms; sources are mixed
to target weights, where a document may come twice or not at all; what is left is encoded and decoded again.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.llm import bpe, minhash, mixing, pii, toxicity
from vistaframe.llm.common import documents, stored

#: Where the session gives the key for pseudonyms, and the published example that is taken, with a warning, if it gives none.
KEY_SETTING = "spark.vistaframe.pii.key"
PII_KEY = pii.KEY


def pii_key(spark: SparkSession) -> str:
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the published example key, and anyone can undo them", stacklevel=2)
    return found or PII_KEY


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the classifier learns from the labels of the documents given."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, "__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Where ids are null or stand for several rows, each text of an id counts as a document of its own, those without id
    after all others, so that no text is lost with another; of rows with one id and text the first by their other columns stays.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    key = ["__none", "__id", "__text"]
    keyed = docs.withColumns({
        "__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__text": F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()),
    })
    order = keyed.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key)
    numbers = stored(order.withColumn("__row", F.monotonically_increasing_id()), "pipeline-numbers")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("__any")))
    first = keyed.withColumn("__rest", rest).groupBy(*key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "__rest").alias("__doc"))
    rows = stored(first.join(numbers, key).select("__row", "__doc"), "pipeline-rows")
    gone = minhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "__doc.text")).where("not kept").select(F.col("doc_id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select("__doc.*")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars is that of the new text."""
    out = pii.pseudonymised(docs, pii_key(spark), found="__pii").withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in mixing order, each as often as its source's target lets it come."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of ids and decoded text of every row."""
    return bpe.digests(docs, "doc_id", "lang", "source")


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("pii", pseudonyms),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the learnt classifier, the pseudonyms and the tokenizer; tests compare with plain Python instead.
ORACLE_SQL = None
