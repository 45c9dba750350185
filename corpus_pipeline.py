"""A training-data pipeline over the table ``documents``, stage by stage.

Quality, near duplicates, personal data, mixture, byte-level BPE.  Each stage takes what
its predecessor kept and, but for the last, returns the columns of its input, whatever
other columns there are and whatever their names.  Rows are told apart by a number of
their own, never by doc_id, which may be null or name several texts.  Each stage takes
texts whole, however long, and gives an empty table for an empty one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm import byte_bpe, mixing, near_copies, pii, quality, spans
from datakiln.llm.identity import identified
from datakiln.operators.headers import unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have the features of an empty text and go or stay together;
    repeated rows get one score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs.select("doc_id", "text"), labels)
    return docs.filter(quality.score_column(spark, model, F.col("text")) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8).

    The one with the least doc_id stays, null last; where a doc_id repeats in a group, one
    of its rows.  Unlike texts under one doc_id both stay.  Texts without words, null ones
    included, are one group.
    """
    held, row = identified(docs, "_copy_row")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row"))
    found = near_copies.near_copies(held.select(key.alias("doc_id"), "text"))
    kept = found.filter("doc_id = component_id").select(F.col("doc_id.row").alias(row))
    return held.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; n_chars follows the text.

    A null text has no spans and stays null, with a null n_chars; repeated rows stay
    repeated.
    """
    base, added = (unused(n, docs.columns) for n in ("_base", "_spans"))
    found = pii.find(docs, base=base, spans=added)
    hidden = found.withColumn("text", spans.masked(F.col("text"), F.col(added)))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, row by row; null and empty texts have no words and are not taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and digests of the ids and of what they decode to; a null text counts as empty."""
    named = docs.select("doc_id", "source", "text")
    coded = byte_bpe.round_trip(named, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(coded).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mixture", mix_sources),
    ("byte_bpe", encode),
]

#: The stages fit a classifier and follow chains of near copies, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is written and read again.

    What a stage saved on the way is removed with it, and its input once its output is
    written, so the shared folder never holds more than two corpora and in the end one.
    """
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch.cleared(spark):
            path = scratch.folder(spark, name, outlives=True)
            docs = scratch.written(stage(spark, docs, sf_dir), path)
        if held:
            scratch.remove(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
