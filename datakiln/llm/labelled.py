"""Labelled rows for the classifiers: which may be learnt from, and a bounded sample of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, fold: int) -> Column:
    """Whether a document belongs to the fold that is never learnt from; false for a null doc_id."""
    return F.coalesce(remainder(doc_id, modulus) == fold, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, fold: int, most: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the fold, taken in hash order.

    Labels other than 0 and 1 and rows without doc_id are left out; of labels that repeat a
    doc_id the larger counts, of texts that repeat a doc_id the least.  The ids that go to
    every task are bounded by ``most``.
    """
    named = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label"))
    free = named.filter(F.col("label_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("label_id"), modulus, fold))
    chosen = free.groupBy("label_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), texts.doc_id == chosen.label_id)
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
