"""Bounded samples of labelled documents, and the rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import whole_text


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the doc_id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and label (0 or 1) of about ``most`` labelled documents at most, chosen by a hash of their id.

    Held-out ids and null or other labels take no part. The sample of labels is bounded, so it can be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(-(-n // most))) == 0)
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")
