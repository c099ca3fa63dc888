"""A bounded sample of labelled documents to train a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int, seed: str, text: str = "text"
) -> DataFrame:
    """(doc_id, label, text as bytes) of about ``rows`` labelled documents that are not held out, drawn by hash.

    The labels are drawn and written before the join, so Spark sees how few they are and the texts of other documents stay
    where they are. Rows without label or id are left out, and a null text is empty.
    """
    usable = labels.where(~held_out & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", F.col(label).cast("int").alias("label"))
    total = usable.count()
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * total < rows
    chosen = materialize(usable.where(drawn), "labels")
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return texts.join(chosen, "doc_id").select("doc_id", "label", "text")
