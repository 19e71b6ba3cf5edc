"""What a conversion did, in numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversion_report(elements: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """elements (doc_id, id, style), paragraphs (doc_id, para_id, text) -> a row for each document.

    n_paragraphs, n_chars of the stored paragraphs; n_matched elements that have one, n_styled of
    those with a style.  Each side is summed up before they meet.
    """
    stored = paragraphs.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))
    known = paragraphs.select(F.col("doc_id").alias("_doc"), F.col("para_id").alias("_id")).distinct()
    hit = elements.join(known, (F.col("doc_id") == F.col("_doc")) & (F.col("id") == F.col("_id")), "left_semi")
    done = hit.groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("n_matched"), F.count_if(F.coalesce(F.col("style"), F.lit("")) != "").alias("n_styled"))
    joined = stored.join(done, F.col("doc_id") == F.col("_doc"), "left")
    return joined.select("doc_id", "n_paragraphs", "n_chars", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_matched", "n_styled")])
