"""From raw documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
each result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, mixing, ngram_join, pii, quality
from paperloom.llm.common import fold, materialize, table
from paperloom.llm.queries import VOCABULARY

#: SQL can express neither the classifier nor the encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts.

    Every row, repeated or not, is judged by its text alone; a null text as an empty one, a null id
    gives no label.  An empty table, or one without a good and a bad label, keeps all its rows.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return quality.score_documents(docs, model, "__quality").where(F.col("__quality") >= quality.CUT).drop("__quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8.

    The row with the smallest id stays (null last).  Rows that share an id but not a text are
    different documents; rows without words (null, empty) are copies of nothing and stay.
    """
    return ngram_join.one_of_each(docs, words=5, num=80, den=100)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with marks in place of personal data and of terms that reveal it.

    Every row stays, null and empty texts as they are; rows equal in id and text come out equal.
    """
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them.

    A null source is a source of its own; rows without words stay once; repeated rows count each.
    """
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it: one row for each row.

    A null text has no ids and decodes to nothing, as an empty one does.
    """
    path = public_tokenizers.path(VOCABULARY)
    hashed = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("__sha"))
    # written in between, so that a task never has an encoding and a decoding worker at once
    encoded = materialize(bpe.encode_documents(hashed, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "__sha"], resident=False), "pipeline-ids")
    decoded = bpe.decode_documents(encoded, path)
    return decoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("__sha")).alias("round_trip"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
