"""What several operators share: shared storage, hashing rules, Arrow settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator that counts or shingles words: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset does this pick a place itself: the
    warehouse on a cluster, a temporary folder with a local master.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "paperloom-shared")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_paperloom"


#: Whether Spark deletes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The size of a page is looked at from its first row on.  Parquet looks after 100 rows otherwise; of rows of 1 MB that
#: makes pages of 100 MB, which are packed and unpacked in buffers outside the heap that the executor keeps.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}


def _write(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` and reads it back; its shuffle files go when it is written, as nothing reads them again."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**PAGES).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a file read, never a recomputation of
    what lies before.  Unlike ``checkpoint()`` it computes its input once.
    """
    return _write(df, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


#: Narrow rows that one task writes to one file.
ROWS_A_FILE = 500_000


class Scratch:
    """The tables that one call of an operator writes on its way, in a folder of its own.

    A table goes as soon as what is made of it has been written.  Other calls, in this process or
    another, have other folders, so none can lose a table that it still reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, rows: int | None = None, each: int = ROWS_A_FILE) -> DataFrame:
        """``rows``, where it is known that there are no more: the table comes in as many files as these need."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // each)))
        return _write(df, f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        hadoop, jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        for name in names:
            place = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            place.getFileSystem(hadoop).delete(place, True)


#: Bytes of text or sets in one Arrow batch at most.
BATCH_BYTES = 2 * 1024 * 1024


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Limits Arrow batches by bytes, as rows may be long; a session's own smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def position(columns: list[str], name: str) -> int:
    """Where a column stands, by Spark's rule: the case of a name doesn't count."""
    return [c.lower() for c in columns].index(name.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def word_count(text: Column) -> Column:
    """Number of words of a text, natively; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
