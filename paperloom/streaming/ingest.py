"""Files and texts as streams, through the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalize
from ..sources.files import detect_format


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files under a folder, with their format."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("format", detect_format(F.col("path"), F.col("content")))


def stream_table(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 1000) -> DataFrame:
    """New Parquet files of a table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def normalize_stream(texts: DataFrame, text: str = "text", **options) -> DataFrame:
    return texts.withColumn("normalized", normalize(F.col(text), **options))


def formats_by_hour(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files and bytes by format and hour of change; hours close when the watermark passes them."""
    hours = files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", "1 hour"), "format")
    return hours.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes")).select(F.col("window.start").alias("hour"), "format", "n_files", "bytes")


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet, exactly once, taking what is there and then ending."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
