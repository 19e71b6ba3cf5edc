"""What a conversion service says of itself, as small tables, and which reader it chooses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import default_config
from ..functions.tables import FORMATS


def formats(spark: SparkSession) -> DataFrame:
    """format, extensions (sorted) of every format that is told by a name."""
    known: dict[str, list[str]] = {}
    for extension, name in FORMATS.items():
        known.setdefault(name, []).append(extension)
    return spark.createDataFrame([(k, sorted(v)) for k, v in known.items()], "format string, extensions array<string>")


def defaults(spark: SparkSession) -> DataFrame:
    """format, allowed_styles, allowed_classes as they are without any settings."""
    rows = [(k, v["allowed_styles"], v["allowed_classes"]) for k, v in default_config().items()]
    return spark.createDataFrame(rows, "format string, allowed_styles array<string>, allowed_classes array<string>")


def health(spark: SparkSession) -> DataFrame:
    """One row: status and Spark's version."""
    return spark.createDataFrame([("healthy", spark.version)], "status string, version string")


def pdf_engine(has_spans: Column, has_text: Column) -> Column:
    """The reader a PDF goes to: positioned spans, else page texts; null where neither is there."""
    return F.when(has_spans, "spans").when(has_text, "text")
