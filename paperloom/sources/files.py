"""Files as tables: format detection, routing, uploads, text pages, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import FORMATS

SNIFF = 200
#: Formats that are accepted; PDF only where an engine for it is there.
ACCEPTED = (".doc", ".docx", ".epub", ".txt", ".rtf", ".md", ".html", ".htm", ".odt")


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path component; empty without one."""
    name = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)\z", 1))


def detect_format(path: Column, content: Column | None = None) -> Column:
    """By extension, else by the first bytes of the content, else plain."""
    ext = extension(path)
    by_name = F.lit(None).cast("string")
    for known, fmt in FORMATS.items():
        by_name = F.when(ext == known, fmt).otherwise(by_name)
    if content is None:
        return F.coalesce(by_name, F.lit("plain"))
    head = F.hex(F.substring(content, 1, SNIFF))
    has = lambda text: head.contains(text.encode().hex().upper())
    zipped = head.startswith("504B0304")
    by_content = F.when(head.startswith(b"%PDF".hex().upper()), "pdf").when(zipped & has("mimetypeapplication/epub+zip"), "epub").when(zipped & (has("word/") | has("docx")), "docx").when(head.startswith(b"{\\rtf".hex().upper()), "rtf")
    return F.coalesce(by_name, by_content, F.lit("plain"))


def is_supported(path: Column, pdf: bool = True) -> Column:
    return extension(path).isin(*ACCEPTED, *([".pdf"] if pdf else []))


def upload_problem(name: Column, pdf: bool = True) -> Column:
    """Why an upload is refused; null if it is not."""
    return F.when(name.isNull(), "no file").when(name == "", "no file name").when(~is_supported(name, pdf), "unsupported format")


def safe_name(name: Column) -> Column:
    """A file name without paths or odd characters; the name as it is where nothing usable is left."""
    flat = F.regexp_replace(F.regexp_replace(name, r"[/\\]", " "), r"[ \t\r\n]+", "_")
    ascii_only = F.regexp_replace(flat, r"[^A-Za-z0-9_.-]", "")
    safe = F.regexp_replace(ascii_only, r"^[._]+|[._]+\z", "")
    return F.when((safe == "") | ~safe.contains("."), name).otherwise(safe)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content and format of all files under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.withColumn("format", detect_format(F.col("path"), F.col("content")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, size_bytes, is_file without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), F.lit(True).alias("is_file"))


def route(files: DataFrame) -> dict[str, DataFrame]:
    """One branch for each way of converting: docx, pdf, epub, text (plain and Markdown), html, other."""
    fmt = F.col("format")
    kinds = {"docx": fmt == "docx", "pdf": fmt == "pdf", "epub": fmt == "epub", "text": fmt.isin("plain", "markdown"), "html": fmt == "html"}
    other = ~fmt.isin("docx", "pdf", "epub", "plain", "markdown", "html")
    return {name: files.where(cond) for name, cond in kinds.items()} | {"other": files.where(other)}


def text_of(files: DataFrame) -> DataFrame:
    """Adds ``text``: the content as UTF-8, broken sequences replaced."""
    return files.withColumn("text", F.decode("content", "UTF-8"))
