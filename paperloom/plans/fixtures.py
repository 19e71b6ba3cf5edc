"""Inputs derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned blocks; the jitter makes anchored grouping differ from grouping by neighbours."""
    base = lines(spark, sf_dir).where(F.length(F.trim("text")) >= 2)
    base = base.withColumn("page_num", F.floor(F.col("line_no") / 40).cast("int")).withColumn("block_no", F.pmod("line_no", F.lit(40)))
    total = F.col("doc_id") + F.col("line_no")
    base = base.withColumn("y0", 60 + 2.0 * F.col("block_no") + 0.5 * F.pmod(total, F.lit(3))).withColumn("x0", 72.0 + 200 * F.pmod("line_no", F.lit(2)) + 25 * flag(F.pmod(total, F.lit(7)) == 0))
    base = base.withColumn("x1", F.col("x0") + 6.0 * F.least(F.length("text"), F.lit(30))).withColumn("y1", F.col("y0") + 10.0)
    return base.withColumn("sizes", F.array((10 + F.pmod(total, F.lit(8))).cast("double"))).withColumn("fonts", F.array(F.concat(F.lit("f"), F.pmod(total, F.lit(3)).cast("string"))))


BLOCKS_SQL = r"""
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), blocks AS (
  SELECT doc_id, line_no, text, (line_no // 40)::INTEGER AS page_num, line_no % 40 AS block_no,
         60 + 2.0::DOUBLE * (line_no % 40) + 0.5::DOUBLE * ((doc_id + line_no) % 3) AS y0,
         72.0::DOUBLE + 200 * (line_no % 2) + 25 * CASE WHEN (doc_id + line_no) % 7 = 0 THEN 1 ELSE 0 END AS x0,
         (10 + (doc_id + line_no) % 8)::DOUBLE AS size, 'f' || ((doc_id + line_no) % 3)::VARCHAR AS font
  FROM lines WHERE length(trim(text)) >= 2
)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of running text with gaps and indents."""
    base = lines(spark, sf_dir).withColumn("page_num", F.floor(F.col("line_no") / 40).cast("int")).withColumn("k", F.pmod("line_no", F.lit(40)))
    total = F.col("doc_id") + F.col("line_no")
    y0 = 60 + 14.0 * F.col("k") + 20 * F.floor(F.col("k") / 7)
    return base.select("doc_id", "page_num", F.col("k").alias("line_no"), "text", y0.alias("y0"), (y0 + 10.0).alias("y1"), (72.0 + 100 * flag(F.pmod(total, F.lit(7)) == 0)).alias("x0"), (10 + F.pmod(total, F.lit(8))).cast("double").alias("size"))


TEXT_LINES_SQL = r"""
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), text_lines AS (
  SELECT doc_id, (n // 40)::INTEGER AS page_num, n % 40 AS line_no, text,
         60 + 14.0::DOUBLE * (n % 40) + 20 * ((n % 40) // 7) AS y0,
         72.0::DOUBLE + 100 * CASE WHEN (doc_id + n) % 7 = 0 THEN 1 ELSE 0 END AS x0,
         (10 + (doc_id + n) % 8)::DOUBLE AS size
  FROM lines
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled runs from conversations: one paragraph for each."""
    c, t = F.col("conv_id"), F.col("turn")
    free = F.pmod(c, F.lit(3)) == 0
    italic = F.when(free, F.lit(None)).when(F.pmod(t, F.lit(3)) == 0, True).when(F.pmod(t, F.lit(3)) == 1, False)
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select(
        c.alias("para"),
        t.alias("ord"),
        "text",
        ((F.col("role") == "assistant") & ~free).alias("bold"),
        italic.cast("boolean").alias("italic"),
        F.lit(None).cast("boolean").alias("underline"),
        none.alias("font_name"),
        (10 + F.when(free, 0).otherwise(F.pmod(t, F.lit(2)))).cast("double").alias("font_size"),
        none.alias("font_color"),
        none.alias("highlight_color"),
    )


RUNS_SQL = r"""
runs AS (
  SELECT conv_id AS para, turn AS ord, text, (role = 'assistant' AND conv_id % 3 <> 0) AS bold,
         CASE WHEN conv_id % 3 = 0 THEN NULL WHEN turn % 3 = 0 THEN true WHEN turn % 3 = 1 THEN false END AS italic,
         (10 + CASE WHEN conv_id % 3 = 0 THEN 0 ELSE turn % 2 END)::DOUBLE AS font_size
  FROM conversations
)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.floor(d / 20).alias("doc"),
        F.pmod(d, F.lit(4)).alias("page"),
        d.alias("index"),
        F.pmod(d * 37, F.lit(800)).cast("double").alias("y0"),
        (40 + F.pmod(d * 13, F.lit(900))).cast("double").alias("width"),
        (40 + F.pmod(d * 29, F.lit(900))).cast("double").alias("height"),
        F.col("n_chars").alias("size"),
        F.md5(F.pmod(d, F.lit(7)).cast("string").cast("binary")).alias("md5"),
        # every fifth image couldn't be decoded
        F.when(F.pmod(d, F.lit(5)) < 4, 20 + F.pmod(d * 11, F.lit(300))).cast("int").alias("px_width"),
        F.when(F.pmod(d, F.lit(5)) < 4, 20 + F.pmod(d * 17, F.lit(300))).cast("int").alias("px_height"),
        F.try_element_at(F.array(*[F.lit(m) for m in ("RGB", "L", "1", "P")]), (F.pmod(d, F.lit(5)) + 1).cast("int")).alias("mode"),
        F.when((F.pmod(d, F.lit(5)) < 4) & (F.pmod(d, F.lit(7)) != 0), F.pmod(d * 3, F.lit(30))).cast("int").alias("n_colors"),
        F.when(F.pmod(d, F.lit(5)) < 4, F.pmod(d, F.lit(10))).cast("int").alias("grey_min"),
        F.when(F.pmod(d, F.lit(5)) < 4, F.pmod(d, F.lit(10)) + F.pmod(d * 13, F.lit(60))).cast("int").alias("grey_max"),
    )


IMAGES_SQL = r"""
images AS (
  SELECT doc_id // 20 AS doc, doc_id % 4 AS page, doc_id AS index, ((doc_id * 37) % 800)::DOUBLE AS y0,
         (40 + (doc_id * 13) % 900)::DOUBLE AS width, (40 + (doc_id * 29) % 900)::DOUBLE AS height,
         n_chars AS size, md5((doc_id % 7)::VARCHAR) AS md5, doc_id
  FROM documents
), judged AS (
  SELECT *, CASE WHEN size < 1024 THEN 'bytes' WHEN width < 80 OR height < 80 THEN 'small'
                 WHEN width / height < 0.2 THEN 'thin' WHEN width / height > 5 THEN 'wide'
                 WHEN doc_id % 5 = 4 THEN NULL WHEN (doc_id * 11) % 300 < 30 OR (doc_id * 17) % 300 < 30 THEN 'pixels'
                 WHEN doc_id % 5 < 2 AND doc_id % 7 <> 0 AND (doc_id * 3) % 30 < 10 THEN 'colors'
                 WHEN doc_id % 5 IN (1, 2) AND (doc_id * 13) % 60 < 20 THEN 'uniform' END AS rule
  FROM images
), filtered AS (
  SELECT *, CASE WHEN rule IS NULL AND row_number() OVER (PARTITION BY doc, rule IS NULL, md5 ORDER BY page, index) > 1
                 THEN 'duplicate' ELSE rule END AS reason
  FROM judged
)"""


def image_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight paragraphs on each page that has an image."""
    pages = images(spark, sf_dir).select("doc", "page").distinct()
    return pages.withColumn("para_no", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("y0", 80.0 + 90 * F.col("para_no"))


IMAGE_PARAGRAPHS_SQL = r"""
image_paragraphs AS (
  SELECT doc, page, para_no, 80.0::DOUBLE + 90 * para_no AS y0
  FROM (SELECT DISTINCT doc, page FROM images), (SELECT unnest(range(8)) AS para_no)
)"""

#: What is put in front of each page's HTML, by page_id % 5.
_MARKUP = (
    "<p><img src=\"http://pics.org/a b/Photo.PNG?x=1\"></p><mark style='color: red'>one</mark>",
    '<p> <IMG alt="x" SRC=\'media/image1.gif\'> </p><MARK class="k">two</MARK>',
    '<p><img src="data:image/png;base64,iVBORw0KGgo=" /></p><p id="kept">three</p>',
    '<p><img src="#anchor"></p><p><img src="pic.webp"></p><mark>four</mark> <mark style="">x</mark>',
    '<head><title>t</title></head><img src="https://e.org/x" data-src="late.bmp"><mark STYLE="y">five</mark>',
)


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with images, marks, ids and heads in front."""
    kind, text = F.pmod("page_id", F.lit(5)), F.lit("")
    for i, m in enumerate(_MARKUP):
        text = F.when(kind == i, F.lit(m)).otherwise(text)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(text, F.col("html")).alias("html"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MARKED_PAGES_SQL = "marked AS (SELECT page_id, CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {quoted(m)}" for i, m in enumerate(_MARKUP)) + " END || html AS html FROM pages)"
