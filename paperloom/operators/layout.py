"""From positioned text blocks to lines, paragraphs and headings.

Spans become blocks, blocks lines, lines paragraphs.  A page is the unit: everything groups or
partitions by document and page, so a page's rows meet in one task and nothing larger does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, escape_html, is_blank, strip

PAGE = ("doc_id", "page_num")


@dataclass(frozen=True)
class Layout:
    """Tolerances in points."""

    y_tolerance: float = 3.0
    x_gap: float = 5.0
    min_block_chars: int = 2
    line_gap: float = 1.5
    indent: float = 20.0
    default_size: float = 12.0
    center: float = 200.0
    center_tolerance: float = 50.0
    h2_above: float = 16.0
    h3_above: float = 14.0


def spans_to_blocks(spans: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Text spans (block_type 0) -> blocks: texts joined in order without separators."""
    kept = spans.where((F.col("block_type") == 0) & ~is_blank(F.col("text")))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "span_no", "text", "size")))
    blocks = kept.groupBy(*PAGE, "block_no").agg(
        ordered.alias("_s"),
        F.array_sort(F.collect_set("font")).alias("fonts"),
        *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")],
    )
    blocks = blocks.withColumn("text", F.array_join(F.transform("_s", lambda s: s["text"]), "")).withColumn("sizes", F.transform("_s", lambda s: s["size"]))
    mean = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x) / F.size("sizes")
    return blocks.where(F.length(strip(F.col("text"))) >= layout.min_block_chars).select(*PAGE, "block_no", "text", "x0", "y0", "x1", "y1", "fonts", "sizes", F.coalesce(mean, F.lit(0.0)).alias("avg_size"))


def blocks_to_lines(blocks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Blocks -> (page, line_no, text, y0, y1, x0, x1, size, fonts).

    A line's first block is its anchor: a block joins while its y0 is within the tolerance of the
    anchor's, not of its neighbour's.  That is a fold over the page's blocks in reading order.
    """
    block = F.struct(F.bround(F.col("y0") / layout.y_tolerance).alias("row"), "x0", "block_no", "y0", "x1", "y1", "text", "sizes", "fonts")
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(block)).alias("b"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("lines"))

    def step(state: Column, b: Column) -> Column:
        same = state["anchor"].isNotNull() & (F.abs(b["y0"] - state["anchor"]) <= layout.y_tolerance)
        line = F.when(same, state["line"]).otherwise(state["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, state["anchor"]).otherwise(b["y0"]).alias("anchor"), F.concat(state["lines"], F.array(line)).alias("lines"))

    numbered = pages.withColumn("lines", F.aggregate("b", start, step)["lines"]).select(*PAGE, F.explode(F.arrays_zip("b", "lines")).alias("z"))
    member = F.struct(F.col("z.b.x0").alias("x0"), F.col("z.b.row").alias("row"), F.col("z.b.block_no").alias("block_no"), F.col("z.b.y0").alias("y0"), F.col("z.b.x1").alias("x1"), F.col("z.b.y1").alias("y1"), F.col("z.b.text").alias("text"), F.col("z.b.sizes").alias("sizes"), F.col("z.b.fonts").alias("fonts"))
    lines = numbered.groupBy(*PAGE, F.col("z.lines").alias("line_no")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    gap = lambda x, i: F.when((i > 0) & (x["x0"] - F.try_element_at(F.col("m"), i)["x1"] > layout.x_gap), " ").otherwise("")
    sizes = F.flatten(F.transform("m", lambda x: x["sizes"]))
    mean = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(sizes) > 0, F.size(sizes))
    first, last = F.col("m")[0], F.try_element_at(F.col("m"), F.lit(-1))
    return lines.select(
        *PAGE,
        "line_no",
        F.array_join(F.transform("m", lambda x, i: F.concat(gap(x, i), x["text"])), "").alias("text"),
        first["y0"].alias("y0"),
        first["y1"].alias("y1"),
        first["x0"].alias("x0"),
        last["x1"].alias("x1"),
        F.coalesce(mean, F.lit(layout.default_size)).alias("size"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["fonts"])))).alias("fonts"),
    )


# Fixed values in it: the patterns of a chapter and a section number.
def paragraph_type(text: Column, size: Column, layout: Layout = Layout()) -> Column:
    """Heading level by size, else by a chapter or section number in front, else p."""
    return F.when(size > layout.h2_above, "h2").when(size > layout.h3_above, "h3").when(text.rlike(r"^第[一二三四五六七八九十\p{Nd}]+章"), "h1").when(text.rlike(r"^\p{Nd}+[.、]"), "h3").otherwise("p")


def lines_to_paragraphs(lines: DataFrame, layout: Layout = Layout(), **normalize_options) -> DataFrame:
    """Lines -> (page, para_no, text, type, size, y0, is_center); blank paragraphs are dropped."""
    page = Window.partitionBy(*PAGE).orderBy("line_no")
    prev = F.lag(F.struct("y0", "y1", "x0", "text")).over(page)
    ends = strip(F.col("p.text")).rlike(r"[。！？.!?]\z")
    fresh = F.col("p").isNull() | (F.col("y0") - F.col("p.y1") > layout.line_gap * (F.col("p.y1") - F.col("p.y0"))) | (F.col("x0") - F.col("p.x0") > layout.indent) | ends
    islands = lines.withColumn("p", prev).withColumn("para_no", F.sum(F.when(fresh, 1).otherwise(0)).over(page))
    grouped = islands.groupBy(*PAGE, "para_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "size", "y0", "x0"))).alias("l"))
    size = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["size"]) / F.size("l")
    merged = grouped.select(
        *PAGE,
        "para_no",
        F.array_join(F.transform("l", lambda x: x["text"]), "").alias("_raw"),
        size.alias("size"),
        F.col("l")[0]["y0"].alias("y0"),
        (F.abs(F.col("l")[0]["x0"] - layout.center) < layout.center_tolerance).alias("is_center"),
    )
    # the cleaned text comes out of an explode, so the filter and the type below don't compute it again
    cleaned = F.array(clean_text(F.col("_raw"), **normalize_options))
    merged = merged.withColumn("text", F.explode(F.filter(cleaned, lambda t: ~is_blank(t))))
    return merged.withColumn("type", paragraph_type(F.col("text"), F.col("size"), layout)).select(*PAGE, "para_no", "text", "type", "size", "y0", "is_center")


def render_paragraph(text: Column, kind: Column, is_center: Column) -> Column:
    safe = escape_html(text)
    mark = lambda tag, css="": F.concat(F.lit(f"<{tag}{css}>"), safe, F.lit(f"</{tag}>"))
    headings = [F.when((kind == h) & is_center, mark(h, ' class="center"')).when(kind == h, mark(h)) for h in ("h1", "h2")]
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.coalesce(*headings, F.when(kind == "h3", mark("h3")), F.when(is_center, mark("p", ' class="no-indent"')), mark("p")))


def text_pages_to_html(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """Plain page texts -> html of each page: a <p> for each line that isn't blank, <hr> between pages."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), escape_html(x), F.lit("</p>"))), "\n")
    more = F.col(page) < F.max(page).over(Window.partitionBy(doc))
    return pages.withColumn("html", F.concat(body, F.when(more, F.lit("\n<hr>")).otherwise(F.lit(""))))


def page_html(parts: DataFrame, title: Column | None = None, css: str = "") -> DataFrame:
    """(doc_id, page_num, pos, html) -> one document in a page shell, parts joined by line breaks."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "pos", "html"))), lambda x: x["html"]), "\n")
    docs = parts.where(F.col("html") != "").groupBy("doc_id").agg(whole.alias("_body"))
    head = [F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">'), F.concat(F.lit("<title>"), escape_html(title if title is not None else F.col("doc_id").cast("string")), F.lit("</title>")), F.lit(f"<style>{css}</style>"), F.lit("</head>\n<body>")]
    return docs.select("doc_id", F.concat_ws("\n", *head, "_body", F.lit("</body>\n</html>")).alias("html"))
