"""HTML and document-tree rewriting."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.css import alignment_name
from ..functions.text import is_blank, strip

# What counts as an element and as an image paragraph.
ELEMENT = r"(?s)<(p|h[1-6])([^>]*)(>)(.*?)(</\1>)"
IMAGE_PARAGRAPH = r"<p>\s*<img[^>]+>\s*</p>"
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Paragraphs and headings by pattern: adds elem_no, tag, attrs, inner_html.

    The pattern also takes tags that begin with p, such as <pre ...>...</p>.
    """
    matches = F.regexp_extract_all(F.col(html), F.lit(ELEMENT), F.lit(0))
    found = pages.select(*[c for c in pages.columns if c != html], F.posexplode(matches).alias("elem_no", "_e"))
    tag = F.when(F.col("_e").startswith("<p"), "p").otherwise(F.substring("_e", 2, 2))
    open_end = F.locate(">", F.col("_e"))
    attrs = F.substr(F.col("_e"), F.length(tag) + 2, open_end - F.length(tag) - 2)
    inner = F.substr(F.col("_e"), open_end + 1, F.length("_e") - open_end - F.length(tag) - 3)
    return found.select(*found.columns[:-1], tag.alias("tag"), attrs.alias("attrs"), inner.alias("inner_html"))


class _Tree(HTMLParser):
    """Collects the text under each paragraph and heading; an unclosed element lasts to its parent's end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.found: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.found.append([tag, dict(attrs).get("id"), []])
            self.open.append((tag, len(self.found) - 1))
        elif tag not in ("br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"):
            self.open.append((tag, -1))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, at in self.open:
            if at >= 0:
                self.found[at][2].append(data)


_TEXTS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_TEXTS)
def element_texts(html: pd.Series) -> pd.Series:
    """Tag, id and stripped text of each paragraph and heading, by parsing."""

    def parse(value):
        tree = _Tree()
        tree.feed(value or "")
        tree.close()
        return [{"tag": t, "id": i, "text": "".join(x).strip()} for t, i, x in tree.found]

    return html.map(parse)


def parsed_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    rest = [c for c in pages.columns if c != html]
    found = pages.select(*rest, F.posexplode(element_texts(F.col(html))).alias("elem_no", "_e"))
    return found.select(*rest, "elem_no", "_e.tag", "_e.id", "_e.text")


def mark_to_span(html: Column) -> Column:
    """<mark> with a quoted style becomes <span> with all it has, any other a bare <span>.

    The style's name and the case of a styled tag count as written: mixed case stays.
    """
    html = F.regexp_replace(html, r"<(?:mark|MARK)([^>]*style=[\"'][^\"'>]*[\"'][^>]*)>", "<span$1>")
    html = F.regexp_replace(html, r"(?i)<mark(?![^>]*(?-i:style=)[\"'][^\"'>]*[\"'])[^>]*>", "<span>")
    return F.regexp_replace(html, "(?i)</mark>", "</span>")


def inject_css(html: Column, css: Column, literal_breaks: bool = False) -> Column:
    """A style block before </head>, else behind <head>, else in a head of its own in front.

    ``literal_breaks`` writes backslash-n in place of line breaks, as older output has it.
    """
    nl = F.lit("\\n" if literal_breaks else "\n")
    block = F.concat(F.lit("<style>"), nl, css, nl, F.lit("</style>"), nl)
    return (
        F.when(html.contains("</head>"), F.replace(html, F.lit("</head>"), F.concat(block, F.lit("</head>"))))
        .when(html.contains("<head>"), F.replace(html, F.lit("<head>"), F.concat(F.lit("<head>"), block)))
        .otherwise(F.concat(F.lit("<head><style>"), nl, css, nl, F.lit("</style></head>"), nl, html))
    )


def _count(html: Column, needle: str) -> Column:
    return ((F.length(html) - F.length(F.replace(html, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def tag_stats(html: Column) -> Column:
    """How often id=, <p and <h1 to <h6 occur, as plain text."""
    headings = [_count(html, f"<h{i}") for i in range(1, 7)]
    total = headings[0]
    for h in headings[1:]:
        total = total + h
    return F.struct(_count(html, "id=").alias("n_ids"), _count(html, "<p").alias("n_paragraphs"), total.alias("n_headings"))


def image_paragraphs(pages: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """(doc, pos, img): the paragraphs that hold an image alone, in order."""
    found = pages.select(doc, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(IMAGE_PARAGRAPH), F.lit(0))).alias("pos", "_m"))
    return found.select(doc, "pos", F.regexp_substr(F.col("_m"), F.lit("<img[^>]+>")).alias("img"))


def pair_image_paragraphs(images: DataFrame, paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Image paragraphs from the last to the first, each with the next blank aligned paragraph in order.

    images: doc, pos; paragraphs: doc, ord, para_id, text, alignment -> images with para_id and
    align, null where paragraphs run out.
    """
    empty = paragraphs.where(is_blank(F.col("text")) & F.col("alignment").isNotNull())
    slots = empty.select(F.col(doc).alias("_doc"), "para_id", alignment_name(F.col("alignment")).alias("align"), F.row_number().over(Window.partitionBy(doc).orderBy("ord")).alias("_k"))
    last = images.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(F.col("pos").desc())))
    return last.join(slots, (F.col(doc) == F.col("_doc")) & (F.col("_n") == F.col("_k")), "left").select(*images.columns, "para_id", "align")


def wrap_images(pages: DataFrame, paragraphs: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """``pages`` with image paragraphs carrying the id and alignment of the paragraph they are."""
    paired = pair_image_paragraphs(image_paragraphs(pages, doc, html), paragraphs, doc)
    new = F.concat(F.lit('<p id="'), F.col("para_id"), F.lit('" class="word-style-image-paragraph" style="text-align: '), F.col("align"), F.lit('">'), F.col("img"), F.lit("</p>"))
    by_doc = paired.groupBy(F.col(doc).alias("_doc")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(new, F.lit("")).alias("new")))), lambda x: x["new"]).alias("_new"))
    joined = pages.join(by_doc, F.col(doc) == F.col("_doc"), "left")
    # texts between the matches, and the matches themselves, in turn
    gaps, old = F.split(F.col(html), IMAGE_PARAGRAPH, -1), F.regexp_extract_all(F.col(html), F.lit(IMAGE_PARAGRAPH), F.lit(0))
    chosen = F.transform(old, lambda x, i: F.when(F.col("_new")[i] != "", F.col("_new")[i]).otherwise(x))
    rest = F.transform(chosen, lambda x, i: F.concat(x, gaps[i + 1]))
    whole = F.concat(gaps[0], F.array_join(rest, ""))
    return joined.select(*[F.when(F.col("_new").isNull(), F.col(html)).otherwise(whole).alias(html) if c == html else F.col(c) for c in pages.columns])


def set_ids(pages: DataFrame, assigned: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """Writes ``match`` of (doc, elem_no, match) into the opening tags that the pattern finds."""
    by_doc = assigned.where(F.col("match").isNotNull()).groupBy(F.col(doc).alias("_doc")).agg(F.map_from_entries(F.collect_list(F.struct("elem_no", "match"))).alias("_ids"))
    joined = pages.join(by_doc, F.col(doc) == F.col("_doc"), "left")
    old = F.regexp_extract_all(F.col(html), F.lit(ELEMENT), F.lit(0))
    gaps = F.split(F.col(html), ELEMENT, -1)
    opened = lambda x, i: F.when(F.try_element_at(F.col("_ids"), i).isNotNull() & ~F.regexp_substr(x, F.lit("^<[^>]*>")).contains(" id="), F.regexp_replace(x, "^<(p|h[1-6])", F.concat(F.lit("<$1 id=\""), F.try_element_at(F.col("_ids"), i), F.lit('"')))).otherwise(x)
    rest = F.transform(old, lambda x, i: F.concat(opened(x, i), gaps[i + 1]))
    whole = F.concat(gaps[0], F.array_join(rest, ""))
    return joined.select(*[F.when(F.col("_ids").isNull(), F.col(html)).otherwise(whole).alias(html) if c == html else F.col(c) for c in pages.columns])


# ---- document trees --------------------------------------------------------------------------


def inline_text(items: list) -> str:
    """Text of a list of inline nodes; lists that stand in it without a node are skipped."""
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, dict):
            kind, content = item.get("t"), item.get("c")
            fixed = {"Space": " ", "SoftBreak": " ", "LineBreak": "\n"}
            if kind == "Str":
                out.append(content or "")
            elif kind in fixed:
                out.append(fixed[kind])
            elif kind and isinstance(content, list):
                out.append(inline_text(content))
    return "".join(out)


_BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_BLOCKS)
def tree_blocks(trees: pd.Series) -> pd.Series:
    """JSON document tree -> kind and stripped text of its title, paragraphs and headings, nested ones included."""

    def walk(nodes, out):
        for node in nodes if isinstance(nodes, list) else []:
            if isinstance(node, list):
                walk(node, out)
            elif isinstance(node, dict) and "t" in node:
                content = node.get("c")
                if node["t"] in ("Para", "Plain", "Header"):
                    text = inline_text(content).strip() if isinstance(content, list) else ""
                    out.append({"kind": node["t"], "text": text})
                elif isinstance(content, list):
                    walk(content, out)

    def parse(value):
        out: list[dict] = []
        try:
            tree = json.loads(value) if value else {}
        except ValueError:
            return out
        if isinstance(tree, dict):
            title = (tree.get("meta") or {}).get("title")
            if isinstance(title, dict):
                out.append({"kind": "Title", "text": inline_text(title.get("c") or []).strip()})
            walk(tree.get("blocks", []), out)
        else:
            walk(tree, out)
        return out

    return trees.map(parse)


def tree_elements(docs: DataFrame, tree: str = "ast") -> DataFrame:
    """Blocks of document trees as elements that ``matching`` can take (titles and headings match exactly
    only; a heading's text, which stands in a bare list, is empty)."""
    rest = [c for c in docs.columns if c != tree]
    found = docs.select(*rest, F.posexplode(tree_blocks(F.col(tree))).alias("elem_no", "_e"))
    return found.select(*rest, "elem_no", F.col("_e.kind").alias("tag"), F.lit(None).cast("string").alias("id"), strip(F.col("_e.text")).alias("text"))
