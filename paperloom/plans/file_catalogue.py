"""Registered queries on packages, files and images, and the SQL they are compared with."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config, pixels, text
from ..operators import images, layout, markup, matching, report
from ..sources import files, packages, remote, service, sinks
from . import fixtures as fx
from . import sql_text as sql
from .registry import query

# ---- packages --------------------------------------------------------------------------------

_SPACES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
_COLORS = ("ff00aa", "auto", None, "00FF7F")
_MARKS = ("yellow", "darkBlue", None, "lightGray", "nosuch")


def _shared(spark) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _content(value: str) -> str:
    return "</w:t><w:br/><w:t>".join(escape(x) for x in value.split("\n"))


def _run_xml(conv: int, turn: int, value: str) -> str:
    bold = ("<w:b/>", '<w:b w:val="0"/>', "")[turn % 3]
    italic = ("", "<w:i/>")[conv % 2]
    line = ('<w:u w:val="single"/>', '<w:u w:val="none"/>', "")[(conv + turn) % 3]
    font = ('<w:rFonts w:ascii="Arial"/>', "")[turn % 2]
    color = _COLORS[(conv + turn) % 4]
    color = "" if color is None else f'<w:color w:val="{color}"' + (' w:themeColor="accent1"' if color == "auto" else "") + "/>"
    mark = _MARKS[turn % 5]
    mark = "" if mark is None else f'<w:highlight w:val="{mark}"/>'
    size = f'<w:sz w:val="{20 + turn % 7}"/>' if turn % 4 else '<w:sz w:val="broken"/>'
    return f'<w:r><w:rPr>{font}{bold}{italic}{line}{color}{size}{mark}</w:rPr><w:t xml:space="preserve">{_content(value)}</w:t></w:r>'


def _paragraph_xml(conv: int, turn: int, role: str, value: str) -> str:
    indent = ('<w:ind w:left="720" w:firstLine="240"/>', '<w:ind w:start="-10" w:right="30" w:hanging="100"/>', '<w:ind w:left="odd"/>', "")[turn % 4]
    space = ('<w:spacing w:before="120" w:after="60" w:line="360"/>', '<w:spacing w:after="60" w:line="300" w:lineRule="exact"/>', "")[turn % 3]
    return f'<w:p w14:paraId="P{turn}"><w:pPr><w:pStyle w:val="S{turn % 2}"/>{indent}{space}</w:pPr>{_run_xml(conv, turn, role)}<w:r><w:t xml:space="preserve">{_content(value)}</w:t></w:r></w:p>'


def _packed(rows: DataFrame, parts) -> DataFrame:
    """(doc, items) -> (path, content): a package for each row; ``parts`` gives its entries."""

    def write(batches):
        for batch in batches:
            out = []
            for doc, items in zip(batch["doc"], batch["items"], strict=True):
                stream = io.BytesIO()
                with zipfile.ZipFile(stream, "w") as package:
                    for name, content in parts(doc, items):
                        package.writestr(name, content)
                out.append((f"d{doc}.docx", stream.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(write, "path string, content binary")


def _talks(spark, sf_dir) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return fx.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(turns.alias("items"))


def _documents_of_talks(spark, sf_dir) -> DataFrame:
    styles = f'<w:styles {_SPACES}><w:style w:styleId="S0"><w:name w:val="Heading 2"/></w:style></w:styles>'

    def parts(doc, items):
        body = "".join(_paragraph_xml(doc, t["turn"], t["role"], t["text"]) for t in items)
        return [("word/document.xml", f"<w:document {_SPACES}><w:body>{body}</w:body></w:document>"), ("word/styles.xml", styles)]

    return packages.read_docx(_packed(_talks(spark, sf_dir), parts))


_ORD = "(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ord"


@query(
    f"""
    WITH turns AS (SELECT conv_id, turn, role, text, {_ORD} FROM conversations)
    SELECT 'd' || conv_id || '.docx' AS doc_id, ord, 0 AS run_no, 'run_0' AS id, role AS text,
           CASE WHEN turn % 4 = 0 THEN false WHEN turn % 3 = 0 THEN true WHEN turn % 3 = 1 THEN false END AS bold,
           CASE WHEN turn % 4 = 0 THEN false WHEN conv_id % 2 = 1 THEN true END AS italic,
           CASE WHEN turn % 4 = 0 THEN false WHEN (conv_id + turn) % 3 = 0 THEN true WHEN (conv_id + turn) % 3 = 1 THEN false END AS underline,
           CASE WHEN turn % 4 <> 0 AND turn % 2 = 0 THEN 'Arial' END AS font_name, CASE WHEN turn % 4 <> 0 THEN (20 + turn % 7) / 2.0::DOUBLE END AS font_size,
           CASE WHEN turn % 4 <> 0 THEN CASE (conv_id + turn) % 4 WHEN 0 THEN '#FF00AA' WHEN 1 THEN 'theme-accent1' WHEN 3 THEN '#00FF7F' END END AS font_color,
           CASE WHEN turn % 4 <> 0 THEN CASE turn % 5 WHEN 0 THEN '#FFFF00' WHEN 1 THEN '#000080' WHEN 3 THEN '#C0C0C0' END END AS highlight_color
    FROM turns
    UNION ALL SELECT 'd' || conv_id || '.docx', ord, 1, 'run_1', text, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM turns
    """
)
def docx_runs(spark, sf_dir):
    """Runs as read from packages: flags that are on, off or not said, colours, highlights, and runs that can't be read."""
    read = _documents_of_talks(spark, sf_dir)
    return read.select("doc_id", "ord", F.posexplode("runs").alias("run_no", "r")).select("doc_id", "ord", "run_no", "r.*")


@query(
    f"""
    SELECT 'd' || conv_id || '.docx' AS doc_id, {_ORD}, CASE WHEN turn % 2 = 0 THEN 'Heading 2' END AS style_name,
           CASE turn % 4 WHEN 0 THEN 36.0 WHEN 1 THEN -0.5 END::DOUBLE AS left_indent, CASE WHEN turn % 4 = 1 THEN 1.5 END::DOUBLE AS right_indent,
           CASE turn % 4 WHEN 0 THEN 12.0 WHEN 1 THEN -5.0 END::DOUBLE AS first_line_indent, CASE WHEN turn % 3 = 0 THEN 6.0 END::DOUBLE AS space_before,
           CASE WHEN turn % 3 = 0 THEN 3.0 END::DOUBLE AS space_after, CASE turn % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 15.0 END::DOUBLE AS line_spacing
    FROM conversations
    """
)
def docx_formats(spark, sf_dir):
    """Paragraph formats as read from packages; space behind counts only where space in front is set."""
    return _documents_of_talks(spark, sf_dir).select("doc_id", "ord", "style_name", "paragraph_format.*")


@query(
    """
    SELECT 'd' || conv_id || '.docx' AS doc_id, count(*) FILTER (WHERE turn % 4 < 3)::BIGINT AS n_paragraphs, count(*) FILTER (WHERE turn % 4 IN (1, 2))::BIGINT AS n_synthetic,
           count(*) FILTER (WHERE turn % 4 = 2)::BIGINT AS n_images, string_agg(CASE turn % 4 WHEN 0 THEN 'own' ELSE 'made' END, ',' ORDER BY turn) FILTER (WHERE turn % 4 < 3) AS ids
    FROM conversations GROUP BY conv_id
    """
)
def docx_synthetic_ids(spark, sf_dir):
    """Paragraphs without an id get one if they have a text or an image, and go if they have neither."""

    def parts(doc, items):
        kinds = ('<w:p w14:paraId="OWN{0}"><w:r><w:t>x</w:t></w:r></w:p>', "<w:p><w:r><w:t>{0} of {1}</w:t></w:r></w:p>", '<w:p><w:r><w:drawing><graphic n="{0}"/></w:drawing></w:r></w:p>', "<w:p><w:r><w:t> </w:t></w:r></w:p>")
        body = "".join(kinds[t["turn"] % 4].format(t["turn"], doc) for t in items)
        return [("word/document.xml", f"<w:document {_SPACES}><w:body>{body}</w:body></w:document>")]

    read = packages.read_docx(_packed(_talks(spark, sf_dir), parts))
    made = F.col("para_id").rlike(r"^hash_text_[0-9]{6}\z") & F.col("fallback")
    kind = F.struct("ord", F.when(made, "made").when(F.col("para_id").startswith("OWN") & ~F.col("fallback"), "own").alias("k"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(kind)), lambda x: x["k"]), ",")
    seen = read.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_if(made).alias("n_synthetic"), F.count_if(text.is_blank(F.col("text"))).alias("n_images"), ids.alias("ids"))
    every = fx.table(spark, sf_dir, "conversations").select(F.concat(F.lit("d"), F.col("conv_id"), F.lit(".docx")).alias("doc_id")).distinct()
    return every.join(seen, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_paragraphs", "n_synthetic", "n_images")], "ids")


@query(
    """
    SELECT 'd' || doc_id // 10 || '.docx' AS doc_id, 'word/media/image' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.png' ELSE '.JPEG' END AS entry,
           'image' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.png' ELSE '.JPEG' END AS name, md5(text) AS md5
    FROM documents WHERE doc_id % 3 < 2
    """
)
def docx_media(spark, sf_dir):
    """Embedded images of packages: entries of the media folder with an image's suffix."""
    docs = fx.table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("doc")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("items"))

    def parts(doc, items):
        suffix = (".png", ".JPEG", ".emf")
        entries = [(f"word/media/image{x['doc_id']}{suffix[x['doc_id'] % 3]}", x["text"] or "") for x in items]
        return [("word/document.xml", "<x/>"), ("word/thumbnail.png", "no"), *entries]

    media = packages.package_media(_packed(docs, parts))
    return media.select("doc_id", "entry", "name", F.md5("content").alias("md5"))


@query("SELECT 'd' || conv_id || '.docx' AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1)::INTEGER AS pos, 'OPS/text/t' || turn || '.xhtml' AS entry, md5('<p>' || text || '</p>') AS md5 FROM conversations WHERE turn % 5 < 4")
def epub_parts(spark, sf_dir):
    """Parts of e-books in reading order, which here runs against that of the files; what isn't in the spine stays out."""

    def parts(doc, items):
        used = [t for t in items if t["turn"] % 5 < 4]
        manifest = "".join(f'<item id="i{t["turn"]}" href="text/t{t["turn"]}.xhtml"/>' for t in items)
        spine = "".join(f'<itemref idref="i{t["turn"]}"/>' for t in reversed(used))
        book = f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{manifest}</manifest><spine>{spine}<itemref idref="none"/></spine></package>'
        container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
        return [("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("OPS/book.opf", book), *[(f"OPS/text/t{t['turn']}.xhtml", f"<p>{t['text']}</p>") for t in items]]

    read = packages.read_epub(_packed(_talks(spark, sf_dir), parts))
    return read.select("doc_id", "pos", "entry", F.md5(F.col("html").cast("binary")).alias("md5"))


@query(
    f"""
    SELECT 'd' || conv_id || '.docx' AS doc_id,
           string_agg(CASE WHEN turn % 2 = 0 THEN '<h2 id="P' || turn || '">' || {sql.escaped("role || text")} || '</h2>' ELSE '<p id="P' || turn || '">' || {sql.escaped("role || text")} || '</p>' END, chr(10) ORDER BY turn) AS html
    FROM conversations GROUP BY conv_id
    """
)
def docx_html(spark, sf_dir):
    return packages.paragraphs_to_html(_documents_of_talks(spark, sf_dir))


# ---- files -----------------------------------------------------------------------------------


@query(
    """
    SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'epub' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'html' ELSE 'other' END AS branch FROM pages
    """
)
def file_routes(spark, sf_dir):
    """Each file in the one branch that converts it."""
    name = F.concat(F.lit("f."), F.element_at(F.array(*[F.lit(x) for x in ("docx", "pdf", "epub", "txt", "md", "htm", "odt", "rtf")]), (F.pmod("page_id", F.lit(8)) + 1).cast("int")))
    named = fx.table(spark, sf_dir, "pages").select("page_id", files.detect_format(name).alias("format"))
    branches = [part.select("page_id", F.lit(branch).alias("branch")) for branch, part in files.route(named).items()]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


@query(
    r"""
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'etc_my_file.docx' WHEN 1 THEN '文档.docx' WHEN 2 THEN 'a_b.pdf' WHEN 3 THEN 'dir_x.txt' WHEN 4 THEN '...' ELSE 'bn.html' END AS name FROM pages
    """
)
def safe_names(spark, sf_dir):
    """Upload names without paths or odd characters; as they are where nothing usable is left."""
    names = F.array(*[F.lit(x) for x in ("../etc/my file.docx", "文档.docx", "a \t b.pdf", "dir\\x.txt", "...", "b&*n.html")])
    return fx.table(spark, sf_dir, "pages").select("page_id", files.safe_name(F.element_at(names, (F.pmod("page_id", F.lit(6)) + 1).cast("int"))).alias("name"))


@query(
    """
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'a,b' ELSE '' END AS doc_styles, CASE WHEN page_id % 4 = 1 THEN 'k' ELSE '' END AS pdf_classes FROM pages
    """
)
def request_config(spark, sf_dir):
    """Style settings of requests; what can't be parsed counts as none."""
    body = F.element_at(F.array(*[F.lit(x) for x in ('{"doc":{"allowed_styles":["a","b"]}}', '{"pdf":{"allowed_classes":["k"]}}', "{broken", "3")]), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    parsed = fx.table(spark, sf_dir, "pages").select("page_id", config.parse_config(body).alias("c"))
    joined = lambda fmt, key: F.coalesce(F.array_join(F.try_element_at(F.col("c"), F.lit(fmt))[key], ","), F.lit(""))
    return parsed.select("page_id", joined("doc", "allowed_styles").alias("doc_styles"), joined("pdf", "allowed_classes").alias("pdf_classes"))


@query("SELECT doc_id || '.html' AS name, octet_length(encode(text))::BIGINT AS bytes, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def written_files(spark, sf_dir):
    """One file for each document, written on the executors and read back from the folder."""
    docs = fx.table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    folder = _shared(spark).removeprefix("file://")
    named = docs.select(F.concat(F.lit("any/where/"), F.col("doc_id"), F.lit(".html")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    sinks.write_files(named, folder).write.format("noop").mode("overwrite").save()
    read = files.read_files(spark, f"file://{folder}", "*.html")
    return read.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.col("length").alias("bytes"), F.md5("content").alias("md5"))


@query(
    """
    SELECT format, extensions, styles, classes FROM (VALUES
      ('doc', '.doc', 7, 7), ('docx', '.docx', 0, 0), ('epub', '.epub', 10, 12), ('html', '.htm,.html', 0, 0), ('markdown', '.md', 0, 0), ('odt', '.odt', 0, 0),
      ('pdf', '.pdf', 7, 7), ('plain', '.txt', 0, 0), ('rtf', '.rtf', 0, 0)) AS t(format, extensions, styles, classes)
    """
)
def service_formats(spark, sf_dir):
    """What the service says of itself: formats with their extensions and the sizes of their allow-lists."""
    known, defaults = service.formats(spark), service.defaults(spark)
    return known.join(defaults, "format", "left").select("format", F.array_join("extensions", ",").alias("extensions"), F.coalesce(F.size("allowed_styles"), F.lit(0)).alias("styles"), F.coalesce(F.size("allowed_classes"), F.lit(0)).alias("classes"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'spans' WHEN page_id % 3 = 1 THEN 'text' ELSE 'none' END AS engine FROM pages")
def pdf_engines(spark, sf_dir):
    """Which reader a PDF goes to: positioned spans before page texts, nothing else."""
    three = F.pmod("page_id", F.lit(3))
    return fx.table(spark, sf_dir, "pages").select("page_id", F.coalesce(service.pdf_engine(three == 0, three < 2), F.lit("none")).alias("engine"))


# ---- images ----------------------------------------------------------------------------------


@query(f"WITH {fx.IMAGES_SQL} SELECT doc, page, index, row_number() OVER (PARTITION BY doc, page ORDER BY y0, index)::INTEGER AS pos FROM judged")
def image_order(spark, sf_dir):
    return images.ordered_images(fx.images(spark, sf_dir)).select("doc", "page", "index", "pos")


@query(
    f"""
    WITH {fx.IMAGES_SQL}, blocks AS (SELECT doc_id // 20 AS doc, doc_id % 4 AS page, min(doc_id) AS b FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
    SELECT i.doc, i.page, i.index, CASE WHEN b IS NULL THEN 0.0 ELSE b::DOUBLE END AS x0, CASE WHEN b IS NULL THEN 600.0 ELSE b + 5.0::DOUBLE END AS x1
    FROM judged i LEFT JOIN blocks USING (doc, page)
    """
)
def image_rects(spark, sf_dir):
    """The rectangle of a page's first image block, or the page's own."""
    blocks = fx.images(spark, sf_dir).where(F.pmod("index", F.lit(3)) == 0)
    box = [F.col("index").cast("double").alias("x0"), F.lit(1.0).alias("y0"), (F.col("index") + 5.0).alias("x1"), F.lit(2.0).alias("y1")]
    pages = fx.images(spark, sf_dir).select("doc", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1")).distinct()
    found = images.first_image_rect(fx.images(spark, sf_dir), blocks.select("doc", "page", F.col("index").alias("block_no"), *box), pages)
    return found.select("doc", "page", "index", "x0", "x1")


@query(
    f"""
    WITH {fx.MARKED_PAGES_SQL}, made AS (
      SELECT page_id, html, '<p id="p' || page_id || '-1" class="word-style-image-paragraph" style="text-align: center">' AS one,
             '<p id="p' || page_id || '-2" class="word-style-image-paragraph" style="text-align: right">' AS two FROM marked
    )
    SELECT page_id, CASE page_id % 5
      WHEN 0 THEN replace(html, '<p><img src="http://pics', one || '<img src="http://pics')
      WHEN 2 THEN replace(html, '<p><img src="data:', one || '<img src="data:')
      WHEN 3 THEN replace(replace(html, '<p><img src="pic', one || '<img src="pic'), '<p><img src="#', CASE WHEN page_id % 2 = 0 THEN two ELSE '<p>' END || '<img src="#')
      ELSE html END AS html
    FROM made
    """
)
def image_paragraphs(spark, sf_dir):
    """Image paragraphs rewritten from the last to the first with the blank aligned paragraphs they stand for."""
    pages = fx.marked_pages(spark, sf_dir).withColumnRenamed("page_id", "doc_id")
    row = lambda i, body, align: F.struct(F.lit(i).alias("ord"), F.concat(F.lit("p"), F.col("doc_id"), F.lit(f"-{i}")).alias("para_id"), F.lit(body).alias("text"), F.lit(align).alias("alignment"))
    rows = F.array(row(0, "words", "left"), row(1, " ", "center"), row(3, "", None), row(2, "\t", "right"))
    rows = F.filter(rows, lambda r: (r["ord"] != 2) | (F.pmod("doc_id", F.lit(2)) == 0))
    paragraphs = pages.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
    return markup.wrap_images(pages, paragraphs).select(F.col("doc_id").alias("page_id"), "html")


@query(
    f"""
    WITH {fx.MARKED_PAGES_SQL}, srcs AS (
      SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS src FROM (SELECT page_id, regexp_extract_all(html, '(?i)<img[^>]+src=["'']([^"'']+)["''][^>]*>', 1) AS l FROM marked)
    )
    SELECT page_id, pos, CASE WHEN page_id % 2 = 0 THEN 'store/' || regexp_extract(src, '([^/]*)$') END AS path FROM srcs
    """
)
def media_resolved(spark, sf_dir):
    """Local images by their base name in the document's media."""
    sources = fx.marked_pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.posexplode(images.image_sources(F.col("html"))).alias("pos", "src"))
    name = F.regexp_extract("src", r"([^/]*)\z", 1)
    media = sources.where(F.pmod("doc_id", F.lit(2)) == 0).select("doc_id", name.alias("name"), F.concat(F.lit("store/"), name).alias("path"))
    return images.resolve_local(sources, media.unionByName(media)).select(F.col("doc_id").alias("page_id"), "pos", "path")


@query(
    """
    WITH s AS (
      SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://a.org/' || page_id % 7 || '.png' WHEN 1 THEN 'https://b.org/x' WHEN 2 THEN 'ftp://c.org/y.gif' WHEN 3 THEN 'http://short.org/z.bmp' ELSE 'http://fails.org/q.png' END AS src FROM pages
    ), c AS (SELECT *, CASE page_id % 5 WHEN 0 THEN repeat(src, 10) WHEN 1 THEN repeat(src, 10) END AS content FROM s)
    SELECT page_id, substr(md5(content), 1, 16) || CASE WHEN page_id % 5 = 0 THEN '.png' ELSE '.jpg' END AS name, octet_length(encode(content))::BIGINT AS n_bytes FROM c
    """
)
def remote_images(spark, sf_dir):
    """Each address is fetched once, by a stand-in here; what is too short or fails has no name."""
    kinds = [F.concat(F.lit("http://a.org/"), F.pmod("page_id", F.lit(7)), F.lit(".png")), *map(F.lit, ("https://b.org/x", "ftp://c.org/y.gif", "http://short.org/z.bmp", "http://fails.org/q.png"))]
    sources = fx.table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*kinds), (F.pmod("page_id", F.lit(5)) + 1).cast("int")).alias("src"))

    def fetch(url: str) -> bytes:
        if "fails" in url:
            raise OSError(url)
        return url.encode() * (1 if "short" in url else 10)

    return remote.fetched(sources, fetch).select("page_id", "name", F.length("content").cast("long").alias("n_bytes"))


@query(
    """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' ELSE 'P' END AS mode, 40::INTEGER AS px_width, (doc_id % 30 + 21)::INTEGER AS px_height,
           (doc_id % 19 + 1)::INTEGER AS n_colors, 3::INTEGER AS grey_min, (3 + 5 * (doc_id % 19))::INTEGER AS grey_max
    FROM documents
    UNION ALL SELECT -1, NULL, NULL, NULL, NULL, NULL, NULL
    """
)
def image_pixels(spark, sf_dir):
    """Sizes, modes, colours and grey ranges of images decoded on the executors; what is no image has none."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id").unionByName(spark.createDataFrame([(-1,)], "doc_id long"))

    def draw(ids: pd.Series) -> pd.Series:
        def image(i: int) -> bytes:
            if i < 0:
                return b"no image"
            grey = [[3 + 5 * ((x + y) % (i % 19 + 1)) for x in range(40)] for y in range(i % 30 + 21)]
            return pixels.encode_png(grey, ("L", "RGB", "P")[i % 3])

        return ids.map(image)

    made = docs.select("doc_id", F.pandas_udf(draw, "binary")(F.col("doc_id")).alias("content"))
    return made.select("doc_id", pixels.pixel_stats(F.col("content")).alias("s")).select("doc_id", "s.*")


# ---- texts and reports -----------------------------------------------------------------------


@query(
    f"""
    WITH l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
    SELECT doc_id, count(*) FILTER (WHERE {sql.strip('line')} <> '')::INTEGER AS n, coalesce(string_agg({sql.normalized('line')}, '|' ORDER BY n) FILTER (WHERE {sql.strip('line')} <> ''), '') AS paragraphs
    FROM l GROUP BY doc_id
    """
)
def normalize_lists(spark, sf_dir):
    """Lists of paragraphs: blank ones go, the others are normalised."""
    lists = fx.table(spark, sf_dir, "documents").select("doc_id", text.normalize_paragraphs(F.split("text", "\n")).alias("p"))
    return lists.select("doc_id", F.size("p").alias("n"), F.array_join("p", "|").alias("paragraphs"))


@query("SELECT char, (row_number() OVER (ORDER BY unicode(char)))::INTEGER AS pos FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> ''")
def char_order(spark, sf_dir):
    """All distinct characters in code point order."""
    return text.ordered_characters(fx.table(spark, sf_dir, "documents")).select("char", "pos")


@query(
    f"""
    SELECT book AS doc_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>' || book || ' &amp; more</title>' || chr(10)
           || '<style>p{{}}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || string_agg(html, chr(10) ORDER BY page_num, pos, html) || chr(10) || '</body>' || chr(10) || '</html>' AS html
    FROM (
      SELECT doc_id // 5 AS book, doc_id % 5 AS page_num, 0 AS pos, '<p>' || {sql.escaped("text[:40]")} || '</p>' AS html FROM documents
      UNION ALL SELECT doc_id // 5, doc_id % 5, 1, '<img src="' || doc_id || '">' FROM documents WHERE doc_id % 3 = 0
    ) GROUP BY book
    """
)
def page_shell(spark, sf_dir):
    """Paragraphs and images of pages in one document with its shell."""
    docs = fx.table(spark, sf_dir, "documents")
    place = [F.floor(F.col("doc_id") / 5).alias("book"), F.pmod("doc_id", F.lit(5)).alias("page_num")]
    paragraphs = docs.select(*place, F.lit(0).alias("pos"), F.concat(F.lit("<p>"), text.escape_html(F.substring("text", 1, 40)), F.lit("</p>")).alias("html"))
    pictures = docs.where(F.pmod("doc_id", F.lit(3)) == 0).select(*place, F.lit(1).alias("pos"), F.concat(F.lit('<img src="'), F.col("doc_id"), F.lit('">')).alias("html"))
    blank = docs.select(*place, F.lit(2).alias("pos"), F.lit("").alias("html"))
    parts = paragraphs.unionByName(pictures).unionByName(blank).withColumnRenamed("book", "doc_id")
    return layout.page_html(parts, F.concat(F.col("doc_id"), F.lit(" & more")), "p{}")


@query(
    """
    SELECT conv_id AS doc_id, count(*)::BIGINT AS n_paragraphs, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (WHERE turn % 3 <> 1)::BIGINT AS n_matched,
           count(*) FILTER (WHERE turn % 2 = 0 AND turn % 3 <> 1)::BIGINT AS n_styled
    FROM conversations GROUP BY conv_id
    """
)
def conversion_report(spark, sf_dir):
    """Paragraphs, characters, matched and styled elements of each document."""
    talk = fx.table(spark, sf_dir, "conversations")
    para = F.concat(F.lit("P"), F.col("turn"))
    paragraphs = talk.select(F.col("conv_id").alias("doc_id"), para.alias("para_id"), "text")
    elements = talk.select(F.col("conv_id").alias("doc_id"), F.when(F.pmod("turn", F.lit(3)) != 1, para).alias("id"), F.when(F.pmod("turn", F.lit(2)) == 0, "color: red").otherwise("").alias("style"))
    return report.conversion_report(elements, paragraphs)


@query(
    """
    WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
    p AS (SELECT conv_id, trim(replace(text, chr(10), ' ')) AS s, max_by('P' || k, k) AS id FROM t WHERE trim(replace(text, chr(10), ' ')) <> '' GROUP BY ALL)
    SELECT e.conv_id, e.k::INTEGER AS elem_no, e.tag, p.id AS match FROM (
      SELECT conv_id, 0 AS k, 'Title' AS tag, '' AS s FROM t WHERE k = 0
      UNION ALL SELECT conv_id, k + 1, CASE WHEN k % 2 = 0 THEN 'Para' ELSE 'Plain' END, trim(replace(text, chr(10), ' ')) FROM t
    ) e LEFT JOIN p ON e.conv_id = p.conv_id AND e.s = p.s
    """
)
def tree_ids(spark, sf_dir):
    """Blocks of document trees matched with paragraphs: paragraphs by text or likeness, titles and headings by text alone."""
    talk = fx.table(spark, sf_dir, "conversations")
    flat = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    word = F.array(F.struct(F.lit("Str").alias("t"), flat.alias("c")))
    turns = F.sort_array(F.collect_list(F.struct("turn", word.alias("w"), flat.alias("s"))))
    grouped = talk.groupBy("conv_id").agg(turns.alias("x"))
    block = lambda x, i: F.to_json(F.struct(F.when(i % 2 == 0, "Para").otherwise("Plain").alias("t"), x["w"].alias("c")))
    title = F.lit('{"t":"MetaInlines","c":[{"t":"Str","c":"no paragraph has this"}]}')
    tree = F.concat(F.lit('{"meta":{"title":'), title, F.lit('},"blocks":['), F.array_join(F.transform("x", block), ","), F.lit("]}"))
    elements = markup.tree_elements(grouped.select("conv_id", tree.alias("ast")))
    paragraphs = grouped.select("conv_id", F.posexplode("x").alias("ord", "r")).select("conv_id", "ord", F.concat(F.lit("P"), F.col("ord")).alias("para_id"), F.col("r.s").alias("text"))
    matched = matching.assign_ids(elements, paragraphs, ["conv_id"], exact_only=F.col("tag").isin("Header", "Title"))
    return matched.select("conv_id", "elem_no", "tag", "match")
