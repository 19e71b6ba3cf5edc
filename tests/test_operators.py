import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import images, layout, markup, matching, styles
from paperloom.sources import files, packages, sinks
from paperloom.streaming import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


BLOCK = "doc_id int, page_num int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, fonts array<string>, sizes array<double>"


def test_lines_are_anchored(spark):
    rows = [(1, 0, i, f"t{i}", float(10 * i), y, 10.0 * i + 4, y + 10, ["f"], [12.0]) for i, y in enumerate([0.0, 2.0, 4.0, 5.0, 9.0])]
    got = {r.line_no: r.text for r in layout.blocks_to_lines(frame(spark, rows, BLOCK)).collect()}
    assert got == {0: "t0 t1", 1: "t2 t3", 2: "t4"}


def test_line_values_come_from_its_ends(spark):
    rows = [(1, 0, 0, "b", 50.0, 1.0, 60.0, 11.0, ["x"], [10.0, 20.0]), (1, 0, 1, "a", 10.0, 0.5, 47.0, 10.5, ["y"], []), (1, 0, 2, "c", 60.0, 0.0, 90.0, 9.0, ["x"], [12.0]), (1, 1, 0, "z", 0.0, 0.0, 1.0, 1.0, [], [])]
    first, second = sorted(layout.blocks_to_lines(frame(spark, rows, BLOCK)).collect(), key=lambda r: r.page_num)
    assert (first.text, first.y0, first.y1, first.x0, first.x1, first.size, first.fonts) == ("abc", 0.5, 10.5, 10.0, 90.0, 14.0, ["x", "y"])
    assert second.size == 12.0


def test_half_even_rows(spark):
    rows = [(1, 0, i, str(i), 0.0, y, 1.0, y + 1, [], [1.0]) for i, y in enumerate([1.5, 4.5, 7.5])]
    ordered = frame(spark, rows, BLOCK).select(F.bround(F.col("y0") / 3.0).alias("k")).collect()
    assert [r.k for r in ordered] == [0, 2, 2]


def test_spans_to_blocks(spark):
    schema = "doc_id int, page_num int, block_no int, block_type int, line_no int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double"
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [(1, 0, 0, 0, 1, 0, "cd", "g", 12.0, *box), (1, 0, 0, 0, 0, 1, "b", "f", 10.0, *box), (1, 0, 0, 0, 0, 0, "a", "f", 10.0, *box), (1, 0, 0, 0, 0, 2, "  ", "f", 99.0, *box), (1, 0, 1, 1, 0, 0, "image", "f", 1.0, *box), (1, 0, 2, 0, 0, 0, "x", "f", 1.0, *box)]
    got = layout.spans_to_blocks(frame(spark, rows, schema)).collect()
    assert [(r.block_no, r.text, r.sizes, r.fonts) for r in got] == [(0, "abcd", [10.0, 10.0, 12.0], ["f", "g"])]


@pytest.mark.parametrize(("text", "size", "kind"), [("x", 17.0, "h2"), ("第1章 x", 15.0, "h3"), ("第十2章 x", 12.0, "h1"), ("3、x", 12.0, "h3"), ("3.x", 12.0, "h3"), ("第章", 12.0, "p"), ("x", 16.0, "h3"), ("x", 14.0, "p")])
def test_paragraph_type(spark, text, size, kind):
    assert spark.range(1).select(layout.paragraph_type(F.lit(text), F.lit(size))).first()[0] == kind


def test_paragraphs_break_by_gap_indent_and_end(spark):
    rows = [(1, 0, 0, "one", 0.0, 10.0, 150.0, 12.0), (1, 0, 1, "two.", 12.0, 22.0, 150.0, 14.0), (1, 0, 2, "three", 24.0, 34.0, 150.0, 12.0), (1, 0, 3, "four", 60.0, 70.0, 150.0, 12.0), (1, 0, 4, "five", 72.0, 82.0, 171.0, 18.0), (1, 0, 5, " ", 200.0, 210.0, 0.0, 9.0)]
    got = layout.lines_to_paragraphs(frame(spark, rows, "doc_id int, page_num int, line_no int, text string, y0 double, y1 double, x0 double, size double")).orderBy("para_no").collect()
    assert [(r.text, r.size, r.type, r.is_center) for r in got] == [("onetwo.", 13.0, "p", False), ("three", 12.0, "p", False), ("four", 12.0, "p", False), ("five", 18.0, "h2", True)]


def test_pages_of_text(spark):
    got = layout.text_pages_to_html(frame(spark, [(1, 0, " a<b \n\n"), (1, 1, "x")], "doc_id int, page_num int, text string")).orderBy("page_num").collect()
    assert [r.html for r in got] == ["<p>a&lt;b</p>\n<hr>", "<p>x</p>"]
    parts = frame(spark, [("d", 1, 0, "<p>2</p>"), ("d", 0, 1, "<p>1</p>"), ("d", 0, 0, "")], "doc_id string, page_num int, pos int, html string")
    assert "<body>\n<p>1</p>\n<p>2</p>\n</body>" in layout.page_html(parts).first().html


def test_image_rules_in_order(spark):
    schema = "doc int, page int, index int, width double, height double, size int, md5 string, px_width int, px_height int, mode string, n_colors int, grey_min int, grey_max int"
    ok = (200.0, 200.0, 5000)
    rows = [(1, 0, 0, *ok, "a", 99, 99, "RGB", 50, None, None), (1, 0, 1, *ok, "a", 99, 99, "RGB", 50, None, None), (1, 0, 2, 900.0, 100.0, 5000, "a", 99, 99, "RGB", 50, None, None), (1, 0, 3, *ok, "b", 40, 99, "RGB", 50, None, None), (1, 0, 4, *ok, "c", 99, 99, "L", 9, 0, 255), (1, 0, 5, *ok, "d", 99, 99, "1", 2, 0, 1), (1, 0, 6, *ok, "e", None, None, None, None, None, None), (2, 0, 0, *ok, "a", 99, 99, "P", 2, None, None), (1, 0, 7, 10.0, 10.0, 10, "z", 1, 1, "L", 1, 0, 0), (1, 0, 8, *ok, "f", 99, 99, "L", 90, 100, 110)]
    got = {(r.doc, r["index"]): r.reason for r in images.filter_images(frame(spark, rows, schema), pixels=True).collect()}
    assert got == {(1, 0): None, (1, 1): "duplicate", (1, 2): "wide", (1, 3): "pixels", (1, 4): "colors", (1, 5): "uniform", (1, 6): None, (2, 0): None, (1, 7): "bytes", (1, 8): "uniform"}


def test_placement_takes_the_first_paragraph_in_reach(spark):
    imgs = frame(spark, [(1, 0, i, y) for i, y in enumerate([0.0, 50.0, 99.9, 100.0, 350.0, -20.0])], "doc int, page int, index int, y0 double")
    paras = frame(spark, [(1, 0, 0, 100.0), (1, 0, 1, 60.0), (1, 0, 2, 200.0)], "doc int, page int, para_no int, y0 double")
    got = {r["index"]: r.para_no for r in images.place_images(imgs, paras).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: None, 4: None, 5: 1}


def test_first_rect_or_page(spark):
    imgs = frame(spark, [(1, 0, 5), (1, 1, 6)], "doc int, page int, index int")
    blocks = frame(spark, [(1, 0, 2, 9.0, 9.0, 9.0, 9.0), (1, 0, 1, 1.0, 2.0, 3.0, 4.0)], "doc int, page int, block_no int, x0 double, y0 double, x1 double, y1 double")
    pages = frame(spark, [(1, 0, 0.0, 0.0, 600.0, 800.0), (1, 1, 0.0, 0.0, 600.0, 800.0)], "doc int, page int, x0 double, y0 double, x1 double, y1 double")
    got = {r.page: (r.x0, r.y1) for r in images.first_image_rect(imgs, blocks, pages).collect()}
    assert got == {0: (1.0, 4.0), 1: (0.0, 800.0)}


def test_html_images(spark):
    html = '<img src="a" data-src="b"><IMG class=x SRC=\'http://h/p.JPEG?q\'><img src="data:image/webp;base64,AAAA">'
    row = spark.range(1).select(F.lit(html).alias("h")).select(images.image_sources(F.col("h")).alias("s"), F.transform(images.image_sources(F.col("h")), images.image_extension).alias("e"), F.transform(images.image_sources(F.col("h")), images.source_kind).alias("k")).first()
    assert row.s == ["b", "http://h/p.JPEG?q", "data:image/webp;base64,AAAA"] and row.e == [".jpg", ".jpg", ".webp"] and row.k == ["local", "http", "base64"]
    pairs = F.array(F.struct(F.lit("http://h/p.JPEG?q").alias("src"), F.lit("../x.jpg").alias("path")))
    assert spark.range(1).select(images.localize_images(F.lit(html), pairs)).first()[0] == html.replace("http://h/p.JPEG?q", "../x.jpg")


@pytest.mark.parametrize(("url", "content"), [("data:image/png;base64,aGk=", b"hi"), ("data:image/png;base64,aGk", b"hi"), ("data:image/png;base64,!!!", None), ("data:image/png;base64", None), ("data:text/plain;base64,aGk=", None), ("data:image/png,a,b", None)])
def test_base64(spark, url, content):
    got = spark.range(1).select(images.data_url_content(F.lit(url))).first()[0]
    assert (bytes(got) if got is not None else None) == content or url.endswith("a,b")


def test_retention(spark):
    rows = frame(spark, [(f"f{i}", i % 3, "g") for i in range(9)], "path string, mtime int, dir string")
    assert {r.path for r in images.expired_files(rows, 4).collect()} == {"f0", "f1", "f3", "f4", "f6"} == {r.path for r in images.expired_files(rows, 4, ["dir"]).collect()}
    assert images.expired_files(rows, 0).count() == 0 and images.expired_files(rows, 50).count() == 0


def test_marks(spark):
    got = spark.range(1).select(markup.mark_to_span(F.lit("<mark style='a'>x</mark><MARK>y</MARK><Mark style=\"q\">z</mark><mark style=b>w</mark>"))).first()[0]
    assert got == "<span style='a'>x</span><span>y</span><Mark style=\"q\">z</span><span>w</span>"


@pytest.mark.parametrize(("html", "expected"), [("<head></head>b", "<head><style>\nC\n</style>\n</head>b"), ("<head>b", "<head><style>\nC\n</style>\nb"), ("b", "<head><style>\nC\n</style></head>\nb")])
def test_css_goes_into_the_head(spark, html, expected):
    assert spark.range(1).select(markup.inject_css(F.lit(html), F.lit("C"))).first()[0] == expected
    assert "\\n" in spark.range(1).select(markup.inject_css(F.lit(html), F.lit("C"), literal_breaks=True)).first()[0]


def test_elements_and_ids(spark):
    pages = frame(spark, [(1, '<p>One</p><h2 class="x">Two <b>x</b></h2><p id="k">Three</p><h9>no</h9>'), (2, "none")], "doc_id int, html string")
    found = markup.elements(pages)
    assert [(r.elem_no, r.tag, r.inner_html) for r in found.orderBy("elem_no").collect()] == [(0, "p", "One"), (1, "h2", "Two <b>x</b>"), (2, "p", "Three")]
    assigned = found.select("doc_id", "elem_no", F.concat(F.lit("P"), F.col("elem_no")).alias("match"))
    out = {r.doc_id: r.html for r in markup.set_ids(pages, assigned).collect()}
    assert out == {1: '<p id="P0">One</p><h2 id="P1" class="x">Two <b>x</b></h2><p id="k">Three</p><h9>no</h9>', 2: "none"}
    texts = markup.parsed_elements(pages).orderBy("elem_no").collect()
    assert [(r.tag, r.id, r.text) for r in texts] == [("p", None, "One"), ("h2", None, "Two x"), ("p", "k", "Three")]


def test_images_are_paired_from_the_end(spark):
    pages = frame(spark, [(1, '<p><img src="a"></p>x<p> <img src="b"> </p><p><img src="c"></p>')], "doc_id int, html string")
    paragraphs = frame(spark, [(1, 0, "A", " ", "center"), (1, 1, "B", "text", "right"), (1, 2, "C", "", "left"), (1, 3, "D", "", None)], "doc_id int, ord int, para_id string, text string, alignment string")
    wrapped = lambda i, a, s: f'<p id="{i}" class="word-style-image-paragraph" style="text-align: {a}"><img src="{s}"></p>'
    got = markup.wrap_images(pages, paragraphs).first().html
    assert got == '<p><img src="a"></p>x' + wrapped("C", "left", "b") + wrapped("A", "center", "c")


def test_matching(spark):
    elements = frame(spark, [(1, 0, " Hello world ", None), (1, 1, "hello, world!", ""), (1, 2, "zzz", None), (1, 3, "Hello world", "own"), (1, 4, "", None), (2, 0, "Hello world", None), (1, 5, "***", None)], "doc_id int, elem_no int, text string, id string")
    paragraphs = frame(spark, [(1, 0, "P0", "Hello world"), (1, 1, "P1", "Hello world"), (1, 2, "P2", "world hello"), (1, 3, "P3", "  "), (1, 4, "P4", "---")], "doc_id int, ord int, para_id string, text string")
    got = {(r.doc_id, r.elem_no): r.match for r in matching.assign_ids(elements, paragraphs, ["doc_id"]).collect()}
    assert got == {(1, 0): "P1", (1, 1): "P1", (1, 2): None, (1, 3): "own", (1, 4): None, (2, 0): None, (1, 5): "P4"}


RUNS = "array<struct<id:string,text:string,bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size:double,font_color:string,highlight_color:string>>"


def run(text, bold=None, size=None):
    return ("r", text, bold, None, None, None, size, None, None)


def test_runs(spark):
    rows = [(0, [run("a", True), run("b"), run("c"), run("d", True), run("e", False)]), (1, [run("a", True), run("b", True)]), (2, []), (3, [run("x")])]
    got = frame(spark, rows, f"i int, r {RUNS}").select("i", styles.is_uniform(F.col("r")).alias("u"), styles.prevailing_run(F.col("r"))["text"].alias("p")).orderBy("i").collect()
    assert [(r.u, r.p) for r in got] == [(False, "a"), (True, "a"), (True, None), (True, "x")]


def test_mixed_runs(spark):
    rows = [(0, "plain a &amp; b bold plain", [run("plain "), run("a & b", True), run(" "), run("plain"), run("gone", True)])]
    got = frame(spark, rows, f"i int, h string, r {RUNS}").select(styles.mixed_runs_html(F.col("h"), F.col("r"))).first()[0]
    assert got == "plain <strong>a &amp; b</strong> bold plain"


def test_document_css(spark):
    got = styles.document_css(frame(spark, [(1, "Normal"), (1, "Body A"), (1, None), (1, "Normal")], "doc_id int, style_name string")).first().css
    assert got.split("\n")[:3] == [".word-style-body-a { margin: 0.5em 0; }", ".word-style-normal { margin: 0.5em 0; }", ".align-center { text-align: center; }"]


def test_tree_text(spark):
    tree = '{"blocks":[{"t":"Para","c":[{"t":"Str","c":"a"},{"t":"Space"},{"t":"Emph","c":[{"t":"Str","c":"b"}]},{"t":"LineBreak"},{"t":"Link","c":[["",[],[]],[{"t":"Str","c":"lost"}],["u",""]]}]},{"t":"BulletList","c":[[{"t":"Plain","c":[{"t":"Str","c":"x"}]}]]}]}'
    got = markup.tree_elements(frame(spark, [(1, tree), (2, "{broken"), (3, None)], "doc_id int, ast string")).orderBy("elem_no").collect()
    assert [(r.tag, r.text) for r in got] == [("Para", "a b"), ("Plain", "x")]


def test_formats(spark):
    rows = [("a/B.DOCX", None), ("x", bytearray(b"%PDF-1")), ("y.bin", bytearray(b"PK\x03\x04....word/x")), ("z", bytearray(b"{\\rtf1")), ("n.tar.md", None), ("u", None), ("dir.pdf/file", None)]
    got = frame(spark, rows, "p string, c binary").select(files.detect_format(F.col("p"), F.col("c")).alias("f")).collect()
    assert [r.f for r in got] == ["docx", "pdf", "docx", "rtf", "markdown", "plain", "plain"]
    names = frame(spark, [("../../etc/a b.txt",), ("中文.docx",), ("ok_1-2.md",)], "n string").select(files.safe_name(F.col("n")).alias("s")).collect()
    assert [r.s for r in names] == ["etc_a_b.txt", "中文.docx", "ok_1-2.md"]
    assert spark.range(1).select(files.upload_problem(F.lit("a.pdf"), pdf=False)).first()[0] == "unsupported format"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/media/image1.PNG", b"png")
        z.writestr("word/media/note.txt", b"no")
    return out.getvalue()


def test_word_packages(spark):
    body = (
        '<w:p w14:paraId="A1"><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="both"/><w:ind w:left="240"/><w:spacing w:after="120" w:line="360"/></w:pPr>'
        '<w:r><w:rPr><w:b/><w:i w:val="0"/><w:sz w:val="23"/><w:color w:val="ff0000"/><w:highlight w:val="yellow"/><w:rFonts w:ascii="Arial"/></w:rPr><w:t>Big</w:t><w:tab/><w:t>x</w:t></w:r></w:p>'
        "<w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        '<w:p><w:r><w:t>no id</w:t></w:r></w:p><w:p w14:paraId="A1"><w:r><w:t>again</w:t></w:r></w:p>'
    )
    got = packages.read_docx(frame(spark, [("f.docx", bytearray(docx(body))), ("bad.docx", bytearray(b"x")), ("null", None)], "path string, content binary")).orderBy("ord").collect()
    assert [(r.ord, r.text, r.fallback) for r in got] == [(0, "again", False), (1, "no id", True)]
    assert got[1].para_id.startswith("hash_text_") and len(got[1].para_id) == 16
    one = packages.docx_paragraphs("d", docx(body.split("<w:p/>")[0]))[0]
    assert one["runs"][0] == {"id": "run_0", "text": "Big\tx", "bold": True, "italic": False, "underline": None, "font_name": "Arial", "font_size": 11.5, "font_color": "#FF0000", "highlight_color": "#FFFF00"}
    assert (one["style_name"], one["alignment"], one["paragraph_format"]["left_indent"], one["paragraph_format"]["space_after"], one["paragraph_format"]["line_spacing"]) == ("heading 1", "justify", 12.0, None, 1.5)
    media = packages.package_media(frame(spark, [("f.docx", bytearray(docx("")))], "path string, content binary")).collect()
    assert [(r.name, bytes(r.content)) for r in media] == [("image1.PNG", b"png")]
    assert packages.paragraphs_to_html(packages.read_docx(frame(spark, [("f", bytearray(docx(body.split("<w:p/>")[0])))], "path string, content binary"))).first().html == '<h1 id="A1">Big\tx</h1>'


def test_books(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>')
        z.writestr("O/b.opf", '<package xmlns="urn:y"><manifest><item id="a" href="a.xhtml"/><item id="b" href="t/b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>A</p>")
        z.writestr("O/t/b.xhtml", "<p>B</p>")
    got = packages.read_epub(frame(spark, [("e.epub", bytearray(out.getvalue()))], "path string, content binary")).orderBy("pos").collect()
    assert [(r.entry, r.html) for r in got] == [("O/t/b.xhtml", "<p>B</p>"), ("O/a.xhtml", "<p>A</p>")]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# hi")
    (tmp_path / "in/b").write_bytes(b"%PDF-")
    read = files.read_files(spark, str(tmp_path / "in"))
    assert {r.format for r in read.collect()} == {"markdown", "pdf"}
    branches = files.route(read)
    assert branches["pdf"].count() == 1 and files.text_of(branches["text"]).first().text == "# hi" and branches["other"].count() == 0
    rows = frame(spark, [("x/../one.html", "<p>é</p>"), ("two.html", None)], "name string, content string")
    got = sinks.write_files(rows, str(tmp_path / "out")).collect()
    assert (tmp_path / "out/one.html").read_text() == "<p>é</p>" and sorted(r.bytes for r in got) == [0, 9]
    docs = frame(spark, [(1, "<p>")], "doc_id int, html string")
    sinks.write_documents(docs, str(tmp_path / "pq"))
    sinks.write_html_lines(docs, str(tmp_path / "js"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == spark.read.json(str(tmp_path / "js")).count() == 1


def test_streams(spark, tmp_path):
    source = tmp_path / "docs"
    frame(spark, [(1, "a ,b"), (2, None)], "doc_id int, text string").write.parquet(str(source))
    stream = ingest.normalize_stream(ingest.stream_table(spark, str(source), "doc_id int, text string"))
    for _ in range(2):  # the second run finds nothing new
        ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.doc_id, r.normalized) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a, b"), (2, None)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files/x.txt").write_text("x")
    counted = ingest.formats_by_hour(ingest.stream_files(spark, str(tmp_path / "files")))
    q = counted.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.format, r.n_files) for r in spark.table("hours").collect()] == [("plain", 1)]


def test_png_filters_and_modes():
    import struct
    import zlib

    import numpy as np

    from paperloom.functions import pixels

    rng = np.random.default_rng(1)

    def encode(px, kind, filters):
        """A PNG whose scan lines take the given filters in turn, written plainly."""
        height, width, channels = px.shape
        lines, above = [], [0] * (width * channels)
        for y in range(height):
            row, f, out = px[y].ravel().tolist(), filters[y % len(filters)], []
            for x, v in enumerate(row):
                left, corner = (row[x - channels], above[x - channels]) if x >= channels else (0, 0)
                p = left + above[x] - corner
                paeth = sorted([(abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner)])[0][2]
                out.append((v - (0, left, above[x], (left + above[x]) // 2, paeth)[f]) % 256)
            lines.append(bytes([f, *out]))
            above = row
        head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
        return pixels._SIGNATURE + pixels._chunk(b"IHDR", head) + pixels._chunk(b"IDAT", zlib.compress(b"".join(lines))) + pixels._chunk(b"IEND", b"")

    for kind, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        px = rng.integers(0, 256, (11, 7, channels)).astype(np.uint8)
        mode, got, _ = pixels.decode_png(encode(px, kind, [0, 1, 2, 3, 4]))
        assert (got == px).all() and mode == pixels._MODES[kind][0]
    whole = pixels.statistics(pixels.encode_png([[0, 255], [255, 0]], "L"))
    assert whole == {"mode": "L", "px_width": 2, "px_height": 2, "n_colors": 2, "grey_min": 0, "grey_max": 255}
    assert pixels.statistics(b"") is None and pixels.statistics(pixels._SIGNATURE + b"junk") is None
    assert pixels.statistics(pixels.encode_png([[1] * 300] * 3, "RGB")[:60]) is None


def test_remote_sources_need_a_fetcher(spark):
    from paperloom.sources import remote, service

    sources = spark.createDataFrame([("http://x.org/a.png",), ("data:x",), (None,)], "src string")
    assert [tuple(r) for r in remote.fetched(sources).collect()] == [("http://x.org/a.png", None, None), ("data:x", None, None), (None, None, None)]
    got = {r.src: r.name for r in remote.fetched(sources.unionByName(sources), lambda u: b"z" * 200).collect()}
    assert got["http://x.org/a.png"].endswith(".png") and got["data:x"] is None and got[None] is None
    assert service.health(spark).first().status == "healthy"


def test_similar_sets_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij0123é中🙂 -") for _ in range(rng.randint(0, 14))) for _ in range(160)]
    left, right = [(i % 3, t) for i, t in enumerate(texts[:90])], [(i % 3, t, f"p{i}", i) for i, t in enumerate(texts[90:])]
    chars = lambda t: {c for c in t if c.isalnum()}
    want = {}
    for (d, t), (e, u, name, pos) in itertools.product(left, right):
        if d == e and t and u:
            a, b = chars(t), chars(u)
            score = 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0
            if score > 0.5:
                want[d, t] = max(want.get((d, t), (0.0, 0, "")), (score, -pos, name))
    got = matching.most_similar(frame(spark, left, "doc int, text string"), frame(spark, right, "doc int, text string, id string, pos int"), ["doc"], 0.5).distinct().collect()
    assert {(r.doc, r.text): (r.match, r.score) for r in got} == {k: (v[2], pytest.approx(v[0])) for k, v in want.items()}


def test_exact_only_and_titles(spark):
    tree = '{"meta":{"title":{"t":"MetaInlines","c":[{"t":"Str","c":"abcdef"}]}},"blocks":[{"t":"Para","c":[{"t":"Str","c":"abcdefg"}]},{"t":"Header","c":[1,[],[{"t":"Str","c":"x"}]]}]}'
    elements = markup.tree_elements(frame(spark, [(1, tree), (2, "{broken"), (3, None)], "doc int, ast string"))
    paragraphs = frame(spark, [(1, 0, "p0", "abcdefgh")], "doc int, ord int, para_id string, text string")
    rows = {r.tag: r.match for r in matching.assign_ids(elements, paragraphs, ["doc"], 0.7, exact_only=F.col("tag") != "Para").collect()}
    assert rows == {"Title": None, "Para": "p0", "Header": None}
    assert {r.tag: r.match for r in matching.assign_ids(elements, paragraphs, ["doc"], 0.7).collect()}["Title"] == "p0"
