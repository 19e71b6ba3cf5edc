"""Registered queries of the document operators and the SQL they are compared with."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import config, css, text
from ..operators import images, layout, markup, matching, styles
from ..sources import files, packages
from ..streaming import ingest
from . import fixtures as fx
from . import sql_text as sql
from .registry import query


# ---- text ------------------------------------------------------------------------------------

_SYMBOLS = (("é", "—"), ("è", "≠"), ("ñ", "€"), ("ü", "“x…"), ("ß", "『°』"), ("ä", "〈•"))


def _swapped(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {fx.quoted(a)}, {fx.quoted(b)})"
    return expr


def _swap(column, pairs):
    for a, b in pairs:
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


@query(f"SELECT doc_id, {sql.normalized('text')} AS normalized FROM documents")
def normalize_documents(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {sql.normalized(_swapped('text', _SYMBOLS))} AS normalized FROM documents")
def normalize_injected_symbols(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.normalize(_swap(F.col("text"), _SYMBOLS)).alias("normalized"))


@query(f"SELECT doc_id, {sql.normalized(_swapped('text', (('é', '1'), ('è', 'A'), ('ü', 'TM'), ('ñ', 'fi'))))} AS normalized FROM documents")
def nfkc_normalize(spark, sf_dir):
    symbols = (("é", "①"), ("è", "Ａ"), ("ü", "™"), ("ñ", "ﬁ"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.normalize(_swap(F.col("text"), symbols)).alias("normalized"))


@query(f"SELECT doc_id, {sql.clean('replace(text, chr(10), chr(7) || chr(10) || chr(8203))')} AS cleaned FROM documents")
def clean_control_chars(spark, sf_dir):
    injected = F.replace(F.col("text"), F.lit("\n"), F.lit("\x07\n​"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.clean_text(injected).alias("cleaned"))


@query(f"SELECT doc_id, {sql.fallback('text')} AS fixed FROM documents")
def punctuation_fallback(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.fix_punctuation_fallback(F.col("text")).alias("fixed"))


@query(f"SELECT doc_id, {sql.escaped('text')} AS escaped FROM documents")
def html_escape(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.escape_html(F.col("text")).alias("escaped"))


@query(
    """
    SELECT c AS char, count(*)::BIGINT AS n_texts, 'U+' || lpad(upper(hex(unicode(c))), 4, '0') AS code, unicode(c) AS decimal
    FROM (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c
    """
)
def char_inventory(spark, sf_dir):
    return text.character_inventory(fx.table(spark, sf_dir, "documents"))


def _unicode_values() -> str:
    """(char, name, category, nfkc) of the blocks that the tables draw from, by Unicode's own data."""
    points = [*range(0x20), *range(0x20, 0x180), *range(0x2010, 0x2030), 0x20AC]
    rows = [(chr(c), unicodedata.name(chr(c), "UNKNOWN"), unicodedata.category(chr(c)), unicodedata.normalize("NFKC", chr(c))) for c in points if c]
    # control characters stand as chr(), as text of SQL can't hold them all
    return ", ".join(f"(chr({ord(c)}), '{name}', '{kind}', {f'chr({ord(form)})' if len(form) == 1 else fx.quoted(form)})" for c, name, kind, form in rows)


@query(
    f"""
    WITH chars AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents), known(char, name, category, nfkc) AS (VALUES {_unicode_values()})
    SELECT c.char, 'U+' || lpad(upper(hex(unicode(c.char))), 4, '0') AS code, unicode(c.char) AS decimal, name, category, nfkc,
           c.char IN (chr(160), '¢', '£', '¥', '©', '®', '°', '²', '³', '¹', '×', '÷', '‐', '‑', '‒', '–', '—', '―', '‘', '’', '‚', '‛', '“', '”', '„', '‟', '•', '‣', '․', '‥', '…', '€') AS in_custom_mappings, NULL::VARCHAR AS error
    FROM chars c LEFT JOIN known k ON c.char = k.char WHERE c.char <> ''
    """
)
def char_info(spark, sf_dir):
    return text.character_info(text.character_inventory(fx.table(spark, sf_dir, "documents")).select("char"))


# ---- layout ----------------------------------------------------------------------------------


@query(
    f"""
    WITH lines AS (
      SELECT doc_id, n_chars, unnest(range(len(l))) AS n, {sql.strip('unnest(l)')} AS line FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS l FROM documents)
    )
    SELECT doc_id, coalesce(string_agg('<p>' || {sql.escaped('line')} || '</p>', chr(10) ORDER BY n) FILTER (WHERE line <> ''), '')
           || CASE WHEN doc_id % 5 < (SELECT max(d.doc_id % 5) FROM documents d WHERE d.doc_id // 5 = lines.doc_id // 5) THEN chr(10) || '<hr>' ELSE '' END AS html
    FROM lines GROUP BY doc_id
    """
)
def doc_lines_html(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "documents").withColumn("book", F.floor(F.col("doc_id") / 5)).withColumn("page_num", F.pmod("doc_id", F.lit(5)))
    return layout.text_pages_to_html(pages, doc="book").select("doc_id", "html")


@query(
    f"""
    WITH RECURSIVE {fx.BLOCKS_SQL}, sorted AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y0 / 3.0, 0), x0, block_no) AS k FROM blocks
    ), walk AS (
      SELECT doc_id, page_num, k, 0 AS line_no, y0 AS anchor FROM sorted WHERE k = 1
      UNION ALL
      SELECT s.doc_id, s.page_num, s.k, CASE WHEN abs(s.y0 - w.anchor) <= 3.0 THEN w.line_no ELSE w.line_no + 1 END,
             CASE WHEN abs(s.y0 - w.anchor) <= 3.0 THEN w.anchor ELSE s.y0 END
      FROM walk w JOIN sorted s ON s.doc_id = w.doc_id AND s.page_num = w.page_num AND s.k = w.k + 1
    ), members AS (
      SELECT s.*, w.line_no AS line, x0 + 6.0::DOUBLE * least(length(text), 30) AS x1, y0 + 10.0::DOUBLE AS y1,
             row_number() OVER (PARTITION BY s.doc_id, s.page_num, w.line_no ORDER BY x0, s.k) AS m
      FROM sorted s JOIN walk w ON s.doc_id = w.doc_id AND s.page_num = w.page_num AND s.k = w.k
    ), spaced AS (
      SELECT *, CASE WHEN m > 1 AND x0 - lag(x1) OVER (PARTITION BY doc_id, page_num, line ORDER BY m) > 5.0 THEN ' ' ELSE '' END || text AS piece FROM members
    )
    SELECT doc_id, page_num, line::INTEGER AS line_no, string_agg(piece, '' ORDER BY m) AS text, arg_min(y0, m) AS y0, arg_min(y1, m) AS y1,
           arg_min(x0, m) AS x0, arg_max(x1, m) AS x1, sum(size) / count(*) AS size, string_agg(DISTINCT font, ',' ORDER BY font) AS fonts
    FROM spaced GROUP BY doc_id, page_num, line
    """
)
def layout_lines(spark, sf_dir):
    lines = layout.blocks_to_lines(fx.blocks(spark, sf_dir))
    return lines.withColumn("fonts", F.array_join("fonts", ","))


@query(
    f"""
    WITH {fx.BLOCKS_SQL}, cut AS (
      SELECT *, text[:5] AS a, text[6:] AS b FROM blocks WHERE block_no % 9 <> 4
    ), pieces AS (
      SELECT *, CASE WHEN {sql.strip('a')} <> '' THEN a ELSE '' END || CASE WHEN {sql.strip('b')} <> '' THEN b ELSE '' END AS whole,
             CASE WHEN {sql.strip('a')} <> '' THEN 1 ELSE 0 END + CASE WHEN {sql.strip('b')} <> '' THEN 1 ELSE 0 END AS n,
             CASE WHEN {sql.strip('a')} <> '' THEN size ELSE 0 END + CASE WHEN {sql.strip('b')} <> '' THEN size + 1 ELSE 0 END AS total
      FROM cut
    )
    SELECT doc_id, page_num, block_no, whole AS text, total / n AS avg_size FROM pieces WHERE length({sql.strip('whole')}) >= 2
    """
)
def blocks_from_spans(spark, sf_dir):
    base = fx.blocks(spark, sf_dir).withColumn("size", F.col("sizes")[0])
    parts = F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t"), (F.col("size") + i).alias("s")) for i, t in ((0, F.substring("text", 1, 5)), (1, F.substr(F.col("text"), F.lit(6))))])
    spans = base.withColumn("_p", F.explode(parts)).select(
        "doc_id", "page_num", "block_no", F.when(F.pmod("block_no", F.lit(9)) == 4, 1).otherwise(0).alias("block_type"), F.col("_p.i").alias("line_no"), F.lit(0).alias("span_no"), F.col("_p.t").alias("text"), F.lit("f").alias("font"), F.col("_p.s").alias("size"), "x0", "y0", "x1", "y1"
    )
    return layout.spans_to_blocks(spans).select("doc_id", "page_num", "block_no", "text", "avg_size")


_PARAGRAPHS = rf"""
{fx.TEXT_LINES_SQL}, breaks AS (
  SELECT *, lag(y0 + 10) OVER p AS py1, lag(x0) OVER p AS px0, {sql.strip('lag(text) OVER p')} AS pt FROM text_lines
  WINDOW p AS (PARTITION BY doc_id, page_num ORDER BY line_no)
), islands AS (
  SELECT *, sum(CASE WHEN py1 IS NULL OR y0 - py1 > 1.5 * 10 OR x0 - px0 > 20 OR regexp_matches(pt, '[。！？.!?]\z') THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id, page_num ORDER BY line_no) AS para_no
  FROM breaks
), merged AS (
  SELECT doc_id, page_num, para_no::BIGINT AS para_no, string_agg(text, '' ORDER BY line_no) AS raw, sum(size) / count(*) AS size,
         arg_min(y0, line_no) AS y0, abs(arg_min(x0, line_no) - 200) < 50 AS is_center
  FROM islands GROUP BY ALL
), cleaned AS (
  SELECT *, {sql.clean('raw')} AS text FROM merged
), paragraphs AS (
  SELECT *, CASE WHEN size > 16 THEN 'h2' WHEN size > 14 THEN 'h3' WHEN regexp_matches(text, '^第[一二三四五六七八九十\p{{Nd}}]+章') THEN 'h1'
                 WHEN regexp_matches(text, '^\p{{Nd}}+[.、]') THEN 'h3' ELSE 'p' END AS type
  FROM cleaned WHERE {sql.strip('text')} <> ''
)"""


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, page_num, para_no, text, type, size, y0, is_center FROM paragraphs")
def layout_paragraphs(spark, sf_dir):
    return layout.lines_to_paragraphs(fx.text_lines(spark, sf_dir))


@query(
    f"""
    WITH {_PARAGRAPHS} SELECT doc_id, page_num, para_no,
      CASE WHEN type IN ('h1', 'h2') AND is_center THEN '<' || type || ' class="center">' || {sql.escaped('text')} || '</' || type || '>'
           WHEN type <> 'p' THEN '<' || type || '>' || {sql.escaped('text')} || '</' || type || '>'
           WHEN is_center THEN '<p class="no-indent">' || {sql.escaped('text')} || '</p>' ELSE '<p>' || {sql.escaped('text')} || '</p>' END AS html
    FROM paragraphs
    """
)
def render_paragraphs(spark, sf_dir):
    found = layout.lines_to_paragraphs(fx.text_lines(spark, sf_dir))
    return found.select("doc_id", "page_num", "para_no", layout.render_paragraph(F.col("text"), F.col("type"), F.col("is_center")).alias("html"))


@query(
    """
    WITH headed AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '第三章 ' WHEN 1 THEN '12. ' WHEN 2 THEN '4、' WHEN 3 THEN '第章' ELSE '' END || text AS t, 9 + (doc_id % 10)::DOUBLE AS s FROM documents)
    SELECT doc_id, CASE WHEN s > 16 THEN 'h2' WHEN s > 14 THEN 'h3' WHEN regexp_matches(t, '^第[一二三四五六七八九十0-9]+章') THEN 'h1'
                        WHEN regexp_matches(t, '^[0-9]+[.、]') THEN 'h3' ELSE 'p' END AS type
    FROM headed
    """
)
def paragraph_types(spark, sf_dir):
    kind, front = F.pmod("doc_id", F.lit(6)), F.lit("")
    for i, prefix in enumerate(("第三章 ", "12. ", "4、", "第章")):
        front = F.when(kind == i, prefix).otherwise(front)
    size = 9 + F.pmod("doc_id", F.lit(10)).cast("double")
    return fx.table(spark, sf_dir, "documents").select("doc_id", layout.paragraph_type(F.concat(front, F.col("text")), size).alias("type"))


# ---- matching --------------------------------------------------------------------------------

_CHARS = "list_distinct(list_filter(string_split(lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), ''), lambda c: c <> ''))"
_SCORE = """CASE WHEN length({0}.text) = 0 OR length({1}.text) = 0 THEN 0.0 WHEN len({0}.s) = 0 AND len({1}.s) = 0 THEN 1.0 WHEN len({0}.s) = 0 OR len({1}.s) = 0 THEN 0.0
            ELSE len(list_intersect({0}.s, {1}.s))::DOUBLE / (len({0}.s) + len({1}.s) - len(list_intersect({0}.s, {1}.s))) END"""


@query(
    f"""
    WITH d AS (SELECT doc_id, text, {_CHARS.format('text')} AS s FROM documents), b AS (SELECT item_id, text, {_CHARS.format('text')} AS s FROM benchmark),
    scored AS (SELECT doc_id, item_id, {_SCORE.format('d', 'b')} AS score FROM d, b)
    SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM scored WHERE score > 0.8) WHERE k = 1
    """
)
def similarity_top1(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = fx.table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("id"), F.col("item_id").alias("pos"))
    return matching.most_similar(docs, items, []).select("doc_id", F.col("match").alias("item_id"), "score")


@query(
    f"""
    WITH t AS (SELECT doc_id, {sql.strip('text')} AS s FROM documents)
    SELECT t.doc_id, m.match FROM t LEFT JOIN (SELECT s, max(doc_id) AS match FROM t WHERE s <> '' GROUP BY s) m USING (s)
    """
)
def text_exact_map(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    paragraphs = docs.select(F.col("doc_id").alias("para_id"), F.col("doc_id").alias("ord"), "text")
    return matching.exact_match(docs.select("doc_id", "text"), paragraphs, []).select("doc_id", "match")


_ELEMENTS = r"""
found AS (
  SELECT page_id, unnest(range(len(l))) AS elem_no, unnest(l) AS e
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p[^>]*>.*?</p>|<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<h4[^>]*>.*?</h4>|<h5[^>]*>.*?</h5>|<h6[^>]*>.*?</h6>') AS l FROM {0})
), elements AS (
  SELECT page_id, elem_no::INTEGER AS elem_no, regexp_extract(e, '^<(p|h[1-6])', 1) AS tag, regexp_extract(e, '(?s)^<(?:p|h[1-6])([^>]*)>', 1) AS attrs,
         substr(e, strpos(e, '>') + 1, length(e) - strpos(e, '>') - length(regexp_extract(e, '^<(p|h[1-6])', 1)) - 3) AS inner_html
  FROM found
)"""


@query(f"WITH {_ELEMENTS.format('pages')} SELECT page_id, elem_no, tag, attrs, inner_html FROM elements")
def element_extract(spark, sf_dir):
    return markup.elements(fx.table(spark, sf_dir, "pages").select("page_id", "html"))


@query(
    f"""
    WITH {_ELEMENTS.format('pages')}, e AS (
      SELECT page_id, elem_no, {sql.strip('inner_html')} AS text, elem_no % 7 = 6 AS has_id FROM elements
    ), paras AS (
      SELECT page_id, elem_no AS ord, 'p' || elem_no AS para_id, CASE WHEN elem_no % 3 = 1 THEN text || ' zq' ELSE text END AS text FROM e WHERE elem_no % 3 < 2
    ), idx AS (
      SELECT page_id, text, arg_max(para_id, ord) AS para_id, min(ord) AS pos FROM paras WHERE text <> '' GROUP BY ALL
    ), exact AS (
      SELECT e.*, i.para_id AS m FROM e LEFT JOIN idx i ON e.page_id = i.page_id AND e.text = i.text
    ), a AS (SELECT DISTINCT page_id, text, {_CHARS.format('text')} AS s FROM exact WHERE m IS NULL AND NOT has_id
    ), b AS (SELECT *, {_CHARS.format('text')} AS s FROM idx
    ), scored AS (SELECT a.page_id, a.text, b.para_id, b.pos, {_SCORE.format('a', 'b')} AS score FROM a JOIN b USING (page_id)
    ), best AS (
      SELECT page_id, text, para_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY score DESC, pos, para_id) AS k FROM scored WHERE score > 0.8) WHERE k = 1
    )
    SELECT x.page_id, x.elem_no, CASE WHEN x.has_id THEN 'own' ELSE coalesce(x.m, best.para_id) END AS match
    FROM exact x LEFT JOIN best ON x.page_id = best.page_id AND x.text = best.text
    """
)
def id_assign(spark, sf_dir):
    found = markup.elements(fx.table(spark, sf_dir, "pages").select("page_id", "html"))
    found = found.select("page_id", "elem_no", text.strip(F.col("inner_html")).alias("text"), F.when(F.pmod("elem_no", F.lit(7)) == 6, "own").alias("id"))
    changed = F.when(F.pmod("elem_no", F.lit(3)) == 1, F.concat(F.col("text"), F.lit(" zq"))).otherwise(F.col("text"))
    paragraphs = found.where(F.pmod("elem_no", F.lit(3)) < 2).select("page_id", F.col("elem_no").alias("ord"), F.concat(F.lit("p"), F.col("elem_no")).alias("para_id"), changed.alias("text"))
    return matching.assign_ids(found, paragraphs, ["page_id"]).select("page_id", "elem_no", "match")


# ---- markup ----------------------------------------------------------------------------------


def _occurrences(expr: str, needle: str) -> str:
    return f"((length({expr}) - length(replace({expr}, {fx.quoted(needle)}, ''))) // {len(needle)})"


@query(f"WITH {fx.MARKED_PAGES_SQL} SELECT page_id, {_occurrences('html', 'id=')}::BIGINT AS n_ids, {_occurrences('html', '<p')}::BIGINT AS n_paragraphs, ({' + '.join(_occurrences('html', f'<h{i}') for i in range(1, 7))})::BIGINT AS n_headings FROM marked")
def html_tag_stats(spark, sf_dir):
    return fx.marked_pages(spark, sf_dir).select("page_id", markup.tag_stats(F.col("html")).alias("s")).select("page_id", "s.*")


@query(
    f"""
    WITH {fx.MARKED_PAGES_SQL}
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<(?:mark|MARK)([^>]*style=["''][^"''>]*["''][^>]*)>', '<span\\1>', 'g'), '(?i)<mark[^>]*>', '<span>', 'g'), '(?i)</mark>', '</span>', 'g') AS html
    FROM marked
    """
)
def mark_to_span(spark, sf_dir):
    return fx.marked_pages(spark, sf_dir).select("page_id", markup.mark_to_span(F.col("html")).alias("html"))


_CSS = ".align-center { text-align: center; }\n.align-right { text-align: right; }\n.align-justify { text-align: justify; }\n.align-left { text-align: left; }"


@query(
    f"""
    WITH {fx.MARKED_PAGES_SQL}, css AS (
      SELECT page_id, html, '.word-style-heading-' || page_id % 4 || ' {{ margin: 0.5em 0; }}' || chr(10) || '.word-style-normal-é_ { '{' } margin: 0.5em 0; { '}' }' || chr(10) || {fx.quoted(_CSS)} AS c FROM marked
    )
    SELECT page_id, CASE WHEN contains(html, '</head>') THEN replace(html, '</head>', '<style>' || chr(10) || c || chr(10) || '</style>' || chr(10) || '</head>')
                         WHEN contains(html, '<head>') THEN replace(html, '<head>', '<head><style>' || chr(10) || c || chr(10) || '</style>' || chr(10))
                         ELSE '<head><style>' || chr(10) || c || chr(10) || '</style></head>' || chr(10) || html END AS html
    FROM css
    """
)
def css_inject(spark, sf_dir):
    pages = fx.marked_pages(spark, sf_dir)
    names = F.array(F.lit("Normal É_"), F.concat(F.lit("Heading "), F.pmod("page_id", F.lit(4))), F.lit("Normal É_"), F.lit(None).cast("string"))
    rules = css.css_rules(F.transform(names, css.style_class))
    return pages.select("page_id", markup.inject_css(F.col("html"), rules).alias("html"))


_SOURCES = rf"""
{fx.MARKED_PAGES_SQL}, srcs AS (
  SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS src
  FROM (SELECT page_id, regexp_extract_all(html, '(?i)<img[^>]+src=["'']([^"'']+)["''][^>]*>', 1) AS l FROM marked)
), kinds AS (
  SELECT *, CASE WHEN starts_with(src, 'http://') OR starts_with(src, 'https://') THEN 'http' WHEN starts_with(src, 'data:image/') THEN 'base64'
                 WHEN starts_with(src, 'media/') OR NOT (starts_with(src, 'data:') OR starts_with(src, '#') OR starts_with(src, 'mailto:')) THEN 'local' ELSE 'ignored' END AS kind,
            CASE WHEN starts_with(src, 'data:image/png;') THEN '.png' WHEN regexp_matches(lower(src), '\.png(\?|$)') THEN '.png' WHEN regexp_matches(lower(src), '\.gif$') THEN '.gif'
                 WHEN regexp_matches(lower(src), '\.webp$') THEN '.webp' WHEN regexp_matches(lower(src), '\.bmp$') THEN '.bmp' ELSE '.jpg' END AS ext
  FROM srcs
)"""


def _sources(spark, sf_dir):
    return fx.marked_pages(spark, sf_dir).select("page_id", F.posexplode(images.image_sources(F.col("html"))).alias("pos", "src"))


@query(f"WITH {_SOURCES} SELECT page_id, pos, src, kind FROM kinds")
def img_extract_classify(spark, sf_dir):
    return _sources(spark, sf_dir).withColumn("kind", images.source_kind(F.col("src")))


@query(f"WITH {_SOURCES} SELECT page_id, pos, substr(md5(src), 1, 16) || ext AS name, '../uploads/images/' || substr(md5(src), 1, 16) || ext AS path FROM kinds")
def img_rename(spark, sf_dir):
    named = _sources(spark, sf_dir).withColumn("name", images.image_name(F.col("src")))
    return named.select("page_id", "pos", "name", images.relative_path(F.concat(F.lit("x/"), F.col("name"))).alias("path"))


@query(
    f"""
    WITH {_SOURCES}, r AS (SELECT page_id, src, '../uploads/images/' || substr(md5(src), 1, 16) || ext AS path FROM kinds WHERE kind <> 'ignored')
    SELECT m.page_id, CASE WHEN r.src IS NULL THEN m.html ELSE replace(m.html, r.src, r.path) END AS html
    FROM marked m LEFT JOIN r USING (page_id)
    """
)
def img_localize(spark, sf_dir):
    """Every source of a page that is not ignored; the SQL relies on there being one at most and on its text standing once."""
    pages = fx.marked_pages(spark, sf_dir)
    src = images.image_sources(F.col("html"))
    pairs = F.filter(F.transform(src, lambda s: F.struct(s.alias("src"), images.relative_path(images.image_name(s)).alias("path"))), lambda p: images.source_kind(p["src"]) != "ignored")
    return pages.select("page_id", images.localize_images(F.col("html"), pairs).alias("html"))


@query(
    f"""
    SELECT doc_id, substr(md5(text), 1, 16) || '.gif' AS name, octet_length(encode(text))::BIGINT AS n_bytes
    FROM documents WHERE doc_id % 3 = 0 AND length(text) > 0
    """
)
def base64_images(spark, sf_dir):
    body = F.base64(F.encode("text", "UTF-8"))
    src = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("data:image/gif;base64,"), F.regexp_replace(body, "[\r\n]", ""))).when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.lit("data:text/plain;base64,"), body)).otherwise("data:image/gif;base64,!!!")
    found = fx.table(spark, sf_dir, "documents").select("doc_id", src.alias("src")).withColumn("content", images.data_url_content(F.col("src"))).where(F.col("content").isNotNull())
    return found.select("doc_id", images.image_name(F.col("src"), F.col("content")).alias("name"), F.length("content").cast("long").alias("n_bytes"))


# ---- images of pages -------------------------------------------------------------------------


@query(f"WITH {fx.IMAGES_SQL} SELECT doc, page, index, rule AS reason FROM judged")
def image_filter(spark, sf_dir):
    return fx.images(spark, sf_dir).select("doc", "page", "index", images.rejection(pixels=True).alias("reason"))


@query(f"WITH {fx.IMAGES_SQL} SELECT doc, page, index, reason FROM filtered")
def image_dedupe(spark, sf_dir):
    return images.filter_images(fx.images(spark, sf_dir), pixels=True).select("doc", "page", "index", "reason")


@query(
    f"""
    WITH {fx.IMAGES_SQL}, {fx.IMAGE_PARAGRAPHS_SQL}
    SELECT i.doc, i.page, i.index, min(p.para_no)::INTEGER AS para_no,
           '<p class="pdf-image" style="text-align: center;"><img src="x" alt="PDF图片" width="' || CASE WHEN width > 600 THEN 600 ELSE width::INTEGER END
           || '" height="' || trunc(CASE WHEN width > 600 THEN height * (600 / width) ELSE height END)::INTEGER || '" /></p>' AS html
    FROM filtered i LEFT JOIN image_paragraphs p ON p.doc = i.doc AND p.page = i.page AND i.y0 < p.y0 AND p.y0 - i.y0 < 100
    WHERE i.reason IS NULL GROUP BY i.doc, i.page, i.index, i.width, i.height
    """
)
def image_place(spark, sf_dir):
    kept = images.filter_images(fx.images(spark, sf_dir), pixels=True).where(F.col("reason").isNull())
    placed = images.place_images(kept, fx.image_paragraphs(spark, sf_dir))
    return placed.select("doc", "page", "index", F.col("para_no").cast("int").alias("para_no"), images.render_image(F.lit("x"), F.col("width"), F.col("height")).alias("html"))


@query(
    """
    WITH imgs AS (SELECT doc_id // 10 AS doc, doc_id AS pos FROM documents WHERE doc_id % 3 = 0
    ), slots AS (SELECT doc_id // 10 AS doc, 'p' || doc_id AS para_id, CASE doc_id % 4 WHEN 0 THEN 'center' WHEN 1 THEN 'justify' ELSE 'left' END AS align,
                        row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS k FROM documents WHERE doc_id % 4 < 3 AND doc_id % 5 < 2)
    SELECT i.doc, i.pos, s.para_id, s.align FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos DESC) AS k FROM imgs) i LEFT JOIN slots s ON s.doc = i.doc AND s.k = i.k
    """
)
def image_para_zip(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").withColumn("doc", F.floor(F.col("doc_id") / 10))
    four = F.pmod("doc_id", F.lit(4))
    align = F.when(four == 0, "center").when(four == 1, "distribute").when(four == 2, "left")
    blank = F.when(F.pmod("doc_id", F.lit(5)) < 2, " 　").otherwise("text")
    paragraphs = docs.select("doc", F.col("doc_id").alias("ord"), F.concat(F.lit("p"), F.col("doc_id")).alias("para_id"), blank.alias("text"), align.alias("alignment"))
    return markup.pair_image_paragraphs(docs.where(F.pmod("doc_id", F.lit(3)) == 0).select("doc", F.col("doc_id").alias("pos")), paragraphs, doc="doc")


# ---- styles ----------------------------------------------------------------------------------


_MODES = rf"""
{fx.RUNS_SQL}, kept AS (SELECT * FROM runs WHERE {sql.strip('text')} <> ''
), counts AS (SELECT para, bold, italic, font_size, count(*) AS n, min(ord) AS first FROM kept GROUP BY ALL
), ranked AS (SELECT *, sum(n) OVER (PARTITION BY para) AS total, count(*) OVER (PARTITION BY para) AS styles, row_number() OVER (PARTITION BY para ORDER BY n DESC, first) AS k FROM counts
)"""


@query(f"WITH {_MODES} SELECT para, total::BIGINT AS n_runs, styles <= 1 AS is_uniform FROM ranked WHERE k = 1")
def run_uniformity(spark, sf_dir):
    return styles.run_styles(fx.runs(spark, sf_dir), ["para"]).select("para", "n_runs", "is_uniform")


@query(f"WITH {_MODES} SELECT para, bold, italic, font_size FROM ranked WHERE k = 1")
def run_mode_style(spark, sf_dir):
    return styles.run_styles(fx.runs(spark, sf_dir), ["para"]).select("para", "style.bold", "style.italic", "style.font_size")


_RUN_HTML = """CASE WHEN bold THEN '<strong>' ELSE '' END || CASE WHEN italic THEN '<em>' ELSE '' END || '<span style="font-size: ' || font_size || 'pt">' || text || '</span>'
  || CASE WHEN italic THEN '</em>' ELSE '' END || CASE WHEN bold THEN '</strong>' ELSE '' END"""


@query(f"WITH {fx.RUNS_SQL} SELECT para, ord, {_RUN_HTML} AS html FROM runs")
def styled_run(spark, sf_dir):
    run = {k: F.col(k) for k in css.RUN_KEYS}
    return fx.runs(spark, sf_dir).select("para", "ord", css.styled_run(F.col("text"), run).alias("html"))


@query(
    """
    WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'center' WHEN 1 THEN 'justify' WHEN 2 THEN 'right' END AS align, (doc_id % 4) * 6.0::DOUBLE AS l, (doc_id % 3) * 1.5::DOUBLE AS sp, (doc_id % 2) * 1.25::DOUBLE AS h FROM documents),
    s AS (SELECT doc_id, concat_ws('; ', CASE WHEN align IS NOT NULL THEN 'text-align: ' || align END, CASE WHEN l <> 0 THEN 'margin-left: ' || l || 'pt' END,
                 CASE WHEN sp <> 0 THEN 'margin-top: ' || sp || 'pt' END, CASE WHEN h <> 0 THEN 'line-height: ' || h END) AS c FROM p)
    SELECT doc_id, CASE WHEN c = '' THEN 'color: red' ELSE 'color: red; ' || c END AS style, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'word-style-list-' || doc_id % 7 || '--a' END AS class FROM s
    """
)
def paragraph_css(spark, sf_dir):
    d = F.col("doc_id")
    five = F.pmod(d, F.lit(5))
    align = F.when(five == 0, "center").when(five == 1, "distribute").when(five == 2, "right").when(five == 3, "left")
    none = F.lit(None).cast("double")
    fmt = {"left_indent": F.pmod(d, F.lit(4)) * 6.0, "right_indent": none, "first_line_indent": F.lit(0.0), "space_before": F.pmod(d, F.lit(3)) * 1.5, "space_after": none, "line_spacing": F.pmod(d, F.lit(2)) * 1.25}
    name = F.when(F.pmod(d, F.lit(7)) != 0, F.concat(F.lit("List "), F.pmod(d, F.lit(7)), F.lit("./A")))
    return fx.table(spark, sf_dir, "documents").select("doc_id", css.add_css(F.lit("color: red"), css.paragraph_css(align, fmt)).alias("style"), css.style_class(name).alias("class"))


@query(
    f"""
    WITH {_MODES}, joined AS (
      SELECT k.para, k.ord, k.text, r.styles, k.bold, k.italic, k.font_size,
             (k.bold IS NOT DISTINCT FROM r.bold AND k.italic IS NOT DISTINCT FROM r.italic AND k.font_size = r.font_size) AS usual
      FROM kept k JOIN ranked r ON r.para = k.para AND r.k = 1
    )
    SELECT para, CASE WHEN max(styles) > 1 THEN '' ELSE 'font-size: ' || any_value(font_size) || 'pt' || CASE WHEN any_value(bold) THEN '; font-weight: bold' ELSE '' END || CASE WHEN any_value(italic) THEN '; font-style: italic' ELSE '' END END AS style,
           string_agg('{{' || ord || '|' || CASE WHEN max_styles > 1 AND NOT usual THEN {_RUN_HTML} ELSE text END || '}}', '' ORDER BY ord) AS inner_html
    FROM (SELECT *, max(styles) OVER (PARTITION BY para) AS max_styles FROM (SELECT * REPLACE ('{{' || ord || '}}' AS text) FROM joined)) GROUP BY para
    """
)
def apply_styles(spark, sf_dir):
    """Runs whose texts are unique marks, so that replacing the first occurrence is unambiguous."""
    mark = F.concat(F.lit("{"), F.col("ord"), F.lit("}"))
    runs = fx.runs(spark, sf_dir).where(~text.is_blank(F.col("text"))).withColumn("text", mark)
    run = F.struct(F.lit("r").alias("id"), "text", *css.RUN_KEYS)
    grouped = runs.groupBy("para").agg(F.sort_array(F.collect_list(F.struct("ord", run.alias("r")))).alias("x"))
    grouped = grouped.withColumn("inner", F.array_join(F.transform("x", lambda x: F.concat(F.lit("{"), x["ord"], F.lit("|"), x["r"]["text"], F.lit("}"))), ""))
    fmt = F.struct(*[F.lit(None).cast("double").alias(n) for n in ("left_indent", "right_indent", "first_line_indent", "space_before", "space_after", "line_spacing")])
    paragraphs = grouped.select(F.lit("d").alias("doc_id"), F.col("para").cast("string").alias("para_id"), F.lit(None).cast("string").alias("alignment"), F.lit(None).cast("string").alias("style_name"), fmt.alias("paragraph_format"), F.transform("x", lambda x: x["r"]).alias("runs"))
    elements = grouped.select(F.lit("d").alias("doc_id"), F.col("para").alias("elem_no"), F.col("para").cast("string").alias("id"), F.lit("").alias("style"), F.array().cast("array<string>").alias("classes"), F.col("inner").alias("inner_html"), F.col("inner").alias("text"))
    return styles.apply_styles(elements, paragraphs).select(F.col("elem_no").alias("para"), "style", "inner_html")


# ---- configuration and files -----------------------------------------------------------------


@query("SELECT c_custkey, 'color,margin' || CASE WHEN lower(c_mktsegment) NOT IN ('color', 'margin') THEN ',' || lower(c_mktsegment) ELSE '' END || ',x,x' AS merged FROM customer")
def config_merge(spark, sf_dir):
    base = F.array(F.lit("color"), F.lit("margin"))
    custom = F.array(F.lower("c_mktsegment"), F.lit("x"), F.lit("margin"), F.lit("x"))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(config.merge_lists(base, custom), ",").alias("merged"))


@query(
    """
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'color,line-height' WHEN c_custkey % 4 = 3 THEN '' ELSE 'color' END AS styles,
           CASE WHEN c_custkey % 4 = 1 THEN 'center,quote' WHEN c_custkey % 4 = 3 THEN '' ELSE 'center' END AS classes, c_custkey % 4 = 1 AS line_height
    FROM customer
    """
)
def style_filter(spark, sf_dir):
    kind = F.pmod("c_custkey", F.lit(4))
    fmt = F.when(kind == 0, "doc").when(kind == 1, "epub").when(kind == 2, "pdf").otherwise("odt")
    given = F.create_map(*[F.lit(x) for x in ("color", "red", "line-height", "2", "float", "left")])
    classes = F.array(F.lit("center"), F.lit("quote"), F.lit("hero"))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(config.filter_styles(fmt, given))), ",").alias("styles"), F.array_join(config.filter_classes(fmt, classes), ",").alias("classes"), config.is_style_allowed(fmt, F.lit("line-height")).alias("line_height"))


_NAMES = """
names AS (SELECT page_id, CASE page_id % 13 WHEN 0 THEN 'a.DOCX' WHEN 1 THEN 'b.doc' WHEN 2 THEN 'c.Pdf' WHEN 3 THEN 'd.epub' WHEN 4 THEN 'e.txt' WHEN 5 THEN 'f.rtf' WHEN 6 THEN 'g.md'
                WHEN 7 THEN 'h.html' WHEN 8 THEN 'i.htm' WHEN 9 THEN 'j.odt' WHEN 10 THEN 'k.v2/noext' WHEN 11 THEN '.docx' ELSE 'm.xyz' END AS name FROM pages)"""


def _names(spark, sf_dir):
    name = F.lit("m.xyz")
    for i, n in enumerate(("a.DOCX", "b.doc", "c.Pdf", "d.epub", "e.txt", "f.rtf", "g.md", "h.html", "i.htm", "j.odt", "k.v2/noext", ".docx")):
        name = F.when(F.pmod("page_id", F.lit(13)) == i, n).otherwise(name)
    return fx.table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@query(
    f"""
    WITH {_NAMES} SELECT page_id, CASE page_id % 13 WHEN 0 THEN 'docx' WHEN 1 THEN 'doc' WHEN 2 THEN 'pdf' WHEN 3 THEN 'epub' WHEN 5 THEN 'rtf' WHEN 6 THEN 'markdown' WHEN 7 THEN 'html'
      WHEN 8 THEN 'html' WHEN 9 THEN 'odt' WHEN 10 THEN 'pdf' WHEN 11 THEN 'epub' WHEN 12 THEN 'rtf' ELSE 'plain' END AS format FROM names
    """
)
def detect_format(spark, sf_dir):
    """Names without a telling extension are told by their first bytes."""
    kind = F.pmod("page_id", F.lit(13))
    head = F.when(kind == 10, F.lit("%PDF-1.7").cast("binary")).when(kind == 11, F.concat(F.unhex(F.lit("504B0304")), F.lit("....mimetypeapplication/epub+zip").cast("binary"))).when(kind == 12, F.lit("{\\rtf1").cast("binary"))
    return _names(spark, sf_dir).select("page_id", files.detect_format(F.col("name"), head).alias("format"))


@query(f"WITH {_NAMES} SELECT page_id, page_id % 13 < 10 AS supported, CASE WHEN page_id % 13 >= 10 THEN 'unsupported format' END AS problem FROM names")
def supported_formats(spark, sf_dir):
    return _names(spark, sf_dir).select("page_id", files.is_supported(F.col("name")).alias("supported"), files.upload_problem(F.col("name")).alias("problem"))


_FILES = "files AS (SELECT 'f' || lpad(doc_id::VARCHAR, 12, '0') AS path, doc_id % 97 AS mtime, n_chars AS size_bytes, doc_id % 11 <> 0 AS is_file FROM documents)"


def _files(spark, sf_dir):
    d = F.col("doc_id")
    return fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.lpad(d.cast("string"), 12, "0")).alias("path"), F.pmod(d, F.lit(97)).alias("mtime"), F.col("n_chars").alias("size_bytes"), (F.pmod(d, F.lit(11)) != 0).alias("is_file"))


@query(f"WITH {_FILES} SELECT path, mtime FROM (SELECT *, row_number() OVER (ORDER BY mtime DESC, path DESC) AS k FROM files) WHERE k > 100")
def retention_topk(spark, sf_dir):
    return images.expired_files(_files(spark, sf_dir), 100).select("path", "mtime")


@query(f"WITH {_FILES} SELECT count(*)::BIGINT AS total_files, sum(CASE WHEN is_file THEN size_bytes END)::BIGINT AS total_bytes, round(sum(CASE WHEN is_file THEN size_bytes END)::BIGINT / 1048576.0::DOUBLE, 2) AS total_mb FROM files")
def dir_stats(spark, sf_dir):
    return images.directory_stats(_files(spark, sf_dir))


# ---- not expressible in SQL ------------------------------------------------------------------


@query()
def dom_text(spark, sf_dir):
    return markup.parsed_elements(fx.table(spark, sf_dir, "pages").select("page_id", "html"))


@query(
    """
    WITH turns AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS elem_no FROM conversations)
    SELECT conv_id, elem_no::INTEGER AS elem_no, CASE WHEN elem_no = 0 THEN 'Header' ELSE 'Para' END AS tag,
           CASE WHEN elem_no = 0 THEN '' ELSE trim(replace(text, chr(10), ' '), ' ') || chr(10) || 'end' END AS text
    FROM turns
    """
)
def ast_text(spark, sf_dir):
    """Document trees built from conversations: a heading, then a paragraph for each turn."""
    talk = fx.table(spark, sf_dir, "conversations")
    word = lambda s: F.struct(F.lit("Str").alias("t"), s.alias("c"))
    para = F.to_json(F.struct(F.lit("Para").alias("t"), F.array(word(F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))), F.struct(F.lit("LineBreak").alias("t"), F.lit(None).cast("string").alias("c")), word(F.lit("end"))).alias("c")))
    head = F.lit('{"t":"Header","c":[1,["",[],[]],[{"t":"Str","c":"lost"}]]}')
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    blocks = talk.withColumn("b", F.when(first, head).otherwise(para)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "b"))).alias("x"))
    trees = blocks.select("conv_id", F.concat(F.lit('{"blocks":['), F.array_join(F.transform("x", lambda x: x["b"]), ","), F.lit("]}")).alias("ast"))
    return markup.tree_elements(trees).select("conv_id", "elem_no", "tag", "text")


@query(
    """
    SELECT 'd' || conv_id || '.docx' AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ord, 'P' || turn AS para_id,
           text, CASE turn % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'justify' END AS alignment, 1::INTEGER AS n_runs
    FROM conversations
    """
)
def docx_paragraphs(spark, sf_dir):
    """Packages written from conversations and read again."""
    talks = fx.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def write(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
        align = {0: '<w:jc w:val="center"/>', 1: '<w:jc w:val="both"/>', 2: ""}
        for batch in batches:
            rows = []
            for conv, turns in zip(batch["conv_id"], batch["turns"], strict=True):
                body = "".join(f'<w:p w14:paraId="P{t["turn"]}"><w:pPr>{align[t["turn"] % 3]}</w:pPr><w:r><w:t xml:space="preserve">{escape(t["text"]).replace(chr(10), "</w:t><w:br/><w:t>")}</w:t></w:r></w:p>' for t in turns)
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as package:
                    package.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
                rows.append((f"d{conv}.docx", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    packed = talks.mapInPandas(write, "path string, content binary")
    return packages.read_docx(packed).select("doc_id", "ord", "para_id", "text", "alignment", F.size("runs").alias("n_runs"))


@query(f"SELECT doc_id, {sql.normalized('text')} AS normalized FROM documents")
def stream_normalize(spark, sf_dir):
    """A stream of the documents table through the normaliser into a table, then read."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    place = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = fx.table(spark, sf_dir, "documents").schema
    stream = ingest.normalize_stream(ingest.stream_table(spark, f"{sf_dir}/documents.parquet*", schema)).select("doc_id", "normalized")
    ingest.write_stream(stream, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out")
