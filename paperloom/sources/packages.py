"""Word-processor and e-book packages as rows, read with the standard library on the executors."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.tables import HIGHLIGHTS

# Namespaces, twips per point, named highlights in the order of their index.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
TWIPS = 20.0
_HIGHLIGHT_NAMES = ("black", "blue", "cyan", "green", "magenta", "red", "yellow", "white", "darkBlue", "darkCyan", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "darkGray", "lightGray")
_ALIGN = {"both": "justify", "start": "left", "end": "right", "center": "center", "left": "left", "right": "right", "distribute": "distribute"}
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp")
_PICTURE = re.compile("graphic|blip|pic:pic")
ID_MODULUS = 1_000_000


def _flag(props, name: str):
    """True, false, or nothing said."""
    node = props.find(f"{W}{name}") if props is not None else None
    if node is None:
        return None
    return node.get(f"{W}val", "true") not in ("0", "false", "none", "off")


def _points(node, name: str):
    try:
        value = float(node.get(f"{W}{name}")) / TWIPS if node is not None and node.get(f"{W}{name}") else None
    except ValueError:
        return None
    return value or None


def _color(props):
    """#RRGGBB, theme-<name>, or nothing."""
    node = props.find(f"{W}color") if props is not None else None
    if node is None:
        return None
    value = node.get(f"{W}val") or ""
    if re.fullmatch("[0-9A-Fa-f]{6}", value):
        return f"#{value.upper()}"
    theme = node.get(f"{W}themeColor")
    return f"theme-{theme}" if theme else None


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _run(i: int, node) -> dict:
    blank = {"id": f"run_{i}", "text": "", "bold": False, "italic": False, "underline": False, "font_name": None, "font_size": None, "font_color": None, "highlight_color": None}
    try:
        props = node.find(f"{W}rPr")
        fonts, size, mark = (props.find(f"{W}{n}") if props is not None else None for n in ("rFonts", "sz", "highlight"))
        named = mark.get(f"{W}val") if mark is not None else None
        return {
            "id": f"run_{i}",
            "text": _text(node),
            "bold": _flag(props, "b"),
            "italic": _flag(props, "i"),
            "underline": _flag(props, "u"),
            "font_name": fonts.get(f"{W}ascii") if fonts is not None else None,
            "font_size": float(size.get(f"{W}val")) / 2 if size is not None else None,
            "font_color": _color(props),
            "highlight_color": HIGHLIGHTS[_HIGHLIGHT_NAMES.index(named) + 1] if named in _HIGHLIGHT_NAMES else None,
        }
    except (ValueError, TypeError, AttributeError):
        return blank | {"text": _text(node)}


def _format(props) -> dict:
    """Indents and spacing in points; space behind counts only where space in front is set."""
    indent, space = (props.find(f"{W}{n}") if props is not None else None for n in ("ind", "spacing"))
    first = _points(indent, "firstLine") or (-_points(indent, "hanging") if _points(indent, "hanging") else None)
    before = _points(space, "before")
    line, rule = (space.get(f"{W}line"), space.get(f"{W}lineRule", "auto")) if space is not None else (None, "auto")
    return {
        "left_indent": _points(indent, "left") or _points(indent, "start"),
        "right_indent": _points(indent, "right") or _points(indent, "end"),
        "first_line_indent": first,
        "space_before": before,
        "space_after": _points(space, "after") if before else None,
        "line_spacing": (float(line) / 240 if rule == "auto" else float(line) / TWIPS) if line else None,
    }


def _style_names(package: zipfile.ZipFile) -> dict[str, str]:
    try:
        root = ElementTree.fromstring(package.read("word/styles.xml"))
    except (KeyError, ElementTree.ParseError):
        return {}
    out = {}
    for style in root.iter(f"{W}style"):
        name = style.find(f"{W}name")
        out[style.get(f"{W}styleId", "")] = name.get(f"{W}val") if name is not None else None
    return out


def docx_paragraphs(doc_id: str, content: bytes) -> list[dict]:
    """Paragraphs of the body, tables left out; of equal ids the last values at the first place."""
    import xxhash

    with zipfile.ZipFile(io.BytesIO(content)) as package:
        root, names = ElementTree.fromstring(package.read("word/document.xml")), _style_names(package)
    body, out = root.find(f"{W}body"), {}
    for node in body.findall(f"{W}p") if body is not None else []:
        props, text, xml = node.find(f"{W}pPr"), _text(node), ElementTree.tostring(node)
        para_id, synthetic = node.get(f"{W14}paraId") or node.get(f"{W}paraId"), False
        if not para_id and (text.strip() or _PICTURE.search(xml.decode().lower())):
            para_id, synthetic = f"hash_text_{xxhash.xxh3_64_intdigest(xml) % ID_MODULUS:06d}", True
        if not para_id:
            continue
        align, style = (props.find(f"{W}{n}") if props is not None else None for n in ("jc", "pStyle"))
        row = {
            "doc_id": doc_id,
            "ord": out[para_id]["ord"] if para_id in out else len(out),
            "para_id": para_id,
            "text": text,
            "alignment": _ALIGN.get(align.get(f"{W}val")) if align is not None else None,
            "style_name": names.get(style.get(f"{W}val")) if style is not None else "Normal",
            "runs": [_run(i, r) for i, r in enumerate(node.findall(f"{W}r"))],
            "paragraph_format": _format(props),
            "fallback": synthetic,
        }
        out[para_id] = row
    return list(out.values())


def _per_file(files: DataFrame, parse, schema: str) -> DataFrame:
    columns = [f.split()[0] for f in schema.split(", ") if " " in f]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = parse(path, bytes(content)) if content is not None else []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []  # not a package of this kind
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def read_docx(files: DataFrame) -> DataFrame:
    """(path, content) -> paragraphs; ``doc_id`` is the path.  Files that are no packages give no rows."""
    return _per_file(files, docx_paragraphs, schemas.PARAGRAPH)


def package_media(files: DataFrame) -> DataFrame:
    """(path, content) -> embedded images of word-processor packages."""

    def parse(path, content):
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            entries = [n for n in package.namelist() if n.startswith("word/media/") and n.lower().endswith(IMAGE_SUFFIXES)]
            return [{"doc_id": path, "entry": n, "name": posixpath.basename(n), "content": package.read(n)} for n in entries]

    return _per_file(files, parse, schemas.MEDIA)


def read_epub(files: DataFrame) -> DataFrame:
    """(path, content) -> the XHTML parts of e-books in reading order."""

    def parse(path, content):
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            container = ElementTree.fromstring(package.read("META-INF/container.xml"))
            place = next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))
            book = ElementTree.fromstring(package.read(place))
            items = {x.get("id"): x.get("href") for x in book.iter() if x.tag.endswith("}item")}
            spine = [items[x.get("idref")] for x in book.iter() if x.tag.endswith("}itemref") and x.get("idref") in items]
            entries = [posixpath.normpath(posixpath.join(posixpath.dirname(place), href)) for href in spine]
            return [{"doc_id": path, "pos": i, "entry": n, "html": package.read(n).decode("utf-8", "replace")} for i, n in enumerate(entries) if n in package.namelist()]

    return _per_file(files, parse, schemas.EPUB_PART)


def paragraphs_to_html(paragraphs: DataFrame) -> DataFrame:
    """Paragraph rows -> one plain HTML body for each document, headings by style name, ids set."""
    from ..functions.text import escape_html

    level = F.regexp_extract(F.lower(F.coalesce("style_name", F.lit(""))), r"^heading ([1-6])\z", 1)
    tag = F.when(level != "", F.concat(F.lit("h"), level)).otherwise("p")
    html = F.concat(F.lit("<"), tag, F.lit(' id="'), F.col("para_id"), F.lit('">'), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    parts = paragraphs.select("doc_id", F.struct("ord", html.alias("html")).alias("x"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["html"]), "\n").alias("html"))
