"""Images of pages and of HTML: filtering, de-duplication, placement, naming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import IMAGE_EXTENSIONS

# Fixed value: one <img> tag with its source; of several the last ``src=`` in a tag counts.
IMG_SRC = r"(?i)<img[^>]+src=[\"']([^\"']+)[\"'][^>]*>"


@dataclass(frozen=True)
class ImageRules:
    min_bytes: int = 1024
    min_width: float = 80
    min_height: float = 80
    min_ratio: float = 0.2
    max_ratio: float = 5.0
    min_pixels: int = 50
    min_colors: int = 10
    min_grey_range: int = 20
    distance: float = 100
    max_rendered_width: int = 600


def rejection(rules: ImageRules = ImageRules(), pixels: bool = False) -> Column:
    """Why an image is decoration, by the first test that says so; null if none does.

    ``pixels``: columns px_width, px_height, mode, n_colors, grey_min, grey_max are there; where
    they are null the image couldn't be decoded and those tests pass.
    """
    ratio = F.col("width") / F.col("height")
    out = F.when(F.col("size") < rules.min_bytes, "bytes").when((F.col("width") < rules.min_width) | (F.col("height") < rules.min_height), "small")
    out = out.when((F.col("width") > 0) & (F.col("height") > 0) & (ratio < rules.min_ratio), "thin").when((F.col("width") > 0) & (F.col("height") > 0) & (ratio > rules.max_ratio), "wide")
    if pixels:
        out = out.when((F.col("px_width") < rules.min_pixels) | (F.col("px_height") < rules.min_pixels), "pixels")
        out = out.when(F.col("mode").isin("RGB", "RGBA", "L") & (F.col("n_colors") < rules.min_colors), "colors")
        out = out.when(F.col("mode").isin("L", "1") & (F.col("grey_max") - F.col("grey_min") < rules.min_grey_range), "uniform")
    return out


def filter_images(images: DataFrame, rules: ImageRules = ImageRules(), pixels: bool = False) -> DataFrame:
    """Adds ``reason``: the rule an image fails, or "duplicate" after the first with its md5 in a document."""
    judged = images.withColumn("reason", rejection(rules, pixels))
    first = Window.partitionBy("doc", F.col("reason").isNull(), "md5").orderBy("page", "index")
    again = F.col("reason").isNull() & F.col("md5").isNotNull() & (F.row_number().over(first) > 1)
    return judged.withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason")))


def place_images(images: DataFrame, paragraphs: DataFrame, rules: ImageRules = ImageRules()) -> DataFrame:
    """Each image with the first paragraph below it and within the distance; null para_no: end of page.

    Paragraphs are cut in strips as high as the distance and an image looks in its own strip and
    the next, so this is an equi-join on (doc, page, strip) whatever a page holds.
    """
    step = F.lit(float(rules.distance))
    strips = images.select("doc", "page", "index", F.col("y0").alias("_y"), F.explode(F.array(F.floor(F.col("y0") / step), F.floor(F.col("y0") / step) + 1)).alias("_strip"))
    below = paragraphs.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), "para_no", F.col("y0").alias("_py"), F.floor(F.col("y0") / step).alias("_pstrip"))
    near = strips.join(below, (F.col("doc") == F.col("_doc")) & (F.col("page") == F.col("_page")) & (F.col("_strip") == F.col("_pstrip")) & (F.col("_y") < F.col("_py")) & (F.col("_py") - F.col("_y") < rules.distance))
    first = near.groupBy("doc", "page", "index").agg(F.min("para_no").alias("para_no"))
    return images.join(first, ["doc", "page", "index"], "left")


def ordered_images(images: DataFrame) -> DataFrame:
    """Adds ``pos``: an image's place on its page from the top, of equally high ones by index."""
    return images.withColumn("pos", F.row_number().over(Window.partitionBy("doc", "page").orderBy("y0", "index")))


def first_image_rect(images: DataFrame, image_blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1 of the page's first image block, or of the page if it has none."""
    box = F.struct("x0", "y0", "x1", "y1")
    first = image_blocks.groupBy("doc", "page").agg(F.min_by(box, "block_no").alias("_first"))
    whole = pages.select("doc", "page", box.alias("_whole"))
    joined = images.join(first, ["doc", "page"], "left").join(whole, ["doc", "page"], "left").withColumn("_box", F.coalesce("_first", "_whole"))
    return joined.select(*images.columns, "_box.x0", "_box.y0", "_box.x1", "_box.y1")


def positional_name(page: Column, index: Column, ext: Column) -> Column:
    return F.format_string("pdf_page%d_img%d.%s", page, index, ext)


def render_image(path: Column, width: Column, height: Column, rules: ImageRules = ImageRules()) -> Column:
    """An <img> in a centred paragraph, not wider than the limit, sizes cut to whole numbers."""
    over = width > rules.max_rendered_width
    w = F.when(over, F.lit(rules.max_rendered_width)).otherwise(width.cast("int"))
    h = F.when(over, (height * (F.lit(rules.max_rendered_width) / width)).cast("int")).otherwise(height.cast("int"))
    size = F.when((width > 0) & (height > 0), F.concat(F.lit(' width="'), w, F.lit('" height="'), h, F.lit('"'))).otherwise("")
    return F.concat(F.lit('<p class="pdf-image" style="text-align: center;"><img src="'), path, F.lit('" alt="PDF图片"'), size, F.lit(" /></p>"))


# ---- images in HTML --------------------------------------------------------------------------


def image_sources(html: Column) -> Column:
    """Sources of all <img> tags, in order."""
    return F.regexp_extract_all(html, F.lit(IMG_SRC), F.lit(1))


def source_kind(src: Column) -> Column:
    """http, base64, local or ignored; prefixes are case-sensitive."""
    ignored = src.startswith("data:") | src.startswith("#") | src.startswith("mailto:")
    return F.when(src.startswith("http://") | src.startswith("https://"), "http").when(src.startswith("data:image/"), "base64").when(src.startswith("media/") | ~ignored, "local").otherwise("ignored")


def image_extension(url: Column) -> Column:
    """By a data URL's type or a URL's path; .jpg where neither tells."""
    kind = F.regexp_extract(url, r"^data:([^;]*);", 1)
    of_type = F.lit(".jpg")
    for name, ext in IMAGE_EXTENSIONS.items():
        of_type = F.when(kind == name, ext).otherwise(of_type)
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    of_path = F.when(path.rlike(r"\.jpe?g\z"), ".jpg")
    for ext in (".png", ".gif", ".webp", ".bmp"):
        of_path = of_path.when(path.endswith(ext), ext)
    return F.when(url.startswith("data:"), of_type).otherwise(F.coalesce(of_path, F.lit(".jpg")))


def image_name(url: Column, content: Column | None = None) -> Column:
    """First 16 hexadecimal digits of the content's MD5 (the URL's without content) and the extension."""
    by_url = F.md5(url.cast("binary"))
    key = by_url if content is None else F.when(content.isNull() | (F.length(content) == 0), by_url).otherwise(F.md5(content))
    return F.concat(F.substring(key, 1, 16), image_extension(url))


def data_url_content(src: Column) -> Column:
    """Bytes of a base64 image URL; null if it is none, has no comma or holds nothing."""
    body = F.regexp_replace(F.element_at(F.split(src, ",", 2), -1), "[^A-Za-z0-9+/]", "")
    # padding is put right before decoding
    whole = F.substr(body, F.lit(1), F.length(body) - F.when(F.length(body) % 4 == 1, 1).otherwise(0))
    content = F.unbase64(F.rpad(whole, F.ceil(F.length(whole) / 4).cast("int") * 4, "="))
    return F.when(src.startswith("data:image/") & src.contains(",") & (F.length(content) > 0), content)


def relative_path(name: Column) -> Column:
    return F.concat(F.lit("../uploads/images/"), F.regexp_extract(name, r"([^/]*)\z", 1))


def localize_images(html: Column, pairs: Column) -> Column:
    """``html`` with sources replaced; ``pairs``: array of struct(src, path), in order, no null path."""

    def step(text: Column, pair: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), F.replace(pair["src"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        tag = F.regexp_substr(text, F.concat(F.lit(r"(?i)<img[^>]+src=[\"']"), quoted, F.lit(r"[\"'][^>]*>")))
        return F.when(tag.isNull(), text).otherwise(F.replace(text, tag, F.replace(tag, pair["src"], pair["path"])))

    return F.aggregate(pairs, html, step)


def fetchable(src: Column) -> Column:
    return src.startswith("http://") | src.startswith("https://")


def usable_download(src: Column, content: Column, least: int = 100) -> Column:
    return fetchable(src) & (F.length(content) >= least)


def resolve_local(images: DataFrame, media: DataFrame) -> DataFrame:
    """Adds ``path`` of the media file with the source's base name, null if there is none."""
    named = media.groupBy(F.col("doc_id").alias("_doc"), F.col("name").alias("_name")).agg(F.min("path").alias("path"))
    base = F.regexp_extract(F.col("src"), r"([^/]*)\z", 1)
    return images.join(named, (F.col("doc_id") == F.col("_doc")) & (base == F.col("_name")), "left").select(*images.columns, "path")


# ---- stored files ----------------------------------------------------------------------------


def expired_files(files: DataFrame, keep: int, group: list[str] | None = None) -> DataFrame:
    """Files beyond the newest ``keep`` (by time, then path); 0 expires nothing.

    Without a group only the ``keep`` newest are sorted, and the others are those older than the
    oldest of them.
    """
    if keep == 0:
        return files.limit(0)
    if group:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("mtime").desc(), F.col("path").desc()))
        return files.withColumn("_rank", rank).where(F.col("_rank") > keep).drop("_rank")
    newest = files.orderBy(F.col("mtime").desc(), F.col("path").desc()).limit(keep)
    edge = newest.agg(F.min(F.struct("mtime", "path")).alias("_edge"), F.count("*").alias("_n"))
    return files.join(F.broadcast(edge), (F.struct("mtime", "path") < F.col("_edge")) & (F.col("_n") == keep)).select(*files.columns)  # one row is broadcast


def directory_stats(files: DataFrame) -> DataFrame:
    """File count (directories included), bytes of files, MB."""
    total = F.coalesce(F.sum(F.when(F.col("is_file"), F.col("size_bytes"))), F.lit(0))
    return files.agg(F.count("*").alias("total_files"), total.alias("total_bytes"), F.round(total / 1048576.0, 2).alias("total_mb"))
