"""CSS declarations and styled fragments as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .tables import ALIGNMENTS, HIGHLIGHTS

RUN_KEYS = ("bold", "italic", "underline", "font_name", "font_size", "font_color", "highlight_color")


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def alignment_name(alignment: Column) -> Column:
    return F.coalesce(_lookup(ALIGNMENTS, F.coalesce(alignment, F.lit("left"))), F.lit("left"))


def highlight_color(index: Column) -> Column:
    """Colour of a highlight index; null if there is none."""
    return _lookup(HIGHLIGHTS, F.coalesce(index, F.lit(-1)))


def rgb_color(value: Column) -> Column:
    """Number -> #RRGGBB."""
    return F.concat(F.lit("#"), F.lpad(F.hex(value.cast("long")), 6, "0"))


def style_class(name: Column) -> Column:
    return F.when(name.isNull() | (name == ""), "").otherwise(F.concat(F.lit("word-style-"), F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]", "-")))


def _given(value: Column) -> Column:
    return value.isNotNull() & (value != 0)


def declarations(*parts: Column) -> Column:
    """Joined by '; '; null parts are left out, null if none is there."""
    joined = F.concat_ws("; ", *parts)
    return F.when(joined != "", joined)


def paragraph_css(alignment: Column, fmt: Column) -> Column:
    """Alignment other than left, then indents, spacing and line height that are not zero."""
    align = alignment_name(alignment)
    points = (("margin-left", "left_indent"), ("margin-right", "right_indent"), ("text-indent", "first_line_indent"), ("margin-top", "space_before"), ("margin-bottom", "space_after"))
    return declarations(
        F.when(align != "left", F.concat(F.lit("text-align: "), align)),
        *[F.when(_given(fmt[f]), F.concat(F.lit(f"{css}: "), fmt[f].cast("string"), F.lit("pt"))) for css, f in points],
        F.when(_given(fmt["line_spacing"]), F.concat(F.lit("line-height: "), fmt["line_spacing"].cast("string"))),
    )


def add_css(existing: Column, new: Column) -> Column:
    """``new`` behind an existing style, with one ';' between them."""

    def joined(pair: Column) -> Column:
        old = F.coalesce(pair["old"], F.lit(""))
        mark = F.when((old != "") & ~old.endswith(";"), ";").otherwise("")
        return F.when(pair["new"].isNull(), pair["old"]).otherwise(F.trim(F.concat(old, mark, F.lit(" "), pair["new"])))

    return let(F.struct(existing.alias("old"), new.alias("new")), joined)


def _font(run: Column) -> list[Column]:
    return [
        F.when(run["font_name"].isNotNull() & (run["font_name"] != ""), F.concat(F.lit("font-family: '"), run["font_name"], F.lit("'"))),
        F.when(_given(run["font_size"]), F.concat(F.lit("font-size: "), run["font_size"].cast("double").cast("string"), F.lit("pt"))),
        F.when(run["font_color"].startswith("#"), F.concat(F.lit("color: "), run["font_color"])),
        F.when(run["highlight_color"].startswith("#"), F.concat(F.lit("background-color: "), run["highlight_color"])),
    ]


def uniform_css(existing: Column, run: Column) -> Column:
    """A paragraph's style with what all of its runs share; weight, slant and line only if not set yet."""
    style = add_css(existing, declarations(*_font(run)))
    for key, css, value in (("bold", "font-weight", "bold"), ("italic", "font-style", "italic"), ("underline", "text-decoration", "underline")):
        wanted = F.coalesce(run[key], F.lit(False))
        style = let(style, lambda s: F.when(wanted & ~F.coalesce(s, F.lit("")).contains(css), add_css(s, F.lit(f"{css}: {value}"))).otherwise(s))  # noqa: B023
    return style


def styled_run(text: Column, run: Column) -> Column:
    """A run's text in a span with its style, inside <em>, inside <strong>."""
    css = declarations(F.when(run["underline"], F.lit("text-decoration: underline")), *_font(run))
    open_, close = let(css, lambda c: F.when(c.isNotNull(), F.concat(F.lit('<span style="'), c, F.lit('">'))).otherwise("")), F.when(css.isNotNull(), "</span>").otherwise("")
    tags = [(F.coalesce(run[k], F.lit(False)), t) for k, t in (("bold", "strong"), ("italic", "em"))]
    return F.concat(*[F.when(on, f"<{t}>").otherwise("") for on, t in tags], open_, text, close, *[F.when(on, f"</{t}>").otherwise("") for on, t in reversed(tags)])


def css_rules(classes: Column) -> Column:
    """Rules of an array of classes, sorted, and the four alignment rules."""
    rules = F.transform(F.array_sort(F.array_distinct(F.filter(classes, lambda c: c.isNotNull() & (c != "")))), lambda c: F.concat(F.lit("."), c, F.lit(" { margin: 0.5em 0; }")))
    fixed = F.array(*[F.lit(f".align-{a} {{ text-align: {a}; }}") for a in ("center", "right", "justify", "left")])
    return F.array_join(F.concat(rules, fixed), "\n")
