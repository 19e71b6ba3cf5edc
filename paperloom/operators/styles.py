"""Paragraph and run styles: which runs agree, which style prevails, and the styled HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.css import RUN_KEYS, add_css, css_rules, paragraph_css, style_class, styled_run, uniform_css
from ..functions.text import escape_html, is_blank


def style_key(run: Column) -> Column:
    """The style of a run as one text: each key that is set, with its value."""
    return F.concat_ws("\x1f", *[F.when(run[k].isNotNull(), F.concat(F.lit(f"{k}="), run[k].cast("string"))) for k in RUN_KEYS])


def visible_runs(runs: Column) -> Column:
    return F.filter(runs, lambda r: ~is_blank(r["text"]))


def is_uniform(runs: Column) -> Column:
    """Whether all runs share their style; none or one always does."""
    return F.size(F.array_distinct(F.transform(runs, style_key))) <= 1


def prevailing_run(runs: Column) -> Column:
    """First run with the most frequent style; of equally frequent ones the style seen first."""

    def place(keys: Column) -> Column:
        counts = F.transform(keys, lambda k: F.size(F.filter(keys, lambda x: x == k)))
        return let(counts, lambda c: F.array_position(c, F.array_max(c)).cast("int"))

    return F.try_element_at(runs, let(F.transform(runs, style_key), place))


def run_styles(runs: DataFrame, by: list[str]) -> DataFrame:
    """Rows of runs (by.., ord, text, style keys) -> by.., n_runs, is_uniform, and the prevailing style.

    Counts per style are pre-aggregated, so a paragraph with very many runs stays small.
    """
    run = F.struct(*RUN_KEYS)
    kept = runs.where(~is_blank(F.col("text"))).withColumn("_run", run).withColumn("_key", style_key(F.col("_run")))
    counts = kept.groupBy(*by, "_key").agg(F.count("*").alias("_n"), F.min("ord").alias("_first"), F.min_by("_run", "ord").alias("_run"))
    best = F.max_by("_run", F.struct("_n", -F.col("_first"))).alias("style")
    return counts.groupBy(*by).agg(F.sum("_n").alias("n_runs"), (F.count("*") <= 1).alias("is_uniform"), best)


def mixed_runs_html(html: Column, runs: Column) -> Column:
    """Inner HTML with each run that differs from the prevailing style replaced, once, by its styled form.

    Runs are taken in order, each looks for its text as it is, then escaped; the result has no
    paragraph inside a paragraph.
    """

    def step(main: Column):
        def swap(text: Column, run: Column) -> Column:
            raw, safe = run["text"], escape_html(run["text"])
            found = F.when(F.instr(text, raw) > 0, raw).when(F.instr(text, safe) > 0, safe)

            def swapped(f: Column) -> Column:
                at = F.instr(text, f)
                return F.concat(F.substr(text, F.lit(1), at - 1), styled_run(f, run), F.substr(text, at + F.length(f)))

            return F.when(style_key(run) == main, text).otherwise(F.coalesce(let(found, swapped), text))

        return swap

    return let(style_key(prevailing_run(runs)), lambda main: F.aggregate(runs, html, step(main)))


def apply_styles(elements: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """elements (doc_id, elem_no, id, style, classes, inner_html, text) and paragraphs (doc_id, para_id,
    alignment, style_name, paragraph_format, runs) -> elements with style, classes and inner_html set.

    One equi-join on (doc_id, id); elements without a paragraph stay as they are.
    """
    known = paragraphs.select(F.col("doc_id").alias("_doc"), F.col("para_id").alias("_para"), "alignment", "style_name", "paragraph_format", visible_runs(F.col("runs")).alias("_runs"), F.lit(True).alias("_hit"))
    joined = elements.join(known, (F.col("doc_id") == F.col("_doc")) & (F.col("id") == F.col("_para")), "left")
    style = add_css(F.col("style"), paragraph_css(F.col("alignment"), F.col("paragraph_format")))
    classes = F.coalesce("classes", F.array().cast("array<string>"))
    name = style_class(F.col("style_name"))
    classes = F.when((name != "") & ~F.array_contains(classes, name), F.concat(classes, F.array(name))).otherwise(classes)
    has_runs = (F.size("_runs") > 0) & ~is_blank(F.col("text"))
    uniform = has_runs & is_uniform(F.col("_runs"))
    hit = F.coalesce("_hit", F.lit(False))
    out = {
        "style": F.when(uniform, uniform_css(style, F.col("_runs")[0])).when(hit, style).otherwise(F.col("style")),
        "classes": F.when(hit, classes).otherwise(F.col("classes")),
        "inner_html": F.when(has_runs & ~uniform, mixed_runs_html(F.col("inner_html"), F.col("_runs"))).otherwise(F.col("inner_html")),
    }
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in elements.columns])


def document_css(paragraphs: DataFrame) -> DataFrame:
    """doc_id -> the rules of its style classes and the alignment rules."""
    return paragraphs.groupBy("doc_id").agg(css_rules(F.collect_set(style_class(F.col("style_name")))).alias("css"))
