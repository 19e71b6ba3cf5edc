"""Text normalisation as Column expressions.

White space is one explicit class everywhere: the engines' own ``\\s`` differ.  Normalising takes one
Arrow step for all its parts: the JVM has no compatibility form, and its regular expressions test the
ranges of a class like white space one by one at every character, which costs far more than the
crossing (25 MB of text: 60 s against 2 s).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import CHARACTERS

#: Every character that counts as white space.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Punctuation rules in order, pattern and replacement.
_CJK_CLOSERS = "，。、；：\"（）【】《》？！"
_CJK_SHORT = "，。、；："
PUNCTUATION_RULES = (
    (r"[\x{200B}-\x{200D}\x{FEFF}]", ""),
    (rf"[{SPACE}]+([{_CJK_CLOSERS}])", "$1"),
    (rf"[{SPACE}]+([,;:.!?])", "$1"),
    (r"([,;:.!?])([^ \n\p{Nd}])", "$1 $2"),
    (rf"([{_CJK_SHORT}])[{SPACE}]+([{_CJK_SHORT}])", "$1$2"),
    (" +", " "),
)
FALLBACK_RULES = (
    (rf"[{SPACE}]+([{_CJK_CLOSERS}])", "$1"),
    (r"([,;:!?])([^ \n])", "$1 $2"),
    (rf"([{_CJK_SHORT}])\x{{200B}}+", "$1"),
)
CONTROLS = r"[\x{0}-\x{8}\x{B}-\x{C}\x{E}-\x{1F}]"


def _for_python(pattern: str) -> re.Pattern:
    pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", pattern)
    return re.compile(pattern.replace(r"\p{Nd}", r"\d"))


def _compiled(rules: tuple[tuple[str, str], ...]) -> list[tuple[re.Pattern, str]]:
    return [(_for_python(pattern), re.sub(r"\$([12])", r"\\\1", to)) for pattern, to in rules]


_SPACES = "".join(chr(c) for c in range(0x3001) if re.match(f"[{_for_python(SPACE.join('[]')).pattern[1:-1]}]", chr(c)))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(_SPACES))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(rf"[^{SPACE}]")


class Normalizer:
    """The steps of ``normalize`` on one Python string."""

    def __init__(self, use_nfkc: bool = True, use_custom_mappings: bool = True, use_punctuation_rules: bool = True, additional_mappings: dict[str, str] | None = None, drop_controls: bool = False):
        self.nfkc, self.drop = use_nfkc, _for_python(CONTROLS) if drop_controls else None
        self.rules = _compiled(PUNCTUATION_RULES) if use_punctuation_rules else []
        table = CHARACTERS | (additional_mappings or {})
        # no fixed replacement yields a character that is replaced itself, so all go in one pass; others go one by one
        self.table = str.maketrans(CHARACTERS) if use_custom_mappings and not additional_mappings else None
        self.chain = list(table.items()) if use_custom_mappings and additional_mappings else []
        self.some = re.compile("[" + "".join(CHARACTERS) + "]")

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        if not text.isascii():
            if self.nfkc:
                text = unicodedata.normalize("NFKC", text)
            if self.table and self.some.search(text):
                text = text.translate(self.table)
        for old, new in self.chain:
            text = text.replace(old, new)
        for pattern, to in self.rules:
            text = pattern.sub(to, text)
        text = text.strip(_SPACES)
        return self.drop.sub("", text).strip(_SPACES) if self.drop else text


def _each(text: Column, f) -> Column:
    """``f`` on each string, in Arrow batches; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run(text)


def nfkc(text: Column) -> Column:
    """Compatibility composition."""
    return _each(text, lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


def replace_characters(text: Column, more: dict[str, str] | None = None) -> Column:
    """The fixed replacements, with ``more`` in its own order."""
    normalizer = Normalizer(False, True, False, more)

    def replace(t: str) -> str:
        if normalizer.table:
            return t.translate(normalizer.table)
        for old, new in normalizer.chain:
            t = t.replace(old, new)
        return t

    return _each(text, replace)


def fix_punctuation_fallback(text: Column) -> Column:
    """The shorter rule set for use without normalisation; straight quotes stay straight."""
    rules = _compiled(FALLBACK_RULES)

    def fix(t: str) -> str:
        for pattern, to in rules:
            t = pattern.sub(to, t)
        return t

    return _each(text, fix)


def normalize(text: Column, use_nfkc: bool = True, use_custom_mappings: bool = True, use_punctuation_rules: bool = True, additional_mappings: dict[str, str] | None = None) -> Column:
    """Compatibility form, replacements, punctuation rules, strip; null and empty stay as they are."""
    return _each(text, Normalizer(use_nfkc, use_custom_mappings, use_punctuation_rules, additional_mappings))


def clean_text(text: Column, **options) -> Column:
    """Normalised and without control characters."""
    return _each(text, Normalizer(**options, drop_controls=True))


def normalize_paragraphs(paragraphs: Column, **options) -> Column:
    """An array of paragraphs: blank ones go, the others are normalised."""
    normalizer = Normalizer(**options)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ps: [normalizer(p) for p in ps if p and p.strip(_SPACES)], na_action="ignore")

    return run(paragraphs)


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def code_point(char: Column) -> Column:
    """Like U+0041."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(char)), 4, "0"))


_INFO = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "category", "nfkc")])


@F.pandas_udf(_INFO)
def _unicode_info(chars: pd.Series) -> pd.DataFrame:
    rows = [(unicodedata.name(c, "UNKNOWN"), unicodedata.category(c), unicodedata.normalize("NFKC", c)) for c in chars]
    return pd.DataFrame(rows, columns=["name", "category", "nfkc"])


def character_info(chars: DataFrame, char: str = "char") -> DataFrame:
    """One row for each character: code, decimal, name, category, nfkc, in_custom_mappings.

    Values that are not exactly one character get an ``error`` instead.
    """
    one = F.length(char) == 1
    known = F.col(char).isin(*CHARACTERS)
    return (
        chars.withColumn("_info", F.when(one, _unicode_info(F.when(one, F.col(char)).otherwise(F.lit(" ")))))
        .withColumn("code", F.when(one, code_point(F.col(char))))
        .withColumn("decimal", F.when(one, F.ascii(char)))
        .select(*chars.columns, "code", "decimal", "_info.name", "_info.category", "_info.nfkc", F.when(one, known).alias("in_custom_mappings"), F.when(~one, F.lit("not one character")).alias("error"))
    )


def character_inventory(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct characters of all texts with the number of texts that hold each."""
    chars = texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char")).where(F.col("char") != "")
    return chars.groupBy("char").agg(F.count("*").alias("n_texts")).withColumn("code", code_point(F.col("char"))).withColumn("decimal", F.ascii("char"))


def ordered_characters(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct characters of all texts with their place in code point order.

    They are counted first: at most as many as there are code points come to the one window.
    """
    return character_inventory(texts, text).withColumn("pos", F.row_number().over(Window.orderBy("decimal")))
