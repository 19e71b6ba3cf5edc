import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import config, css, similarity, text
from paperloom.functions.tables import CHARACTERS

ODD = " \t\n\x0b\x1c\x85\xa0  ​‍﻿　,;:.!?，。、；：\"《》abZé0٣①Ａ™ﬁ—≠🙂"
RULES = [
    (r"[​‌‍﻿]", ""),
    (r"\s+([，。、；：\"（）【】《》？！])", r"\1"),
    (r"\s+([,;:.!?])", r"\1"),
    (r"([,;:.!?])([^ \n\d])", r"\1 \2"),
    (r"([，。、；：])\s+([，。、；：])", r"\1\2"),
    (r" +", " "),
]


def plain(value, nfkc=True, custom=True, rules=True):
    if not value:
        return value
    if nfkc:
        value = unicodedata.normalize("NFKC", value)
    if custom:
        for a, b in CHARACTERS.items():
            value = value.replace(a, b)
    if rules:
        for a, b in RULES:
            value = re.sub(a, b, value)
    return value.strip()


def column(spark, values, f):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=ODD, max_size=25), min_size=1, max_size=60))
def test_normalize_equals_python(spark, values):
    values = [*values, None, ""]
    assert column(spark, values, text.normalize) == [plain(v) for v in values]
    assert column(spark, values, lambda c: text.normalize(c, use_nfkc=False)) == [plain(v, nfkc=False) for v in values]
    assert column(spark, values, lambda c: text.normalize(c, use_nfkc=False, use_custom_mappings=False)) == [plain(v, False, False) for v in values]
    assert column(spark, values, lambda c: text.normalize(c, use_punctuation_rules=False)) == [plain(v, rules=False) for v in values]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("a...b", "a. .. b"), ("http://y.z", "http: //y. z"), ('say "hi"', 'say"hi"'), ("①", "1"), ("™", "TM"), ("a ​b", "a b"), ("℃", "degC"), ("x —y", "x --y"), ("《书》", "<<书>>")],
)
def test_golden(spark, given, expected):
    assert column(spark, [given], text.normalize) == [expected]


def test_whole_map(spark):
    table = CHARACTERS
    assert len(table) == 210 and table["⑳"] == "(20)" and table["ⓩ"] == "(z)" and table["Ⅷ"] == "VIII" and table["₉"] == "9"
    assert column(spark, list(table), text.replace_characters) == list(table.values())


def test_additional_mappings_keep_their_order(spark):
    assert column(spark, ["a—"], lambda c: text.replace_characters(c, {"a": "b", "b": "c", "—": "a"})) == ["cc"]
    assert column(spark, ["—x"], lambda c: text.replace_characters(c, {"—": "="})) == ["=x"]


def test_clean_fallback_and_paragraphs(spark):
    assert column(spark, ["a\x07b \x00", "\x1f"], text.clean_text) == ["ab", ""]
    assert column(spark, ["a ，b,c.d 1:2", "，​​x"], text.fix_punctuation_fallback) == ["a，b, c.d 1: 2", "，x"]
    frame = spark.createDataFrame([(1, ["a ,b", " \t", "", "c①"]), (2, []), (3, None)], "i int, p array<string>")
    assert [r.p for r in frame.select("i", text.normalize_paragraphs(F.col("p")).alias("p")).orderBy("i").collect()] == [["a, b", "c1"], [], None]


def test_white_space_is_pythons(spark):
    assert text._SPACES == "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert column(spark, ["\u3000 a\x1cb\x85\t", "", None, " "], text.strip) == ["a\x1cb", "", None, ""]


def test_replacements_follow_unicode():
    """The series of the table, told by Unicode's own data."""
    for char, to in CHARACTERS.items():
        form, name = unicodedata.normalize("NFKC", char), unicodedata.name(char, "")
        if name.startswith(("CIRCLED", "PARENTHESIZED")) and "IDEOGRAPH" not in name:
            assert to == f"({form.strip('()')})"
        if "SCRIPT DIGIT" in name or name.startswith(("SUPERSCRIPT", "ROMAN NUMERAL", "SMALL ROMAN")):
            assert to == form
        assert to.isascii() and (unicodedata.category(char) != "Zs" or to == " ")


def test_character_keys(spark):
    from paperloom.functions.similarity import character_key, character_set

    values = ["Hello, World 12²", "", None, "***", "ΑΣ ΑΣΑ", "Éé½Ⅷ", "abcabc" * 1000, "İ"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = frame.select("i", character_key(F.col("x")).alias("k"), F.array_join(F.array_sort(character_set(F.col("x"))), "").alias("s")).orderBy("i").collect()
    assert all(r.k == r.s for r in rows) and rows[0].k == "12dehlorw²"

def test_character_info(spark):
    rows = {r.char: r for r in text.character_info(spark.createDataFrame([("é",), ("🙂",), ("①",), ("ab",), ("",)], "char string")).collect()}
    assert (rows["é"].code, rows["é"].category, rows["é"].name) == ("U+00E9", "Ll", "LATIN SMALL LETTER E WITH ACUTE")
    assert rows["🙂"].decimal == 128578 and rows["①"].nfkc == "1" and rows["①"].in_custom_mappings
    assert rows["ab"].error and rows["ab"].code is None and rows[""].error


def test_escape(spark):
    assert column(spark, ["<a & 'b' \"c\">"], text.escape_html) == ["&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"]


@pytest.mark.parametrize(("a", "b", "score"), [("abc", "bcd", 0.5), ("***", "---", 1.0), ("***", "a", 0.0), ("", "", 0.0), ("ABC", "cba", 1.0)])
def test_similarity(spark, a, b, score):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(similarity.text_similarity(F.col("a"), F.col("b"))).first()[0] == score


def test_css(spark):
    fmt = "struct<left_indent:double,right_indent:double,first_line_indent:double,space_before:double,space_after:double,line_spacing:double>"
    run = "struct<bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size:double,font_color:string,highlight_color:string>"
    rows = [("distribute", (12.0, None, 0.0, 6.0, 0.0, 1.5), (True, True, True, "Arial", 12.0, "#FF0000", "theme-x"), "color: red"), ("left", (None,) * 6, (None, False, None, "", 0.0, "theme-a", "#FFFF00"), None), (None, None, None, "a: b;")]
    frame = spark.createDataFrame(rows, f"a string, f {fmt}, r {run}, s string")
    got = frame.select(
        css.paragraph_css(F.col("a"), F.col("f")).alias("p"), css.add_css(F.col("s"), css.paragraph_css(F.col("a"), F.col("f"))).alias("d"), css.styled_run(F.lit("x"), F.col("r")).alias("run"), css.uniform_css(F.col("s"), F.col("r")).alias("u")
    ).collect()
    assert got[0].p == "text-align: justify; margin-left: 12.0pt; margin-top: 6.0pt; line-height: 1.5"
    assert got[0].d == f"color: red; {got[0].p}" and got[1].p is None and got[1].d is None and got[2].d == "a: b;"
    assert got[0].run == "<strong><em><span style=\"text-decoration: underline; font-family: 'Arial'; font-size: 12.0pt; color: #FF0000\">x</span></em></strong>"
    assert got[1].run == '<span style="background-color: #FFFF00">x</span>' and got[2].run == "x"
    assert got[0].u == "color: red; font-family: 'Arial'; font-size: 12.0pt; color: #FF0000; font-weight: bold; font-style: italic; text-decoration: underline"


def test_small_lookups(spark):
    row = spark.range(1).select(css.highlight_color(F.lit(7)).alias("h"), css.highlight_color(F.lit(99)).alias("n"), css.rgb_color(F.lit(255)).alias("c"), css.style_class(F.lit("Heading 1/É")).alias("k"), css.style_class(F.lit(None).cast("string")).alias("e"), css.alignment_name(F.lit("odd")).alias("a")).first()
    assert tuple(row) == ("#FFFF00", None, "#0000FF", "word-style-heading-1-é", "", "left")


def test_config():
    once = config.merged_config({"doc": {"allowed_styles": ["x", "color"]}, "none": {"allowed_styles": ["y"]}})
    assert once["doc"]["allowed_styles"][-1] == "x" and once["doc"]["allowed_styles"].count("color") == 1 and "none" not in once
    assert "x" not in config.default_config()["doc"]["allowed_styles"]
    assert config.config_from_request("{broken") == config.default_config() == config.config_from_request(None) == config.config_from_request('{"style_config": 3}')
    assert config.config_from_request('{"style_config": {"epub": {"allowed_classes": ["z"]}}}')["epub"]["allowed_classes"][-1] == "z"


def test_parse_config(spark):
    frame = spark.createDataFrame([('{"doc": {"allowed_styles": ["a"]}}',), ("{oops",), (None,)], "b string")
    got = [r.c for r in frame.select(config.parse_config(F.col("b")).alias("c")).collect()]
    assert got[0]["doc"].allowed_styles == ["a"] and not got[1] and not got[2]
