import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from corpuskit.functions.html import html_to_text
from corpuskit.operators.html import html_to_text_parser, parse_text
from corpuskit.sources.tables import table

CASES = [
    ("<h1>Merge sort</h1>", "Merge sort"),
    ("<li>keep <i>both</i> runs</li>", "keep both runs"),
    (None, ""),
    ("", ""),
    # hand-worked cases
    ("foo<b>bar</b>", "foo bar"),
    ("a &lt;p&gt; b", "a <p> b"),
    ("x<!-- c -->y", "x y"),
    ("<pre>l1\nl2</pre>", "l1\nl2"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ('<script>var t="</p>";</script>ok', "ok"),
    ("<!DOCTYPE html><html><head><style>p{x:1}</style><title>T</title></head><body>B</body></html>", "T B"),
    ("&amp;lt; &copy &#233; &#x3c;b&#62;", "&lt; © é <b>"),
    ("<p> a &nbsp;</p><p>&#32;b</p>", "a b"),
    ("<p>\t\n</p><p>x</p>", "x"),
    ("a\ue001b \ue000 \x01c", "a\ue001b \ue000 \x01c"),
    ("<a title='x>y'>k</a> <b data=\"1>2\">m</b>", "k m"),
    ("a &lt;script&gt; b<p title=\"it's\">c</p>", "a <script> b c"),
    ("<template><p>t</p></template>a<ruby>漢<rt>kan</rt></ruby>", "a 漢"),
    ("&unknown; &am &ampx", "&unknown; &am &x"),
    ("&notin; &notit; &alpha; &nvlt;b", "\u2209 \u00acit; \u03b1 <\u20d2b"),
    ("&#150;&#0;&#x110000;&#00000000065;&#1;x&#xD800;", "\u2013\ufffd\ufffdAx\ufffd"),
]


@pytest.mark.parametrize("html,expected", CASES)
def test_native_cleaning(spark, html, expected):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text(F.col("h")).alias("t")).first().t == expected


@pytest.mark.parametrize("html,expected", CASES)
def test_parser_cleaning(html, expected):
    assert parse_text(html) == expected


def test_native_equals_parser_on_pages(spark):
    pages = table(spark, SF_MID, "pages")
    res = pages.select(html_to_text(F.col("html")).alias("n"), html_to_text_parser(F.col("html")).alias("p"))
    assert res.filter(F.col("n") != F.col("p")).count() == 0
    assert res.count() == pages.count()


def test_cleaning_is_one_codegen_project(spark):
    df = table(spark, SF_MID, "pages").select(html_to_text(F.col("html")).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_many_distinct_references_decode_in_one_pass(spark):
    # a page written entirely as numeric references (thousands of distinct ones)
    text = "".join(f"&#{cp};" for cp in range(0x4E00, 0x4E00 + 5000))
    html = f"<p>{text}</p><p>&#x4E00;&amp;lt;</p>"
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(html_to_text(F.col("h")).alias("t")).first().t
    assert got == parse_text(html)
    assert len(got) == 5000 + 1 + 1 + 4


def test_script_without_end_runs_to_the_end(spark):
    df = spark.createDataFrame([("a<script>var x = 1; <b>no</b>",), ("a<style>p{}",), ("<p don't>kept</p> it's",)], "h string")
    assert [r.t for r in df.select(html_to_text(F.col("h")).alias("t")).collect()] == ["a", "a", "kept it's"]


def test_parser_ends_annotations_with_their_ruby():
    assert parse_text("<ruby>A<rt>x</ruby> tail") == "A tail"
