"""Tokens of single strings, stated by hand and not from the tables that the engine and the SQL share."""

import pytest
from pyspark.sql import functions as F

from polylogue.functions.tokenize import tokenize

BY_HAND = {
    "13a": [
        ("Hello, world!", "Hello|,|world|!"), ("It's 3.14, not 2,718.", "It's|3.14|,|not|2,718|."), ("a-b 10-20 x", "a-b|10|-|20|x"),
        ("&quot;x&quot; &amp;amp; &lt;b&gt;", '"|x|"|&|amp|;|<|b|>'), ("e.g. U.S.A.", "e|.|g|.|U|.|S|.|A|."), ("1,000.50", "1,000.50"),
        ("a/b (c) [d] {e}", "a|/|b|(|c|)|[|d|]|{|e|}"), ("x:y;z", "x|:|y|;|z"), ("50% $5 a_b", "50|%|$|5|a|_|b"), ("5. .5", "5|.|.|5"),
        ("one<skipped>two", "onetwo"), ("", ""), ("  two   words ", "two|words"), ("é!ü", "é|!|ü"), ("a=b+c*d", "a|=|b|+|c|*|d"), ("~x^y`", "~|x|^|y|`"),
    ],
    "intl": [
        ("Hello, world!", "Hello|,|world|!"), ("3.14 and 2,718", "3.14|and|2,718"), ("it's", "it|'|s"), ("«oui»", "«|oui|»"), ("5€ a€b", "5|€|a|€|b"),
        ("a–b", "a|–|b"), ("¿qué?", "¿|qué|?"), ("a+b", "a|+|b"), ("x_y", "x|_|y"), ("", ""),
    ],
    "char": [("ab c", "a|b|c"), ("é 你", "é|你"), ("", ""), (" \t", "")],
    "zh": [("你好, world", "你|好|,|world"), ("第3.5章", "第|3.5|章"), ("a、b", "a|、|b"), ("ＡＢ", "Ａ|Ｂ"), ("no cjk.", "no|cjk|.")],
    "none": [("a, b.", "a,|b."), (" x  y ", "x|y")],
}


@pytest.mark.parametrize("method", sorted(BY_HAND))
def test_tokens_by_hand(spark, method):
    rows = [(i, text) for i, (text, _) in enumerate(BY_HAND[method])]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, text string").select("i", tokenize(F.col("text"), method).alias("t")).collect()}
    for i, (text, want) in enumerate(BY_HAND[method]):
        assert got[i] == (want.split("|") if want else []), (method, text)


def test_lower_case_by_hand(spark):
    df = spark.createDataFrame([("Hello, WORLD! É",)], "text string")
    assert df.select(tokenize(F.col("text"), "13a", True).alias("t")).first()["t"] == ["hello", ",", "world", "!", "é"]
