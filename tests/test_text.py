import unicodedata

from pyspark.sql import functions as F

from fidelis.functions import exact
from fidelis.functions import text as tx


def values(spark, expression, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_numerals(spark):
    rows = ["三百二十", "十五", "一百零三", "两千五百", "三万六千", "十", "3", "", "二亿"]
    assert values(spark, tx.zh_number, rows) == [320, 15, 103, 2500, 36000, 10, None, None, 200000000]
    assert [exact.zh_value(r) for r in rows] == values(spark, tx.zh_number, rows)


def test_numbers_are_exact_and_plain(spark):
    rows = ["2,864,000", "２８６.４", "0.50", "-0.02", "007", "x", "100", "-0.0", ".5", "1.1234567890123", "99,999,999,999,999,999,999,999,999,999.5", "", "1.2.3", None]
    want = ["2864000", "286.4", "0.5", "-0.02", "7", None, "100", "0", "0.5", "1.1234567890123", "99999999999999999999999999999.5", None, None, None]
    assert values(spark, tx.number, rows) == want
    assert values(spark, lambda c: tx.number(c, 2), ["0.05", "3", "1.2345", "0.001"]) == ["5", "300", "123.45", "0.1"]
    assert values(spark, lambda c: tx.number(c, -2), ["5", "1", "0.5", "1234"]) == ["0.05", "0.01", "0.005", "12.34"]
    for places in (-2, 0, 4):
        assert [exact.moved(r, places) for r, w in zip(rows, want, strict=True) if w] == [x for x in values(spark, lambda c, p=places: tx.number(c, p), rows) if x]


def test_documents(spark):
    rows = ["a  \r\nb\r\n\r\n\r\n\r\nc\n\n", "", "\n\nx", "é"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(9, None)], "i int, x string")
    got = [r[0] for r in tx.nfc(df, "x").orderBy("i").select(tx.normalized(F.col("x"))).collect()]
    assert got == ["a\nb\n\nc\n", "", "x\n", unicodedata.normalize("NFC", "é") + "\n", None]


def test_sentences_keep_every_character(spark):
    rows = ["一。二！Three. Four 3.5 x.y\nfive", "", " \n"]
    pieces = values(spark, lambda c: tx.prose_sentences(c), rows)
    assert pieces[0] == ["一。", "二！", "Three.", " Four 3.5 x.y\n", "five"] and pieces[1] == [] and pieces[2] == []
    assert values(spark, lambda c: F.array_join(tx.sentences(c), ""), rows) == rows


def test_language_and_counts(spark):
    assert values(spark, tx.language, ["数字化 text", "all english text 数", ""]) == ["zh", "en", "en"]
    assert values(spark, lambda c: tx.occurrences(c, F.lit("aa")), ["aaaa b aa", "", "x"]) == [3, 0, 0]
