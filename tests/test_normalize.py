from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckscope.operators.normalize import normalize_results, safe_float, safe_int


def test_safe_float_and_int(spark):
    vals = [None, "7.5/10", "$1,234.5", "1..2", "-", "", "abc", "-3.7", "3 words"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(safe_float(F.col("v"), T.StringType()).alias("f"), safe_int(F.col("v"), T.StringType()).alias("i")).collect()
    assert [r["f"] for r in rows] == [0.0, 7.51, 1234.5, 0.0, 0.0, 0.0, 0.0, -3.7, 3.0]
    assert [r["i"] for r in rows] == [0, 7, 1234, 0, 0, 0, 0, -3, 3]


def test_normalize_results_touches_existing_columns_only(spark):
    df = spark.createDataFrame([("a", None, "5.5", None)], "deck_name string, category string, composite_score string, summary string")
    r = normalize_results(df).collect()[0]
    assert r["category"] == "" and r["composite_score"] == 5.5 and r["summary"] == ""
    assert "word_count" not in normalize_results(df).columns
