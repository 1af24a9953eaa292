"""Scoring expressions on literal rows."""

from pyspark.sql import functions as F

from lodeworks.functions import scoring as S


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame(rows, "i int, x double").orderBy("i").select(column).collect()]


def test_decay_credit(spark):
    rows = [(0, 50.0), (1, 150.0), (2, 250.0), (3, 400.0), (4, 0.0)]
    assert values(spark, S.decay_credit(F.col("x"), 50), rows) == [1.0, 0.5, 0.0, 0.0, 1.0]


def test_severity_and_grade(spark):
    rows = [(0, 300.0), (1, 150.0), (2, 100.0)]
    assert values(spark, S.issue_severity(F.col("x"), F.lit(100.0)), rows) == ["error", "warning", "info"]
    assert values(spark, S.issue_severity(F.col("x"), F.lit(0.0)), rows) == ["warning"] * 3
    assert values(spark, S.grade(F.col("x")), [(0, 90.0), (1, 89.0), (2, 50.0), (3, 49.0)]) == ["A+", "A", "D", "F"]


def test_names(spark):
    df = spark.createDataFrame([("PDFLoader",), ("GL11Version",), ("MarshalJSON",)], "s string")
    assert [r[0] for r in df.select(S.camel_words(F.col("s"))).collect()] == [["PDF", "Loader"], ["GL", "11", "Version"], ["Marshal", "JSON"]]
    assert [r[0] for r in df.limit(1).select(S.suffix_of(F.lit("store_repo_linux"))).collect()] == ["_repo"]


def test_arrays(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    empty = F.array().cast("array<int>")
    got = one.select(S.jaccard(empty, empty), S.jaccard(arr(1, 2), arr(2, 3)), S.entropy_ratio(arr(2.0, 2.0)), S.lower_rank(arr(5, 1, 3, 2, 4))).first()
    assert got[0] == 1.0 and abs(got[1] - 1 / 3) < 1e-12 and abs(got[2] - 0.5) < 1e-12 and got[3] == 4
