import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import scalar


def _sum(spark, rows, kind):
    df = spark.createDataFrame([(x,) for x in rows], T.StructType([T.StructField("x", kind)]))
    return df.agg(scalar.lenient_sum(F.col("x"), kind).alias("s")).first().s


def test_sum_rules(spark):
    assert _sum(spark, [1, None, 2], T.IntegerType()) == 3
    assert _sum(spark, [None, None], T.LongType()) is None
    assert _sum(spark, [], T.LongType()) is None
    assert _sum(spark, ["1.5", "x", None, " 2 "], T.StringType()) == 3.5
    assert _sum(spark, [0.5, None], T.DoubleType()) == 0.5


@pytest.mark.parametrize("rows", [[2**63 - 1, 1], [-(2**63), -1], [2**63 - 1, 2**63 - 1, 5, -7], [-(2**63)] * 3, [-1, -2, 3]])
def test_long_sums_wrap(spark, rows):
    want = (sum(rows) + 2**63) % 2**64 - 2**63
    assert _sum(spark, rows, T.LongType()) == want


def test_sum_refuses_booleans(spark):
    with pytest.raises(TypeError):
        scalar.lenient_sum(F.col("x"), T.BooleanType())


def test_divide_year_and_patterns(spark):
    row = spark.range(1).select(
        scalar.divide(F.lit(1), F.lit(0)).alias("z"),
        scalar.divide(F.lit(3), F.lit(2)).alias("q"),
        scalar.year_of(F.lit("1996-02-03")).alias("y"),
        scalar.year_of(F.lit("none")).alias("n"),
        scalar.matches(F.lit("anything"), "SM CASE||SM BOX").alias("e"),
        scalar.edit_distance(F.lit("kitten"), F.lit("sitting")).alias("d"),
    ).first()
    assert tuple(row) == (None, 1.5, 1996, None, True, 3)


def test_user_defined_aggregates(spark, monkeypatch):
    from quillon.functions import aggregates as A

    rows = [(k if k else None, v) for k in range(40) for v in (1.0, None, float(k))] + [(5, 2.0)] * 50
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    spread = A.Aggregate(init=lambda: None, iterate=lambda b, x: b if x is None else (x, x) if b is None else (min(b[0], x), max(b[1], x)), merge=lambda a, b: a if b is None else b if a is None else (min(a[0], b[0]), max(a[1], b[1])), terminate=lambda b: None if b is None else b[1] - b[0])
    want = {}
    for k, v in rows:
        if v is not None:
            lo, hi = want.get(k, (v, v))
            want[k] = (min(lo, v), max(hi, v))
    for held in (A.HELD, 3):
        monkeypatch.setattr(A, "HELD", held)
        got = {r.k: r.s for r in A.aggregate(df, ["k"], ["v"], spread, "s").collect()}
        assert got == {k: hi - lo for k, (lo, hi) in want.items()}
    assert A.aggregate(df.limit(0), ["k"], ["v"], spread, "s").count() == 0
    none = A.aggregate(df.where("v is null"), ["k"], ["v"], spread, "s").where("k = 3").first()
    assert none.s is None
