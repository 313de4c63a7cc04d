"""The normal distribution as columns against the standard library."""

from math import erfc, inf, isnan, nan, sqrt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from foliospark.functions.normal import normal_cdf, normal_ppf


def values(spark, xs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    return [r.y for r in df.withColumn("y", f("x")).orderBy("i").collect()]


def test_cdf(spark):
    xs = [i / 100 for i in range(-4000, 4001)] + [1e-300, -1e-9, 0.0, 0.662912, 0.66292, 5.6568, 5.657, 37.5, -37.5, -38.4]
    for x, y in zip(xs, values(spark, xs, normal_cdf)):
        want = 0.5 * erfc(-x / sqrt(2))
        assert y == pytest.approx(want, rel=2e-14, abs=1e-305), x
    assert values(spark, [None, inf, -inf], normal_cdf) == [None, 1.0, 0.0]
    assert isnan(values(spark, [nan], normal_cdf)[0])


def test_ppf(spark):
    qs = [i / 5000 for i in range(1, 5000)] + [10.0**-k for k in range(2, 300, 7)] + [1 - 10.0**-k for k in range(2, 16)] + [0.075, 0.925, 0.0749999, 0.9250001]
    for q, y in zip(qs, values(spark, qs, normal_ppf)):
        assert y == pytest.approx(NormalDist().inv_cdf(q), rel=2e-14, abs=1e-15), q
    assert values(spark, [None, 0.0, 1.0, -0.1, 1.1], normal_ppf) == [None] * 5


def test_inverse_of_each_other(spark):
    df = spark.range(1, 1000).select((F.col("id") / 1000).alias("q")).withColumn("z", normal_ppf("q")).withColumn("back", normal_cdf("z"))
    assert df.agg(F.max(F.abs(F.col("back") - F.col("q")))).first()[0] < 1e-15


def test_no_python_worker_in_the_plan(spark):
    plan = spark.range(3).select(F.col("id").cast("double").alias("x")).select(normal_cdf("x"), normal_ppf("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
