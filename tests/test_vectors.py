"""Vector columns cost what their length says."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions import vectors


def test_a_length_is_computed_once_per_vector(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [2.0]), (3, []), (4, None), (5, [None, 2.0])], "i int, v array<float>")
    unit = df.select("i", vectors.l2_normalize(F.col("v")).alias("u"))
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    found = {r.i: r.u for r in unit.collect()}
    assert found == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: [1.0], 3: [], 4: None, 5: [None, 2.0]}
