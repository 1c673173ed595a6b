"""Repeated rows are found by hash first."""

from transferlens.operators.profiling import duplicate_rows


def test_only_rows_with_a_repeated_hash_are_compared(spark):
    nan, schema = float("nan"), "a string, b string, v double"
    rows = [(None, "x", 1.0), ("x", None, 1.0), ("x", None, 1.0), ("y", "y", nan), ("y", "y", nan), ("z", "z", 0.0), ("z", "z", -0.0), ("z", "z", 1.0)]
    df = spark.createDataFrame(rows, schema)
    found = duplicate_rows(df)
    assert found.first()[0] == 3 and duplicate_rows(df, ["a"]).first()[0] == 4
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
