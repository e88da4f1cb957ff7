import datetime as dt

from pyspark.sql import functions as F

from probelake.operators import gates


def test_missing_days_of_keys(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 3)), ("b", dt.date(2024, 1, 2)), ("b", dt.date(2024, 1, 2))], "k string, day date")
    got = gates.missing_days(rows, "day", F.lit("2024-01-01"), F.lit("2024-01-03"), ["k"]).collect()
    assert sorted((r.k, r.day.day) for r in got) == [("a", 2), ("b", 1), ("b", 3)]
    assert gates.missing_days(rows, "day", F.lit("2024-01-01"), F.lit("2024-01-03")).count() == 0
