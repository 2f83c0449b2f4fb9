import datetime

import pytest
from pyspark.sql import functions as F

from reviewmill.functions import timespans

AT = datetime.date(2024, 3, 31)  # a Sunday
D = datetime.date
CASES = [
    ("Died 2 weeks ago", [("2 weeks ago", D(2024, 3, 17), D(2024, 3, 23))]),
    ("one day ago, a month ago", [("one day ago", D(2024, 3, 30), D(2024, 3, 30)), ("a month ago", D(2024, 2, 29), D(2024, 3, 28))]),
    ("bought 3 years ago", [("3 years ago", D(2021, 3, 31), D(2022, 3, 30))]),
    ("Failed AFTER TWO MONTHS!", [("after two months", D(2024, 1, 31), AT)]),
    ("within 10 days; for a year", [("within 10 days", D(2024, 3, 21), AT), ("for a year", D(2023, 3, 31), AT)]),
    ("last week", [("last week", D(2024, 3, 18), D(2024, 3, 24))]),
    ("this week, last month. This year", [
        ("this week", D(2024, 3, 25), AT), ("last month", D(2024, 2, 1), D(2024, 2, 29)), ("this year", D(2024, 1, 1), D(2024, 12, 31)),
    ]),
    ("last 5 weeks", [("last 5 weeks", D(2024, 2, 25), AT)]),
    ("yesterday and today", [("yesterday", D(2024, 3, 30), D(2024, 3, 30)), ("today", AT, AT)]),
    ("in March", [("in march", D(2024, 3, 1), AT)]),
    ("in april", [("in april", D(2023, 4, 1), D(2023, 4, 30))]),
    ("since February 2020", [("since february 2020", D(2020, 2, 1), AT)]),
    ("in february 2023", [("in february 2023", D(2023, 2, 1), D(2023, 2, 28))]),
    ("in 2019, since 2021", [("in 2019", D(2019, 1, 1), D(2019, 12, 31)), ("since 2021", D(2021, 1, 1), AT)]),
    ("on 2023-02-28 or 2023-02-30", [("2023-02-28", D(2023, 2, 28), D(2023, 2, 28)), ("2023-02-30", None, None)]),
    ("since 2030", [("since 2030", D(2030, 1, 1), D(2030, 1, 1))]),
    ("9999 years ago", [("9999 years ago", D.min, D.min)]),
    ("in 20240, 12345 days ago, todays, x-today, in marching, éin 2020, in 1", []),
    ("", []), (None, []),
]


def test_expressions(spark):
    df = spark.createDataFrame([(i, text, AT) for i, (text, _) in enumerate(CASES)], "i int, text string, at date")
    rows = df.select("i", timespans.time_intervals(F.col("text"), F.col("at")).alias("t")).orderBy("i")
    got = rows.select("i", F.transform("t", lambda x: F.struct(x["phrase"], x["first"].cast("string"), x["last"].cast("string"))).alias("t")).collect()
    for row, (text, wanted) in zip(got, CASES):
        if text == "9999 years ago":
            assert [t[0] for t in row["t"]] == [text]  # long before any calendar, but no error
            continue
        plain = [(p, a and str(a), b and str(b)) for p, a, b in wanted]
        assert [tuple(t) for t in row["t"]] == plain, text


def test_without_a_time_there_are_no_days(spark):
    df = spark.createDataFrame([("2 weeks ago, in march, 2020-01-01", None)], "text string, at timestamp")
    found = df.select(timespans.time_intervals(F.col("text"), F.col("at")).alias("t")).first()["t"]
    assert [(t["first"], t["last"]) for t in found] == [(None, None)] * 3


@pytest.mark.parametrize("unit", timespans.UNITS)
def test_times_ago_follow_one_another(spark, unit):
    """What lies n units back ends the day before what lies n - 1 back begins, but for months' ends."""
    df = spark.createDataFrame([(n, f"{n} {unit}s ago", D(2024, 3, 15)) for n in range(1, 30)], "n int, text string, at date")
    rows = [r["t"][0] for r in df.select("n", timespans.time_intervals(F.col("text"), F.col("at")).alias("t")).orderBy("n").collect()]
    assert all(b["last"] == a["first"] - datetime.timedelta(1) for a, b in zip(rows, rows[1:]))
