"""D1-D7 and the registered queries."""

import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from contactrank.operators import portfolio as D


def test_funnel(spark):
    deals = spark.createDataFrame([(s,) for s, n in zip(D.FUNNEL, (124, 18, 4, 2), strict=True) for _ in range(n)] + [("Other",)], "stage string")
    assert [(r.n, r.pct) for r in D.deal_funnel(deals).orderBy("position").collect()] == [(124, 100), (18, 15), (4, 4), (2, 2)]


def test_totals(spark):
    d = datetime.date
    v = spark.createDataFrame([("I", d(2023, 1, 3), 100.0), ("I", d(2023, 1, 9), 20.0), ("II", d(2024, 2, 1), 150.0)], "fund string, as_of date, value double")
    assert {(str(r.month), r.fund): r.value for r in D.valuation_trend(v).collect()} == {("2023-01-01", "I"): 120.0, ("2024-02-01", "II"): 150.0}
    assert [r.fund for r in D.valuation_trend(v, ["II"]).collect()] == ["II"]
    assert [r.change_pct for r in D.aum_yoy(v).orderBy("year").collect()] == [None, 25.0]
    committed = spark.createDataFrame([("I", 60.0), ("I", 40.0), ("II", 5.0)], "fund string, committed double")
    called = spark.createDataFrame([("I", 80.0), ("I", 4.0)], "fund string, amount double")
    got = {r.fund: (r.deployed_pct, r.dry_powder) for r in D.fund_deployment(committed, called).collect()}
    assert got == {"I": (84.0, 16.0), "II": (0.0, 5.0)}
    assert tuple(D.active_portfolio(spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False)], "company_id long, sector string, active boolean")).first()) == (2, 1)


def test_latest_and_next(spark):
    t = datetime.datetime
    calls = spark.createDataFrame([(i, datetime.date(2024, 1, 1 + i % 3)) for i in range(9)], "call_id long, call_date date")
    assert [r.call_id for r in D.recent_calls(calls).collect()] == [2, 5, 8]
    meetings = spark.createDataFrame([(1, t(2024, 1, 2)), (2, t(2024, 1, 1)), (3, t(2023, 1, 1))], "meeting_id long, start_ts timestamp_ntz")
    assert [r.meeting_id for r in D.upcoming_meetings(meetings, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()] == [2, 1]


def test_every_query_has_sql_or_a_reason():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names
    assert all(n.startswith("op") or n == "pipeline" for n in names - sql)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
