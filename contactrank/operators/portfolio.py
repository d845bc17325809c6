"""Dashboard aggregates over portfolio tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUNNEL = ("Initial Review", "Due Diligence", "Term Sheet", "Closing")


def valuation_trend(valuations: DataFrame, funds: list[str] | None = None) -> DataFrame:
    """Value by month and fund."""
    rows = valuations.where(F.col("fund").isin(funds)) if funds else valuations
    return rows.groupBy(F.trunc("as_of", "month").alias("month"), "fund").agg(F.sum("value").alias("value"))


def aum_yoy(valuations: DataFrame) -> DataFrame:
    """Total by year and its change from the year before, in percent."""
    total = valuations.groupBy(F.year("as_of").alias("year")).agg(F.sum("value").alias("total"))
    before = F.lag("total").over(Window.orderBy("year"))  # one row per year
    return total.withColumn("change_pct", 100 * (F.col("total") - before) / before)


def active_portfolio(companies: DataFrame) -> DataFrame:
    """D3: active companies and their sectors."""
    return companies.where("active").agg(F.count_distinct("company_id").alias("companies"), F.count_distinct("sector").alias("sectors"))


def fund_deployment(commitments: DataFrame, calls: DataFrame) -> DataFrame:
    """Deployed percent and dry powder of each fund; both sides are summed before the join."""
    committed = commitments.groupBy("fund").agg(F.sum("committed").alias("committed"))
    called = calls.groupBy("fund").agg(F.sum("amount").alias("called"))
    called_or_none = F.coalesce("called", F.lit(0.0))
    return committed.join(called, "fund", "left").select("fund", "committed", called_or_none.alias("called"), (100 * called_or_none / F.col("committed")).alias("deployed_pct"), (F.col("committed") - called_or_none).alias("dry_powder"))


def deal_funnel(deals: DataFrame, stages: tuple[str, ...] = FUNNEL) -> DataFrame:
    """Deals by stage, in the order given, with the percent of the first stage, rounded up."""
    counts = deals.where(F.col("stage").isin(list(stages))).groupBy("stage").agg(F.count("*").alias("n"))
    order = deals.sparkSession.createDataFrame(list(enumerate(stages)), "position int, stage string")
    rows = order.join(counts, "stage", "left").select("position", "stage", F.coalesce("n", F.lit(0)).alias("n"))
    first = F.max(F.when(F.col("position") == 0, F.col("n"))).over(Window.partitionBy())  # a row per stage
    return rows.withColumn("pct", F.ceil(100 * F.col("n") / first).cast("long"))


def recent_calls(calls: DataFrame, n: int = 3) -> DataFrame:
    """The latest capital calls."""
    return calls.orderBy(F.desc("call_date"), "call_id").limit(n)


def upcoming_meetings(meetings: DataFrame, as_of: Column, n: int = 3) -> DataFrame:
    """The next meetings from a given time on."""
    return meetings.where(F.col("start_ts") >= as_of).orderBy("start_ts", "meeting_id").limit(n)
