"""D1-D3 kept up to date: partial states per month and load, merged when they are read.

    <path>/month=<first day>/load=<name>/...

A load of new rows writes one small state for each of its months and touches nothing else; a load that comes again under
its name replaces its own states, so nothing counts twice. Late rows of an old month are one more state of that month.
Sums merge by addition. Distinct counts don't: their states hold the distinct members themselves, which are exact over
any months, and beside them a sketch, which is enough where two percent are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactrank.operators import portfolio

_STATE = "month date, load string"
_SUMS = f"fund string, value double, n long, {_STATE}"
_MEMBERS = f"company_id string, sector string, {_STATE}"
_SKETCHES = f"companies long, sketch binary, {_STATE}"


def _write(states: DataFrame, path: str, load: str) -> None:
    """Replaces the load's states of the months that it has."""
    by = ["month", "load"]
    states.withColumn("load", F.lit(load)).repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _month(at: str) -> Column:
    return F.trunc(at, "month").alias("month")


# sums


def load_valuations(rows: DataFrame, path: str, load: str) -> None:
    """Adds valuations (fund, as_of, value); rows without a date have no month and are left out, as in D1's months."""
    states = rows.where("as_of is not null").groupBy(_month("as_of"), "fund").agg(F.sum("value").alias("value"), F.count("value").alias("n"))
    _write(states, path, load)


def valuation_trend(spark: SparkSession, path: str) -> DataFrame:
    """D1 from the states."""
    return _read(spark, path, _SUMS).groupBy("month", "fund").agg(F.sum("value").alias("value"))


def aum_yoy(spark: SparkSession, path: str) -> DataFrame:
    """D2 from the states."""
    return portfolio.aum_yoy(_read(spark, path, _SUMS).select(F.col("month").alias("as_of"), "value"))


# distinct members


def load_activity(rows: DataFrame, path: str, load: str) -> None:
    """Adds the companies (company_id, sector) that were active at `as_of`, each once a month; their sketches go to `<path>-sketches`."""
    active = rows.where("active and as_of is not null and company_id is not null").select(_month("as_of"), F.col("company_id").cast("string").alias("company_id"), "sector").distinct()
    _write(active, path, load)
    own = _read(rows.sparkSession, path, _MEMBERS).where(F.col("load") == load)
    _write(own.groupBy("month").agg(F.count_distinct("company_id").alias("companies"), F.hll_sketch_agg("company_id", F.lit(14)).alias("sketch")), f"{path}-sketches", load)


def active_portfolio(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """D3 from the states, exact: companies and sectors active in the months from `since` to `until`."""
    rows = _between(_read(spark, path, _MEMBERS), since, until)
    return rows.agg(F.count_distinct("company_id").alias("companies"), F.count_distinct("sector").alias("sectors"))


def active_by_month(spark: SparkSession, path: str) -> DataFrame:
    """month, companies (exact), companies_so_far (exact: since the first month) and approx_so_far (from sketches alone)."""
    members = _read(spark, path, _MEMBERS)
    each = members.groupBy("month").agg(F.count_distinct("company_id").alias("companies"))
    new = members.groupBy("company_id").agg(F.min("month").alias("month")).groupBy("month").agg(F.count("*").alias("new"))
    upto = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row per month
    sketches = _read(spark, f"{path}-sketches", _SKETCHES).groupBy("month").agg(F.hll_union_agg("sketch").alias("sketch"))
    rows = each.join(new, "month", "left").join(sketches, "month", "left")
    so_far = F.sum(F.coalesce("new", F.lit(0))).over(upto)
    return rows.select("month", "companies", so_far.alias("companies_so_far"), F.hll_sketch_estimate(F.hll_union_agg("sketch").over(upto)).alias("approx_so_far"))


def _between(rows: DataFrame, since: str | None, until: str | None) -> DataFrame:
    rows = rows if since is None else rows.where(F.col("month") >= F.lit(since).cast("date"))
    return rows if until is None else rows.where(F.col("month") <= F.lit(until).cast("date"))
