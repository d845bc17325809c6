"""Preview pages of staged contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactrank.functions.schema import DEFAULT_PAGE_SIZE


def page_stats(contacts: DataFrame, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A3: rows and pages of each file; at least one page."""
    rows = contacts.groupBy("source_file").agg(F.count("*").alias("row_count"))
    return rows.withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("row_count") / size)).cast("long"))


def preview(contacts: DataFrame) -> DataFrame:
    """Shown columns; an empty one is a dash, an empty name says so."""
    dash = lambda c: F.when(F.col(c) == "", "—").otherwise(F.col(c)).alias(c)
    return contacts.select("source_file", "row_ord", F.when(F.col("full_name") == "", "(no name)").otherwise(F.col("full_name")).alias("name"), *map(dash, ("position", "company", "connected_on", "email", "url")))


def preview_page(contacts: DataFrame, page: int, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of every file, by a range of row_ord. Pages past a file's last one show the last one."""
    last = page_stats(contacts, size).select("source_file", F.least(F.lit(max(page, 0)), F.col("page_count") - 1).alias("_page"))
    rows = contacts.join(last, "source_file").where((F.col("row_ord") >= F.col("_page") * size) & (F.col("row_ord") < (F.col("_page") + 1) * size))
    return preview(rows)
