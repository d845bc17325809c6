"""Contacts from cells: field resolution by alias, snapshots per owner, load statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactrank.functions.schema import ALIASES
from contactrank.functions.text import js_trim, normalize_key
from contactrank.operators import snapshots


def get_field(cells: Column, field: str) -> Column:
    """The value of the first cell whose key is an alias, even if it is empty; '' if there is none."""
    found = F.filter(cells, lambda c: normalize_key(c["key"]).isin(ALIASES[field]))
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def first_last(cells: Column) -> Column:
    return js_trim(F.concat(get_field(cells, "first"), F.lit(" "), get_field(cells, "last")))


def full_name(cells: Column) -> Column:
    """The full name, or first and last name."""
    full = get_field(cells, "full")
    return F.when(full != "", full).otherwise(first_last(cells))


def resolve_fields(rows: DataFrame, owner_id: Column) -> DataFrame:
    """Contacts of (source_file, row_ord, cells) rows; absent fields are ''."""
    cells = F.col("cells")
    fields = [get_field(cells, f).alias(f) for f in ("position", "company", "email", "url", "connected_on")]
    everything = F.array_join(F.transform(cells, lambda c: F.coalesce(c["value"], F.lit(""))), " ").alias("all_text")
    return rows.select(owner_id.cast("string").alias("owner_id"), "source_file", "row_ord", full_name(cells).alias("full_name"), *fields, everything)


def confirm_snapshot(staged: DataFrame, path: str) -> bool:
    """Replaces the confirmed contacts of the owners in `staged`; does nothing if it is empty."""
    return snapshots.confirm(staged, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Confirmed contacts, with the lower-cased columns that searches use."""
    return snapshots.read(spark, path)


def revoke_snapshot(spark: SparkSession, path: str, owners: list[str]) -> None:
    """A new upload withdraws its owner's confirmation."""
    snapshots.revoke(spark, path, owners)


def stage_upload(spark: SparkSession, parsed: DataFrame, owner: str, path: str) -> DataFrame:
    """The contacts of an owner's new upload. Good or bad, it withdraws what the owner had confirmed before."""
    from contactrank.sources.exports import raw_rows

    revoke_snapshot(spark, path, [owner])
    return resolve_fields(raw_rows(parsed), F.lit(owner))


def load_stats(staged: DataFrame, confirmed: Column, sample_rows: int) -> DataFrame:
    """A1: per file the staged rows, confirmed rows and columns in the first rows, in one pass over parsed rows (source_file, row_ord, cells)."""
    keys = F.collect_set(F.when(F.col("row_ord") < sample_rows, F.col("cells.key")))  # different key lists of sample_rows rows at most
    counts = [F.count("*").alias("staged_rows"), F.count_if(confirmed).alias("confirmed_rows")]
    return staged.groupBy("source_file").agg(*counts, F.size(F.array_distinct(F.flatten(keys))).cast("long").alias("column_count"))
