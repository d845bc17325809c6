"""S5 for folders of any files: each goes to the parser that its name and size ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactrank.sources import csv_ranges, exports
from contactrank.sources.clean_json import parse_json

#: CSV files above this size are parsed in ranges; it is the most that a task then holds of a file's text.
WHOLE_BYTES = 32 << 20


def _named(*suffixes: str) -> Column:
    name = F.lower("_metadata.file_path")
    return F.coalesce(*(F.when(name.endswith(s), F.lit(True)) for s in suffixes), F.lit(False))


def parse_folder(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES, range_bytes: int | None = None) -> DataFrame:
    """Rows and a status row of every file below a path, as `exports.parse_exports` gives them.

    CSV files of up to `whole_bytes` and JSON files are read whole, larger CSV files in ranges of `range_bytes` (the
    session's size of a read partition, if None). Files of other types are not read at all. An empty folder gives no rows.
    """
    large = _named(".csv") & (F.col("_metadata.file_size") > whole_bytes)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = exports.parse_exports(exports.read_files(spark, path, _named(".csv") & ~large))
    other = listed.where(~_named(".csv", ".json")).select(F.col("_metadata.file_path").alias("source_file"))
    other = other.select("source_file", F.lit("").alias("file_type"), F.lit(exports.NOT_SUPPORTED).alias("error"), F.lit(0).cast("long").alias("row_count"))
    out = small.unionByName(parse_json(exports.read_files(spark, path, _named(".json")))).unionByName(other, allowMissingColumns=True)
    big = listed.where(large).select(F.col("_metadata.file_path").alias("source_file"))
    if big.isEmpty():
        return out
    with csv_ranges.ranges_of(spark, range_bytes):
        rows = csv_ranges.parse_csv_ranges(csv_ranges.read_lines(spark, path, large))
    counts = rows.groupBy("source_file").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    status = big.join(counts, "source_file", "left").select("source_file", F.lit("csv").alias("file_type"), F.when(n == 0, exports.NO_ROWS).alias("error"), n.alias("row_count"))
    return out.unionByName(rows, allowMissingColumns=True).unionByName(status, allowMissingColumns=True)
