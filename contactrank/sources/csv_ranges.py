"""S1-S3 for CSV files of any size: ranges of a file are parsed apart, whatever its quotes do.

Whether a place of a file is inside quotes follows from the number of quotes before it alone: each one, doubled or not,
turns the state over. So what a range does to either state it may start in is one bit, its number of quotes modulo 2.

1. Spark splits a file into ranges of physical lines. A native aggregate gives each range's bit; a running sum over the
   ranges of a file, a row each, gives the state that each really starts in. A task reads as many ranges as make
   TASK_BYTES, so small ranges are no small tasks.
2. Every range is read again and cut, in its task, into rows that begin and end in it. What it holds of rows that cross
   its ends leaves as fragments: one at its start, one at its end, or all of it.
3. Fragments of one row are joined and parsed like any row. Their number is that of the ranges at most.
4. Rows of the ranges before a row, counted from the parsed rows, make its place in the file. The header is the first
   row with a first and a last name column, else the first one; its columns are laid out once per file, and every other
   row becomes cells by native expressions.

No task holds more of a file than a row, a batch of lines, or what a quote that is never closed makes of its rest, which
is one cell by the rules of the format. A range of a file whose only line breaks are single carriage returns is one
line, so such a file is one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactrank.functions.tables import MAX_BROADCAST_BYTES, checkpoint
from contactrank.sources import exports as S

_CUT = "source_file string, at long, place long, cells array<string>, named boolean, fragment string, opens boolean"
_BATCH = 5_000
#: Bytes of ranges that one task reads, one range after the other.
TASK_BYTES = 16 << 20
_RANGE = ["source_file", "at"]


@contextmanager
def ranges_of(spark: SparkSession, n_bytes: int | None) -> Iterator[None]:
    """Ranges of so many bytes while the files are read; the session's own size, if None. Either way not by the number of cores, which may change between two reads."""
    wanted = {"spark.sql.files.minPartitionNum": "1"} | ({"spark.sql.files.maxPartitionBytes": str(n_bytes)} if n_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_lines(spark: SparkSession, path: str, which: Column | None = None) -> DataFrame:
    """source_file, at (where its range begins) and line, in the files' order within a range; which: a condition on `_metadata`."""
    rows = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    rows = rows if which is None else rows.where(which)
    return rows.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at"), F.make_valid_utf8("value").alias("line"))


def in_tasks(lines: DataFrame) -> DataFrame:
    """Ranges one after the other in tasks of TASK_BYTES, or as many tasks as there are cores; the ranges stay what they are."""
    spark = lines.sparkSession
    n = lines.rdd.getNumPartitions()
    range_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return lines.coalesce(max(1, min(n, max(-(-n * range_bytes // TASK_BYTES), spark.sparkContext.defaultParallelism))))


def start_states(lines: DataFrame) -> DataFrame:
    """source_file, at, inside: whether a range starts inside quotes."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    bits = lines.groupBy(*_RANGE).agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("source_file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    return bits.select(*_RANGE, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def with_states(lines: DataFrame, states: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Adds `inside` to every line and keeps a range's lines together and in order."""
    n_bytes = states.agg(F.sum(F.octet_length("source_file") + 16)).first()[0] or 0
    if n_bytes <= max_bytes:
        out = lines.join(F.broadcast(states), _RANGE, "left")
    else:
        numbered = lines.withColumn("_line", F.monotonically_increasing_id())
        out = numbered.join(states.hint("merge"), _RANGE, "left").sortWithinPartitions(*_RANGE, "_line").drop("_line")
    return out.withColumn("inside", F.coalesce("inside", F.raise_error(F.lit("the files or their ranges have changed between two reads")).cast("boolean")))


def _is_header(row: list[str]) -> bool:
    return {"firstname", "lastname"} <= set(map(S.norm_key, row))


class _Cut:
    """What a task has cut so far: rows with their place in the range, and fragments."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def text(self, range_: tuple[str, int], place: int, text: str) -> int:
        """The rows of a text that starts and ends outside of quotes; the place after them."""
        maybe_header = "name" in text.lower()
        for row in S.csv_table(text, bom=False):
            self.rows.append((*range_, place, row, maybe_header and _is_header(row), None, False))
            place += 1
        return place

    def fragment(self, range_: tuple[str, int], text: str, opens: bool) -> None:
        self.rows.append((*range_, None, None, False, text, opens))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.bool_()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["source_file", "at", "place", "cells", "named", "fragment", "opens"])
        self.rows = []
        return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now, place, held, inside, crossed = _Cut(), None, 0, [], False, False

    def close() -> None:
        if held:  # a row that goes on in the next range, begun here or before
            out.fragment(now, "\n".join(held), not crossed)
            held.clear()

    for batch in batches:
        for file, at, line, starts_inside in zip(*(batch.column(c).to_pylist() for c in ("source_file", "at", "line", "inside")), strict=True):
            if (file, at) != now:
                close()
                now, place, inside, crossed = (file, at), 0, starts_inside, starts_inside
                if at == 0:
                    line = line.removeprefix("﻿")
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                text = "\n".join(held)
                held.clear()
                if crossed:
                    out.fragment(now, text, False)
                    crossed = False
                else:
                    place = out.text(now, place, text)
            if len(out.rows) >= _BATCH:
                yield out.batch()
    close()
    yield out.batch()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that all fragments from one opening on make."""
    out = _Cut()
    for batch in batches:
        for file, owner, text in zip(*(batch.column(c).to_pylist() for c in ("source_file", "owner", "text")), strict=True):
            out.text((file, owner), 0, text)
            if len(out.rows) >= _BATCH:
                yield out.batch()
    yield out.batch()


def cut_rows(lines: DataFrame, states: DataFrame) -> DataFrame:
    """source_file, ordinal (over all rows that are not blank), cells and named (it has a first and a last name cell)."""
    cut = checkpoint(with_states(lines, states).mapInArrow(_cut, _CUT))
    upto = Window.partitionBy("source_file").orderBy("at", "opens")  # two fragments per range at most
    pieces = cut.where("fragment is not null").withColumn("owner", F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(upto))
    in_order = F.array_sort(F.collect_list(F.struct("at", "fragment")))  # one fragment per range
    texts = pieces.groupBy("source_file", "owner").agg(F.array_join(F.transform(in_order, lambda p: p["fragment"]), "\n").alias("text"))
    joined = checkpoint(texts.mapInArrow(_stitch, _CUT))
    whole = cut.where("fragment is null")
    counts = whole.groupBy(*_RANGE).agg(F.count("*").alias("n"), F.lit(0).alias("n_joined")).unionByName(joined.groupBy(*_RANGE).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("n_joined")))
    counts = counts.groupBy(*_RANGE).agg(F.sum("n").alias("n"), F.sum(F.col("n") + F.col("n_joined")).alias("all"))
    before = Window.partitionBy("source_file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.select(*_RANGE, "n", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    rows = whole.withColumn("_joined", F.lit(False)).unionByName(joined.withColumn("_joined", F.lit(True)))
    rows = _joined_small(rows, counts, _RANGE)
    ordinal = F.col("before") + F.col("place") + F.when(F.col("_joined"), F.col("n")).otherwise(0)  # a row that crosses an end is its range's last
    return rows.select("source_file", ordinal.alias("ordinal"), "cells", "named")


def _joined_small(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Joined with a table of a row per key, which is sent to all tasks if its size allows it."""
    n_bytes = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return rows.join(F.broadcast(small) if n_bytes <= MAX_BROADCAST_BYTES else small, keys)


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file its keys in their order, each with the place of its cell."""
    kind = pa.list_(pa.struct([("key", pa.string()), ("cell", pa.int32())]))
    for batch in batches:
        keys = [[{"key": k, "cell": c} for k, c in S.record(row, list(range(len(row)))).items()] for row in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("source_file"), batch.column("ordinal"), pa.array(keys, kind)], ["source_file", "header", "keys"])


def _record(keys: Column, cells: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(k["key"].alias("key"), F.coalesce(F.get(cells, k["cell"]), F.lit("")).alias("value")))


def parse_csv_ranges(lines: DataFrame) -> DataFrame:
    """Rows of the CSV files as `exports.parse_exports` gives them: row_ord counts the rows below the header; no status rows.

    Runs at once up to the cut rows, so that a size given by `ranges_of` holds for them.
    """
    with ranges_of(lines.sparkSession, None):
        lines = in_tasks(lines)
        rows = cut_rows(lines, checkpoint(start_states(lines)))
    first = F.struct("ordinal", "cells")
    heads = rows.where("named or ordinal = 0").groupBy("source_file").agg(F.coalesce(F.min(F.when(F.col("named"), first)), F.min(first)).alias("h")).select("source_file", "h.ordinal", "h.cells")
    heads = checkpoint(heads.mapInArrow(_layout, "source_file string, header long, keys array<struct<key:string,cell:int>>"))
    below = _joined_small(rows, heads, ["source_file"]).where("ordinal > header")
    return below.select("source_file", F.lit("csv").alias("file_type"), (F.col("ordinal") - F.col("header") - 1).alias("row_ord"), _record(F.col("keys"), F.col("cells")).alias("cells"))
