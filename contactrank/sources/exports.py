"""Contact exports (S1-S5, P6): CSV and JSON files to rows of ordered cells, and a status per file.

A file is parsed as a whole by one vectorised helper, because quoted line breaks and a preamble of any length make it
unsplittable; parallelism is the number of files. Any frame (source_file, content) can be parsed, from disk or not.
Bad files become status rows and never fail the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactrank.functions.text import JS_WS_CHARS

#: What the user is told.
NOT_ARRAY = "JSON must be an array of objects."
NOT_SUPPORTED = "Unsupported file type. Please upload a .csv or .json file."
NO_ROWS = "No rows found in file."
NOT_PARSED = "Failed to parse file."

_OUT = "source_file string, file_type string, row_ord long, cells array<struct<key:string,value:string>>, error string, row_count long"
_CELLS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_CHUNK, _CHUNK_CHARS = 5_000, 8 << 20

#: A quoted run (closed or up to the end), a plain run, a comma, or a line break; no backtracking.
_PIECE = re.compile(r'"((?:[^"]++|"")*+)(?:"|\Z)|([^",\r\n]++)|(,)|(\r\n|\r|\n)')


def csv_table(text: str, bom: bool = True) -> list[list[str]]:
    """Trimmed cells of all rows that are not blank. Quotes may open and close anywhere in a cell."""
    table: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []

    def end_row() -> None:
        row.append("".join(cell).strip(JS_WS_CHARS))
        cell.clear()
        if any(row):
            table.append(row.copy())
        row.clear()

    for m in _PIECE.finditer(text.removeprefix("\ufeff") if bom else text):
        kind = m.lastindex
        if kind == 1:
            cell.append(m[1].replace('""', '"'))
        elif kind == 2:
            cell.append(m[2])
        elif kind == 3:
            row.append("".join(cell).strip(JS_WS_CHARS))
            cell.clear()
        else:
            end_row()
    end_row()
    return table


def norm_key(key: str) -> str:
    return re.sub("[^a-z0-9]+", "", key.lower())


def header_row(table: list[list[str]]) -> int:
    """The first row with a first and a last name column, else the first row."""
    return next((i for i, r in enumerate(table) if {"firstname", "lastname"} <= set(map(norm_key, r))), 0)


def csv_records(text: str) -> list[dict[str, str]]:
    """S3: cells by header; a missing cell is empty, a blank header is col_N, a repeated header keeps its last value.

    A record is an object in the browser, so headers that are array indexes come first, ascending.
    """
    table = csv_table(text)
    if not table:
        return []
    at = header_row(table)
    return [record(table[at], r) for r in table[at + 1 :]]


def record(header: list[str], row: list) -> dict[str, object]:
    """S3 for one row."""
    keys = [h or f"col_{c}" for c, h in enumerate(header)]
    return _object(zip(keys, row + [""] * (len(keys) - len(row)), strict=False))


def js_number(x: float) -> str:
    """A number as ECMAScript prints it."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent  # digits before the decimal point
    if len(text) <= point <= 21:
        out = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{text}"
    else:
        mantissa = text[0] + ("." + text[1:] if len(text) > 1 else "")
        out = f"{mantissa}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out


def compact_json(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{compact_json(k)}:{compact_json(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(compact_json, v)) + "]"
    if isinstance(v, float):
        out = js_number(v)
        return "null" if out[-1] in "yN" else out
    return json.dumps(v, ensure_ascii=False)


def to_text(v: object) -> str:
    """X1 for a parsed JSON value."""
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return js_number(v)
    if isinstance(v, list):
        return " ".join(map(to_text, v))
    return compact_json(v)


def _object(pairs: Iterable[tuple[str, object]]) -> dict[str, object]:
    """Last value, first place; keys that are array indexes come first, ascending."""
    out = dict(pairs)
    index = sorted((k for k in out if re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < 2**32 - 1), key=int)
    return {k: out[k] for k in index} | out if index else out


def _refuse(name: str) -> object:
    raise ValueError(name)


def json_records(text: str) -> list[dict[str, str]]:
    """The elements of a top-level array; one that is no object is a row without cells, a null is an error."""
    value = json.loads(text.removeprefix("\ufeff"), parse_int=float, parse_constant=_refuse, object_pairs_hook=_object)
    if not isinstance(value, list):
        raise TypeError(NOT_ARRAY)
    if any(x is None for x in value):
        raise ValueError(NOT_PARSED)
    return [{k: to_text(x) for k, x in v.items()} if isinstance(v, dict) else {} for v in value]


def parse_file(name: str, content: str) -> tuple[str, list[dict[str, str]], str | None]:
    """(type, rows, error) of one file."""
    kind = next((t for t in ("json", "csv") if name.lower().endswith("." + t)), "")
    try:
        if not kind:
            return "", [], NOT_SUPPORTED
        rows = json_records(content) if kind == "json" else csv_records(content)
    except TypeError as e:
        return kind, [], str(e)
    except (ValueError, RecursionError):
        return kind, [], NOT_PARSED
    return kind, rows, None if rows else NO_ROWS


def _whole(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many small files leave together; those of a large one in batches of _CHUNK."""
    out = _Rows()
    for batch in batches:
        for name, content in zip(batch.column("source_file").to_pylist(), batch.column("content").to_pylist(), strict=True):
            kind, rows, error = parse_file(name or "", content or "")
            for i, r in enumerate(rows):
                out.add(name, kind, i, [{"key": _whole(k), "value": _whole(v)} for k, v in r.items()], None, None)
                if out.full():
                    yield out.batch()
            out.add(name, kind, None, None, error, len(rows))
            if out.full():
                yield out.batch()
    yield out.batch()


class _Rows:
    """Rows that have not left yet, _CHUNK rows or _CHUNK_CHARS characters of cells and one row more at most."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, *row: object) -> None:
        self.rows.append(row)
        self.chars += sum(len(c["key"]) + len(c["value"]) for c in row[3] or ())

    def full(self) -> bool:
        return len(self.rows) >= _CHUNK or self.chars >= _CHUNK_CHARS

    def batch(self) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), _CELLS, pa.string(), pa.int64()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(types)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["source_file", "file_type", "row_ord", "cells", "error", "row_count"])
        self.rows, self.chars = [], 0
        return out


def read_files(spark: SparkSession, path: str, which: Column | None = None) -> DataFrame:
    """(source_file, content) of every file below a path that holds anything; which: a condition on `_metadata`.

    Spark's readers don't list files without a byte, so these have no row here, nor a status later.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = rows if which is None else rows.where(which)
    return rows.select(F.col("_metadata.file_path").alias("source_file"), F.make_valid_utf8("value").alias("content"))


def parse_exports(files: DataFrame) -> DataFrame:
    """Rows (row_ord is set) and one status row per file (row_ord is null). Persist it where both are read."""
    return files.select(F.col("source_file").cast("string").alias("source_file"), F.col("content").cast("string").alias("content")).mapInArrow(_parse, _OUT)


def raw_rows(parsed: DataFrame) -> DataFrame:
    """source_file, file_type, row_ord and cells, with the derived full name of CSV rows."""
    rows = parsed.where("row_ord is not null").select("source_file", "file_type", "row_ord", "cells")
    return rows.withColumn("cells", F.when(F.col("file_type") == "csv", derive_full_name(F.col("cells"))).otherwise(F.col("cells")))


def file_status(parsed: DataFrame) -> DataFrame:
    """source_file, status, error and row_count."""
    rows = parsed.where("row_ord is null")
    return rows.select("source_file", F.when(F.col("error").isNull(), "OK").otherwise("ERROR").alias("status"), "error", "row_count")


def derive_full_name(cells: Column) -> Column:
    """`Full Name` from first and last name, in the place of a cell of exactly that key or at the end."""
    from contactrank.operators.contacts import first_last, get_field

    key = "Full Name"
    name = first_last(cells)
    put = F.when(
        F.exists(cells, lambda c: c["key"] == key),
        F.transform(cells, lambda c: F.struct(c["key"].alias("key"), F.when(c["key"] == key, name).otherwise(c["value"]).alias("value"))),
    ).otherwise(F.concat(cells, F.array(F.struct(F.lit(key).alias("key"), name.alias("value")))))
    named = (get_field(cells, "first") != "") | (get_field(cells, "last") != "")
    return F.when(named, put).otherwise(cells)


def discover_columns(rows: DataFrame, sample_rows: int) -> DataFrame:
    """A2: source_file, position and col_name of the keys in a file's first rows, in order of appearance.

    Rows with the same keys in the same order count once, so a wide CSV file sends one list; the lists of a file, of
    sample_rows at most, are merged in their order into one that holds each key once.
    """
    lists = rows.where(F.col("row_ord") < sample_rows).groupBy("source_file", F.col("cells.key").alias("keys")).agg(F.min("row_ord").alias("row_ord"))
    of = lists.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("row_ord", "keys"))).alias("lists"))
    merged = F.aggregate("lists", F.array().cast("array<string>"), lambda keys, x: F.array_union(keys, x["keys"]))
    return of.select("source_file", F.posexplode(merged).alias("position", "col_name"))
