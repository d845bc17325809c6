"""S4 for JSON files without surprises: native columns from a whole file to its rows, behind a proof per file.

The engine's JSON functions are lenient where the browser is strict, and print some numbers otherwise. A file takes the
native path only if these functions themselves show that none of this can matter to it:

* It is one JSON value and nothing else: it parses (as a variant, which is strict and refuses repeated keys) as the only
  element of an array, and as the value of an object. Text after the value would break one of both, or add an element.
* The value is an array without nulls. Elements that are no objects are rows without cells.
* Every value of an object is a string, a boolean, null, a number that prints the same in both worlds, or an array or
  object that holds only such values, no array in an array, and nothing that the two serialise apart.
* No key is an array index, which the browser would put first.

Other files, broken ones among them, go to the helper of `exports`, which knows the browser's rules in full. `parse_json`
looks first whether there are any, so that nothing of Python is in the plan of clean files. The proof is conservative: it
may refuse a file that both would read alike, never the reverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactrank.functions.tables import checkpoint
from contactrank.functions.text import array_to_text
from contactrank.sources import exports as S

#: Integers of at most 15 digits and decimals of at most 6 places print the same, once trailing zeros are off.
_NUMBER = r"\A-?[0-9]{1,15}(\.[0-9]{1,6})?\z"
_INDEX = r"\A(0|[1-9][0-9]{0,9})\z"
#: In nested values: long runs of digits, keys that are numbers, and escapes by code.
_NESTED = r'[0-9]{16}|"[0-9]+":|\\u'
_ROW = "struct<fine:boolean,cells:array<struct<key:string,value:string>>>"


def _kind(v: Column) -> Column:
    return F.coalesce(F.call_function("schema_of_variant", v), F.lit("VOID"))


def _cell(raw: Column, kind: Column) -> Column:
    """fine and the text of one value: raw as the engine prints it, kind as its variant has it."""
    plain = F.regexp_replace(raw, r"(\.[0-9]*?)0+\z", "$1")
    number = F.when(F.contains(raw, F.lit(".")), F.regexp_replace(plain, r"\.\z", "")).otherwise(raw)
    short = raw.rlike(_NUMBER) & (F.length(F.regexp_replace(raw, "[^0-9]", "")) <= 15)
    # values of mixed kinds hide theirs: there nothing but strings may hold what a fraction, an exponent or an inner array is written with
    bare = F.regexp_replace(F.regexp_replace(raw, '"[^"]*"', ""), "true|false|null", "")
    mixed = ~F.contains(raw, F.lit("\\")) & ~bare.rlike("[.eE]") & ~(kind.startswith("ARRAY") & F.substr(bare, F.lit(2)).contains("["))
    nested = ~raw.rlike(_NESTED) & ~kind.rlike("DOUBLE|DECIMAL|FLOAT|ARRAY<ARRAY|DATE|TIMESTAMP|BINARY") & (~F.contains(kind, F.lit("VARIANT")) | mixed)
    flat = array_to_text(F.from_json(raw, "array<string>"))
    fine = F.when(kind.isin("STRING", "BOOLEAN", "VOID"), True).when(kind.rlike("^(BIGINT|DECIMAL)"), short).when(kind.rlike("^(ARRAY|OBJECT)<"), nested).otherwise(False)
    text = F.when(kind == "VOID", F.lit("")).when(kind.startswith("DECIMAL"), number).when(kind.startswith("ARRAY"), flat).otherwise(raw)
    return F.struct(F.coalesce(fine, F.lit(False)).alias("fine"), F.coalesce(text, F.lit("")).alias("text"))


def _row(item: Column, kind: Column) -> Column:
    """fine and the cells of one element."""
    raw, kinds = F.from_json(item, "map<string,string>"), F.transform(F.map_values(F.from_json(item, "map<string,variant>")), _kind)
    values = F.zip_with(F.map_values(raw), kinds, _cell)
    cells = F.zip_with(F.map_keys(raw), values, lambda k, v: F.struct(k.alias("key"), v["text"].alias("value")))
    keys_fine = ~F.exists(F.map_keys(raw), lambda k: k.rlike(_INDEX))
    objects = F.struct((F.forall(values, lambda v: v["fine"]) & keys_fine & (F.size(kinds) == F.size(F.map_keys(raw)))).alias("fine"), cells.alias("cells"))
    return F.when(kind.startswith("OBJECT"), objects.cast(_ROW)).otherwise(F.struct((kind != "VOID").alias("fine"), F.array().alias("cells")).cast(_ROW))


def prove(files: DataFrame) -> DataFrame:
    """source_file, rows (fine and cells of every element; null for what is no array) and content, for each file."""
    text = F.regexp_replace(F.col("content"), "\\A\ufeff", "")
    of = files.select("source_file", "content", text.alias("_text"))
    alone = (F.json_array_length(F.concat(F.lit("["), "_text", F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit("["), "_text", F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), "_text", F.lit("}"))).isNotNull()
    value = F.try_parse_json("_text")
    array = alone & _kind(value).startswith("ARRAY") & ~F.col("_text").rlike(r"\\u[dD][89a-fA-F]")
    of = of.select("source_file", "content", F.when(array, F.col("_text")).alias("_text"), F.when(array, value).alias("_value"))
    kinds = F.transform(F.try_variant_get("_value", "$", "array<variant>"), _kind)
    return of.select("source_file", F.zip_with(F.from_json("_text", "array<string>"), kinds, _row).alias("rows"), "content")


def parse_json(files: DataFrame) -> DataFrame:
    """Rows and status rows of the JSON files (source_file, content), as `exports.parse_exports` gives them."""
    fine = F.coalesce(F.forall("rows", lambda r: r["fine"]), F.lit(False))
    proved = prove(files).select("source_file", fine.alias("fine"), "rows", "content")
    proved = checkpoint(proved.select("source_file", "fine", F.when(F.col("fine"), F.col("rows")).alias("rows"), F.when(~F.col("fine"), F.col("content")).alias("content")))
    clean = proved.where("fine")
    none, kind = F.lit(None), F.lit("json").alias("file_type")
    rows = clean.select("source_file", F.posexplode("rows").alias("row_ord", "row"))
    rows = rows.select("source_file", kind, F.col("row_ord").cast("long").alias("row_ord"), F.col("row.cells").alias("cells"), none.cast("string").alias("error"), none.cast("long").alias("row_count"))
    n = F.size("rows").cast("long")
    status = clean.select("source_file", kind, none.cast("long").alias("row_ord"), none.cast(rows.schema["cells"].dataType).alias("cells"), F.when(n == 0, S.NO_ROWS).alias("error"), n.alias("row_count"))
    out = rows.unionByName(status)
    odd = proved.where("not fine")
    return out if odd.isEmpty() else out.unionByName(S.parse_exports(odd.select("source_file", "content")))
