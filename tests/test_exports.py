"""Parsing of exports, against cases and an independent character-by-character model."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from contactrank.operators.contacts import get_field, load_stats
from contactrank.sources import exports as S

BOM = chr(0xFEFF)


def rows_of(spark, text, name="a.csv"):
    rows = S.raw_rows(S.parse_exports(spark.createDataFrame([(name, text)], "source_file string, content string")))
    return [{c["key"]: c["value"] for c in r.cells} for r in rows.orderBy("row_ord").collect()]


def test_csv_cases():
    cases = [
        ('A,B\n"x ""q"", y"," z "', [{"A": 'x "q", y', "B": "z"}]),
        ('A,B\n"l1\nl2",k', [{"A": "l1\nl2", "B": "k"}]),
        ('A,B\nab"c,d"e,f', [{"A": "abc,de", "B": "f"}]),
        ('A,B\nx,"y\nz', [{"A": "x", "B": "y\nz"}]),
        ("A\r\n1", [{"A": "1"}]),
        ("A\n1", [{"A": "1"}]),
        ("A\r1", [{"A": "1"}]),
        ("A,B\n , \n,\n1,2", [{"A": "1", "B": "2"}]),
        ("A,B\n1\n1,2,3", [{"A": "1", "B": ""}, {"A": "1", "B": "2"}]),
        ("A,,C\n1,2,3", [{"A": "1", "col_1": "2", "C": "3"}]),
        ("x,y\n1,2", [{"x": "1", "y": "2"}]),
        (BOM + "A\n1", [{"A": "1"}]),
        ("", []),
    ]
    assert [S.csv_records(t) for t, _ in cases] == [e for _, e in cases]
    assert list(S.csv_records("Name,2023,10,007\na,b,c,d")[0].items()) == [("10", "c"), ("2023", "b"), ("Name", "a"), ("007", "d")]
    repeated = S.csv_records("A,B,A\n1,2,3")[0]
    assert list(repeated.items()) == [("A", "3"), ("B", "2")]


def test_full_name(spark):
    head = "First Name,Last Name"
    assert rows_of(spark, f'Notes:\n"n, m"\n\n{head}\nAnn,Lee') == [{"First Name": "Ann", "Last Name": "Lee", "Full Name": "Ann Lee"}]
    assert rows_of(spark, f"{head}\nAnn,")[0]["Full Name"] == "Ann"
    assert "Full Name" not in rows_of(spark, f"{head},X\n,,1")[0]
    over = rows_of(spark, f"Full Name,{head}\nOld,Ann,Lee")[0]
    assert list(over.items())[0] == ("Full Name", "Ann Lee")
    frame = S.raw_rows(S.parse_exports(spark.createDataFrame([("a.csv", f"full_name,{head}\nOld,Ann,Lee")], "source_file string, content string")))
    row = frame.select(get_field(F.col("cells"), "full").alias("n"), F.col("cells.key").alias("k")).first()
    assert row.n == "Old" and row.k[-1] == "Full Name"


def model(text):
    """Character by character."""
    table, row, cell, quoted, i = [], [], "", False, 0
    strip = S.JS_WS_CHARS

    def push():
        nonlocal row
        row = [c.strip(strip) for c in row]
        if any(row):
            table.append(row)
        row = []

    while i < len(text):
        ch, nxt = text[i], text[i + 1 : i + 2]
        if ch == '"' and quoted and nxt == '"':
            cell += '"'
            i += 1
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch == ",":
            row.append(cell)
            cell = ""
        elif not quoted and ch in "\r\n":
            i += ch == "\r" and nxt == "\n"
            row.append(cell)
            cell = ""
            push()
        else:
            cell += ch
        i += 1
    row.append(cell)
    push()
    return table


def test_random_csv():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice('a",\n\r b"') for _ in range(rng.randrange(25)))
        assert S.csv_table(text) == model(text), text


def test_json(spark):
    assert S.parse_file("a.json", '{"a":1}') == ("json", [], S.NOT_ARRAY)
    assert S.parse_file("a.json", "[1,2")[2] == S.NOT_PARSED
    assert S.parse_file("a.json", "[NaN]")[2] == S.NOT_PARSED
    assert S.parse_file("a.json", "[null]")[2] == S.NOT_PARSED
    assert S.parse_file("a.json", "[" * 100_000)[2] == S.NOT_PARSED
    assert S.parse_file("a.json", "[]")[2] == S.parse_file("a.csv", "A,B")[2] == S.parse_file("a.csv", "")[2] == S.NO_ROWS
    assert S.parse_file("x.txt", "a")[2] == S.NOT_SUPPORTED
    assert S.parse_file("y.Json", BOM + '[1, {"a":1,"b":2,"a":3}]') == ("json", [{}, {"a": "3", "b": "2"}], None)
    assert list(S.json_records('[{"z":1,"10":2,"9":3}]')[0]) == ["9", "10", "z"]
    assert rows_of(spark, '[{"a":" x "}]', "X.JSON") == [{"a": " x "}]


def test_first_key_wins_even_empty(spark):
    frame = S.raw_rows(S.parse_exports(spark.createDataFrame([("a.json", '[{"title":"","Position":"CTO"}]')], "source_file string, content string")))
    assert frame.select(get_field(F.col("cells"), "position")).first()[0] == ""


def test_status_and_nulls(spark):
    files = spark.createDataFrame([("a.csv", "A\n1"), ("b.pdf", "x"), (None, None), ("c.json", None)], "source_file string, content string")
    got = {r.source_file: (r.status, r.error, r.row_count) for r in S.file_status(S.parse_exports(files)).collect()}
    assert got == {"a.csv": ("OK", None, 1), "b.pdf": ("ERROR", S.NOT_SUPPORTED, 0), None: ("ERROR", S.NOT_SUPPORTED, 0), "c.json": ("ERROR", S.NOT_PARSED, 0)}


def test_rows_of_small_files_leave_together(monkeypatch):
    files = pa.RecordBatch.from_pydict({"source_file": [f"{i}.csv" for i in range(700)], "content": [f"A\n{i}\n{'x' * (i % 50)}" for i in range(700)]})
    out = list(S._parse(iter([files, files])))
    assert [b.num_rows for b in out] == [sum(2 + (i % 50 > 0) for i in range(700)) * 2]
    monkeypatch.setattr(S, "_CHUNK_CHARS", 100)
    small = list(S._parse(iter([files, files])))
    assert pa.Table.from_batches(small).combine_chunks() == pa.Table.from_batches(out).combine_chunks()
    assert max(sum(len(c["value"]) for r in b.to_pylist() for c in r["cells"] or ()) for b in small) < 150
    monkeypatch.setattr(S, "_CHUNK", 9)
    assert {b.num_rows for b in S._parse(iter([files]))} >= {9} and max(b.num_rows for b in S._parse(iter([files]))) == 9


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A\n"x\ny"', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"k":1}]', encoding="utf-8")
    parsed = S.parse_exports(S.read_files(spark, str(tmp_path)))
    assert sorted(r.cells[0]["value"] for r in S.raw_rows(parsed).collect()) == ["1", "x\ny"]


def test_discover_columns(spark):
    text = "[" + ",".join(['{"b":1,"a":2}', *['{"a":1}'] * 99, '{"z":1}']) + "]"
    rows = S.raw_rows(S.parse_exports(spark.createDataFrame([("a.json", text)], "source_file string, content string")))
    assert [r.col_name for r in S.discover_columns(rows, 100).orderBy("position").collect()] == ["b", "a"]
    csv = S.raw_rows(S.parse_exports(spark.createDataFrame([("a.csv", "Name,2023\nx,1"), ("b.csv", "A\n1\n2")], "source_file string, content string")))
    assert [r.col_name for r in S.discover_columns(csv, 100).orderBy("source_file", "position").collect()] == ["2023", "Name", "A"]
    stats = load_stats(csv, F.col("row_ord") == 0, 1).orderBy("source_file").collect()
    assert [tuple(r) for r in stats] == [("a.csv", 1, 1, 2), ("b.csv", 2, 1, 1)]


def test_columns_of_wide_files(spark):
    keys = [f"k{i}" for i in range(100_000)]
    rows = spark.createDataFrame([("w.csv", i) for i in range(30)], "source_file string, row_ord long").withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda k: F.struct(F.concat(F.lit("k"), k.cast("string")).alias("key"), F.lit("").alias("value"))))
    out = S.discover_columns(rows, 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert [r.col_name for r in out.orderBy("position").collect()] == keys
    cell = lambda *names: [(n, "") for n in names]
    mixed = spark.createDataFrame([("a", 2, cell("z", "b")), ("a", 0, cell("b", "c")), ("a", 1, cell("d", "b", "a")), ("a", 3, cell("late")), ("b", 0, [])], "source_file string, row_ord long, cells array<struct<key:string,value:string>>")
    assert [(r.source_file, r.position, r.col_name) for r in S.discover_columns(mixed, 3).orderBy("position").collect()] == [("a", k, n) for k, n in enumerate("bcdaz")]
