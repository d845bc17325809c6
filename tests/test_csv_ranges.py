"""CSV files cut into ranges anywhere, against the parser of whole files, cell by cell."""

import random

import pytest
from pyspark.sql import functions as F

from contactrank.sources import csv_ranges as R
from contactrank.sources import exports as S
from tests.test_exports import model


def write(tmp_path, name, text):
    with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def ranged(spark, path, n_bytes):
    """File name to its rows in order, and the number of ranges."""
    with R.ranges_of(spark, n_bytes):
        lines = R.read_lines(spark, str(path))
        n = lines.select("source_file", "at").distinct().count()
        rows = R.parse_csv_ranges(lines).orderBy("source_file", "row_ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r.row_ord, [(c["key"], c["value"]) for c in r.cells]))
    return out, n


def whole(text):
    return list(enumerate(list(x.items()) for x in S.csv_records(text)))


def random_csv(rng, rows):
    pieces = ["a", "é", "b c", "1", '"', '""', '"x, y"', '"l1\nl2"', '"q ""in"" q"', ",", ",", "\n", "\r\n", "\r", " ", '"\r\n,\n"', "日"]
    lines = []
    for _ in range(rows):
        lines.append("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))))
    return "\n".join(lines)


@pytest.mark.parametrize("n_bytes", [50, 150])
def test_equal_to_whole_files_on_random_quotes(spark, tmp_path, n_bytes):
    rng = random.Random(n_bytes)
    texts = {}
    for k in range(5):
        head = rng.choice(["", "Notes:\n\"all\nhere\"\n\n", "﻿"]) + rng.choice(["First Name,Last Name,2023,10,A,A\n", "x,,y\r\n", ""])
        texts[f"f{k}.csv"] = head + random_csv(rng, 30) + rng.choice(["", "\n", '\n"never closed\n\nend\n', "\r\n"])
    texts["one.csv"], texts["blank.csv"], texts["quote.csv"] = "only", " , \n\n,\n", '"'
    for name, text in texts.items():
        write(tmp_path, name, text)
    got, n = ranged(spark, tmp_path, n_bytes)
    assert n > 16
    for name, text in texts.items():
        assert model(text) == S.csv_table(text)
        assert got.get(name, []) == whole(text), name


def test_rows_over_many_ranges_and_late_headers(spark, tmp_path):
    cell = "\n".join(f"line {i} ,{'x' * (i % 7)}" for i in range(60))
    text = "\n".join(f"a{i},b,c" for i in range(50)) + f'\n"{cell}",2\n' + "First Name,Last Name\n" + "\n".join(f'"A{i}\n",B' for i in range(100))
    write(tmp_path, "a.csv", text)
    got, n = ranged(spark, tmp_path, 64)
    assert n > 16 and got["a.csv"] == whole(text) and len(got["a.csv"]) == 100


def test_large_tables_of_states_are_merged(spark, tmp_path):
    text = random_csv(random.Random(3), 100)
    write(tmp_path, "a.csv", text)
    with R.ranges_of(spark, 50):
        lines = R.read_lines(spark, str(tmp_path))
        states = R.start_states(lines)
        one, two = (R.with_states(lines, states, m).groupBy("at").agg(F.collect_list("line").alias("l"), F.max("inside").alias("i")).orderBy("at").collect() for m in (1 << 20, 0))
        assert "SortMergeJoin" in R.with_states(lines, states, 0)._jdf.queryExecution().executedPlan().toString()
    assert one == two


def test_changed_ranges_are_an_error(spark, tmp_path):
    write(tmp_path, "a.csv", random_csv(random.Random(3), 30))
    with R.ranges_of(spark, 50):
        lines = R.read_lines(spark, str(tmp_path))
        states = R.start_states(lines).where("at = 0")
        with pytest.raises(Exception, match="have changed"):
            R.with_states(lines, states).collect()


def test_no_task_reads_more_than_its_range(spark, tmp_path):
    text = "First Name,Last Name\n" + "\n".join(f'"A {i}",B' for i in range(2000))
    write(tmp_path, "a.csv", text)
    with R.ranges_of(spark, 1000):
        lines = R.read_lines(spark, str(tmp_path))
        sizes = lines.groupBy("at").agg(F.sum(F.octet_length("line") + 1).alias("n")).collect()
        tasks = lines.select(F.spark_partition_id().alias("p"), F.octet_length("line").alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert len(sizes) > 16 and max(r.n for r in sizes) < 1100 and max(r.n for r in tasks) < 1100
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "1000"


def test_small_ranges_are_no_small_tasks(spark, tmp_path):
    text = "\n".join(f'"a{i}\n",b{i}' for i in range(2000))
    write(tmp_path, "a.csv", text)
    with R.ranges_of(spark, 64):
        lines = R.read_lines(spark, str(tmp_path))
        states = R.start_states(R.in_tasks(lines))
        assert lines.rdd.getNumPartitions() > 300 and R.with_states(R.in_tasks(lines), states).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        rows = R.parse_csv_ranges(lines)
    assert rows.rdd.getNumPartitions() < 50
    got, n = ranged(spark, tmp_path, 64)
    assert n > 300 and got["a.csv"] == whole(text)
