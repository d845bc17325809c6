"""S6, T1, T2, T3 over stored versions: what readers see, which files a search opens, what a page reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactrank.functions.schema import CONTACTS
from contactrank.operators import preview
from contactrank.operators import search as R
from contactrank.operators import snapshots as N


def contacts(spark, rows):
    return spark.createDataFrame(rows, CONTACTS)


def rows_of(owner, n, text="x", file="f"):
    return [(owner, file, i, f"{text} {i}", "", "", "", "", "", f"{text} {i}") for i in range(n)]


def seen(frame):
    return sorted((r.owner_id, r.source_file, r.row_ord, r.full_name) for r in frame.collect())


def keys(rows):
    return sorted((o, f, i, name) for o, f, i, name, *_ in rows)


def test_a_reader_sees_a_version_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    assert seen(N.read(spark, path)) == [] and N.versions(spark, path) == []
    assert not N.confirm(contacts(spark, []), path) and N.versions(spark, path) == []
    one, two = rows_of("a", 5) + rows_of("b/:%", 3), rows_of("a", 2, "new") + rows_of("c", 1)
    N.confirm(contacts(spark, one), path)
    before = N.read(spark, path)
    N.confirm(contacts(spark, two), path)
    assert seen(before) == keys(one)  # read after the change, planned before it
    assert seen(N.read(spark, path)) == keys(two + rows_of("b/:%", 3))
    assert seen(N.read(spark, path, version=1)) == keys(one) and seen(N.read(spark, path, owner="c")) == keys(rows_of("c", 1))
    N.revoke(spark, path, ["a", "none"])
    assert seen(N.read(spark, path)) == keys(rows_of("b/:%", 3) + rows_of("c", 1))
    N.revoke(spark, path, ["none"])
    assert N.versions(spark, path) == [3, 2, 1]
    N.vacuum(spark, path, keep=1)
    assert N.versions(spark, path) == [3] and seen(N.read(spark, path)) == keys(rows_of("b/:%", 3) + rows_of("c", 1))
    assert len(list((tmp_path / "s" / "data").iterdir())) <= 2
    N.revoke(spark, path, ["b/:%", "c"])
    assert seen(N.read(spark, path)) == [] and N.search_confirmed(spark, path, "x").count() == 0


def test_an_unfinished_or_lost_change_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    N.confirm(contacts(spark, rows_of("a", 2)), path)
    (tmp_path / "s" / "manifests" / f"{2:012}.json").write_text('{"version": 2, "buck')  # a writer is at it
    assert seen(N.read(spark, path)) == keys(rows_of("a", 2))
    (tmp_path / "s" / "manifests" / f"{2:012}.json").unlink()
    publish, calls = N._publish, []

    def late(spark, path, content):
        if not calls:  # another writer comes first with this number
            calls.append(1)
            N.confirm(contacts(spark, rows_of("b", 1)), path)
        return publish(spark, path, content)

    monkeypatch.setattr(N, "_publish", late)
    N.confirm(contacts(spark, rows_of("a", 1, "later")), path)
    assert seen(N.read(spark, path)) == keys(rows_of("a", 1, "later") + rows_of("b", 1)) and N.versions(spark, path) == [3, 2, 1]
    monkeypatch.setattr(N, "_publish", lambda *a: False)
    with pytest.raises(RuntimeError):
        N.confirm(contacts(spark, rows_of("a", 1)), path)
    assert len(list((tmp_path / "s" / "data").iterdir())) == 3  # what was not published is gone


def test_many_owners_share_few_folders(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(3000).select(F.concat(F.lit("owner-"), "id").alias("owner_id"), F.lit("f").alias("source_file"), F.lit(0).cast("long").alias("row_ord"), *(F.lit("x").alias(f.name) for f in CONTACTS.fields[3:]))
    N.confirm(rows, path, n_buckets=8)
    assert N.read(spark, path).select("owner_id").distinct().count() == 3000
    (write,) = (tmp_path / "s" / "data").iterdir()
    assert len([f for f in write.iterdir() if f.is_dir()]) == 8
    N.confirm(rows.where("owner_id = 'owner-7'"), path)
    assert N.manifest(spark, path)["n_buckets"] == 8 and N.read(spark, path).count() == 3000
    assert len(set(N.manifest(spark, path)["buckets"].values())) == 2  # one bucket is in a new write


def test_searches_open_only_files_that_can_hold_a_token(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "ROWS_PER_FILE", 40)
    path, rng = str(tmp_path / "s"), random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÉß日") for _ in range(rng.randrange(1, 9)))
    rows = [(f"o{i % 3}", f"f{i % 2}", i // 6, f"{word()} {word()}", word(), word(), "", "", "", word()) for i in range(600)]
    rows[400] = (*rows[400][:4], "Zymurgist", *rows[400][5:])
    frame = contacts(spark, rows)
    N.confirm(frame, path)
    everything = len(N.read(spark, path).inputFiles())
    key = lambda out: [(r.owner_id, r.source_file, r.row_ord, r.score) for r in out.collect()]
    for query in ("zymurg", "ZYMURGIST ab", "nothere", "abcd, éß日 x", "a", *(f"{word()}, {word()}" for _ in range(4))):
        for owner in (None, "o1"):
            want = R.search(frame if owner is None else frame.where(F.col("owner_id") == owner), query)
            order = lambda rs: sorted(rs, key=lambda r: (-r[3], r[1], r[2], r[0]))
            got, full = order(key(N.search_confirmed(spark, path, query, owner))), order(key(want))
            if owner:
                assert got == full
            else:  # rows of two owners may tie on file and ordinal
                assert [g[1:] for g in got] == [f[1:] for f in full]
    read = lambda tokens, owner=None: len(N.candidates(spark, path, tokens, owner).inputFiles())
    assert everything > 12 and read(["zymurg"]) <= 2 and read(["nothere"]) <= 1 and read(["zymurg", "a"]) == everything
    assert N.search_confirmed(spark, path, " ,; ").count() == N.search_confirmed(spark, path, "").count() == 0


def test_pages_read_a_range_and_count_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "ROWS_PER_FILE", 30)
    path = str(tmp_path / "s")
    rows = rows_of("a", 101) + rows_of("a", 7, file="g") + rows_of("b", 20)
    N.confirm(contacts(spark, rows), path)
    shown = lambda n, size, owner="a", file="f": sorted(r.row_ord for r in N.page(spark, path, owner, file, n, size).collect())
    assert [shown(p, 25) for p in (0, 3, 4, 9, -1)] == [list(range(25)), list(range(75, 100)), [100], [100], list(range(25))]
    assert shown(0, 100) == list(range(100)) and shown(5, 50, "a", "g") == list(range(7)) and shown(0, 50, "none", "f") == []
    out = N.page(spark, path, "a", "f", 1, 25)
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(row_ord,25)" in plan and "EqualTo(source_file,f)" in plan and "Aggregate" not in plan and "Exchange" not in plan
    whole = preview.preview_page(contacts(spark, rows_of("a", 101)), 1, 25)
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.collect()))


def test_guard(spark):
    asked = spark.createDataFrame([(1, "a", "x"), (2, "a", " ,;"), (3, "a", None), (4, "b", "x"), (5, None, "x"), (1, "a", "x")], "search_id int, owner_id string, criteria string")
    got = sorted((r.search_id, r.runs) for r in R.search_guard(contacts(spark, rows_of("a", 3)), asked).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]


def test_filters_take_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé日 ") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 500]
    rows = spark.createDataFrame([(f"f{i // 100}", t, t) for i, t in enumerate(texts)], "file string, a string, b string").coalesce(1)
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(f"f{i // 100}", set()).update((t or "")[k : k + 3] for k in range(len(t or "") - 2))
    for file, bits in N.trigram_filters(rows).collect():
        assert all(N._holds(bits, [N._places(N._codes(g))]) for g in want[file])
        assert not N._holds(bits, [N._places(N._codes("qqq"))]) and N._holds(bits, [N._places(N._codes(g)) for g in ("qqq", min(want[file]))])
    monkeypatch.setattr(N, "CODES_AT_ONCE", 64)
    pieces = list(N._pieces(iter(texts)))
    assert max(map(len, pieces)) <= 2 * 64 + 8  # whatever the number and length of texts
    parts = ["".join(map(chr, p)) for p in pieces]
    assert {p[k : k + 3] for p in parts for k in range(len(p) - 2) if "\n" not in p[k : k + 3]} == set().union(*want.values())
