"""R1-R3, T1, T3, P5, B1, P4, T2, A3, S6."""

import random

from pyspark.sql import functions as F

from contactrank.functions.schema import CONTACTS, WEIGHTS
from contactrank.functions.text import tokens_of
from contactrank.operators import contacts as C
from contactrank.operators import matching as M
from contactrank.operators import preview as V
from contactrank.operators import search as R
from contactrank.sources import exports as S

K = ("o", "f", 0, 'Ann O"Neil', "Director", "Acme", "ann@acme.com", "https://x/ann", "12 Oct 2023", 'Ann O"Neil Director Acme ann@acme.com https://x/ann 12 Oct 2023 blue chip')


def contacts(spark, rows):
    return spark.createDataFrame(rows, CONTACTS)


def test_scores_and_reasons(spark):
    cases = [
        ("cto, acme; ANN 2023 zzz cto", 19, ["ann", "cto", "acme", "2023"], ["Name match: ann", "Position match: cto", "Company match: acme"]),
        ("blue", 1, ["blue"], ["Matched: blue"]),
        ("https", 2, ["https"], ["Matched: https"]),
        ("ann https", 8, ["ann", "https"], ["Name match: ann"]),
        ("acme.com", 2, ["acme.com"], ["Email match: acme.com"]),
    ]
    for query, score, matched, reasons in cases:
        (r,) = R.search(contacts(spark, [K]), query).collect()
        assert (r.score, r.matched_tokens, r.reasons) == (score, matched, reasons)
    for query in ("%", "_", ",; ", ""):
        assert R.search(contacts(spark, [K]), query).count() == 0


def test_reasons_are_cut_and_both_forms_agree(spark):
    query = "a b c d e f g h i"
    row = (*K[:3], "abcdefghi", *K[4:])
    (r,) = R.search(contacts(spark, [row]), query).collect()
    assert r.score == 54 and len(r.matched_tokens) == 9 and r.reasons == ["Name match: a, b, c, d, e, f, g, h"]
    tokens = tokens_of(query) * 5
    frame = R.lowered(contacts(spark, [row, K]))
    long, short = frame.select(R.score(tokens)).collect(), frame.select(R.score(F.array(*map(F.lit, tokens)))).collect()
    assert [x[0] for x in long] == [x[0] for x in short]


def slow(row, tokens):
    score, by = 0, {f: [] for f in WEIGHTS}
    for t in tokens:
        f = next((f for f in WEIGHTS if t in row[3 + list(WEIGHTS).index(f)].lower()), None)
        if f:
            score += WEIGHTS[f]
            by[f] += [t] * (t not in by[f])
    return score, [t for f in WEIGHTS for t in by[f]]


def test_random_rows_and_partitions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randrange(4)))
    rows = [("o", f"f{i % 3}", i, *(word() for _ in range(6)), word() + " " + word()) for i in range(60)]
    for query in ("a b", "ab, c; a a", "cab bb x"):
        tokens = tokens_of(query)
        best = sorted(((-slow(r, tokens)[0], r[1], r[2]) for r in rows if slow(r, tokens)[0]))[:10]
        for n in (1, 4, 64):
            got = R.search(contacts(spark, rows).repartition(n), query).orderBy(F.desc("score"), "source_file", "row_ord").collect()
            assert [(-r.score, r.source_file, r.row_ord) for r in got] == best
            assert all(r.matched_tokens == slow(rows[r.row_ord], tokens)[1] for r in got)


def test_batch(spark, monkeypatch):
    rows = [("b" if i % 5 else "a", "f", i, "ann", f"p{i}", "", "", "", "", "ann") for i in range(200)]
    searches = spark.createDataFrame([(1, "a", "ann p1"), (2, "b", "ann"), (3, "b", " ;"), (4, "c", "ann"), (5, "b", None)], "search_id long, owner_id string, criteria string")
    out = R.batch_search(contacts(spark, rows), searches)
    assert {r.search_id: r.n for r in out.groupBy("search_id").agg(F.count("*").alias("n")).collect()} == {1: 10, 2: 10}
    one = R.search(contacts(spark, [r for r in rows if r[0] == "a"]), "ann p1").collect()
    assert [(r.row_ord, r.score) for r in out.where("search_id = 1").orderBy("rank").collect()] == [(r.row_ord, r.score) for r in one]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange
    ranked = plan[plan.index("WindowGroupLimit") :]
    assert "all_text" not in ranked[: ranked.index("MapInArrow")]  # texts do not travel with what is ranked
    monkeypatch.setattr(R, "MAX_BROADCAST_BYTES", 0)  # an owner's contacts are dealt to several tasks
    salted = R.batch_search(contacts(spark, rows), searches)
    assert sorted(map(str, salted.collect())) == sorted(map(str, out.collect()))
    stored = R.lowered(contacts(spark, rows)).withColumn("_full_name", F.lit("zed"))  # a snapshot's own search columns are used
    assert R.search(stored, "zed").count() == 10


def test_searches_under_one_id_and_repeated_ones(spark):
    rows = contacts(spark, [("a", "f", i, f"ann {i}", "cto" if i % 2 else "", "", "", "", "", "") for i in range(6)])
    asked = [(1, "a", "ann"), (1, "a", "cto"), (1, "a", "cto"), (1, "b", "ann"), (2, "a", "cto cto ann")]
    out = R.batch_search(rows, spark.createDataFrame(asked, "search_id int, owner_id string, criteria string")).collect()
    assert {(r.search_id, r.criteria): n for r in out for n in [sum((x.search_id, x.criteria) == (r.search_id, r.criteria) for x in out)]} == {(1, "ann"): 6, (1, "cto"): 3, (2, "cto cto ann"): 6}
    assert sorted(r.rank for r in out if r.criteria == "cto") == [1, 2, 3] and max(r.score for r in out) == 14


def test_matcher_equals_the_slow_model_and_reads_each_field_once():
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abC é") for _ in range(rng.randrange(n)))
    searches = [tokens_of(f"{word(9)} {word(9)},{word(4)} {word(2)}") for _ in range(300)]
    m = M.Matcher(searches)

    class Counted:
        def __init__(self, automaton):
            self.automaton, self.read = automaton, []

        def iter(self, text):
            self.read.append(text)
            return self.automaton.iter(text)

    m.automaton = Counted(m.automaton)
    for _ in range(50):
        row = ("o", "f", 0, *(word(12) for _ in range(7)))
        m.automaton.read.clear()
        got = m.scores([x.lower() for x in row[3:]])
        assert got == {p: s for p, tokens in enumerate(searches) if (s := slow(row, tokens)[0])}
        assert len(m.automaton.read) <= 7  # of 300 searches
    assert M.Matcher([[]]).scores(["a"] * 7) == {}


def test_owners_with_many_searches_and_contacts(spark, monkeypatch):
    rows = contacts(spark, [(f"o{i % 3}", "f", i, f"n{i % 7}", f"p{i % 11}", "", "", "", "", "") for i in range(150)])
    asked = spark.createDataFrame([(i, f"o{i % 4}", f"n{i % 7} p{i % 5}") for i in range(60)], "search_id long, owner_id string, criteria string")
    key = lambda r: (r.search_id, r["rank"], r.owner_id, r.row_ord, r.score, r.reasons)
    want = sorted(map(key, R.batch_search(rows, asked).collect()))
    monkeypatch.setattr(M, "SEARCHES_PER_BLOCK", 4)
    assert sorted(map(key, R.batch_search(rows, asked).collect())) == want
    monkeypatch.setattr(M, "CONTACTS_PER_TASK", 9)
    monkeypatch.setattr(R, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(key, R.batch_search(rows, asked).collect())) == want
    assert R.batch_search(rows, asked.where("false")).count() == R.batch_search(rows.where("false"), asked).count() == 0


def test_common_tokens_do_not_multiply_contacts_and_searches(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"o{i % 2}", f"f{i % 3}", i, f"ann {i}", rng.choice(["cto", "ceo", "dev"]), rng.choice(["acme", "bolt"]), "", "", rng.choice(["Jan", "May"]), "ann") for i in range(400)]
    asked = [(i, f"o{i % 2}", rng.choice([f"ann {i * 3}", "ann cto jan", f"{i} bolt; may bolt", "acme ceo ann", "zzz", f"ann {i % 7}x"])) for i in range(200)]
    frame, searches = contacts(spark, rows), spark.createDataFrame(asked, "search_id long, owner_id string, criteria string")
    want = []
    for search, owner, criteria in asked:
        scored = sorted((-slow(r, tokens_of(criteria))[0], r[1], r[2]) for r in rows if r[0] == owner)
        want += [(search, n, -s, file, row) for n, (s, file, row) in enumerate(scored[:10], 1) if s]
    key = lambda r: (r.search_id, r["rank"], r.score, r.source_file, r.row_ord)
    monkeypatch.setattr(M, "FEW", 12)
    for max_bytes in (R.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(R, "MAX_BROADCAST_BYTES", max_bytes)
        assert sorted(map(key, R.batch_search(frame, searches).collect())) == sorted(want)
    blocks = M.in_blocks(searches.withColumn("tokens", F.split("criteria", "[ ;]+")))
    pairs = M.match(R.lowered(frame), blocks).groupBy("owner_id", "place").count()
    assert pairs.agg(F.max("count")).first()[0] <= 10 + 2 * M.FEW  # of 200 contacts


def test_cards(spark):
    r = R.result_cards(R.search(contacts(spark, [("o", "f", 0, "", "", "Acme", "", "", "", "Acme"), ("o", "f", 1, "N", "CTO", "Acme", "", "", "", "x")]), "acme")).orderBy("row_ord").collect()
    assert [(x.name, x.subtitle) for x in r] == [("(no name)", "Acme"), ("N", "CTO • Acme")]


def test_pages(spark):
    rows = contacts(spark, [("o", "f", i, "", "p", "", "", "", "", "") for i in range(101)])
    assert V.page_stats(rows).first().page_count == 3
    assert [V.preview_page(rows, p).count() for p in (0, 1, 2, 9)] == [50, 50, 1, 1]
    shown = V.preview_page(rows, 9).first()
    assert (shown.name, shown.position, shown.company) == ("(no name)", "p", "—")
    assert V.page_stats(rows.where("false")).count() == 0


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "confirmed")
    rows = contacts(spark, [(o, "f", i, "n", "", "", "", "", "", "") for o in ("1", "2") for i in range(3)])
    assert C.confirm_snapshot(rows, path)
    assert not C.confirm_snapshot(rows.where("false"), path)
    assert C.confirm_snapshot(rows.where("owner_id = '1' and row_ord = 0"), path)
    assert sorted((r.owner_id, r.row_ord) for r in C.read_snapshot(spark, path).collect()) == [("1", 0), ("2", 0), ("2", 1), ("2", 2)]
    C.revoke_snapshot(spark, path, ["2", "none"])
    assert [r.owner_id for r in C.read_snapshot(spark, path).collect()] == ["1"]
    bad = S.parse_exports(spark.createDataFrame([("a.csv", "")], "source_file string, content string"))
    assert C.confirm_snapshot(rows, path) and C.stage_upload(spark, bad, "2", path).count() == 0
    assert {r.owner_id for r in C.read_snapshot(spark, path).collect()} == {"1"}
