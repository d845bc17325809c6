"""Operators 11 to 13 against brute force, on nulls, empty and long texts, ties, repeated rows and clashing names."""

import random
import re
import time
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from contactrank.llm import filter_audit, pii, queries, spelling

CLASH = "doc_id long, text string, source string, row string, spans string, part string, n long, word string"
LABELS = "doc_id long, quality int, toxic int"


def clash(spark, rows):
    return spark.createDataFrame([(i, t, s, "r", "s", "p", 3, "w") for i, t, s in rows], CLASH)


# operator 11

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def slow_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and slow_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def told(spans):
    return [(s.kind, s.start, s.end) for s in spans]


def card(rng, n=16):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(n - 2))
    return next(digits + c for c in "0123456789" if slow_luhn(digits + c))


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(11)
    pieces = ["a", "b.c", "@", "@", ".", "_", "%", "+", "-", " ", "(", ")", "1", "22", "255", "256", "007", "4", "é", "\n", "x@y.z", "1.2.3.4", "+1 (743) 555-3824", "a@b.c_d@e.f", "@@"]
    for k in range(6000):
        parts = [rng.choice(pieces) for _ in range(rng.randrange(1, 24))]
        if k % 3 == 0:
            parts.insert(rng.randrange(len(parts)), card(rng, rng.choice((14, 16, 19))))
        text = "".join(parts)
        spans = pii.spans_of(text)
        assert told(s for s in spans if s.base) == slow_base(text), text
        assert told(spans) == sorted(told(spans), key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("number", ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NO9386011117947"])
def test_account_numbers(number):
    (s,) = pii.spans_of(f"pay to {number} NOW OR NEVER")
    assert (s.kind, s.start, s.end, s.base) == ("iban", 7, 7 + len(number), False)
    wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
    assert not [s for s in pii.spans_of(f"pay to {wrong} now") if s.kind == "iban"]
    assert not pii.spans_of(f"x{number}")


def test_context_moves_scores():
    assert pii.spans_of("call 743-555-3824 today")[0][2:] == ("phone", 0.65, False)
    assert pii.spans_of("it cost 743-555-3824 today") == [] and pii.spans_of("order call 743-555-3824") == []
    assert pii.spans_of(f"far {'x' * 50} phone {'.' * 50} 743-555-3824") == []
    two = "4465758382889437 4465758382889437"
    assert [(s.start, s.end, s.base) for s in pii.spans_of(f"a {two} b")] == [(2, 18, False), (19, 35, False)]
    assert pii.spans_of(f"invoice {two}") == []
    plain, told_, other = (pii.spans_of(f"{w} 10.2.3.4")[0].score for w in ("so", "server", "version"))
    assert other < plain < told_ and pii.spans_of("version 1.2.3.4")[0].base
    assert pii.masked("write a@b.c or +1 743 555 3824.", pii.spans_of("write a@b.c or +1 743 555 3824.")) == "write <EMAIL> or <PHONE>."
    assert pii.apart([pii.Span(3, 5, "card", 1, False), pii.Span(9, 12, "card", 1, False)], [pii.Span(0, 4, "ip", 1, True), pii.Span(1, 9, "ip", 1, True)]) == [pii.Span(9, 12, "card", 1, False)]


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "@a" * 100_000, "a@" * 100_000, "A1 " * 130_000, "12 " * 130_000, "a@b.c " * 20_000):
        pii.spans_of(text)
    assert time.perf_counter() - began < 20


def test_pii_frames(spark):
    rows = [(1, "mail a@b.cd", "s"), (1, "mail a@b.cd", "s"), (2, None, None), (3, "", "s"), (None, "é 1.2.3.4", "s")]
    out = pii.find_pii(clash(spark, rows), mask=True).collect()
    assert sorted((str(r.row.doc_id), r.masked) for r in out) == [("1", "mail <EMAIL>"), ("1", "mail <EMAIL>"), ("2", None), ("3", ""), ("None", "é <IP>")]
    assert next(r.row.spans for r in out) == "s" and pii.find_pii(clash(spark, [])).count() == 0
    found = {(r.row.doc_id, s.kind, s.start, s.end) for r in out for s in r.spans}
    assert found == {(1, "email", 5, 11), (None, "ip", 2, 9)}


def test_pii_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [f"{rng.choice(['tel', 'so'])} 743-555-3824, {card(rng)}; {'a@b.c ' * rng.randrange(3)}+{rng.randrange(10**9, 10**12)}" for _ in range(30)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    for r in queries.op11_pii(spark, str(tmp_path)).collect():
        base = slow_base(texts[r.doc_id] or "")
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        every = [s for s in r.spans.split(",") if s]
        assert set(every) >= {f"{k}:{a}:{b}" for k, a, b in base}
        assert len(every) == len(base) + (r.doc_id < 30 and texts[r.doc_id].startswith("tel"))


# operator 12


def slow_audit(docs, fails, lost):
    """docs: (part, {filter: failed}, {kind: is}, n)."""
    out = {}
    for order in permutations(fails):
        for step, f in enumerate(order):
            for part, failed, kinds, n in docs:
                row = out.setdefault((part, "".join(order), step + 1), Counter())
                before = any(failed[g] for g in order[:step])
                row["kept"] += n * (not before and not failed[f])
                row["removed"] += n * (not before and failed[f])
                row["redundant"] += n * (before and failed[f])
                row["unique_fails"] += n * (failed[f] and sum(failed.values()) == 1)
                for k in lost:
                    row[k] += n * (not before and failed[f] and kinds[k])
    for (part, order, step), row in out.items():
        row["shapley"] = sum(r["removed"] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1])
    return out


def test_interactions_equal_every_document_walked_through_every_order(spark):
    rng = random.Random(12)
    docs = [(rng.choice(["a", "b", None, ""]), {f: rng.random() < p for f, p in zip("XYZ", (0.5, 0.3, 0.6), strict=True)}, {"good": rng.random() < 0.4, "bad": rng.random() < 0.3}, rng.choice([1, 5, 1 << 40])) for _ in range(80)]
    docs.append(("huge", {"X": True, "Y": True, "Z": False}, {"good": True, "bad": False}, 1 << 58))  # next to the fields' end
    rows = spark.createDataFrame([(p, *f.values(), *k.values(), n, "x") for p, f, k, n in docs], "part string, X boolean, Y boolean, Z boolean, good boolean, bad boolean, n long, kept string")
    out = filter_audit.interactions(rows, ["X", "Y", "Z"], lost=("good", "bad"), weight="n").collect()
    want = slow_audit(docs, "XYZ", ("good", "bad"))
    assert len(out) == len(want) == 5 * 18
    for r in out:
        w = want[r.part, r.filter_order, r.step]
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good, r.bad, r.shapley) == tuple(w[c] for c in ("kept", "removed", "redundant", "unique_fails", "good", "bad", "shapley"))


def test_interactions_nulls_and_limits(spark):
    rows = spark.createDataFrame([("a", None, True), ("a", True, None), ("a", True, None)], "part string, A boolean, B boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed) for r in filter_audit.interactions(rows, ["A", "B"]).collect()}
    assert got == {("AB", 1): (1, 2), ("AB", 2): (0, 1), ("BA", 1): (2, 1), ("BA", 2): (0, 2)}
    assert filter_audit.interactions(rows.where("false"), ["A", "B"]).count() == 0
    for bad in ([], list("ABCDEFG"), ["A", "A"]):
        with pytest.raises(ValueError):
            filter_audit.interactions(rows, bad)


def test_filter_audit_query(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(210))
    texts = [long, long, "Same SAME " * 150, "a b #", None, "", "  ", long + " #", "UPPER " + long, "x " * 300]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), rng.choice(texts), rng.choice(["s", "t", None])) for _ in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(1, 9)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    clash(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows)}
        docs.append((s or "", failed, {"good_lost": any(x == i and q == 1 for x, q, _ in labels if x), "toxic_lost": any(x == i and q == 1 for x, _, q in labels if x)}, 1))
    want = slow_audit(docs, "ABCDE", ("good_lost", "toxic_lost"))
    out = queries.op12_filter_audit(spark, str(tmp_path)).collect()
    assert len(out) == len(want) == 3 * 600
    for r in out:
        row = r.asDict()
        w = want[row.pop("part"), row.pop("filter_order"), row.pop("step")]
        assert row == {c: w[c] for c in row}


# operator 13


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(v, w)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        out[w] = [n, len(close), best if best and counts[best] >= ratio * n else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return out


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("max_group", [2, 5, 4096])
def test_variants_equal_all_pairs(spark, max_group, monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(spelling, "TILE", 8)  # so that groups have many tiles
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 11))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "abababab", "babababa"]
    words = set(base)
    for w in base:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + "ÿ" + w[k:], w[:k] + "日" + w[k + 1 :]}
    counts = {w: rng.choice([2, 3, 30, 400, 400, 5000]) for w in words if w}
    got = {r.word: [r.n, r.n_near, r.form, r.root] for r in spelling.spelling_variants(counted(spark, counts), max_group=max_group).collect()}
    assert got == slow_variants(counts)
    assert any(r[2] for r in got.values()) and any(r[2] and r[3] != r[2] for r in got.values())


def test_no_group_stays_crowded(spark):
    words = counted(spark, {"prefix" + "".join(p): 2 for p in permutations("abcdef", 4)})
    rows = spelling.grouped(words, 20)
    sizes = rows.groupBy("size", "side", "k", "gap", "key").count()
    assert sizes.agg(F.max("count")).first()[0] <= 20
    assert rows.select("word").distinct().count() == words.count()


def test_roots_follow_long_paths(spark):
    path = [(f"w{i:02}", f"w{i + 1:02}") for i in range(19)] + [("x", "w05")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(path, "word string, form string")).collect()}
    assert got == {w: "w19" for w, _ in path}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_variants_of_nothing_and_of_little(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    got = {r.word: (r.n_near, r.form) for r in spelling.spelling_variants(counted(spark, {"a": 1, "b": 20, "ab": 3, "\0b": 4, "z" * 3000: 1, "z" * 3001: 10})).collect()}
    assert got == {"a": (2, "b"), "b": (3, None), "ab": (3, None), "\0b": (2, None), "z" * 3000: (1, "z" * 3001), "z" * 3001: (1, None)}


def test_spelling_query(spark, tmp_path):
    rng = random.Random(7)
    words = ["Garçonnet", "straßenbahn", "señorita", "alphabetic", "ALPHABETIC", "x×y÷zabcd", "short", "élégance", "Éclairage"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "1", "日"]) for _ in range(rng.randrange(40, 90))) for _ in range(60)] + [None, "", "ab" * 400]
    rows = [(i if i % 9 else None, t, "s") for i, t in enumerate(texts)] + [(1, texts[1], "s")]
    clash(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = slow_variants({w: n for w, n in counts.items() if n >= 2 and len(w) >= 7})
    got = {r.word: [r.n, r.n_near, r.form, r.root] for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == want and any(r[2] for r in got.values())
