"""The ten operators against brute force, round trips and held-out rows, on odd rows: nulls, empty and long texts, ties, copies."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactrank.llm.bpe import WordBpe, decode, encode
from contactrank.llm.chat_format import escape, format_examples, read_back, unescape
from contactrank.llm.components import components
from contactrank.llm.decontamination import contaminated
from contactrank.llm.language_id import predict_language
from contactrank.llm.line_rules import quality_rules
from contactrank.llm.lm_scoring import lm_score
from contactrank.llm.ngram_join import jaccard_components
from contactrank.llm.quality_classifier import score_quality, train_quality
from contactrank.llm.substring_dedup import remove_repeated_passages
from contactrank.llm.suffix_array_dedup import remove_repeated_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Names that the operators use themselves.
CLASH = "doc_id long, text string, row string, block long, bucket long, data string, n_words long, kept string, ids string, score double"


def clash(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", 1, 2, "d", 3, "k", "i", 0.5) for i, t in zip(ids, texts, strict=True)], CLASH)


def odd_texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["the", "a", "Über", "naïve", "x1", "日本", "of", "to", "é"] + [f"w{i}" for i in range(60)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = make(60)
    texts = [make(rng.randrange(1, 120)) for _ in range(n)]
    texts += [f"{make(5)}\n{passage}\t{make(9)}" for _ in range(6)] + [passage, passage + " tail", "lead " + passage]
    texts += [texts[0], texts[0], texts[3] + " more", None, "", " \n\t", "one", "two words", make(9000), "same " * 300, "ab" * 400, f" \x0b{make(50)}\r\n"]
    return texts


def thue_morse(n):
    """Two words of 2**n letters that polynomials modulo 2**64 cannot tell apart, for n of 10 and more."""
    w = "a"
    for _ in range(n):
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


def brute_spans(seqs, size):
    count = Counter(s[i : i + size] for s in seqs for i in range(len(s) - size + 1))
    out = []
    for s in seqs:
        mask = [False] * len(s)
        for i in range(len(s) - size + 1):
            if count[s[i : i + size]] > 1:
                mask[i : i + size] = [True] * size
        out.append(mask)
    return out


def check_passages(spark, texts, window, **tuning):
    out = remove_repeated_passages(clash(spark, texts), window=window, **tuning).select("row.*", F.col("kept").alias("left"), F.col("n_removed")).collect()
    words = [tuple(WORD.findall(t or "")) for t in texts]
    for mask, w, r in zip(brute_spans(words, window), words, sorted(out, key=lambda r: r.doc_id), strict=True):
        assert (r.left, r.n_removed) == (" ".join(x for x, m in zip(w, mask, strict=True) if not m), sum(mask))
        assert r.block == 1 and r.kept == "k"


def check_bytes(spark, texts, size, **tuning):
    out = remove_repeated_bytes(clash(spark, texts), size=size, **tuning).select("row.doc_id", "kept", "n_removed", "removed").collect()
    data = [(t or "").encode() for t in texts]
    for mask, b, r in zip(brute_spans(data, size), data, sorted(out, key=lambda r: r.doc_id), strict=True):
        assert bytes(r.kept) == bytes(x for x, m in zip(b, mask, strict=True) if not m)
        assert r.n_removed == sum(mask) == sum(s.end - s.start for s in r.removed)


#: Grams of few hash bits meet often; with hot=1 every repeated window is counted by itself.
TUNING = [{}, {"per_group": 50}, {"hot": 1, "per_group": 50}, {"hash_bits": 8, "hot": 10}]


@pytest.mark.parametrize("tuning", TUNING)
def test_repeated_passages(spark, tuning, monkeypatch):
    import contactrank.llm.suffixes as S

    monkeypatch.setattr(S, "RUN_UNITS", 600 if tuning else 3_000_000)
    monkeypatch.setattr(S, "GATHERED", 7 if tuning else 4_000)
    for window in (35, 3) if tuning else (35, 3, 1):
        check_passages(spark, odd_texts(), window, **tuning)


@pytest.mark.parametrize("tuning", TUNING)
def test_repeated_bytes(spark, tuning):
    for size in (200, 9) if tuning else (200, 40, 9, 1):
        check_bytes(spark, odd_texts(2), size, **tuning)


def test_words_that_polynomials_confuse(spark):
    for n in (10, 11):
        a, b = thue_morse(n)
        texts = [" ".join([a] * 36), " ".join([b] * 36), f"{a} x", f"{b} y", " ".join([a, b] * 20)]
        check_passages(spark, texts, 35)
        check_passages(spark, texts, 35, hot=1)
        check_bytes(spark, [a, b, a + "x", b + "y"], 1 << n)
        check_bytes(spark, [a, b, a + "x", b + "y"], 1 << n, hot=1)
        got = jaccard_components(spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string"))
        assert {r.id: r.component for r in got.collect()} == {1: 1, 2: 2}
        known = lm_score(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), F.col("doc_id") == 1)
        assert {r.doc_id: r.n_known for r in known.select("row.doc_id", "n_known").collect()} == {1: 2, 2: 1}


def test_repeated_bytes_as_text(spark):
    text = remove_repeated_bytes(clash(spark, ["é" * 300, "x" + "é" * 300]), as_text=True).select("kept").collect()
    assert {r.kept for r in text} == {"", "x"}


def test_counts_of_64_bits():
    from contactrank.llm import blocks as B

    keys, big = np.array([3, 5, 9], np.uint64), np.array([2**33, 7, 10**12])
    decide = B.counter()
    answers = decide([B.planes(big) + B.pack(keys), B.planes(np.array([2**33])) + B.pack(keys[:1])])
    assert B.counts_in(answers[0]).tolist() == [2**34, 7, 10**12] and B.counts_in(answers[1]).tolist() == [2**34]


def brute_components(texts, ids, size, num, den):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                comp = [comp[i] if c == comp[j] else c for c in comp]
    least = {}
    for c, i in zip(comp, ids, strict=True):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or c in least else None
    return [(i, len(s), least[c]) for i, s, c in zip(ids, sets, comp, strict=True)]


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        out.append(" ".join(w[rng.randrange(4) :]).upper() if rng.random() < 0.5 else " ".join(w))
    return out


def test_jaccard(spark, monkeypatch):
    import contactrank.llm.ngram_join as N

    texts = odd_texts(3) + near_copies(3, 60)
    ids = [7 * i % 1009 for i in range(len(texts) - 1)] + [None]
    for size, num, den in ((3, 9, 10), (5, 4, 5), (2, 1, 2)):
        monkeypatch.setattr(N, "BLOCK_GRAMS", 700 if size == 5 else 400_000)
        got = jaccard_components(clash(spark, texts, ids), size=size, threshold=(num, den)).select("id", "n", "component").collect()
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(map(tuple, got), key=key) == sorted(brute_components(texts, ids, size, num, den), key=key)


@pytest.mark.parametrize("block_grams, size, num, den", [(400_000, 3, 9, 10), (700, 3, 4, 5), (700, 2, 1, 2)])
def test_jaccard_links(spark, monkeypatch, block_grams, size, num, den):
    import contactrank.llm.ngram_join as N

    monkeypatch.setattr(N, "BLOCK_GRAMS", block_grams)
    monkeypatch.setattr(N, "PAIRS", 300)
    texts = odd_texts(5) + near_copies(5, 60) + near_copies(6, 4) * 2
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    want = [sum(i != j and bool(a) and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    args = {"size": size, "threshold": (num, den)}
    got = jaccard_components(clash(spark, texts), **args).select("id", "n_links", "component").orderBy("id").collect()
    assert [r.n_links for r in got] == want and max(want) > 8
    assert sorted((r.id, r.n, r.component) for r in jaccard_components(clash(spark, texts), **args).select("id", "n", "component").collect()) == sorted(brute_components(texts, range(len(texts)), size, num, den))


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100 + i, 100) for i in range(1, 9)] + [(5, 5), (7, 6), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(9)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(text, items, size=10):
    """(number of hit words, sorted ids) of one text."""
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(LOWER))
    own, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for window in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            for s in range(len(own) - len(window) + 1):
                if tuple(own[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    ids.add("" if item is None else str(item))
    return len(hit), sorted(ids)


@pytest.mark.parametrize(("heavy", "most"), [(1, 1000), (3, 5)])
def test_joins_deal_a_key_by_its_rows(spark, monkeypatch, heavy, most):
    from contactrank.llm import components as K

    monkeypatch.setattr(K, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(K, "MAX_HEAVY", most)
    many = spark.createDataFrame([(k, i) for k in range(6) for i in range(4**k // 4)] + [(None, 1)], "k int, i int")
    one = many.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    got = sorted(map(tuple, K.join_salted(many, one, ["k"], "i").collect()))
    assert got == sorted((k, i, 4**k // 4 - 1) for k in range(6) for i in range(4**k // 4))
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)]
    assert {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(i, 0) for i in range(60)} | {(i, 100) for i in range(100, 141)}


def test_decontamination(spark):
    items = [(1, "a b c d e f g h i j k"), (2, "Short, ITEM"), (3, None), (4, "…! "), (5, "a b c d e f g h i j k"), (None, "über straße"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (10, "a a a")]
    texts = ["x a b c d e f g h i j y", "A-B-C-D-E-F-G-H-I-J-K", "short item short item", "item short", None, "", "die Über?Straße", "a b c d e f g h i x j", "b c d e f g h i j k", "a A a a a"]
    rng = random.Random(7)
    texts += [" ".join(rng.choice(["a", "b", "w1", "über", "straße", "Short", "item"]) for _ in range(200)) for _ in range(5)]
    texts += [" ".join(f"w{i}" for i in range(k, k + 15)) for k in range(5)] + ["z " * 20_000 + "short.item" + " z" * 20_000, texts[0], texts[0]]
    table = spark.createDataFrame(items, "item_id long, text string")
    for part in (1_000_000, 3):
        got = sorted(contaminated(clash(spark, texts), table, part_windows=part).select("row.doc_id", "n_words", F.expr("aggregate(hits, 0L, (n, s) -> n + s.end - s.start)").alias("hit"), "items").collect())
        assert [(r.hit, r["items"]) for r in got] == [brute_hits(t, items) for t in texts]
    assert got[6].hit == 0 and brute_hits(texts[6], items) == (0, []) and got[9].hit == 5
    assert contaminated(clash(spark, texts), table.where("false")).where("size(hits) > 0").count() == 0


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts(4) + ["Hi<|endoftext|>There <|STARTOFTEXT|> don't 1²½ ΑΣ İ ẞ", "<|startoftext|>", "a" * 3000, "!?" * 500, chr(0x85).join("ab"), "a" + chr(0x1C) + "b", "日本 👍🏽 e" + chr(0x301)]
    got = decode(encode(clash(spark, texts), path, decoded="at_once"), path).select("row.doc_id", "ids", "decoded", "at_once").collect()
    assert all(r.decoded == r.at_once for r in got)
    for t, r in zip(texts, sorted(got, key=lambda r: r.doc_id), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (list(r.ids), r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    bpe = WordBpe(path)
    raw = np.frombuffer("naïve日本".encode(), np.uint8)
    code, start = bpe.cuts(raw, np.array([len(raw)]))
    assert len(start) > 1 and not bpe.inside[code[start[1:] - 1], code[start[1:]]].any()


def test_bpe_every_code_point():
    """Each between letters, at a word's end, at its start and alone, in one text for each 64 code points."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, bpe = Tokenizer.from_file(path), WordBpe(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 64 == 0 or c > 0x10FF00 or 0xE0000 <= c < 0xE0200)]
    texts = [" ".join(f"a{c}b a{c} {c}b {c}" for c in map(chr, points[k : k + 64])) for k in range(0, len(points), 64)]
    ids, decoded = bpe.encode(pa.array(texts))
    for text, own, told in zip(texts, ids.to_pylist(), decoded.to_pylist(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert own == want and told == library.decode(want, skip_special_tokens=False), [hex(ord(c)) for c in text[1:400:5]]
    with pytest.raises(ValueError):
        WordBpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_lm(spark):
    from math import log10

    long = " ".join(random.Random(9).choice("abcdefg") for _ in range(5000))
    texts = ["A b a b", "a b c", None, "", "c c d", "a b", "a b a b c", "a b a b c", long, "b a q b a\u3000b"]
    train = [0, 1, 2, 3, 6, 7]
    got = sorted(lm_score(clash(spark, texts), F.col("doc_id").isin(train), beta=(2.0, 0.5)).select("row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", F.col("score").alias("s")).collect())
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for t in texts]
    c = Counter(x for k in train for x in tokens[k])
    pair = Counter(p for k in train for p in zip([None, *tokens[k]], tokens[k], strict=False))
    triple = Counter(p for k in train for p in zip([None, *tokens[k]], tokens[k], tokens[k][1:], strict=False))
    total = sum(c.values()) + len(c) + 1
    p1 = lambda x: (c[x] + 1) / total
    p2 = lambda a, x: (pair[a, x] + 2 * p1(x)) / (c[a] + 2)
    p3 = lambda a, b, x: (triple[a, b, x] + 0.5 * p2(b, x)) / (pair[a, b] + 0.5) if pair[a, b] > 1 else p2(b, x)
    for t, r in zip(tokens, got, strict=True):
        want = log10(p2(None, t[0])) + sum(log10(p3(*x)) for x in zip([None, *t], t, t[1:], strict=False))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), sum(c.values()))
        assert abs(r.s - want) < 1e-7 and abs(r.base_score - sum(log10(p1(x)) for x in t)) < 1e-7
    vocabulary = [*(x for x in c if x is not None), None]
    for a, b in [(None, "a"), ("a", "b"), ("b", "c"), ("x", "a"), ("x", "y")]:  # arcs and failure arcs leave no mass over
        assert abs(sum(p3(a, b, w) for w in vocabulary) + p3(a, b, "new") - 1) < 1e-9


def brute_ngrams(text):
    """4 bytes inside a word, with or without the place before and after it."""
    data = (text or "").lower().encode()
    letter = [97 <= b <= 122 or b >= 128 for b in data]
    plain = [b if m else 32 for b, m in zip(data, letter, strict=True)]
    return [int.from_bytes(bytes(plain[i : i + 4])) for i in range(len(data) - 3) if letter[i + 1] and letter[i + 2]]


LANGUAGES = {"en": "the cat and the dog with the hat", "de": "der hund und die katze mit dem hut", "fr": "le chat et le chien à côté du chapeau"}


def test_language_filters_and_shares(spark):
    """Counts, masks and corrected shares against sets."""
    from contactrank.llm import language_id as L

    rng = random.Random(4)
    rows = [(name, " ".join(rng.choice(words.split()) for _ in range(rng.randrange(1, 60)))) for name, words in LANGUAGES.items() for _ in range(20)]
    rows += [(None, "the cat"), ("en", None), ("en", "")]
    model = L.learn_filter(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    counts = {name: Counter(g for x, t in rows if x == name for g in brute_ngrams(t)) for name in LANGUAGES}
    share = {name: {g: n / sum(c.values()) for g, n in c.items()} for name, c in counts.items()}
    top = lambda g: max(s.get(g, 0) for s in share.values())
    chosen = {name: {g for g, x in s.items() if x >= L.MIN_SHARE and x >= L.MIN_RATIO * top(g)} for name, s in share.items()}
    assert model.languages == sorted(LANGUAGES) and model.fallback == "en"
    every = sorted({g for c in counts.values() for g in c})
    slots = [x.tolist() for x in model.slots(np.array(every, np.uint32))]
    mask = {g: int(np.bitwise_and.reduce([model.words[0][x[k]] for x in slots])) for k, g in enumerate(every)}
    for k, name in enumerate(model.languages):
        held = {g for g in every if mask[g] >> k & 1}
        assert chosen[name] <= held and len(held - chosen[name]) <= 0.2 * len(every)  # none is missed, few pass by chance
    texts = [t or "" for _, t in rows]
    import pyarrow as pa

    got = model.shares(*L.ngrams(pa.array(texts)), len(texts))
    for t, own in zip(texts, got, strict=True):
        grams = brute_ngrams(t)
        for k in range(len(model.languages)):
            n, p = max(1, len(grams)), model.passing[k]
            want = (sum(mask[g] >> k & 1 for g in grams) - n * p) / (1 - p) / n
            assert abs(own[k] - min(1, max(0, want))) < 1e-9


def test_language(spark):
    rng = random.Random(5)
    make = lambda name, n: " ".join(rng.choice(LANGUAGES[name].split()) for _ in range(n))
    names = [sorted(LANGUAGES)[i // 3 % 3] for i in range(90)]
    texts = [make(x, 40) for x in names] + [None, "", "123 !?", "жзи", make("de", 30_000), make("fr", 9), make("fr", 9)]
    docs = spark.createDataFrame([(i, t, names[i] if i < 90 else None, 1.0, "x", "y", 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double, lang_pred string, row string, gram long")
    docs = docs.union(docs.where("doc_id = 0"))
    got = predict_language(docs, F.col("doc_id") % 3 < 2).select("row.doc_id", "lang_pred", F.col("score").alias("s")).orderBy("doc_id").collect()
    assert len(got) == len(texts) + 1 and got[0] == got[1] and all(0 <= r.s <= 1 for r in got)
    got = got[1:]
    assert [r.lang_pred for r in got[:90] if r.doc_id % 3 == 2] == [names[r.doc_id] for r in got[:90] if r.doc_id % 3 == 2]  # not learned from
    assert [r.lang_pred for r in got[90:]] == ["und"] * 3 + [got[93].lang_pred, "de", "fr", "fr"] and got[93].s == 0
    assert {r.lang_pred for r in predict_language(docs, F.lit(False)).collect()} == {"und"}
    assert predict_language(docs.where("false"), F.lit(True)).count() == 0


def test_risk_by_finite_differences():
    from contactrank.llm import quality_classifier as Q

    rng = np.random.default_rng(2)
    u, p = np.append(rng.normal(size=(300, 6)), np.ones((300, 1)), 1), np.append(rng.normal(1, 1, (80, 6)), np.ones((80, 1)), 1)
    prior, decay, w = 0.4, 0.01, rng.normal(size=7)
    positive = lambda z: np.logaddexp(0, -z)
    negative = lambda z: np.logaddexp(0, z)

    def whole(w):
        second = negative(u @ w).mean() - prior * negative(p @ w).mean()
        return prior * positive(p @ w).mean() + second + decay / 2 * (w[:-1] ** 2).sum(), second

    second, gradient, curvature = Q.risk(Q.logistic_sums(u, w), len(u), p, w, prior, decay)
    assert abs(second - whole(w)[1]) < 1e-12
    for k in range(7):
        e = np.zeros(7)
        e[k] = 1e-5
        assert abs((whole(w + e)[0] - whole(w - e)[0]) / 2e-5 - gradient[k]) < 1e-8
        ahead, back = (Q.risk(Q.logistic_sums(u, x), len(u), p, x, prior, decay)[1] for x in (w + e, w - e))
        assert np.abs((ahead - back) / 2e-5 - curvature[k]).max() < 1e-7


def test_traverse_equals_a_walk_of_each_document():
    from contactrank.llm.lm_scoring import traverse

    rng = np.random.default_rng(1)
    for trial in range(20):
        length = rng.integers(0, 50, rng.integers(0, 80))
        if trial % 3 == 0 and len(length):
            length[0] = 700
        n = int(length.sum())
        target, arcs, has, failure = rng.integers(0, 3, n), rng.normal(size=(3, n)), rng.random((3, n)) < 0.5, rng.normal(size=(3, n))
        want, p = [], 0
        for size in length.tolist():
            state, score = 1, 0.0
            for p in range(p, p + size):
                now = state
                while now and not has[now, p]:
                    score, now = score + failure[now, p], now - 1
                score, state = score + arcs[now, p], min(now + 1, target[p])
            p += size > 0
            want.append(score)
        assert np.allclose(traverse(length, 1, target, arcs, has, failure), want)


def test_fit_finds_the_minimum_or_stops_at_the_boundary(spark, monkeypatch):
    from contactrank.llm import quality_classifier as Q

    rng = np.random.default_rng(4)
    monkeypatch.setattr(Q, "N_FEATURES", 3)

    def blocks(x):
        data = [bytearray(part.astype(np.float16).tobytes()) for part in np.array_split(x, 4)]
        return spark.createDataFrame([(d,) for d in data], "x binary")

    def terms(model, p, u, prior):
        z = lambda x: Q.scaled(x, model.mean, model.scale) @ np.append(model.weight, model.bias)
        return prior * np.logaddexp(0, -z(p)).mean(), np.logaddexp(0, z(u)).mean() - prior * np.logaddexp(0, z(p)).mean()

    p = rng.normal(0.7, 1, (400, 3)).astype(np.float16).astype(float)
    u = np.concatenate([rng.normal(0.7, 1, (300, 3)), rng.normal(-0.7, 1, (500, 3))]).astype(np.float16).astype(float)
    prior, ridge = 0.375, 200.0
    model = Q.fit(p, blocks(u), prior, ridge=ridge)
    whole = lambda m: sum(terms(m, p, u, prior)) + ridge / len(u) / 2 * (m.weight**2).sum()
    assert terms(model, p, u, prior)[1] > 0
    for k in range(4):  # no way down from here
        for d in (-0.1, 0.1):
            other = Q.Model(model.mean, model.scale, model.weight + d * (np.arange(3) == k), model.bias + d * (k == 3))
            assert whole(other) > whole(model)
    # with too large a prior the second term would fall below zero: the fit ends before it does
    odd = Q.fit(p, blocks(u), 0.9, ridge=0.1)
    assert terms(odd, p, u, 0.9)[1] >= 0


def test_a_bound_on_positives_takes_the_same_rows_whatever_the_layout(spark):
    from contactrank.llm import quality_classifier as Q

    docs = spark.createDataFrame([(i % 90, f"text {i} " * (i % 7 + 1)) for i in range(200)] + [(None, "x"), (3, None)], "doc_id long, text string")
    known = spark.range(0, 400, 2).withColumnRenamed("id", "doc_id")
    every = Q._sample(docs, known, "doc_id", "text", 1000)
    assert len(every) == docs.where("doc_id % 2 = 0").count()
    some = [Q._sample(docs.repartition(n), known, "doc_id", "text", 30) for n in (1, 7)]
    assert len(some[0]) == 30 and (some[0] == some[1]).all() and {r.tobytes() for r in some[0]} <= {r.tobytes() for r in every}
    assert len(Q._sample(docs, known.where("false"), "doc_id", "text", 30)) == 0


def test_quality(spark):
    rng = random.Random(6)
    good = lambda n=6: ". ".join(" ".join(rng.choice(["tree", "river", "stone", "walks", "under"]) for _ in range(8)).capitalize() for _ in range(n))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW"]) + "!!$$" for _ in range(40))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (1002, good(3000)), (1003, "W" * 90_000), (None, good()), (0, bad())]
    docs = spark.createDataFrame([(*r, 0.5, "r", "x", 1) for r in rows], "doc_id long, text string, score double, row string, x string, _label long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400)] + [(2, 1), (2, 0), (999, None), (None, 1)], "doc_id long, quality int")
    train = F.col("doc_id") % 9 < 6
    got = [(r.doc_id, r.s) for r in score_quality(docs, train_quality(docs, labels, train)).select("row.doc_id", F.col("score").alias("s")).collect()]
    assert len(got) == 406 and all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i == 0}) == 2
    held = {i: s for i, s in got if i is not None and i < 400 and i % 9 >= 6}
    assert np.mean([(s >= 0.7) == (i % 4 > 0) for i, s in held.items()]) > 0.95
    none = score_quality(docs, train_quality(docs, labels.where("false"), F.lit(True)))
    assert {r.score for r in none.select("score").collect()} == {0.5}
    empty = docs.where("false")
    assert score_quality(empty, train_quality(empty, labels, train)).count() == 0


def test_equal_rows_go_to_many_blocks(spark):
    from contactrank.llm.blocks import in_blocks

    rows = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text")).repartition(16)
    assert in_blocks(rows, 1 << 30).select("block").distinct().count() > 8


def test_chat(spark):
    texts = ["<|im_end|>", "a\\|b<\\|", "\\\\n<|im_start|>x\n", "", None, "<<||>\\", "é\n\n"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", "we\\n\nird<|", "assistant", "user"], texts, strict=True))]
    rows += [(2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, 0, "assistant", "only"), (4, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = format_examples(turns)
    assert {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {1: 4, None: 4, 2: 1, 3: 1, 4: 1}
    got = {r.conv_id: r for r in read_back(examples).collect()}
    told = [(r, x or "") for _, _, r, x in rows[:7]]
    assert [tuple(t) for t in got[1].turns] == [tuple(t) for t in got[None].turns] == told
    assert got[1].loss_text == "".join(x for r, x in told if r == "assistant")
    assert [t.text for t in got[2].turns] == ["a", "a", "b"] and got[2].loss_text == "" and got[3].loss_text == "only"
    assert [tuple(t) for t in got[4].turns] == [("", "")]
    assert format_examples(turns.where("false")).count() == 0
    long = [(9, t, ("user", "assistant")[t % 2], f"{t} <|im_end|>" * (20_000 if t == 1 else 1)) for t in range(300)]
    (back,) = read_back(format_examples(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(t) for t in back.turns] == [(r, x) for _, _, r, x in long] and back.loss_text == "".join(x for _, _, r, x in long if r == "assistant")
    rng = random.Random(8)
    odd = spark.createDataFrame([("".join(rng.choice("\\<|n\nx") for _ in range(rng.randrange(12))),) for _ in range(500)], "s string")
    same = odd.select("s", unescape(escape(F.col("s"))).alias("a"), unescape(escape(F.col("s"), True), True).alias("b"), escape(F.col("s"), True).alias("e"))
    assert same.where("a <> s or b <> s or e like '%<|%' or e like '%\n%'").count() == 0


def letters(i):
    """A number in letters: digits are all one to the line rules."""
    return "".join(chr(97 + int(c)) for c in str(i))


def prose(i, n=30):
    return " ".join(f"w{letters(i)}x{letters(k)}" for k in range(n))


def test_line_rules(spark):
    texts = [f"Menu  HOME 1\n{prose(i)}" for i in range(60)] + ["menu home 2\n" * 30 + prose(99, 21)] + [None, "", "few words", "a b c d e f g h " * 10] + [prose(0)] * 2
    docs = spark.createDataFrame([(i, t, "h" if i < 63 else None, 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, above int")
    got = quality_rules(docs).select("row.doc_id", "n_words", "n_repeat_words", "n_dup_lines", "n_left", "base_failed", "kept", "clean_text").orderBy("doc_id").collect()
    assert all(r.kept and r.n_left == 30 and r.n_words == 33 for r in got[:60]) and got[5].clean_text == prose(5)
    assert not got[60].kept and got[60].n_left == 21 and got[60].n_dup_lines == 29
    assert [r.base_failed for r in got[61:67]] == [True, True, True, True, False, False]
    assert got[64].n_repeat_words == 80 and got[65].kept
    assert quality_rules(docs.where("false")).count() == 0


def test_line_rules_against_sql_above_the_limit(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    import contactrank.llm.line_rules as L
    from contactrank.llm.queries import OP4_SQL, op4_quality_rules

    line = lambda n: " ".join(f"menu{letters(k)}" for k in range(n))
    rows = [(i, f"{line(25 + 10 * (i % 3))}\n{prose(i)}", ("a", "b", None)[i % 4 % 3]) for i in range(252)]
    rows += [(200 + i, f"Menu  Home {i % 10}\n{prose(200 + i)}", "a") for i in range(21)] + [(300 + i, f" Legal\tPage 7 \n\n{prose(300 + i)}", "b") for i in range(3)]
    rows += [(500 + i, f"Every Host's line {i}\n{prose(500 + i)}\r", f"host {i}") for i in range(60)] + [(600 + i, f"Own line\n{prose(600 + i)}", "small") for i in range(5)]
    rows += [rows[0], rows[0], (400, None, "a"), (401, "", None), (None, "menu home 3\n" * 3 + prose(401), "a"), (402, prose(402, 30_000), "a"), (403, "\n \n x \n\x0b", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for most in (32 << 20, 0):  # sent to all tasks, or joined by a salted shuffle
        monkeypatch.setattr(L, "MAX_BROADCAST_BYTES", most)
        found = op4_quality_rules(spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({OP4_SQL})").fetchall()
        got = found.collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        removed = [r for r in got if r.n_left < r.n_words and not r.base_failed]
        assert {r.kept for r in removed} == {True, False} and all(r.n_left == r.n_words for r in got if r.doc_id in (300, 301, 302, 600, 601))
        assert all(r.n_left == 30 for r in got if r.doc_id in range(500, 560))


def test_empty_tables(spark):
    none = clash(spark, [])
    assert remove_repeated_passages(none).count() == remove_repeated_bytes(none).count() == 0
    assert jaccard_components(none).count() == lm_score(none, F.lit(True)).count() == 0
    assert encode(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_digest_of_a_whole_text(spark):
    text = "z " * 50_000
    (r,) = remove_repeated_passages(clash(spark, [text])).select(F.sha2(F.col("kept").cast("binary"), 256).alias("s"), "n_removed").collect()
    assert r.n_removed == 50_000 and r.s == hashlib.sha256(b"").hexdigest()
