"""The pipeline's stages on small documents: what goes goes, clean documents stay, columns are those of documents."""

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_operators import brute_components, brute_hits, brute_spans

pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    def prose(i, n=80):
        return ". ".join(" ".join(f"{a}{(i * 7919 + k * 31 + j) % 9973}" for j, a in enumerate(["tree", "river", "stone", "walks", "under"])).capitalize() for k in range(n // 5))

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    shared = "This sentence stands in two pages. " * 8
    rows = [(i, prose(i), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, "BUY!!$$ NOW!!$$ " * 40, "en", "s", 0) for i in range(20)]
    rows += [(200, prose(0), "en", "s", 0), (201, prose(1) + ". One more end.", "en", "s", 0), (202, prose(300) + " " + item, "en", "s", 0)]
    rows += [(203, prose(301) + shared, "en", "s", 0), (204, shared + prose(302), "en", "s", 0), (205, None, None, None, None), (206, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in [*range(60), *range(100, 120)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left, columns = {}, {}
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        left[name], columns[name] = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    clean = set(range(2, 60))
    assert clean <= left["quality_classifier"] and not left["quality_classifier"] & set(range(100, 120))
    assert left["near_duplicates"] & {0, 200} == {0} and left["near_duplicates"] & {1, 201} == {1}
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/2").collect()}
    assert "two pages" not in kept[203] + kept[204]
    assert 202 not in left["benchmark_decontamination"] and clean <= left["benchmark_decontamination"]
    assert all(columns[n] == C.COLUMNS for n, _ in C.STAGES[:-1])
    run = C.run(spark, folder)
    assert {r.doc_id for r in run.select("doc_id").collect()} == left["bpe_encoding"]


def test_stages_against_brute_force(spark, folder):
    """All rows of run(), stage by stage in plain Python, given the classifier's scores; extra columns do not pass."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = C.quality(spark, docs.withColumn("row", F.lit(1)).withColumn("score", F.lit(2)), folder)
    assert scored.columns == C.COLUMNS
    left = [(r.doc_id, r.text) for r in scored.orderBy("doc_id").collect()]
    parts = brute_components([t for _, t in left], [i for i, _ in left], 5, 4, 5)
    left = [x for x, (i, n, low) in zip(left, parts, strict=True) if n == 0 or i == low]
    data = [(t or "").encode() for _, t in left]
    kept = [bytes(b for b, m in zip(d, mask, strict=True) if not m).decode(errors="ignore") for d, mask in zip(data, brute_spans(data, 200), strict=True)]
    left = [(i, t and k) for (i, t), k in zip(left, kept, strict=True) if k or not t]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not brute_hits(t, items)[0]]
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in left)
    assert sorted((r.doc_id, list(r.ids)) for r in C.run(spark, folder).collect()) == want and len(want) > 60


def test_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_one_document_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " end", " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text), (7, near), (7, text), (7, text), (9, text)] + [(None, other)] * 3 + [(None, other + " end")]
    rows += [(None, None), (None, None), (3, ""), (3, ""), (4, " \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in C.near_duplicates(spark, docs, "").collect()]
    assert [i for i, t in got if t and t.startswith("w0 ")] == [7]
    assert [i for i, t in got if t and t.startswith("v0 ")] == [None]
    assert sorted(map(repr, (x for x in got if not (x[1] or "").strip()))) == sorted(map(repr, [(None, None), (None, None), (3, ""), (4, " \n")]))


def test_stages_are_handed_over_as_parquet(spark, folder):
    assert any("/benchmark_decontamination/" in f for f in C.run(spark, folder).inputFiles())
