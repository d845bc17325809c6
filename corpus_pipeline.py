"""The corpus pipeline: five stages, each a training-data operator over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows with null or empty texts pass the first stages by
their scores like any other row; a table without rows gives a result without rows.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactrank.llm.blocks import whole_text_rows
from contactrank.llm.bpe import encode
from contactrank.llm.components import checkpoint_folder
from contactrank.llm.decontamination import contaminated
from contactrank.llm.ngram_join import jaccard_components
from contactrank.llm.quality_classifier import score_quality, train_quality
from contactrank.llm.suffix_array_dedup import remove_repeated_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores under 0.7; it learns from three of four labelled rows.

    Null and empty texts are scored like others; repeated rows get the same score, so all or none stay; rows of a null id
    teach nothing.
    """
    whole_text_rows(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    scored = score_quality(docs, train_quality(docs.select("doc_id", "text"), labels, train))
    return scored.where("score >= 0.7").select("row.*").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more.

    The kept one has the least (doc_id, text hash), null ids last; of repeated rows with both one stays. Documents
    without words are in no group and stay; of those that repeat an id and text one stays.
    """
    whole_text_rows(spark)
    groups = jaccard_components(docs, size=5, threshold=(4, 5))
    first = groups.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first"))
    keep = first.select(F.col("first.id").alias("_id"), F.col("first.th").alias("_th"))
    rows = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left_semi").dropDuplicates(["doc_id", "_hash"])
    wordless = rows.where(F.coalesce(F.translate("text", " \t\n\x0b\f\r", ""), F.lit("")) == "")
    kept = kept.unionByName(wordless.where("doc_id is not null").dropDuplicates(["doc_id", "_hash"]))
    return kept.unionByName(wordless.where("doc_id is null")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte inside a 200-byte string that occurs again; parts of characters at a cut go with it.

    A document of which nothing is left is dropped, unless it was empty before. A null text stays null; of repeated
    rows every one loses what they share.
    """
    whole_text_rows(spark)
    out = remove_repeated_bytes(docs.select(*COLUMNS), as_text=True)
    out = out.select("row.doc_id", F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text"), "row.lang", "row.source", "n_removed")
    out = out.where("n_removed = 0 or text <> ''")
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of ten consecutive words of a benchmark item.

    Null and empty texts, and all if the benchmark is empty, stay; repeated rows stay or go together.
    """
    whole_text_rows(spark)
    out = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return out.where(F.size("hits") == 0).select("row.*").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, ids (BPE), n_tokens and the SHA-256 of the text that the ids decode to.

    Null and empty texts have no ids and the digest of the empty text; repeated rows each give a row.
    """
    whole_text_rows(spark)
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    out = encode(docs.select(*COLUMNS), path, decoded="decoded")
    return out.select("row.doc_id", "row.source", "row.lang", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", tokens),
]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written as Parquet to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
