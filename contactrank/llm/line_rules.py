"""Operator 4: quality rules with cross-document line frequency, on native columns only.

A line is normalised (lower case, one space for white space, digits as 0) and hashed. A line is above the limit on a
host if it is in more than `max_share` of its distinct documents, and in more than `min_docs`. A host with fewer than
`min_host_docs` distinct documents has too few for a share of its own: there the line's share of all hosts' documents
counts. Lines above the limit are removed; a document that keeps less than `min_left` of its words is depleted and
rejected. Documents of equal text on a host count once.

A host with an average of m distinct lines a document has at most m / max_share lines above the limit, however many
documents it has; counting is a partial aggregation per task before its shuffle, and a hot host or line is one row
per task and partition. The table of these lines is sent to all tasks up to MAX_BROADCAST_BYTES, by its own size;
beyond, documents are dealt to it by host, and a host's documents to SALTS tasks.

Defined results: null text has no words and fails the base rules; a null host is a host of its own; repeated rows
are one document for the counts and each gives a row; an empty table gives none; columns come back in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactrank.llm.blocks import spread
from contactrank.llm.components import checkpoint

_SPACE = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
#: White space inside a line.
_INSIDE = r"[\x20\x09\x0B-\x0D]+"
#: Bytes of hosts and line hashes that are sent to all tasks.
MAX_BROADCAST_BYTES = 32 << 20
SALTS = 64


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(c, _SPLIT), "")


def _normal(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[1-9]", "0"), _INSIDE, " ")


def line_hashes(text: Column) -> Column:
    """Hash of each line with a word, normalised; the whole text is normalised at once."""
    lines = F.replace(F.replace(_normal(text), F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.transform(F.array_remove(F.split(F.trim(lines), "\n"), ""), lambda x: F.xxhash64(x))


def lines_above_limit(docs: DataFrame, text: str, host: str, max_share: float, min_docs: int, min_host_docs: int) -> DataFrame:
    """host and above: the hashes of its too frequent lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    once = docs.select(F.col(host).alias("host"), F.xxhash64(text).alias("th"), F.array_distinct(line_hashes(body)).alias("lines")).dropDuplicates(["host", "th"])
    total = once.groupBy("host").agg(F.count("*").alias("n_docs"))
    total = total.withColumn("all_docs", total.agg(F.sum("n_docs")).scalar())
    seen = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    # most lines are rare everywhere: only those over the least floor are looked at by host
    anywhere = seen.groupBy("line").agg(F.sum("n").alias("n_all")).where(F.col("n_all") > min_docs)
    known = seen.join(anywhere, "line").join(total.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    small = F.col("n_docs") < min_host_docs
    n, of = F.when(small, F.col("n_all")).otherwise(F.col("n")), F.when(small, F.col("all_docs")).otherwise(F.col("n_docs"))
    return known.where((n > min_docs) & (n > max_share * of)).groupBy("host").agg(F.collect_set("line").alias("above"))


def eight_words(hashes: Column) -> Column:
    """A hash of each 8-word window, from the array of word hashes."""
    windows = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, 8))))
    return F.when(F.size(hashes) >= 8, F.slice(windows, F.lit(1), F.size(hashes) - 7)).otherwise(F.array().cast("array<bigint>"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_share: float = 0.02, min_docs: int = 3, min_host_docs: int = 50, min_left: float = 0.5) -> DataFrame:
    """row, the base counts, n_left (words outside removed lines), base_failed, kept, clean_text (without removed lines)."""
    docs = spread(docs)
    above = checkpoint(lines_above_limit(docs, text, host, max_share, min_docs, min_host_docs))
    n_bytes = above.agg(F.sum(8 * F.size("above") + F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumn("_host", F.col(f"row.{host}"))
    if n_bytes <= MAX_BROADCAST_BYTES:
        rows = rows.join(F.broadcast(above), rows["_host"].eqNullSafe(above["host"]), "left").drop("_host", "host")
    else:
        salted = above.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(f"row.{text}"), F.lit(SALTS)))
        rows = rows.join(salted, rows["_host"].eqNullSafe(salted["host"]) & (rows["_salt"] == salted["salt"]), "left").drop("_host", "host", "_salt", "salt")
    touched = F.col("above").isNotNull() & F.arrays_overlap("above", line_hashes(body))
    rows = rows.select("row", words_of(body).alias("words"), F.split(body, "\n").alias("lines"), F.when(touched, F.col("above")).alias("above"))
    left = F.filter("lines", lambda x: ~F.array_contains("above", F.xxhash64(F.trim(_normal(x)))))
    full = F.filter("lines", lambda x: F.trim(x, F.lit(_SPACE)) != "")
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select("row", F.size("words").alias("n_words"), F.char_length(F.array_join("words", "")).alias("word_chars"), hashes.alias("hashes"), full.alias("full"), F.when(F.col("above").isNotNull(), F.array_join(left, "\n")).alias("left"))
    rows = rows.withColumn("eight", eight_words(F.col("hashes"))).drop("hashes")
    rows = rows.withColumn("tied", F.when(F.size(F.array_distinct("eight")) < F.size("eight"), F.sort_array(F.transform("eight", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    starts = F.filter("tied", lambda e, k: F.coalesce(F.get("tied", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("tied", k + 1)["h"] == e["h"], F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(starts, lambda e: e["i"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    repeat = F.aggregate("starts", zero, lambda a, i: F.struct((i + 8).alias("end"), (a["n"] + i + 8 - F.greatest(a["end"], i)).alias("n")))["n"]
    rows = rows.select(
        "row",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.col("left").isNull(), F.col("n_words")).otherwise(F.size(words_of(F.col("left")))).cast("long").alias("n_left"),
        F.coalesce("left", body).alias("clean_text"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_left") >= min_left * F.col("n_words")))
