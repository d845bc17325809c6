"""Operator 5: language identification with language-bitmask n-gram filters.

One table of Bloom slots serves all languages: a slot is a bit mask with a bit per language (bit-sliced filters), an
n-gram sets its languages' bits in HASHES slots, and the conjunction of these slots is the mask of all languages that
hold the n-gram. A text's n-grams are looked up at once; per language the set bits are counted, and the count is
corrected for the share p of foreign n-grams that pass a filter by chance: (count - n p) / (1 - p). The highest
corrected share of the text's n-grams decides.

Learning counts every training document: distinct n-grams per task, added up per language and n-gram. A filter takes
n-grams with at least MIN_SHARE of their language's occurrences and MIN_RATIO of the share that they have in the
language where they are most common, so stray foreign words stay out. At most 1 / MIN_SHARE n-grams of a language can
pass, which bounds the table that is sent to the tasks, whatever the corpus.

N-grams are 4 bytes of lower-cased UTF-8 inside a word, with or without the place before and after it.

Defined results: null texts and texts without a letter are `und` with score 0; a text with letters that no filter
knows gets the language with most training documents, and score 0; rows without a language teach nothing; repeated
rows count as often as they occur; without any training row every prediction is `und`; columns come back in `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm import fingerprints as P
from contactrank.llm.blocks import slices

_U = np.uint64
HASHES = 3
MIN_SHARE = 2e-6
MIN_RATIO = 0.05
#: Slots per n-gram: with 3 hashes about 1 % of foreign n-grams pass.
SLOTS_PER_GRAM = 12


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document number, n-gram as a number of 4 bytes)."""
    data, offsets = P.concat(pc.utf8_lower(texts.cast(pa.large_string())))
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.where(letter, data, 32).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    gram = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = letter[1:-2] & letter[2:-1] & (doc[:-3] == doc[3:])
    return doc[:-3][ok], gram[ok]


class MaskFilter:
    """Bit-sliced Bloom filters of many languages in one table."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray], fallback: str | None):
        self.languages, self.fallback = languages, fallback
        n = sum(len(g) for g in grams.values())
        self.bits = max(10, int(n * SLOTS_PER_GRAM).bit_length())
        self.words = [np.zeros(1 << self.bits, np.uint64) for _ in range(0, max(1, len(languages)), 64)]
        for k, language in enumerate(languages):
            for slot in self.slots(grams[language]):
                self.words[k // 64][slot] |= _U(1 << k % 64)
        self.passing = [float(np.mean((w >> _U(k % 64)) & _U(1))) ** HASHES for k in range(len(languages)) for w in [self.words[k // 64]]]

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        h = P.mix(grams.astype(np.uint64) + _U(0x51ED))
        return [(h * _U(2 * k + 1) + _U(k) >> _U(64 - self.bits)).astype(np.int64) for k in range(HASHES)]

    def shares(self, doc: np.ndarray, grams: np.ndarray, n_docs: int) -> np.ndarray:
        """Per document and language the corrected share of n-grams that the language holds."""
        uniq, inverse = np.unique(grams, return_inverse=True)
        slots = self.slots(uniq)
        n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
        out = np.zeros((n_docs, len(self.languages)))
        for w, table in enumerate(self.words):
            mask = table[slots[0]]
            for s in slots[1:]:
                mask = mask & table[s]
            for k in range(64 * w, min(64 * (w + 1), len(self.languages))):
                has = ((mask >> _U(k % 64)) & _U(1)).astype(np.float64)[inverse]
                count = np.bincount(doc, weights=has, minlength=n_docs)
                out[:, k] = (count - n * self.passing[k]) / (1 - self.passing[k])
        return np.clip(out / n[:, None], 0, 1)


def learn_filter(docs: DataFrame, text: str, lang: str) -> MaskFilter:
    """Counts n-grams of all the given documents by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[str, np.ndarray]] = {}
        for batch in batches:
            done = 0
            names = np.array(batch.column("lang").to_pylist(), object)
            for part in slices(batch.column("text")):
                own = names[done : done + len(part)]
                done += len(part)
                doc, grams = ngrams(part)
                for name in set(own):
                    keys, n = np.unique(grams[(own == name)[doc]], return_counts=True)
                    if name in sums:
                        keys, inverse = np.unique(np.concatenate([sums[name]["k"], keys]), return_inverse=True)
                        n = np.bincount(inverse, weights=np.concatenate([sums[name]["n"], n])).astype(np.int64)
                    sums[name] = {"k": keys, "n": n}
        for name, s in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(s["k"]), pa.string()), "gram": pa.array(s["k"].astype(np.int64)), "n": pa.array(s["n"].astype(np.int64))})

    rows = docs.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("lang is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= MIN_SHARE)
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    chosen = share.join(top, "gram").where(F.col("share") >= MIN_RATIO * F.col("top")).groupBy("gram").agg(F.collect_set("lang").alias("langs"))
    documents = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(documents)
    grams: dict[str, list[int]] = {x: [] for x in languages}
    for r in chosen.toLocalIterator():  # at most 1 / MIN_SHARE of a language
        for x in r["langs"]:
            grams[x].append(r["gram"])
    return MaskFilter(languages, {x: np.array(g, np.uint32) for x, g in grams.items()}, max(languages, key=lambda x: (documents[x], x), default=None))


def predict_language(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """row, lang_pred and score (the winning language's corrected share). `lang` is read only where train is true."""
    model = learn_filter(docs.where(F.coalesce(train, F.lit(True))), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            done = 0
            for part in slices(pc.struct_field(batch.column("row"), text)):
                letters = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                names, best = np.full(len(part), "und", object), np.zeros(len(part))
                if model.languages:
                    share = model.shares(*ngrams(part), len(part))
                    first = share.argmax(axis=1)
                    best = np.where(letters, share[np.arange(len(part)), first], 0.0)
                    names[letters] = np.where(best > 0, np.array(model.languages, object)[first], model.fallback)[letters]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(done, len(part)), pa.array(names, pa.string()), pa.array(best)], ["row", "lang_pred", "score"])
                done += len(part)

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(predict, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
