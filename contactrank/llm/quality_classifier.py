"""Operator 7: quality classifier by positive-unlabelled learning.

A logistic model over text-shape features is fitted on trusted positives (training rows labelled 1) and on all
unlabelled web text, by the non-negative unbiased risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). While the
second term is not negative the risk is convex for the logistic loss, and a Newton step is taken; a step that takes the term below zero
is halved until it does not. So where the term is clipped, the fit stops early at that boundary and does not go on along it, as
beyond it only the positives' own loss would fall. The class prior is estimated as the share of label 1 among labelled training rows; labels
0 have no other use.

Features of every training text are made once and written, two bytes each, to the checkpoint folder; mean, scale and each step's
gradient and curvature are sums over all of them, added up by Spark, of which about 9,000 numbers reach the driver. Of
the trusted positives at most `max_positive` (a parameter) are used, chosen by a hash of the id; no text is shuffled. Scoring is one pass
over all whole texts without a shuffle.

Features of a text: relative frequencies of pairs of byte classes (lower case, upper case, digit, space, line break,
common punctuation, other symbols one by one, multi-byte), logarithms of its words, lines and word length, and shares
of words that repeat the one before, of distinct words and of repeated lines.

Defined results: null and empty texts have zero features and get a score like any other; duplicates of a label row
count once, with the larger label; repeated rows weigh as often as they occur; without positives or unlabelled rows every
score is the prior, or 0.5 without labels; an empty table gives no scores; other columns come back in `row`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm import fingerprints as P
from contactrank.llm.blocks import lean_map, slices
from contactrank.llm.components import checkpoint, release

MAX_POSITIVE = 8_000

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\f", "\n\r", ".,;:'\"-()?", "!", "#*$%&", "|<>{}[]\\/@_=+^~`"], 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 10
_N_CLASS = 11
_MORE = 8
N_FEATURES = _N_CLASS * _N_CLASS + _MORE


def features(texts: pa.Array) -> np.ndarray:
    data, offsets = P.concat(texts)
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, N_FEATURES), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    kind = _CLASS[data]
    same = doc[1:] == doc[:-1]
    pairs = np.bincount(((doc[:-1] * _N_CLASS + kind[:-1]) * _N_CLASS + kind[1:])[same], minlength=n_docs * _N_CLASS**2).reshape(n_docs, -1)
    size = np.maximum(np.diff(offsets), 1)
    out[:, : _N_CLASS**2] = np.sqrt(pairs / size[:, None])
    words = P.Words(data, offsets)
    n = np.maximum(np.diff(words.first), 1)
    prints = words.fingerprints()
    again = np.zeros(len(words), bool)
    again[1:] = (prints[1:] == prints[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((prints, words.doc))
    first = np.ones(len(words), bool)
    first[1:] = (prints[order][1:] != prints[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    distinct = np.bincount(words.doc[order], weights=first, minlength=n_docs)
    breaks = data == 10
    lines = np.bincount(doc, weights=breaks, minlength=n_docs) + 1
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(breaks[:-1]) + 1]))
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[doc[starts] + 1])
    line = P.byte_windows(data, starts, ends - starts)
    order = np.lexsort((line, doc[starts]))
    line_first = np.ones(len(starts), bool)
    line_first[1:] = (line[order][1:] != line[order][:-1]) | (doc[starts][order][1:] != doc[starts][order][:-1])
    distinct_lines = np.bincount(doc[starts][order], weights=line_first, minlength=n_docs)
    more = [np.log1p(np.diff(words.first)) / 10, np.log1p(lines) / 10, np.bincount(words.doc, weights=words.end - words.start, minlength=n_docs) / n / 20, np.bincount(words.doc, weights=again, minlength=n_docs) / n, distinct / n, distinct_lines / lines, np.minimum(n / lines / 50, 2), (distinct / n) ** 2]
    out[:, _N_CLASS**2 :] = np.stack(more, axis=1)
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float):
        self.mean, self.scale, self.weight, self.bias = mean, scale, weight, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as the model sees them, and a constant for the bias."""
    return np.append(np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1)), axis=1)


def logistic_sums(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the loss log(1 + exp(z)) of taking rows for negatives: sum, gradient and upper half of the curvature, in a row."""
    z = np.clip(x @ weight, -30, 30)
    s = 1 / (1 + np.exp(-z))
    curvature = x.T @ (x * (s * (1 - s))[:, None])
    return np.concatenate([[np.logaddexp(0, z).sum()], x.T @ s, curvature[np.triu_indices(len(weight))]])


def _summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a function of the block's features that gives a row of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("x"):
                some = of(np.frombuffer(data.as_buffer(), np.float16).reshape(-1, N_FEATURES).astype(np.float64))
                total = some if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    got = blocks.mapInArrow(lean_map(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toArrow()
    return got["v"].to_numpy()


def risk(unlabelled: np.ndarray, n: float, positive: np.ndarray, weight: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(second term of the risk, gradient of the whole risk, its curvature), given logistic_sums of n unlabelled rows."""
    d = len(weight)
    p = logistic_sums(positive, weight) / len(positive)
    u = unlabelled / n
    second = u[0] - prior * p[0]
    curvature = np.zeros((d, d))
    curvature[np.triu_indices(d)] = u[1 + d :]
    curvature = curvature + np.triu(curvature, 1).T
    ridge = np.full(d, decay)
    ridge[-1] = 0
    # log(1 + exp(-z)) - log(1 + exp(z)) = -z: what positives add to the two terms is linear
    return second, u[1 : 1 + d] - prior * positive.mean(axis=0) + ridge * weight, curvature + np.diag(ridge + 1e-9)


def fit(positive: np.ndarray, unlabelled: DataFrame, prior: float, steps: int = 16, ridge: float = 200.0) -> Model:
    """Minimises the non-negative unbiased risk; unlabelled: blocks of features (see _feature_blocks).

    ridge: a prior on the scaled weights, worth so many rows: a few rows of an odd kind do not make it a bad one.
    """
    constant = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    none = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), constant)
    if not len(positive):
        return none
    sums = _summed(unlabelled, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if not len(sums):
        return none
    n, mean = sums[0], sums[1 : 1 + N_FEATURES] / sums[0]
    scale = np.maximum(np.sqrt(np.maximum(sums[1 + N_FEATURES :] / n - mean**2, 0)), 1e-3)
    p, weight = scaled(positive.astype(np.float64), mean, scale), np.append(np.zeros(N_FEATURES), constant)
    best, step = weight, np.zeros(N_FEATURES + 1)
    for _ in range(steps):
        of = _summed(unlabelled, lambda x, w=weight: logistic_sums(scaled(x, mean, scale), w))
        second, gradient, curvature = risk(of, n, p, weight, prior, ridge / n)
        if second < 0:  # further down the risk is only what the model has learned by heart
            step = step / 2
        else:
            best, step = weight, np.linalg.solve(curvature, gradient)
            step *= min(1.0, 4 / max(1e-12, float(np.abs(step).max())))  # not far outside of where the curvature was taken
        if np.abs(step).max() < 1e-2:
            break
        weight = best - step
    return Model(mean, scale, best[:-1], float(best[-1]))


def _feature_blocks(docs: DataFrame, text: str) -> DataFrame:
    """x: features of some rows each, two bytes a number, in the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([np.minimum(features(part), 6e4).astype(np.float16).tobytes()], pa.binary())], ["x"])

    return checkpoint(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(lean_map(run), "x binary"))


def _sample(docs: DataFrame, known: DataFrame, id_col: str, text: str, n: int) -> np.ndarray:
    """Features of the n rows with ids in `known` that come first by a hash of the id, or of all.

    The ids are chosen before any text is read, from narrow rows; n of them at most are sent to all tasks, and the texts
    stay where they are.
    """
    hashed = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)).alias("h")
    ids = docs.select(id_col).join(known.select(id_col), id_col, "left_semi").distinct()
    chosen = ids.select(id_col, hashed).orderBy("h", id_col).limit(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column("text")):
                x = features(part)
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(done, len(part)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], ["h", "x"])
                done += len(part)

    rows = docs.join(F.broadcast(chosen), id_col).select("h", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(lean_map(run), "h long, x array<float>")
    got = rows.orderBy("h", "x").limit(n).select("x").toArrow()["x"].combine_chunks()
    flat = got.flatten().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0, np.float32)
    return flat.reshape(-1, N_FEATURES)


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_positive: int = MAX_POSITIVE) -> Model:
    """labels: rows (id, label). Only rows where `train` (a column over the id) is true are read."""
    known = labels.where(F.coalesce(train, F.lit(True))).where(F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_label"))
    prior = known.agg(F.avg("_label")).first()[0]
    rows = docs.where(F.coalesce(train, F.lit(True))).select(id_col, text)
    positive = _sample(rows, known.where("_label = 1"), id_col, text, max_positive)
    blocks = _feature_blocks(rows, text)
    model = fit(positive, blocks, 0.5 if prior is None else float(prior))
    release(blocks)
    return model


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row and score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(pc.struct_field(batch.column("row"), text)):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(done, len(part)), pa.array(shared.value.score(features(part)).astype(np.float64))], ["row", "score"])
                done += len(part)

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(lean_map(run), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
