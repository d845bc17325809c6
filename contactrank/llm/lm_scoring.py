"""Operator 3: language-model scoring with a weighted backoff automaton of three orders.

States are the root, one per token seen in training and one per pair of tokens seen there at least twice. A state has an arc per token
seen after it, whose weight is the smoothed log-probability, and a failure arc to the state without its oldest token,
whose weight is the mass that it keeps for anything else; the root has an arc per known token and one for unknown ones.
Smoothing is by Dirichlet priors, order by order: P(w) = (c(w) + 1) / (N + V + 1), P(w | h) = (c(h, w) + beta P(w | h'))
/ (c(h) + beta) with h' the shorter context, so arcs and failure arc of a state sum to one; every n-gram of the
training texts whose context is a state is in the automaton, which grows with them.

It is nowhere whole. A block of documents asks for the arcs that its texts can take, with their counts if they are in
training documents: first its distinct tokens, as text, and its distinct pairs, by hash; then the triples that begin
with a state. Buckets add up the counts of all blocks and answer those who asked. Then the block's documents are walked
from left to right, side by side, a token a step: each carries its state, takes the arc or follows failure arcs down to
one, and adds up the weights.

Tokens are compared as text, but for V, the number of distinct ones, which counts 64-bit digests. Pairs and triples are 64-bit hashes of their tokens' digests, cut to SPARE_BITS more
than the number of tokens has: about one n-gram in 2**SPARE_BITS shares the count of another.

Defined results: null and empty texts are the end token alone; rows whose `train` is null count as training; repeated
rows count as often as they occur; an empty table gives none; other columns come back in `row`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm import blocks as B
from contactrank.llm import fingerprints as P

_U = np.uint64
_BLOCK = 6 << 20
SPARE_BITS = 16


class Tokens:
    """Tokens of a block, an end token after each document's words: document and number of each, and the distinct ones in an order of their digests."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        data, offsets = P.concat(texts)
        words = P.Words(P.lower_ascii(data), offsets)
        number, distinct = P.dictionary(words)
        self.length = np.diff(words.first) + 1
        self.doc = np.repeat(np.arange(len(self.length)), self.length)
        self.end = np.cumsum(self.length) - 1
        inner = np.ones(len(self.doc), bool)
        inner[self.end] = False
        # no word holds white space: one space stands for the end
        distinct = pa.concat_arrays([distinct.cast(pa.large_binary()), pa.array([b" "], pa.large_binary())])
        digests = P.strong(distinct)
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.digest, self.distinct = digests[order, 0], distinct.take(pa.array(order))
        self.number = np.full(len(self.doc), rank[-1])
        self.number[inner] = rank[number]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pair and the triple that end at each token; a document begins after an end token, and its first triple stands for nothing."""
        key = self.digest[self.number]
        start = self.end - self.length + 1
        before = np.concatenate([key[:1], key[:-1]])
        before[start] = key[self.end[0]] if len(self.end) else 0
        pair = P.mix(before ^ P.mix(key + _U(0x9E3779B97F4A7C15)))
        first = np.concatenate([pair[:1], pair[:-1]])
        triple = P.mix(first ^ P.mix(key + _U(0xD6E8FEB86659FD93)))
        triple[start] = P.mix(pair[start] + _U(1))
        return pair, triple


#: So many documents or fewer are walked one by one.
FEW = 24


def training_size(docs: DataFrame, train: Column, text: str, n_buckets: int) -> tuple[int, int]:
    """Number of tokens in training documents, end tokens among them, and of distinct ones (by their digests)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch.column(0), 4 << 20):
                tokens = Tokens(part)
                keys = tokens.digest if (tokens.number == len(tokens.digest) - 1).any() else tokens.digest[:0]
                sent = [(b, len(tokens.number) if lo == 0 else 0, B.pack(keys[lo:hi])) for b, lo, hi in B.runs(B.even_bucket(keys, n_buckets))]
                yield from B.messages(sent).to_batches()

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.concatenate([B.unpack(d) for d in B.opened(table["data"].to_pylist())])
        return pa.table({"n": pa.array([pc.sum(table["block"]).as_py()]), "v": pa.array([len(np.unique(keys))])})

    rows = docs.where(F.coalesce(train, F.lit(True))).select(text).mapInArrow(send, B.MESSAGE)
    got = rows.groupBy("bucket").applyInArrow(B.lean(distinct), "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return got[0] or 0, got[1] or 0


def _count_tokens(data: list[bytes]) -> list[bytes]:
    """Counts of each block's tokens over all blocks, compared as text."""
    asked = [pickle.loads(d) for d in data]
    tokens = pa.concat_arrays([t for t, _ in asked]).dictionary_encode()
    which, counts = tokens.indices.to_numpy(), np.concatenate([n for _, n in asked])
    total = np.zeros(len(tokens.dictionary), np.int64)
    np.add.at(total, which, counts)
    return [B.planes(x) for x in np.split(total[which], np.cumsum([len(n) for _, n in asked])[:-1])]


def traverse(length: np.ndarray, start: int, target: np.ndarray, arcs: np.ndarray, has: np.ndarray, failure: np.ndarray) -> np.ndarray:
    """Log-probability of each document, walked from left to right, all documents a step at a time; the last few one by one.

    start: order of the first state; target: of the longest state that ends with the token; arcs, has, failure (order,
    token): weight of the arc that the state of this order has for the token, whether it has one, and the weight of the
    state's failure arc.
    """
    # what each state does with each token: over its arc, or over failure arcs to a state that has one
    gain, after = np.empty((3, len(target))), np.empty((3, len(target)), np.int8)
    gain[0], used = arcs[0], np.zeros(len(target), np.int8)
    after[0] = np.minimum(1, target)
    for order in (1, 2):
        gain[order] = np.where(has[order], arcs[order], failure[order] + gain[order - 1])
        used = np.where(has[order], np.int8(order), used)
        after[order] = np.minimum(used + 1, target)
    place = np.cumsum(length) - length
    by_length = np.argsort(-length, kind="stable")
    lanes = np.searchsorted(-length[by_length], -np.arange(length.max(initial=0)), side="left")  # documents with more than t tokens
    state = np.full(len(length), start)
    score, at = np.zeros(len(length)), place[by_length]
    done = int(np.searchsorted(-lanes, -FEW, side="right"))
    for t, n in enumerate(lanes[:done].tolist()):
        p, now = at[:n] + t, state[:n]
        score[:n] += gain[now, p]
        state[:n] = after[now, p]
    for k in range(int(lanes[done]) if done < len(lanes) else 0):
        of = slice(int(at[k]) + done, int(at[k] + length[by_length[k]]))
        now, total, gains, states = int(state[k]), 0.0, gain[:, of].tolist(), after[:, of].tolist()
        for i in range(of.stop - of.start):
            total += gains[now][i]
            now = states[now][i]
        score[k] += total
    out = np.empty(len(length))
    out[by_length] = score
    return out


def lm_score(docs: DataFrame, train: Column, text: str = "text", beta: tuple[float, float] = (300.0, 60.0)) -> DataFrame:
    """row, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (the automaton's log10 probability).

    beta: weight of the shorter context for pairs and for triples.
    """
    total = B.total_bytes(docs, text)
    n, n_tokens = B.n_buckets(total / 4), B.n_buckets(total / 100)
    n_train, n_distinct = training_size(docs, train, text, n_tokens)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(train, F.lit(True)).alias("train"))
    rows = B.in_blocks(rows, total, _BLOCK)
    shift = _U(max(0, 64 - SPARE_BITS - max(20, int(total // 4).bit_length())))

    def trained(table: pa.Table, tokens: Tokens) -> np.ndarray:
        return table["train"].combine_chunks().to_numpy(zero_copy_only=False)[tokens.doc].astype(np.int64)

    def short(keys: np.ndarray) -> np.ndarray:
        return keys >> shift << shift

    def counts_before(tokens: Tokens, c: np.ndarray, at_start: float) -> np.ndarray:
        before = np.concatenate([c[:1], c[:-1]])
        before[tokens.end - tokens.length + 1] = at_start
        return before

    def send(key: tuple, table: pa.Table) -> pa.Table:
        tokens, block = Tokens(pc.struct_field(table["row"], text)), key[0].as_py()
        taught = trained(table, tokens)
        asked = B.ask(block, short(tokens.grams()[0]), lambda k: B.even_bucket(k, n), counts=taught)
        counts = np.zeros(len(tokens.distinct), np.int64)
        np.add.at(counts, tokens.number, taught)
        words = tokens.distinct.cast(pa.binary())
        more = [(n + b, block, pickle.dumps((words.take(pa.array(np.arange(lo, hi))), counts[lo:hi]))) for b, lo, hi in B.runs(B.even_bucket(tokens.digest, n_tokens))]
        return pa.concat_tables([asked, B.messages(more)])

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        data = B.opened(table["data"].to_pylist())
        counts = _count_tokens(data) if key[0].as_py() >= n else B.counter()(data)
        return table.set_column(2, "data", pa.array(B.closed(counts), pa.binary())).select(["bucket", "block", "data"])

    def part(answers: pa.Table, low: int, high: int) -> pa.Table:
        return answers.filter(pc.and_(pc.greater_equal(answers["bucket"], low), pc.less(answers["bucket"], high)))

    def states(tokens: Tokens, pair: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pairs that end at each token, and of those before them where these are states."""
        c2 = B.counts_for(short(pair), part(answers, 0, n))
        before = counts_before(tokens, c2, 0)
        return c2, np.where(before > 1, before, 0)

    def send_triples(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(pc.struct_field(table["row"], text))
        pair, triple = tokens.grams()
        some = states(tokens, pair, answers)[1] > 0
        return B.ask(key[0].as_py(), short(triple[some]), lambda k: B.even_bucket(k, n), counts=trained(table, tokens)[some])

    def walk(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(pc.struct_field(table["row"], text))
        pair, triple = tokens.grams()
        c2, h2 = states(tokens, pair, answers)
        c3 = np.zeros(len(c2))
        c3[h2 > 0] = B.counts_for(short(triple[h2 > 0]), part(answers, n + n_tokens, 2 * n + n_tokens))
        distinct = np.concatenate([B.counts_in(d) for d in B.answers_of(part(answers, n, n + n_tokens))]).astype(np.float64)
        c1 = distinct[tokens.number]
        of_end = distinct[tokens.number[tokens.end[0]]]
        h1 = counts_before(tokens, c1, of_end)
        p1 = (c1 + 1) / (n_train + n_distinct + 1)
        p2 = (c2 + beta[0] * p1) / (h1 + beta[0])
        p3 = (c3 + beta[1] * p2) / (h2 + beta[1])
        target = np.where(c2 > 1, 2, (c1 > 0).astype(np.int64))
        failure = np.log10(np.stack([np.ones(len(h1)), beta[0] / (h1 + beta[0]), beta[1] / (h2 + beta[1])]))
        score = traverse(tokens.length, int(of_end > 0), target, np.log10(np.stack([p1, p2, p3])), np.stack([np.ones(len(c1), bool), c2 > 0, c3 > 0]), failure)
        size = table.num_rows
        out = {"n_tokens": tokens.length, "n_known": np.bincount(tokens.doc, weights=c1 > 0, minlength=size).astype(np.int64), "train_tokens": np.full(size, n_train), "base_score": np.bincount(tokens.doc, weights=np.log10(p1), minlength=size), "score": score}
        return pa.table({"row": table["row"], **out})

    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    by_block = rows.groupBy("block")
    replies = by_block.applyInArrow(B.lean(send), B.MESSAGE).groupBy("bucket").applyInArrow(B.lean(decide), B.MESSAGE)
    triples = B.answer(by_block.cogroup(replies.groupBy("block")).applyInArrow(B.lean(send_triples), B.MESSAGE), B.counter())
    replies = replies.union(triples.withColumn("bucket", F.col("bucket") + n + n_tokens))
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(B.lean(walk), schema)
