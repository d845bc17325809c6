"""Blocks of documents and the exchange of their distinct fingerprints.

Documents are dealt into blocks of a few MB by a hash of the whole row. A block sends its *distinct*
fingerprints, sorted, to buckets of the key space; a bucket sees every block's share of its keys, decides,
and answers in the order in which it was asked. The block sorts its keys again and knows the answers'
places, so neither positions nor texts travel. A key that occurs a billion times costs one entry per block.

The documents' exchange appears once or more in such a plan with the same shape, so Spark reuses it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 3 << 20
#: Keys that one bucket holds in memory, at 8 to 48 bytes each. Larger inputs get larger buckets, up to a bound. A message
#: holds (keys of a block) * (keys of a bucket) / (all keys): for operator 1 about 60 at 50 GB of text and 2 at 170 TB,
#: where a key then costs 20 bytes instead of 6.
BUCKET_KEYS = 400_000
MAX_BUCKET_KEYS = 16_000_000

MESSAGE = "bucket long, block long, data binary"


def whole_text_rows(spark: SparkSession) -> None:
    """Arrow batches of few rows: a row is a whole document, and a batch is held in memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def trim() -> None:
    """Gives the system what Arrow and the C library keep of freed memory: a worker outlives the stages that needed it."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def lean(f: Callable) -> Callable:
    """A function for a group, or for a pair of groups, that trims memory when it has its result."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return f(key, table)
        finally:
            trim()

    def two(key: tuple, table: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return f(key, table, other)
        finally:
            trim()

    return one if f.__code__.co_argcount == 2 else two


def lean_map(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for all batches of a task that trims memory when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """Runs of texts of about `size` bytes, so that the arrays made from them stay small."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    begin = 0
    while begin < len(texts):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + size, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def spread(docs: DataFrame) -> DataFrame:
    """Deals rows anew where fewer tasks than cores hold any, as with a table of one row group; else as they are."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.groupBy(F.spark_partition_id()).count().count() >= n else docs.repartition(n)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one number to the driver."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def in_blocks(docs: DataFrame, n_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds `block`. The hash is over all columns and the input's partition, so neither copies of a text with other ids
    nor equal rows of a large input go to one block. Blocks grow with the cube root of inputs over 50 GB, up to 8 times.
    """
    block_bytes *= min(8.0, max(1.0, (n_bytes / 5e10) ** (1 / 3)))
    n = max(8, int(-(-n_bytes // block_bytes)))
    return docs.withColumn("block", F.pmod(F.xxhash64(*_hashable(docs), F.spark_partition_id()), F.lit(n)))


def _hashable(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]


def bucket_keys(keys: float) -> int:
    return int(min(MAX_BUCKET_KEYS, max(BUCKET_KEYS, 40 * keys**0.5)))


def n_buckets(keys: float, per_bucket: int | None = None) -> int:
    return int(max(16, -(-keys // (per_bucket or bucket_keys(keys)))))


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit integers as differences, byte plane after byte plane: the upper planes are zeros and compress away."""
    steps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    if len(keys) > 1:  # the first stays apart, so that it doesn't fill the upper planes
        return keys[:1].tobytes() + np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8).T).tobytes()
    return keys.tobytes()


def unpack(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= 8:
        return raw.view(np.uint64).copy()
    steps = np.empty(len(raw) // 8, np.uint64)
    steps[:1] = raw[:8].view(np.uint64)
    steps[1:] = np.ascontiguousarray(raw[8:].reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


def even_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets that are equal ranges of the key space, in key order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def closed(data: Iterable[bytes]) -> list[bytes]:
    """Compressed: the bits of sorted keys' differences are uneven, which Spark's own codec, without an entropy code, leaves as they are."""
    codec = zstandard.ZstdCompressor(level=1)
    return [codec.compress(bytes(d)) for d in data]


def opened(data: Iterable[bytes]) -> list[bytes]:
    codec = zstandard.ZstdDecompressor()
    return [codec.decompress(d) for d in data]


def messages(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array(closed(r[2] for r in rows), pa.binary())})


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of a sorted array's runs."""
    if not len(ids):
        return []
    cut = np.flatnonzero(np.diff(ids)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(ids)]])
    return [(int(ids[a]), int(a), int(b)) for a, b in zip(lo, hi, strict=True)]


def answer(asked: DataFrame, decide: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Runs decide(all messages of a bucket) -> one answer each, in order. A negative bucket only returns its message."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:
            table = table.set_column(2, "data", pa.array(closed(decide(opened(table["data"].to_pylist()))), pa.binary()))
        return table.select(["bucket", "block", "data"])

    return asked.groupBy("bucket").applyInArrow(lean(one), MESSAGE)


def answers_of(table: pa.Table) -> list[bytes]:
    """A block's answers in key order."""
    got = [(b, d) for b, d in zip(table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True) if b >= 0]
    return opened(d for _, d in sorted(got, key=lambda x: x[0]))


def planes(values: np.ndarray) -> bytes:
    """Counts as byte planes, as many as the largest needs (one byte says how many)."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def counts_in(data: bytes | memoryview) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(np.int64)


def keys_and_counts(data: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Number of keys, keys and counts of messages."""
    split = [(len(d) - 1) // (8 + d[0]) for d in data]
    keys = np.concatenate([unpack(memoryview(d)[1 + d[0] * n :]) for d, n in zip(data, split, strict=True)])
    counts = np.concatenate([counts_in(memoryview(d)[: 1 + d[0] * n]) for d, n in zip(data, split, strict=True)])
    return split, keys, counts


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of its key's counts for each key; sums are 64-bit integers."""
    uniq, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, inverse, counts)
    return total[inverse]


def counter() -> Callable[[list[bytes]], list[bytes]]:
    """decide() that answers each key with its count over all blocks."""

    def decide(data: list[bytes]) -> list[bytes]:
        split, keys, counts = keys_and_counts(data)
        return [planes(x) for x in np.split(totals(keys, counts), np.cumsum(split)[:-1])]

    return decide


def ask(block: int, keys: np.ndarray, bucket_of: Callable[[np.ndarray], np.ndarray], counts: np.ndarray | None = None, state: bytes | None = None) -> pa.Table:
    """Messages with a block's distinct keys and counts (of the occurrences, or their sums); state: what comes back to the block as it is."""
    if counts is None:
        uniq, n = np.unique(keys, return_counts=True)
    else:
        uniq, inverse = np.unique(keys, return_inverse=True)
        n = np.zeros(len(uniq), np.int64)
        np.add.at(n, inverse, counts)
    out = [(b, block, planes(n[lo:hi]) + pack(uniq[lo:hi])) for b, lo, hi in runs(bucket_of(uniq))]
    if state is not None:
        out.append((-1 - block, block, state))
    return messages(out)


def counts_for(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The corpus-wide count of each of the keys that the block asked for."""
    if not len(keys):
        return np.zeros(0, np.int64)
    _, inverse = np.unique(keys, return_inverse=True)
    return np.concatenate([counts_in(d) for d in answers_of(answers)])[inverse]


def state_of(answers: pa.Table) -> bytes:
    return next((opened([d])[0] for b, d in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True) if b < 0), b"")
