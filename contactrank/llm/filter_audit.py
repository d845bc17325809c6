"""Operator 12: an audit of how filters interact, by wide packed counters.

A document's failed filters are a mask of k bits. Its way through every order of the filters follows from the mask alone:
a failed filter that comes first removes it, later ones are redundant. So each of the 2**k masks is mapped to one
integer, whose 64-bit fields hold a one for everything that happens: removed at (order, step), redundant at (order, step),
failed by this filter only, and counted at all. The integers of a part's documents are added up; the sum of n equal ones
is n times one of them. No field exceeds the number of documents, which is a 64-bit number, so none runs over into the
next, and the sum is cut into its fields again. Documents of a kind to be watched (of good quality, toxic) have sums of
their own.

Spark counts the documents of each part, mask and kind, with partial counts per task before the shuffle; a part then has
at most 2**k * 2**kinds rows, so one row of bounded size holds what its sum needs, however hot the part is.

Defined results: null flags count as passed, or as not of the kind; a null part is a part of its own; repeated rows count
each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_BYTES = 8
MAX_FILTERS = 6


@cache
def packed(k: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """All orders of k filters, and the integer of each mask: fields (order, step) of removals, then of redundant failures, k of sole failures, one of all."""
    orders = list(permutations(range(k)))
    steps = len(orders) * k
    one = lambda at: 1 << (8 * FIELD_BYTES * at)
    out = []
    for mask in range(1 << k):
        value = one(2 * steps + k)
        if mask.bit_count() == 1:
            value += one(2 * steps + mask.bit_length() - 1)
        for o, order in enumerate(orders):
            failed = [step for step, f in enumerate(order) if mask >> f & 1]
            for i, step in enumerate(failed):
                value += one(o * k + step + (steps if i else 0))
        out.append(value)
    return orders, out


def unpack(value: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Removals and redundant failures by (order, step), sole failures by filter, and the number of documents."""
    n = len(packed(k)[0])
    fields = np.frombuffer(value.to_bytes(FIELD_BYTES * (2 * n * k + k + 1), "little"), "<i8")
    return fields[: n * k].reshape(n, k), fields[n * k : 2 * n * k].reshape(n, k), fields[2 * n * k : -1], int(fields[-1])


def interactions(rows: DataFrame, fails: list[str], part: str = "part", lost: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """part, filter_order, step (from 1), kept, removed, redundant, unique_fails, one column per kind in `lost`, shapley.

    fails: boolean columns with one-letter names, in the order of the mask's bits; lost: boolean columns, of which the
    removed documents are counted; weight: documents that a row stands for (one, if there is none).
    """
    k = len(fails)
    if not 0 < k <= MAX_FILTERS or len(set(fails)) < k:
        raise ValueError(f"one to {MAX_FILTERS} different filters")
    on = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    mask = sum((F.when(on(f), 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    kind = sum((F.when(on(c), 1 << i).otherwise(0) for i, c in enumerate(lost)), F.lit(0))
    number = F.sum(weight).cast("long") if weight else F.count("*")
    counts = rows.select(F.col(part).cast("string").alias("part"), mask.cast("int").alias("mask"), kind.cast("int").alias("kind"), *([weight] if weight else [])).groupBy("part", "mask", "kind").agg(number.alias("n"))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "kind", "n")).alias("counts"))  # 2**k * 2**kinds at most
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", *lost, "shapley"))])

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, integers = packed(k)
        filters = np.array(orders)
        names = ["".join(fails[f] for f in order) for order in orders for _ in order]
        steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for of, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, watched = 0, [0] * len(lost)
                for c in counts:
                    add = integers[c["mask"]] * c["n"]
                    total += add
                    for i in range(len(lost)):
                        if c["kind"] >> i & 1:
                            watched[i] += add
                removed, redundant, sole, n = unpack(total, k)
                shares = np.zeros(k, np.int64)
                np.add.at(shares, filters, removed)
                columns = [n - removed.cumsum(axis=1), removed, redundant, sole[filters], *(unpack(w, k)[0] for w in watched), shares[filters]]
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(names), pa.string()), pa.array(names), pa.array(steps), *(pa.array(c.reshape(-1), pa.int64()) for c in columns)], schema=schema)

    kinds = ", ".join(f"`{c}` long" for c in lost)
    return by_part.mapInArrow(outcomes, f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, {kinds}{', ' * bool(lost)}shapley long")


def mark_copies(rows: DataFrame, text: Column, key: str, by: list[str], out: str) -> DataFrame:
    """by, n and `out`: the rows counted by the columns `by`, and by whether a smaller key has the same text in any row.

    Texts are told apart by SHA-256. Rows of a text are first counted by `by`, so that the rows of a hot text shrink to
    those of its combinations before they meet. Null keys are no smaller and have no smaller; equal keys neither.
    """
    each = rows.select(*by, F.col(key).alias("_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text")).groupBy("_text", *by, "_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
    each = each.groupBy("_text", *by).agg(first.alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    least = each.groupBy("_text").agg(F.min("first._id").alias("least"))
    own = F.col("no_id") + F.when(F.col("first._id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias(out), own.alias("n")), F.struct(F.lit(True).alias(out), (F.col("n") - own).alias("n")))
    return each.join(least, "_text").select(*by, F.explode(both).alias("_b")).select(*by, "_b.*").where("n > 0")
