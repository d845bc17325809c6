"""Strings of a fixed length that occur again anywhere, by sparse suffix trees: what operators 1 and 6 share.

A unit is a word or a byte, a window is `size` units of one document. Suffixes are sampled by content: a window's
sample place is that of its least gram (of a third of its units), by a hash. So any two equal windows hold a sample
place at the same offset, a difference cover whose residues the content chooses, and only sampled suffixes are sorted:
about 2 in size * 2 / 3 of all.

1. Every block sends the grams of its sample places; buckets of the hash space count them over all blocks. A suffix
   whose gram occurs once hangs as a leaf above the depth of interest and is dropped.
2. The others go, as text (the units that the windows around the place can have), to groups by their own first bytes:
   ranges of the byte order, cut at strings of variable length so that groups fit in memory. Equal texts of a block
   are sent once. A group sorts its suffixes, one subtree (gram) after the other in runs of bounded size; common-prefix lengths
   of neighbours give the inner nodes of each depth, and the same from right to left gives the ranks of what precedes
   the sample places. A window with `a` units before its place is repeated if its inner node at depth size - a has
   another leaf with the same rank at depth a. Texts are compared, not hashes.
3. A gram with more than `hot` occurrences has too large a subtree: its prefix is extended to the whole window, that
   is, its windows themselves are counted, by 128-bit BLAKE2 digests, a block's equal ones once.
4. Blocks get a bit per place and offset, and mark what the repeated windows cover.

Nothing depends on hashes but which suffixes are sampled or dropped as unique (equal grams have equal hashes), and 3,
where a false pair among n windows has a chance of n * n / 2**129.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm import blocks as B
from contactrank.llm import fingerprints as P

_U = np.uint64
#: Sampled suffixes that a group is planned for, and those of one gram from which its windows are counted one by one.
PER_GROUP = 40_000
HOT = 5_000
#: Units that a group sorts at once, and places or texts that are gathered at once: what bounds a worker's memory.
RUN_UNITS = 3_000_000
GATHERED = 4_000
#: Ranges of the byte order: their bounds are all that the driver knows. Larger inputs split each by the gram's hash.
MAX_RANGES = 2_000
#: Bytes of a gram that place it in the byte order.
_HEAD = 48
#: A gram's hash keeps so many bits more than the number of places has.
SPARE_BITS = 10
_STATE = -(1 << 40)

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Bytes:
    """A block of documents, byte by byte."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        self.data, self.first = P.concat(texts)

    def __len__(self) -> int:
        return len(self.data)

    def grams(self, size: int) -> np.ndarray:
        return P.grams(P.byte_values(self.data), size)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that hold all units, and where those of [start, end) lie in them."""
        return self.data, start, end

    @staticmethod
    def rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of texts as sortable numbers over 0, and the number of each text's."""
        return data + np.uint8(1), np.diff(offsets)  # UTF-8 has no byte 255


class Words:
    """A block of documents, word by word."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        self.words = P.Words(*P.concat(texts))
        self.first = self.words.first

    def __len__(self) -> int:
        return len(self.words)

    def grams(self, size: int) -> np.ndarray:
        return P.grams(self.words.fingerprints(), size)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain, at = self.plain
        return plain, at[start], at[end] - 1

    @cached_property
    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins."""
        w = self.words
        size = w.end - w.start
        at = np.cumsum(size + 1) - size - 1
        plain = np.full(int((size + 1).sum()), 32, np.uint8)
        plain[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())] = w.data[~P.SPACE[w.data]]
        return plain, np.append(at, len(plain))

    @staticmethod
    def rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = P.Words(data, offsets)
        return P.dictionary(words)[0].astype(np.int32) + 1, np.diff(words.first)


def _flat(data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray | None = None) -> pa.BinaryArray:
    """data[s:e] for each range, after two bytes of `head` if given."""
    more = 0 if head is None else 2
    size = end - start + more
    upto = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(upto[-1], np.uint8)
    for lo in range(0, len(start), GATHERED):
        hi = min(lo + GATHERED, len(start))
        take = np.repeat(start[lo:hi] - upto[lo:hi] - more, size[lo:hi]) + np.arange(upto[lo], upto[hi])
        flat[upto[lo] : upto[hi]] = data[np.maximum(take, 0)]
    if head is not None:
        flat[upto[:-1]], flat[upto[:-1] + 1] = head & 255, head >> 8
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(flat)])


def sample_places(units: Bytes | Words, prints: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Places of a least gram of any window inside a document."""
    n, reach = len(units), size - gram + 1
    if n < size:
        return np.zeros(0, np.int64)
    end = np.repeat(units.first[1:], np.diff(units.first))
    least = P.slide(prints, reach, np.minimum)  # of the window at i
    own = np.where(np.arange(n - size + 1) + size <= end[: n - size + 1], least, prints.dtype.type(0))
    pad = np.zeros(reach - 1, prints.dtype)
    highest = P.slide(np.concatenate([pad, own, pad]), reach, np.maximum)  # over the windows that hold the gram at p
    return np.flatnonzero((highest == prints) & (highest > 0))


def _same_as_neighbour(rows: np.ndarray) -> np.ndarray:
    """Common-prefix length of each sorted row with the one before it."""
    equal = rows[1:] == rows[:-1]
    if not rows.shape[1]:
        return np.zeros(len(equal), np.int64)
    return np.where(equal.all(axis=1), rows.shape[1], equal.argmin(axis=1))


def _sorted(rows: np.ndarray) -> np.ndarray:
    plain = np.ascontiguousarray(rows if rows.dtype == np.uint8 else rows.astype(">u4"))
    return np.argsort(plain.view(f"S{plain.shape[1] * plain.itemsize}").ravel(), kind="stable") if plain.shape[1] else np.arange(len(rows))


def repeated_offsets(units: np.ndarray, n_units: np.ndarray, before: np.ndarray, times: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For suffixes with what precedes them: is the window with a units before the place repeated (row, a)?

    units: all rows' units one after the other, of which before[k] precede the place; times: occurrences of a row.
    """
    reach, k = size - gram + 1, len(n_units)
    table = np.zeros((k, reach - 1 + size), units.dtype)
    column, upto = np.arange(table.shape[1]), np.concatenate([[0], np.cumsum(n_units)])
    for lo in range(0, k, GATHERED):
        hi = min(lo + GATHERED, k)
        lead = (reach - 1 - before[lo:hi])[:, None]
        table[lo:hi][(column >= lead) & (column < lead + n_units[lo:hi, None])] = units[upto[lo] : upto[hi]]  # row by row
    after = n_units - before
    right, left = table[:, reach - 1 :], table[:, : reach - 1][:, ::-1]
    by_right, by_left = _sorted(right), _sorted(left)
    depth, back = _same_as_neighbour(right[by_right]), _same_as_neighbour(left[by_left])
    out = np.zeros((k, reach), bool)
    node, rank = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for a in range(reach):
        node[by_right[1:]] = np.cumsum(depth < size - a)  # inner node of this depth
        rank[by_left[1:]] = np.cumsum(back < a)
        some = np.flatnonzero((before >= a) & (after >= size - a))
        key = node[some] * k + rank[some]
        order = np.argsort(key)
        tied = np.zeros(len(some) + 1, bool)
        tied[1:-1] = key[order][1:] == key[order][:-1]
        out[some[order], a] = (tied[1:] | tied[:-1]) | (times[some[order]] > 1)
    return out


def range_bounds(docs: DataFrame, text: str, total: int, n: int, kind: type) -> list[bytes]:
    """At most n - 1 strings that cut the byte order of places into ranges of about equal weight.

    Taken from a bounded sample of places; they only balance the groups. The shortest prefix that parts two neighbours is enough.
    """
    if n < 2 or not total:
        return []
    wanted = 8 * n
    h = F.xxhash64(text)
    size = F.char_length(text)
    chosen = docs.where(size > 0).where(F.pmod(h, F.lit(1 << 30)) <= F.lit(float(wanted) * (1 << 30) / total) * size)
    place = (F.pmod(F.shiftright(h, 30), size) + 1).cast("int")
    head = F.substring(text, place, F.lit(3 * _HEAD))
    if kind is Words:  # from the next word on
        head = F.regexp_replace(head, r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+", "")
    found = sorted(bytes(r[0])[:_HEAD] for r in chosen.select(head.cast("binary")).limit(4 * wanted).toLocalIterator())
    found = found[:: max(1, len(found) // n)][1:]
    return sorted({b[: next((i + 1 for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a) + 1)] for a, b in zip([b"", *found], found, strict=False) if a < b})


def mark_repeated(docs: DataFrame, text: str, size: int, kind: type, finish: Callable[[pa.Table, Bytes | Words, np.ndarray], pa.Table], schema: T.StructType, per_group: int | None = None, hot: int | None = None, hash_bits: int = 32) -> DataFrame:
    """finish(rows, units, mask of the units inside a repeated window) of every block, with the columns of `schema`.

    hash_bits: of the grams' hashes; fewer make unequal grams meet more often, with the same result.
    """
    gram = -(-size // 3)
    reach = size - gram + 1
    total = B.total_bytes(docs, text)
    rows = B.in_blocks(docs.select(F.struct("*").alias("row")), total, 2 << 20 if kind is Bytes else B.BLOCK_BYTES)
    places = 2 * total / (reach + 1) / (6 if kind is Words else 1)
    n_counts, n_groups = B.n_buckets(places), max(1, int(places // (per_group or PER_GROUP)))
    hot = hot or HOT
    bounds = range_bounds(docs, text, total, min(MAX_RANGES, n_groups), kind)
    cuts = np.array(bounds, f"S{_HEAD}")
    parts = max(1, n_groups // (len(bounds) + 1))
    shift = _U(max(0, 64 - SPARE_BITS - max(24, int(places).bit_length())))

    def texts_of(table: pa.Table) -> pa.Array:
        # a block's rows come in any order, and what is known of their places goes by place
        texts = pc.fill_null(pc.struct_field(table.combine_chunks()["row"], text), "")
        return texts.take(pc.sort_indices(texts))

    def keys_at(units: Bytes | Words, at: np.ndarray) -> np.ndarray:
        return (units.grams(gram)[at] >> shift if hash_bits == 32 else units.grams(gram)[at] >> _U(64 - hash_bits)) << shift

    def send_grams(key: tuple, table: pa.Table) -> pa.Table:
        units = kind(texts_of(table))
        prints = (units.grams(gram) >> _U(64 - hash_bits)).astype(np.uint32) | np.uint32(1)
        at = sample_places(units, prints, size, gram)
        return B.ask(key[0].as_py(), keys_at(units, at), lambda k: B.even_bucket(k, n_counts), state=B.pack(at.astype(np.uint64)))

    def send_suffixes(key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        units, block = kind(texts_of(table)), key[0].as_py()
        at = B.unpack(B.state_of(counts)).astype(np.int64)
        keys = keys_at(units, at)
        n = B.counts_for(keys, counts)
        doc = np.searchsorted(units.first, at, side="right") - 1
        low, high = np.maximum(at - reach + 1, units.first[doc]), np.minimum(at + size, units.first[doc + 1])
        cold, warm = (n > 1) & (n <= hot), n > hot
        p, lo, hi = at[cold], low[cold], high[cold]
        data, begin, end = units.ranges(lo, hi)
        bodies = _flat(data, begin, end, p - lo).dictionary_encode()
        which, bodies = bodies.indices.to_numpy(), bodies.dictionary
        one = np.zeros(len(bodies), np.int64)
        one[which] = np.arange(len(p))  # a place that has this text
        _, begin, end = units.ranges(p[one], np.minimum(p[one] + gram, hi[one]))
        heads = np.array(_flat(data, begin, np.minimum(end, begin + _HEAD)).to_pylist(), f"S{_HEAD}")
        group = np.searchsorted(cuts, heads, side="right") * parts + (P.mix(keys[cold][one]) % _U(parts)).astype(np.int64)
        times = np.bincount(which, minlength=len(bodies))
        # places of hot grams: every window around them by itself
        some = np.zeros(len(units) + 1, np.int64)
        first, last = low[warm], np.minimum(at[warm], high[warm] - size)
        ok = last >= first
        np.add.at(some, first[ok], 1)
        np.add.at(some, last[ok] + 1, -1)
        starts = np.flatnonzero(np.cumsum(some[:-1]) > 0)
        _, begin, end = units.ranges(starts, starts + size)
        whole = data.tobytes() if len(starts) else b""
        digests = np.frombuffer(b"".join(blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)), "S16")
        uniq, inverse, again = np.unique(digests, return_inverse=True, return_counts=True)
        bucket = (np.frombuffer(uniq.tobytes(), ">u4")[::4].astype(np.int64) * n_groups) >> 32
        sent = [(-1 - b, np.ascontiguousarray(uniq[x:y]).tobytes() + (again[x:y] > 1).tobytes()) for b, x, y in B.runs(bucket)]
        state = pickle.dumps((p.astype(np.uint32), which.astype(np.uint32), starts.astype(np.uint32), inverse.astype(np.uint32)))
        more = [*sent, (_STATE - block, state)]
        return pa.table(
            {
                "bucket": np.concatenate([group, np.array([b for b, _ in more], np.int64)]),
                "block": np.full(len(group) + len(more), block),
                "no": np.concatenate([np.arange(len(group)), np.zeros(len(more), np.int64)]).astype(np.int32),
                "times": np.concatenate([np.minimum(times, 2), np.zeros(len(more), np.int64)]).astype(np.int32),
                "data": pa.chunked_array([bodies, pa.array([d for _, d in more], pa.binary())], pa.binary()),
            }
        )

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket <= _STATE:
            out = table.select(["block", "data"])
        elif bucket < 0:
            out = pa.table({"block": table["block"], "data": pa.array(_digests_again(table["data"].to_pylist()), pa.binary())})
        else:
            out = _subtrees(table, kind, size, gram)
        return out.append_column("part", pa.array(np.full(out.num_rows, bucket), pa.int64()))

    def finish_block(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(pc.fill_null(pc.struct_field(table["row"], text), "")))
        units = kind(pc.struct_field(table["row"], text))
        got = sorted(zip(replies["part"].to_pylist(), replies["data"].to_pylist(), strict=True), key=lambda x: x[0])
        states = [d for part, d in got if part <= _STATE]
        start = np.zeros(len(units), bool)
        if states:
            p, which, hot_start, hot_which = (x.astype(np.int64) for x in pickle.loads(states[0]))
            width = -(-reach // 8)
            bits = np.zeros((int(which.max()) + 1 if len(which) else 0, width), np.uint8)
            for part, d in got:
                if part >= 0:
                    n = len(d) // (4 + width)
                    bits[np.frombuffer(d, np.int32, n)] = np.frombuffer(d, np.uint8, n * width, 4 * n).reshape(n, width)
            for lo in range(0, len(p), 20_000):
                which_place, a = np.nonzero(np.unpackbits(bits[which[lo : lo + 20_000]], axis=1, count=reach))
                start[p[lo + which_place] - a] = True
            again = np.concatenate([np.frombuffer(d, bool) for part, d in reversed(got) if _STATE < part < 0] or [np.zeros(0, bool)])
            start[hot_start[again[hot_which]]] = True
        upto = np.cumsum(np.concatenate([[0], start]))
        at = np.arange(len(units))
        return finish(table, units, upto[at + 1] - upto[np.maximum(at + 1 - size, 0)] > 0)

    by_block = rows.groupBy("block")
    counts = B.answer(by_block.applyInArrow(B.lean(send_grams), B.MESSAGE), B.counter())
    sent = by_block.cogroup(counts.groupBy("block")).applyInArrow(B.lean(send_suffixes), "bucket long, block long, no int, times int, data binary")
    replies = sent.groupBy("bucket").applyInArrow(B.lean(decide), "block long, data binary, part long")
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(B.lean(finish_block), schema)


def _digests_again(messages: list[bytes]) -> list[bytes]:
    """For each message's digests: is it there twice, in one block or two?"""
    size = [len(m) // 17 for m in messages]
    digests = np.concatenate([np.frombuffer(m, "S16", n) for m, n in zip(messages, size, strict=True)])
    twice = np.concatenate([np.frombuffer(m, bool, n, 16 * n) for m, n in zip(messages, size, strict=True)])
    uniq, inverse, n = np.unique(digests, return_inverse=True, return_counts=True)
    again = n > 1
    again[inverse[twice]] = True
    return [x.tobytes() for x in np.split(again[inverse], np.cumsum(size)[:-1])]


def _subtrees(table: pa.Table, kind: type, size: int, gram: int) -> pa.Table:
    """Bits of all suffixes of a group, one row per block: numbers, then a bit per offset."""
    table = table.combine_chunks()
    bodies = table["data"].combine_chunks()
    bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
    data, offsets = P.concat(bodies)
    before = data[offsets[:-1]].astype(np.int64) | data[offsets[:-1] + 1].astype(np.int64) << 8
    keep = np.ones(len(data), bool)
    keep[offsets[:-1]] = keep[offsets[:-1] + 1] = False
    units, n_units = kind.rows(data[keep], offsets - 2 * np.arange(len(offsets)))
    upto = np.concatenate([[0], np.cumsum(n_units)])
    place = upto[:-1] + before
    heads = np.empty((len(place), gram), units.dtype)
    for lo in range(0, len(place), GATHERED):
        heads[lo : lo + GATHERED] = units[place[lo : lo + GATHERED, None] + np.arange(gram)]
    order = _sorted(heads)
    tree = np.flatnonzero(np.concatenate([[True], _same_as_neighbour(heads[order]) < gram, [True]]))  # where a gram's subtree begins
    times = table["times"].to_numpy()
    bits = np.zeros((len(bodies), -(-(size - gram + 1) // 8)), np.uint8)
    one = 0
    while one < len(tree) - 1:  # runs of whole subtrees
        after = max(one + 1, int(np.searchsorted(tree, tree[one] + RUN_UNITS // (2 * size), side="right")) - 1)
        some = order[tree[one] : tree[after]]
        n = n_units[some]
        flat = np.concatenate([units[a:b] for a, b in zip(upto[some].tolist(), upto[some + 1].tolist(), strict=True)])
        bits[some] = np.packbits(repeated_offsets(flat, n, before[some], times[some], size, gram), axis=1)
        one = after
    blocks, no = table["block"].to_numpy(), table["no"].to_numpy()
    by_block = np.argsort(blocks, kind="stable")
    out = [(b, no[x].astype(np.int32).tobytes() + bits[x].tobytes()) for b, lo, hi in B.runs(blocks[by_block]) for x in [by_block[lo:hi]]]
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})
