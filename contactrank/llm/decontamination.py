"""Operator 8: benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item (an item of fewer words is one window). Its set is that of its
words, each a shingle of one; words are ordered by rarity in the corpus. A document that holds a window holds its rarest word, so
one word per window, its necessary prefix, is joined with the documents' words. A match at word q with the rare word
at offset o of the window can only begin at q - o: positional and length bounds drop begins outside the document. What
is left is verified, first by the hash of the whole window and then by its text.

Documents are scanned without any shuffle of texts: once for the rarity of words, then once per part of the
benchmark. A part has about PART_WINDOWS windows, so what is on the driver and sent to the tasks is bounded by one part (100
MB), whatever the benchmark's size; parts are fetched, sent and released one after the other. Rarity is counted in
CELLS cells of a hash, of which only those of benchmark words are counted: any order of words gives the same hits.

Defined results: null and empty texts have no words and no hits; items without words have no window; repeated items
count once by id, and a null item id reads as the empty string; an empty benchmark or table hits nothing; repeated
rows each give a row; input columns come back untouched in `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm import fingerprints as P
from contactrank.llm.blocks import lean_map, slices
from contactrank.llm.components import checkpoint, release

#: Windows in one part of the index: about 140 bytes each.
PART_WINDOWS = 500_000
CELLS = 1 << 18

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(texts: pa.Array | pa.ChunkedArray) -> P.Words:
    data, offsets = P.concat(texts)
    return P.Words(P.lower_ascii(data), offsets, P.NOT_WORD)


def item_windows(items: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(item, words array<string>): one row per distinct window and item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text"))
            data = words.data.tobytes()
            out: tuple[list, list] = ([], [])
            for d, item in enumerate(batch.column("item").to_pylist()):
                lo, hi = words.first[d], words.first[d + 1]
                own = [data[a:b].decode() for a, b in zip(words.start[lo:hi], words.end[lo:hi], strict=True)]
                for w in {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else ():
                    out[0].append(item)
                    out[1].append(list(w))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string()))], ["item", "words"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item string, words array<string>")


def _cells(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _counted(docs: DataFrame, text: str, used: np.ndarray | None) -> np.ndarray:
    """Occurrences of the words of each cell; only of the cells that are used, if given. At most CELLS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                total += np.bincount(_cells(words_of(part).fingerprints()), minlength=CELLS)
        at = np.flatnonzero(total if used is None else total * used)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(CELLS, np.int64)
    for r in docs.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["cell"]] = r["n"]
    return out


class WindowIndex:
    """One part of the benchmark: windows by their rarest word, in arrays."""

    def __init__(self, words: pa.Array, items: pa.Array, rarity: np.ndarray):
        flat, bounds = words.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        own = P.hash_strings([w.encode() for w in flat.to_pylist()])
        size = np.diff(bounds)
        window = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((np.arange(len(own)), own, rarity[_cells(own)], window))
        least = order[bounds[:-1][size > 0]]  # the first of the rarest
        offset = least - bounds[:-1]
        rare = own[least]
        by_word = np.argsort(rare, kind="stable")
        self.rare, self.offset, self.length = rare[by_word], offset[by_word], size[by_word]
        self.print = P.sequences(own, bounds[:-1], bounds[1:])[by_word] if len(own) else rare
        self.text = pc.binary_join(words, " ").cast(pa.large_binary()).take(pa.array(by_word))
        self.items = items.take(pa.array(by_word))

    def find(self, words: P.Words) -> Iterator[tuple[int, int]]:
        """(first word, window) of every verified occurrence."""
        prints = words.fingerprints()
        lo, hi = np.searchsorted(self.rare, prints, "left"), np.searchsorted(self.rare, prints, "right")
        at = np.flatnonzero(hi > lo)
        for some in np.array_split(at, max(1, int((hi[at] - lo[at]).sum()) // 1_000_000 + 1)):
            n = hi[some] - lo[some]
            q = np.repeat(some, n)
            e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n)
            start, doc = q - self.offset[e], words.doc[q]
            ok = (start >= words.first[doc]) & (start + self.length[e] <= words.first[doc + 1])
            start, e = start[ok], e[ok]
            if len(e):
                ok = P.sequences(prints, start, start + self.length[e]) == self.print[e]
                for s, w in zip(start[ok].tolist(), e[ok].tolist(), strict=True):
                    own = (words.data[a:b].tobytes() for a, b in zip(words.start[s : s + self.length[w]], words.end[s : s + self.length[w]], strict=True))
                    if b" ".join(own) == self.text[w].as_py():
                        yield s, w


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, part_windows: int = PART_WINDOWS) -> DataFrame:
    """row, n_words, hits (spans of word numbers inside occurrences of windows) and items (ids as sorted strings)."""
    windows = item_windows(benchmark, item_id, item_text, size).groupBy("words").agg(F.collect_set("item").alias("items"))
    windows = checkpoint(windows)
    n_parts = max(1, -(-windows.count() // part_windows))
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
    rarity = _counted(docs, text, _counted(benchmark, item_text, None) > 0)
    out = docs.select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(schema["hits"].dataType).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(n_parts):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(n_parts)) == k).toArrow()
        words, items = (pa.chunked_array(part[c].chunks, part[c].type).combine_chunks() for c in ("words", "items"))
        words, items = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (words, items))
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex(words, items, rarity))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for texts in slices(pc.struct_field(batch.column("row"), text)):
                    had = batch.slice(done, len(texts))
                    done += len(texts)
                    words = words_of(texts)
                    inside = np.zeros(len(words) + 1, np.int64)
                    items: dict[int, set[str]] = {}
                    for s, w in index.value.find(words):
                        inside[s] += 1
                        inside[s + index.value.length[w]] -= 1
                        items.setdefault(int(words.doc[s]), set()).update(index.value.items[w].as_py())
                    hit = np.cumsum(inside[:-1]) > 0
                    hits, found = [], []
                    for d, (before, old) in enumerate(zip(had.column("hits").to_pylist(), had.column("items").to_pylist(), strict=True)):
                        own = hit[words.first[d] : words.first[d + 1]].copy()
                        for span in before or ():
                            own[span["start"] : span["end"]] = True
                        start, end = P.spans_of(own) if own.any() else ((), ())
                        hits.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)])
                        found.append(sorted({*(old or ()), *items.get(d, ())}))
                    yield pa.RecordBatch.from_arrays([had.column("row"), pa.array(np.diff(words.first), pa.int64()), pa.array(hits, _SPANS), pa.array(found, pa.list_(pa.string()))], ["row", "n_words", "hits", "items"])

        out = out.mapInArrow(lean_map(search), schema)
        if k < n_parts - 1:
            out = checkpoint(out)
            index.destroy()
            if k:
                release(last)
            last = out
    release(windows)
    return out
