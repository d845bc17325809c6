"""Operator 13: spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes one of the other. With m the length of the
longer one this holds where their common prefix and their common suffix together reach m - 1; so one of both has m // 2
code points at least, and only words that share a prefix or a suffix of that length are compared.

1. A word is dealt to the groups (m, side, its first or last m // 2 code points) for m of its own length and one more.
2. A group of more than MAX_GROUP words is cut along the texts: pairs that agree on one more code point go to a group
   with a longer key, and the others to one whose key is all but the code point after the first key. Groups of the
   second kind hold a word per letter of the alphabet, so every group ends small, however frequent a prefix is.
3. Groups are dealt to tasks by a hash of the key. A task writes its words as matrices of code points, padded behind for
   prefixes and before for suffixes, and compares them in tiles of TILE words: one pass over the columns counts the
   common prefixes of all pairs of two tiles, another the suffixes. Words of many small groups share a tile.
4. A word's neighbours leave a task as their number and the best of them, never as pairs. A pair counts in one group
   only: where its prefix has m // 2 code points on that side, else on the other; and in a cut group by its exact length.

Roots follow forms by pointer doubling: each form is `ratio` times as frequent, so paths are short.

Defined results: null, empty and repeated words are not counted apart (a frame of counted words holds each once);
words shorter than two code points have no neighbours within keys of nothing, which are compared like others; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactrank.llm.components import checkpoint, release

#: Words that a group may have before its key grows.
MAX_GROUP = 4096
#: Words of a tile; two tiles are compared at once.
TILE = 256
#: Words that a task's batch of groups has on average.
BATCH_WORDS = 60_000

_GROUP = ["size", "side", "k", "gap"]


def count_words(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word and its number n of rows, from a frame with a row per occurrence in `word`; added up per task before the shuffle."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _last(word: Column, k: Column) -> Column:
    return F.substr(word, F.char_length(word) - k + 1, k)


def _key() -> Column:
    """What the words of a group share."""
    word, k, rest = F.col("word"), F.col("k"), F.col("size") - 1 - F.col("k")
    none = F.lit(1)
    first, last = F.substr(word, none, k), _last(word, k)
    return F.when(F.col("side") == 0, F.when(F.col("gap"), F.concat(first, F.lit("\n"), _last(word, rest))).otherwise(first)).otherwise(F.when(F.col("gap"), F.concat(F.substr(word, none, rest), F.lit("\n"), last)).otherwise(last))


def grouped(words: DataFrame, max_group: int) -> DataFrame:
    """size, side, k, gap, key, word, n: every word in its groups, none of them over `max_group` words while its key can grow."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    rows = rows.select("size", "side", F.floor(F.col("size") / 2).cast("int").alias("k"), F.lit(False).alias("gap"), "word", "n").withColumn("key", _key())
    ready = None
    while True:
        crowded = rows.groupBy(*_GROUP, "key").agg(F.count("*").alias("words")).where((F.col("words") > max_group) & ~F.col("gap") & (F.col("k") < F.col("size") - 1))
        crowded = checkpoint(crowded.drop("words"))
        last = crowded.isEmpty()
        fine = rows if last else rows.join(crowded, [*_GROUP, "key"], "left_anti")
        ready = fine if ready is None else ready.unionByName(fine)
        if last:
            return ready
        cut = rows.join(crowded, [*_GROUP, "key"], "left_semi").withColumn("gap", F.explode(F.array(F.lit(False), F.lit(True))))
        rows = checkpoint(cut.withColumn("k", F.when(F.col("gap"), F.col("k")).otherwise(F.col("k") + 1)).withColumn("key", _key()))


def _matrix(words: list[str], width: int, before: bool) -> np.ndarray:
    """A column per word, a row per place: code points and one, zero where there is none."""
    flat = "".join(w.rjust(width, "\0") if before else w.ljust(width, "\0") for w in words)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width) + np.uint32(1)
    size = np.array([len(w) for w in words])[:, None]
    place = np.arange(width)[None, :]
    codes = np.where(place >= width - size if before else place < size, codes, np.uint32(0))
    return np.ascontiguousarray((codes if codes.max() >= 1 << 16 else codes.astype(np.uint16)).T)


def _common(a: np.ndarray, b: np.ndarray, alive: np.ndarray, start: int) -> np.ndarray:
    """For pairs that are alive and share `start` places: the number of equal places before the first other one."""
    out = alive * np.int32(start)
    alive = alive.copy()
    for p in range(start, len(a)):
        alive &= a[p][:, None] == b[p][None, :]
        if not alive.any():
            break
        out += alive
    return out


def _near(words: list[str], group: np.ndarray, size: int, side: int, k: int, gap: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words, once for each pair; `group` is sorted."""
    front, back = _matrix(words, size, before=False), _matrix(words, size, before=True)[::-1]
    full = np.array([len(w) == size for w in words])
    for i in range(0, len(words), TILE):
        here = slice(i, i + TILE)
        for j in range(i, len(words), TILE):
            if group[j] != group[min(i + TILE, len(words)) - 1]:
                if j > i:
                    break
            there = slice(j, j + TILE)
            alive = (group[here][:, None] == group[there][None, :]) & (full[here][:, None] | full[there][None, :])
            if i == j:
                alive = np.triu(alive, 1)
            if not alive.any():
                continue
            prefix = _common(front[:, here], front[:, there], alive, k if side == 0 else 0)
            suffix = _common(back[:, here], back[:, there], alive, k if side == 1 else 0)
            hit = alive & (prefix + suffix >= size - 1)
            if gap:
                hit &= (prefix if side == 0 else suffix) == k
            if side == 1:
                hit &= prefix < size // 2
            x, y = np.nonzero(hit)
            if len(x):
                yield x + i, y + j


def _compare(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table[c].to_pylist() for c in (*_GROUP, "key", "word", "n")), strict=True))
    rows.sort()
    words, n = [r[5] for r in rows], np.array([r[6] for r in rows], np.int64)
    best_first = sorted(range(len(rows)), key=lambda i: (-rows[i][6], words[i]))
    rank = np.empty(len(rows), np.int64)
    rank[best_first] = np.arange(len(rows))
    near, best = np.zeros(len(rows), np.int64), np.full(len(rows), len(rows))
    begin = 0
    while begin < len(rows):
        kind = rows[begin][:4]
        end = begin
        group = []
        while end < len(rows) and rows[end][:4] == kind:
            group.append(group[-1] + (rows[end][4] != rows[end - 1][4]) if group else 0)
            end += 1
        for x, y in _near(words[begin:end], np.array(group), *kind):
            for a, b in ((x + begin, y + begin), (y + begin, x + begin)):
                np.add.at(near, a, 1)
                np.minimum.at(best, a, rank[b])
        begin = end
    found = np.flatnonzero(near)
    chosen = np.array(best_first, np.int64)[best[found]] if len(found) else found
    return pa.table({"word": pa.array([words[i] for i in found], pa.string()), "n_near": pa.array(near[found]), "best_n": pa.array(n[chosen]), "best": pa.array([words[i] for i in chosen], pa.string())})


def neighbours(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """word, n_near, best_n and best for the words that have near ones; best: the most frequent, of equals the first."""
    n = max(16, -(-4 * words.count() // BATCH_WORDS))
    rows = grouped(words, max_group).withColumn("batch", F.pmod(F.xxhash64(*_GROUP, "key"), F.lit(n)))
    found = rows.groupBy("batch").applyInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form) without loops: every form is replaced by its own form's, until none has one."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = checkpoint(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = not step.where("_moved").isEmpty()
        release(now)
        now = step.drop("_moved")
        if not moved:
            return now
        now.written_to = step.written_to


def spelling_variants(words: DataFrame, ratio: int = 10, max_group: int = MAX_GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of counted words (word, n), each once.

    form: the most frequent near word, if it has `ratio` times the occurrences or more; root: the end of the path of forms.
    """
    words = checkpoint(words.select("word", F.col("n").cast("long").alias("n")))
    known = words.join(neighbours(words, max_group), "word", "left")
    taken = F.col("best_n") >= ratio * F.col("n")
    known = checkpoint(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
