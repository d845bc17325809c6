"""B1's matching: all searches of an owner at once, by one automaton over their distinct tokens.

A contact's fields are read once, in priority order, whatever the number of searches: each field's pass gives the tokens
that it holds and no earlier field held. A token's weight goes to every search that names it, as often as it does.

Contacts and searches are not multiplied. What a contact holds is one row of tokens and weights, and it is ranked
for a search only if

* it holds one of the search's rare tokens, those that at most FEW of the owner's contacts hold, or
* it is among the k best by the search's frequent tokens alone.

Nothing else can be among the k best: without a rare token a contact's score is that of the frequent ones, and the k that
are before it by these have at least as much in all. Searches with the same frequent tokens share these k, and of the
contacts with equal frequent tokens and weights only the first k are compared, so common tokens cost the number of
different mixes on both sides, not the number of searches times that of contacts.

Searches are held per owner in blocks of SEARCHES_PER_BLOCK, each with an automaton; an owner with more searches has more
blocks, and a contact is read once for each of them.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactrank.functions.schema import MAX_RESULTS, WEIGHTS
from contactrank.functions.tables import MAX_BROADCAST_BYTES, checkpoint

SEARCHES_PER_BLOCK = 10_000
#: Contacts of an owner that one task matches where its searches are sent to them by a shuffle.
CONTACTS_PER_TASK = 50_000
#: Automata that a task keeps.
MAX_AUTOMATA = 64
#: Contacts of an owner with a token, up to which each is ranked for every search that names it.
FEW = 100

_KEYS = ["owner_id", "source_file", "row_ord"]
_FIELDS = [f"_{f}" for f in WEIGHTS]
_BLOCK = ["owner_id", "block"]
_CONTACT = "owner_id string, block int, source_file string, row_ord long"
HITS = f"{_CONTACT}, place int, score int"
_FOUND = f"{_CONTACT}, hits map<int,int>"
_BEST = f"{_CONTACT}, part int, score int"
_KINDS = {"place": pa.int32(), "score": pa.int32(), "part": pa.int32(), "hits": pa.map_(pa.int32(), pa.int32())}


class Matcher:
    """The searches of one block; `frequent`: numbers of tokens that more than FEW contacts hold."""

    def __init__(self, searches: list[list[str]], frequent: Iterable[int] = ()) -> None:
        self.searches, self.frequent = searches, frozenset(frequent)
        self.numbers: dict[str, int] = {}
        for tokens in searches:
            for t in tokens:
                self.numbers.setdefault(t, len(self.numbers))

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for token, number in self.numbers.items():
            out.add_word(token, number)
        if self.numbers:
            out.make_automaton()
        return out

    @cached_property
    def asked(self) -> list[tuple[tuple[int, int], ...]]:
        """Per search its tokens, each with how often it names it."""
        return [tuple((self.numbers[t], times) for t, times in sorted(Counter(tokens).items())) for tokens in self.searches]

    @cached_property
    def rare(self) -> dict[int, list[int]]:
        """Per rare token the searches that name it."""
        out: dict[int, list[int]] = {}
        for place, tokens in enumerate(self.asked):
            for number, _ in tokens:
                if number not in self.frequent:
                    out.setdefault(number, []).append(place)
        return out

    @cached_property
    def parts(self) -> dict[tuple[tuple[int, int], ...], list[int]]:
        """The frequent tokens of searches, each mix once, with the searches that have it."""
        out: dict[tuple, list[int]] = {}
        for place, tokens in enumerate(self.asked):
            if part := tuple(x for x in tokens if x[0] in self.frequent):
                out.setdefault(part, []).append(place)
        return out

    @cached_property
    def places(self) -> list[list[int]]:
        return list(self.parts.values())

    @cached_property
    def parts_with(self) -> dict[int, list[tuple[int, int]]]:
        """Per frequent token the parts that name it, and how often."""
        out: dict[int, list[tuple[int, int]]] = {}
        for part, tokens in enumerate(self.parts):
            for number, times in tokens:
                out.setdefault(number, []).append((part, times))
        return out

    def hits(self, fields: list[str | None]) -> dict[int, int]:
        """Number of a token to the weight of the first field that holds it, for lower-cased fields in the order of WEIGHTS."""
        out: dict[int, int] = {}
        for text, weight in zip(fields, WEIGHTS.values(), strict=True):
            if text and self.numbers:
                for _, number in self.automaton.iter(text):
                    out.setdefault(number, weight)
        return out

    def ranked(self, hits: dict[int, int], parts: Iterable[int] = ()) -> dict[int, int]:
        """Place of a search to the whole score, for the searches with a rare token among the hits or one of the parts."""
        places = {p for number in hits for p in self.rare.get(number, ())}
        places.update(p for part in parts for p in self.places[part])
        return {p: sum(times * hits.get(number, 0) for number, times in self.asked[p]) for p in places}

    def scores(self, fields: list[str | None]) -> dict[int, int]:
        """Place of a search to its score; only those over 0, and of them those with a rare token."""
        return self.ranked(self.hits(fields))

    def best(self, mixes: dict[tuple[tuple[int, int], ...], list[tuple[str, int]]], k: int) -> Iterator[tuple]:
        """part, score and contact of each part's k best, from (token, weight) mixes and their first contacts."""
        held: dict[int, list[tuple]] = {}
        for mix, some in mixes.items():
            score: dict[int, int] = {}
            for number, weight in mix:
                for part, times in self.parts_with.get(number, ()):
                    score[part] = score.get(part, 0) + weight * times
            for part, s in score.items():
                of = held.setdefault(part, [])
                of += [(-s, *contact) for contact in some]
                if len(of) > 8 * k:
                    held[part] = heapq.nsmallest(k, of)
        for part, of in held.items():
            yield from ((part, -s, *contact) for s, *contact in heapq.nsmallest(k, of))


def in_blocks(asked: DataFrame) -> DataFrame:
    """owner_id, block, searches: of (search_id, owner_id, criteria, tokens), each once; a block is an array of bounded length."""
    per_owner = asked.groupBy("owner_id").agg(F.ceil(F.count("*") / SEARCHES_PER_BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("search_id", "criteria"), F.col("blocks")).cast("int").alias("block")
    return asked.join(per_owner, "owner_id").select("owner_id", block, F.struct("search_id", "criteria", "tokens").alias("s")).groupBy("owner_id", "block").agg(F.sort_array(F.collect_list("s")).alias("searches"))


# what a task does with contacts of one owner and a block of its searches; rows without owner and block


def _find(matcher: Matcher, rows: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    for file, row, *fields in zip(*(rows.column(c).to_pylist() for c in ("source_file", "row_ord", *_FIELDS)), strict=True):
        if hits := matcher.hits(fields):
            yield file, row, list(hits.items())


def _best(k: int) -> Callable:
    def best(matcher: Matcher, rows: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
        mixes: dict[tuple, list] = {}
        for file, row, hits in zip(*(rows.column(c).to_pylist() for c in ("source_file", "row_ord", "hits")), strict=True):
            mixes.setdefault(tuple(hits), []).append((file, row))
        yield from ((file, row, part, score) for part, score, file, row in matcher.best(mixes, k))

    return best


def _rank(matcher: Matcher, rows: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    for file, row, hits, parts in zip(*(rows.column(c).to_pylist() for c in ("source_file", "row_ord", "hits", "parts")), strict=True):
        for place, score in matcher.ranked(dict(hits), parts or ()).items():
            yield file, row, place, score


def _table(owner: str | None, block: int | None, rows: list[tuple], kind: str) -> pa.Table:
    names = [c.split(" ")[0] for c in kind.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 2)
    own = [pa.array([owner] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int32()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())]
    return pa.table([*own, *(pa.array(c, _KINDS[n]) for n, c in zip(names[4:], columns[2:], strict=True))], names=names)


def _sent(rows: DataFrame, by_owner: Broadcast, frequent: Broadcast | None, work: Callable, kind: str) -> DataFrame:
    """Rows against searches that were sent to every task (owner to block to token lists); they stay where they are."""
    by = [c for c in _BLOCK if c in rows.columns]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, Matcher] = {}
        for batch in batches:
            rows_of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
                rows_of.setdefault(key, []).append(i)
            for (owner, *named), at in rows_of.items():
                blocks = by_owner.value.get(owner, {})
                for block in named or blocks:
                    if (owner, block) not in made:
                        if len(made) >= MAX_AUTOMATA:
                            made.clear()
                        made[owner, block] = Matcher(blocks[block], frequent.value.get((owner, block), ()) if frequent else ())
                    out = list(work(made[owner, block], batch.take(pa.array(at, pa.int64()))))
                    if out:
                        yield from _table(owner, block, out, kind).to_batches()

    return rows.mapInArrow(meet, kind)


def _dealt(rows: DataFrame, blocks: DataFrame, work: Callable, kind: str) -> DataFrame:
    """Rows against searches in a shuffle: an owner's rows go to as many tasks as their number asks for, once for each block."""
    by = [c for c in _BLOCK if c in rows.columns]
    sized = blocks.join(rows.groupBy(*by).agg(F.ceil(F.count("*") / CONTACTS_PER_TASK).cast("int").alias("parts_of")), by)
    to_part = F.pmod(F.xxhash64("source_file", "row_ord"), F.col("parts_of")).cast("int")
    dealt = rows.join(sized.select(*_BLOCK, "parts_of"), by).withColumn("to", to_part).drop("parts_of")
    to = sized.select(F.col("owner_id").alias("to_owner"), F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), F.col("parts_of") - 1)).alias("of"), F.transform("searches", lambda s: s["tokens"]).alias("tokens"), "frequent")

    def meet(key: tuple, some: pa.Table, searches: pa.Table) -> pa.Table:
        if not some.num_rows or not searches.num_rows:
            return _table(None, None, [], kind)
        matcher = Matcher(searches["tokens"][0].as_py(), searches["frequent"][0].as_py() or ())
        return _table(key[0].as_py(), key[1].as_py(), list(work(matcher, some)), kind)

    return dealt.groupBy(*_BLOCK, "to").cogroup(to.groupBy("to_owner", "of_block", "of")).applyInArrow(meet, kind)


def match(contacts: DataFrame, blocks: DataFrame, max_bytes: int | None = None, k: int = MAX_RESULTS) -> DataFrame:
    """HITS of contacts (keys and lower-cased fields) and the blocks of their owners' searches: a search's k best are among them.

    Blocks of up to `max_bytes` in all are sent to every task, and the contacts stay where they are. Larger ones meet the
    contacts in a shuffle. What contacts hold is written before it is counted.
    """
    rows = contacts.select(*_KEYS, *_FIELDS)
    n_bytes = blocks.agg(F.sum(F.octet_length(F.to_json("searches")))).first()[0] or 0
    small = n_bytes <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes)
    context = contacts.sparkSession.sparkContext
    by_owner = None
    if small:
        lists: dict[str, dict[int, list]] = {}
        for r in blocks.select(*_BLOCK, F.transform("searches", lambda s: s["tokens"]).alias("tokens")).collect():
            lists.setdefault(r.owner_id, {})[r.block] = r.tokens
        by_owner = context.broadcast(lists)
    none = blocks.withColumn("frequent", F.array().cast("array<int>"))
    found = checkpoint(_sent(rows, by_owner, None, _find, _FOUND) if small else _dealt(rows, none, _find, _FOUND))

    counts = found.select(*_BLOCK, F.explode(F.map_keys("hits")).alias("token")).groupBy(*_BLOCK, "token").agg(F.count("*").alias("n"))
    frequent = checkpoint(counts.where(F.col("n") > FEW).groupBy(*_BLOCK).agg(F.sort_array(F.collect_list("token")).alias("frequent")))
    told = context.broadcast({(r.owner_id, r.block): r.frequent for r in frequent.collect()}) if small else None
    told_blocks = blocks.join(frequent, _BLOCK, "left")

    def meet(some: DataFrame, work: Callable, kind: str) -> DataFrame:
        return _sent(some, by_owner, told, work, kind) if small else _dealt(some, told_blocks, work, kind)

    mix = F.array_sort(F.map_entries(F.map_filter("hits", lambda t, _: F.array_contains("frequent", t))))
    mixed = found.join(F.broadcast(frequent) if small else frequent, _BLOCK).withColumn("mix", mix).where(F.size("mix") > 0)
    alike = Window.partitionBy(*_BLOCK, "mix").orderBy("source_file", "row_ord")
    first = mixed.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k)
    of_parts = meet(first.select(*_BLOCK, "source_file", "row_ord", F.map_from_entries("mix").alias("hits")), _best(k), _BEST)
    by_part = Window.partitionBy(*_BLOCK, "part").orderBy(F.desc("score"), "source_file", "row_ord")
    best = of_parts.withColumn("_n", F.row_number().over(by_part)).where(F.col("_n") <= k)
    best = checkpoint(best.groupBy(*_BLOCK, "source_file", "row_ord").agg(F.collect_set("part").alias("parts")))
    return meet(found.join(best, [*_BLOCK, "source_file", "row_ord"], "left"), _rank, HITS)
