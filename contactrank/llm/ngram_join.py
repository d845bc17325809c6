"""Operator 9: n-gram Jaccard join by vertical partitioning.

1. A document's set is its distinct word n-grams. Documents with equal sets form a class, which takes part once.
2. The global n-gram order is by the number of classes that hold an n-gram, rare ones first. A pair that reaches
   the threshold shares an n-gram among the first |x| - ceil(t |x|) + 1 of both sets, and their sizes are within the
   threshold; n-grams of one class are nobody's, so most documents end here. Classes that such n-grams connect form a
   group; only pairs of one group are compared.
3. The order is cut into FRAGMENTS by powers of four of the counts, and every set into its segments. Groups (large ones
   as pairs of blocks of bounded size) and fragments are dealt out together: a task counts the partial overlaps of one
   fragment's segments.
4. The partial counts of a pair are summed over the fragments and compared with the threshold. Pairs travel as packed
   arrays, never as rows; what leaves is each class's number of similar rows and a forest for the components.

Words are 128-bit BLAKE2 digests, mixed into a 64-bit hash per n-gram; a class is 128 bits of all of its set. So a set is
never taken for another, and an overlap is off by one with a chance of its set's size times n / 2**64 for n n-grams.

Defined results: null and empty texts, and texts without words, have an empty set, link with nothing and are their
own component with no links; a text of fewer words than an n-gram is one n-gram of its own kind; repeated rows are one class; ids
are of any type with an order; a null id counts after every other id; an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm import blocks as B
from contactrank.llm import fingerprints as P
from contactrank.llm.components import checkpoint, components, join_salted, release

_U = np.uint64
#: Text in one block of documents.
BLOCK_BYTES = 2 << 20
#: N-grams and classes in one block of a group; a task holds one fragment of two blocks.
BLOCK_GRAMS = 400_000
BLOCK_CLASSES = 700
#: Fragments of the n-gram order: counts of 2 and 3, to 15, to 63, ... and all above.
FRAGMENTS = 6
#: Occurrences are counted by a hash's upper bits, this many more than the number of n-grams has. The count only
#: orders n-grams, so the few that share these bits do no harm.
SPARE_BITS = 12
#: Rows that a task remembers, so as to send equal ones once.
REMEMBERED = 100_000
#: Pairs that are counted at once.
PAIRS = 1 << 20
#: A member's side where a group's pairs are those inside one block.
WITHIN = 2


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of each document's distinct n-grams, ordered by both."""
    data, offsets = P.concat(texts)
    words = P.Words(P.lower_ascii(data), offsets)
    number, distinct = P.dictionary(words)
    digest = P.strong(distinct)
    digest = P.mix(digest[:, 0] ^ P.mix(digest[:, 1]))[number] if len(number) else np.zeros(0, np.uint64)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words))  # words from here to the document's end
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    print_ = digest
    for n in range(1, size + 1):
        if n > 1:
            print_ = P.mix(print_[:-1] ^ P.mix(digest[n - 1 :] + _U(0x9E3779B97F4A7C15)))
        # whole sequences of fewer words than an n-gram, then n-grams
        at = np.flatnonzero((left >= size) if n == size else (left == n) & (np.arange(len(words)) == words.first[words.doc]))
        docs.append(words.doc[at])
        keys.append(P.mix(print_[at] + _U(n)))
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    return docs[new], keys[new]


def set_classes(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """id, th (hash of the text), n (set size), cls and cls2 (both equal for equal sets only, null for empty ones)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in B.slices(batch.column("text")):
                doc, keys = shingle_sets(part, size)
                n = np.bincount(doc, minlength=len(part))
                lanes = []
                for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B):
                    total = np.zeros(len(part), np.uint64)
                    np.add.at(total, doc, P.mix(keys ^ _U(salt)))
                    lanes.append(pa.array(P.mix(total + n.astype(np.uint64)).view(np.int64), mask=n == 0))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(done, len(part)), "th": batch.column("th").slice(done, len(part)), "n": pa.array(n, pa.int64()), "cls": lanes[0], "cls2": lanes[1]})
                done += len(part)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(B.lean_map(label), T.StructType([rows.schema["id"], *T.StructType.fromDDL("th long, n long, cls long, cls2 long")]))


def one_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those whose id and hash of the text their task has just sent; only so many are remembered."""
    sent: set[tuple] = set()
    for batch in batches:
        take = []
        for k, pair in enumerate(zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), strict=True)):
            if pair not in sent:
                sent.add(pair)
                take.append(k)
        if len(sent) > REMEMBERED:
            sent.clear()
        yield batch if len(take) == batch.num_rows else batch.take(pa.array(take, pa.int64()))


def _candidate_sets(docs: DataFrame, members: DataFrame, id_col: str, text: str, size: int, threshold: tuple[int, int]) -> DataFrame:
    """v (number of the class), cls, cls2, n, size (rows), m (n-grams not of this class alone), prefix (n-grams that a partner may share), cut (n-grams in each fragment), grams (all that others hold too, in the global order)."""
    num, den = threshold
    n_bytes = B.total_bytes(docs, text)
    n_blocks = max(8, -(-n_bytes // BLOCK_BYTES))
    place = F.pmod(F.xxhash64("id", "th"), F.lit(n_blocks)).alias("block")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = rows.mapInArrow(B.lean_map(one_of_equal), rows.schema).withColumn("block", place)
    chosen = members.where("cls is not null").groupBy("cls", "cls2").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("size")).select("first.id", "first.th", "cls", "cls2", "size").withColumn("block", place)
    buckets = B.n_buckets(n_bytes / 6)
    shift = _U(max(0, 64 - SPARE_BITS - max(20, int(n_bytes // 6).bit_length())))

    def send(key: tuple, table: pa.Table, reps: pa.Table) -> pa.Table:
        cls = {(i, h): own for i, h, *own in zip(*(reps[k].to_pylist() for k in ("id", "th", "cls", "cls2", "size")), strict=True)}
        take, own = [], []
        for k, pair in enumerate(zip(table["id"].to_pylist(), table["th"].to_pylist(), strict=True)):
            if (c := cls.pop(pair, None)) is not None:
                take.append(k)
                own.append(c)
        _, keys = shingle_sets(table["text"].take(pa.array(take, pa.int64())), size)
        state = np.array(own, np.int64).reshape(-1, 3).T.tobytes() + table["th"].take(pa.array(take, pa.int64())).to_numpy().astype(np.int64).tobytes()
        return B.ask(key[0].as_py(), keys >> shift << shift, lambda k: B.even_bucket(k, buckets), state=state)

    def prefixes(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        cls, cls2, rows_of, th = np.frombuffer(B.state_of(answers), np.int64).reshape(4, -1)
        where = {h: k for k, h in enumerate(table["th"].to_pylist())}
        doc, keys = shingle_sets(table["text"].take(pa.array([where[h] for h in th.tolist()], pa.int64())), size)
        counts = B.counts_for(keys >> shift << shift, answers)
        order = np.lexsort((keys, counts, doc))
        doc, keys, counts = doc[order], keys[order], counts[order]
        bounds = np.searchsorted(doc, np.arange(len(cls) + 1))
        edges = 4 ** np.arange(1, FRAGMENTS)
        out: dict[str, list] = {c: [] for c in ("v", "cls", "cls2", "n", "size", "m", "prefix", "cut", "grams")}
        for d, c in enumerate(cls.tolist()):
            lo, hi = bounds[d], bounds[d + 1]
            n = int(hi - lo)
            length = n - -(-n * num // den) + 1
            alone = int(np.searchsorted(counts[lo:hi], 2))
            if alone < length:
                cut = np.diff(np.concatenate([[0], np.searchsorted(counts[lo + alone : hi], edges), [n - alone]]))
                for name, value in zip(out, (key[0].as_py() << 24 | d, c, int(cls2[d]), n, int(rows_of[d]), n - alone, keys[lo + alone : lo + length].view(np.int64), cut, keys[lo + alone : hi].view(np.int64)), strict=True):
                    out[name].append(value)
        types = [*[pa.int64()] * 6, *[pa.list_(pa.int64())] * 3]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), types, strict=True)})

    asked = rows.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(B.lean(send), B.MESSAGE)
    counted = B.answer(asked, B.counter())
    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(B.lean(prefixes), "v long, cls long, cls2 long, n long, size long, m long, prefix array<long>, cut array<long>, grams array<long>")


def partial_overlaps(group: np.ndarray, side: np.ndarray, bounds: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, count): common n-grams of the pairs of members of one group, for members in the order of their groups.

    grams[bounds[i] : bounds[i + 1]] are those of member i. In a group of k members from place p on, whose squares of
    earlier sizes add up to s, members p + i and p + j with i < j are pair s + i k + j.
    """
    k = np.bincount(group)
    first, base = np.cumsum(k) - k, np.cumsum(k * k) - k * k
    owner = np.repeat(np.arange(len(group)), np.diff(bounds))
    order = np.lexsort((owner, grams, group[owner]))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (group[owner[1:]] != group[owner[:-1]])
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    held = np.diff(np.append(start, len(owner)))
    of = group[owner[start]] if len(start) else np.zeros(0, np.int64)
    common = (held > 64) & (held >= k[of] / 8)  # held by many of a large group: counted by a product of matrices
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for g in np.unique(of[common]).tolist():
        runs = np.flatnonzero(common & (of == g))
        overlap = np.zeros((k[g], k[g]), np.float32)
        for some in np.array_split(runs, -(-len(runs) // 2048)):
            table = np.zeros((k[g], len(some)), np.float32)
            for c, r in enumerate(some.tolist()):
                table[owner[start[r] : start[r] + held[r]] - first[g], c] = 1
            overlap += table @ table.T
        i, j = np.nonzero(np.triu(overlap, 1))
        if side[first[g]] != WITHIN:
            ok = side[first[g] + i] != side[first[g] + j]
            i, j = i[ok], j[ok]
        out.append((base[g] + i * k[g] + j, overlap[i, j].astype(np.int64)))
    back = np.where(common[run], 0, np.arange(len(owner)) - start[run]) if len(run) else np.zeros(0, np.int64)  # earlier members of the run
    for some in np.split(np.flatnonzero(back), np.searchsorted(np.cumsum(back[back > 0]), np.arange(PAIRS, int(back.sum()), PAIRS))):
        n = back[some]
        j = np.repeat(owner[some], n)
        i = owner[np.repeat(start[run[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ok = (side[i] == WITHIN) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        g = group[i]
        out.append(np.unique(base[g] + (i - first[g]) * k[g] + j - first[g], return_counts=True))
    pairs, counts = (np.concatenate(x) for x in zip(*out, strict=True))
    uniq, inverse = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, inverse, counts)
    return uniq, total


def similar_pairs(pair: np.ndarray, overlap: np.ndarray, group: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of the pairs whose overlap, summed over the fragments, reaches the threshold."""
    k = np.bincount(group)
    first, base = np.cumsum(k) - k, np.cumsum(k * k) - k * k
    g = np.searchsorted(base, pair, side="right") - 1
    i, j = np.divmod(pair - base[g], k[g])
    i, j = first[g] + i, first[g] + j
    ok = overlap * (num + den) >= (n[i] + n[j]) * num
    return i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each node reaches over the edges (i, j)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, least[i], low)
        np.minimum.at(least, least[j], low)
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            return least


def _links(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b, links): a forest over the similar classes (b not null), and each class's number of similar rows in one pair of blocks (b null); their sum is the whole join's."""
    num, den = threshold
    # joins of two written tables have nothing but an exchange on each side: a hot key's rows are split as they are read.
    # sizes of similar sets are in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("long")
    tokens = sets.select("v", band.alias("band"), F.explode("prefix").alias("token"))
    hubs = checkpoint(tokens.groupBy("token", "band").agg(F.min("v").alias("hub"), F.count("*").alias("n")))
    stars = tokens.join(hubs.where("n > 1").select("token", "band", "hub"), ["token", "band"]).where("v <> hub").select("v", "hub")
    bridges = hubs.select("token", "band", F.col("hub").alias("v")).join(hubs.select("token", (F.col("band") - 1).alias("band"), "hub"), ["token", "band"]).where("v <> hub").select("v", "hub")
    groups = components(stars.union(bridges).distinct(), "v", "hub").select(F.col("node").alias("v"), F.col("component").alias("g"))
    groups = checkpoint(groups.join(sets.select("v", "m"), "v"))
    n_blocks = groups.groupBy("g").agg(F.ceil(F.greatest(F.sum("m") / BLOCK_GRAMS, F.count("*") / BLOCK_CLASSES)).cast("int").alias("n_blocks"), F.count("*").alias("n"))
    mine = F.pmod(F.xxhash64("v"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    rows = join_salted(groups, n_blocks, ["g"], "v").select("v", "m", "g", mine.alias("mine"), other)
    side = F.when(F.col("mine") == F.col("other"), WITHIN).otherwise((F.col("mine") > F.col("other")).cast("int"))
    rows = rows.select("v", "m", side.alias("side"), F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"))
    work = rows.agg(F.sum("m")).first()[0] or 0
    rows = rows.drop("m").withColumn("w", F.pmod(F.xxhash64("g"), F.lit(int(max(16, work // BLOCK_GRAMS)))))
    segment = F.posexplode(F.transform("cut", lambda n, f: F.slice("grams", (F.aggregate(F.slice("cut", 1, f), F.lit(0).cast("long"), lambda a, x: a + x) + 1).cast("int"), n.cast("int")))).alias("f", "segment")
    rows = rows.join(sets.select("v", "n", "size", segment), "v")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        """One fragment's partial overlaps, and with the first fragment what is known of the members."""
        w, fragment = (x.as_py() for x in key)
        table = table.combine_chunks().sort_by([("g", "ascending"), ("v", "ascending")])
        _, group = np.unique(table["g"].to_numpy(), return_inverse=True)
        segments = table["segment"].combine_chunks()
        segments = segments.chunk(0) if isinstance(segments, pa.ChunkedArray) else segments
        offsets = segments.offsets.to_numpy().astype(np.int64)
        pair, overlap = partial_overlaps(group, table["side"].to_numpy(), offsets - offsets[0], segments.flatten().to_numpy())
        out = [(w, fragment, B.planes(overlap) + B.pack(pair.astype(np.uint64)))]
        if fragment == 0:
            out.append((w, -1, pickle.dumps([group, *(table[c].to_numpy() for c in ("v", "n", "size"))])))
        return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("w", "f", "data"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        """Sums every pair's partial overlaps."""
        data = dict(zip(table["f"].to_pylist(), table["data"].to_pylist(), strict=True))
        group, v, n, size = pickle.loads(data.pop(-1))
        _, pairs, counts = B.keys_and_counts([*data.values()])
        pair, inverse = np.unique(pairs, return_inverse=True)
        overlap = np.zeros(len(pair), np.int64)
        np.add.at(overlap, inverse, counts)
        i, j = similar_pairs(pair.astype(np.int64), overlap, group, n, num, den)
        links = np.zeros(len(v), np.int64)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        least, some = forest(len(v), i, j), np.flatnonzero(links)
        tied = np.flatnonzero(least != np.arange(len(v)))
        a, b = np.concatenate([v[tied], v[some]]), np.concatenate([v[least[tied]], v[some]])
        n_links = np.concatenate([np.zeros(len(tied), np.int64), links[some]])
        of_links = np.arange(len(a)) >= len(tied)
        return pa.table({"a": a, "b": pa.array(b, mask=of_links), "links": pa.array(n_links, mask=~of_links)})

    partial = rows.groupBy("w", "f").applyInArrow(B.lean(count), "w long, f long, data binary")
    out = checkpoint(partial.groupBy("w").applyInArrow(B.lean(add_up), "a long, b long, links long"))
    release(hubs, groups)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """(id, th, n, comp, component, n_links): documents linked, directly or through others, by Jaccard >= num / den.

    component is the least id reachable; th is xxhash64 of the text; comp is equal for linked rows, null for empty sets.
    n_links is the number of other rows with Jaccard >= num / den, rows of equal sets among them.
    """
    members = checkpoint(set_classes(docs, id_col, text, size))
    sets = checkpoint(_candidate_sets(docs, members, id_col, text, size, threshold))
    links = _links(sets, threshold)
    tree = components(links.where("b is not null")).select(F.col("node").alias("v"), F.col("component").alias("root"))
    partners = links.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("partners"))
    found = sets.select("v", "cls", "cls2").join(partners, "v", "left").join(tree, "v", "left").drop("v")
    # each class's least id and rows, then each component's; rows get them by their class
    classes = members.where("cls is not null").groupBy("cls", "cls2").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    classes = checkpoint(classes.join(found, ["cls", "cls2"], "left"))
    roots = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("low"), F.count("*").alias("n"))
    comp = F.when(F.col("root").isNull(), F.struct("cls", "cls2")).otherwise(F.struct(F.col("root").alias("cls"), F.lit(None).cast("long").alias("cls2")))
    linked = classes.where("root is null").withColumn("low", F.col("least")).unionByName(join_salted(classes.where("root is not null"), roots, ["root"], "cls"))
    linked = checkpoint(linked.select("cls", "cls2", comp.alias("comp"), F.col("low").alias("component"), (F.col("rows") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")))
    release(sets, links, classes)
    some = members.where("cls is not null").join(linked, ["cls", "cls2"])
    none = members.where("cls is null").select("id", "th", "n", F.lit(None).cast(linked.schema["comp"].dataType).alias("comp"), F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return some.select("id", "th", "n", "comp", "component", "n_links").unionByName(none)
