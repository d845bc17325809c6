"""Operator 10: BPE encoding and decoding with forced-boundary splitting.

From the vocabulary alone: two neighbouring symbols that stand next to each other inside no token can never be
merged across, whatever surrounds them, so the place between them is a certain cut. A text is cut at white space,
at the tokenizer's word pattern and at these pairs. Fragments are short and few in kind; each is merged on its own,
by rank, and a text's ids are its fragments' ids in order.

A batch's texts are cut at ASCII white space at once, the chunks are dictionary-encoded by Arrow, and only a batch's
distinct chunks are looked up or encoded; ids and decoded texts are then gathered by chunk number. Rows are
independent: no shuffle, one task per input split, and per-worker memory bounded by CACHE entries.

The tokenizer's file is a parameter (a local path on every machine). Its own normaliser and pre-tokenizer are run on
distinct chunks, so that letters and cases are those of its Unicode version; vocabulary, merges, suffix and added
tokens are read from it. A file for which chunks between white space are not independent (a pre-tokenizer that keeps
white space, added tokens that strip or hold white space, a decoder other than the plain one) raises ValueError.

Defined results: null text gives no ids and decodes to the empty text; empty text likewise; very long words are
merged with a heap in n log n steps; repeated rows give repeated results; an empty table gives none; columns come
back untouched in `row`.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactrank.llm import fingerprints as P
from contactrank.llm.blocks import lean_map, slices, spread

#: Words and chunks that a worker remembers.
CACHE = 100_000
#: Rank of a pair that no merge has.
NEVER = 1 << 60
#: Bytes of text that are encoded at once.
SLICE = 4 << 20


class WordBpe:
    """A BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        self.library = Tokenizer.from_file(path)
        odd = model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec["decoder"]
        if odd or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added) or self.pieces("a \t\n\x0b\x0c\r b") != self.pieces("a") + self.pieces("b"):
            raise ValueError(f"chunks between white space are not independent in {path}")
        self.pattern = self.ascii_pattern(spec)
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        # symbols: a byte, plus 256 at a word's end; the pre-tokenizer's letter for each byte is known from its own output
        letters = self.byte_letters(pre_tokenizers)
        self.byte_of = {ord(letter): chr(b) for b, letter in enumerate(letters)}
        names = [*letters, *(x + self.suffix for x in letters)]
        code = {name: k for k, name in reversed([*enumerate(names)])}
        self.symbol_id = np.array([self.ids.get(name, -1) for name in names], np.int64)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        pairs = np.array([self.ids[a] << 32 | self.ids[b] for a, b in merges], np.int64)
        self.pair_order = np.argsort(pairs, kind="stable")
        self.pairs, self.merged = pairs[self.pair_order], np.array([self.ids[a + b] for a, b in merges], np.int64)
        self.inside = np.zeros((512, 512), bool)  # do the symbols stand next to each other inside a token?
        for token in self.ids:
            s = [code.get(x, -1) for x in self.symbols(token)]
            if min(s) >= 0:
                self.inside[s[:-1], s[1:]] = True
        self.chunks: dict[str, tuple[bytes, str]] = {}  # without white space: ids and decoded text
        self.words: dict[bytes, tuple[bytes, str]] = {}  # pieces of the pre-tokenizer

    @staticmethod
    def ascii_pattern(spec: dict) -> regex.Pattern | None:
        """The word pattern for texts of ASCII letters, whose classes no Unicode version changes, or None if the file has steps other than these."""
        normal, pieces = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
        if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or [p["type"] for p in pieces.get("pretokenizers", [])] != ["Split", "ByteLevel"]:
            return None
        split, level = pieces["pretokenizers"]
        if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"] or "Regex" not in split["pattern"]:
            return None
        return regex.compile(split["pattern"]["Regex"] + r"|\n")

    @staticmethod
    def byte_letters(pre_tokenizers) -> list[str]:
        """The letter that stands for each byte."""
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letter: dict[int, str] = {}
        for lead in (b"", *(bytes([b, *[0x90] * (n - 1)]) for n, leads in ((2, range(0xC2, 0xE0)), (3, range(0xE1, 0xED)), (4, range(0xF1, 0xF4))) for b in leads)):
            for k in range(128) if not lead else range(0x80, 0xC0):
                raw = bytes([k]) if not lead else lead[:-1] + bytes([k])
                letter |= dict(zip(raw, "".join(x for x, _ in level.pre_tokenize_str(raw.decode())), strict=True))
        rest = sorted(set(level.alphabet()) - set(letter.values()))  # of bytes that no text has
        return [letter.get(b) or rest.pop() for b in range(256)]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of the normalised text."""
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return [*token[:-1], token[-1] + self.suffix]
        return list(token)

    def cuts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that end at `ends`, and where fragments begin: at words and at forced boundaries."""
        code = data.astype(np.int64)
        if self.suffix:
            code[ends - 1] += 256
        begins = np.ones(len(code), bool)
        begins[1:] = ~self.inside[code[:-1], code[1:]]
        begins[ends[:-1]] = True
        return code, np.flatnonzero(begins)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging two token ids, or NEVER."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.pair_order[at], NEVER)

    def merge_table(self, part: np.ndarray) -> np.ndarray:
        """Merges the rows of a table of ids (-1: nothing more), all rows a merge at a time: the pair of least rank, the leftmost of equals."""
        out = part.copy()
        rows = np.arange(len(part))
        ranks = self.rank(part[:, :-1], part[:, 1:])
        column = np.arange(part.shape[1])
        while len(rows):
            k = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), k]
            go = best < NEVER
            out[rows[~go]] = part[~go]
            rows, part, ranks, k, best = rows[go], part[go], ranks[go], k[go], best[go]
            if not len(rows):
                break
            at = np.arange(len(rows))
            part = np.pad(part, ((0, 0), (0, 1)), constant_values=-1)[at[:, None], column + (column > k[:, None])]
            part[at, k] = self.merged[best]
            ranks = np.pad(ranks, ((0, 0), (0, 1)), constant_values=NEVER)[at[:, None], column[:-1] + (column[:-1] > k[:, None])]
            follows = np.minimum(k, ranks.shape[1] - 1)
            ranks[at, follows] = np.where(k < ranks.shape[1], self.rank(part[at, k], part[at, np.minimum(k + 1, part.shape[1] - 1)]), ranks[at, follows])
            before = np.maximum(k - 1, 0)
            ranks[at, before] = np.where(k > 0, self.rank(part[at, before], part[at, k]), ranks[at, before])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for one long fragment, with a heap."""
        part = [*ids]
        ranks = lambda some: self.rank(np.array([part[x] for x, _ in some], np.int64), np.array([part[y] for _, y in some], np.int64)).tolist() if some else []
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        every = [(k, k + 1) for k in range(len(part) - 1)]
        heap = [(r, k, part[k], part[k + 1]) for (k, _), r in zip(every, ranks(every), strict=True) if r < NEVER]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if part[k] != a or j >= len(part) or part[j] != b:
                continue  # a neighbour was merged meanwhile
            part[k], part[j], after[k] = int(self.merged[r]), -2, after[j]
            if after[k] < len(part):
                before[after[k]] = k
            near = [(x, after[x]) for x in (before[k], k) if x >= 0 and after[x] < len(part)]
            for (x, y), r in zip(near, ranks(near), strict=True):
                if r < NEVER:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p >= 0]

    def learn(self, words: list[bytes]) -> None:
        """Encodes words, as the pre-tokenizer's bytes, all at once: their fragments on their own, then one after the other."""
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
        code, start = self.cuts(data, ends)
        size = np.diff(np.append(start, len(code)))
        raw = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(2 * np.append(start, len(code))), pa.py_buffer(code.astype(np.uint16))]).dictionary_encode()
        which = raw.indices.to_numpy()
        one = np.zeros(len(raw.dictionary), np.int64)
        one[which] = np.arange(len(start))
        first, n = start[one], size[one]
        ids = self.symbol_id[code]
        encoded: list[list[int]] = [[]] * len(one)
        for low, high in ((0, 1), (1, 4), (4, 8), (8, 16), (16, 64)):
            some = np.flatnonzero((n > low) & (n <= high))
            column = np.arange(high)
            table = np.where(column < n[some][:, None], ids[np.minimum(first[some][:, None] + column, len(ids) - 1)], -1)
            if high > 1:
                table = self.merge_table(table)
            found, kept = table.ravel(), (table >= 0).sum(axis=1)
            found, upto = found[found >= 0].tolist(), np.concatenate([[0], np.cumsum(kept)]).tolist()
            for k, lo, hi in zip(some.tolist(), upto, upto[1:], strict=False):
                encoded[k] = found[lo:hi]
        for k in np.flatnonzero(n > 64).tolist():
            encoded[k] = self.merge_long(ids[first[k] : first[k] + n[k]].tolist())
        bounds = np.searchsorted(start, np.concatenate([[0], ends])).tolist()
        which, token = which.tolist(), self.tokens
        if len(self.words) + len(words) > CACHE:
            self.words.clear()
        for word, lo, hi in zip(words, bounds, bounds[1:], strict=False):
            own = encoded[which[lo]] if hi == lo + 1 else [i for f in which[lo:hi] for i in encoded[f]]
            self.words[word] = array("i", own).tobytes(), " ".join([token[i] for i in own])

    def parts(self, text: str) -> list[bytes | int]:
        """Words of a chunk, as bytes, and special tokens, as ids."""
        as_bytes = lambda t: [p.translate(self.byte_of).encode("latin-1") for p in self.pieces(t)]
        if not (self.special_pattern and self.special_pattern.search(text)):
            return as_bytes(text)
        out, begin = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*as_bytes(text[begin : m.start()]), self.special[m.group()]]
            begin = m.end()
        return out + as_bytes(text[begin:])

    def known(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Ids, as 32-bit integers, of chunks without ASCII white space, and what they decode to."""
        new = [c for c in chunks if c not in self.chunks]
        mark = tuple({t[0] for t in self.special})
        plain = [c for c in new if c.isascii() and not any(m in c for m in mark)] if self.pattern else []
        simple = {*plain}
        parts = [(c, self.parts(c)) for c in new if c not in simple]
        if plain:
            own: list[bytes] = []
            every = iter(plain)
            for p in self.pattern.findall("\n".join(plain).lower() + "\n"):
                if p == "\n":
                    parts.append((next(every), own))
                    own = []
                else:
                    own.append(p.encode())
        missing = list(dict.fromkeys(p for _, own in parts for p in own if isinstance(p, bytes) and p not in self.words))
        had = {p: self.words[p] for _, own in parts for p in own if p in self.words} if len(self.words) + len(missing) > CACHE else None
        if missing:
            self.learn(missing)
        words = self.words | had if had else self.words
        if len(self.chunks) + len(parts) > CACHE:
            keep = {c: self.chunks[c] for c in chunks if c in self.chunks}
            self.chunks.clear()
            self.chunks |= keep
        for c, own in parts:
            if len(own) == 1 and isinstance(own[0], bytes):
                self.chunks[c] = words[own[0]]
            else:
                made = [words[p] if isinstance(p, bytes) else (array("i", [p]).tobytes(), self.tokens[p]) for p in own]
                self.chunks[c] = b"".join([ids for ids, _ in made]), " ".join([told for ids, told in made if ids])
        return [self.chunks[c] for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
        """Id lists and decoded texts."""
        data, offsets = P.concat(texts)
        words = P.Words(data, offsets)
        which, distinct = P.dictionary(words)
        made = self.known(distinct.cast(pa.large_string()).to_pylist())
        size = np.array([len(ids) // 4 for ids, _ in made], np.int64)
        flat = np.frombuffer(b"".join([ids for ids, _ in made]), np.int32)
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        first = np.cumsum(size) - size
        ids = flat[np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])]
        lists = pa.ListArray.from_arrays(pa.array(upto[words.first], pa.int32()), pa.array(ids, pa.int32()))
        some = np.concatenate([[0], np.cumsum(n > 0)])  # a chunk without ids leaves no space behind
        told = pa.array([text for _, text in made], pa.string()).take(pa.array(which[n > 0]))
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(some[words.first], pa.int32()), told), " ")
        return lists, decoded

    def forget(self) -> None:
        """Empties the caches: a worker outlives the stage that fills them."""
        self.chunks.clear()
        self.words.clear()

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """Read once per worker."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """row (the input's columns) and ids array<int> of every whole text.

    decoded: name of one more column, the text that the ids decode to, made by the same worker as the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            done = 0
            for texts in slices(pc.struct_field(batch.column("row"), text), SLICE):
                ids, told = bpe.encode(texts)
                columns = {"row": batch.column("row").slice(done, len(texts)), "ids": ids}
                if decoded:
                    columns[decoded] = told
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
                done += len(texts)
        bpe.forget()

    rows = spread(docs).select(F.struct("*").alias("row"))
    more = [T.StructField(decoded, T.StringType())] if decoded else []
    return rows.mapInArrow(lean_map(run), T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), *more]))


def decode(frame: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of each id list (null: empty); special tokens are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(name, T.StringType())]))
