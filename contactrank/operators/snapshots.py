"""Confirmed contacts as versions of a stored table, with what searches and pages need beside the rows.

    data/<write>/bucket=<b>/...     rows with their lower-cased search columns, range-sorted by owner, file and ordinal
    index/<write>/...               per data file a Bloom filter of the trigrams in its search columns
    counts/<write>/...              rows per bucket, owner and source file
    manifests/<version>.json        which write holds each bucket

Owners share a fixed number of buckets, so 100,000 owners are no 100,000 folders. A change (contacts confirmed, or an
owner's confirmation revoked) writes the buckets that it touches anew, under a name of its own, and then one manifest.
A manifest is created under the next number and never changed; of two writers of one number the file system lets one
create it, and the other starts again from that version. A reader takes the newest complete manifest, so it sees all of
a change or nothing. Files of older versions stay for their readers until `vacuum`.

A substring of three code points or more is in a text only if its trigrams are. A search opens the files whose filters
hold all trigrams of one of its tokens; one with a shorter token opens all of its owner's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactrank.functions.schema import CONTACTS, DEFAULT_PAGE_SIZE, MAX_RESULTS, WEIGHTS
from contactrank.functions.tables import checkpoint, drop_folder, release
from contactrank.functions.text import tokens_of
from contactrank.operators import preview, search

BUCKETS = 64
ROWS_PER_FILE = 500_000
#: A filter's size, 2 bits a trigram: a file of 50,000 different trigrams lets through 29 % of those that it does not hold.
FILTER_BITS = 1 << 17
FILTERS_HELD = 256
#: Code points that a filter takes at once; they need some 100 bytes each.
CODES_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 256
ATTEMPTS = 5

_ROW = [f.name for f in CONTACTS]
_LOWERED = [f"_{f}" for f in WEIGHTS]
_ORDER = ["owner_id", "source_file", "row_ord"]


def bucket_of(owner: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(owner.cast("string")), F.lit(n)).cast("int")


# manifests


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    with_bytes = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_bytes, "UTF-8")
    finally:
        with_bytes.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all manifests, the newest first."""
    fs, at = _at(spark, f"{path}/manifests")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest complete manifest, or that of a version; one without buckets where there is none."""
    for v in versions(spark, path):
        if version in (None, v):
            try:
                return json.loads(_read(spark, f"{path}/manifests/{v:012}.json"))
            except ValueError:  # still being written
                continue
    return {"version": 0, "n_buckets": BUCKETS, "buckets": {}}


def _publish(spark: SparkSession, path: str, content: dict) -> bool:
    """Creates the manifest unless another writer has done so."""
    fs, at = _at(spark, f"{path}/manifests/{content['version']:012}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(at):
            return False
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return True


def _folders(path: str, kind: str, of: dict, buckets: list[str] | None = None) -> list[str]:
    return [f"{path}/{kind}/{write}/bucket={b}" for b, write in of["buckets"].items() if buckets is None or b in buckets]


# writing


def _stored(rows: DataFrame, path: str, write: str) -> list[int]:
    """Writes the rows, their filters and counts; the buckets that there are."""
    n = rows.count()
    if not n:
        return []
    spark = rows.sparkSession
    files = rows.repartitionByRange(-(-n // ROWS_PER_FILE), "bucket", *_ORDER).sortWithinPartitions("bucket", *_ORDER)
    files.write.partitionBy("bucket").parquet(f"{path}/data/{write}")
    data = spark.read.parquet(f"{path}/data/{write}")
    index = trigram_filters(data.select(F.regexp_extract("_metadata.file_path", "(bucket=[0-9]+/[^/]*)$", 1).alias("file"), *_LOWERED))
    index.withColumn("bucket", F.regexp_extract("file", "^bucket=([0-9]+)", 1).cast("int")).write.partitionBy("bucket").parquet(f"{path}/index/{write}")
    counts = data.groupBy("bucket", "owner_id", "source_file").agg(F.count("*").alias("row_count"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "owner_id", "source_file").write.partitionBy("bucket").parquet(f"{path}/counts/{write}")
    return [r.bucket for r in counts.select("bucket").distinct().collect()]


def replace(spark: SparkSession, path: str, owners: DataFrame, rows: DataFrame | None, n_buckets: int = BUCKETS) -> int:
    """A new version in which the owners have these rows and no others; its number. n_buckets: of the first version, and so of all."""
    for _ in range(ATTEMPTS):
        base = manifest(spark, path)
        n = base["n_buckets"] if base["version"] else n_buckets
        owned = owners.select(F.col("owner_id").cast("string").alias("owner_id")).distinct()
        touched = {str(r[0]) for r in owned.select(bucket_of(F.col("owner_id"), n)).distinct().collect()}
        old = _folders(path, "data", base, sorted(touched))
        kept = spark.read.schema(_schema()).parquet(*old).join(owned, "owner_id", "left_anti") if old else None
        new = None if rows is None else search.lowered(rows.select(*_ROW).withColumn("owner_id", F.col("owner_id").cast("string")))
        both = [d.select(*_ROW, *_LOWERED) for d in (kept, new) if d is not None]
        write = uuid4().hex
        there = _stored((both[0] if len(both) == 1 else both[0].unionByName(both[1])).withColumn("bucket", bucket_of(F.col("owner_id"), n)), path, write) if both else []
        buckets = {b: w for b, w in base["buckets"].items() if b not in touched} | {str(b): write for b in there}
        if _publish(spark, path, {"version": base["version"] + 1, "n_buckets": n, "buckets": buckets}):
            return base["version"] + 1
        for kind in ("data", "index", "counts"):
            drop_folder(spark, f"{path}/{kind}/{write}")
    raise RuntimeError(f"{ATTEMPTS} other writers were first")


def confirm(staged: DataFrame, path: str, n_buckets: int = BUCKETS) -> bool:
    """Replaces the confirmed contacts of the owners in `staged`; does nothing if it is empty.

    A change rewrites its owners' buckets, so the first confirmation sets their number by the size to come: as many as
    make a bucket a few GB.
    """
    if staged.isEmpty():
        return False
    rows = checkpoint(staged.select(*_ROW))
    replace(staged.sparkSession, path, rows, rows, n_buckets)
    release(rows)
    return True


def revoke(spark: SparkSession, path: str, owners: list[str]) -> None:
    """Withdraws owners' confirmations; those who have none change nothing."""
    if owners and not read(spark, path).where(F.col("owner_id").isin(owners)).isEmpty():
        replace(spark, path, spark.createDataFrame([(o,) for o in owners], "owner_id string"), None)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes older versions than the newest `keep`, and the files that only they name."""
    numbers = versions(spark, path)
    named = {w for v in numbers[:keep] for w in manifest(spark, path, v)["buckets"].values()}
    gone = {w for v in numbers[keep:] for w in manifest(spark, path, v)["buckets"].values()} - named
    for v in numbers[keep:]:
        drop_folder(spark, f"{path}/manifests/{v:012}.json")
    for write in gone:
        for kind in ("data", "index", "counts"):
            drop_folder(spark, f"{path}/{kind}/{write}")


# reading


def _schema() -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in CONTACTS), *(f"{c} string" for c in _LOWERED)])


def _bucket(spark: SparkSession, owner: str, of: dict) -> list[str]:
    return [str(spark.range(1).select(bucket_of(F.lit(owner), of["n_buckets"])).first()[0])]


def _rows_of(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.schema(_schema()).parquet(*files) if files else spark.createDataFrame([], _schema())


def read(spark: SparkSession, path: str, version: int | None = None, owner: str | None = None) -> DataFrame:
    """Confirmed contacts with their lower-cased columns, of one version and, if it is named, of one owner."""
    of = manifest(spark, path, version)
    rows = _rows_of(spark, _folders(path, "data", of, None if owner is None else _bucket(spark, owner, of)))
    return rows if owner is None else rows.where(F.col("owner_id") == owner)


def _places(codes: np.ndarray) -> np.ndarray:
    """Two bits for each three code points in a row."""
    c = codes.astype(np.uint64)
    h = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    both = np.concatenate([h, h * np.uint64(0xBF58476D1CE4E5B9)])
    return (both >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(files: pa.Array) -> Iterator[tuple[str, int, int]]:
    """Equal neighbours: value, begin and end."""
    begin = 0
    for value, of in groupby(files.to_pylist()):
        end = begin + sum(1 for _ in of)
        yield value, begin, end
        begin = end


def _pieces(texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """Code points of all texts in pieces of CODES_AT_ONCE; a longer text is cut so that each of its trigrams is in a piece."""
    held, n = [], 0
    for text in texts:
        for at in range(0, len(text or ""), CODES_AT_ONCE):
            held.append(text[at : at + CODES_AT_ONCE + 2])
            n += len(held[-1]) + 1
            if n >= CODES_AT_ONCE:
                yield _codes("\n".join(held) + "\n\n")
                held, n = [], 0
    # no token holds a line break, so trigrams across two texts are never asked for
    if held:
        yield _codes("\n".join(held) + "\n\n")


def trigram_filters(rows: DataFrame) -> DataFrame:
    """file and bits, from rows of a file's name and texts: filters per batch, then their union per file."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"file": pa.array(list(held), pa.string()), "bits": pa.array([np.packbits(b).tobytes() for b in held.values()], pa.binary())})
            held.clear()
            return out

        for batch in batches:
            files, *fields = batch.columns
            for file, begin, end in _runs(files):
                if file not in held and len(held) >= FILTERS_HELD:
                    yield told()
                bits = held.setdefault(file, np.zeros(FILTER_BITS, bool))
                some = ((at, min(ROWS_AT_ONCE, end - at)) for at in range(begin, end, ROWS_AT_ONCE))
                for codes in _pieces(t for at, n in some for f in fields for t in f.slice(at, n).to_pylist()):
                    bits[_places(codes)] = True
        yield told()

    def union(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()])
        return pa.table({"file": pa.array([key[0].as_py()], pa.string()), "bits": pa.array([bits.tobytes()], pa.binary())})

    kind = "file string, bits binary"
    return rows.mapInArrow(some, kind).groupBy("file").applyInArrow(union, kind)


def _holds(bits: bytes, asked: list[np.ndarray]) -> bool:
    """Whether a filter has all places of one of the tokens."""
    of = np.frombuffer(bits, np.uint8)
    return any((of[p >> 3] >> (7 - (p & 7)) & 1).all() for p in asked)


def files_with(index: DataFrame, tokens: list[str]) -> DataFrame:
    """The files that may hold one of the tokens."""
    if any(len(t) < 3 for t in tokens):
        return index.select("file")
    asked = [_places(_codes(t)) for t in tokens]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_holds(b.as_py(), asked) for b in batch.column("bits")]
            yield pa.RecordBatch.from_arrays([batch.column("file").filter(pa.array(found, pa.bool_()))], names=["file"])

    return index.select("file", "bits").mapInArrow(keep, "file string")


def candidates(spark: SparkSession, path: str, tokens: list[str], owner: str | None = None) -> DataFrame:
    """Confirmed contacts in the files that may hold one of the tokens; names of files are what the driver gets."""
    of = manifest(spark, path)
    buckets = None if owner is None else _bucket(spark, owner, of)
    files = []
    writes: dict[str, list[str]] = {}
    for b, write in of["buckets"].items():
        if buckets is None or b in buckets:
            writes.setdefault(write, []).append(b)
    for write, bs in writes.items():
        index = spark.read.schema("file string, bits binary").parquet(*(f"{path}/index/{write}/bucket={b}" for b in bs))
        files += [f"{path}/data/{write}/{r.file}" for r in files_with(index, tokens).collect()]
    rows = _rows_of(spark, sorted(files))
    return rows if owner is None else rows.where(F.col("owner_id") == owner)


def search_confirmed(spark: SparkSession, path: str, query: str, owner: str | None = None, k: int = MAX_RESULTS) -> DataFrame:
    """The k best confirmed contacts, of one owner if it is named; none without tokens or confirmed contacts."""
    tokens = tokens_of(query)
    rows = candidates(spark, path, tokens, owner) if tokens else _rows_of(spark, [])
    return search.search(rows, query, k)


def page(spark: SparkSession, path: str, owner: str, source_file: str, number: int, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A page of a stored file. Its length is looked up, and a range of the sorted ordinals is read; past the last page, the last."""
    of = manifest(spark, path)
    bucket = _bucket(spark, owner, of)
    own = (F.col("owner_id") == owner) & (F.col("source_file") == source_file)
    counts = _folders(path, "counts", of, bucket)
    found = spark.read.schema("owner_id string, source_file string, row_count long").parquet(*counts).where(own).first() if counts else None
    last = max(0, -(-(found.row_count if found else 0) // size) - 1)
    at = min(max(number, 0), last) * size
    rows = _rows_of(spark, _folders(path, "data", of, bucket)).where(own & (F.col("row_ord") >= at) & (F.col("row_ord") < at + size))
    return preview.preview(rows)
