"""Operator 6: suffix-array dedup of byte strings, blockwise, with a difference cover.

The suffix array is built one bucket (a range of the byte order) at a time from the suffixes of a cover sample only.
The sample is a difference cover chosen by content, a synchronising set: any two equal strings of `size` bytes
hold a sample place at the same shift, which a cover of fixed residues also gives, but with 12 places in 133 instead of
2. The order of the sampled suffixes and the ranks of what precedes them, compared byte by byte in the bucket, settle every longer
tie: two strings are equal if, at their shift, they share a node of the bucket and a rank of the preceding bytes. See
`suffixes` for the steps; a bucket's memory is bounded for any number of copies.

Defined results: a null text is empty; strings never cross documents; texts shorter than `size` bytes are kept;
repeated rows are repeats of each other; each input row gives one output row with its columns in `row`; an empty
table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contactrank.llm import fingerprints as P
from contactrank.llm.suffixes import ARROW_SPANS, SPANS, Bytes, mark_repeated


def remove_repeated_bytes(docs: DataFrame, text: str = "text", size: int = 200, as_text: bool = False, **tuning: int) -> DataFrame:
    """Removes every byte covered by a `size`-byte string that also starts anywhere else.

    Returns row (the input's columns), kept (binary: the bytes left), n_bytes, n_removed and removed (spans of bytes).
    as_text: kept is a string without the bytes of characters that a cut went through. tuning: per_group, hot,
    hash_bits of `suffixes.mark_repeated`.
    """

    def finish(table: pa.Table, units: Bytes, drop: np.ndarray) -> pa.Table:
        kept, removed, counts = [], [], []
        for lo, hi in zip(units.first[:-1], units.first[1:], strict=True):
            start, end = P.spans_of(drop[lo:hi])
            removed.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            counts.append((hi - lo, int((end - start).sum())))
            kept.append(units.data[lo:hi][~drop[lo:hi]].tobytes())
        counts = np.array(counts, np.int64).reshape(-1, 2)
        return pa.table({"row": table["row"], "kept": pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), "n_bytes": counts[:, 0], "n_removed": counts[:, 1], "removed": pa.array(removed, ARROW_SPANS)})

    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields), False), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", SPANS)])
    return mark_repeated(docs, text, size, Bytes, finish, schema, **tuning)
