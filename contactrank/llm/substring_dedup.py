"""Operator 1: substring dedup by prefix-partitioned suffix trees over words.

Suffixes begin at words. They are split by prefixes of variable length into memory-sized groups; each group sorts its
suffixes, and common-prefix lengths of neighbours are the inner nodes of its subtree. Inner nodes at a depth of
`window` words or more, counting what precedes a sampled suffix alike, are the maximal repeats that cover the words to
remove. See `suffixes` for the sample, the groups, and prefixes that are too frequent for one group.

Defined results: a null text has no words and an empty kept text; texts shorter than the window are kept whole;
repeated rows are repeats of each other; every input row gives one output row; an empty table gives none. Other
columns, whatever their names, are returned untouched inside `row`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contactrank.llm import fingerprints as P
from contactrank.llm.suffixes import ARROW_SPANS, SPANS, Words, mark_repeated


def remove_repeated_passages(docs: DataFrame, text: str = "text", window: int = 35, **tuning: int) -> DataFrame:
    """Removes every word covered by a window of `window` words whose words also start anywhere else.

    Returns row (the input's columns), kept (the words left, joined by one space), n_words, n_removed and removed
    (spans of word numbers). tuning: per_group, hot, hash_bits of `suffixes.mark_repeated`.
    """

    def finish(table: pa.Table, units: Words, drop: np.ndarray) -> pa.Table:
        words = units.words
        data = words.data.tobytes()
        kept, removed, counts = [], [], []
        for d in range(table.num_rows):
            lo, hi = words.first[d], words.first[d + 1]
            own = data[words.offsets[d] : words.offsets[d + 1]].split()
            start, end = P.spans_of(drop[lo:hi])
            edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(own)]
            kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in own[a:b]))
            removed.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            counts.append((hi - lo, int(drop[lo:hi].sum())))
        counts = np.array(counts, np.int64).reshape(-1, 2)
        return pa.table({"row": table["row"], "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": counts[:, 0], "n_removed": counts[:, 1], "removed": pa.array(removed, ARROW_SPANS)})

    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields), False), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", SPANS)])
    return mark_repeated(docs, text, window, Words, finish, schema, **tuning)
