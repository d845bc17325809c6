"""Connected components of an edge list by alternating large-star and small-star rounds, on DataFrames.

Rounds grow with the logarithm of a component's diameter. Each round is two minima per node, added up before they are
shuffled, and two joins that deal a node's edges to several tasks, so a hub's neighbours are never gathered in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactrank.functions.tables import checkpoint, checkpoint_folder, release  # noqa: F401  the cuts that loops and stages use

#: Rows of a key above which they are dealt to several tasks, and keys that can have more: these are sent to all tasks.
HEAVY_ROWS = 20_000
MAX_HEAVY = 500_000


def join_salted(many: DataFrame, one: DataFrame, keys: list[str], *by: str, total: int | None = None) -> DataFrame:
    """Inner join of many rows with one row per key, which has in `n` how many there are at most.

    A key's rows are dealt, by a hash of `by`, to as many tasks as their number asks for. Keys that need more than one are
    sent to all tasks to say so; by the bound on their rows there are at most MAX_HEAVY. total: the sum of n.
    """
    total = (one.agg(F.sum("n")).first()[0] or 0) if total is None else total
    salts = F.ceil(F.col("n") / max(HEAVY_ROWS, total // MAX_HEAVY)).cast("int")
    heavy = one.select(*keys, salts.alias("_salts")).where("_salts > 1")
    dealt = many.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return dealt.join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n"), [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the least node that it reaches. Loops and repeats do no harm."""
    now = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    last = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(state) == last:
            break
        last = tuple(state)
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_salted(both.where("v > u"), least, ["u"], "v", total=2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, and itself, are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_salted(large, least, ["u"], "v", total=state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e"))
        before, now = now, checkpoint(small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct())
        release(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
