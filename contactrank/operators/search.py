"""Weighted substring search with reasons.

A token counts for the first field, in priority order, whose lower-cased text holds it. One query's tokens are literals
and the score is a sum of generated conditions; many queries are matched by one automaton per owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactrank.functions.schema import FALLBACK_REASON, MAX_REASON_TOKENS, MAX_RESULTS, REASONS, WEIGHTS
from contactrank.functions.tables import MAX_BROADCAST_BYTES, checkpoint
from contactrank.functions.text import tokenize_query, tokens_of
from contactrank.operators.matching import in_blocks, match

_ORDER = ("source_file", "row_ord")
#: Literal tokens per query before the array form takes over, so that generated code stays small.
MAX_LITERAL_TOKENS = 24


def lowered(contacts: DataFrame) -> DataFrame:
    """Adds lower-cased search columns, where a stored snapshot does not have them already."""
    return contacts.withColumns({f"_{f}": F.lower(F.col(f)) for f in WEIGHTS if f"_{f}" not in contacts.columns})


def hit_weight(token: Column) -> Column:
    """Weight of the first field that holds the token, else 0."""
    out = F
    for f, w in WEIGHTS.items():
        out = out.when(F.contains(F.col(f"_{f}"), token), w)
    return out.otherwise(0)


def _hit_field(token: Column) -> Column:
    out = F
    for f in WEIGHTS:
        out = out.when(F.contains(F.col(f"_{f}"), token), f)
    return out


def score(tokens: list[str] | Column) -> Column:
    """The sum over all tokens, repeated ones again."""
    if isinstance(tokens, list) and len(tokens) <= MAX_LITERAL_TOKENS:
        return sum((hit_weight(F.lit(t)) for t in tokens), F.lit(0)).cast("int")
    array = F.array(*map(F.lit, tokens)) if isinstance(tokens, list) else tokens
    return F.aggregate(F.transform(array, hit_weight), F.lit(0), lambda a, x: a + x).cast("int")


def hits_by_field(tokens: Column) -> Column:
    """Struct of the distinct tokens that matched each field."""
    hits = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), _hit_field(t).alias("field")))

    def of(field: str) -> Column:
        return F.transform(F.filter(hits, lambda h: h["field"] == field), lambda h: h["token"]).alias(field)

    return F.struct(*map(of, WEIGHTS))


def matched_tokens(hits: Column) -> Column:
    """R2: distinct tokens by field, then by their order in the query."""
    return F.flatten(F.array(*(hits[f] for f in WEIGHTS)))


def match_reasons(hits: Column) -> Column:
    """A line for each of name, position, company and email; one for all tokens if none of these matched."""
    lines = [F.when(F.size(hits[f]) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(hits[f], 1, MAX_REASON_TOKENS), ", "))) for f, label in REASONS.items()]
    own = F.array_compact(F.array(*lines))
    everything = matched_tokens(hits)
    rest = F.when(F.size(everything) > 0, F.array(F.concat(F.lit(f"{FALLBACK_REASON}: "), F.array_join(everything, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(own) > 0, own).otherwise(rest)


def explain(scored: DataFrame, tokens: Column) -> DataFrame:
    """Adds matched_tokens and reasons; for the winners only, since the score alone decides the rank."""
    out = scored.withColumn("_hits", hits_by_field(tokens))
    return out.withColumns({"matched_tokens": matched_tokens(F.col("_hits")), "reasons": match_reasons(F.col("_hits"))}).drop("_hits", *(f"_{f}" for f in WEIGHTS))


def score_rows(contacts: DataFrame, query: str) -> DataFrame:
    """Every contact with its score."""
    return lowered(contacts).withColumn("score", score(tokens_of(query)))


def search(contacts: DataFrame, query: str, k: int = MAX_RESULTS) -> DataFrame:
    """The k best contacts, equal scores in input order; none if the query has no tokens."""
    tokens = tokens_of(query)
    best = score_rows(contacts, query).where("score > 0").orderBy(F.desc("score"), *_ORDER).limit(k)
    if not tokens:
        best = best.where(F.lit(False))
    return explain(best, F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>"))


def batch_search(contacts: DataFrame, searches: DataFrame, k: int = MAX_RESULTS) -> DataFrame:
    """B1: for each of the searches (search_id, owner_id, criteria) its owner's k best contacts.

    A contact is known by (owner_id, source_file, row_ord), a search by all its three columns: equal rows are one search,
    and others under one search_id are ranked apart. Contacts are matched once for all searches of their owner; only keys
    and scores of those that can be among the k best go to the ranking, and the text columns come back for the winners. The
    window's group limit keeps k rows per search and task before the shuffle, so neither a hot owner nor a hot search is gathered.
    """
    asked = searches.select("search_id", "owner_id", "criteria", tokenize_query(F.col("criteria")).alias("tokens")).where(F.size("tokens") > 0).dropDuplicates(["search_id", "owner_id", "criteria"])
    blocks = checkpoint(in_blocks(asked.withColumn("owner_id", F.col("owner_id").cast("string"))))
    rows = lowered(contacts).withColumn("owner_id", F.col("owner_id").cast("string"))
    scored = match(rows, blocks, MAX_BROADCAST_BYTES, k)
    by_search = Window.partitionBy("owner_id", "block", "place").orderBy(F.desc("score"), *_ORDER)
    best = scored.withColumn("rank", F.row_number().over(by_search)).where(F.col("rank") <= k)
    named = blocks.select("owner_id", "block", F.posexplode("searches").alias("place", "s")).select("owner_id", "block", "place", "s.*")
    won = best.join(named, ["owner_id", "block", "place"]).drop("block", "place").join(rows, ["owner_id", *_ORDER])
    return explain(won, F.col("tokens")).drop("tokens")


def search_guard(confirmed: DataFrame, searches: DataFrame) -> DataFrame:
    """The searches with `runs`: their criteria have a token and their owner has confirmed contacts."""
    owners = confirmed.select(F.col("owner_id").cast("string").alias("_owner")).distinct()
    asked = searches.join(owners, F.col("owner_id").cast("string") == F.col("_owner"), "left")
    return asked.withColumn("runs", F.col("_owner").isNotNull() & (F.coalesce(F.size(tokenize_query(F.col("criteria"))), F.lit(0)) > 0)).drop("_owner")


def result_cards(found: DataFrame) -> DataFrame:
    """P5: what a result shows; the first 3 reasons and the first 10 tokens."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    keep = [c for c in ("search_id", "rank") if c in found.columns]
    return found.select(
        *keep,
        *_ORDER,
        F.coalesce(blank("full_name"), F.lit("(no name)")).alias("name"),
        F.concat_ws(" • ", blank("position"), blank("company")).alias("subtitle"),
        "email",
        "url",
        "score",
        F.slice("reasons", 1, 3).alias("reasons"),
        F.slice("matched_tokens", 1, 10).alias("tokens"),
    )
