"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactrank.functions import tables
from contactrank.functions import text as X
from contactrank.functions.schema import COLUMN_SAMPLE_ROWS, WEIGHTS
from contactrank.operators import contacts as C
from contactrank.operators import portfolio as D
from contactrank.operators import preview as V
from contactrank.operators import rollups as U
from contactrank.operators import search as R
from contactrank.operators import snapshots as N
from contactrank.plans import adaptors as A
from contactrank.sources import clean_json as J
from contactrank.sources import csv_ranges as B
from contactrank.sources import exports as S

QUERY = "nation_1, machinery; #0000001 asia.example bolt 1997 machinery"
_TOKENS = X.tokens_of(QUERY)
_FIELDS = ["full_name", "position", "company", "email", "url", "connected_on"]


def _tokens() -> F.Column:
    return F.array(*map(F.lit, _TOKENS))


def _joined(cells) -> F.Column:
    return F.array_join(F.transform(cells, lambda c: F.concat(c["key"], F.lit("="), c["value"])), "|")


# text functions


def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 over the names of parts and customers."""
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit("_"), "p_brand").alias("key"))
    return rows.select("id", X.normalize_key(F.col("key")).alias("normalized"))


def tokenize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 over every document."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", X.tokenize_query(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "|").cast("binary")).alias("tokens_md5"))


def js_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 over padded names."""
    pad = F.lit("\t ﻿ \n")
    rows = A.table(spark, sf_dir, "customer").select("c_custkey", F.concat(pad, F.col("c_name"), F.lit("\u0085　\r ")).alias("x"))
    return rows.select("c_custkey", X.js_trim(F.col("x")).alias("trimmed"))


def to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 of an array and an object per event."""
    rows = A.table(spark, sf_dir, "events")
    array = X.array_to_text(F.array(F.col("event_type"), F.lit(None).cast("string"), F.col("user_id").cast("string")))
    return rows.select("event_id", array.alias("array_text"), X.object_to_text(F.from_json("props", "map<string,int>")).alias("object_text"))


# files


def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the CSV exports as parsed."""
    rows = S.raw_rows(S.parse_exports(A.csv_files(spark, sf_dir)))
    return rows.select("source_file", "row_ord", _joined(F.col("cells")).alias("row_text"))


def csv_header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of each file, found below its preamble."""
    rows = S.raw_rows(S.parse_exports(A.csv_files(spark, sf_dir))).where("row_ord = 0")
    return rows.select("source_file", F.array_join("cells.key", "|").alias("header"))


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: cells of one header in all files: count and length by key."""
    rows = S.raw_rows(S.parse_exports(A.csv_files(spark, sf_dir))).select(F.explode("cells").alias("c"))
    return rows.groupBy(F.col("c.key").alias("col_name")).agg(F.count("*").alias("n"), F.sum(F.char_length("c.value")).alias("chars"))


def derive_full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived full name of every CSV row."""
    rows = S.raw_rows(S.parse_exports(A.csv_files(spark, sf_dir)))
    return rows.select("source_file", "row_ord", C.get_field(F.col("cells"), "full").alias("full_name"))


def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the JSON exports, values as text."""
    rows = S.raw_rows(S.parse_exports(A.json_files(spark, sf_dir)))
    return rows.select("source_file", "row_ord", _joined(F.col("cells")).alias("row_text"))


def json_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of JSON exports that are proved clean, by native columns only."""
    rows = S.raw_rows(J.parse_json(A.clean_json_files(spark, sf_dir)))
    return rows.select("source_file", "row_ord", _joined(F.col("cells")).alias("row_text"))


def csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per owner, each parsed in ranges of 16 KB that cut it anywhere."""
    path = f"{tables.checkpoint_folder(spark)}/exports-{uuid4().hex}"
    A.write_csv_by_owner(spark, sf_dir, path)
    with B.ranges_of(spark, 16 << 10):
        rows = S.raw_rows(B.parse_csv_ranges(B.read_lines(spark, path)))
    tables.drop_folder(spark, path)  # the rows are in the checkpoint folder by now
    return rows.select(F.regexp_extract("source_file", "owner_id=([^/]*)", 1).alias("owner_id"), "row_ord", _joined(F.col("cells")).alias("row_text"))


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status per file, good or bad."""
    return S.file_status(S.parse_exports(A.mixed_files(spark, sf_dir)))


def resolve_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts resolved from the parsed CSV exports."""
    rows = S.raw_rows(S.parse_exports(A.csv_files(spark, sf_dir)))
    return C.resolve_fields(rows, F.split_part("source_file", F.lit("-"), F.lit(2)))


def discover_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: columns of the JSON exports by their first rows."""
    return S.discover_columns(S.raw_rows(S.parse_exports(A.json_files(spark, sf_dir))), COLUMN_SAMPLE_ROWS)


def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: staged rows, confirmed rows (of even owners) and columns of each CSV file."""
    rows = S.raw_rows(S.parse_exports(A.csv_files(spark, sf_dir)))
    owner = F.split_part("source_file", F.lit("-"), F.lit(2)).cast("int")
    return C.load_stats(rows, owner % 2 == 0, COLUMN_SAMPLE_ROWS)


def discover_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over CSV exports: headers that are array indexes come first, as in the browser."""
    return S.discover_columns(S.raw_rows(S.parse_exports(A.year_files(spark, sf_dir))), COLUMN_SAMPLE_ROWS)


def _snapshot(spark: SparkSession, change: Callable[[str], None]) -> DataFrame:
    """What a snapshot folder holds after a change; the folder is removed, what was read stays in the checkpoint folder."""
    path = f"{tables.checkpoint_folder(spark)}/confirmed-{uuid4().hex}"
    change(path)
    out = C.read_snapshot(spark, path).select("owner_id", "source_file", "row_ord", *WEIGHTS).checkpoint()
    tables.drop_folder(spark, path)
    return out


def confirm_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contacts confirmed by owner in a shared folder and read again, after one owner's second upload."""

    def change(path: str) -> None:
        staged = A.contacts(spark, sf_dir).select("owner_id", "source_file", "row_ord", *WEIGHTS)
        C.confirm_snapshot(staged, path)
        C.confirm_snapshot(staged.where("owner_id = '7'").withColumn("position", F.lit("new")), path)
        C.confirm_snapshot(staged.where("owner_id = 'none'"), path)

    return _snapshot(spark, change)


def revoke_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still confirmed after new uploads of two owners, of which only the second is good and confirmed."""

    def change(path: str) -> None:
        C.confirm_snapshot(A.contacts(spark, sf_dir).select("owner_id", "source_file", "row_ord", *WEIGHTS), path)
        files = S.parse_exports(A.csv_files(spark, sf_dir).where("source_file like 'contacts-4-%'"))
        bad = S.parse_exports(A.mixed_files(spark, sf_dir).where("source_file like '%.json' and content not like '%]'"))
        C.stage_upload(spark, bad, "3", path)
        C.confirm_snapshot(C.stage_upload(spark, files, "4", path), path)

    return _snapshot(spark, change)


def _confirmed(spark: SparkSession, sf_dir: str) -> str:
    """A folder with all contacts confirmed."""
    path = f"{tables.checkpoint_folder(spark)}/confirmed-{uuid4().hex}"
    C.confirm_snapshot(A.contacts(spark, sf_dir), path)
    return path


def _kept(rows: DataFrame, path: str) -> DataFrame:
    out = tables.checkpoint(rows)
    tables.drop_folder(rows.sparkSession, path)
    return out


def search_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over a snapshot: the ten best confirmed contacts of one owner, from the files that can hold a token."""
    path = _confirmed(spark, sf_dir)
    out = N.search_confirmed(spark, path, QUERY, owner="7")
    return _kept(out.select("source_file", "row_ord", *_FIELDS, "score", F.array_join("matched_tokens", "|").alias("matched"), F.array_join("reasons", "|").alias("reasons")), path)


def upload_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 to T1 in a row: one owner's CSV exports parsed, staged, confirmed and searched."""
    path = f"{tables.checkpoint_folder(spark)}/confirmed-{uuid4().hex}"
    parsed = S.parse_exports(A.csv_files(spark, sf_dir).where("source_file like 'contacts-4-%'"))
    C.confirm_snapshot(C.stage_upload(spark, parsed, "4", path), path)
    out = N.search_confirmed(spark, path, QUERY, owner="4")
    return _kept(out.select("owner_id", "source_file", "row_ord", "full_name", "score"), path)


def confirmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 over a snapshot: of one owner's file the second page of 25, the first of 100, and the last by a number past it."""
    path = _confirmed(spark, sf_dir)
    pages = [N.page(spark, path, "7", "7", at, size).withColumn("page_size", F.lit(size)) for at, size in ((1, 25), (0, 100), (10**6, 50))]
    return _kept(pages[0].unionByName(pages[1]).unionByName(pages[2]), path)


# search


def search_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each search runs, where every third owner has confirmed contacts."""
    rows = A.contacts(spark, sf_dir).where(F.col("owner_id").cast("int") % 3 == 0)
    return R.search_guard(rows, A.searches(spark, sf_dir)).select("search_id", "runs")


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every contact."""
    return R.score_rows(A.contacts(spark, sf_dir), QUERY).select("owner_id", "row_ord", "score")


def matched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the matched tokens of every contact."""
    rows = R.lowered(A.contacts(spark, sf_dir)).withColumn("h", R.hits_by_field(_tokens()))
    return rows.select("owner_id", "row_ord", F.array_join(R.matched_tokens(F.col("h")), "|").alias("matched"))


def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of every contact."""
    rows = R.lowered(A.contacts(spark, sf_dir)).withColumn("h", R.hits_by_field(_tokens()))
    return rows.select("owner_id", "row_ord", F.array_join(R.match_reasons(F.col("h")), "|").alias("reasons"))


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best contacts of one query over all owners."""
    out = R.search(A.contacts(spark, sf_dir), QUERY)
    return out.select("source_file", "row_ord", *_FIELDS, "score", F.array_join("matched_tokens", "|").alias("matched"), F.array_join("reasons", "|").alias("reasons"))


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: every search's ten best contacts of its owner."""
    out = R.batch_search(A.contacts(spark, sf_dir), A.searches(spark, sf_dir))
    return out.select("search_id", "rank", "owner_id", "row_ord", "score", F.array_join("matched_tokens", "|").alias("matched"))


def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: what every search shows."""
    out = R.result_cards(R.batch_search(A.contacts(spark, sf_dir), A.searches(spark, sf_dir)))
    return out.select("search_id", "rank", "name", "subtitle", "email", "url", "score", F.array_join("reasons", "|").alias("reasons"), F.array_join("tokens", "|").alias("tokens"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over long texts: the documents' text as position."""
    d = A.table(spark, sf_dir, "documents")
    blank = F.lit("")
    rows = d.select(F.col("source").alias("source_file"), F.col("doc_id").alias("row_ord"), blank.alias("full_name"), F.coalesce("text", blank).alias("position"), F.coalesce("lang", blank).alias("company"), blank.alias("email"), blank.alias("url"), blank.alias("connected_on"), blank.alias("all_text"))
    return R.search(rows, "en the of, tion; der").select("source_file", "row_ord", "score")


# preview


def preview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty rows of every file."""
    return V.preview_page(A.contacts(spark, sf_dir), 1)


def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: rows and pages of every file."""
    return V.page_stats(A.contacts(spark, sf_dir))


# portfolio


def valuation_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    out = D.valuation_trend(A.valuations(spark, sf_dir))
    return out.select(F.col("month").cast("string").alias("month"), "fund", F.round("value", 2).alias("value"))


def aum_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    out = D.aum_yoy(A.valuations(spark, sf_dir))
    return out.select("year", F.round("total", 2).alias("total"), F.round("change_pct", 4).alias("change_pct"))


def _states(spark: SparkSession, rows: DataFrame, load: Callable[[DataFrame, str, str], None], result: Callable[[str], DataFrame]) -> DataFrame:
    """A result from the states of rows that come in three loads by their day, the last of them twice."""
    path = f"{tables.checkpoint_folder(spark)}/states-{uuid4().hex}"
    part = F.dayofmonth("as_of") % 3
    for k in (0, 2, 1, 1):
        load(rows.where(part == k), path, f"load-{k}")
    out = tables.checkpoint(result(path))
    for folder in (path, f"{path}-sketches"):
        tables.drop_folder(spark, folder)
    return out


def valuation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 from monthly states of three loads."""
    out = _states(spark, A.valuations(spark, sf_dir), U.load_valuations, lambda path: U.valuation_trend(spark, path))
    return out.select(F.col("month").cast("string").alias("month"), "fund", F.round("value", 2).alias("value"))


def aum_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 from monthly states of three loads."""
    out = _states(spark, A.valuations(spark, sf_dir), U.load_valuations, lambda path: U.aum_yoy(spark, path))
    return out.select("year", F.round("total", 2).alias("total"), F.round("change_pct", 4).alias("change_pct"))


def activity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 by month from states of three loads: active companies, and those since the first month."""
    out = _states(spark, A.activity(spark, sf_dir), U.load_activity, lambda path: U.active_by_month(spark, path))
    return out.select(F.col("month").cast("string").alias("month"), "companies", "companies_so_far")


def active_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3."""
    return D.active_portfolio(A.companies(spark, sf_dir))


def fund_deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    rows = A.valuations(spark, sf_dir)
    out = D.fund_deployment(rows.withColumnRenamed("value", "committed"), rows.where("status = 'F'").withColumnRenamed("value", "amount"))
    return out.select("fund", F.round("committed", 2).alias("committed"), F.round("called", 2).alias("called"), F.round("deployed_pct", 4).alias("deployed_pct"), F.round("dry_powder", 2).alias("dry_powder"))


def deal_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 over the events."""
    stages = ("view", "click", "signup", "purchase")
    return D.deal_funnel(A.table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), stages)


def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6."""
    return D.recent_calls(A.capital_calls(spark, sf_dir)).withColumn("call_date", F.col("call_date").cast("string"))


def upcoming_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 over the events."""
    rows = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("meeting_id"), F.col("event_type").alias("title"), F.col("ts").alias("start_ts"))
    return D.upcoming_meetings(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (search_topk, batch_search, score_rows, matched_tokens, match_reasons, result_cards, search_documents, normalize_key, tokenize_query, js_trim, to_text, csv_parse, csv_header_detect, csv_records, derive_full_name, json_ingest, json_clean, csv_ranges, file_status, resolve_fields, discover_columns, discover_csv_columns, load_stats, confirm_snapshot, revoke_snapshot, search_confirmed, upload_and_search, confirmed_pages, search_guard, preview_page, page_stats, valuation_trend, aum_yoy, valuation_rollup, aum_rollup, activity_rollup, active_portfolio, fund_deployment, deal_funnel, recent_calls, upcoming_meetings)
    return {f.__name__: f for f in made}
