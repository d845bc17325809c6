"""Contacts, searches, export files and portfolio tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a generated export file.
FILE_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact per customer, in twenty owners' lists; keyed left joins only, the dimension tables are small."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    first = t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    rows = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(t("pages").select("page_id", F.col("url").alias("page_url")), F.col("c_custkey") == F.col("page_id"), "left")
    rows = rows.join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.join(t("part").select("p_partkey", "p_name"), F.col("c_custkey") == F.col("p_partkey"), "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    out = rows.select(
        (F.col("c_custkey") % 20).cast("string").alias("owner_id"),
        (F.col("c_custkey") % 20).cast("string").alias("source_file"),
        F.floor(F.col("c_custkey") / 20).cast("long").alias("row_ord"),
        text(F.col("c_name")).alias("full_name"),
        text(F.col("c_mktsegment")).alias("position"),
        text(F.col("n_name")).alias("company"),
        text(F.lower(F.concat(F.replace("c_mktsegment", F.lit(" "), F.lit("")), F.col("c_custkey").cast("string"), F.lit("@"), F.replace("r_name", F.lit(" "), F.lit("")), F.lit(".example")))).alias("email"),
        text(F.col("page_url")).alias("url"),
        text(F.date_format("first_order", "dd MMM yyyy")).alias("connected_on"),
        text(F.col("p_name")).alias("notes"),
    )
    return out.withColumn("all_text", F.concat_ws(" ", "full_name", "position", "company", "email", "url", "connected_on", "notes"))


CONTACTS_SQL = """
first_order AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey),
contacts0 AS (
  SELECT CAST(c_custkey % 20 AS VARCHAR) AS owner_id, CAST(c_custkey % 20 AS VARCHAR) AS source_file, c_custkey // 20 AS row_ord,
    coalesce(c_name, '') AS full_name, coalesce(c_mktsegment, '') AS position, coalesce(n_name, '') AS company,
    coalesce(lower(replace(c_mktsegment, ' ', '') || c_custkey || '@' || replace(r_name, ' ', '') || '.example'), '') AS email,
    coalesce(url, '') AS url, coalesce(strftime(d, '%d %b %Y'), '') AS connected_on, coalesce(p_name, '') AS notes
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN pages ON page_id = c_custkey LEFT JOIN first_order ON o_custkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey
),
contacts AS (SELECT *, concat_ws(' ', full_name, position, company, email, url, connected_on, notes) AS all_text FROM contacts0)
"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per supplier, mixing fields, repeated tokens and tokens that match nothing."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    key = F.col("s_suppkey")
    name = F.coalesce("n_name", F.lit(""))
    mix = F.when(key % 4 == 0, F.concat(name, F.lit(", Machinery;  machinery 199")))
    mix = mix.when(key % 4 == 1, F.concat(F.lit("asia.example\t"), name, F.lit(" bolt zzz"), key.cast("string")))
    mix = mix.when(key % 4 == 2, F.concat(F.lit("#0000"), key.cast("string"), F.lit("; building; ; Jan")))
    return rows.select(key.cast("long").alias("search_id"), (key % 20).cast("string").alias("owner_id"), mix.otherwise(F.lit(" ,; ")).alias("criteria"))


SEARCHES_SQL = """
searches AS (
  SELECT s_suppkey AS search_id, CAST(s_suppkey % 20 AS VARCHAR) AS owner_id,
    CASE s_suppkey % 4 WHEN 0 THEN coalesce(n_name, '') || ', Machinery;  machinery 199'
      WHEN 1 THEN 'asia.example' || chr(9) || coalesce(n_name, '') || ' bolt zzz' || s_suppkey
      WHEN 2 THEN '#0000' || s_suppkey || '; building; ; Jan' ELSE ' ,; ' END AS criteria
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
)
"""


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


CSV_HEAD = 'Notes:\n"all, as exported"\n\nFirst Name,Last Name,Position,Company,Email Address,URL,Connected On,Notes\r'


def _csv_line():
    """A contact as a line of an export, with a line break inside quotes."""
    name = F.split("full_name", "#")
    note = F.concat(F.lit("a, "), F.col("notes"), F.lit(' "x"\n2nd'))
    return F.concat_ws(",", F.get(name, F.lit(0)), F.get(name, F.lit(1)), _quoted(F.col("position")), F.concat(F.lit(" "), F.col("company"), F.lit(" ")), "email", _quoted(F.col("url")), "connected_on", _quoted(note))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export files of FILE_ROWS contacts: a preamble, quoted cells with commas, quotes and line breaks, blank rows."""
    rows = contacts(spark, sf_dir)
    part = F.floor(F.col("row_ord") / FILE_ROWS)
    files = rows.select(F.concat(F.lit("contacts-"), F.col("owner_id"), F.lit("-"), part.cast("string"), F.lit(".CSV")).alias("source_file"), F.struct("row_ord", _csv_line().alias("line")).alias("r"))
    files = files.groupBy("source_file").agg(F.sort_array(F.collect_list("r")).alias("r"))  # at most FILE_ROWS rows
    return files.select("source_file", F.concat(F.lit(CSV_HEAD + "\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\r\n , ,\r\n")).alias("content"))


def write_csv_by_owner(spark: SparkSession, sf_dir: str, path: str) -> None:
    """An export file per owner in folders owner_id=..., whatever its size."""
    rows = contacts(spark, sf_dir)
    lines = rows.select("owner_id", "row_ord", F.concat(_csv_line(), F.lit("\r\n , ,\r")).alias("value"))
    heads = rows.select("owner_id").distinct().select("owner_id", F.lit(-1).cast("long").alias("row_ord"), F.lit(CSV_HEAD).alias("value"))
    lines.unionByName(heads).repartition("owner_id").sortWithinPartitions("owner_id", "row_ord").select("owner_id", "value").write.partitionBy("owner_id").text(path)


def year_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export per nation, with headers that are numbers."""
    rows = table(spark, sf_dir, "nation")
    line = F.concat_ws(",", "n_name", F.col("n_nationkey").cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"))
    return rows.select(F.concat(F.lit("years-"), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("source_file"), F.concat(F.lit("Name,2023,007,10,Note,4294967295\n"), line).alias("content"))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event exports as JSON arrays of FILE_ROWS objects."""
    e = table(spark, sf_dir, "events")
    value = F.concat(F.lit('{"Full Name": "user '), F.col("user_id").cast("string"), F.lit('", "role": "'), F.col("event_type"), F.lit('", "n": '), F.col("event_id").cast("string"), F.lit('.0, "tags": ["'), F.col("event_type"), F.lit('", null, true, [2.50, 1e21]], "props": '), F.col("props"), F.lit(', "none": null, "role": "'), F.upper("event_type"), F.lit('"}'))
    rows = e.select(F.concat(F.lit("events-"), F.floor(F.col("event_id") / FILE_ROWS).cast("string"), F.lit(".Json")).alias("source_file"), F.struct("event_id", value.alias("v")).alias("r"))
    rows = rows.groupBy("source_file").agg(F.sort_array(F.collect_list("r")).alias("r"))  # at most FILE_ROWS rows
    return rows.select("source_file", F.concat(F.lit("[\n"), F.array_join(F.transform("r", lambda x: x["v"]), ",\n"), F.lit("\n]")).alias("content"))


def clean_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event exports as JSON arrays of FILE_ROWS objects, without anything that two JSON readers see differently."""
    e = table(spark, sf_dir, "events")
    value = F.concat(F.lit('{"Full Name": "user '), F.col("user_id").cast("string"), F.lit('", "role": "'), F.col("event_type"), F.lit('", "n": '), F.col("event_id").cast("string"), F.lit(', "share": 2.50, "tags": ["'), F.col("event_type"), F.lit('", null, "\\"é"], "props": '), F.col("props"), F.lit(', "none": null, "new": true}'))
    rows = e.select(F.concat(F.lit("events-"), F.floor(F.col("event_id") / FILE_ROWS).cast("string"), F.lit(".json")).alias("source_file"), F.struct("event_id", value.alias("v")).alias("r"))
    rows = rows.groupBy("source_file").agg(F.sort_array(F.collect_list("r")).alias("r"))  # at most FILE_ROWS rows
    return rows.select("source_file", F.concat(F.lit("[\n"), F.array_join(F.transform("r", lambda x: x["v"]), ",\n"), F.lit("\n]\n")).alias("content"))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per customer: well-formed ones and each kind of bad one."""
    c = table(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 7
    name = F.concat(F.lit("file-"), F.col("c_custkey").cast("string"))
    text = F.col("c_name")
    content = F.when(kind == 0, F.concat(F.lit("First Name,Last Name\n"), text, F.lit(",x\n"), text)).when(kind == 1, F.lit("First Name,Last Name\n")).when(kind == 2, F.concat(F.lit('[{"name": "'), text, F.lit('"}]')))
    content = content.when(kind == 3, F.concat(F.lit('{"name": "'), text, F.lit('"}'))).when(kind == 4, F.concat(F.lit('[{"name": "'), text)).when(kind == 5, F.concat(text, F.lit(",1"))).otherwise(F.concat(F.lit('[1, null, "'), text, F.lit('"]')))
    suffix = F.when(kind.isin(0, 1), ".csv").when(kind == 5, ".txt").otherwise(".json")
    return c.select(F.concat(name, suffix).alias("source_file"), content.alias("content"))


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    funds = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(funds, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("r_name").alias("fund"), F.col("o_orderdate").cast("date").alias("as_of"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    rows = table(spark, sf_dir, "customer").join(open_orders, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("company_id"), F.col("c_mktsegment").alias("sector"), F.coalesce("active", F.lit(False)).alias("active"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company was active on the days of its open orders."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_custkey").alias("company_id"), F.col("c_mktsegment").alias("sector"), F.col("o_orderdate").cast("date").alias("as_of"), (F.col("o_orderstatus") == "O").alias("active"))


def capital_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "FUNDED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("OVERDUE")
    return rows.select(F.col("o_orderkey").alias("call_id"), F.col("c_name").alias("entity"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("call_date"), status.alias("status"))
