"""Rewriting tables into a target schema, file landing, profiles and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.books import workbook_bytes
from queries.common import fresh_folder, table
from schemalign.functions import text
from schemalign.operators import conform as c
from schemalign.plans.map_files import map_files as run_map_files
from schemalign.sources import delimited, tables, workbook
from schemalign.streaming.landing import land_files as run_land_files
from schemalign.streaming.landing import land_stream as run_land_stream
from schemalign.streaming.landing import landed

TARGETS = ["Account Name", "Account No.", "Nation/Key?", "Segment", "Unused Field"]
CUSTOMER_MAPPING = [
    ("c_name", "Account Name"), ("c_custkey", "Account No."), ("c_nationkey", "Nation/Key?"),
    ("c_mktsegment", "(Ignored)"), ("c_acctbal", "(Ignored)"), ("c_custkey", "Account Name"),
]
LINE_MAPPING = [
    ("l_orderkey", "Order"), ("l_linenumber", "Line"), ("l_returnflag", "Flag"), ("l_linestatus", "Status"),
    ("l_suppkey", "Flag"), ("absent", "Nowhere"),
]
WORKBOOK_ROWS = 1000
LINE_TARGETS = ["Flag", "Line", "Nowhere", "Order", "Part", "Status"]

CONFORM_CUSTOMER_SQL = """
SELECT c_name AS "Account Name", c_custkey::VARCHAR AS "Account No.", c_nationkey::VARCHAR AS "Nation/Key?",
       NULL::VARCHAR AS "Segment", NULL::VARCHAR AS "Unused Field" FROM customer"""
BOTH_SQL = """
SELECT 'customer' AS source_id, c_name AS "Account Name", c_custkey::VARCHAR AS "Account No.",
       c_nationkey::VARCHAR AS "Nation/Key?", CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS "Segment",
       NULL::VARCHAR AS "Unused Field" FROM customer
UNION ALL SELECT 'supplier', s_name, s_suppkey::VARCHAR, s_nationkey::VARCHAR, NULL, NULL FROM supplier"""


def conform_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.conform(table(spark, sf_dir, "customer"), CUSTOMER_MAPPING, TARGETS)


def conform_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.conform(table(spark, sf_dir, "lineitem"), LINE_MAPPING, LINE_TARGETS, missing=["", "N", "7"])


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as rows of two layouts."""

    def values(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return df.select(F.lit(name).alias("source_id"), F.array(*[F.col(x).cast("string") for x in columns]).alias("values"))

    customers = values(table(spark, sf_dir, "customer"), "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return customers.unionByName(values(table(spark, sf_dir, "supplier"), "supplier", ["s_name", "s_suppkey", "s_nationkey"]))


def conform_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame(
        [
            ("customer", 0, "Account No."), ("customer", 1, "Account Name"), ("customer", 2, "Nation/Key?"),
            ("customer", 3, "Segment"), ("supplier", 0, "Account Name"), ("supplier", 1, "Account No."),
            ("supplier", 2, "Nation/Key?"), ("supplier", 3, "Account No."),
        ],
        "source_id string, position int, target string",
    )
    return c.conform_many(_rows(spark, sf_dir), mapping, TARGETS, missing=["", "MACHINERY"])


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "nan").when(F.col("event_type") == "view", "N/A").otherwise(F.col("props")).alias("cell"),
    )
    return cells.withColumn("cell", c.clean_tokens(F.col("cell")))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "customer").orderBy("c_custkey")
    return c.preview(ordered, 100, rename=[("c_custkey", "Account No."), ("c_name", "Account Name")])


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    conformed = conform_lineitem(spark, sf_dir)
    return c.profile_table(conformed).drop("nullable")


def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.when(F.col("source") != "src0", F.col("source")).alias("source")
    )
    return c.sample_values(docs, "doc_id")


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("source_id", F.concat("source_id", F.lit(".v1.csv")))
    files = rows.groupBy("source_id").agg(F.max(F.size("values")).alias("n")).select(
        "source_id", F.sequence(F.lit(1), F.col("n")).cast("array<string>").alias("columns")
    )
    return c.file_stats(rows, files)


def sanitize_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.table_name(F.col("url")).alias("table_name"))


def _as_files(spark: SparkSession, sf_dir: str) -> str:
    """Customers by commas, suppliers by pipes, nations by tabs, and parts whose rows are longer than their header."""
    folder = fresh_folder(spark)
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("Account-Name"), "c_nationkey", F.concat("c_mktsegment", F.lit(', "x"\nline')).alias("note")
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("ACCOUNT NAME!"), "s_suppkey", "s_nationkey")
    tables.export_csv(customers, f"{folder}/customer")
    suppliers.write.option("header", True).option("sep", "|").csv(f"{folder}/supplier")
    nations = table(spark, sf_dir, "nation").select(F.concat_ws("\t", "n_nationkey", "n_name", F.lit("")).alias("value"))
    lines = F.concat_ws("\n", F.lit("n\to|m\tp\n\r\n"), F.sort_array(F.collect_list("value")))
    nations.agg(lines.alias("value")).write.text(f"{folder}/nation")
    parts = table(spark, sf_dir, "part").select(F.concat_ws(",", "p_partkey", "p_name", F.lit(""), "p_size").alias("p_partkey,p_name"))
    parts.write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(f"{folder}/part")
    return folder


def _all_folders(folder: str) -> list[str]:
    return [f"{folder}/{name}" for name in ("customer", "supplier", "nation", "part")]


def read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _as_files(spark, sf_dir)
    _, rows = delimited.read_delimited(spark, _all_folders(folder))
    return rows.select(F.array_join("values", "~", "").alias("fields"))


READ_SQL = """
SELECT c_custkey || '~' || c_name || '~' || c_nationkey || '~' || c_mktsegment || ', "x"' || chr(10) || 'line' AS fields FROM customer
UNION ALL SELECT s_name || '~' || s_suppkey || '~' || s_nationkey FROM supplier
UNION ALL SELECT n_nationkey || '~' || n_name || '~' FROM nation"""


def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of the files, those that cannot be read among them, with the rows read of each kind."""
    files, rows = delimited.read_delimited(spark, _all_folders(_as_files(spark, sf_dir)))
    read = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    kind = F.regexp_extract("source_id", "/([a-z]+)/[^/]*$", 1).alias("kind")
    told = files.join(read, "source_id", "left").groupBy(kind, "delimiter", F.array_join("columns", "~").alias("header"), "error")
    return told.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"))


FILES_SQL = """
SELECT 'customer' AS kind, ',' AS delimiter, 'c_custkey~Account-Name~c_nationkey~note' AS header, NULL::VARCHAR AS error,
       count(*) AS rows_read FROM customer
UNION ALL SELECT 'supplier', '|', 'ACCOUNT NAME!~s_suppkey~s_nationkey', NULL, count(*) FROM supplier
UNION ALL SELECT 'nation', chr(9), 'n~o|m~p', NULL, count(*) FROM nation
UNION ALL SELECT DISTINCT 'part', ',', 'p_partkey~p_name', 'a row has 4 fields, the header 2', 0 FROM part"""


def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _as_files(spark, sf_dir)
    files, rows = delimited.read_delimited(spark, _all_folders(folder))
    dictionary = spark.createDataFrame(
        [
            ("account name", "Account Name"), ("c_custkey", "Account No."), ("s_suppkey", "Account No."),
            ("c_nationkey", "Nation"), ("s_nationkey", "Nation"), ("unused", "Unused Field"),
        ],
        "src string, target string",
    )
    return run_map_files(files, rows, dictionary).rows.drop("source_id")


MAP_FILES_SQL = """
SELECT c_name AS "Account Name", c_custkey::VARCHAR AS "Account No.", c_nationkey::VARCHAR AS "Nation", NULL::VARCHAR AS "Unused Field"
FROM customer UNION ALL SELECT s_name, s_suppkey::VARCHAR, s_nationkey::VARCHAR, NULL FROM supplier"""


def write_conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows, and as one more row what the writer told about them."""
    folder = fresh_folder(spark)
    name = f"conformed_{folder.rsplit('/', 1)[-1]}"
    told = tables.write_conformed(conform_lineitem(spark, sf_dir), name, [t for _, t in LINE_MAPPING], folder)
    written = spark.table(name)
    numbers = [f"rows {told.rows}", f"mapped {told.mapped_columns}", f"null {told.null_columns}"]
    said = spark.range(1).select(*[F.lit(x).alias(c) for c, x in zip(written.columns, [*numbers, None, None, None], strict=True)])
    return written.unionByName(said)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored dictionary, together with that of a table that is not there."""
    folder = fresh_folder(spark)
    name = f"dictionary_{folder.rsplit('/', 1)[-1]}"
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("src"), F.col("p_type").alias("target"), F.col("p_brand").alias("description"))
    part.withColumn("extra", F.lit(1)).write.option("path", folder).saveAsTable(name)
    return tables.dictionary(spark, name).unionByName(tables.dictionary(spark, f"{name}_absent"))


def read_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks of up to WORKBOOK_ROWS rows, by nation and block of keys, made in tasks and read back."""
    block = F.floor(F.col("c_custkey") / WORKBOOK_ROWS)
    customers = table(spark, sf_dir, "customer").withColumn("path", F.concat_ws("-", "c_nationkey", block))
    kinds = {"c_custkey": "number", "c_name": "shared", "c_mktsegment": "inline"}
    books = customers.withColumn("c_custkey", F.col("c_custkey").cast("string")).groupBy("path").applyInPandas(
        lambda key, rows: pd.DataFrame({"path": [f"{key[0]}.xlsx"], "content": [workbook_bytes(rows, kinds)]}), "path string, content binary"
    )
    files, rows = workbook.sheets_of(books)
    named = rows.join(files.select("source_id", "columns"), "source_id")
    return named.select("source_id", F.array_join("columns", "~").alias("header"), F.array_join("values", "~", "?").alias("fields"))


LINES_SQL = """
SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS "Flag", nullif(l_linenumber::VARCHAR, '7') AS "Line",
       NULL::VARCHAR AS "Nowhere", nullif(l_orderkey::VARCHAR, '7') AS "Order", NULL::VARCHAR AS "Part",
       l_linestatus AS "Status" FROM lineitem"""


def land_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    customers = table(spark, sf_dir, "customer")
    tables.export_csv(customers, f"{folder}/in")
    query = run_land_stream(
        spark, f"{folder}/in", customers.columns, CUSTOMER_MAPPING, TARGETS, f"{folder}/checkpoint", path=f"{folder}/out"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def land_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two layouts landed in two rounds, the second by a stream that is started again, a bad file parked."""
    folder = fresh_folder(spark)
    dictionary = spark.createDataFrame(
        [("account name", "Account Name"), ("c_custkey", "Account No."), ("s_suppkey", "Account No.")], "src string, target string"
    )

    def run() -> None:
        run_land_files(spark, f"{folder}/in", dictionary, f"{folder}/checkpoint", f"{folder}/out", f"{folder}/parked").awaitTermination()

    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(',\n"x"')).alias("Account-Name"), "c_nationkey")
    customers.write.option("header", True).option("escape", '"').csv(f"{folder}/in")
    run()
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("ACCOUNT NAME!"), "s_suppkey")
    suppliers.write.mode("append").option("header", True).option("sep", "|").csv(f"{folder}/in")
    longer = table(spark, sf_dir, "part").select(F.concat_ws(",", "p_partkey", "p_size").alias("c_custkey"))
    longer.write.mode("append").option("header", True).option("sep", "\u0001").csv(f"{folder}/in")
    run()
    told = landed(spark, f"{folder}/parked").select(F.lit("parked").alias("kind"), F.col("reason").alias("Account Name"), F.lit(None).cast("string").alias("Account No.")).distinct()
    rows = landed(spark, f"{folder}/out").select(F.lit("row").alias("kind"), "`Account Name`", "`Account No.`")
    return rows.unionByName(told)


LANDED_SQL = """
SELECT 'row' AS kind, c_name || ',' || chr(10) || '"x"' AS "Account Name", c_custkey::VARCHAR AS "Account No." FROM customer
UNION ALL SELECT 'row', s_name, s_suppkey::VARCHAR FROM supplier
UNION ALL SELECT DISTINCT 'parked', 'a row has 2 fields, the header 1', NULL FROM part"""


def read_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    part = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") > 3, F.col("p_name")).alias("SRC"), F.col("p_type").alias("TARGET"),
        F.concat(F.lit('say "'), "p_brand", F.lit('", once, or\ntwice')).alias("DESCRIPTION"),
    )
    tables.export_csv(part, folder)
    return tables.read_dictionary(spark, folder)


QUERIES = {
    "conform_customer": conform_customer,
    "conform_lineitem": conform_lineitem,
    "conform_many": conform_many,
    "clean_tokens": clean_tokens,
    "preview": preview,
    "profile_table": profile_table,
    "sample_values": sample_values,
    "file_stats": file_stats,
    "sanitize_table_name": sanitize_table_name,
    "read_delimited": read_delimited,
    "delimited_files": delimited_files,
    "read_dictionary": read_dictionary,
    "map_files": map_files,
    "write_conformed": write_conformed,
    "dictionary": dictionary,
    "read_workbook": read_workbook,
    "land_stream": land_stream,
    "land_files": land_files,
}
ORACLES = {
    "land_files": LANDED_SQL,
    "conform_customer": CONFORM_CUSTOMER_SQL,
    "conform_lineitem": LINES_SQL,
    "conform_many": BOTH_SQL,
    "clean_tokens": """
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN props END AS cell FROM events""",
    "preview": 'SELECT c_custkey AS "Account No.", c_name AS "Account Name" FROM customer ORDER BY c_custkey LIMIT 100',
    "profile_table": "WITH t AS (" + LINES_SQL + """)
SELECT 1 AS position, 'Flag' AS column_name, 'string' AS data_type, count("Flag") AS n_values, count(*) AS n_rows FROM t
UNION ALL SELECT 2, 'Line', 'string', count("Line"), count(*) FROM t
UNION ALL SELECT 3, 'Nowhere', 'string', count("Nowhere"), count(*) FROM t
UNION ALL SELECT 4, 'Order', 'string', count("Order"), count(*) FROM t
UNION ALL SELECT 5, 'Part', 'string', count("Part"), count(*) FROM t
UNION ALL SELECT 6, 'Status', 'string', count("Status"), count(*) FROM t""",
    "sample_values": """
WITH cells AS (SELECT doc_id, 'text' AS column_name, text AS v FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents
               UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source <> 'src0')
SELECT column_name, string_agg(substr(v, 1, 30), ', ' ORDER BY doc_id) || '...' AS sample
FROM (SELECT * FROM cells WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY doc_id) <= 3)
GROUP BY column_name""",
    "file_stats": """
SELECT 'customer.v1.csv' AS source_id, count(*) AS n_rows, 4 AS n_columns, 'CSV' AS format FROM customer
UNION ALL SELECT 'supplier.v1.csv', count(*), 3, 'CSV' FROM supplier""",
    "sanitize_table_name": r"""
SELECT page_id, substr(upper(CASE WHEN regexp_matches(s, '^[^A-Za-z]') THEN 'T_' || s ELSE s END), 1, 128) AS table_name
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[^a-zA-Z0-9_]', '_', 'g') AS s FROM pages)""",
    "read_delimited": READ_SQL,
    "delimited_files": FILES_SQL,
    "read_dictionary": """
SELECT p_name AS src, p_type AS target, 'say "' || p_brand || '", once, or' || chr(10) || 'twice' AS description
FROM part WHERE p_size > 3""",
    "map_files": MAP_FILES_SQL,
    "write_conformed": "WITH t AS (" + LINES_SQL + """)
SELECT * FROM t UNION ALL SELECT 'rows ' || count(*), 'mapped 5', 'null 1', NULL, NULL, NULL FROM t""",
    "dictionary": "SELECT p_name AS src, p_type AS target, p_brand AS description FROM part",
    "read_workbook": """
SELECT c_nationkey || '-' || c_custkey // 1000 || '.xlsx' AS source_id, 'c_custkey~c_name~c_mktsegment' AS header,
       c_custkey || '~' || c_name || '~' || c_mktsegment AS fields FROM customer""",
    "land_stream": CONFORM_CUSTOMER_SQL,
}
