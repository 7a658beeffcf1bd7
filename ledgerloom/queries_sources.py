"""Sources, sinks and streams over files that are written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.amounts import MONEY
from .plans import components
from .plans.frames import load
from .queries import query
from .sources import profiles, sinks, summaries, tables
from .streaming import ingest


def _text_files(rows: DataFrame, name: str) -> str:
    """A folder with one file for each g; rows: (g, place, line)."""
    path = components.shared_path(rows.sparkSession, name)
    rows.repartition("g").sortWithinPartitions("g", "place").select("g", F.col("line").alias("value")).write.partitionBy("g").text(path)
    return path


def _g() -> Column:
    return F.regexp_extract("file", r"/g=(\d+)/", 1).cast("long")


def _summary_files(spark: SparkSession, d: str) -> str:
    """An account-group summary for every 500 customers, with totals that are one too high in every second file."""
    k = F.col("k")
    t = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("v")).withColumn("g", F.floor(k / 500))
    debit, credit = F.when((k % 11 != 0) & (k % 7 != 0), F.col("v")), F.when((k % 11 != 0) & (k % 7 == 0), F.col("v"))
    shown = lambda c: F.coalesce(F.concat(F.lit('"'), F.format_number(c, 2), F.lit('"')), F.lit(""))
    label = F.when(k % 11 == 0, F.concat(F.lit("TDS Payable "), k)).otherwise(F.concat(F.when(k % 2 == 0, "TDS Receivable from Firm ").otherwise("TDS Recievable from Firm "), k))
    rows = t.select("g", (k + 10).alias("place"), F.concat_ws(",", label, F.lit(""), F.when(k % 11 == 0, shown(F.col("v"))).otherwise(shown(debit)), shown(credit), F.lit("")).alias("line"))
    total = t.groupBy("g").agg(F.coalesce(F.sum(debit), F.lit(0)).cast(MONEY).alias("d"), F.coalesce(F.sum(credit), F.lit(0)).cast(MONEY).alias("c"))
    total = total.select("g", F.lit(1 << 60).alias("place"), F.concat_ws(",", F.lit("Grand Total"), F.lit(""), shown((F.col("d") + F.col("g") % 2).cast(MONEY)), shown(F.col("c")), F.lit("")).alias("line"))
    top = ["TDS ledgers of the firm,,,,", "1-Apr-24 to 31-Mar-25,,,,", "Particulars,Opening,Transactions,,Closing", ",,,,x", ",Balance,Debit,Credit,Balance"]
    heads = t.select("g").distinct().select("g", F.posexplode(F.array(*map(F.lit, top))).alias("place", "line"))
    return _text_files(rows.unionByName(total).unionByName(heads), "summary")


_SUMMARY_SQL = """t AS (SELECT o_custkey AS k, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY 1)"""


@query(f"""WITH {_SUMMARY_SQL}
SELECT k // 500 AS g, 'Firm ' || k AS party, CASE WHEN k % 7 != 0 THEN v::DECIMAL(18,2) END AS tds_amount, CASE WHEN k % 7 != 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction,
  CASE WHEN k % 7 != 0 THEN 'VALID' ELSE 'REVIEW_REQUIRED' END AS status, '2024-25' AS financial_year FROM t WHERE k % 11 != 0""", decimals="tds_amount")
def group_summary_accounts(spark, d):
    rows = summaries.group_summary(tables.read_grid(spark, _summary_files(spark, d)))
    return rows.filter("role = 'TDS_RECEIVABLE'").select(_g().alias("g"), "party", "tds_amount", "direction", "status", "financial_year")


@query(f"""WITH {_SUMMARY_SQL}, s AS (SELECT k // 500 AS g, coalesce(sum(v) FILTER (k % 11 != 0 AND k % 7 != 0), 0)::DECIMAL(18,2) AS debit, coalesce(sum(v) FILTER (k % 11 != 0 AND k % 7 = 0), 0)::DECIMAL(18,2) AS credit,
  count(*) FILTER (k % 11 != 0) AS account_rows, count(*) FILTER (k % 11 != 0 AND k % 7 != 0) AS debit_rows FROM t GROUP BY 1)
SELECT g, 1 AS segment, account_rows, debit_rows, debit AS debit_total, credit AS credit_total, -(g % 2)::DECIMAL(18,2) AS debit_difference, 0::DECIMAL(18,2) AS credit_difference FROM s""", decimals="debit_total credit_total debit_difference credit_difference")
def group_summary_controls(spark, d):
    rows = summaries.control_totals(summaries.group_summary(tables.read_grid(spark, _summary_files(spark, d))))
    return rows.select(_g().alias("g"), "segment", "account_rows", "debit_rows", "debit_total", "credit_total", "debit_difference", "credit_difference")


_HEADERS = ("TAN,Name of Deductor,Tax Deducted,Remarks", "Particulars,Voucher No,TDS Receivable,Debit", "Invoice No,Invoice Value,Customer,Credit", "Foo,Bar,Baz,Date")


def _headed_files(spark: SparkSession, d: str) -> DataFrame:
    """(file, kind, headers) of a file for every 50 customers, of four types in turn, put in by turns as books and statement."""
    c = load(spark, d, "customer").withColumn("g", F.floor(F.col("c_custkey") / 50))
    rows = c.select("g", (F.col("c_custkey") + 1).alias("place"), F.concat_ws(",", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").alias("line"))
    header = F.get(F.array(*map(F.lit, _HEADERS)), (F.col("g") % 4).cast("int"))
    heads = c.select("g").distinct().select("g", F.lit(0).cast("long").alias("place"), header.alias("line"))
    grid = tables.read_grid(spark, _text_files(rows.unionByName(heads), "sources"))
    return grid.filter("row_no = 1").select("file", F.when(_g() % 8 < 4, "books").otherwise("form26as").alias("kind"), F.col("cells").alias("headers"))


@query("""WITH g AS (SELECT DISTINCT c_custkey // 50 AS g FROM customer),
f AS (SELECT g, CASE WHEN g % 8 < 4 THEN 'books' ELSE 'form26as' END AS kind, CASE g % 4 WHEN 0 THEN 'Government 26AS / Form 16A' WHEN 1 THEN 'ERP TDS Receivable / Books Report'
  WHEN 2 THEN 'Sales Registry / GST Invoice Register' ELSE 'Unclassified tabular report' END AS source_type FROM g)
SELECT *, CASE WHEN kind = 'books' AND g % 4 = 0 THEN '26AS / Form 16A file uploaded as Books' WHEN kind = 'form26as' AND g % 4 = 1 THEN 'ERP Books report uploaded as 26AS / Form 16A' END AS problem FROM f""")
def misfiled_sources(spark, d):
    return profiles.files(_headed_files(spark, d)).select(_g().alias("g"), "kind", "source_type", "problem")


@query("""WITH g AS (SELECT DISTINCT c_custkey // 50 AS g FROM customer), k AS (SELECT g, CASE WHEN g % 8 < 4 THEN 'books' ELSE 'form26as' END AS kind FROM g),
h(m, place, source_column, books, form26as, semantic) AS (VALUES
  (0, 0, 'TAN', NULL, 'tan', NULL), (0, 1, 'Name of Deductor', NULL, 'deductor_name', NULL), (0, 2, 'Tax Deducted', NULL, 'tax_deducted', NULL), (0, 3, 'Remarks', 'narration', NULL, NULL),
  (1, 0, 'Particulars', 'customer_name', NULL, NULL), (1, 1, 'Voucher No', 'transaction_id', NULL, NULL), (1, 2, 'TDS Receivable', 'tds_expected', NULL, NULL), (1, 3, 'Debit', 'debit_amount', NULL, 'DEBIT_AMOUNT'),
  (2, 0, 'Invoice No', 'document_number', NULL, NULL), (2, 1, 'Invoice Value', 'taxable_value', NULL, NULL), (2, 2, 'Customer', 'customer_name', NULL, NULL), (2, 3, 'Credit', 'credit_amount', NULL, 'CREDIT_AMOUNT'),
  (3, 0, 'Foo', NULL, NULL, NULL), (3, 1, 'Bar', NULL, NULL, NULL), (3, 2, 'Baz', NULL, NULL, NULL), (3, 3, 'Date', 'document_date', 'transaction_date', NULL)),
j AS (SELECT g, kind, place, source_column, semantic, CASE kind WHEN 'books' THEN books ELSE form26as END AS c FROM k JOIN h ON m = g % 4)
SELECT g, kind, place, source_column, c AS canonical_field, CASE WHEN c IS NULL THEN NULL WHEN c = replace(lower(source_column), ' ', '_') THEN 'CANONICAL_HEADER' ELSE 'CANONICAL_ALIAS' END AS mapping_method,
  coalesce(semantic, upper(c)) AS semantic_field, CASE WHEN c IS NULL AND semantic IS NULL THEN 'NOT_DETERMINABLE' ELSE 'HIGH' END AS confidence, CASE WHEN c IS NULL AND semantic IS NULL THEN 'IGNORED' ELSE 'DETECTED' END AS status FROM j""")
def source_profile_columns(spark, d):
    return profiles.columns(_headed_files(spark, d)).withColumn("g", _g()).drop("file")


@query("""WITH g AS (SELECT DISTINCT c_custkey // 50 AS g FROM customer)
SELECT g, CASE g % 4 WHEN 2 THEN 'TDS_ROLE_NOT_DETERMINABLE' WHEN 3 THEN NULL ELSE 'TDS_ROLE_REVIEW_REQUIRED' END AS code, CASE g % 4 WHEN 0 THEN 'Tax Deducted' WHEN 1 THEN 'TDS Receivable' ELSE '' END AS source_columns,
  CASE g % 4 WHEN 3 THEN 'NOT_APPLICABLE' ELSE 'REVIEW_REQUIRED' END AS accounting_context FROM g""")
def source_warnings(spark, d):
    return profiles.warnings(_headed_files(spark, d)).select(_g().alias("g"), "code", F.array_join("source_columns", ",").alias("source_columns"), "accounting_context")


@query("SELECT e.b + 1 AS batch, count(*) AS rows, true AS intact FROM (SELECT *, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END AS b FROM events) e GROUP BY e.b")
def audit_log_batches(spark, d):
    """All events in a log of three batches, each held to its digest and to the link before it."""
    log = sinks.AuditLog(spark, components.shared_path(spark, "audit-log"))
    events = load(spark, d, "events")
    for part in ("event_type = 'click'", "event_type = 'view'", "coalesce(event_type, '') not in ('click', 'view')"):
        log.append(events.filter(part))
    rows = spark.createDataFrame([(x["batch"], x["intact"]) for x in log.verify()], "batch int, intact boolean")
    return log.events().groupBy(F.col("batch").cast("int").alias("batch")).agg(F.count("*").alias("rows")).join(rows, "batch")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS version, count(*) AS rows, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total FROM orders GROUP BY 1", decimals="total")
def written_versions(spark, d):
    path, orders = components.shared_path(spark, "versions"), load(spark, d, "orders")
    for part in ("o_orderstatus = 'F'", "coalesce(o_orderstatus, '') != 'F'"):
        sinks.append_version(orders.filter(part), path, spark)
    return spark.read.parquet(path).groupBy("version").agg(F.count("*").alias("rows"), F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("total"))


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def stream_ingested_once(spark, d):
    """All events as a stream of files that is run twice, the second time without what it remembers."""
    folder, register = components.shared_path(spark, "stream"), ingest.Register(spark, components.shared_path(spark, "register"))
    load(spark, d, "events").repartition(4).write.parquet(folder)
    for _ in range(2):
        ingest.ingest_once(ingest.event_stream(spark, folder), register, components.shared_path(spark, "stream-state")).awaitTermination()
    return register.rows().groupBy("event_type").agg(F.count("*").alias("rows"))
