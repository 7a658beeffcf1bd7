"""The driver's tables as canonical frames, and the same frames in SQL for the results to be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import MONEY
from ..functions.dates import financial_year, quarter


#: Bytes of the tables' files for each part of a shuffle, and of a shuffle for each task.
PART_BYTES, TASK_BYTES = 8 << 20, "16MB"
PARTS, ADVISED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_bytes: dict[str, int] = {}
_given: dict[str, str | None] = {}


def dealt_by_size(spark: SparkSession, sf_dir: str) -> None:
    """Lets the number of a shuffle's parts grow with the tables, so that a task's rows do not; adaptive execution puts small
    parts together.  What the session has set itself stays."""
    if sf_dir not in _bytes:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/{{customer,supplier,part,orders,lineitem,events}}.parquet")
        _bytes[sf_dir] = files.agg(F.sum("length")).first()[0] or 0  # contents are not read
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes[sf_dir] // PART_BYTES))
    if spark.conf.get(PARTS, None) in (None, _given.get(PARTS)):
        _given[PARTS] = str(parts)
        spark.conf.set(PARTS, _given[PARTS])
    if spark.conf.get(ADVISED) in ("64MB", "67108864b", TASK_BYTES):
        spark.conf.set(ADVISED, TASK_BYTES)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated(df: DataFrame, day: str = "day") -> DataFrame:
    return df.withColumns({"fy": financial_year(F.col(day)), "quarter": quarter(F.col(day))})


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines dealt by their orders, so that neither grouping them nor joining the orders moves them again."""
    return load(spark, sf_dir, "lineitem").repartition("l_orderkey")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book entry for each order."""
    o = load(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast(MONEY).alias("amount"), F.col("o_orderpriority").alias("section"))
    return dated(rows)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement row for each order line: its number in the return, deductor, tax and status."""
    l, o = _order_lines(spark, sf_dir), load(spark, sf_dir, "orders")
    tax = (F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY)
    rows = l.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_suppkey").alias("tan"), F.min(F.col("l_shipdate").cast("date")).alias("day"), F.max(F.col("l_extendedprice").cast(MONEY)).alias("amount"),
        F.max(tax).alias("tax"), F.min("l_linestatus").alias("status"), F.min("l_returnflag").alias("section"),
    )
    rows = rows.join(o.select("o_orderkey", F.col("o_custkey").alias("customer")), "o_orderkey").drop("o_orderkey")
    return dated(rows)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment for each statement row, with its nature, dates and the tax withheld."""
    l, o, p = _order_lines(spark, sf_dir), load(spark, sf_dir, "orders"), load(spark, sf_dir, "part")
    tax = (F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY)
    rows = l.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_partkey").alias("p_partkey"), F.min("l_suppkey").alias("deductee"), F.min(F.col("l_shipdate").cast("date")).alias("credited"),
        F.max(F.col("l_extendedprice").cast(MONEY)).alias("amount"), F.max(tax).alias("actual"),
    )
    rows = rows.join(o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("paid")), "o_orderkey")
    rows = rows.join(p.select("p_partkey", F.col("p_type").alias("nature"), F.col("p_name").alias("description")), "p_partkey")
    return rows.drop("o_orderkey", "p_partkey").withColumn("day", F.least("credited", "paid")).withColumn("fy", financial_year(F.col("day")))


RULES = [
    # id, from, to, rate, per transaction, aggregate, excess only, priority, version
    (1, "1990-01-01", "1996-12-31", "1.00", "30000.00", "100000.00", False, 10, 1),
    (2, "1996-06-01", "1998-12-31", "2.00", "30000.00", "100000.00", True, 20, 2),
    (3, "1998-01-01", None, "7.53", "50000.00", "250000.00", False, 20, 3),
    (4, "2000-01-01", None, "10.00", None, "50000.00", False, 30, 4),
]


def rules(spark: SparkSession) -> DataFrame:
    schema = "rule_id int, effective_from string, effective_to string, rate string, per_transaction string, aggregate string, excess_only boolean, priority int, version int"
    rows = spark.createDataFrame(RULES, schema)
    return rows.select(
        "rule_id", *(F.col(c).cast("date").alias(c) for c in ("effective_from", "effective_to")),
        *(F.col(c).cast(MONEY).alias(c) for c in ("rate", "per_transaction", "aggregate")), "excess_only", "priority", "version",
    )


def _rules_sql() -> str:
    def value(x: object, kind: str) -> str:
        return f"NULL::{kind}" if x is None else f"{str(x).lower()}::{kind}" if isinstance(x, bool) else f"'{x}'::{kind}"

    kinds = ("INTEGER", "DATE", "DATE", "DECIMAL(18,2)", "DECIMAL(18,2)", "DECIMAL(18,2)", "BOOLEAN", "INTEGER", "INTEGER")
    rows = ", ".join("(" + ", ".join(map(value, r, kinds)) + ")" for r in RULES)
    return f"rules(rule_id, effective_from, effective_to, rate, per_transaction, aggregate, excess_only, priority, version) AS (VALUES {rows})"


def fy_sql(day: str) -> str:
    y = f"(year({day}) - CASE WHEN month({day}) < 4 THEN 1 ELSE 0 END)"
    return f"({y}::VARCHAR || '-' || lpad((({y} + 1) % 100)::VARCHAR, 2, '0'))"


def quarter_sql(day: str) -> str:
    return f"('Q' || ((((month({day}) + 8) % 12) // 3) + 1)::VARCHAR)"


BOOKS_SQL = f"""books AS (
  SELECT o_orderkey AS id, o_custkey AS customer, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS amount,
    o_orderpriority AS section, {fy_sql('o_orderdate::DATE')} AS fy, {quarter_sql('o_orderdate::DATE')} AS quarter FROM orders)"""
_LINES_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS okey, min(l_suppkey) AS supp, min(l_partkey) AS part_key,
    min(l_shipdate::DATE) AS ship, max(l_extendedprice::DECIMAL(18,2)) AS amount,
    max((l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(4,2))::DECIMAL(18,2)) AS tax, min(l_linestatus) AS status, min(l_returnflag) AS flag
  FROM lineitem GROUP BY 1, 2"""
STATEMENTS_SQL = f"""stmts AS (
  SELECT id, supp AS tan, ship AS day, amount, tax, status, flag AS section, o_custkey AS customer,
    {fy_sql('ship')} AS fy, {quarter_sql('ship')} AS quarter FROM ({_LINES_SQL}) JOIN orders ON o_orderkey = okey)"""
PAYMENTS_SQL = f"""payments AS (
  SELECT id, supp AS deductee, ship AS credited, amount, tax AS actual, o_orderdate::DATE AS paid, p_type AS nature, p_name AS description,
    least(ship, o_orderdate::DATE) AS day, {fy_sql('least(ship, o_orderdate::DATE)')} AS fy
  FROM ({_LINES_SQL}) JOIN orders ON o_orderkey = okey JOIN part ON p_partkey = part_key)"""
RULES_SQL = _rules_sql()
