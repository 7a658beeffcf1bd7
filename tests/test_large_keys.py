"""Queries against their SQL on tables whose keys and values the small tables do not have."""

import duckdb

from ledgerloom import queries as engine

from .test_oracle import rows


def held_to_sql(spark, sf_dir, folder, name, changes):
    """The query's rows and its SQL's over the tables of sf_dir, some with other columns."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"COPY (SELECT * {changes.get(table, '')} FROM '{sf_dir}/{table}.parquet') TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df, want = engine.QUERIES[name](spark, str(folder)), con.sql(engine.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_halves_of_balances_are_rounded_to_even(spark, sf_dir, tmp_path):
    halves = lambda k, c: f"REPLACE (({k} % 40 + 0.5)::DOUBLE AS {c})"
    held_to_sql(spark, sf_dir, tmp_path, "sales_tds_evidence", {"customer": halves("c_custkey", "c_acctbal"), "supplier": halves("s_suppkey", "s_acctbal")})


def test_deductees_beyond_four_digits_are_kept_apart(spark, sf_dir, tmp_path):
    held_to_sql(spark, sf_dir, tmp_path, "statutory_ledger", {"lineitem": "REPLACE (100000 + l_suppkey AS l_suppkey)"})


def test_parts_of_a_shuffle_grow_with_the_tables(spark, sf_dir, monkeypatch):
    from ledgerloom.plans import frames

    engine.QUERIES["duplicate_review"](spark, sf_dir)
    least = int(spark.conf.get(frames.PARTS))
    assert least == int(spark.conf.get("spark.sql.shuffle.partitions")) and spark.conf.get(frames.ADVISED) == frames.TASK_BYTES
    monkeypatch.setitem(frames._bytes, "large", 100 * frames.PART_BYTES + 1)
    frames.dealt_by_size(spark, "large")
    assert int(spark.conf.get(frames.PARTS)) == 101
    frames.dealt_by_size(spark, sf_dir)
    assert int(spark.conf.get(frames.PARTS)) == least
    spark.conf.set(frames.PARTS, "77")  # the session's own number stays
    try:
        frames.dealt_by_size(spark, "large")
        assert spark.conf.get(frames.PARTS) == "77"
    finally:
        spark.conf.unset(frames.PARTS)


def test_requests_of_one_id_are_ledgers_of_their_own(spark, sf_dir, tmp_path):
    held_to_sql(spark, sf_dir, tmp_path, "seeded_calculator", {"lineitem": "REPLACE ((10 * l_linenumber)::INTEGER AS l_linenumber)"})
