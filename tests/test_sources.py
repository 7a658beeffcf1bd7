"""Files as users have them: quotes, byte-order marks, packages good and bad, versions and streams."""

import csv
import json
import random
import shutil
import zipfile
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import schema, sinks, tables
from ledgerloom.streaming import ingest


def header(kind, *columns):
    """A spelling of each column's header that the kind knows."""
    known = schema.aliases(kind)
    return ",".join(next(k for k, (column, _) in known.items() if column == c) for c in columns)


def test_a_delimited_file_is_read_below_its_header(spark, tmp_path):
    text = "Ledger export,,\n" + header("books", "customer_name", "document_date", "taxable_value") + '\n"Rao, ""Sons""",05-04-2024,"1,234.50"\n,,\nIyer,2024-04-06,(12)\n'
    (tmp_path / "books.csv").write_text("﻿" + text)
    rows = tables.read_delimited(spark, str(tmp_path / "books.csv"), "books").orderBy("row_no").collect()
    assert [(r["row_no"], r["customer_name"], r["taxable_value"]) for r in rows] == [(3, 'Rao, "Sons"', Decimal("1234.50")), (5, "Iyer", Decimal("-12.00"))]
    assert str(rows[0]["document_date"]) == "2024-04-05"


TEXT = "Ledger export;;\n" + header("books", "customer_name", "document_date", "narration").replace(",", ";") + '''
"Rao
""Sons""; & Co";05-04-2024;"one
two ""x""

three"
Pipe 5" wide;06-04-2024;"quoted" tail
"";07-04-2024;
"a;b";08-04-2024;Münz €
'''
WANTED = [(3, 'Rao\n"Sons"; & Co', "one\ntwo \"x\"\n\nthree"), (8, 'Pipe 5" wide', "quoted tail"), (9, None, None), (10, "a;b", "Münz €")]


@pytest.mark.parametrize("encoding, split", [("utf-8", "16b"), ("utf-8", "128m"), ("utf-8-sig", "37b"), ("utf-16", "16b"), ("utf-16-le", "37b"), ("utf-16-be", "128m"), ("cp1252", "16b")])
def test_quotes_encodings_and_splits(spark, tmp_path, encoding, split):
    (tmp_path / "b.csv").write_bytes(TEXT.replace("\n", "\r\n" if split == "37b" else "\n").encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = tables.read_delimited(spark, str(tmp_path / "b.csv"), "books").orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["row_no"], r["customer_name"], r["narration"]) for r in rows] == WANTED


def test_bytes_that_no_other_encoding_has_are_latin(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes((header("books", "customer_name", "document_date") + "\nM\xfcnz \x81,05-04-2024\n").encode("latin-1"))
    assert tables.detect_encoding(spark, str(tmp_path / "b.csv")) == "ISO-8859-1"
    assert [r["customer_name"] for r in tables.read_delimited(spark, str(tmp_path / "b.csv"), "books").collect()] == ["Münz \x81"]
    with pytest.raises(Exception, match="not valid UTF-8"):
        tables.read_delimited(spark, str(tmp_path / "b.csv"), "books", "UTF-8").collect()


def test_a_quote_that_never_ends_is_refused(spark, tmp_path):
    (tmp_path / "b.csv").write_text(header("books", "customer_name", "document_date") + '\n"Rao,05-04-2024\nIyer,06-04-2024\n')
    with pytest.raises(Exception, match="a quote in line 2 never ends"):
        tables.read_delimited(spark, str(tmp_path / "b.csv"), "books").collect()


@pytest.mark.parametrize("split", ["8b", "64b", "1m"])
def test_records_move_their_lines_once_and_have_a_length_at_most(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(tables, "MOST_LINES", 6)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (tmp_path / "b.csv").write_text('a,b\n1,"x\n\n""y\n\n\nz"\n2,v\n')
        whole = tables.records(tables.lines(spark, str(tmp_path / "b.csv")), ",")
        assert sorted((r["row_no"], r["value"]) for r in whole.collect()) == [(1, "a,b"), (2, '1,"x\n\n""y\n\n\nz"'), (8, "2,v")]
        plan = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("FileScan text") + plan.count("Scan text") <= 8  # both ways of writing it, for lines and their counts, twice
        (tmp_path / "b.csv").write_text('a,b\n1,"x\n\n\n\n\n\nz"\n2,v\n')
        with pytest.raises(Exception, match="a quote in line 2 never ends"):
            tables.records(tables.lines(spark, str(tmp_path / "b.csv")), ",").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_random_quotes_against_a_plain_reader(spark, tmp_path):
    rng = random.Random(3)
    cell = lambda: "".join(rng.choice(['"', ",", "\n", "a", "b ", '""', "é"]) for _ in range(rng.randrange(6)))
    rows = [["n" + cell(), "01-04-2024", cell()] for _ in range(150)]
    with open(tmp_path / "b.csv", "w", newline="") as f:
        f.write(header("books", "customer_name", "document_date", "narration") + "\n")
        csv.writer(f, lineterminator="\n").writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = tables.read_delimited(spark, str(tmp_path / "b.csv"), "books", raw=True).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["customer_name"], r["narration"]) for r in got] == [(a.strip(), c.strip()) for a, _, c in rows]


def test_files_of_one_layout(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(f"report {k}\n" * k + header("books", "customer_name", "document_date") + f"\nname{k},05-04-2024\nTotal,\n")
    rows = tables.read_delimited(spark, str(tmp_path), "books").orderBy("customer_name").collect()
    assert [(r["customer_name"], r["row_no"]) for r in rows] == [("name0", 2), ("name1", 3), ("name2", 4)]


def test_packages(spark, tmp_path):
    def package(name, **members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in members.items():
                z.writestr(member.replace("_", "."), text)

    package("good.zip", a_txt="one\ntwo", b_pdf="x")
    package("two.zip", a_txt="one", b_csv="two")
    with zipfile.ZipFile(tmp_path / "unsafe.zip", "w") as z:
        z.writestr("../a.txt", "one")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    found = {}
    for r in tables.read_packages(spark, str(tmp_path)).orderBy("file", "row_no").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["row_no"], r["value"]) if r["row_no"] else None)
    assert found == {"good.zip": [(1, "one"), (2, "two")], "two.zip": [None], "unsafe.zip": [None], "broken.zip": [None]}


def test_return_rows_of_a_file(spark, tmp_path):
    text = "REGULAR STATEMENT\nReference;PAN;Tax;Challan\nR1;abcde1234f;1,000;C1\n;ABCDE1234F;5;\nR2;ABCDE12345;5;\nR3;ABCDE1234F;x;\n\nR4;ABCDE1234F;0;\n"
    (tmp_path / "r.csv").write_text(text)
    rows = tables.return_rows(tables.lines(spark, str(tmp_path / "r.csv"))).orderBy("row_no").collect()
    assert [(r["row_no"], r["transaction_id"], r["deductee_pan"], r["tds_amount"], r["challan_number"]) for r in rows] == [
        (3, "R1", "ABCDE1234F", Decimal("1000.00"), "C1"),
        (8, "R4", "ABCDE1234F", Decimal("0.00"), None),
    ]


def test_a_return_without_its_columns_or_lines_is_none(spark):
    lines = lambda *rows: spark.createDataFrame(list(enumerate(rows, 1)), "row_no long, value string")
    assert tables.return_rows(lines("PAN,Tax", "ABCDE1234F,5")) is None
    assert tables.return_rows(lines("FORM 26Q")) is None
    assert tables.return_rows(lines()) is None


def test_runs_replace_their_own_rows_only_and_versions_grow(spark, tmp_path):
    path = str(tmp_path / "results")
    sinks.replace_run(spark.range(3), path, "a")
    sinks.replace_run(spark.range(5), path, "b")
    sinks.replace_run(spark.range(1), path, "a")
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"a": 1, "b": 5}
    path = str(tmp_path / "versions")
    assert [sinks.append_version(spark.range(n), path, spark) for n in (2, 3)] == [1, 2]
    assert {r["version"]: r["count"] for r in spark.read.parquet(path).groupBy("version").count().collect()} == {1: 2, 2: 3}


def test_a_stream_takes_every_file_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(folder)
        ingest.ingest_available(ingest.event_stream(spark, folder), out, state).awaitTermination(60)
    ingest.ingest_available(ingest.event_stream(spark, folder), out, state).awaitTermination(60)
    assert spark.read.parquet(out).count() == 7


def test_two_writers_at_once_get_two_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: sinks.append_version(spark.range(n), path, spark), range(1, 5)))
    assert sorted(got) == [1, 2, 3, 4]
    assert {r["version"]: r["count"] for r in spark.read.parquet(path).groupBy("version").count().collect()} == dict(zip(got, range(1, 5)))


def test_content_digests(spark):
    of = lambda df: sinks.content_digest(df).first()["digest"]
    df = spark.range(70_000).selectExpr("id", "if(id % 3 = 0, null, cast(id as string)) as s")
    assert of(df) == of(df.repartition(7, "s").select("s", "id"))
    assert len({of(df), of(df.limit(69_999)), of(df.union(df.limit(1))), of(df.withColumn("s", F.coalesce("s", F.lit("")))), of(df.withColumn("s", F.col("id")))}) == 5


def test_a_changed_batch_of_the_log_is_found(spark, tmp_path):
    log = sinks.AuditLog(spark, str(tmp_path / "log"))
    assert log.events() is None and log.verify() == []
    event = lambda a, b: spark.range(a, b).selectExpr("id as event", "concat('did ', id) as action")
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(lambda k: log.append(event(10 * k, 10 * k + 4)), range(3))) == [1, 2, 3]
    assert log.append(event(0, 0)) == 4
    assert [(x["batch"], x["rows"], x["intact"]) for x in log.verify()] == [(1, 4, True), (2, 4, True), (3, 4, True), (4, 0, True)]
    assert {r["batch"]: r["count"] for r in log.events().groupBy("batch").count().collect()} == {1: 4, 2: 4, 3: 4}
    folder = log.links()[1]["folder"]
    spark.read.parquet(f"{log.path}/{folder}").selectExpr("event", "'did nothing' as action").coalesce(1).write.parquet(str(tmp_path / "changed"))
    shutil.rmtree(f"{log.path}/{folder}")
    shutil.move(str(tmp_path / "changed"), f"{log.path}/{folder}")
    assert [x["intact"] for x in log.verify()] == [True, False, True, True]
    link = log.links()[2]  # a link that is written anew with other rows breaks the one after it
    (tmp_path / "log/_links/000000000003").write_text(json.dumps({**link, "rows": 5, "digest": sinks._link_digest({**link, "rows": 5})}))
    assert [x["intact"] for x in log.verify()] == [True, False, False, False]


def test_a_stream_without_its_checkpoint_takes_nothing_twice(spark, tmp_path):
    folder, register = str(tmp_path / "in"), ingest.Register(spark, str(tmp_path / "out"))
    run = lambda state: ingest.ingest_once(ingest.event_stream(spark, folder), register, str(tmp_path / state)).awaitTermination(90)
    for n in (3, 4):
        spark.range(n).coalesce(1).write.mode("append").parquet(folder)
        run("state")
    assert register.rows().count() == 7 and len(register.entries()) == 2
    run("lost")
    assert register.rows().count() == 7
    spark.range(4).coalesce(1).write.mode("append").parquet(folder)  # the very rows of another source
    run("lost")
    assert register.rows().count() == 7 and len(register.entries()) == 2
    rows = lambda n: spark.range(n).withColumn("job", F.lit("j1"))
    assert register.take(rows(9), "job") == 1 and register.take(rows(9), "job") == 0 and register.rows().count() == 16
    with pytest.raises(ValueError, match="j1"):
        register.take(rows(10), "job")
    # rows that were written but never registered are not seen
    spark.range(5).withColumn("source", F.lit("x")).write.mode("append").partitionBy("source").parquet(f"{register.path}/rows")
    assert register.rows().count() == 16


def test_a_streams_tasks_do_not_grow_with_its_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "TASK_ROWS", 100)
    folder, register = str(tmp_path / "in"), ingest.Register(spark, str(tmp_path / "out"))
    spark.range(1000).withColumn("m", F.create_map(F.lit("a"), F.col("id"))).coalesce(1).write.parquet(folder)
    for state in ("one", "two"):
        ingest.ingest_once(ingest.event_stream(spark, folder), register, str(tmp_path / state)).awaitTermination(90)
    assert sorted(r["id"] for r in register.rows().collect()) == list(range(1000)) and len(register.entries()) == 1
    assert len(register.rows().inputFiles()) > 4  # one task for all rows of a file wrote one
    plan = register.rows()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 16])
def test_no_task_sorts_the_lines_of_a_whole_split(spark, tmp_path, monkeypatch, size):
    """Records over any number of groups of lines, in several files; a split is sorted in groups, in more tasks the more lines."""
    monkeypatch.setattr(tables, "GROUP_LINES", size)
    rng = random.Random(5)
    want = []
    for k in range(3):
        cell = lambda: "".join(rng.choice(['"', ",", "\n", "a", "b", "\n\n"]) for _ in range(rng.randrange(5)))
        rows = [[f"{k}-{n}", cell(), "z"] for n in range(60)]
        with open(tmp_path / f"f{k}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
        want += [",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n') else c for c in r) for r in rows]
    whole = tables.records(tables.lines(spark, str(tmp_path)), ",")
    assert sorted(r["value"] for r in whole.collect()) == sorted(want)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    lines = sum(v.count("\n") + 1 for v in want)
    assert f"RepartitionByExpression [_home#" in plan and plan.rstrip() and (f", {max(4, -(-lines // (4 * size)))}" in plan)


def test_lines_that_are_records_are_not_moved(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x, ""y"""\n2,v"w\n')
    whole = tables.records(tables.lines(spark, str(tmp_path / "a.csv")), ",")
    assert sorted((r["row_no"], r["value"]) for r in whole.collect()) == [(1, "a,b"), (2, '1,"x, ""y"""'), (3, '2,v"w')]
    assert "hashpartitioning" not in whole._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_cells_and_footers_are_those_of_the_slow_way(spark):
    """What one look at a whole record rules out is never there: cells are those of each cell taken by itself."""
    from pyspark.sql import functions as F

    from ledgerloom.functions.text import header_key

    rng = random.Random(9)
    part = lambda: "".join(rng.choice(['"', '""', " ", "\t", "\x01", "a", "B c", " ", "\n"]) for _ in range(rng.randrange(5)))
    raw = [",".join(part() for _ in range(4)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in raw], "value string")
    for delimiter in (",", "\t", "|"):
        d = "\\|" if delimiter == "|" else delimiter
        cells = F.regexp_extract_all(F.concat("value", F.lit(delimiter)), F.lit(rf'(?s)("(?:[^"]++|"")*+"[^{d}]*+|[^{d}]*+){d}'), F.lit(1))
        plain = lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'(?s)\A"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(c)
        want = F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(plain(c), r"[\x00-\x08\x0b-\x1f\x7f]+", " "), r"\A\s+|\s+\z", ""))
        assert df.filter(want != tables.split_cells(F.col("value"), delimiter)).count() == 0
    keys = ["voucher_no", "party_name", "date", "tds_receivable"]
    words = ["Voucher No", "VOUCHER-no", "Party Name", "party", "Date", "﻿Da﻿te", "Grand Total", "sub", "Closing﻿ BALANCE", "Tds  Receivable", "1,00", ""]
    grid = spark.createDataFrame([([rng.choice(words) for _ in range(4)],) for _ in range(2000)], "cells array<string>")
    known = F.transform("cells", header_key)
    footer = tables.is_footer(F.get(F.filter(known, lambda k: k != ""), F.lit(0)), known, F.array(*map(F.lit, keys)))
    found = grid.filter(footer)
    assert found.count() > 100 and found.filter(~tables._may_be_footer(F.col("cells"), keys)).count() == 0
    assert grid.filter(tables._may_be_footer(F.col("cells"), keys)).count() < 2000


def test_places_of_rows_of_many_files(spark):
    """Ranges of row numbers hold no more rows the more files there are; where no place is asked for, none is counted."""
    from pyspark.sql import functions as F

    from ledgerloom.operators import normalise

    rows = spark.createDataFrame([(k % 400, "x" if k % 7 else None) for k in range(4000)] + [(None, "y")], "row_no long, given string")
    normalise.STRIDE, before = 100, normalise.STRIDE
    try:
        got = normalise.positions(rows, wanted=F.col("given").isNull())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "/ 9.0" in plan or "/ 10.0" in plan  # 100 rows of ten files
    finally:
        normalise.STRIDE = before
    found = [r["position"] for r in got.orderBy("position").collect()]
    assert found == list(range(1, 4002)) and got.filter("row_no is null").first()["position"] == 4001
    assert [r["position"] for r in normalise.positions(rows.filter("given is not null"), wanted=F.col("given").isNull()).distinct().limit(1).collect()] != [1]
    assert normalise.positions(rows, wanted=F.col("row_no") < 0).filter("position is not null").count() == 0
