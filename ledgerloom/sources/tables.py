"""Exports as canonical tables.

Delimited files are read as lines with their numbers, in as many splits as Spark makes; a header is looked for among the
first lines only, so nothing but these reaches the driver, and the records are put together, split, named and typed by
column expressions.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date
from ..functions.text import blank_to_null, header_key, is_pan, split_list
from ..operators.validation import header_score, is_footer
from . import schema
from .shared import kept

PREVIEW = 500
DELIMITERS = (",", ";", "\t", "|")


def _raw(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, block, at, value): lines as bytes; blocks are a file's splits by their offsets, at orders a block's lines."""
    reader = spark.read.option("encoding", encoding).option("lineSep", "\n") if encoding else spark.read
    text = reader.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


# Characters of the bytes 0x80 to 0x9F that Windows' code page 1252 defines, and the bytes that it does not.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_LACKS = "[\x81\x8d\x8f\x90\x9d]"


def _survey(spark: SparkSession, path: str) -> DataFrame:
    """A row for each split, of one reading: how many lines, the first one's number, and whether all are UTF-8."""
    return kept(_raw(spark, path).groupBy("file", "block").agg(F.count("*").alias("_size"), F.min("at").alias("_first"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")))


def detect_encoding(spark: SparkSession, path: str, survey: DataFrame | None = None) -> str:
    """UTF-16LE or UTF-16BE by the mark at the start or by the zero bytes of the first line, else UTF-8 if all lines are,
    else cp1252 if no byte is undefined there, else ISO-8859-1."""
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    r = (survey or _survey(spark, path)).agg(F.min(F.struct("file", "block")).alias("at"), F.bool_and("utf8").alias("utf8")).first()
    start = ""
    if r["at"]:  # the first line of the first split
        where = (F.col("_metadata.file_path") == r["at"]["file"]) & (F.col("_metadata.file_block_start") == r["at"]["block"])
        start = spark.read.text(path).filter(where).select(F.hex(F.substring(F.col("value").cast("binary"), 1, 64))).first()[0]
    pairs = [start[k : k + 2] for k in range(0, len(start), 2)]
    if pairs[:2] == ["FF", "FE"] or (len(pairs) > 3 and pairs[1::2].count("00") > len(pairs) // 3):
        return "UTF-16LE"
    if pairs[:2] == ["FE", "FF"] or (len(pairs) > 3 and pairs[::2].count("00") > len(pairs) // 3):
        return "UTF-16BE"
    if r["utf8"] is not False:
        return "UTF-8"
    return "ISO-8859-1" if _raw(spark, path).agg(F.bool_or(latin.rlike(CP1252_LACKS))).first()[0] else "cp1252"


def _decoded(value: Column, encoding: str) -> Column:
    """Lines as text.  Bytes that the encoding does not allow are an error, never a replacement character."""
    if encoding == "UTF-8":
        text = F.when(F.is_valid_utf8(value), value).otherwise(F.raise_error(F.lit("a line is not valid UTF-8")))
    elif encoding == "cp1252":
        text = F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), CP1252_BYTES, CP1252)
    else:
        text = F.decode(value.cast("binary"), encoding)
    return F.regexp_replace(F.replace(text, F.lit("\ufeff"), F.lit("")), r"\r$", "")


def lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, block, row_no from 1 in its file, value) of text files, whatever the number of splits, which block numbers; the
    encoding is looked for unless given."""
    blocks = _survey(spark, path)
    encoding = encoding or detect_encoding(spark, path, blocks)
    text = _raw(spark, path, encoding if encoding.startswith("UTF-16") else None)
    if encoding.startswith("UTF-16"):
        blocks = kept(text.groupBy("file", "block").agg(F.count("*").alias("_size"), F.min("at").alias("_first")))
    # a row for each split
    before = F.sum("_size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    number = F.row_number().over(Window.orderBy("file", "block"))
    blocks = blocks.select("file", "block", number.alias("_no"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return text.join(F.broadcast(blocks), ["file", "block"]).select("file", F.col("_no").alias("block"), (F.col("at") + F.col("_shift")).alias("row_no"), _decoded(F.col("value"), encoding).alias("value"))


#: Lines that one record may have; more mean that a quote never ends.
MOST_LINES = 1000
#: Lines that are sorted together, and groups of them for each task.
GROUP_LINES, GROUPS = 1 << 16, 4


def _cell(d: str) -> str:
    """A cell before a delimiter: quoted, with doubled quotes inside, or without a quote at its start."""
    return f'(?:"(?:[^"]++|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|)'


def records(text: DataFrame, delimiter: str) -> DataFrame:
    """(file, row_no, value): lines put together where a quoted cell holds line breaks; row_no is that of the first line.

    Where no line ends inside a quote that begins in it, each line is a record, and none is moved.  Else, whether a line
    starts inside quotes depends on all lines before it.  A line maps the state before it to the one after it: it keeps it,
    turns it, or sets it.  So the state is that of the last line that sets it, turned as often as lines since then turn it:
    sums over a group of at most GROUP_LINES lines of a split, and the same once more over the groups.  The groups come
    first, from numbers alone; then the lines at a group's start that go on with a record are dealt to the group where it
    begins, so that every group of lines starts outside quotes and holds whole records, and texts move once.
    """
    d = "\\" + delimiter if delimiter == "|" else delimiter
    value, cells = F.col("value"), f"{_cell(d)}(?:{d}{_cell(d)})*+"
    quoted = value.contains('"')  # a line without a quote keeps the state
    from_out = quoted & ~value.rlike(rf"(?s)\A{cells}\z")
    from_in = ~(quoted & value.rlike(rf'(?s)\A(?:[^"]++|"")*+"[^{d}]*+(?:{d}{cells})?\z'))
    ends_inside = lambda some: some.agg(F.bool_or(from_out)).first()[0]
    if not ends_inside(text.limit(1000)) and not ends_inside(text):
        return text.select("file", "row_no", "value")
    names = kept(text.groupBy("block").agg(F.first("file").alias("file"), F.count("*").alias("n")))  # a row for each split
    parts = max(int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(names.agg(F.sum("n")).first()[0] or 0) // (GROUPS * GROUP_LINES)))
    names = F.broadcast(names.select("block", "file"))
    # groups are numbered in the order of their lines
    group = (F.col("block").cast("long") * (1 << 32) + F.floor(F.col("row_no") / GROUP_LINES)).alias("_group")
    rows = text.select(group, "row_no", "value", from_out.alias("_out"), from_in.alias("_into"))
    rows = rows.withColumns({"_set": F.when(F.col("_out") == F.col("_into"), F.col("_out").cast("int")), "_turn": (F.col("_out") & ~F.col("_into")).cast("int")})

    def state(rows: DataFrame, by: list[str], order: str, start: Column) -> DataFrame:
        """Adds _in, the state before a row."""
        w = Window.partitionBy(*by).orderBy(order)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        turns = rows.withColumn("_turns", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        turns = turns.withColumns({"_last": F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", "_turns")), ignorenulls=True).over(earlier), "_so_far": F.coalesce(F.sum("_turn").over(earlier), F.lit(0))})
        known = (F.col("_last._set") + F.col("_so_far") - F.col("_last._turns")) % 2
        return turns.withColumn("_in", F.when(F.col("_last").isNotNull(), known).otherwise((start + F.col("_so_far")) % 2))

    own = state(rows.select("_group", "row_no", "_set", "_turn").repartition(parts, "_group"), ["_group"], "row_no", F.lit(0))
    # a group sets the state if any of its lines does; its lines outside quotes if it starts outside, and if inside
    last = F.max_by(F.struct("_set", "_turns"), F.when(F.col("_set").isNotNull(), F.col("row_no")))
    outside = {k: F.when(F.when(F.col("_last").isNotNull(), F.col("_in")).otherwise((F.col("_in") + k) % 2) == 0, F.col("row_no")) for k in (0, 1)}
    ends = [f(outside[k]).alias(f"{name}{k}") for k in (0, 1) for name, f in (("_first", F.min), ("_final", F.max))]
    groups = own.groupBy("_group").agg(last.alias("_l"), F.sum("_turn").alias("_all"), F.max("row_no").alias("_to"), *ends)
    groups = groups.withColumns({"_set": (F.col("_l._set") + F.col("_all") - F.col("_l._turns")) % 2, "_turn": F.when(F.col("_l").isNull(), F.col("_all") % 2).otherwise(0)})
    of = lambda c: F.shiftright(c, 32).cast("int").alias("block")
    groups = state(groups.select("*", of("_group")).join(names, "block"), ["file"], "_group", F.lit(0))  # a row for each group
    first, final = (F.when(F.col("_in") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("_first", "_final"))
    groups = groups.select("file", "_group", "_to", first.alias("_first"), final.alias("_final"))
    before = Window.partitionBy("file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("_first").isNotNull()
    groups = groups.select("_group", "_to", "_first", F.last(F.when(starts, F.col("_group")), ignorenulls=True).over(before).alias("_home"), F.max("_final").over(before).alias("_of"))
    bad = lambda of: F.raise_error(F.concat(F.lit("a quote in line "), of.cast("string"), F.lit(" never ends")))
    too_long = F.coalesce(F.coalesce(F.col("_first") - 1, F.col("_to")) - F.col("_of") >= MOST_LINES, F.lit(False))
    groups = kept(groups.select("_group", "_first", F.when(too_long, bad(F.col("_of"))).otherwise(F.col("_home")).alias("_home")))
    goes_on = F.col("_first").isNull() | (F.col("row_no") < F.col("_first"))
    dealt = rows.join(F.broadcast(groups), "_group").select(F.when(goes_on, F.col("_home")).otherwise(F.col("_group")).alias("_home"), "row_no", "value", "_set", "_turn")
    known = state(dealt.repartition(parts, "_home"), ["_home"], "row_no", F.lit(0)).withColumn("_after", F.when(F.col("_set").isNotNull(), F.col("_set")).otherwise((F.col("_in") + F.col("_turn")) % 2))
    # the lines of a record follow the last one that starts outside
    here = Window.partitionBy("_home").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    known = known.select("_home", "row_no", "value", "_after", F.last(F.when(F.col("_in") == 0, F.col("row_no")), ignorenulls=True).over(here).alias("_of"))
    known = known.withColumn("_of", F.when(F.col("row_no") - F.col("_of") >= MOST_LINES, bad(F.col("_of"))).otherwise(F.col("_of")))
    lines_ = F.sort_array(F.collect_list(F.struct("row_no", "value", "_after")))
    whole = known.groupBy("_home", F.col("_of").alias("row_no")).agg(lines_.alias("_lines"))
    joined = F.array_join(F.transform("_lines", lambda x: x["value"]), "\n")
    whole = whole.select(of("_home"), "row_no", F.when(F.element_at("_lines", -1)["_after"] == 1, bad(F.col("row_no"))).otherwise(joined).alias("value"))
    return whole.join(names, "block").select("file", "row_no", "value")


def sniff_delimiter(head: list[str]) -> str:
    """The delimiter that splits the first lines most evenly, a comma if none does."""
    def evenness(d: str) -> tuple[int, int]:
        counts = [line.count(d) for line in head if line.strip()]
        most = max(set(counts), key=counts.count) if counts else 0
        return (counts.count(most), most) if most else (0, 0)

    best = max(DELIMITERS, key=evenness)
    return best if evenness(best)[0] else ","


def split_cells(value: Column, delimiter: str) -> Column:
    """Cells of a record, quotes taken off, control characters as blanks, each trimmed.

    A quote counts only at a cell's start; elsewhere it is a character like any other.
    """
    d = "\\" + delimiter if delimiter == "|" else delimiter
    cells = F.regexp_extract_all(F.concat(value, F.lit(delimiter)), F.lit(rf'(?s)("(?:[^"]++|"")*+"[^{d}]*+|[^{d}]*+){d}'), F.lit(1))
    quoted = lambda c: F.replace(F.regexp_replace(c, r'(?s)\A"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"'))
    bare = lambda c: F.when(c.startswith('"'), quoted(c)).otherwise(c)
    # most records have nothing to take away, which one look at the whole tells
    tidy = lambda c: F.regexp_replace(F.regexp_replace(bare(c), r"[\x00-\x08\x0b-\x1f\x7f]+", " "), r"\A\s+|\s+\z", "")
    untidy = value.rlike(rf'[\x00-\x08\x0b-\x1f\x7f]|\s(?:[{d}"]|\z)|(?:[{d}"]|\A)\s')
    return F.when(untidy, F.transform(cells, tidy)).otherwise(F.transform(cells, bare))


def find_header(grid: DataFrame, kind: str) -> tuple[int, list[str]] | None:
    """(row number, keys) of the row with the best score among the first PREVIEW rows; the first of equals, in the first file."""
    scored = grid.filter(F.col("row_no") <= PREVIEW).select("file", "row_no", F.transform("cells", header_key).alias("keys"))
    scored = scored.withColumn("score", header_score(F.col("keys"), schema.aliases(kind))).filter("score > 0")
    best = scored.orderBy(F.desc("score"), "row_no", "file").limit(1).collect()
    return (best[0]["row_no"], best[0]["keys"]) if best else None


def header_mapping(keys: list[str], kind: str) -> dict[str, int]:
    """column -> place of its header: the canonical name before aliases, then the leftmost."""
    known, out = schema.aliases(kind), {}
    for i, key in enumerate(keys):
        if key in known:
            column = known[key][0]
            if column not in out or (key == column and keys[out[column]] != column):
                out[column] = i
    return out


def typed(cell: Column, kind: str) -> Column:
    given = F.nullif(F.trim(cell), F.lit(""))
    return {"string": given, "date": parse_date(given), "money": parse_amount(given), "list": split_list(given)}[kind]


def _may_be_footer(cells: Column, keys: list[str]) -> Column:
    """Whether a row's text has what a total or a repeated header needs, so that few rows' cells are turned into keys."""
    text = F.lower(F.replace(F.array_join(cells, " "), F.lit("\ufeff"), F.lit("")))
    known = [F.coalesce(text.contains(max(k.split("_"), key=len)).cast("int"), F.lit(0)) for k in sorted(set(keys)) if k]
    return reduce(lambda x, y: x | y, (text.contains(w) for w in ("total", "balance"))) | (reduce(lambda x, y: x + y, known, F.lit(0)) >= 3)


def canonical(grid: DataFrame, kind: str, raw: bool = False) -> DataFrame:
    """The rows below the header with the kind's columns; totals, repeated headers and empty rows are left out.

    grid: (row_no, cells), and file where there are several of one layout: each file's rows begin below its own header.
    """
    grid = grid if "file" in grid.columns else grid.withColumn("file", F.lit(""))
    found = find_header(grid, kind)
    if not found:
        raise ValueError(f"no row looks like a header of {kind}")
    at, keys = found
    places = header_mapping(keys, kind)
    cell_keys = F.transform("cells", header_key)
    headers = grid.filter((F.col("row_no") <= PREVIEW) & (cell_keys == F.array(*map(F.lit, keys)))).groupBy("file").agg(F.min("row_no").alias("_head"))
    rows = grid.join(F.broadcast(headers), "file").filter((F.col("row_no") > F.col("_head")) & (F.array_join("cells", "") != ""))
    first = F.get(F.filter(cell_keys, lambda k: k != ""), F.lit(0))
    footer = F.coalesce(is_footer(first, cell_keys, F.array(*(F.lit(k) for k in keys if k))), F.lit(False))
    rows = rows.filter(~F.when(_may_be_footer(F.col("cells"), keys), footer).otherwise(False))
    cell = lambda c: F.get("cells", F.lit(places[c])) if c in places else F.lit(None).cast("string")
    as_kind = lambda c, t: cell(c) if raw else typed(cell(c), t).cast(schema.TYPES[t])
    return rows.select("row_no", "file", *(as_kind(c, t).alias(c) for c, _, t, _ in schema.KINDS[kind]))


def read_grid(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, row_no, cells) of the records of delimited files; empty ones are left out.

    The encoding is looked for unless given; cells may hold line breaks; a quote that never ends is an error.
    """
    text = lines(spark, path, encoding)
    head = text.filter("row_no <= 50").orderBy("file", "row_no").limit(50)
    delimiter = sniff_delimiter([r["value"] for r in head.collect()])
    whole = records(text, delimiter).filter(F.trim("value") != "")
    return kept(whole.select("file", "row_no", split_cells(F.col("value"), delimiter).alias("cells")))  # a header is looked for in these rows before they are named


def read_delimited(spark: SparkSession, path: str, kind: str, encoding: str | None = None, raw: bool = False) -> DataFrame:
    """The canonical rows of a delimited file, or of a folder of files of one layout; as text where ``raw``, for the normalisers."""
    return canonical(read_grid(spark, path, encoding), kind, raw)


def detect_kind(keys: list[str]) -> str | None:
    """The kind that the header fits best."""
    def score(kind: str) -> int:
        known = schema.aliases(kind)
        hit = {known[k] for k in keys if k in known}
        return len(hit) + 3 * sum(required for _, required in hit)

    best = max(schema.KINDS, key=score)
    return best if score(best) else None


def carry_blocks(rows: DataFrame, is_head: Column, carried: dict[str, Column], order: str, block: str) -> DataFrame:
    """Detail rows with what the head row above them says; ``block`` names files or sheets, within which rows follow."""
    w = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({name: F.last(F.when(is_head, c), ignorenulls=True).over(w) for name, c in carried.items()})
    return filled.filter(~is_head)


# Places of the fields in caret-delimited return files, (current layout, older layout).
CARET = {
    "CD": {"reference": (3, 3), "amount": (11, 26), "bsr": (14, 15), "serial": (16, 11), "deposit_date": (18, 17), "tax": (20, 28), "interest": (23, 33)},
    "DD": {"reference": (3, 11), "code": (5, 7), "pan": (7, 9), "name": (8, 12), "section": (14, 32), "pay_date": (18, 22), "amount": (19, 21), "tax": (23, 16), "deposited": (24, 18), "deduction_date": (26, 23), "rate": (27, 25)},
    "BH": {"form": (4, 4), "tan": (12, 12), "pan": (14, 14), "financial_year": (16, 16), "quarter": (17, 17), "name": (18, 18)},
}
FIELD_COUNTS = {"FH": (18, 18), "BH": (72, 72), "CD": (30, 41), "DD": (45, 54)}
DATES = {"deposit_date", "pay_date", "deduction_date"}
NUMBERS = {"amount", "tax", "interest", "deposited", "rate"}


def caret_records(text: DataFrame, record: str, old: bool = False) -> DataFrame:
    """The records of one kind of a caret-delimited file as columns, with their batch and whether they are complete."""
    fields = F.split("value", r"\^", -1)
    rows = text.withColumn("f", fields).filter(F.get("f", F.lit(1)) == record)

    def column(name: str, at: tuple[int, int]) -> Column:
        raw = F.nullif(F.trim(F.get("f", F.lit(at[old]))), F.lit(""))
        if name in DATES:
            return F.try_to_date(raw, "ddMMyyyy")
        if name == "financial_year":
            return F.when(raw.rlike(r"^\d{6}$"), F.concat(F.left(raw, F.lit(4)), F.lit("-"), F.right(raw, F.lit(2))))
        return raw.try_cast("decimal(18,2)") if name in NUMBERS else raw

    columns = [column(n, at).alias(n) for n, at in CARET[record].items()]
    complete = (F.size("f") == FIELD_COUNTS[record][old]).alias("complete")
    return rows.select("row_no", F.concat_ws("^", F.get("f", F.lit(2)), F.get("f", F.lit(3))).alias("batch"), *columns, complete)


MAX_MEMBERS, MAX_BYTES = 50, 25 << 20


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, value): the lines of the one text member of each ZIP file; a bad package has a null row_no and why."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = z.infolist()
                        texts = [m for m in members if m.filename.lower().endswith((".txt", ".csv"))]
                        unsafe = any(m.filename.startswith("/") or ".." in m.filename.split("/") for m in members)
                        if unsafe or len(members) > MAX_MEMBERS or sum(m.file_size for m in members) > MAX_BYTES or len(texts) != 1:
                            raise ValueError("not a package of one text file within the limits")
                        own = z.read(texts[0]).decode("utf-8-sig", "replace").splitlines()
                    yield pd.DataFrame({"file": name, "row_no": range(1, len(own) + 1), "value": own})
                except (ValueError, zipfile.BadZipFile) as e:
                    yield pd.DataFrame({"file": [name], "row_no": [None], "value": [str(e)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, row_no long, value string")


# Headers of structured return extracts, letters and digits only.
RETURN_HEADERS = {
    "transaction_id": ("transactionid", "transactionreference", "reference", "voucher", "vouchernumber"),
    "payment_reference": ("paymentreference", "paymentid", "paymentnumber", "paymentidentifier"),
    "invoice_number": ("invoicenumber", "invoiceno", "invoice"),
    "document_identifier": ("documentidentifier", "documentid", "documentnumber", "documentreference"),
    "deductee_pan": ("deducteepan", "pan"),
    "deductee_name": ("deducteename", "name"),
    "amount_paid": ("amountpaid", "paymentamount", "amount"),
    "tds_amount": ("tdsamount", "taxdeducted", "taxdeductedandpaid", "tax"),
    "section": ("section", "sectioncode"),
    "challan_number": ("challannumber", "challan", "cin"),
    "payment_date": ("paymentdate", "creditdate", "paymentorcreditdate"),
}
RETURN_KEYS = ("transaction_id", "deductee_pan", "tds_amount")


def return_rows(text: DataFrame) -> DataFrame | None:
    """The rows of a structured return extract, given as its lines (row_no, value): row_no and the columns of RETURN_HEADERS.

    A first line that speaks of a form or of a regular or correction statement is a banner and no header.  Rows without
    a transaction, a well-formed PAN or a tax that is a number are left out.  None where the header lacks one of these.
    """
    head = [r["value"] for r in text.filter("row_no <= 50 and trim(value) != ''").orderBy("row_no").collect()]
    head[:1] = [x.lstrip("\ufeff") for x in head[:1]]
    banner = bool(head) and any(word in head[0].upper() for word in ("FORM", "REGULAR", "CORRECTION"))
    if len(head) <= banner:
        return None
    delimiter = sniff_delimiter(head[banner:])
    keys = ["".join(c for c in cell.lower() if c.isascii() and c.isalnum()) for cell in head[banner].split(delimiter)]
    places = {column: i for column, names in RETURN_HEADERS.items() for i in reversed(range(len(keys))) if keys[i] in names}
    if any(k not in places for k in RETURN_KEYS):
        return None
    cells = text.filter("trim(value) != ''").select("row_no", split_cells(F.col("value"), delimiter).alias("cells"))
    first = cells.orderBy("row_no").limit(banner + 1).agg(F.max("row_no")).first()[0]
    given = {c: blank_to_null(F.get("cells", F.lit(places[c]))) if c in places else F.lit(None).cast("string") for c in RETURN_HEADERS}
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    given |= {"deductee_pan": F.upper(given["deductee_pan"]), "amount_paid": number(given["amount_paid"]), "tds_amount": number(given["tds_amount"])}
    rows = cells.filter(F.col("row_no") > first).select("row_no", *(v.alias(k) for k, v in given.items()))
    return rows.filter(F.col("transaction_id").isNotNull() & is_pan(F.col("deductee_pan")) & F.col("tds_amount").isNotNull())
