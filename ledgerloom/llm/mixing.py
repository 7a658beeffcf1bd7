"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / quality, with u drawn from a digest of the document, so that better
documents tend to come first and reruns agree.  A source's target is its share by weight, at most MAX_EPOCHS times its
size, what is cut off being shared again.  Whole epochs of the source come first; what is left of the target is filled
with documents in the order of their keys until their prefix sum reaches it, and of the last one only as many words are
taken as are still missing.

No source is ever sorted or summed in one task: the keys fall into cells of about CELL_ROWS rows, the cells' sizes are
summed before the shuffle, prefix sums run over the cells, and only the rows of the one cell of each source in which the
target ends are put into order.

Defined cases: a null text has size 0 and is taken 0 times or whole, without words; a null source is a source, ordered
last; rows with the same id and text are told apart only by their other drawn bits and may tie, ties being taken in
order of the id; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import fresh, stored

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
#: Rows that a cell of keys holds on average.
CELL_ROWS = 200
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_weight(text: Column) -> Column:
    """A quality weight from 0.05 to 1: the share of a text that is not symbols, falling steeply."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), 1 - 10 * F.coalesce(symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the values alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    The targets are min(MAX_EPOCHS * size, level * weight) for the one level at which they add up to all words; it is
    found by capping and sharing again until nothing is above its cap, and only sums reach the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row for each source, not for each document
    n = F.row_number().over(order) - 1
    ranked = stored(sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))), "mix-sources")
    cap = MAX_EPOCHS * F.col("source_size")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    level = (total or 0) / weight if weight else 0.0
    while weight:
        above = level * F.col("w") > cap
        capped, left = ranked.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("w")))).first()
        if not left:
            break
        new = (total - (capped or 0)) / left
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(cap.cast("double"), level * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row."""
    return _mixed(_drawn(docs, id_col, text_col, source_col), weights).drop("mark")


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: rows of docs, as often as they are taken, with all columns of docs.

    Of a document that is taken in part, the last row holds the words that are taken, joined by blanks.
    """
    mark = F.xxhash64(F.col(text_col).cast("string"))
    mixed = _mixed(_drawn(docs, id_col, text_col, source_col), weights)
    plan = mixed.groupBy("doc_id", "mark").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("rows"))
    of = {c: fresh(f"mix_{c}", docs) for c in ("doc_id", "mark", "taken", "size", "rows", "copy")}
    plan = stored(plan.filter("taken > 0"), "mix-plan").withColumnsRenamed({c: of[c] for c in plan.columns})
    own = {c: F.col(n) for c, n in of.items()}
    rows = docs.join(plan, F.col(id_col).cast("long").eqNullSafe(own["doc_id"]) & (mark == own["mark"]))
    if not plan.filter(own["rows"] > 1).isEmpty():  # equal rows: one of them stands for all
        again = rows.filter(own["rows"] > 1).dropDuplicates([of["doc_id"], of["mark"]])
        rows = rows.filter(own["rows"] == 1).unionByName(again)
    copies = F.ceil(own["taken"] / own["size"]).cast("int")
    rows = rows.withColumn(of["copy"], F.explode(F.sequence(F.lit(1), copies)))
    left = own["taken"] - (own["copy"] - 1) * own["size"]
    some = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})"), 1), F.lit(1), left.cast("int")), " ")
    cut = rows.withColumn(text_col, F.when(left < own["size"], some).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(left < own["size"], F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    key = -F.log(uniform(F.col(id_col).cast("long"), text)) / symbol_weight(text)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), key.alias("key"), F.xxhash64(text).alias("mark"))


def _mixed(drawn: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    rows = stored(drawn, "mix-keys")  # ids and numbers only; the texts are read once
    n = rows.count()
    cells = max(1, n // CELL_ROWS)
    # keys of weight w are exponential with mean 1 / w: a mean of such distributions spreads those of all weights over
    # the cells and keeps their order
    spread = 1 - (F.exp(-F.col("key")) + F.exp(-F.col("key") / 5) + F.exp(-F.col("key") / 20)) / 3
    rows = rows.withColumn("cell", F.floor(spread * cells))
    by_cell = stored(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    goal = targets(by_cell.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    goal = goal.withColumnRenamed("source", "g")
    placed = by_cell.withColumn("before", F.coalesce(before, F.lit(0)))
    placed = placed.join(goal, placed["source"].eqNullSafe(goal["g"])).drop("g")
    # a cell is taken whole, not at all, or it is the one in which the target ends
    whole = F.col("before") + F.col("cell_size") <= F.col("rest")
    none = F.col("before") >= F.col("rest")
    plan = placed.select("source", "cell", "source_size", "target", "epochs", F.when(whole, F.lit(None)).when(none, 0).otherwise(F.col("rest") - F.col("before")).alias("budget"), whole.alias("whole"))
    plan = plan.withColumnRenamed("source", "s").withColumnRenamed("cell", "c")
    # the plan has a row for about CELL_ROWS rows; cells of one source lie in many tasks, so a hot source does too
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["cell"] == plan["c"])).drop("s", "c")
    ends = joined.filter(~F.col("whole") & (F.col("budget") > 0))
    order = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("size").over(order)
    part = ends.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - upto + F.col("size"))))
    rest = joined.filter(F.col("whole") | (F.col("budget") <= 0)).withColumn("part", F.when(F.col("whole"), F.col("size")).otherwise(0))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return part.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "mark")

