"""Quality rules with a perplexity band for each language.

The model is a modified Kneser-Ney model of ORDER characters.  A text is taken as code points with A-Z as a-z, every
digit as 0, every blank as a space and what lies beyond 16 bits folded into the surrogates' range, so an n-gram of four
is one 64-bit number and none is confused with another below that fold.  Spark counts the n-grams of all texts as often
as they occur; the lower orders count in how many different contexts their n-grams stand, as the method wants.  All of
that is aggregation by the n-gram's number.

All texts that are scored are counted as well, so each of their n-grams has its probability, found once for each different
n-gram by joins from order to order.  What is sent to every task is bounded: each n-gram falls by a hash into one of
2**SLOT_BITS slots, and where several do, only the most frequent is sent.  Those arrays lie in ascending order, and scoring
probes them by binary search, once for each different n-gram of a run of texts.  The n-grams that were not sent come out of
the tasks with how often each text has them and are joined with their probabilities, so no n-gram is left out.

A document is rejected when its log-perplexity lies outside its language's band.  The band is drawn from quartiles of
all documents of the language that the plain rules keep, ``SPREAD`` interquartile ranges to both sides; as the mean over
n characters strays by the order of 1/sqrt(n), short documents get ``SHORT / sqrt(n)`` more.  Bands are joined by
language, however many there are.

Defined cases: a null text counts as no words (rejected by the rules); a null language is a language of its own; an
empty table gives an empty result; repeated rows are judged one by one; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import byte_texts, chunks, counted, fresh, keyed_texts, lean, small_batches, stored

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
ORDER = 4
#: At most 2**SLOT_BITS n-grams are sent to the tasks; the others are joined.
SLOT_BITS = 22
SPREAD, SHORT = 2.0, 1.5
#: Width of a bin of log-perplexity in the histograms that give the quartiles.
BIN = 0.002
#: Bytes of text whose n-grams are sorted together, and different n-grams that a task holds before it gives them out.
AT_ONCE, HELD = 1 << 20, 1 << 20
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5

_FOLD = np.arange(1 << 16, dtype=np.uint64)
_FOLD[[*b"0123456789"]] = ord("0")
_FOLD[[*BLANKS]] = ord(" ")
#: Number of the symbol that stands before a text's first character and after its last.
_EDGE = 0
_FOLD[0] = 1


def symbols(text: bytes) -> np.ndarray:
    """The text's characters as numbers below 2**16, with ORDER - 1 edges before and one after them."""
    points = np.frombuffer(text.lower().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() >= 1 << 16:
        points = np.where(points >= 1 << 16, 0xD800 + (points & 0x7FF), points)
    out = np.full(len(points) + ORDER, _EDGE, np.uint64)
    out[ORDER - 1 : -1] = _FOLD[points]
    return out


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the n-grams of all texts, each ending in a character or the last edge, how many each text has)."""
    own = [symbols(x) for x in texts]
    lengths = np.array([len(x) - ORDER + 1 for x in own], np.int64)
    a = np.concatenate([*own, np.zeros(ORDER, np.uint64)])
    keys = a[: -ORDER + 1 or None].copy()
    for k in range(1, ORDER):
        keys = (keys << np.uint64(16)) | a[k : len(keys) + k]
    # a window of every place; those that reach into the next text are left out
    real = np.ones(len(keys), bool)
    ends = np.cumsum(lengths + ORDER - 1)
    for k in range(1, ORDER):
        real[ends - k] = False
    real[ends[-1] if len(ends) else 0 :] = False
    return keys[real], lengths


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = (_grams(texts[i:j])[0] for texts in map(byte_texts, batches) for i, j in chunks(texts, AT_ONCE))
    for keys, n in counted(grams, HELD):
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) of every n-gram of the texts' characters and how often it occurs."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(lean(_count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off n-grams that are counted once, twice, and more often."""
    n1, n2, n3, n4 = (max(1, n or 0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


def _suffix(order: int) -> Column:
    return F.expr(f"gram & {(1 << 16 * (order - 1)) - 1}")


def _of_lower(counts: DataFrame, order: int) -> DataFrame:
    """The next lower order's counts: in how many different contexts its n-grams stand."""
    return stored(counts.groupBy(_suffix(order).alias("gram")).agg(F.count("*").alias("n")), "quality-counts")


def _most_frequent(rows: DataFrame, slot_bits: int, *more: str) -> DataFrame:
    """(n, gram, more) of the most frequent n-gram of each of 2**slot_bits slots."""
    slot = F.pmod(F.xxhash64("gram"), F.lit(1 << slot_bits))
    return rows.groupBy(slot.alias("slot")).agg(F.max(F.struct("n", "gram", *more)).alias("row")).select("row.*")


def _order(counts: DataFrame, order: int, slot_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """An order's n-grams (gram, context, share, n) with their discounted share, those of bounded slots or all, and their
    contexts (context, left) with the mass that is left to the lower order."""
    context = F.expr(f"shiftrightunsigned(gram, 16) & {(1 << 48) - 1}")
    of = counts.withColumn("context", context if order > 1 else F.lit(0).cast("long"))
    off = _discounts(*counts.agg(*(F.sum(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4))).first())
    totals = of.groupBy("context").agg(F.sum("n").alias("total"))
    discount = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
    kept = of if slot_bits is None else _most_frequent(of, slot_bits, "context")
    shares = stored(kept.join(totals, "context").select("gram", "context", ((F.col("n") - discount) / F.col("total")).alias("share"), "n"), "quality-grams")
    return shares, shares.groupBy("context").agg((1 - F.sum("share")).alias("left"))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(gram, n, log): of every n-gram of (gram, n), the logarithm of its probability by the whole model."""
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append((order, *_order(counts, order)))
        if order > 1:
            counts = _of_lower(counts, order)
    p = None
    for order, shares, contexts in reversed(levels):
        if p is None:
            lower = shares.withColumn("p", F.lit(1 / (shares.count() + 1)))  # one for what was never seen
        else:
            lower = shares.withColumn("suffix", _suffix(order)).join(p, "suffix")
        both = lower.join(contexts, "context").select("gram", "n", (F.col("share") + F.greatest("left", F.lit(0.0)) * F.col("p")).alias("p"))
        p = both.select(F.col("gram").alias("suffix"), "p")
    return stored(both.select("gram", "n", F.log(F.greatest("p", F.lit(1e-12))).alias("log")), "quality-logs")


def _ascending(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.view(np.uint64)
    by = np.argsort(keys)
    return keys[by], values[by]


class KneserNey:
    """Interpolated modified Kneser-Ney by itself, of bounded size, for texts that were not counted: for each order, n-grams
    in ascending order with their discounted share, and contexts in ascending order with the mass that they leave to the
    next lower order.  The mass of n-grams that lost their slot goes to the lower order."""

    def __init__(self, grams: dict, contexts: dict, known: int):
        self.grams, self.contexts, self.uniform = grams, contexts, 1 / (known + 1)  # one for what was never seen

    @staticmethod
    def fit(counts: DataFrame, slot_bits: int | None = None) -> KneserNey:
        """The model from (gram, n); the lower orders count the different n-grams that end in theirs."""
        grams, contexts, known = {}, {}, 0
        for order in range(ORDER, 0, -1):
            shares, left = (df.toArrow() for df in _order(counts, order, slot_bits or SLOT_BITS))  # bounded by the slots
            grams[order] = _ascending(shares["gram"].to_numpy(), shares["share"].to_numpy())
            contexts[order] = _ascending(left["context"].to_numpy(), left["left"].to_numpy())
            known = len(grams[order][0])
            if order > 1:
                counts = _of_lower(counts, order)
        return KneserNey(grams, contexts, known)

    @staticmethod
    def _probe(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, absent: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full(len(wanted), absent)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], absent).astype(np.float64)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """P(last character | the ones before it) of whole n-grams."""
        p = np.full(len(grams), self.uniform)
        for order in range(1, ORDER + 1):
            own = grams & np.uint64((1 << 16 * order) - 1)
            left = self._probe(self.contexts[order], own >> np.uint64(16), 1.0)
            p = self._probe(self.grams[order], own, 0.0) + np.maximum(left, 0) * p
        return p


def log_sums(keys: np.ndarray, logs: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(the sum of the logarithms of each text's n-grams that are among the ascending keys, how many n-grams it has, and
    those that are not among them, with how often each occurs)."""
    sums, lengths, grams, often, rows = ([np.zeros(0, k)] for k in (float, np.int64, np.uint64, np.int64, np.int64))
    for i, j in chunks(texts, AT_ONCE):
        own, n = _grams(texts[i:j])
        different, which = np.unique(own, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, different), max(len(keys) - 1, 0))
        found = keys[at] == different if len(keys) else np.zeros(len(different), bool)
        value = np.where(found, logs[at], 0.0) if len(keys) else np.zeros(len(different))
        sums.append(np.add.reduceat(value[which], np.cumsum(n) - n))
        lengths.append(n)
        if not found.all():
            out = ~found[which]
            pairs, count = np.unique(np.stack([np.repeat(np.arange(i, j), n)[out], which[out]]), axis=1, return_counts=True)
            for column, part in ((rows, pairs[0]), (grams, different[pairs[1]]), (often, count)):
                column.append(part)
    ends = np.cumsum(np.bincount(np.concatenate(rows), minlength=len(texts)))
    rest = pa.StructArray.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(often))], ["gram", "n"])
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return np.concatenate(sums), np.concatenate(lengths), pa.ListArray.from_arrays(offsets, rest)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    words = text.split()
    n = len(words)
    ink = text.translate(None, BLANKS)
    chars = len(ink) if ink.isascii() else len(ink.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    dup_lines = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup_lines += 1
            elif line.strip():
                seen.add(line)
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(grams)) < len(grams):
            repeated = _covered(grams, n)
    return n, chars, len(ink) - len(ink.translate(None, SYMBOLS)), dup_lines, repeated


def _covered(grams: list[tuple], n: int) -> int:
    """Words that lie in a window found more than once."""
    ids: dict[tuple, int] = {}
    gram = np.array([ids.setdefault(g, len(ids)) for g in grams])
    again = np.bincount(gram)[gram] > 1
    inside = np.zeros(n + 1, np.int64)
    inside[: len(gram)] += again
    inside[WINDOW : WINDOW + len(gram)] -= again[: n + 1 - WINDOW]
    return int(np.sum(np.cumsum(inside)[:n] > 0))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, text_col: str, out: str, columns: list[str]) -> DataFrame:
    """These columns of docs, stored, with one more, a structure of the counts, the length in bytes and the log-perplexity of
    each text."""
    spark = docs.sparkSession
    small_batches(spark)
    every = log_probabilities(stored(gram_counts(docs, text_col), "quality-counts"))
    sent = _most_frequent(every, SLOT_BITS, "log").select("gram", "log").toArrow()  # at most 2**SLOT_BITS rows
    whole = every.count() == sent.num_rows
    model = spark.sparkContext.broadcast(_ascending(sent["gram"].to_numpy(), sent["log"].to_numpy()))

    @F.arrow_udf(", ".join(f"{c} long" for c in _COUNTS) + ", n_bytes long, sum double, grams long, rest array<struct<gram long, n long>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [x or b"" for x in batch.to_pylist()]
            base = np.array([base_counts(x) for x in texts], np.int64).reshape(-1, len(_COUNTS))
            sums, grams, rest = log_sums(*model.value, texts)
            columns = [*map(pa.array, (*base.T.copy(), np.array([len(x) for x in texts], np.int64), sums, grams)), rest]
            yield pa.StructArray.from_arrays(columns, [*_COUNTS, "n_bytes", "sum", "grams", "rest"])

    row, more = fresh("quality_row", docs), fresh("quality_more", docs)
    rows = docs.withColumn(out, score(F.col(text_col).cast("binary"))).withColumn(row, F.monotonically_increasing_id())
    rows = stored(rows.select(*columns, out, row), "quality").withColumn(more, F.lit(0.0))
    if not whole:  # the n-grams that were not sent; the frequent ones were, so none is hot
        each = rows.select(row, F.explode(F.col(out)["rest"]).alias("r")).select(row, "r.gram", F.col("r.n").alias("times"))
        sums = each.join(every, "gram").groupBy(row).agg(F.sum(F.col("times") * F.col("log")).alias(more))
        rows = rows.drop(more).join(sums, row, "left")
    of = F.col(out)
    perplexity = -(of["sum"] + F.coalesce(more, F.lit(0.0))) / of["grams"]
    return rows.withColumn(out, F.struct(*(of[c].alias(c) for c in (*_COUNTS, "n_bytes")), perplexity.alias("log_perplexity"))).select(*columns, out)


def language_bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high) from (lang, base_failed, log_perplexity); what is sorted is a histogram of each language."""
    usable = rows.filter(~F.col("base_failed")).withColumn("bin", F.floor(F.col("log_perplexity") / BIN))
    by_bin = usable.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    ranked = by_bin.select("lang", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    q1, q3 = (F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * BIN)) for q in (0.25, 0.75))
    bands = ranked.groupBy("lang").agg(q1.alias("q1"), q3.alias("q3"))
    wide = SPREAD * (F.col("q3") - F.col("q1"))
    return bands.select("lang", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def _language(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # null is none of the languages that have a name


def _failed(of: Column) -> Column:
    return (of["n_words"] < MIN_WORDS) | (100 * of["n_repeat_words"] > MAX_REPEATED_PERCENT * of["n_words"])


def _verdicts(rows: DataFrame, of: Column, lang: Column, low: str, high: str) -> DataFrame:
    """rows with their band's limits, joined by language."""
    known = rows.select(lang.alias("lang"), _failed(of).alias("base_failed"), of["log_perplexity"].alias("log_perplexity"))
    name = fresh("quality_lang", rows)
    bands = stored(language_bands(known), "quality-bands").select(F.col("lang").alias(name), F.col("low").alias(low), F.col("high").alias(high))
    slack = SHORT / F.sqrt(of["n_bytes"] + 1)
    joined = rows.join(bands, lang == F.col(name), "left").drop(name)
    # a language without a document that the rules keep has no band, and keeps none either
    return joined.withColumn(low, F.coalesce(low, F.lit(float("-inf"))) - slack).withColumn(high, F.coalesce(high, F.lit(float("inf"))) + slack)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row's counts, log-perplexity, band and verdict."""
    texts = keyed_texts(docs.select(id_col, text_col, lang_col), id_col, text_col, F.col(lang_col).alias("lang"))
    rows = scored(texts, "text", "of", ["id", "lang"])  # numbers only
    of = F.col("of")
    judged = _verdicts(rows, of, _language(F.col("lang")), "band_low", "band_high")
    kept = ~_failed(of) & of["log_perplexity"].between(F.col("band_low"), F.col("band_high"))
    return judged.select(F.col("id").alias("doc_id"), *(of[c].alias(c) for c in _COUNTS), _failed(of).alias("base_failed"), kept.alias("kept"), of["log_perplexity"].alias("log_perplexity"), "band_low", "band_high")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules and the band keep, whole and with all their columns.

    Rows are written once with their scores and read again with their bands, so no text is scored twice or shuffled.
    """
    name, low, high = fresh("quality_of", docs), fresh("quality_low", docs), fresh("quality_high", docs)
    rows = scored(docs, text_col, name, docs.columns)
    of = F.col(name)
    judged = _verdicts(rows, of, _language(F.col(lang_col)), low, high)
    return judged.filter(~_failed(of) & of["log_perplexity"].between(F.col(low), F.col(high))).select(*docs.columns)
