"""LM scoring with a hashed maximum-entropy model.

Tokens are the words of a text (A-Z as a-z) and its end.  A word is known by 48 bits of its hash and its last two bytes.
Spark counts the tokens of all training texts; everything below is drawn from these counts.

    P(word | history) = P(class | history) * P(head | class, history) * P(word | class, head)

Every word, known or not, has a class, which its last two bytes decide; the end is a class of its own.  The most frequent
words of a class are its heads, each standing for itself, and one further head stands for all others.  Both
P(class | history) and P(head | class, history) are softmaxes of a log frequency and three hashed features: the last
word, the last two words (n-grams) and the word before the last (skip).  A word that is no head is drawn among those of
its class by (count + 0.5) / (their tokens + 0.5 * (their number + 1)), the last one standing for all unseen words.

Classes, heads and feature buckets grow with the number of distinct training tokens (``shape``), up to MOST_WEIGHTS
weights, so that the model fits every task whatever the corpus.

Training goes over every training text once, in ROUNDS parts that are drawn by a hash.  In each round the tasks hold the
weights as they are and add up for every feature and outcome how often it was observed and how often expected; Spark
sums that over the tasks.  Their difference is the gradient of the log-likelihood, and a weight moves along it by STEP
times the difference over the logarithmic mean of the two sums, that is by STEP * log(observed / expected), both smoothed.

The counts of the most frequent words travel with the model; those of others are joined with the texts' occurrences.

Defined cases: a null text is its end alone; a null id is hashed as if it were no held-out one; repeated rows are scored
one by one; without training texts every token is unseen; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import byte_texts, chunks, counted, keyed_texts, lean, mix64, small_batches, stored, word_hashes

#: Words whose counts travel with the model, besides the heads; weights of each softmax at most; rounds of training.
TOP, MOST_WEIGHTS, ROUNDS = 1 << 18, 1 << 24, 3
#: Share of the full step that an update takes, and pseudo-observations of each feature.
STEP, SMOOTH = 0.7, 512.0
#: Weights are kept within LIMIT, so that no exponential overflows.
LIMIT = 20.0
#: Bytes of text that are encoded at once, probabilities that are added and that are made at once, buckets that travel as one row.
AT_ONCE, ADDED, MADE, BLOCK = 1 << 20, 1 << 20, 1 << 15, 64
#: Rows for one place that are added by turns; more are summed in runs of so many.
TURNS, RUN = 6, 32
#: The end of a text, and what stands before its first token.
END, START = np.uint64(0), np.uint64(1)
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the tokens of all texts, each text's closed by END, how many each text has)."""
    joined = b" ".join(texts)
    hashes, first, last = word_hashes(joined)
    a = np.frombuffer(joined.lower() + b"\0", np.uint8).astype(np.uint64)
    before = np.where(last - first > 1, a[np.maximum(last - 2, 0)], 0)
    words = hashes & ~np.uint64(0xFFFF) | a[last - 1] << np.uint64(8) | before.astype(np.uint64)
    lengths = np.diff(np.searchsorted(first, np.cumsum([0] + [len(x) + 1 for x in texts]))) + 1
    out = np.full(len(words) + len(texts), END)
    ends = np.zeros(len(out), bool)
    ends[np.cumsum(lengths) - 1] = True
    out[~ends] = words
    return out, lengths


def class_of(token, classes: int):
    """The class that a word's last two bytes decide, from 1; for arrays and for columns."""
    if isinstance(token, Column):
        return F.when(token == 0, 0).otherwise(1 + F.shiftright(token.bitwiseAND(0xFFFF) * 40503, 4) % (classes - 1)).cast("int")
    ending = (token & np.uint64(0xFFFF)).astype(np.int64)
    return np.where(token == END, 0, 1 + (ending * 40503 >> 4) % (classes - 1))


def shape(distinct: int) -> tuple[int, int]:
    """(classes, which is also the number of heads of a class; buckets) for so many distinct tokens: with their fourth
    root and their square root."""
    bits = log2(max(2, distinct))
    classes = 1 << max(3, round(bits / 4 + 1))
    return classes, max(BLOCK, min(1 << round(bits / 2 + 4), MOST_WEIGHTS // classes))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = (tokens(texts[i:j])[0] for texts in map(byte_texts, batches) for i, j in chunks(texts, AT_ONCE))
    for h, n in counted(parts):
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def token_counts(training: DataFrame) -> DataFrame:
    """(h, n) of every distinct token of the texts."""
    return stored(training.select("text").mapInArrow(lean(_count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")


class Model:
    """The words that travel with it, in ascending order with their counts and heads, frequencies and weights."""

    def __init__(self, words: pd.DataFrame, sums: pd.DataFrame, classes: int, buckets: int):
        """words: (h, n, head), head from 0 or -1; sums: (cls, n, v) of the tokens of every class."""
        words = words.assign(h=words["h"].to_numpy().view(np.uint64)).sort_values("h")
        self.keys, self.counts = words["h"].to_numpy(), words["n"].to_numpy().astype(np.int64)
        self.classes, self.buckets = classes, buckets
        self.other = classes - 1
        self.heads = np.where(words["head"] >= 0, words["head"], self.other).astype(np.int64)
        n, v = np.zeros(classes), np.zeros(classes)
        n[sums["cls"]], v[sums["cls"]] = sums["n"], sums["v"]
        cls = class_of(self.keys, classes)
        own = np.zeros((classes, classes))
        head = self.heads < self.other
        own[cls[head], self.heads[head]] = self.counts[head]
        is_head = own > 0
        left = n - own.sum(1)
        own[:, self.other] = left
        is_head[1:, self.other] = True  # the end has no others
        is_head[0, 0] = True
        self.prior = np.log((n + 0.5) / (n.sum() + 0.5 * classes)).astype(np.float32)
        shares = np.where(is_head, own + 0.5, 0)
        with np.errstate(divide="ignore"):
            self.prior_head = np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32)
        self.among = np.log10(left + 0.5 * (v - (is_head.sum(1) - 1) + 1))  # of the words that are no heads
        self.weights = [np.zeros((buckets, classes), np.float32) for _ in range(2)]

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether a token travels with the model, its count, its class, its head)."""
        cls = class_of(own, self.classes)
        if not len(self.keys):
            return np.zeros(len(own), bool), np.zeros(len(own), np.int64), cls, np.where(cls > 0, self.other, 0)
        different, of = np.unique(own, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, different), len(self.keys) - 1)[of]
        known = self.keys[at] == own
        return known, np.where(known, self.counts[at], 0), cls, np.where(known, self.heads[at], np.where(cls > 0, self.other, 0))

    def features(self, own: np.ndarray, lengths: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
        """The three buckets of each token's history, for its class and for its head."""
        first = np.cumsum(lengths) - lengths
        one = np.roll(own, 1)
        one[first] = START
        two = np.roll(one, 1)
        two[first] = START
        with np.errstate(over="ignore"):
            raw = np.stack([mix64(one ^ _SALTS[0]), mix64(one * np.uint64(3) + two ^ _SALTS[1]), mix64(two ^ _SALTS[2])])
            inner = mix64(raw + cls.astype(np.uint64) * _SALTS[3])
        return [(x % np.uint64(self.buckets)).astype(np.int64) for x in (raw, inner)]

    def exponentials(self, level: int, features: np.ndarray, cls: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(which tokens, what their outcomes' probabilities are proportional to, the sums of that), some at a time, so that
        a processor's cache holds their rows; a row is overwritten by the next ones."""
        w, n = self.weights[level], max(16, MADE // self.classes)
        x, more = np.empty((2, min(n, len(cls)), self.classes), np.float32)
        ones = np.ones(self.classes, np.float32)
        for at in range(0, len(cls), n):
            part = slice(at, min(at + n, len(cls)))
            own, other = x[: part.stop - at], more[: part.stop - at]
            np.take(w, features[0][part], axis=0, out=own, mode="clip")  # no place is outside; the other modes copy twice
            for f in features[1:]:
                own += np.take(w, f[part], axis=0, out=other, mode="clip")
            own += np.take(self.prior_head, cls[part], axis=0, out=other, mode="clip") if level else self.prior
            np.exp(own, out=own)
            yield part, own, own @ ones

    def probabilities(self, level: int, features: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """P(class | history) at level 0, P(head | class, history) at level 1, a row for each token."""
        out = np.empty((len(cls), self.classes), np.float32)
        for part, x, total in self.exponentials(level, features, cls):
            np.multiply(x, (1 / total)[:, None], out=out[part])
        return out

    def log_probability(self, level: int, features: np.ndarray, cls: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's own outcome."""
        out = np.empty(len(cls))
        for part, x, total in self.exponentials(level, features, cls):
            out[part] = np.log10(x[np.arange(len(x)), outcome[part]] / total)
        return out


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, where places repeat: the rows of a place are added up first, few by turns, many as products of
    short runs with the matrix that says which row is whose, whose results are rows for the same places."""
    by = np.argsort(at.astype(np.uint16) if len(total) <= 1 << 16 else at, kind="stable")  # short numbers sort in linear time
    place = at[by]
    start = np.flatnonzero(np.diff(place, prepend=-1))
    length = np.diff(start, append=len(place))
    few = start[length <= TURNS]
    if len(few):
        sums, n = np.take(rows, by[few], axis=0, mode="clip"), length[length <= TURNS]
        for k in range(1, n.max()):
            own = np.flatnonzero(n > k)
            sums[own] += np.take(rows, by[few[own] + k], axis=0, mode="clip")
        sums += np.take(total, place[few], axis=0, mode="clip")
        total[place[few]] = sums
    own = np.flatnonzero(np.repeat(length > TURNS, length))
    if len(own):
        runs = -(-len(own) // RUN)
        held = np.zeros((runs * RUN, rows.shape[1]), rows.dtype)
        np.take(rows, by[own], axis=0, out=held[: len(own)], mode="clip")
        new = np.diff(place[own], prepend=-1) != 0
        new[::RUN] = True
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1  # counts the pairs of a run and a place
        rank = of - np.repeat(of[::RUN], RUN)[: len(of)]
        whose = np.zeros((runs, rank.max() + 1, RUN), rows.dtype)
        i = np.arange(len(own))
        whose[i // RUN, rank, i % RUN] = 1
        sums = whose @ held.reshape(runs, RUN, -1)
        _add_rows(total, place[own[first]], sums[first // RUN, rank[first]])


def _gradient(model):
    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        # by level: observed and expected
        sums = np.zeros((2, 2, m.buckets, m.classes), np.float32)
        for texts in map(byte_texts, batches):
            for i, j in chunks(texts, AT_ONCE):
                own, lengths = tokens(texts[i:j])
                _, _, cls, head = m.find(own)
                features = m.features(own, lengths, cls)
                step = max(16, ADDED // m.classes)
                for at in range(0, len(own), step):
                    part = slice(at, at + step)
                    for level, outcome in enumerate((cls, head)):
                        f = features[level][:, part]
                        p = m.probabilities(level, f, cls[part])
                        for bucket in f:
                            np.add.at(sums[level, 0].reshape(-1), bucket * m.classes + outcome[part], np.float32(1))
                            _add_rows(sums[level, 1], bucket, p)
        rows = sums.reshape(2, 2, -1, BLOCK * m.classes).transpose(0, 2, 1, 3)  # level, block, (observed, expected), weights
        full = [(level, block) for level, block in np.argwhere(rows[:, :, 0].any(2))]
        columns = [pa.array([int(level) << 32 | int(block) for level, block in full], pa.int64()), pa.array([rows[level, block].tobytes() for level, block in full], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "sums"])

    return gradient


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(frame["sums"].iloc[0], np.float32).astype(np.float64)
    for x in frame["sums"].iloc[1:]:
        total += np.frombuffer(x, np.float32)
    return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})


def train(training: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Updates the model's weights, once for each part of the training texts."""
    spark = training.sparkSession
    for part in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        texts = training.filter(F.col("part") == part).select("text").coalesce(spark.sparkContext.defaultParallelism)
        sums = texts.mapInArrow(lean(_gradient(shared)), "block long, sums binary")
        # in two steps, so that no group has a row of every task of a large cluster
        salted = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
        once = salted.groupBy("block", "salt").applyInPandas(lambda _, f: _add(f), "block long, sums binary")
        total = once.groupBy("block").applyInPandas(lambda _, f: _add(f), "block long, sums binary")
        total = stored(total, "lm-gradient").toArrow()  # as many numbers as the model has weights
        for at, sums_ in zip(total["block"].to_pylist(), total["sums"].to_pylist()):
            level, rows = at >> 32, slice((at & 0xFFFFFFFF) * BLOCK, (at & 0xFFFFFFFF) * BLOCK + BLOCK)
            observed, expected = np.frombuffer(sums_, np.float32).reshape(2, -1, model.classes)
            # the smoothing is spread over outcomes as the feature expects them
            mean = SMOOTH * (expected + 1e-3) / (expected.sum(1, keepdims=True) + 1e-3 * model.classes)
            moved = model.weights[level][rows] + STEP * np.log((observed + mean) / (expected + mean))
            model.weights[level][rows] = np.clip(moved, -LIMIT, LIMIT)
        shared.unpersist()
    return model


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>"


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            texts = byte_texts(batch)
            columns: list[list] = [[], [], [], [], []]
            for i, j in chunks(texts, AT_ONCE):
                own, lengths = tokens(texts[i:j])
                known, count, cls, head = m.find(own)
                features = m.features(own, lengths, cls)
                logs = m.log_probability(0, features[0], cls, cls) + m.log_probability(1, features[1], cls, head)
                frequency = np.where(known, np.log10(count + 0.5), 0)  # of others it is added when their counts are known
                logs += np.where((head == m.other) & (cls > 0), frequency - m.among[cls], 0)
                seen = known | (cls == 0)
                first = np.cumsum(lengths) - lengths
                rare = np.add.reduceat(~seen, first, dtype=np.int64)
                for column, x in zip(columns, (lengths, np.add.reduceat(known, first, dtype=np.int64), np.add.reduceat(frequency, first), np.add.reduceat(logs, first))):
                    column.append(x)
                columns[4].append((rare, own[~seen].view(np.int64)))
            if texts:
                n = np.concatenate([r for r, _ in columns[4]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate([h for _, h in columns[4]])))
                arrays = [batch.column("id"), batch.column("held_out"), *(pa.array(np.concatenate(x)) for x in columns[:4]), lists]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _SCORED.split(", ")])

    return score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, rounds: int = ROUNDS) -> tuple[Model, DataFrame, dict]:
    """(the trained model, the table of counts, totals of tokens) from the rows that are not held out."""
    small_batches(docs.sparkSession)
    training = docs.filter(~held_out(F.col(id_col))).select(
        F.col(text_col).cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(rounds)).alias("part")
    )
    counts = token_counts(training)
    n, v, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("h") == 0, F.col("n")))).first()
    n, v, ends = n or 0, v or 0, ends or 0
    classes, buckets = shape(v)
    by_class = counts.withColumn("cls", class_of(F.col("h"), classes))
    sums = by_class.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # a row for each class
    order = Window.partitionBy("cls").orderBy(F.desc("n"), "h")
    heads = by_class.withColumn("head", F.row_number().over(order) - 1).filter(F.col("head") < classes - 1).select("h", "n", "head").toPandas()
    often = counts.orderBy(F.desc("n"), "h").limit(top).toPandas()  # bounded, as the heads are
    words = pd.concat([heads, often.assign(head=-1)]).drop_duplicates("h")
    model = train(training, Model(words, sums, classes, buckets), rounds)
    return model, counts, {"n": n, "v": v, "ends": ends}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    model, counts, total = fit(docs, id_col, text_col, top, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = keyed_texts(docs, id_col, text_col, held_out(F.col(id_col)).alias("held_out"))
    scored = stored(rows.mapInArrow(lean(_scorer(shared)), _SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("h")).join(counts, "h", "left")
    of_row = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.count("n").alias("rare_known"))
    joined = scored.drop("rare").join(of_row, "row", "left").na.fill(0, ["rare_log", "rare_known"])
    all_tokens = float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    end = 0.0 if total["ends"] else float(np.log10(0.5))  # without training texts the end is no word of the model
    base = F.col("base") + F.col("rare_log") + F.lit(end) - F.col("n_tokens") * F.lit(all_tokens)
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("model") + F.col("rare_log")).alias("score"),
    )
