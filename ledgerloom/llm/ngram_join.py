"""N-gram Jaccard self-join by parity sketches.

Sets.  A document's set holds the 64-bit hashes of its distinct runs of ``WORDS`` words.  Documents with equal sets are
one *text*, known by a digest of the set; copies are never compared.

Sketches.  Hashes are XORed into a sketch of blocks, as many as its size band holds elements at most.  A token that two
sets share cancels out of the XOR of their sketches, so at most as many blocks differ as their symmetric difference has
elements; and sets of sizes a <= b with a Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) * (a + b)
elements.  A plain sketch of SKETCH_WORDS * 64 parity bits bounds the difference from below in the same way by its
Hamming distance.

Pigeonhole join.  Of two linked sets' non-empty blocks at most d = (1 - t) / (1 + t) * (a + b) differ, so in whatever
order blocks are ranked, the first c that both have alike are among the first d + c of either.  Each text gives out those
blocks only, in the band of its own size, and in the next lower band if a partner there can be small enough.  A text
of n elements takes c = n // EXTRA + 1, so two linked texts meet in as many blocks as the smaller one's c at least; a
text that meets others in fewer blocks than the c of its smallest admissible partner is linked with nothing and drops
out before any pair is made, whatever passages it shares with others.  Blocks that many texts share rank last, as found
in a sample of texts by digest; the order changes how many candidates there are, never which links are found.

Small sets.  The lowest band has so few blocks that d of them may be all that a set fills, so there (and in all bands
below BLOCK_PERCENT) texts give out the hashes of their elements instead: linked sets share t * n elements at least of
either's n, hence the first c that they share are among the first n - t * n + c of either.  In the bands above, a set
would have to fill fewer than d + c blocks to miss a partner, more than six standard deviations below what it fills.

Candidates.  Texts with an equal block are compared with one another where a block has no more than SMALL texts.  In a
larger group all are compared with one pivot, and again with another while the group is not yet one component; what is
left after PIVOT_ROUNDS is compared across components by longer sketches, each pair once, in tiles of bounded size.  Pairs
whose sizes or sketches differ too much are dropped, all others are verified on their whole sets.

Numbers of links.  Texts that are in one component already need no comparison to name it.  To count their links, the
texts of larger groups are held against all others of their component on their whole sets, in tiles of bounded size.

Defined cases: a text of fewer words than WORDS is one shingle; a null text, an empty one and one without words have an
empty set and are linked with nothing; rows with a null id keep their row but name no component; repeated rows get the
same component; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import byte_texts, chunks, fresh, keyed_texts, lean, mix64, slices, stored, word_hashes

WORDS = 5
PERCENT = 75
#: A band holds sizes up to BAND times its smallest.
BAND = 16
SKETCH_WORDS = 8
#: Bits of a long sketch for each element, rounded up to a power of two.
LONG_BITS = 4
#: One text in SAMPLE tells which blocks are common: those of COMMON or more of these texts, MAX_COMMON at most.
SAMPLE, COMMON, MAX_COMMON = 16, 4, 500_000
#: One element in EXTRA tells how many blocks more than the differing ones a text gives out.
EXTRA = 8
#: Least similarity at which the differing blocks leave enough others alike.
BLOCK_PERCENT = 70
#: Texts of one block that are compared with one another; larger groups go by pivots.
SMALL, PIVOT_ROUNDS = 8, 2
#: Texts of a group that one task holds against as many others, and elements where whole sets are held.
TILE, TILE_ELEMENTS = 1024, 1 << 20
#: An element is frequent where more than one pair of sets in DENSE has it; such columns and other meetings taken at once.
DENSE, COLUMNS, MEETINGS = 128, 2048, 1 << 21

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _run(hashes: np.ndarray, long: int) -> np.ndarray:
    n = len(hashes)
    run = np.full(n - long + 1, np.uint64(long))
    for k in range(long):
        run ^= hashes[k : n - long + 1 + k]
        run *= _MULTIPLIER
        run ^= run >> np.uint64(29)
    return mix64(run)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of words."""
    for i, j in chunks(texts, 1 << 20):
        hashes, place, _ = word_hashes(b" ".join(texts[i:j]))
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        of = np.searchsorted(place, firsts)
        runs = _run(hashes, words) if len(hashes) >= words else hashes[:0]
        for lo, hi in zip(of[:-1].tolist(), of[1:].tolist()):
            if hi - lo >= words:
                s = np.sort(runs[lo : hi - words + 1])
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            else:
                yield _run(hashes[lo:hi], hi - lo) if hi > lo else hashes[:0]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of words; A-Z count as a-z."""
    return next(shingle_sets([text], words))


def digest(s: np.ndarray) -> int:
    """A digest of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([np.sum(s * _SPREAD) + np.uint64(len(s))]))[0].astype(np.int64))


def band_top(n: int) -> int:
    top = BAND
    while n >= top:
        top *= BAND
    return top


def blocks(s: np.ndarray, top: int) -> np.ndarray:
    """Keys of the set's non-empty blocks in a band's sketch: each the place of a block with the XOR of its hashes."""
    place = mix64(s ^ _SPREAD) % np.uint64(top)
    by = np.argsort(place.astype(np.uint16) if top <= 1 << 16 else place, kind="stable")  # short numbers sort in linear time
    place = place[by]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    with np.errstate(over="ignore"):
        return mix64(np.bitwise_xor.reduceat(s[by], first) ^ (place[first] * _MULTIPLIER + np.uint64(top)))


def elements(s: np.ndarray) -> np.ndarray:
    """Keys of the set's elements themselves."""
    return mix64(s ^ _MULTIPLIER)


def sketch(s: np.ndarray, size: int = SKETCH_WORDS) -> np.ndarray:
    """Parity bits: bit h of the sketch tells whether an odd number of hashes falls on it."""
    bits = np.bincount((s % np.uint64(64 * size)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def long_words(n: int) -> int:
    return 1 << max(3, (LONG_BITS * n - 1).bit_length() - 6)


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches of half the length: as bits are places modulo the length, the halves' XOR."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def least_shared(n):
    """Blocks that a text of n elements has in common with each linked text that is no smaller, at least, among those given out."""
    return n // EXTRA + 1


def least_met(n, percent: int = PERCENT):
    """Blocks in which a text of n elements meets any linked text at least: its smallest partner gives out the fewest."""
    return least_shared((n * percent + 99) // 100)


def block_keys(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys that a set gives out, common ones last."""
    n = len(s)
    own, out = band_top(n), []
    # the difference is greatest with the largest partner in the own band, with an equally large one in the lower band
    for top, most in ((own, (100 - percent) * (n + n * 100 // percent) // (100 + percent)), (own // BAND, (100 - percent) * 2 * n // (100 + percent))):
        if top < own and (top < BAND or n * percent >= 100 * top):
            continue  # no partner is as small as that
        if top <= BAND or percent < BLOCK_PERCENT:
            keys, most = elements(s), n - (n * percent + 99) // 100
        else:
            keys = blocks(s, top)
        most += least_shared(n) - 1
        if most + 1 < len(keys):
            rank = keys >> np.uint64(1)
            if len(common):
                at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
                rank |= (common[at] == keys).astype(np.uint64) << np.uint64(63)
            keys = keys[np.argpartition(rank, most)[: most + 1]]
        out.append(keys)
        if percent < BLOCK_PERCENT:
            break  # elements are the same in every band
    return np.concatenate(out)


def _profile(words: int):
    names = ["kind", "id", "digest", "n", *(f"s{k}" for k in range(SKETCH_WORDS))]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, digests, sizes, sketches, keys, owners = [], [], [], [], [], []
            for id_, s in zip(batch.column("id").to_pylist(), shingle_sets(byte_texts(batch), words)):
                ids.append(id_)
                sizes.append(len(s))
                digests.append(digest(s) if len(s) else 0)
                sketches.append(sketch(s))
                if len(s) and digests[-1] % SAMPLE == 0:
                    keys.append(blocks(s, band_top(len(s))) if len(s) >= BAND else elements(s))
                    owners.append(np.full(len(keys[-1]), digests[-1]))
            if ids:
                columns = [np.zeros(len(ids), np.int32), pa.array(ids, pa.int64()), np.array(digests), np.array(sizes), *np.array(sketches).T]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names)
            if keys:
                of = np.concatenate(owners)
                blank = [np.zeros(len(of), np.int64)] * (1 + SKETCH_WORDS)
                columns = [np.ones(len(of), np.int32), np.concatenate(keys).astype(np.int64), of, *blank]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return profile, "kind int, id long, digest long, n long, " + ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))


def profiles(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """((id, digest, n, s0..) of every row, (key, digest) of the sampled texts' blocks)."""
    profile, schema = _profile(words)
    rows = stored(keyed_texts(docs, id_col, text_col).mapInArrow(lean(profile), schema), "ngram-profiles")
    return rows.filter("kind = 0").drop("kind"), rows.filter("kind = 1").select(F.col("id").alias("key"), "digest")


def shared_blocks(docs: DataFrame, sampled: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(key, digest) of every block key that more than one text gave out."""
    often = sampled.distinct().groupBy("key").agg(F.count("*").alias("texts")).filter(F.col("texts") >= COMMON)
    top = often.orderBy(F.desc("texts"), "key").limit(MAX_COMMON).select("key").toArrow()["key"].to_numpy()  # bounded: a ranking
    common = docs.sparkSession.sparkContext.broadcast(np.sort(top.astype(np.uint64)))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()
        for batch in slices(batches):
            keys, owners, now = [], [], set()
            for s in shingle_sets(byte_texts(batch), words):
                if len(s):
                    own = digest(s)
                    if own not in last and own not in now:  # copies that lie near one another give keys once
                        keys.append(block_keys(s, common.value, percent))
                        owners.append(np.full(len(keys[-1]), own))
                    now.add(own)
            last = now
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(owners))], ["key", "digest"])

    given = keyed_texts(docs, id_col, text_col).mapInArrow(lean(give), "key long, digest long")
    w = Window.partitionBy("key")
    met = given.select("key", "digest", F.min("digest").over(w).alias("least"), F.max("digest").over(w).alias("most")).filter("least != most")
    return stored(met.select("key", "digest").distinct(), "ngram-met")


def promising(met: DataFrame, info: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, digest, texts, pivot) of the blocks of texts that meet others often enough."""
    often = met.groupBy("digest").agg(F.count("*").alias("met")).join(info.select("digest", "n"), "digest")
    often = often.filter(f"met >= (n * {percent} + 99) div 100 div {EXTRA} + 1")  # least_met
    kept = met.join(often.select("digest"), "digest").select("key", "digest")
    # counted before the shuffle and joined back, so that Spark can split a block that a large group of texts shares
    blocks_ = kept.groupBy("key").agg(F.count("*").alias("texts"), F.min("digest").alias("pivot")).filter("texts > 1")
    return stored(kept.join(blocks_, "key"), "ngram-blocks")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _plausible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    of = lambda p: info.select(F.col("digest").alias(p), F.col("n").alias(f"{p}_n"), *(F.col(f"s{k}").alias(f"{p}_{k}") for k in range(SKETCH_WORDS)))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in range(SKETCH_WORDS)))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    near = (100 * small >= percent * large) & ((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n")))
    return both.filter(near).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in slices(batches, 256):
            good = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            for x, y, tx, ty in zip(a, b, ta, tb):
                for k, t in ((x, tx), (y, ty)):
                    if k not in kept:
                        if len(kept) > 256:
                            kept.clear()
                        kept[k] = shingles(t, words)
                sx = kept[x] if x in kept else shingles(tx, words)
                both = len(np.intersect1d(sx, kept[y], assume_unique=True))
                good.append(100 * both >= percent * (len(sx) + len(kept[y]) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    of = lambda p: texts.select(F.col("digest").alias(p), F.col("text").alias(f"text_{p}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(verify), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    Each round hangs every node on the smallest node that it or its neighbours hang on and looks that one up in turn, so
    a chain's length falls by half; only the number of changes reaches the driver.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "component-edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "component-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        down = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        # the label's own label
        own = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = down.join(own, "next", "left").select("node", "component", F.least("next", "further").alias("new"))
        moved = stored(moved, "component-labels")
        labels = moved.select("node", F.col("new").alias("component"))
        if moved.filter("new != component").isEmpty():
            return labels


def _across(open_: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of texts from different components of one group that may be linked, by their long sketches.

    Groups that share a text are taken as one, so that a pair is looked at once and not for each block that it shares.
    The texts that are not in a group's largest component are held against all texts of the group, in tiles of TILE by
    TILE texts, each in a task of its own.
    """
    edges = open_.select(F.col("digest").alias("a"), F.col("pivot.digest").alias("b")).filter("a != b").distinct()
    groups = components(edges).select(F.col("node").alias("digest"), F.col("component").alias("group"))
    of_group = groups.join(open_.select("digest", "component").distinct(), "digest").join(texts, "digest")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = list(shingle_sets(byte_texts(batch), words))
            n, bits = pa.array([len(s) for s in own], pa.int64()), pa.array([sketch(s, long_words(len(s))).tobytes() for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "digest", "component")), n, bits], ["group", "digest", "component", "n", "bits"])

    members = of_group.select("group", "digest", "component", "text").mapInArrow(lean(describe), "group long, digest long, component long, n long, bits binary")
    members = stored(members, "ngram-members")
    counts = members.groupBy("group", "component").agg(F.count("*").alias("size"))
    groups = counts.groupBy("group").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.ceil(F.sum("size") / TILE).cast("int").alias("tiles"))
    placed = members.join(groups, "group").withColumn("tile", F.pmod(F.xxhash64("digest"), "tiles").cast("int"))
    tiles = F.explode(F.expr("sequence(0, tiles - 1)"))
    asked = placed.filter("component != main").select("group", F.col("tile").alias("i"), tiles.alias("j"), "digest", "component", "n", "bits")
    again = [F.col(c).alias(c) for c in ("group", "digest", "component", "n", "bits")]  # columns of their own for the cogroup
    against = placed.select(*again, F.col("tile").alias("j"), tiles.alias("i"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n, component, digests = (y[c].to_numpy() for c in ("n", "component", "digest"))
        sketches = y["bits"].to_pylist()
        words_of = np.array([len(b) // 8 for b in sketches], np.int64)
        classes = {}  # sketches by length, with their halves: linked texts' lengths differ by a factor of two at most
        for w in np.unique(words_of):
            at = np.flatnonzero(words_of == w)
            bits = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), w)
            classes[w] = at, {w: bits, w // 2: folded(bits)}
        for own, size, mine, b in zip(*(x[c].to_pylist() for c in ("digest", "n", "component", "bits"))):
            mine_bits = np.frombuffer(b, np.uint64)
            short = folded(mine_bits)
            for w, (at, forms) in classes.items():
                sketch_, shape = (mine_bits, len(mine_bits)) if len(mine_bits) in forms else (short, len(short))
                if shape not in forms:
                    continue
                fits = np.flatnonzero((component[at] != mine) & (100 * np.minimum(n[at], size) >= percent * np.maximum(n[at], size)))
                apart = np.bitwise_count(forms[shape][fits] ^ sketch_).sum(1, dtype=np.int64)
                near = at[fits[(100 + percent) * apart <= (100 - percent) * (n[at[fits]] + size)]]
                first.append(np.minimum(digests[near], own))
                second.append(np.maximum(digests[near], own))
        return pa.table({"a": np.concatenate(first), "b": np.concatenate(second)})

    return asked.groupBy("group", "i", "j").cogroup(against.groupBy("group", "i", "j")).applyInArrow(compare, "a long, b long")


def shared_elements(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many elements each set of x has in common with each of y; x and y hold the sets one after another, n and m
    their sizes.  Elements that many sets have are counted by a product of matrices, all others one meeting at a time."""
    values, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    of_x, of_y = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
    x, y = code[: len(x)], code[len(x) :]
    in_x, in_y = (np.bincount(c, minlength=len(values)) for c in (x, y))
    both = np.zeros((len(n), len(m)), np.float32)
    frequent = in_x * in_y > both.size // DENSE
    place = np.cumsum(frequent) - 1
    for lo in range(0, int(frequent.sum()), COLUMNS):
        sides = []
        for c, owner, rows in ((x, of_x, len(n)), (y, of_y, len(m))):
            at = np.flatnonzero(frequent[c] & (place[c] >= lo) & (place[c] < lo + COLUMNS))
            side = np.zeros((rows, COLUMNS), np.float32)
            side[owner[at], place[c[at]] - lo] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    both = both.astype(np.int64)
    by = np.argsort(y, kind="stable")
    of_y, first = of_y[by], np.cumsum(in_y) - in_y
    rare = np.flatnonzero(~frequent[x] & (in_y[x] > 0))
    upto = np.cumsum(in_y[x[rare]])
    for lo, hi in pairwise(np.searchsorted(upto, [*range(0, int(upto[-1]) if len(upto) else 0, MEETINGS), 1 << 62])):
        runs = in_y[x[rare[lo:hi]]]
        met = np.repeat(first[x[rare[lo:hi]]] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        both += np.bincount(np.repeat(of_x[rare[lo:hi]], runs) * len(m) + of_y[met], minlength=both.size).reshape(both.shape)
    return both


def _links_inside(large: DataFrame, labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(digest, n_links) of the texts of larger groups: how many others of them in their component each is linked with."""
    own = labels.withColumnRenamed("node", "digest").join(large.select("digest").distinct(), "digest")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = list(shingle_sets(byte_texts(batch), words))
            n, whole = pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("digest"), n, whole], ["component", "digest", "n", "elements"])

    members = own.join(texts, "digest").select("component", "digest", "text").mapInArrow(lean(describe), "component long, digest long, n long, elements binary")
    members = stored(members, "ngram-members")
    most = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_ELEMENTS)).cast("int")
    placed = members.join(members.groupBy("component").agg(most.alias("tiles")), "component").withColumn("tile", F.pmod(F.xxhash64("digest"), "tiles").cast("int"))
    columns = [F.col(c).alias(c) for c in ("component", "digest", "n", "elements")]
    asked = placed.select(*columns, F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"))
    against = placed.select(*columns, F.col("tile").alias("j"), F.explode(F.expr("sequence(0, tile)")).alias("i"))

    def count(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        n, m = x["n"].to_numpy(), y["n"].to_numpy()
        both = shared_elements(*(np.frombuffer(b"".join(t["elements"].to_pylist()), np.uint64) for t in (x, y)), n, m)
        good = (100 + percent) * both >= percent * (n[:, None] + m)
        if key[1].as_py() == key[2].as_py():
            return pa.table({"digest": x["digest"].to_numpy(), "n_links": good.sum(1) - 1})  # but itself
        return pa.table({"digest": np.concatenate([x["digest"].to_numpy(), y["digest"].to_numpy()]), "n_links": np.concatenate([good.sum(1), good.sum(0)])})

    return asked.groupBy("component", "i", "j").cogroup(against.groupBy("component", "i", "j")).applyInArrow(count, "digest long, n_links long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, counted: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; n_links counts all other texts that the row's is linked
    with, and is left out unless counted."""
    rows, sampled = profiles(docs, id_col, text_col, words)
    info = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), *(F.first(f"s{k}").alias(f"s{k}") for k in range(SKETCH_WORDS)))
    met = promising(shared_blocks(docs, sampled, id_col, text_col, words, percent), info, percent)

    # texts that may be linked at all, each read from one of its documents
    wanted = met.select("digest").distinct().join(info.select("digest", "id", "n"), "digest")
    source = keyed_texts(docs, id_col, text_col)
    texts = _texts(source, wanted, words)

    small = met.filter(F.col("texts") <= SMALL).select("key", "digest")
    all_small = small.join(small.withColumnRenamed("digest", "other"), "key").filter("digest < other").select(*_pair(F.col("digest"), F.col("other")))
    star = met.filter((F.col("texts") > SMALL) & (F.col("digest") != F.col("pivot"))).select(*_pair(F.col("digest"), F.col("pivot")))
    pairs = stored(_plausible(all_small.union(star).distinct(), info, percent), "ngram-pairs")
    links = stored(_verified(pairs, texts, words, percent), "ngram-links")
    large = met.filter(F.col("texts") > SMALL).select("key", "digest")
    labels = components(links)
    if not large.isEmpty():
        for turn in range(PIVOT_ROUNDS + 1):
            labelled = large.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
            split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("digest", "component"), F.xxhash64("digest", F.lit(turn))).alias("pivot")).filter("low != high")
            open_ = stored(labelled.join(split.select("key", "pivot"), "key"), "ngram-open")
            if open_.isEmpty():
                break
            if turn < PIVOT_ROUNDS:
                new = open_.filter(F.col("component") != F.col("pivot.component")).select(*_pair(F.col("digest"), F.col("pivot.digest")))
                new = _plausible(new.distinct(), info, percent)
            else:
                new = _across(open_, texts, words, percent).distinct()
            new = stored(new.join(pairs, ["a", "b"], "left_anti"), "ngram-pairs")
            pairs = pairs.unionByName(new)
            more = stored(_verified(new, texts, words, percent), "ngram-links")
            links = links.unionByName(more)
            if not more.isEmpty():
                labels = components(links)

    firsts = info.select("digest", "id").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    firsts = firsts.withColumn("component", F.coalesce("component", "digest"))
    smallest = firsts.groupBy("component").agg(F.min("id").alias("component_id"))
    named = firsts.join(smallest, "component").select("digest", "component_id")
    if counted:
        # all pairs were compared but those within one component whose texts both are in a larger block
        inside = large.select("digest").distinct()
        left = links.join(inside.select(F.col("digest").alias("a"), F.lit(True).alias("_a")), "a", "left").join(inside.select(F.col("digest").alias("b"), F.lit(True).alias("_b")), "b", "left")
        left = left.filter("_a is null or _b is null")
        ends = left.select(F.col("a").alias("digest"), F.lit(1).cast("long").alias("n_links")).union(left.select("b", F.lit(1).cast("long")))
        degree = ends.union(_links_inside(large, labels, texts, words, percent)).groupBy("digest").agg(F.sum("n_links").alias("n_links"))
        named = named.join(degree, "digest", "left")
    out = rows.select("id", "digest", "n").join(named, "digest", "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    links_ = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if counted else []
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), *links_)


def _texts(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(digest, text) of the wanted texts; as ids may repeat, each text is held against its digest."""
    read = source.join(wanted.select("id").distinct().withColumnRenamed("id", "wanted_id"), F.col("id").eqNullSafe(F.col("wanted_id"))).select("text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests = [digest(s) if len(s) else 0 for s in shingle_sets(byte_texts(batch), words)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), batch.column("text")], ["digest", "text"])

    named = read.mapInArrow(lean(name), "digest long, text binary").join(wanted.select("digest"), "digest")
    return stored(named.dropDuplicates(["digest"]), "ngram-texts")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but those of which a linked document has a smaller id, with all columns of docs.

    Rows that are equal in id and text are copies of one another, and one of them stays; rows without an id stay.
    """
    found = stored(classes(docs, id_col, text_col, counted=False), "ngram-classes")
    name = fresh("gone", docs)
    gone = found.filter("component_id is not null and doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    same = F.col(id_col).cast("long") == F.col(name)
    kept = docs.join(gone, same, "left_anti")
    again = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(name))
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, same, "left_anti").unionByName(once)
