"""URL filters: a sorted digest array that tasks map into memory and probe with vectorised binary search.

A rule is a host and the start of a path with a verdict.  Its key is the 64-bit xxhash of ``host/path``; the keys are
kept ascending in one file, beside it the rules' full strings, and Spark ships both to every executor, whose tasks map
them into memory.  A URL is probed with every suffix of its host and every start of its path that is as long as some
rule's path, none at all for rules of a host alone; a digest that is found counts only if the stored string is the probed one, so collisions do no harm.  The
longest rule wins.  A URL that no rule fits is blocked if it names no host or its host has a word of BLOCK_WORDS
between dots and hyphens (such words are keys of the same array), and else gets ``default``.

The rules are shipped to all executors, so their number is bounded: beyond MAX_SHIPPED the same probes are joined with
the table of rules by digest, and no file is made.

Defined cases: a null URL and one without ``://`` have an empty host and path and are blocked unless a rule fits; of
equal rules with two verdicts, block wins; repeated rows are judged one by one; other columns are never read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import small_batches

Rule = tuple[str, str, str]  # host, start of the path, verdict

# The rules that results are held to.
RULES: tuple[Rule, ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words that mark a host as one to block where no rule fits.
BLOCK_WORDS = ("adult", "ads", "bets", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: Rules that are shipped to the executors at most.
MAX_SHIPPED = 1_000_000
DEFAULT = "allow"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_url(url: str | None) -> tuple[bytes, bytes]:
    """(host with A-Z lower-cased, path) of a URL, both empty without ``://``."""
    if not url or "://" not in url:
        return b"", b""
    rest = url.split("://", 1)[1].encode()
    end = min((i for i in (rest.find(c) for c in b"/?#") if i >= 0), default=len(rest))
    tail = rest[end:].split(b"?", 1)[0].split(b"#", 1)[0]
    return rest[:end].translate(_LOWER), tail


def _suffixes(host: bytes) -> Iterator[bytes]:
    while True:
        yield host
        _, dot, host = host.partition(b".")
        if not dot:
            break


class DigestArray:
    """One file: how many, the ascending digests, the place of each one's string, the lengths of rules' paths, a byte of
    verdict for each rule, and the strings one after another.  Opening it maps it into memory and reads nothing."""

    def __init__(self, path: str):
        n, size, kinds = (int(x) for x in np.fromfile(path, np.int64, 3))
        part = lambda kind, at, count: np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind)
        self.digests = part(np.uint64, 24, n)
        self.places = part(np.int64, 24 + 8 * n, n + 1)
        self.lengths = part(np.int64, 32 + 16 * n, kinds).tolist()
        self.blocks = part(np.uint8, 32 + 16 * n + 8 * kinds, n)
        self.strings = part(np.uint8, 32 + 17 * n + 8 * kinds, size)

    @staticmethod
    def write(rules: Iterable[Rule], path: str) -> None:
        merged: dict[bytes, bool] = {}
        lengths = set()
        for host, start, verdict in rules:
            key = host.encode().translate(_LOWER) + start.encode()
            merged[key] = merged.get(key, False) or verdict == "block"
            if not host.startswith("#"):  # words are no starts of URLs
                lengths.add(len(start.encode()))
        keys = sorted(merged, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        strings = b"".join(keys)
        with open(path, "wb") as out:
            for x in (
                np.array([len(keys), len(strings), len(lengths)], np.int64),
                np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64),
                np.cumsum([0] + [len(k) for k in keys], dtype=np.int64),
                np.array(sorted(lengths), np.int64),
                np.array([merged[k] for k in keys], np.uint8),
            ):
                out.write(x.tobytes())
            out.write(strings)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key in the array, -1 where it is not stored."""
        found = np.full(len(keys), -1)
        if not len(self.digests):
            return found
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, wanted)
        same = self.digests[np.minimum(at, len(self.digests) - 1)] == wanted
        for i in np.flatnonzero(same):
            j = at[i]
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # colliding digests lie side by side
                if self.strings[self.places[j] : self.places[j + 1]].tobytes() == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found


def _probes(host: bytes, path: bytes, lengths: list[int]) -> Iterator[bytes]:
    """The keys that rules for this URL can have, longest first."""
    for suffix in _suffixes(host):
        for n in reversed(lengths):
            if n <= len(path):
                yield suffix + path[:n]


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; rules: (host, path, verdict), RULES if none are given."""
    spark = pages.sparkSession
    given: Iterable[Rule] = RULES
    words = [(f"#{w}", "", "block") for w in BLOCK_WORDS]  # no host holds a number sign
    if rules is not None:
        rules = rules.select("host", "path", "verdict")
        if rules.limit(MAX_SHIPPED + 1).count() > MAX_SHIPPED:
            return _joined(pages, rules, id_col, url_col, default)
        given = zip(*(c.to_pylist() for c in rules.toArrow().columns))  # MAX_SHIPPED rows at most
    name = _ship(spark, [*given, *words])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            rows = [split_url(u) for u in batch.column("url").to_pylist()]
            keys, first = [], []
            for host, path in rows:
                first.append(len(keys))
                keys.extend(_probes(host, path, array.lengths))
            found = array.find(keys)
            marks = [(i, b"#" + w) for i, (host, _) in enumerate(rows) for w in host.replace(b"-", b".").split(b".")]
            marked = {marks[k][0] for k in np.flatnonzero(array.find([m for _, m in marks]) >= 0)}
            hits = np.flatnonzero(found >= 0)
            nearest = np.searchsorted(hits, first + [len(keys)])
            rule, verdict = [], []
            for i, (host, _) in enumerate(rows):
                own = hits[nearest[i] : nearest[i + 1]]
                if len(own):
                    best = max(own, key=lambda k: len(keys[k]))
                    rule.append(keys[best].decode())
                    verdict.append("block" if array.blocks[found[best]] else "allow")
                else:
                    rule.append(None)
                    verdict.append("block" if not host or i in marked else default)
            columns = [batch.column("id"), *(pa.array([r[k].decode() for r in rows], pa.string()) for k in (0, 1)), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    small_batches(spark)
    wanted = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    return wanted.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _ship(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Hands the array's file to Spark, whose driver serves a copy to every executor; its name there."""
    top = tempfile.mkdtemp(prefix="ledgerloom-rules-")
    atexit.register(shutil.rmtree, top, ignore_errors=True)  # executors may ask for it until the end
    path = f"{top}/digests-{uuid.uuid4().hex}"
    DigestArray.write(rules, path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _joined(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    """The same for any number of rules: probes and rules meet by their strings."""
    url = F.col("url")
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.select(F.concat(lower, "path").alias("rule"), F.length("path").alias("n"), "verdict").groupBy("rule").agg(F.max("verdict").alias("verdict"), F.first("n").alias("n"))
    lengths = [r[0] for r in known.select("n").distinct().collect()]  # path lengths, not rules
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")).select(
        "page_id", F.monotonically_increasing_id().alias("row"), host.alias("host"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path")
    )
    starts = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(n <= F.length("path"), F.substring(F.col("path"), F.lit(1), n)))
    probes = rows.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(F.array_compact(starts)))
    hits = probes.withColumn("rule", F.concat("suffix", "start")).join(known, "rule")
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(F.desc(F.length("rule"))))).filter("k = 1")
    judged = rows.join(best.select("row", "rule", F.col("verdict").alias("given")), "row", "left")
    marked = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, BLOCK_WORDS)))
    verdict = F.coalesce("given", F.when((F.col("host") == "") | marked, "block").otherwise(default))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: The query's rows by SQL.
SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
  max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  coalesce(max_by(rule_verdict, length(rule_host || rule_path)), CASE WHEN host = '' OR list_has_any(string_split(replace(host, '-', '.'), '.'), [
    'adult', 'ads', 'bets', 'casino', 'gambling', 'malware', 'phishing', 'pills', 'poker', 'porn', 'spam', 'viagra', 'warez', 'xxx'])
    THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path
"""
