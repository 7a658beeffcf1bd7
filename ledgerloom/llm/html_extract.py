"""Main text of web pages: a bidirectional LSTM labels every block of a page with the whole page in view.

A page is cut into leaf blocks at block-level tags.  A block's tag path (elements, words of their classes, ids and roles)
and its words are hashed to vectors; the recurrent labeller reads a page's blocks from both ends and says of each whether
it is main text.  Nothing is decided by a rule: only what is never shown as text (scripts, styles, comments, titles,
templates) is no block at all.

The model is fitted on the driver: at most SAMPLE pages of the table of at most SAMPLE_CHARS characters (by the
hashes of id and url), labelled by the elements of HTML that say what they hold (article and main on one side;
nav, header, footer, aside, form and telling classes on the other), and LAYOUTS made-up pages in many layouts over the same words.

Defined cases: null or empty html and pages without main blocks give empty text; markup without ends, crossed tags, raw
text that looks like tags and stray ``<`` are read as browsers do, about; a very long page is one sequence like any other;
white space is what Unicode says; repeated ids are rows of their own; an empty table returns nothing; further columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import block_labeller as labeller
from .runtime import chunks, lean, slices, small_batches, word_hashes

SAMPLE, SAMPLE_CHARS, SAMPLE_BLOCKS = 150, 20_000, 120
LAYOUTS = 450
THRESHOLD = 0.5

#: Comments, elements whose content is no text of the page, declarations, tags.
_MARKUP = re.compile(
    r"<!--(?:.*?-->|(.*))|<(script|style|title|textarea|template|noscript|iframe)\b[^>]*+>.*?(?:</\2\s*>|(\Z))|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*+>",
    re.S | re.I,
)
_BEGUN = re.compile(r"<[a-zA-Z/!?]")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME_WORDS = re.compile(r"[^\W\d_]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends, if it is open, up to the element that holds it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: What the sample's labels go by.
GOOD = {"article", "main"}
BAD = {"nav", "header", "footer", "aside", "form"}
BAD_NAMES = set("ad ads advert advertisement banner comment comments cookie cookies footer header menu nav navbar navigation notice promo related share sidebar sponsored subscribe newsletter widget".split())


class Paths:
    """Tag paths as a tree: a path is its parent's number and its own names."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.nodes: list[tuple[int, tuple[str, ...]]] = [(-1, ())]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names = (tag, *("." + w.lower() for v in _NAMED.findall(attributes) for w in _NAME_WORDS.findall(v))) if "=" in attributes else (tag,)
        key = (parent, names)
        if key not in self.numbers:
            self.numbers[key] = len(self.nodes)
            self.nodes.append(key)
        return self.numbers[key]

    def names(self, node: int) -> Iterator[str]:
        while node > 0:
            node, own = self.nodes[node]
            yield from own


def leaf_blocks(page: str, paths: Paths) -> list[tuple[str, int, float]]:
    """(text, tag path, share of its characters in links) of every block, in page order."""
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    node, links, linked, at = 0, 0, 0, 0

    def cut() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, node, min(1.0, linked / len(text))))
            pieces.clear()
            linked = 0

    def drop(i: int) -> None:
        """Ends the open elements from the i-th on."""
        nonlocal links
        links -= sum(tag == "a" for tag, _ in stack[i:])
        del stack[i:]

    def put(text: str) -> None:
        nonlocal node, linked
        bare = not text or text.isspace()
        if not bare and not any(p and not p.isspace() for p in pieces):
            node = stack[-1][1] if stack else 0
        if text:
            pieces.append(text)
        if links and not bare:
            linked += len(text)

    end = page.rfind(">") + 1  # no markup ends beyond, so none is looked for there
    for m in _MARKUP.finditer(page, 0, end):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[5]
        if tag is None:
            if m[1] is not None or m[3] is not None:  # it never ends
                at = len(page)
            continue
        tag = tag.lower()
        if tag == "br":
            put(" ")
            continue
        inline = tag in INLINE
        if not inline:
            cut()
        if m[4]:
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == tag:
                    if inline:
                        links -= tag == "a"
                        del stack[i]
                    else:
                        drop(i)
                    break
                if inline and name not in INLINE:
                    break
            continue
        if not inline:
            i = len(stack) - 1
            while i >= 0 and stack[i][0] in INLINE:
                i -= 1
            if i >= 0 and stack[i][0] == "p":
                drop(i)
            if tag in ENDS:
                ended, holders = ENDS[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        drop(i)
                        break
                    if stack[i][0] in holders:
                        break
        if tag not in VOID:
            stack.append((tag, paths.child(stack[-1][1] if stack else 0, tag, m[6])))
            links += tag == "a"
    put(page[at:end] + _BEGUN.split(page[max(at, end) :], maxsplit=1)[0])
    cut()
    return out


def encoded(pages: list[list[tuple[str, int, float]]], paths: Paths) -> labeller.Pages:
    """The blocks as the labeller reads them: every word of every block, whole paths."""
    sizes = np.array([len(p) for p in pages], np.int64)
    flat = [b for p in pages for b in p]
    texts = [b[0].encode("utf-8", "replace") for b in flat]
    node = np.array([b[1] for b in flat], np.int64)
    bucket: dict[str, int] = {}
    owner, part = [0], [0]  # the root has a name too
    for k, (_, names) in enumerate(paths.nodes):
        for name in names:
            if name not in bucket:
                bucket[name] = zlib.crc32(name.encode()) % labeller.PATH_BUCKETS
            owner.append(k)
            part.append(bucket[name])
    blocks, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in chunks(texts):
        hashes, first, _ = word_hashes(b"\n".join(texts[lo:hi]))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[lo : hi - 1]])
        blocks.append(lo + np.searchsorted(starts, first, "right") - 1)
        words.append((hashes >> np.uint64(32)).astype(np.int64) % labeller.WORD_BUCKETS)
    chars = np.array([len(b[0]) for b in flat], np.float32)
    extra = np.stack([np.log1p(chars) / 4 - 1, np.array([b[2] for b in flat], np.float32)], 1) if flat else np.zeros((0, labeller.EXTRA), np.float32)
    return labeller.Pages(sizes, node, np.array([parent for parent, _ in paths.nodes]), (np.array(owner), np.array(part)), np.concatenate(blocks), np.concatenate(words), extra.astype(np.float32))


def known_labels(blocks: list[tuple[str, int, float]], paths: Paths) -> list[bool] | None:
    """Labels by what the page's elements say, None where it has no article or main element."""
    names = [set(paths.names(b[1])) for b in blocks]
    if not any(n & GOOD for n in names):
        return None
    return [bool(n & GOOD) and not n & BAD and not any(x[1:] in BAD_NAMES for x in n if x[0] == ".") for n in names]


def fit(sample: list[str], n_layouts: int = LAYOUTS, seed: int = 0) -> labeller.Weights:
    """The labeller, from pages whose elements say what they hold and from made-up ones."""
    paths = Paths()
    pages, labels, vocabulary = [], [], set()
    for page in sample:
        blocks = leaf_blocks(page, paths)
        vocabulary.update(w for b in blocks[:20] for w in b[0].split()[:50] if len(w) < 20)
        known = known_labels(blocks, paths)
        if known and len(blocks) <= SAMPLE_BLOCKS:
            pages.append(blocks)
            labels += known
    for page, wanted in labeller.layouts(n_layouts, sorted(x for x in vocabulary if "<" not in x and "&" not in x), seed):
        blocks = leaf_blocks(page, paths)
        pages.append(blocks)
        main = set(wanted)
        labels += [b[0] in main for b in blocks]
    return labeller.train(encoded(pages, paths), np.array(labels, np.float32), seed)


def sample_of(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> list[str]:
    """At most SAMPLE pages of at most SAMPLE_CHARS characters, the same ones whatever the order of the rows."""
    by = F.xxhash64(F.col(id_col).cast("string"), F.col(url_col).cast("string"))
    # a share of all rows by their hash first: what tasks send does not grow with their number
    share = min(1.0, 4 * SAMPLE / max(pages.count(), 1))
    short = pages.filter((F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30))) & F.col(html_col).isNotNull() & (F.length(html_col) <= SAMPLE_CHARS))
    rows = short.select(by.alias("by"), F.col(html_col).cast("string").alias("html")).orderBy("by", "html").limit(SAMPLE)
    return [r["html"] for r in rows.collect()]


def labelled(pages: DataFrame, weights: labeller.Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, texts, main): every block of a page and how likely it is main text."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            given = batch.column("html").to_pylist()
            texts = [x or "" for x in given]
            for lo, hi in chunks(texts):
                paths = Paths()
                blocks = [leaf_blocks(x, paths) for x in texts[lo:hi]]
                main = labeller.probabilities(weights, encoded(blocks, paths))
                ends = np.cumsum([0] + [len(b) for b in blocks]).astype(np.int32)
                said = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([b[0] for p in blocks for b in p], pa.string()))
                likely = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(main.astype(np.float32), pa.float32()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), said, likely], names=["page_id", "url", "texts", "main"])

    return rows.mapInArrow(task, "page_id long, url string, texts array<string>, main array<float>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, weights: labeller.Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks): the main blocks of every page, one a line."""
    weights = weights or fit(sample_of(pages, id_col, url_col, html_col))
    rows = labelled(pages, weights, id_col, url_col, html_col)
    kept = F.filter("texts", lambda t, i: F.get("main", i) > threshold)
    return rows.select("page_id", "url", F.array_join(kept, "\n").alias("text"), F.size("texts").cast("long").alias("n_blocks")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks"
    )
