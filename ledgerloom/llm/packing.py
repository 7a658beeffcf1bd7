"""Packing token ids into windows by best-fit decreasing.

Texts are tokenized where they are read.  As the tokenizer drops white space and never joins what stands on both sides
of it, a text's ids are those of its white-space runs one after another; each task keeps the ids of runs it has met, so
most runs cost a look-up, and the tokenizer itself gets only new ones.  A document's ids and the closing id are cut into
full windows, each a sequence of its own, and a remainder.  Remainders are dealt by a hash into groups of about
GROUP_PIECES, so no document, source or length makes a group large, and each group is packed alone: pieces in falling
length, each into the open window with the least room that still holds it.  A segment tree over the rooms finds that
window: it is indexed by remaining capacity and counts the open windows of each.

A sequence is padded to a full window, except where its ids are a power of two.

Defined cases: a null or empty text is its closing id alone; repeated rows and repeated ids are packed row by row; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import byte_texts, chunks, keyed_texts, lean, stored

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces in a packing group, about.
GROUP_PIECES = 8192
#: Runs of letters that are encoded together.
TOGETHER = 128
#: White-space runs whose ids a task keeps, and the length up to which they are kept.
MAX_KEPT, MAX_RUN = 500_000, 64
#: Bytes of text that are encoded together.
AT_ONCE = 1 << 20
_MARK = re.compile(rb"(?<=[A-Za-z])([.,])(?=[ \n])")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RunTokenizer:
    """Ids of whole texts, from the ids of their white-space runs."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run.

        Runs of letters are encoded many at a time, as their last id marks the end of a word and no other does; where
        the number of ends is not that of the runs, each is encoded by itself.
        """
        texts = [r.decode("utf-8", "replace") for r in runs]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        out = [b""] * len(runs)
        groups = [letters[k : k + TOGETHER] for k in range(0, len(letters), TOGETHER)]
        for group, ids in zip(groups, self._each([" ".join([texts[i] for i in g]) for g in groups])):
            last = np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)])
            if len(last) == len(group):
                cuts = [0, *(4 * (last + 1)).tolist()]
                for i, x, y in zip(group, cuts, cuts[1:]):
                    out[i] = ids[x:y]
            else:
                for i, own in zip(group, self._each([texts[i] for i in group])):
                    out[i] = own
        others = [i for i, t in enumerate(texts) if not t.isalpha()]
        for i, own in zip(others, self._each([texts[i] for i in others])):
            out[i] = own
        return out

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers, without the closing id."""
        for i, j in chunks(texts, AT_ONCE):
            runs = [_plain(t).split() for t in texts[i:j]]
            kept = self.kept
            here = set().union(*runs)
            new = [r for r in here if r not in kept]
            if len(kept) + len(new) > MAX_KEPT:
                kept.clear()
                new = list(here)
            kept.update(zip(new, self._encode(new)))
            for own in runs:
                yield b"".join([kept[r] for r in own])
            for r in new:
                if len(r) > MAX_RUN:
                    del kept[r]


def _plain(text: bytes) -> bytes:
    """The text with fewer different runs and the same ids: the tokenizer ignores case, and takes a full stop or comma
    after a word as a token by itself.  A special token or a combining mark could make a difference: such texts stay."""
    if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
        return text
    return _MARK.sub(rb" \1", text.lower())


def cut(ids: bytes, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: full windows, then the remainder."""
    size = 4 * window
    return [(at // 4, min(size, len(ids) - at) // 4, zlib.crc32(ids[at : at + size])) for at in range(0, len(ids), size)]


_PIECE = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens): a row for each piece; row tells equal pieces apart."""
    end = np.array([END_ID], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RunTokenizer(tokenizer)
        row = 0
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("id").to_pylist(), encoder.ids(byte_texts(batch))):
                ids += end
                out += [(doc_id, row, *piece, len(ids) // 4) for piece in cut(ids, window)]
                row += 1
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _PIECE.split(", ")])

    return keyed_texts(docs, id_col, text_col).mapInArrow(lean(split), _PIECE)


class RoomTree:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for ``least``, which is taken out."""
        at = self.size + least
        if not self.count[at]:
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece; the lengths fall, and none is longer than a window."""
    tree, sequences, offsets, opened = RoomTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        room, at = found if found else (window, opened)
        opened += found is None
        sequences.append(at)
        offsets.append(window - room)
        if room > n:
            tree.add(room - n, at)
    return sequences, offsets


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Every piece with its sequence and its offset there, and how long the padded sequence is."""
    cuts = stored(pieces(docs, id_col, text_col, window, tokenizer), "pieces")  # numbers only; texts are tokenized once
    groups = max(1, cuts.count() // GROUP_PIECES)
    group = F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "row"), F.lit(groups))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True], kind="stable")
        number, offset = best_fit(group["length"].tolist(), window)
        used = np.bincount(number, group["length"])[number].astype(np.int64)
        out = group.assign(sequence_id=(group["group"].to_numpy() << 32) + np.array(number), offset=offset)
        return out.assign(sequence_length=np.where(used & (used - 1) == 0, used, window)).drop(columns=["group", "row"])

    packed = cuts.withColumn("group", group).groupBy("group").applyInPandas(fill, _PACKED + ", sequence_length long")
    return packed
