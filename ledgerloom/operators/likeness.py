"""Token-set likeness of names, for many pairs at once.

Two names are alike by the best of three: their common words with the words of either one alone, held against each other,
and the common words against each of these.  Edits are deletions and insertions; a name whose words are all in the other
has likeness 1, a name without words 0.
"""

from __future__ import annotations

import numpy as np

#: Longest side in characters, and most words, that the vectorised form takes; others are compared one by one.
WORD_BITS = 64
#: Pairs times words times words that are compared at once.
AT_ONCE = 1 << 24


def common_length(a: str, b: str) -> int:
    """Characters of the longest common subsequence, by bits of the pattern (Hyyrö's recurrence)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def of_pair(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 1.0
    both, one, two = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    return float(_best(*(np.array([len(w)]) for w in (both, one, two)), np.array([common_length(one, two)]))[0])


def _best(both: np.ndarray, one: np.ndarray, two: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """By the lengths of the common words and of each side's own, and of what these have in common."""
    gap = (both > 0).astype(np.int64)
    long = 2 * (both + gap) + one + two
    best = 1 - (one + two - 2 * shared) / np.maximum(long, 1)
    for own in (one, two):
        with_own = 1 - (gap + own) / np.maximum(2 * both + gap + own, 1)
        best = np.maximum(best, np.where(both > 0, with_own, 0.0))
    return best


class Names:
    """Names as their sorted words: numbers of the words, lengths, and the characters of any part of a name."""

    def __init__(self, names: list[str], numbers: dict[str, int], alphabet: dict[str, int]) -> None:
        self.names = names
        self.words = [sorted(set(n.split())) for n in names]
        most = max(map(len, self.words), default=0)
        self.ids = np.full((len(names), most), -1, np.int64)
        self.size = np.zeros((len(names), most), np.int64)
        for k, own in enumerate(self.words):
            self.ids[k, : len(own)] = [numbers.setdefault(w, len(numbers)) for w in own]
            self.size[k, : len(own)] = [len(w) for w in own]
        self.count = np.array([len(w) for w in self.words], np.int64)
        self.length = self.size.sum(1) + np.maximum(self.count - 1, 0)
        self.alphabet = alphabet
        self.bags = np.zeros((len(names), 2), np.uint64)
        for k, own in enumerate(self.words):
            seen: dict[str, int] = {}
            for c in " ".join(own):
                seen[c] = seen.get(c, 0) + 1
                # a bit for a character's first, second and third place: bits that differ are edits that no order saves
                if c != " " and seen[c] <= 3:
                    bit = 3 * (alphabet.setdefault(c, len(alphabet)) % 42) + seen[c] - 1
                    self.bags[k, bit >> 6] |= np.uint64(1 << (bit & 63))

    def parts(self, rows: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(the number of each pair's part, the parts): a name's words that are not in the mask."""
        keys, first, which = np.unique(np.stack([rows.astype(np.uint64), masks]), axis=1, return_index=True, return_inverse=True)
        texts = [" ".join(w for i, w in enumerate(self.words[rows[f]]) if not int(masks[f]) >> i & 1) for f in first]
        return which.ravel(), texts


def most_alike(a: Names, b: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound that no pair's likeness exceeds, where neither name's words are all in the other."""
    apart = np.bitwise_count(a.bags[i] ^ b.bags[j]).sum(1).astype(np.int64)
    return 1 - apart / np.maximum(a.length[i] + b.length[j], 1)


def bounds(a: Names, b: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What the likeness of each of the names i of a with each of the names j of b does not exceed: the bound from the letters,
    or what the common words alone give, which takes no look at a pair."""
    one, two = a.length[i].astype(np.float32), b.length[j].astype(np.float32)
    apart = sum(np.bitwise_count(a.bags[i, k][:, None] ^ b.bags[j, k][None, :]) for k in (0, 1))
    out = 1 - apart / np.maximum(one[:, None] + two[None, :], 1)
    both = np.full(out.shape, -1, np.float32)  # characters of the common words and the gaps between them
    (wa, ra), (wb, rb) = (_by_word(n, k) for n, k in ((a, i), (b, j)))
    for w in np.intersect1d(wa, wb):
        (x0, x1), (y0, y1) = (np.searchsorted(v, (w, w + 1)) for v in (wa, wb))
        at = ra[x0]
        both[np.ix_(ra[x0:x1], rb[y0:y1])] += 1 + a.size[i[at], np.flatnonzero(a.ids[i[at]] == w)[0]]
    both[:, two == 0] = both[one == 0] = -1
    return np.maximum(out, np.where(both > 0, 2 * both / np.maximum(np.minimum(one[:, None], two[None, :]) + both, 1), 0))


def _by_word(names: Names, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words in order, which of the rows has it)."""
    ids = names.ids[rows]
    at = np.nonzero(ids >= 0)
    order = np.argsort(ids[at], kind="stable")
    return ids[at][order], at[0][order]


def of_pairs(a: Names, b: Names, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
    """The likeness of names i of a and j of b; what is sure to lie below ``least`` may come back as 0."""
    out = np.zeros(len(i))
    step = max(1, AT_ONCE // max(1, a.ids.shape[1] * b.ids.shape[1]))
    for lo in range(0, len(i), step):
        out[lo : lo + step] = _of_some(a, b, i[lo : lo + step], j[lo : lo + step], least)
    return out


def _of_some(a: Names, b: Names, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    out = np.zeros(len(i))
    if not a.ids.shape[1] or not b.ids.shape[1]:
        return out
    many = (a.count[i] > WORD_BITS) | (b.count[j] > WORD_BITS)
    for k in np.flatnonzero(many):
        out[k] = of_pair(a.names[i[k]], b.names[j[k]])
    at = np.flatnonzero(~many & (a.count[i] > 0) & (b.count[j] > 0))
    i, j = i[at], j[at]
    same = (a.ids[i][:, :, None] == b.ids[j][:, None, :]) & (a.ids[i] >= 0)[:, :, None]
    in_a, in_b = same.any(2), same.any(1)
    common = in_a.sum(1)
    both = (a.size[i] * in_a).sum(1) + np.maximum(common - 1, 0)
    one, two = (n.length[k] - both - (common > 0) for n, k in ((a, i), (b, j)))
    whole = (common == a.count[i]) | (common == b.count[j])
    one, two = np.maximum(one, 0), np.maximum(two, 0)
    score = np.where(whole & (common > 0), 1.0, _best(both, one, two, np.zeros(len(i), np.int64)))  # without the first of the three
    # the first one can only matter where its bound does
    rest = np.flatnonzero(~whole & (most_alike(a, b, i, j) >= max(least, 1e-12)))
    long = rest[(one[rest] > WORD_BITS) & (two[rest] > WORD_BITS)]
    for k in long:
        score[k] = of_pair(a.names[i[k]], b.names[j[k]])
    rest = rest[(one[rest] <= WORD_BITS) | (two[rest] <= WORD_BITS)]
    bits = [np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64) for x in (in_a, in_b)]
    masks = [(x[rest] * w).sum(1, dtype=np.uint64) for x, w in zip((in_a, in_b), bits)]
    (wa, parts_a), (wb, parts_b) = a.parts(i[rest], masks[0]), b.parts(j[rest], masks[1])
    swap = one[rest] > WORD_BITS
    shared = np.zeros(len(rest), np.int64)
    for turned in (False, True):
        mine = np.flatnonzero(swap == turned)
        if len(mine):
            p, t = ((wb, parts_b), (wa, parts_a)) if turned else ((wa, parts_a), (wb, parts_b))
            shared[mine] = _common_lengths(p[1], t[1], p[0][mine], t[0][mine])
    score[rest] = _best(both[rest], one[rest], two[rest], shared)
    out[at] = score
    return out


def _common_lengths(patterns: list[str], texts: list[str], p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """common_length of patterns p, of WORD_BITS characters at most, and texts t, all pairs in step."""
    alphabet: dict[str, int] = {}
    used = sorted(set(p.tolist()))
    place = np.zeros(len(patterns), np.int64)
    place[used] = np.arange(len(used))
    for x in used:
        for c in patterns[x]:
            alphabet.setdefault(c, len(alphabet) + 1)
    masks = np.zeros((len(used), len(alphabet) + 1), np.uint64)  # column 0: characters that no pattern has
    for k, x in enumerate(used):
        for at, c in enumerate(patterns[x]):
            masks[k, alphabet[c]] |= np.uint64(1 << at)
    size = np.array([len(x) for x in texts])
    codes = np.zeros((len(texts), int(size.max(initial=0))), np.int64)
    for k, x in enumerate(texts):
        codes[k, : len(x)] = [alphabet.get(c, 0) for c in x]
    own = place[p]
    s = np.full(len(p), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(int(size[t].max(initial=0))):
            u = s & masks[own, codes[t, k]]
            s = (s + u) | (s - u)
    length = np.array([len(x) for x in patterns])[p]
    full = np.where(length >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(length, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~s & full).astype(np.int64)
