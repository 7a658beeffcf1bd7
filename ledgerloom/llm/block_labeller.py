"""A bidirectional LSTM in numpy that labels the blocks of a page, and the made-up layouts that it learns from besides."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np

PATH_BUCKETS, WORD_BUCKETS = 1024, 4096
PATH_DIM, WORD_DIM, EXTRA, HIDDEN = 16, 8, 2, 16
#: Padded steps times pages that the recurrence takes at once.
AT_ONCE = 1 << 14
EPOCHS, BATCH, RATE = 10, 32, 0.015

Weights = dict[str, np.ndarray]


class Pages:
    """Blocks of some pages as the model reads them.

    sizes: blocks of each page.  node: a block's tag path; parent: the path that a path goes on from, which stands before
    it; parts: (path, bucket) of the names that it adds.  word_block, word: the block and the bucket of every word.
    extra: further numbers of a block.
    """

    def __init__(self, sizes: np.ndarray, node: np.ndarray, parent: np.ndarray, parts: tuple[np.ndarray, np.ndarray], word_block: np.ndarray, word: np.ndarray, extra: np.ndarray) -> None:
        self.sizes, self.node, self.parent, self.parts, self.word_block, self.word, self.extra = sizes, node, parent, parts, word_block, word, extra


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by at, which is sorted."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(first):
        out[at[first]] = np.add.reduceat(rows, first)
    return out


def _means(at: np.ndarray, keys: np.ndarray, table: np.ndarray, n: int, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(means of the table's rows, their divisor), in pieces of bounded size."""
    count = np.maximum(np.bincount(at, minlength=n), 1).astype(np.float32)[:, None]
    out = np.zeros((n, table.shape[1]), np.float32)
    for lo in range(0, len(at), piece):
        part = at[lo : lo + piece]
        base = int(part[0])
        here = _sums(part - base, table[keys[lo : lo + piece]], int(part[-1]) - base + 1)
        out[base : base + len(here)] += here
    return out / count, count


def _paths(table: np.ndarray, p: Pages) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the vectors of all names on a path over the root of their number, that divisor)."""
    owner, bucket = p.parts
    total = np.zeros((len(p.parent), table.shape[1]), table.dtype)
    np.add.at(total, owner, table[bucket])
    count = np.bincount(owner, minlength=len(p.parent))
    for k in range(1, len(p.parent)):
        total[k] += total[p.parent[k]]
        count[k] += count[p.parent[k]]
    divisor = np.sqrt(np.maximum(count, 1)).astype(np.float32)[:, None]
    return total / divisor, divisor


def inputs(w: Weights, p: Pages) -> np.ndarray:
    paths, _ = _paths(w["path"], p)
    words, _ = _means(p.word_block, p.word, w["word"], len(p.node))
    return np.concatenate([paths[p.node], words, p.extra], 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _places(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of step t of a page, in either direction: 2 x T x B; which steps there are: T x B)."""
    t = np.arange(sizes.max())[:, None]
    there = t < sizes
    ahead = np.where(there, starts + t, starts)
    back = np.where(there, starts + sizes - 1 - t, starts)
    return np.stack([ahead, back]), there


def _run(w: Weights, x: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (2 x T x B x HIDDEN) of both directions."""
    two, steps, pages = at.shape
    gates = np.stack([(x @ w["in"][k] + w["bias"][k])[at[k]] for k in range(2)])
    h = np.zeros((two, pages, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.empty((two, steps, pages, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        z = gates[:, t] + h @ w["again"]
        s = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o, g = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :], np.tanh(z[..., 3 * HIDDEN :])
        if keep:
            kept.append((i, f, o, g, c, h))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t] = h
    return out, kept


def probabilities(w: Weights, p: Pages) -> np.ndarray:
    """How likely each block is main text, from the whole page in both directions; pages of like length run together."""
    out = np.empty(len(p.node), np.float32)
    if not len(p.node):
        return out
    x = inputs(w, p)
    starts = np.cumsum(p.sizes) - p.sizes
    order = np.argsort(p.sizes, kind="stable")
    order = order[p.sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and int(p.sizes[order[hi]]) * (hi + 1 - lo) <= AT_ONCE:
            hi += 1
        mine = order[lo:hi]
        at, there = _places(p.sizes[mine], starts[mine])
        h, _ = _run(w, x, at)
        for k in range(2):
            score = h[k] @ w["out"][k]
            if k == 0:
                out[at[0][there]] = score[there]
            else:
                out[at[1][there]] += score[there]
        lo = hi
    return _sigmoid(out + w["shift"])


def initial(seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + EXTRA
    draw = lambda *shape, size: rng.normal(0, size, shape).astype(np.float32)
    bias = np.zeros((2, 4 * HIDDEN), np.float32)
    bias[:, HIDDEN : 2 * HIDDEN] = 1
    return {
        "path": draw(PATH_BUCKETS, PATH_DIM, size=0.1), "word": draw(WORD_BUCKETS, WORD_DIM, size=0.1), "in": draw(2, d, 4 * HIDDEN, size=d**-0.5),
        "again": draw(2, HIDDEN, 4 * HIDDEN, size=HIDDEN**-0.5), "bias": bias, "out": draw(2, HIDDEN, size=HIDDEN**-0.5), "shift": np.zeros(1, np.float32),
    }


def gradients(w: Weights, p: Pages, label: np.ndarray, mine: np.ndarray, words: bool = True) -> tuple[float, Weights]:
    """(mean loss of these pages' blocks, its gradients), back through both directions."""
    x = inputs(w, p)
    if not words:
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = 0
    starts = np.cumsum(p.sizes) - p.sizes
    at, there = _places(p.sizes[mine], starts[mine])
    h, kept = _run(w, x, at, keep=True)
    score = np.zeros(len(p.node), np.float32)
    for k in range(2):
        score[at[k][there]] += h[k][there] @ w["out"][k]
    own = at[0][there]
    prob = _sigmoid(score[own] + w["shift"])
    y = label[own]
    loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
    back = np.zeros(len(p.node), np.float32)
    back[own] = (prob - y) / len(own)
    g: Weights = {"shift": back.sum(keepdims=True), "out": np.zeros_like(w["out"]), "again": np.zeros_like(w["again"])}
    dh_out = np.zeros_like(h)
    for k in range(2):
        here = np.where(there, back[at[k]], 0)
        g["out"][k] = np.einsum("tb,tbh->h", here, h[k])
        dh_out[k] = here[..., None] * w["out"][k]
    dz_all = np.empty((*h.shape[:3], 4 * HIDDEN), np.float32)
    dh, dc = np.zeros_like(h[:, 0]), np.zeros_like(h[:, 0])
    for t in range(h.shape[1] - 1, -1, -1):
        i, f, o, cand, c_before, h_before = kept[t]
        dh = dh + dh_out[:, t]
        tc = np.tanh(f * c_before + i * cand)
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * cand * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], -1)
        dz_all[:, t] = dz
        g["again"] += h_before.transpose(0, 2, 1) @ dz
        dh, dc = dz @ w["again"].transpose(0, 2, 1), dc * f
    dx = np.zeros_like(x)
    g["in"], g["bias"] = np.empty_like(w["in"]), np.empty_like(w["bias"])
    for k in range(2):
        dz, rows = dz_all[k][there], at[k][there]
        g["in"][k], g["bias"][k] = x[rows].T @ dz, dz.sum(0)
        dx[rows] += dz @ w["in"][k].T
    by_node = np.zeros((len(p.parent), PATH_DIM), np.float32)
    np.add.at(by_node, p.node, dx[:, :PATH_DIM])
    by_node /= _paths(w["path"], p)[1]
    for k in range(len(p.parent) - 1, 0, -1):
        by_node[p.parent[k]] += by_node[k]
    g["path"] = np.zeros_like(w["path"])
    np.add.at(g["path"], p.parts[1], by_node[p.parts[0]])
    g["word"] = np.zeros_like(w["word"])
    if words:
        _, count = _means(p.word_block, p.word, w["word"], len(p.node))
        rows = (dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / count)[p.word_block]
        for k in range(WORD_DIM):
            g["word"][:, k] = np.bincount(p.word, rows[:, k], WORD_BUCKETS)
    return loss, g


def part_of(p: Pages, mine: np.ndarray) -> tuple[Pages, np.ndarray]:
    """Some of the pages by themselves, and their blocks."""
    starts = np.cumsum(p.sizes) - p.sizes
    blocks = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[mine], p.sizes[mine])])
    words = np.concatenate([np.arange(*np.searchsorted(p.word_block, [s, s + n])) for s, n in zip(starts[mine], p.sizes[mine])])
    new = np.zeros(len(p.node), np.int64)
    new[blocks] = np.arange(len(blocks))
    return Pages(p.sizes[mine], p.node[blocks], p.parent, p.parts, new[p.word_block[words]], p.word[words], p.extra[blocks]), blocks


def train(p: Pages, label: np.ndarray, seed: int = 0) -> Weights:
    """Adam over batches of pages; for every other batch the words are hidden, so that the paths and the context must do."""
    w, rng = initial(seed), np.random.default_rng(seed + 1)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    some = np.flatnonzero(p.sizes > 0)
    step, total = 0, EPOCHS * -(-len(some) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(some)
        order = order[np.argsort(p.sizes[order] // 8, kind="stable")]  # like lengths together, batches in random order
        cuts = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for k in rng.permutation(len(cuts)):
            part, blocks = part_of(p, cuts[k])
            _, g = gradients(w, part, label[blocks], np.arange(len(part.sizes)), words=step % 2 == 0)
            step += 1
            rate = RATE * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for key, grad in g.items():
                mean[key] += 0.1 * (grad - mean[key])
                square[key] += 0.001 * (grad * grad - square[key])
                w[key] = w[key] - (rate * mean[key] / (np.sqrt(square[key]) + 1e-8)).astype(np.float32)
    return w


#: Ways in which pages name their parts: elements from the outside in.
BODIES = ["", "div", "div.wrapper", "div#page", "div.container", "div#wrap div.row", "div.site div.inner"]
MAIN = ["article", "main", "main article", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "section.story", "div#main div.text", "article.post div.body", "div.main-content", "section.article", "div.page-content", "main#main"]
PARTS = {
    "menu": ["nav ul li a", "nav a", "div.menu ul li a", "div#nav ul li a", "ul.navigation li a", "div.navbar a", "header nav ul li a", "div.breadcrumbs a", "ul.menu li a", "div.topnav a"],
    "header": ["header p", "header div", "header h1", "div#header p", "div.masthead h2", "div.site-header p", "header.top div a", "div.header div"],
    "footer": ["footer", "footer p", "div.footer p", "div#footer", "footer ul li a", "div.site-footer p", "footer small", "div.copyright", "footer.page-footer div"],
    "sidebar": ["aside p", "aside h3", "aside ul li a", "div.sidebar p", "div#sidebar ul li a", "div.widget p", "aside.sidebar div p", "section.sidebar p", "div.right-rail p", "div.side p"],
    "notice": ["div.cookie-notice p", "div#cookies", "div.notice", "div.cookie-banner p", "div.gdpr p", "div.alert", "section.notice p", "div.consent p", "div.disclaimer", "aside.notice p", "div.warning p", "div.message", "p.notice", "div#notice"],
    "advert": ["div.ad", "div.ads p", "div.advert p", "div.sponsored p", "div.promo p", "div#banner", "aside.ad p", "section.advertisement p", "div.advertisement", "div.ad-slot", "ins.adsbygoogle", "p.ad"],
    "form": ["form label", "form p", "form button", "div.newsletter form p", "form.search label", "div.subscribe form label", "form fieldset legend", "form select option", "form div"],
    "comments": ["section.comments div.comment p", "div#comments ul li.comment p", "ol.commentlist li p", "div.comments article p", "section#comments article.comment p", "div.reader-comments p", "div.comment", "div.responses div.reply p", "div#disqus_thread p", "section.comments p", "section.comments h3", "div.comment-list div"],
    "more": ["div.related ul li a", "div.share a", "section.related h3", "div.tags a", "div.recommended p", "div.social a", "div.pagination a", "div.author-box p"],
}
TEXT = ["h1", "h2", "h3", "p", "p", "p", "p", "p", "p", "p", "p", "p", "ul li", "ol li", "blockquote p", "blockquote", "pre", "table tr td", "figure figcaption", "dl dd", "div p", "section p"]
#: Words that such parts often hold.
SAID = {
    "menu": "home about contact news products startseite kontakt accueil inicio noticias", "header": "welcome to our site willkommen bienvenue bienvenido", "footer": "copyright all rights reserved imprint privacy impressum datenschutz mentions légales aviso legal",
    "sidebar": "popular posts archive categories latest beliebt populaires archivo", "notice": "we use cookies accept this site uses cookies wir verwenden cookies nous utilisons des cookies usamos cookies", "advert": "advertisement sponsored buy now sale anzeige publicité anuncio comprar",
    "form": "subscribe your email name send search password anmelden envoyer enviar buscar", "comments": "comments reply says posted by thanks great post kommentare antworten commentaires répondre comentarios", "more": "read more share related next previous tweet mehr lire aussi leer más",
}
#: Share of layouts whose classes and ids say nothing.
NAMELESS = 0.1


def _element(names: list[str], text: str, hide: bool, rng: random.Random) -> str:
    """The text in nested elements, such as ``div.menu``."""
    opened = []
    for name in names:
        tag, mark, value = name.partition("#") if "#" in name else name.partition(".")
        if hide and mark:
            value = "".join(rng.choice("bcdfghjkmz") for _ in range(6))
        opened.append((tag, f' {"id" if mark == "#" else "class"}="{value}"' if mark else ' href="/x"' if tag == "a" else ""))
    return "".join(f"<{t}{a}>" for t, a in opened) + text + "".join(f"</{t}>" for t, _ in reversed(opened))


def layouts(n: int, vocabulary: list[str], seed: int = 0) -> Iterator[tuple[str, list[str]]]:
    """(html, the texts of its main blocks) of made-up pages; words are drawn from the vocabulary."""
    rng = random.Random(seed)
    vocabulary = vocabulary or ["lorem", "ipsum", "dolor", "sit", "amet"]
    mark = 0

    def said(kind: str, least: int, most: int) -> str:
        """A text that no other block has: its last word is a number of its own."""
        nonlocal mark
        mark += 1
        own = SAID[kind].split() if kind in SAID and rng.random() < 0.5 else vocabulary
        return " ".join([*(rng.choice(own) for _ in range(rng.randint(least, most))), f"n{mark}"]).capitalize() + rng.choice([".", ".", ""])

    for _ in range(n):
        hide, long = rng.random() < NAMELESS, rng.random() < 0.05
        main, wanted = rng.choice(MAIN).split(), []
        inside: list[tuple[str, bool, str]] = []
        for k in range(rng.randint(60, 120) if long else rng.choice([1, 2, 3, 5, 8, 13, 20])):
            how = "h1" if k == 0 and rng.random() < 0.7 else rng.choice(TEXT) if rng.random() < 0.5 else "p"
            text = said("", 1, 12) if how.startswith(("h", "ul", "ol", "table", "dl")) else said("", 2, rng.choice([6, 20, 60]))
            wanted.append(text)
            linked = text if rng.random() < 0.85 else text.replace(" ", ' <a href="/y">', 1) + "</a>" if rng.random() < 0.5 else f"<b>{text}</b>"
            inside.append((linked, True, how))

        def part(kind: str) -> str:
            names = rng.choice(PARTS[kind]).split()
            many = rng.randint(2, 8) if names[-1] == "a" else rng.choice([1, 1, 2, 3]) if names[-1] in ("p", "label", "li", "option", "button") else 1
            short = names[-1] in ("a", "label", "button", "option", "legend", "h1", "h2", "h3")
            keep = next((k for k, x in enumerate(names) if x in ("li", "a", "p", "label", "option", "button", "article", "div.comment", "li.comment", "article.comment")), len(names) - 1)
            each = "".join(_element(names[keep:], said(kind, 1, 3) if short else said(kind, 2, 25), hide, rng) for _ in range(many))
            return _element(names[:keep], each, hide, rng)

        cut = [k for k in ("advert", "notice", "form", "more", "sidebar") if rng.random() < 0.12]
        body = [_element(how.split(), text, False, rng) for text, _, how in inside]
        for kind in cut:  # parts that stand among the article's blocks
            body.insert(rng.randint(0, len(body)), part(kind))
        before = [k for k in ("menu", "header", "notice", "advert", "form", "sidebar") if rng.random() < 0.45]
        after = [k for k in ("comments", "more", "sidebar", "advert", "form", "footer", "notice", "menu") if rng.random() < 0.45]
        rng.shuffle(before)
        page = "".join(map(part, before)) + _element(main, "".join(body), hide and main[0].startswith("div"), rng) + "".join(map(part, after))
        yield "<html><head><title>t</title></head><body>" + _element(rng.choice(BODIES).split(), page, hide, rng) + "</body></html>", wanted
