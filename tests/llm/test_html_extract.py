import html
import re
import time

import numpy as np
import pytest

from ledgerloom.llm import block_labeller as labeller
from ledgerloom.llm import html_extract as extract

VOCABULARY = "ther und les de la pour avec está niño über straße and of in it erster nicht onwhor ntble".split()


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="module")
def weights(pages):
    return extract.fit(extract.sample_of(pages, "page_id", "url", "html"))


def article(page):
    """What the given pages' article holds, by their one layout."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def texts_of(page):
    return [b[0] for b in extract.leaf_blocks(page, extract.Paths())]


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<br>b<b>c</b>d</p>e", ["a bcd", "e"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<script>var t='</p><p>no</p>';</script><style>p{}</style><title>no</title><!-- no <p>no</p> --><p>yes", ["yes"]),
        ("<p>x<script>no", ["x"]),
        ("<p>x<!-- no", ["x"]),
        ("<p>x<!-- no <b>no</b> no", ["x"]),
        ("<p>x<script>no</b> no", ["x"]),
        ("<script>no</script>x", ["x"]),
        ("<p title='a>b'>x</p><p title=\"a'>b\">y</p>", ["x", "y"]),
        ("1 < 2 &amp; 3 &gt; 2 &eacute;&#233;&#xe9; &lt;p&gt; &amp;amp; &bogus;", ["1 < 2 & 3 > 2 ééé <p> &amp; &bogus;"]),
        ("a&nbsp;&nbsp;b\t\tc d", ["a b c d"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", ["a", "b", "c", "d", "e", "f", "g"]),
        ("<P>A</P><DIV CLASS=x>B</DIV></p></div></article>C", ["A", "B", "C"]),
        ("<p> <b> </b> &nbsp; </p>", []),
        ("<noscript>no</noscript><template><p>no</p></template><p>yes</p>", ["yes"]),
        ("x <b>y</b> z < 3 <p title='never", ["x y z < 3"]),
        ("<p>x</p><p title=\"never ends>y</p>", ["x", "y"]),
    ],
)
def test_blocks(page, wanted):
    assert texts_of(page) == wanted


def test_paths_and_links():
    paths = extract.Paths()
    found = extract.leaf_blocks('<div class="Main-Menu x2" id=top><ul><li><a href="/a">abcd</a> efg<li>z</ul></div><p>q', paths)
    assert [(t, list(paths.names(n)), round(s, 2)) for t, n, s in found] == [
        ("abcd efg", ["a", "li", "ul", "div", ".main", ".menu", ".x", ".top"], 0.5), ("z", ["li", "ul", "div", ".main", ".menu", ".x", ".top"], 0.0), ("q", ["p"], 0.0),
    ]


def test_deep_and_odd_markup_takes_linear_time():
    start = time.time()
    for page in ("<div>" * 20000 + "x", "<" * 50000, "<p title='" * 5000, "</b>" * 50000 + "x", "<!--" * 20000, "<a <b " * 20000):
        texts_of(page)
    assert time.time() - start < 10


def made(n, seed):
    paths = extract.Paths()
    pages, labels = [], []
    for page, wanted in labeller.layouts(n, VOCABULARY, seed):
        pages.append(extract.leaf_blocks(page, paths))
        labels += [b[0] in set(wanted) for b in pages[-1]]
    return extract.encoded(pages, paths), np.array(labels, np.float32)


def test_gradients():
    p, label = made(5, 3)
    w = {k: v.astype(np.float64) for k, v in labeller.initial(4).items()}
    mine = np.arange(len(p.sizes))
    _, g = labeller.gradients(w, p, label, mine)
    rng = np.random.default_rng(0)
    for key in w:
        flat = np.flatnonzero(g[key].ravel()) if g[key].any() else np.zeros(0, int)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            loss = []
            for step in (1e-3, -1e-3):
                w[key].ravel()[i] += step
                loss.append(labeller.gradients(w, p, label, mine)[0])
                w[key].ravel()[i] -= step
            assert abs((loss[0] - loss[1]) / 2e-3 - g[key].ravel()[i]) < 2e-3 * (0.05 + abs(g[key].ravel()[i])), key


def test_a_page_gets_the_same_labels_beside_any_others(weights):
    paths = extract.Paths()
    pages = [extract.leaf_blocks(page, paths) for page, _ in labeller.layouts(30, VOCABULARY, 8)]
    together = labeller.probabilities(weights, extract.encoded(pages, paths))
    alone = np.concatenate([labeller.probabilities(weights, extract.encoded([p], paths)) for p in pages])
    assert np.allclose(together, alone, atol=1e-4)


def test_labels_depend_on_the_page_around_a_block(weights):
    paths = extract.Paths()
    block = [("und les of it and ther of straße nicht.", paths.child(0, "p", ""), 0.0)]
    long = [("und les of it and ther " * 10, paths.child(0, "p", ""), 0.0)] * 8
    links = [("ther", paths.child(paths.child(0, "li", ""), "a", ""), 1.0)] * 8
    one, two = (labeller.probabilities(weights, extract.encoded([x + block], paths))[-1] for x in (long, links))
    assert one > two


def test_held_out_layouts(weights):
    p, label = made(300, 77)
    assert np.mean((labeller.probabilities(weights, p) > 0.5) == label) > 0.95


def test_given_pages(pages, weights):
    rows = {r["page_id"]: r for r in extract.extract(pages, weights=weights).collect()}
    given = pages.collect()
    assert len(rows) == len(given)
    assert all(rows[r["page_id"]]["text"] == article(r["html"]) and rows[r["page_id"]]["n_chars"] == len(article(r["html"])) for r in given)


PARTS = [
    "<aside><h3>Zz more</h3><p>Zz side words here.</p></aside>", '<div class="cookie-consent"><p>Zz we use cookies.</p></div>',
    '<section class="comments"><h2>Zz Comments</h2><div class="comment"><p>Zz I like the of this.</p></div></section>',
    "<form><label>Zz mail</label><button>Zz go</button></form>", "<header><p>Zz site of the.</p></header>", '<div class="notice">Zz notice of it.</div>', '<div class="advertisement">Zz buy.</div>',
]


@pytest.mark.parametrize("k", range(len(PARTS)))
def test_parts_put_into_given_pages_stay_out(spark, pages, weights, k):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.limit(30).collect()]
    put = [(i, u, x.replace("<article>", PARTS[k] + "<article>") if i % 2 else x.replace("</article>", "</article>" + PARTS[k])) for i, u, x in rows]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(put, "page_id long, url string, html string"), weights=weights).collect()}
    assert got == {i: article(x) for i, _, x in rows}


def test_odd_pages(spark, weights):
    long = "<article>" + "".join(f"<p>the words of number {i} and more</p>" for i in range(6000)) + "</article><footer>no</footer>"
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<article><p>one and the other of it</p></article>"), (2, "u", "<nav>x</nav>"), (3, "u", long)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, html string, text string, texts string, main string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract.extract(df, weights=weights).collect()))
    assert got[:4] == [(0, "one and the other of it", 23), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert got[4][1].count("\n") == 5999 and "no" not in got[4][1].split("\n")
    assert extract.extract(df.limit(0)).collect() == []


def test_the_sample_is_the_same_whatever_the_order(pages):
    of = lambda df: extract.sample_of(df, "page_id", "url", "html")
    assert of(pages) == of(pages.orderBy("url").repartition(5))
