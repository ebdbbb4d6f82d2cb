import numpy as np
import pytest

from quillspan.llm.html_blocks import DIMS, Labeller, blocks, extracted, train, training_pages, vectors


def text(page):
    return [t for t, _ in blocks(page)]


def test_blocks():
    assert text("<p>a&amp;b  <b>c</b>d<br>e</p>\n<div>f<p>g<p>h") == ["a&b cd e", "f", "g", "h"]
    assert text('<script>var t="</p>";x<y</script><style>p{}</style>a<!-- <p>no</p> -->b') == ["ab"]
    assert text("<p><b>x<br><p>y</p><p>z</p>") == ["x", "y", "z"]
    assert text('<a title="1>2">q</a> &eacute;&#233; < 3') == ["q éé < 3"]
    assert text("<!DOCTYPE html><title>t</title>") == [] and text("") == []
    assert blocks("<article><p>x</b></p></article><p>y")[0] == ("x", ("article", "p"))
    assert blocks('<div class="ad"><span>x</span></div>') == [("x", ("div ad",))]


def test_gradients():
    from quillspan.llm import html_blocks as h

    rng = np.random.default_rng(0)
    net = Labeller()
    net.p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in net.p.items()}
    x = rng.normal(0, 1, (3, 5, 2 * h.DIMS + 8))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    y = rng.random((3, 5)) < 0.5
    loss, g = net.gradients(x, mask, y)
    for name in ("xf", "hf", "hb", "cb", "out"):
        i = tuple(int(k) for k in np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        kept = net.p[name][i]
        net.p[name][i] = kept + 1e-5
        up = net.gradients(x, mask, y)[0]
        net.p[name][i] = kept - 1e-5
        down = net.gradients(x, mask, y)[0]
        net.p[name][i] = kept
        assert abs((up - down) / 2e-5 - g[name][i]) < 1e-3 * abs(g[name][i]) + 1e-6


@pytest.fixture(scope="module")
def labeller(spark):
    rows = [(i, f"<p>The thing {i} and that other one</p>") for i in range(40)]
    return train(spark.createDataFrame(rows, "page_id long, html string"))


def test_held_out_layouts(labeller):
    pages = training_pages([f"w{i}" for i in range(300)], 150, seed=77)
    got = labeller.label([p for p, _ in pages])
    assert np.mean(np.concatenate([g == (y > 0) for g, (_, y) in zip(got, pages, strict=True)])) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header class="site-header"><a>Logo</a></header><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav>
<div class="cookie-banner">We use cookies.</div><article><h1>Head&shy;line</h1><p>First  para.
more<br>text<p>Second &lt;one&gt;.</p></article><aside class="sidebar"><h3>Related</h3><p>Other story.</p></aside>
<section class="comments"><p>I like this.</p></section><form><label>Mail</label></form><div class="ad">Buy now.</div><footer>&copy; x</footer></body></html>"""


def test_extraction(spark, labeller):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (4, "u", "<article><p>" + "word " * 90_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars").repartition(2)
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extracted(df, labeller).collect()), key=str)
    main = "Head­line First para. more text Second <one>."
    long = ("word " * 90_000).strip()
    assert out == sorted([(1, "u", main, len(main))] * 2 + [(2, None, "", 0), (3, "u", "", 0), (4, "u", long, len(long))], key=str)


@pytest.mark.parametrize("page,main", [
    ("<p>One paragraph alone on its page, with nothing else beside it.</p>", "One paragraph alone on its page, with nothing else beside it."),
    ("<table><tr><td>The first paragraph of this old page is in a cell.<p>A second one follows it, longer than the first, with more words.</p></td></tr></table>", "The first paragraph of this old page is in a cell. A second one follows it, longer than the first, with more words."),
    ("<article><h1>Head</h1><p>Licensed under the Apache License, Version 2.0.</p><p>Plain prose comes after it here.</p><p>CHSCHA,!!</p></article><footer>Copyright 2020 someone</footer>", "Head Licensed under the Apache License, Version 2.0. Plain prose comes after it here. CHSCHA,!!"),
    ("<nav><a>Home</a></nav><main><p>In short.</p><p>In short.</p><p>In short.</p><p>In short.</p></main><footer>&copy; us</footer>", "In short. In short. In short. In short."),
    ('<div class="menu"><a>Home</a></div><div class="post"><h2>Title of it</h2>Text that stands bare in a division.<ul><li>one item</li><li>another item</li></ul></div><div class="sidebar"><li>Other</li></div>', "Title of it Text that stands bare in a division. one item another item"),
])
def test_odd_layouts(labeller, page, main):
    found = blocks(page)
    assert " ".join(t for (t, _), k in zip(found, labeller.label([found])[0], strict=True) if k) == main


def test_long_pages_go_in_stretches(labeller, monkeypatch):
    from quillspan.llm import html_blocks as h

    page = [b for p, _ in training_pages(["alpha", "beta", "gamma"], 60, seed=5) for b in p]
    whole = labeller.label([page])[0]
    monkeypatch.setattr(h, "LONG", 37)
    assert len(page) > 400 and (labeller.label([page])[0] == whole).all()


def test_given_pages(spark):
    """The test tables' pages, where they are: what stands in the article is kept, and nothing else."""
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    pages = [blocks(p or "") for p in pq.read_table(path).column("html").to_pylist()]
    labeller = train(spark.read.parquet(path))
    inside = [np.array([any(e.split(" ")[0] == "article" for e in path) for _, path in p], bool) for p in pages]
    got = labeller.label(pages)
    assert sum((g == y).all() for g, y in zip(got, inside, strict=True)) >= 0.98 * len(pages)


def test_vectors_see_whole_blocks():
    opening = "one two three four five six seven eight "
    a, b = (vectors([(opening + "and so on " * 30 + end, ("div",))]) for end in ("alpha beta gamma.", "delta sigma omega 7."))
    words = slice(DIMS, 2 * DIMS)
    assert (a[0, words] != b[0, words]).any() and abs(a[0, words].sum() - 1) < 1e-5
    assert a[0, 2 * DIMS + 5] == 0 and b[0, 2 * DIMS + 5] == 1


def test_empty(spark, labeller):
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string"), labeller).collect() == []
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert vectors([("x", ("p",))]).shape[0] == 1
