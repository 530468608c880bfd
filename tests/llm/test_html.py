import random

import numpy as np
import pytest

from corpuslink.llm import html as H


@pytest.fixture(scope="module")
def pages(small):
    import duckdb

    return [h for (h,) in duckdb.sql(f"select html from '{small}/pages.parquet' order by page_id").fetchall()]


@pytest.fixture(scope="module")
def model(pages):
    return H.learn(pages)


def labelled(model, page):
    blocks = H.blocks_of(page)
    return blocks, H.scores([H.Features().of(blocks)], model)[0] >= 0.5


def test_blocks():
    page = "<body><p>a  b&amp;c<b>x</b><br>d<p>e</div>f<script>var t='</p>';</script><ul><li>1<li>2</ul><!-- <p>no</p> --><style>p{}</style><p></p>&nbsp;<table><tr><td>g<td>h</table>"
    assert [b.text for b in H.blocks_of(page)] == ["a b&cx d", "e", "f", "1", "2", "g", "h"]
    assert H.blocks_of("") == [] and [b.text for b in H.blocks_of("a < b")] == ["a < b"]


def test_broken_markup_loses_no_text():
    texts = lambda page: [b.text for b in H.blocks_of(page)]
    assert texts("<p><a href=x title=don't>Hello</a> world</p><p>it's <b>fine</b> here</p>") == ["Hello world", "it's fine here"]
    assert texts("<article><p>a<select><option>1<option>2</p><p>b</p><select><option>x</select>c</article>") == ["a", "b", "c"]
    assert texts("<div>a<svg><path d='M0 0'><p>b</p></div><p>c<object data=x><div>d</div>") == ["a", "b", "c", "d"]
    assert texts('<p>a<br title="x>y">b</p><p class=\'q">r\'>c</p>') == ["a b", "c"]
    assert texts('<p title="never ended>a</p><p>b</p>') == ["a", "b"]
    assert texts("<p>a</p><!-- open <p>b</p>") == ["a"] and texts("<p>x <b y") == ["x <b y"]


def test_broken_markup_is_read_in_one_pass():
    import time

    began = time.time()
    for unit in ("<", "<a ", '<a b="', '<a b="x>"', "<a b='", "<!", "</", "<p title=\"'>", "<svg>", "<select>"):
        H.blocks_of(unit * 40_000)
        H.blocks_of("<p>" + unit * 40_000 + "</p>")
    assert time.time() - began < 30


def test_bounds_of_the_sample(pages):
    small = H.learn(pages[:5], blocks=8)
    assert H.scores([H.Features().of(H.blocks_of(pages[0]))], small)[0].shape == (len(H.blocks_of(pages[0])),)


def test_gradients():
    rng = np.random.default_rng(1)
    w = {"x": rng.normal(size=(5, 4 * H.HIDDEN)) * 0.3, "h": rng.normal(size=(H.HIDDEN, 4 * H.HIDDEN)) * 0.1, "b": rng.normal(size=4 * H.HIDDEN) * 0.1}
    x, d = rng.normal(size=(2, 6, 5)), rng.normal(size=(2, 6, H.HIDDEN))
    _, states = H._run(x, w, True)
    g = H._back(x, w, states, d)
    for name, at in (("x", (2, 7)), ("h", (3, 40)), ("b", (70,))):
        e = 1e-5
        w[name][at] += e
        up = (H._run(x, w) * d).sum()
        w[name][at] -= 2 * e
        down = (H._run(x, w) * d).sum()
        w[name][at] += e
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-6)


def test_held_out_pages(model, pages):
    """Labels by the pages' own article elements, on pages of a larger table that it has not seen."""
    import duckdb

    held = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall() if h not in set(pages)]
    right = total = 0
    for page in held:
        blocks, got = labelled(model, page)
        want = [any(tag == "article" for tag, _ in b.path) for b in blocks]
        right += sum(a == b for a, b in zip(got.tolist(), want))
        total += len(blocks)
    assert right / total > 0.995


def test_held_out_layouts(model):
    rng, right, total = random.Random(77), 0, 0
    pool = [" ".join(rng.choice("lorem ipsum dolor sit amet consectetur adipiscing".split()) for _ in range(rng.randint(8, 40))) + "." for _ in range(60)]
    for _ in range(150):
        blocks, got = labelled(model, H._layout(pool, rng))
        right += sum(bool(b.label) == g for b, g in zip(blocks, got.tolist()))
        total += len(blocks)
    assert right / total > 0.97


def test_query(spark, pages):
    rows = [(i, "u", h, "x", 1) for i, h in enumerate(pages)] + [(100, None, None, "x", 1), (101, "u", "", "x", 1), (102, "u", "<nav><a href=/>Home</a></nav>", "x", 1), (0, "u", pages[0], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (100, 101, 102)} == {""}
    assert sum(r.page_id == 0 for r in got) == 2
    assert H.main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("unit", ["<p>x</p><b>", "<p>x</p><b class=c>", "<td><p>x<i>", "<p>x<b id=a><li><u>y"])
def test_unclosed_inline_elements_are_read_in_one_pass(unit):
    """A page of a megabyte, in time that grows with its length."""
    import time

    H.Features().of(H.blocks_of(unit * 2000))
    page = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    x = H.Features().of(H.blocks_of(page))
    assert len(x) >= page.count("x") - 1 and time.perf_counter() - start < 20


def test_places():
    blocks = H.blocks_of("<body><div class=a><p>x<b>y</b></p><span data-main=1><p>z</div>w")
    assert [(b.text, b.path, b.label) for b in blocks] == [
        ("xy", [("body", ""), ("div", "class=a"), ("p", "")], None),
        ("z", [("body", ""), ("div", "class=a"), ("span", "data-main=1"), ("p", "")], True),
        ("w", [("body", "")], None),
    ]
