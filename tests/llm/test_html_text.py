import random
import time

import numpy as np
import pytest

from labelloom.llm import html_text
from labelloom.llm.html_text import BlockLabeller, blocks, fit, made_page, main_text, padded, train, vectors

TEXTS = ["the quick brown fox, jumps over the lazy dog. and then some more words of plain prose follow, as ever " * 4, "le chat est sur la table. il dort, et la pluie tombe sur le toit de la maison " * 4]


@pytest.fixture(scope="module")
def model():
    return train(TEXTS)


def test_blocks():
    page = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- c --><div class='ad x'>buy &amp; sell</div><p><b>one\n two<br>three<p>four &copy &#233;</p> a < b <li>x<li><a href='q>r'>y</a></body>"
    found = blocks(page)
    assert [t for _, t, _ in found] == ["buy & sell", "one two three", "four © é", "a < b", "x", "y"]
    assert found[0][0] == ("html", "body", "div ad x") and found[1][0][:3] == ("html", "body", "p") and found[2][0] == ("html", "body", "p")
    assert found[5][0] == ("html", "body", "li", "a") or found[5][2] == 1
    assert blocks("") == [] and blocks("<<<") == [(("",)[:0], "<<<", 0)] and blocks("<script>never closed") == [] and blocks("<p") == [((), "<p", 0)]


def test_heads_and_elements_that_are_left_open():
    texts = lambda page: [t for _, t, _ in blocks(page)]
    assert texts("<html><head><title>t</title><p>one<article><p>two</article>") == ["one", "two"]
    assert texts("<head><meta charset=x><article>one</article>") == ["one"] and texts("<head><title>t</title>\n one <b>two</b>") == ["one two"]
    assert texts("<head><noscript>no</noscript><template><p>no</p></template><title>t</title></head><p>one") == ["one"]
    assert texts("<head><template><p>no<body><p>one") == ["one"] and texts("<head><iframe>x</iframe><p>one") == ["one"]
    for tag in "svg math object select canvas audio video template noscript".split():
        assert texts(f"<body><p>one</p><{tag}><p>two</p><p>three") == ["one", "two", "three"], tag
        assert texts(f"<article><p>one <{tag}>two</{tag}> three</p></article>") == ["one two three"], tag
    assert texts("<p>one<script>var a = '<p>no</p>'</script><style>no</style>") == ["one"]


def test_gradients():
    rng = np.random.default_rng(0)
    net = BlockLabeller.new(3, rng)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    pages = [rng.normal(size=(n, net.params["xf"].shape[0])) for n in (4, 2)]
    x, mask = padded(pages)
    y = rng.integers(0, 2, mask.shape).astype(np.float32)
    _, grads = net.gradients(x, mask, y)
    for k in grads:
        at = tuple(rng.integers(0, n) for n in grads[k].shape)
        old, eps, got = net.params[k][at], 1e-3, []
        for sign in (1, -1):
            net.params[k][at] = old + sign * eps
            got.append(net.gradients(x, mask, y)[0])
        net.params[k][at] = old
        assert abs((got[0] - got[1]) / (2 * eps) - grads[k][at]) < 2e-3, k


def test_held_out_accuracy(model):
    rng, wrong, total = random.Random(77), 0, 0
    for _ in range(150):
        page, labels = made_page([t[::-1] for t in TEXTS], rng)
        found = blocks(page)
        assert len(found) == len(labels)
        wrong += int((model.label([vectors(found)])[0] != np.array(labels)).sum())
        total += len(labels)
    assert wrong <= 0.01 * total


def test_pages(spark, model):
    article = "<html><head><title>x</title></head><body><nav><ul><li><a href='/a'>menu entry</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  part,\nof it.</p><p>Second part.</p></article><footer>&copy; someone, somewhere</footer></body></html>"
    rows = [(1, "u", article, "a"), (1, "u", article, "b"), (2, None, None, "c"), (None, "v", "", "d"), (3, "w", "<article>" + "<p>A sentence of some words, as it were.</p>" * 5000 + "</article>", "e")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text(frame, model).collect()
    assert len(got) == 5
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "A & B\n\nFirst part, of it.\n\nSecond part." and texts[2] == texts[None] == ""
    assert texts[3].count("\n\n") == 4999 and all(r.n_chars == len(r.text) for r in got)
    assert main_text(frame.limit(0), model).count() == 0


#: Labelled by hand: name, html, main text.
PAGES = [
("blog", """<!doctype html><html lang=en><head><meta charset=utf-8><title>Bread | My Blog</title><style>.x{}</style></head><body class="home">
<div class="skip"><a href="#c">Skip to content</a></div><header class="site-header"><a href="/">My Blog</a><nav class="main-nav"><ul><li><a href="/a">Home</a><li><a href="/b">About</a><li><a href="/c">Recipes</a></ul></nav></header>
<main id="c"><article class="post hentry"><header class="entry-header"><h1 class="entry-title">Bread without haste</h1></header>
<div class="entry-content"><p>The dough rests for a night in a cold room, and that is all there is to it.</p><p>Flour, water, salt &amp; time: <a href="/f">four things</a>, none of them rare.</p><h2>What to do</h2><ul><li>Mix everything in a bowl.</li><li>Wait until the morning, then bake.</li></ul><blockquote><p>A loaf is a clock that one can eat.</p></blockquote></div></article></main>
<aside class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Soup</a></li><li><a href="/2">Cake</a></li></ul></aside>
<section id="comments" class="comments-area"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><p>I tried this and it worked very well, thank you for the recipe!</p></li><li class="comment"><p>Mine was too wet, perhaps less water would do.</p></li></ol><form class="comment-form"><label>Name</label><input><button>Post comment</button></form></section>
<footer class="site-footer"><p>Copyright 2020 My Blog. All rights reserved.</p></footer></body></html>""",
 "Bread without haste\n\nThe dough rests for a night in a cold room, and that is all there is to it.\n\nFlour, water, salt & time: four things, none of them rare.\n\nWhat to do\n\nMix everything in a bowl.\n\nWait until the morning, then bake.\n\nA loaf is a clock that one can eat."),
("news", """<html><head><title>n</title></head><body><div id="cookie-banner" class="cookie consent"><p>We use cookies to make this site better for all readers.</p><button>Accept</button></div>
<div id="header"><div class="logo">The Daily</div><div class="menu"><a href="/w">World</a> <a href="/s">Sport</a> <a href="/k">Culture</a></div></div>
<div id="content"><div class="article"><h1>River rises after rain</h1><p>The river rose by two metres on Monday, the city said, after a week of steady rain in the hills.</p>
<div class="ad advertisement"><p>Buy boots now, half the price!</p></div><p>Schools stayed open, but several roads along the bank were closed until the evening.</p><p>No one was hurt.</p></div>
<div class="related"><h3>Related</h3><ul><li><a href="/r1">Floods of the past</a></li><li><a href="/r2">How dams work</a></li></ul></div></div>
<div id="sidebar"><div class="newsletter"><p>Sign up for our letter</p><form><input><button>Go</button></form></div></div><div id="footer"><a href="/i">Imprint</a> <a href="/p">Privacy</a></div></body></html>""",
 "River rises after rain\n\nThe river rose by two metres on Monday, the city said, after a week of steady rain in the hills.\n\nSchools stayed open, but several roads along the bank were closed until the evening.\n\nNo one was hurt."),
("docs", """<html><head><title>d</title></head><body><nav class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></nav><div role="main" class="document body"><section id="a"><h1>Install</h1><p>Unpack the archive into a folder of your choice.</p><pre>tar xf tool.tar</pre></section><section id="b"><h1>Use</h1><p>Call the tool with a file, and it prints a summary of it.</p><table><tr><td>-v</td><td>says more about what it does</td></tr></table></section></div><footer><p>Built on Monday.</p></footer></body></html>""",
 "Install\n\nUnpack the archive into a folder of your choice.\n\ntar xf tool.tar\n\nUse\n\nCall the tool with a file, and it prints a summary of it.\n\n-v\n\nsays more about what it does"),
("plain", """<html><body><p>Once there was a mill by the brook, and no road led to it.<p>The miller had a donkey and a boat.<p>In spring the boat was of more use.</body></html>""",
 "Once there was a mill by the brook, and no road led to it.\n\nThe miller had a donkey and a boat.\n\nIn spring the boat was of more use."),
("german", """<html><head><title>g</title></head><body><header><nav><a href='/'>Start</a> <a href='/k'>Kontakt</a></nav></header><article><h1>Der Wald im Herbst</h1><p>Im Oktober fallen die Blätter, und der Weg wird weich.</p><figure><img src=x><figcaption>Ein Weg im Nebel</figcaption></figure><p>Wer früh geht, sieht die Rehe am Rand der Lichtung.</p></article><div class='share social'><a href='#'>Teilen</a></div><footer>Impressum</footer></body></html>""",
 "Der Wald im Herbst\n\nIm Oktober fallen die Blätter, und der Weg wird weich.\n\nEin Weg im Nebel\n\nWer früh geht, sieht die Rehe am Rand der Lichtung."),
]


@pytest.mark.parametrize("name, page, want", PAGES, ids=[p[0] for p in PAGES])
def test_pages_labelled_by_hand(spark, name, page, want):
    """Weights from the words of two texts."""
    model = _fitted(spark)
    assert main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), model).first().text == want


_MODELS = []


def _fitted(spark):
    if not _MODELS:
        _MODELS.append(fit(spark.createDataFrame([(i, f"<p>{t} {i}</p>") for i in range(40) for t in TEXTS], "page_id long, html string")))
    return _MODELS[0]


@pytest.mark.parametrize("unit", ["<div>", "<div>x", "<p", "<a '", "<b></i>", "<b> </b>", "<title>", "</title", "<", "<!--", "<a \">", "<a '\">", "<head>", "&amp;", "<template><p>", "<div class=a><b>t"])
def test_what_is_left_open_costs_no_more_than_its_length(unit):
    took = []
    for size in (100_000, 1_000_000):
        began = time.process_time()
        found = html_text.leaf_blocks(unit * (size // len(unit)))
        html_text.vectors(found[:1000])
        took.append(time.process_time() - began)
    assert took[1] < 10 and took[1] < 30 * max(took[0], 0.02)


def test_paths_of_deep_pages_are_those_of_their_elements():
    deep = "<div class='a b'>" * 50 + "x" + "<p id=c>y</p>" + "</div>" * 50 + "z"
    assert html_text.blocks(deep) == [(("div a b",) * 50, "x", 0), ((*("div a b",) * 50, "p c"), "y", 0), ((), "z", 0)]
    assert (html_text.vectors(html_text.leaf_blocks(deep)) == html_text.vectors(html_text.blocks(deep))).all()


def test_elements_that_are_never_closed_take_no_text_behind_them():
    texts = lambda page: [t for _, t, _ in html_text.blocks(page)]
    for tag in ("title", "textarea", "iframe"):
        assert texts(f"<p>a</p><{tag}>x<p>rest<p>more") == ["a", "rest", "more"]
        assert texts(f"<p>a</p><{tag}>x<p>y</{tag} ><p>rest") == ["a", "rest"]
    assert texts("<p>a<script>if (a<b) x") == ["a"]


def test_a_reference_that_a_tag_cuts_is_none():
    assert [t for _, t, _ in html_text.blocks("<p>&am<b>p;</b> &lt;b&gt; &#x41;&copy")] == ["&amp; <b> A©"]
