"""Main texts of pages in layouts that are not among those practised on."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from corpus_spark.llm import html_extract as H

PAGES = "/root/testdata/sf0.001/pages.parquet"
T = "This is the first long paragraph of the story, with several words and a full stop at its end. It goes on, and on, as stories do."
U = "Another passage follows here; it has commas, numbers like 42, and ends the way that passages end. Readers like it."

LAYOUTS = {
    "one sentence": ("<body><p>One short sentence.</p></body>", "One short sentence."),
    "text in the article": (f"<div id=root><article><h1>Head line</h1>{T}<table><tr><td>cell one</td><td>cell two</td></tr></table>{U}<p>{T}</p></article><div class=comments><p>nice post</p><p>me too</p></div><div class=cookie-notice>We use cookies. <button>ok</button></div></div>", f"Head line\n{T}\ncell one\ncell two\n{U}\n{T}"),
    "menu and little else": ("<html><body><nav><h2>Menu</h2><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><main><h1>Hi</h1><p>Text of the page, short.</p></main><footer>(c) 2020 Site</footer></body></html>", "Hi\nText of the page, short."),
    "row of links": (f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div class=content><h1>Title of it</h1><p>{T}</p><p>{U}</p></div></body>", f"Title of it\n{T}\n{U}"),
    "table layout": (f"<table><tr><td><a href=/>Home</a><br><a href=/a>About</a></td><td><h1>Old page</h1><p>{T}</p><p>{U}</p></td></tr></table>", f"Old page\n{T}\n{U}"),
    "figure and links": (f"<body><header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><article><h2>Post</h2><p>{T}</p><figure><img src=x><figcaption>A picture of it</figcaption></figure><ul><li><a href=/1>Link one</a></li><li><a href=/2>Link two</a></li></ul><p>{U}</p></article><aside><h3>Related</h3><ul><li><a href=/r>Other story</a></li></ul></aside><footer><p>Imprint</p></footer></body>", f"Post\n{T}\nA picture of it\nLink one\nLink two\n{U}"),
}


def f1(got, want):
    a, b = (Counter(re.findall(r"\w+", x)) for x in (got, want))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_held_out_layouts(spark):
    trees = H.fit(spark.read.parquet(PAGES))
    got = {name: H.main_texts([page], trees)[0] for name, (page, _) in LAYOUTS.items()}
    scores = {name: f1(got[name], want) for name, (_, want) in LAYOUTS.items()}
    assert min(scores.values()) >= 0.8 and np.mean(list(scores.values())) >= 0.9, (scores, got)
    assert not any("Menu" in x or "cookies" in x or "me too" in x for x in got.values())


def nodes(page):
    root = H.parse(page)
    return root, H.features(root)[0]


def test_a_page_with_text_is_never_empty():
    root, own = nodes("<div><nav>menu</nav><p>one</p><p>two</p></div>")
    odds = np.array([0.0, -2.0, -9.0, -3.0, -3.5])
    assert [n.tag for n in own] == ["#root", "div", "nav", "p", "p"]
    assert H.blocks(root, H.choose(own, odds)) == ["one", "two"]
    root, own = nodes("<div>side <p>main</p></div>")
    assert "main" in "".join(H.blocks(root, H.choose(own, np.array([0.0, -5.0, -1.0]))))
    root, own = nodes("<div><p></p></div>")
    assert H.blocks(root, H.choose(own, np.array([0.0, -5.0, -1.0]))) == []
