"""Pages unlike those of the test data, and block accuracy on layouts that the
labeller hasn't seen."""

import numpy as np
import pytest

from colsense.llm import html_extract

P = ["A long paragraph of real text about the matter at hand, with many words in it.", "Another long paragraph follows here with more to say about it all."]
NAV, FOOT = '<nav><a href="#">Home</a><a href="#">News</a></nav>', "<footer>Copyright 2020 Someone</footer>"
PAGES = {
    "list at the end": (f"{NAV}<article><h1>Title of it</h1><p>{P[0]}</p><p>{P[1]}</p><ul><li>first point</li><li>second point here</li><li>third</li></ul></article>{FOOT}",
                        ["Title of it", *P, "first point", "second point here", "third"]),
    "table, list and code": (f'<header><a href="#">Site</a></header><main><h1>How to do it</h1><p>{P[0]}</p><table><tr><th>Key</th><th>Value</th></tr><tr><td>alpha</td><td>12</td></tr>'
                             f"</table><ul><li>note one</li><li>note two</li></ul><pre><code>x = 1</code></pre></main>{FOOT}",
                             ["How to do it", P[0], "Key", "Value", "alpha", "12", "note one", "note two", "x = 1"]),
    "layout table": (f'<table><tr><td><a href="#">Home</a> <a href="#">News</a></td><td><h1>A headline on top</h1><p>{P[0]}</p><p>{P[1]}</p></td></tr></table>',
                     ["A headline on top", *P]),
    "caption": (f'{NAV}<article><h1>Pictures of the town</h1><p>{P[0]}</p><figure><img src="x"><figcaption>The old bridge at noon</figcaption></figure><p>{P[1]}</p></article>'
                '<aside><h3>Related</h3><p>More stories</p></aside><div class="cookie-banner">We use cookies</div>',
                ["Pictures of the town", P[0], "The old bridge at noon", P[1]]),
    "names that say nothing": (f'<div id="a1"><ul><li><a href="#">Home</a></li><li><a href="#">Contact</a></li></ul></div><div id="c17"><h1>The heading of this text</h1><p>{P[0]}</p><p>{P[1]}</p></div>',
                               ["The heading of this text", *P]),
}


@pytest.fixture(scope="module")
def net(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html"))


def test_other_layouts(spark, net):
    pages = spark.createDataFrame([(k, "", f"<html><body>{h}</body></html>") for k, (h, _) in enumerate(PAGES.values())], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(pages, net).collect()}
    for k, (name, (_, want)) in enumerate(PAGES.items()):
        assert got[k] == want, name


def test_accuracy_on_unseen_layouts(spark, net):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").toArrow().to_batches()
    found = [r for b in html_extract._known_blocks(iter(rows)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    good, bad = [g for g, _ in found if g], [x for _, b in found for x in b]
    rng = np.random.default_rng(99)
    right = total = 0
    for _ in range(300):
        x, y = html_extract._layout(rng, good, bad)
        if len(x):
            z, _ = net.logits(x[:, None, :], np.ones((len(x), 1)))
            right, total = right + int(((z[:, 0] > 0) == (y > 0)).sum()), total + len(y)
    print(f"block accuracy on unseen layouts: {right / total:.4f} of {total}")
    assert right / total > 0.97
