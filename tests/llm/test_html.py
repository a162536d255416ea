import html
import re

import numpy as np

from counterbook.llm import html_blocks as H
from counterbook.llm import queries
from tests.llm.conftest import SF


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op8_html_blocks"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", article[1])).split()) if article else ""
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_held_out_blocks():
    pages, labels = H.generated_pages(200, 77)
    p = np.concatenate(H.classified(H.default_labeller(), pages, {}))
    assert ((p >= 0.5) == np.concatenate(labels)).mean() > 0.97


def test_context_of_the_whole_page_counts():
    w = H.default_labeller()
    prose = "<p>A line of plain prose that says something about a thing, and then some more of it.</p>"
    page = f'<header><p>Site</p></header><article><h1>Title</h1>{prose * 3}</article><section class="comments">{prose}</section><footer>&copy; x</footer>'
    found = H.leaves(page)
    kept = [t for (t, _, _), p in zip(found, H.classified(w, [found], {})[0]) if p >= 0.5]
    assert kept == [t for t, _, _ in found if t not in ("Site", "© x")][:4]


def test_gradients_are_the_slopes():
    pages, labels = H.generated_pages(3, 5)
    x = H.vectors(pages, {}).astype(float)
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    w = {k: v.astype(float) for k, v in H.new_weights(1).items()}
    xb, live, at = H.padded(x, first, np.arange(3))
    y = np.concatenate(labels)[at]

    def loss(w):
        z = H.logits(w, xb, live)[0]
        return (np.logaddexp(0, z) - y * z)[live].sum()

    z, both, ka, kb = H.logits(w, xb, live, True)
    dz = (H.sigmoid(z) - y) * live
    d = dz[..., None] * w["out"][:, 0]
    gx, gh, gc = H.lstm_back(xb, live, ka, w["fh"], d[..., : H.HIDDEN])
    for name, grad in (("fx", gx), ("fh", gh), ("fc", gc)):
        for spot in list(np.ndindex(*w[name].shape))[::997][:4]:
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name][spot] += 1e-4
            down[name][spot] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - grad[spot]) < 1e-2 * max(1, abs(grad[spot]))


def test_blocks():
    say = lambda page: [t for t, _, _ in H.leaves(page)]
    assert say("a &lt;b&gt; &amp;amp; <b>c</b>d<br>e") == ["a <b> &amp; cd e"]
    assert say("<p>a<script>x < y</script> b") == ["a b"] and say("<style>x") == [] and say("<!-- x") == []
    assert say("<ul><li>a<li>b</ul>c") == ["a", "b", "c"] and say("<p>a<div>b</div>c") == ["a", "b", "c"]
    assert say("1 < 2 <3") == ["1 < 2 <3"] and say("<p") == [] and say("") == [] and say("plain\n text") == ["plain text"]


def test_odd_pages(spark):
    long = "<article>" + "<p>" + "word " * 20_000 + "</p></article>"
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<nav><a>x</a></nav>"), (3, "u", long), (3, "u", long), (4, None, "<article><p>Some text stands here, and it is quite plain.")]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = H.extract(pages).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 0, 45, 99_999, 99_999]
    assert sorted(map(str, (r.url for r in got))) == sorted(str(r[1]) for r in rows)
    assert H.extract(pages.limit(0)).count() == 0
