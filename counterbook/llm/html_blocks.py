r"""Operator 8: main text of web pages by a recurrent block labeller.

A page is cut into blocks (runs of text between block-level tags). Each block is read as a vector: its tag path with class and id
words (hashed), its words (hashed) and a few measures such as length and share of link text. A
bidirectional LSTM in numpy reads the whole sequence of a page's blocks in both directions, so each block is
classified with all others in view; blocks classified as content make the text.

The labeller is fitted here, on pages that a seeded generator makes: semantic and class-named
layouts, missing end tags, menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside articles.
Fitting takes some seconds, once in a driver process; the weights (under half a MB) go to the tasks with the code.

Defined results: a null or empty page, or one without content blocks, gives the empty text; a page of any length
is read whole; rows with equal ids or pages are extracted one by one; an unclosed comment, script or style reaches to the page's end; an
empty table gives an empty table; columns beside id, url and html are not read.
"""

from __future__ import annotations

import html as html_entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T
from .shared import type_of

# HTML elements that stand inside a line of text, that never hold anything, and whose content is no text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object")
#: Elements that end an open paragraph or list item of their own kind.
ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)>)")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Leaf:
    __slots__ = ("path", "parts", "link")

    def __init__(self, path):
        self.path, self.parts, self.link = path, [], 0


def tag_words(attributes: str) -> tuple[str, ...]:
    found = [x for m in _NAMES.findall(attributes) for x in m if x] if "=" in attributes else []
    return tuple(dict.fromkeys(w.lower() for f in found for w in _WORD.findall(f)))


def leaves(page: str) -> list[tuple[str, tuple[tuple[str, ...], ...], float]]:
    """The page's blocks in order: (text, tag path with class and id words, share of link text)."""
    out: list[tuple[str, tuple, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    leaf: Leaf | None = None
    links, at, n = 0, 0, len(page)

    def close():
        nonlocal leaf
        if leaf is not None:
            text = " ".join("".join(leaf.parts).split())
            if text:
                out.append((text, leaf.path, leaf.link / max(1, sum(map(len, leaf.parts)))))
            leaf = None

    def add(raw):
        nonlocal leaf
        if raw and (leaf is not None or not raw.isspace()):
            if leaf is None:
                leaf = Leaf(tuple((t, *w) for t, w in stack))
            text = html_entities.unescape(raw) if "&" in raw else raw
            leaf.parts.append(text)
            leaf.link += len(text) if links else 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that never ends
            add(rest[: cut.start()] if cut else rest)
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1]:
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        name = m[4].lower()
        if not m[3]:
            if name in RAW:
                if name not in ("svg", "math", "object") or not m[5].endswith("/"):
                    end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                    at = n if end is None else end.end()
                continue
            if name == "br":
                add(" ") if leaf is not None else None
                continue
            if name not in INLINE:
                close()
                opened = [t for t, _ in stack]
                if "p" in opened and name not in VOID:  # a block ends an open paragraph and what stands in it
                    k = len(opened) - 1 - opened[::-1].index("p")
                    if all(t in INLINE for t in opened[k + 1 :]):
                        links = 0
                        del stack[k:]
                elif name in ENDS_ITSELF and opened and opened[-1] == name:
                    stack.pop()
            if name == "a":
                links = 1
            if name not in VOID and not m[5].endswith("/"):
                stack.append((name, tag_words(m[5])))
        else:
            if name not in INLINE:
                close()
            if name == "a":
                links = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE or all(t in INLINE for t, _ in stack[k:]):
                        del stack[k:]
                    break
    close()
    return out


# -- vectors -------------------------------------------------------------------------------------------------------------

PATH_SIZE, WORD_SIZE = 256, 32
MEASURES = 9
INPUT = PATH_SIZE + WORD_SIZE + MEASURES


def vectors(pages: list[list[tuple[str, tuple, float]]], slots: dict[str, int]) -> np.ndarray:
    """A row for each block of the pages, one after the other."""
    blocks = [b for p in pages for b in p]
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x

    def slot(word):
        if word not in slots:
            slots[word] = zlib.crc32(word.encode()) % PATH_SIZE
        return slots[word]

    rows, cols = [], []
    paths: dict[tuple, list[int]] = {}
    for k, (_, path, _) in enumerate(blocks):
        if path not in paths:
            names = {w for element in path for w in (element[0], *("." + c for c in element[1:]))}
            if path:
                names.add("leaf " + next((e[0] for e in reversed(path) if e[0] not in INLINE), "none"))
            paths[path] = sorted({slot(w) for w in names})
        cols += paths[path]
        rows += [k] * len(paths[path])
    x[rows, cols] = 1
    texts = pa.array([b[0] for b in blocks], pa.large_string())
    powers, table = T.Powers(), T.byte_table()
    for lo, hi, data, offsets in T.slices(texts):
        ws, we, wf = T.runs(~T.SPACE[data], offsets)
        owner = T.owners(wf)
        bucket = (T.Hasher(T.lower_az(data), table, powers).of(ws, we) % np.uint64(WORD_SIZE)).astype(np.int64)
        bag = np.bincount(owner * WORD_SIZE + bucket, minlength=(hi - lo) * WORD_SIZE).reshape(hi - lo, WORD_SIZE)
        n = np.diff(wf)
        x[lo:hi, PATH_SIZE : PATH_SIZE + WORD_SIZE] = bag / np.maximum(n, 1)[:, None]
        size = np.diff(offsets)

        def share(mask, offsets=offsets, size=size):
            c = T.counts(mask)
            return (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(size, 1)

        m = x[lo:hi, PATH_SIZE + WORD_SIZE :]
        m[:, 0], m[:, 1] = np.log1p(size) / 6, np.log1p(n) / 5
        m[:, 2], m[:, 3] = share((data == 44) | (data == 46)) * 10, share((data >= 48) & (data < 58))
        last = data[offsets[1:] - 1]
        m[:, 4] = (last == 46) | (last == 33) | (last == 63)
        m[:, 5], m[:, 6] = n <= 3, n >= 15
    x[:, PATH_SIZE + WORD_SIZE + 7] = [b[2] for b in blocks]
    x[:, PATH_SIZE + WORD_SIZE + 8] = np.concatenate([np.arange(len(p)) / len(p) for p in pages if p])
    return x


# -- the network -----------------------------------------------------------------------------------------------------------

HIDDEN = 16


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def new_weights(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"{d}x"] = r.normal(0, 0.08, (INPUT, 4 * HIDDEN)).astype(np.float32)
        w[f"{d}h"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"{d}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    w["out"] = r.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32)
    w["skip"] = r.normal(0, 0.05, (INPUT, 1)).astype(np.float32)
    w["bias"] = np.zeros(1, np.float32)
    return w


def lstm(x, live, wx, wh, wc, keep: bool):
    """States [step, page, HIDDEN] of one direction over x [step, page, INPUT]; ``live`` [step, page] marks real blocks, others leave the state as it is."""
    steps, pages, _ = x.shape
    gates = (x.reshape(-1, x.shape[-1]) @ wx + wc).reshape(steps, pages, -1)
    h = c = np.zeros((pages, HIDDEN), np.float32)
    states, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        g = gates[t] + h @ wh
        i, f, o, u = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, HIDDEN : 2 * HIDDEN]), sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        new = f * c + i * u
        tc = np.tanh(new)
        on = live[t][:, None]
        if keep:
            kept.append((h, c, i, f, o, u, tc))
        c = np.where(on, new, c)
        h = np.where(on, o * tc, h)
        states[t] = h
    return states, kept


def lstm_back(x, live, kept, wh, ds):
    """Gradients of (wx, wh, wc) for the gradients ``ds`` of the states."""
    steps, pages, _ = x.shape
    dg = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((pages, HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, u, tc = kept[t]
        on = live[t][:, None]
        dh = dh + ds[t]
        dnew = dc + dh * o * (1 - tc * tc)
        g = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), dh * tc * o * (1 - o), dnew * i * (1 - u * u)], axis=1) * on
        dg[t] = g
        dwh += h.T @ g
        dh = np.where(on, g @ wh.T, dh)
        dc = np.where(on, dnew * f, dc)
    flat = dg.reshape(-1, dg.shape[-1])
    return x.reshape(-1, x.shape[-1]).T @ flat, dwh, flat.sum(axis=0)


def padded(x: np.ndarray, first: np.ndarray, which: np.ndarray):
    """[step, page, INPUT] and the mask for some pages; ``first`` has each page's first row, and one more."""
    size = np.diff(first)[which]
    steps = int(size.max())
    live = np.arange(steps)[:, None] < size
    at = np.minimum(first[:-1][which][None] + np.arange(steps)[:, None], len(x) - 1)
    return x[at] * live[..., None], live, at


def logits(w, x, live, keep=False):
    a, ka = lstm(x, live, w["fx"], w["fh"], w["fc"], keep)
    b, kb = lstm(x[::-1], live[::-1], w["bx"], w["bh"], w["bc"], keep)
    both = np.concatenate([a, b[::-1]], axis=2)
    return (both @ w["out"] + x @ w["skip"])[..., 0] + w["bias"], both, ka, kb


def fit_labeller(pages: list[list[tuple[str, tuple, float]]], labels: list[np.ndarray], epochs: int = 10, batch: int = 40, rate: float = 0.01, seed: int = 23) -> dict[str, np.ndarray]:
    x = vectors(pages, {})
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    y = np.concatenate(labels).astype(np.float32)
    w, r = new_weights(seed), np.random.default_rng(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = np.argsort(np.diff(first) + r.uniform(0, 8, len(pages)))  # pages of like length together
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        for k in r.permutation(len(batches)):
            step += 1
            xb, live, at = padded(x, first, batches[k])
            drop = r.random((1, xb.shape[1], PATH_SIZE)) < 0.08  # a page without some of its names
            xb[:, :, :PATH_SIZE] *= ~drop
            z, both, ka, kb = logits(w, xb, live, True)
            dz = ((sigmoid(z) - y[at]) * live / live.sum()).astype(np.float32)
            d = dz[..., None] * w["out"][:, 0]
            g = {"out": (both * dz[..., None]).sum((0, 1))[:, None], "skip": (xb * dz[..., None]).sum((0, 1))[:, None], "bias": dz.sum(keepdims=True)[0]}
            g["fx"], g["fh"], g["fc"] = lstm_back(xb, live, ka, w["fh"], d[..., :HIDDEN])
            g["bx"], g["bh"], g["bc"] = lstm_back(xb[::-1], live[::-1], kb, w["bh"], d[::-1, :, HIDDEN:])
            for name, grad in g.items():
                grad = grad + 1e-4 * w[name]
                m, v = state[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def classified(w, pages, slots) -> list[np.ndarray]:
    """The content probability of each block, page by page."""
    x = vectors(pages, slots)
    size = np.array([len(p) for p in pages])
    first = np.concatenate([[0], np.cumsum(size)])
    out = [np.zeros(0)] * len(pages)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + 256)
        while hi > lo + 1 and int(size[order[hi - 1]]) * (hi - lo) > 20_000:  # padded blocks at once
            hi = lo + (hi - lo) // 2
        which = order[lo:hi]
        xb, live, _ = padded(x, first, which)
        p = sigmoid(logits(w, xb, live)[0])
        for k, page in enumerate(which):
            out[page] = p[: size[page], k]
        lo = hi
    return out


# -- pages for fitting ------------------------------------------------------------------------------------------------------

#: Marks of the generator, removed before fitting: content and other text.
YES, NO = "", ""
# Names that page authors give to the parts of a page.
NAMES = {
    "menu": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs toc tabs pagination pager".split(),
    "header": "header masthead top topbar banner logo branding site-header page-header".split(),
    "footer": "footer foot bottom copyright legal site-footer colophon".split(),
    "sidebar": "sidebar side aside related recommended widget popular trending rail more-stories tags".split(),
    "notice": "notice cookie cookies consent gdpr alert message disclaimer subscribe newsletter paywall popup modal".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox".split(),
    "share": "share social sharing follow buttons toolbar meta byline".split(),
    "comments": "comments comment comment-list discussion replies responses disqus reply reader-comments".split(),
    "content": "content article post entry main story body text article-body post-content entry-content main-content".split(),
}


def generated_page(r: random.Random) -> str:
    letters = r.choice(("abcdefghilmnoprstu", "aeiouéèêlmnrstpqu", "aäöüßbehnrstuig", "aíñóeilosrnct"))
    word = lambda: "".join(r.choice(letters) for _ in range(1 + min(11, int(r.expovariate(0.25)))))
    junk = r.random() < 0.2
    odd = ("***", "$$$", "%%%", "&amp;&amp;&amp;", "###", "!!", " |")

    def words(n):
        return " ".join(word() + (r.choice(odd) if junk else "," if r.random() < 0.08 else "." if r.random() < 0.08 else "") for _ in range(n))

    def say(mark, n, stop="."):
        return mark + words(n).capitalize() + stop

    def named(kind, tag=None):
        tag = tag or r.choice({"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "comments": ("section", "div", "aside")}.get(kind, ("div", "section", "aside")))
        plain = tag in ("nav", "header", "footer", "aside") and r.random() < 0.5
        return (f"<{tag}>" if plain else f'<{tag} {r.choice(("class", "class", "id"))}="{r.choice(NAMES[kind])}{r.choice(("", "", " " + word(), "-" + str(r.randint(1, 9))))}">'), f"</{tag}>"

    def menu():
        a, b = named("menu")
        n = r.randint(2, 10)
        items = [f'<a href="/{word()}">{say(NO, r.randint(1, 3), "")}</a>' for _ in range(n)]
        return a + ("<ul>" + "".join(f"<li>{i}" + r.choice(("</li>", "</li>", "")) for i in items) + "</ul>" if r.random() < 0.7 else " ".join(items)) + b

    def some(kind):
        a, b = named(kind)
        parts = []
        for _ in range(r.randint(1, 4)):
            tag = r.choice(("p", "div", "", "", "li", "h3", "span", "p"))
            text = say(NO, r.choice((2, 4, 8, 15, 30)), r.choice((".", "", "!")))
            text = f'<a href="/{word()}">{text}</a>' if r.random() < 0.3 else text
            parts.append(f"<{tag}>{text}</{tag}>" if tag else text)
        return a + ("" if r.random() < 0.5 else " ").join(parts) + b

    def form():
        return f'<form action="/{word()}"><label>{say(NO, r.randint(1, 4), "")}</label><input name="q"><select><option>{say(NO, 1, "")}<option>{say(NO, 1, "")}</select><button>{say(NO, 1, "")}</button></form>'

    def comments():
        a, b = named("comments")
        each = "".join(f'<div class="{r.choice(NAMES["comments"])}">' * (k := r.random() < 0.7) + f"<p>{say(NO, r.choice((4, 10, 25, 50)))}</p>" + "</div>" * k for _ in range(r.randint(1, 6)))
        return a + (f"<h2>{say(NO, 2, '')}</h2>" if r.random() < 0.6 else "") + each + (form() if r.random() < 0.3 else "") + b

    def footer():
        a, b = named("footer")
        return a + f"&copy; {say(NO, r.randint(2, 12))}" + (f" &middot; {say(NO, 5)}" if r.random() < 0.5 else "") + (menu() if r.random() < 0.2 else "") + b

    def header():
        a, b = named("header")
        return a + f"<div>{say(NO, r.randint(1, 5), '')}</div>" * (r.random() < 0.7) + (menu() if r.random() < 0.5 else f"<p>{say(NO, 6)}</p>") + b

    def paragraph():
        kind = r.random()
        n = r.choice((1, 1, 2, 5, 12, 30, 60, 120))
        if kind < 0.72:
            inner = say(YES, n)
            if r.random() < 0.2:
                inner += f' <a href="/{word()}">{words(2)}</a> {words(4)}'
            if r.random() < 0.15:
                return f"<p><b>{inner}<br>"
            return f"<p>{inner}" + r.choice(("</p>", "</p>", "</p>", ""))
        if kind < 0.8:
            return f"<h{(h := r.randint(2, 4))}>{say(YES, r.randint(1, 6), '')}</h{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{say(YES, r.choice((2, 8, 20)))}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{say(YES, n)}</blockquote>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{say(YES, 2, '')}</td><td>{say(YES, 3, '')}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{say(YES, n)}</div>"

    def article():
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        a = f"<{tag}>" if tag in ("article", "main") and r.random() < 0.6 else f'<{tag} {r.choice(("class", "id"))}="{r.choice(NAMES["content"])}">'
        out = [f"<h1>{say(YES, r.randint(2, 12), r.choice(('', '.')))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 4, 8, 15))):
            out.append(paragraph())
            if r.random() < 0.07:
                out.append(r.choice((lambda: some("ad"), lambda: some("share"), lambda: some("notice"), lambda: some("sidebar"), form))())
        if r.random() < 0.1:
            out.append(comments())
        inner = "".join(out)
        if r.random() < 0.25:
            inner = f'<div class="{r.choice(NAMES["content"])}">{inner}</div>'
        return a + inner + f"</{tag}>"

    before, after = [], []
    for part, chance in ((header, 0.45), (menu, 0.75), (lambda: some("notice"), 0.25), (lambda: some("ad"), 0.4), (lambda: some("sidebar"), 0.2), (form, 0.12)):
        if r.random() < chance:
            before.append(part())
    for part, chance in ((lambda: some("share"), 0.2), (lambda: some("sidebar"), 0.3), (comments, 0.3), (lambda: some("ad"), 0.2), (form, 0.1), (lambda: some("notice"), 0.15), (footer, 0.8)):
        if r.random() < chance:
            after.append(part())
    body = "".join([*before, f"<!-- {words(2)} -->", article(), *after])
    if r.random() < 0.25:
        body = f'<div id="{r.choice(("page", "wrapper", "container", "root"))}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{body}" + r.choice(("</body></html>", "</body></html>", ""))


def generated_pages(n: int, seed: int) -> tuple[list, list]:
    r = random.Random(seed)
    pages, labels = [], []
    for _ in range(n):
        found = leaves(generated_page(r))
        pages.append([(t.replace(YES, "").replace(NO, "") or "-", path, link) for t, path, link in found])
        labels.append(np.array([YES in t for t, _, _ in found]))
    return pages, labels


_MODEL: list[dict] = []


def default_labeller() -> dict[str, np.ndarray]:
    if not _MODEL:
        _MODEL.append(fit_labeller(*generated_pages(900, 41)))
    return _MODEL[0]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_blocks, n_content (blocks in the text)."""
    weights = weights or default_labeller()

    def run(batches):
        slots: dict[str, int] = {}
        for batch in batches:
            column, lo = batch.column(2), 0
            while lo < len(batch):
                found, size, hi = [], 0, lo
                while hi < len(batch) and (hi == lo or size < T.SLICE_BYTES):
                    page = column[hi].as_py() or ""
                    found.append(leaves(page))
                    size += len(page)
                    hi += 1
                content = [p >= threshold for p in classified(weights, found, slots)]
                texts = [" ".join(b[0] for b, c in zip(p, k, strict=True) if c) for p, k in zip(found, content, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(p) for p in found], pa.int64()), pa.array([int(c.sum()) for c in content], pa.int64())],
                    ["id", "url", "text", "n_blocks", "n_content"],
                )
                lo = hi

    out = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = type_of(pages, id_col), type_of(pages, url_col)
    return out.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_blocks long, n_content long").withColumnsRenamed({"id": id_col, "url": url_col})
