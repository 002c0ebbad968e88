"""Operator 4: main text of web pages by gradient-boosted trees over DOM nodes.

Every block element is a node with features of its tag, attribute tokens, depth, subtree density,
siblings and ancestors. Two forests are trained on generated pages of many layouts whose main text is
known: one tells whether a subtree holds main text at all, the other whether a node's own text is
main. Decoding is hierarchical: the kept nodes are the ancestor-closed set with the greatest sum of
log odds (a node's value is its own plus its children's where that is positive, else it goes with all
below it), so no kept node stands inside a dropped one. Own texts of kept nodes that the second
forest accepts are joined in page order, one block a line.

Scale: pages are independent, so this is one narrow pass without a shuffle; the forests are some
60 kB, trained once a session from a fixed seed and sent with the task.

Defined results: null and empty pages have the empty text; a page without markup is one block; pages
of any length are read whole; repeated rows give equal results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import boosting
from tessera.llm.dom import FEATURES, Page

TRAIN_PAGES, SEED = 700, 41
#: Marks main text in generated pages; a private-use character.
MARK = "\ue000"
#: Log odds are cut to this size before they are summed, so that no single node outweighs its whole subtree.
CUT = 4.0


class Maker:
    """Generates pages whose main text is marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out, begin = [], True
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice("etaoinshrdlucmé") for _ in range(r.randint(1, 9)))
            stop = r.random()
            out.append((w.capitalize() if begin else w) + ("." if stop < 0.09 else "," if stop < 0.17 else ""))
            begin = stop < 0.09
        return " ".join(out) + r.choice([".", ".", "", "?"])

    def attr(self, *names: str, chance: float = 0.75) -> str:
        r = self.r
        noise = r.choice(["", "", " col-8", " block", " x12", " wrapper", " clearfix", " grid"])
        if not names or r.random() > chance:
            return f' class="{noise.strip()}"' if noise and r.random() < 0.5 else ""
        name = r.choice(names) + r.choice(["", "", "-1", "-box", "-list", "__inner"])
        return r.choice([f' class="{name}{noise}"', f" class='{name}'", f' id="{name}"', f" id={name}"])

    def links(self, n: int) -> str:
        r, items = self.r, []
        for _ in range(n):
            items.append(f'<a href="/{r.randint(1, 99)}">{self.words(1, 3)}</a>')
        kind = r.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{x}" + r.choice(["</li>", "</li>", ""]) for x in items) + "</ul>"
        return r.choice([" ", " | ", ""]).join(items) if kind == 1 else "".join(f"<div>{x}</div>" for x in items)

    def box(self, tags: tuple[str, ...], body: str, *names: str, chance: float = 0.75) -> str:
        tag = self.r.choice(tags)
        must = chance if tag not in ("div", "p", "section", "ul") else max(chance, 0.92)
        return f"<{tag}{self.attr(*names, chance=must)}>{body}</{tag}>"

    def nav(self) -> str:
        return self.box(("nav", "nav", "div", "ul"), self.links(self.r.randint(2, 12)), "nav", "menu", "navigation", "main-menu", "breadcrumbs")

    def advert(self) -> str:
        return self.box(("div", "div", "aside", "section", "p"), self.r.choice([self.words(2, 40), f"<p>{self.words(3, 40)}</p>", f'<a href="/b">{self.words(2, 12)}</a>']), "ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner")

    def notice(self) -> str:
        return self.box(("div", "div", "section", "p", "aside"), self.r.choice([self.words(5, 50), f"<p>{self.words(5, 45)}</p><button>OK</button>"]), "cookie-notice", "notice", "consent", "alert", "gdpr", "cookie-banner")

    def form(self) -> str:
        r = self.r
        inner = f'<label>{self.words(1, 3)}</label><input name="q">' + r.choice(["", f"<p>{self.words(3, 25)}</p>", f"<div>{self.words(2, 10)}</div>"]) + f"<button>{self.words(1, 2)}</button>"
        return r.choice([f"<form{self.attr('search', 'newsletter', 'signup', 'login')}>{inner}</form>", self.box(("div", "section"), f"<form>{inner}</form>", "newsletter", "subscribe", "search")])

    def sidebar(self) -> str:
        r = self.r
        inner = f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(r.randint(2, 9)), f"<p>{self.words(5, 70)}</p>", f"<p>{self.words(5, 40)}</p>" + self.links(4)])
        return self.box(("aside", "aside", "div", "section"), inner, "sidebar", "related", "widget", "side", "popular", "more-stories")

    def comments(self) -> str:
        r, items = self.r, []
        for _ in range(r.randint(1, 7)):
            body = f"<p>{self.words(3, 70)}</p>" if r.random() < 0.8 else self.words(3, 70)
            items.append(r.choice([f"<div{self.attr('comment', 'reply')}>{body}</div>", f"<li>{body}</li>", f"<article{self.attr('comment')}>{body}</article>", body if body[0] == "<" else f"<p>{body}</p>"]))
        return self.box(("section", "div", "ol", "aside"), r.choice(["", f"<h2>{self.words(1, 3)}</h2>"]) + "".join(items), "comments", "comment-list", "discussion", "replies", "respond", chance=1.0)

    def header(self) -> str:
        inner = self.r.choice([f"<div>{self.words(1, 4)}</div>", f"<p>{self.words(1, 12)}</p>", self.words(1, 10), f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 5)}</h2>"])
        return self.box(("header", "header", "div"), inner + (self.nav() if self.r.random() < 0.5 else ""), "header", "masthead", "site-header", "topbar")

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(2, 40)}", f"<p>&copy; {self.words(2, 45)}</p>", f"<p>{self.words(3, 30)}</p>" + self.links(4), self.links(5)])
        return self.box(("footer", "footer", "div"), inner, "footer", "site-footer", "copyright", "bottom")

    def inline(self, t: str) -> str:
        r, w = self.r, t.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(w))
            w[i] = r.choice([f"<b>{w[i]}</b>", f"<a href='/x'>{w[i]}</a>", f"<em>{w[i]}</em>", f"<span>{w[i]}</span>", f"<b>{w[i]}", w[i] + "<br>"])
        return " ".join(w)

    def article(self) -> str:
        r = self.r
        m = lambda low, high: MARK + self.inline(self.words(low, high))
        parts = [f"<h1>{MARK}{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        long = r.choice([(1, 12), (8, 60), (30, 150)])
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 40])):
            x = r.random()
            if x < 0.78:
                parts.append(f"<p>{m(*long)}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""]))
            elif x < 0.84:
                parts.append(f"<h2>{MARK}{self.words(1, 6)}</h2><p>{m(*long)}</p>")
            elif x < 0.89:
                parts.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{m(1, 20)}</li>" for _ in range(r.randint(1, 6)))))
            elif x < 0.92:
                parts.append(f"<blockquote>{r.choice(['', '<p>'])}{m(3, 40)}</blockquote>")
            elif x < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{m(1, 4)}</td><td>{m(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{m(2, 15)}</figcaption></figure>")
            elif x < 0.98:
                parts.append(f"<pre>{m(3, 30)}</pre>")
            else:
                parts.append(f"<div>{m(*long)}</div>")
            y = r.random()
            if y < 0.07:
                parts.append(self.advert())
            elif y < 0.09:
                parts.append(self.sidebar())
            elif y < 0.10:
                parts.append(self.form())
            elif y < 0.115:
                parts.append(self.notice())
        if r.random() < 0.1:
            parts.append(self.comments())
        body = r.choice(["", "\n"]).join(parts)
        kind = r.randrange(9)
        if kind < 3:
            return f"<article{self.attr('post', 'article', 'entry', chance=0.3)}>{body}</article>"
        if kind == 3:
            return f"<main><article>{body}</article></main>"
        if kind == 4:
            return f"<main{self.attr('content', chance=0.4)}>{body}</main>"
        if kind == 5:
            return f"<div{self.attr('content', 'main', 'story', 'entry-content', 'article-body', chance=0.85)}>{body}</div>"
        if kind == 6:
            return f"<div id=main><div class='post'><div class='entry-content'>{body}</div></div></div>"
        return f"<section{self.attr('content', 'article', chance=0.7)}>{body}</section>" if kind == 7 else body

    def page(self) -> str:
        r = self.r
        before = [f() for f, p in ((self.header, 0.55), (self.nav, 0.7), (self.notice, 0.25), (self.advert, 0.5), (self.form, 0.15), (self.sidebar, 0.15)) if r.random() < p]
        after = [f() for f, p in ((self.advert, 0.25), (self.comments, 0.4), (self.sidebar, 0.4), (self.form, 0.25), (self.footer, 0.8), (self.notice, 0.2)) if r.random() < p]
        if r.random() < 0.08:
            before, after = [], []
        if r.random() < 0.2:
            r.shuffle(before)
        core = self.article()
        if r.random() < 0.3:
            side = self.sidebar()
            core = f"<div{self.attr('wrapper', 'container', 'row')}>" + (core + side if r.random() < 0.6 else side + core) + "</div>"
        if r.random() < 0.08:
            core = f"<table><tr><td>{self.links(4)}</td><td>{core}</td></tr></table>"
        gap = r.choice(["", "\n", "<!-- x -->"])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{gap.join([*before, core, *after])}</body></html>"


class Extractor:
    def __init__(self, pages: int = TRAIN_PAGES, seed: int = SEED):
        maker = Maker(seed)
        xs, inside, own, size = [], [], [], []
        for _ in range(pages):
            p = Page(maker.page())
            main = np.array([MARK in t for _, t, _ in p.runs], float)
            owner = np.array([o for o, *_ in p.runs])
            seen = np.concatenate([[0], np.cumsum(main)])
            inside.append(seen[np.array(p.last)] > seen[np.array(p.begin)])
            text = np.array([bool(t.strip()) and t != "\n\0" for _, t, _ in p.runs])
            own.append(np.bincount(owner, main, len(p.tag)) > 0)
            size.append(np.bincount(owner, text, len(p.tag)) > 0)
            p.runs = [(o, t.replace(MARK, ""), a) for o, t, a in p.runs]
            xs.append(p.features())
        x, inside, own, size = np.concatenate(xs), np.concatenate(inside), np.concatenate(own), np.concatenate(size)
        assert x.shape[1] == FEATURES
        self.subtree = boosting.train(x, inside.astype(float))
        self.text = boosting.train(x[size], own[size].astype(float))

    def keep(self, parents: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Nodes whose own text is main. parents: node indexes over all pages at once, -1 for roots, parents first."""
        value = np.clip(self.subtree.log_odds(x), -CUT, CUT)
        total = value.tolist()
        up = parents.tolist()
        for i in range(len(up) - 1, -1, -1):
            if up[i] >= 0 and total[i] > 0:
                total[up[i]] += total[i]
        open_ = [False] * len(up)
        for i, p in enumerate(up):
            open_[i] = p < 0 or (open_[p] and total[i] > 0)
        return np.array(open_, bool) & (self.text.log_odds(x) > 0)

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        if not pages:
            return []
        sizes = np.cumsum([0] + [len(p.tag) for p in pages])
        parents = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + o) for p, o in zip(pages, sizes, strict=False)])
        keep = self.keep(parents, np.concatenate([p.features() for p in pages]))
        out = []
        for s, p, a, b in zip(sources, pages, sizes[:-1], sizes[1:], strict=True):
            k = keep[a:b]
            if len(p.tag) == 1 and "<" not in s:
                k = np.ones(1, bool)
            out.append("\n".join(p.blocks(k)))
        return out


_EXTRACTOR: dict[tuple[int, int], Extractor] = {}


def extractor(pages: int = TRAIN_PAGES, seed: int = SEED) -> Extractor:
    if (pages, seed) not in _EXTRACTOR:
        _EXTRACTOR[pages, seed] = Extractor(pages, seed)
    return _EXTRACTOR[pages, seed]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch: int = 64) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    model = extractor()
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                text = model.texts([s or "" for s in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
