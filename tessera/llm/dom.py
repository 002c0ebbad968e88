"""A small HTML reader: block elements as nodes in page order, the texts that they own, and features of each node.

Reading is one scan with a cursor that never moves back, and the open elements are looked up by name, so the time
grows with the page and not with its mistakes. A quote inside an unquoted value is an ordinary character, and a value whose
quote never closes is unquoted; from the first tag that never ends, tags end at the next ``>``, whatever is quoted; without one, the rest is text.
A comment, script or style without an end reaches to the end of the page; any other unclosed element is only its tag.
"""

from __future__ import annotations

import html
import re

import numpy as np

#: Elements without content; elements whose text is never shown or only labels a control.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "svg", "iframe", "canvas", "video", "audio", "head", "select", "textarea", "button", "datalist", "title")
#: Without an end tag, these reach to the end of the page; of the others of RAW only the tag is passed over.
UNCLOSED = ("script", "style")
#: What can stand in a head, which may have no end tag: it ends before any other element, or before text.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input acronym picture output meter progress map area nobr object noscript math".split()) | frozenset(
    "mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom merror mprescripts mmultiscripts semantics annotation".split()
)
#: An opening tag of the key closes an open element of the values.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",),
}
#: Where the search for an element to close ends.
SCOPE = frozenset("html body table td th ul ol dl article section div aside nav header footer main form blockquote figure".split())
GROUPS = (
    ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tfoot", "tr"), ("td", "th", "caption"),
    ("article",), ("main",), ("section",), ("div", "center"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog"), ("figure", "figcaption", "details", "summary"), ("body",),
)
#: Attribute tokens by what they speak for; compared as whole tokens of id, class, role and aria-label values.
TOKENS = (
    frozenset("article content post entry story text body main prose articlebody maincontent".split()),
    frozenset("nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip".split()),
    frozenset("footer copyright colophon legal bottom".split()),
    frozenset("header masthead banner top logo topbar branding".split()),
    frozenset("sidebar aside side rail widget related recommended popular more trending complementary".split()),
    frozenset("ad ads adv advert advertisement sponsor sponsored promo promotion promoted banner billboard adsense".split()),
    frozenset("comment comments reply replies discussion respond disqus commentlist".split()),
    frozenset("cookie cookies consent notice alert gdpr warning message paywall announcement popup modal overlay".split()),
    frozenset("share social follow newsletter subscribe subscription signup login search form contact tags meta byline author".split()),
)
FEATURES = 2 * (len(GROUPS) + len(TOKENS)) + 17
_NAME = re.compile(r"</?+([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+>")
_ATTR = re.compile(r"(?:^|\s)(?:id|class|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_RAW = frozenset(RAW)
_SPLIT = re.compile(r"[^a-z0-9]+")
_END = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*+>", re.I) for t in UNCLOSED}
_LONG_REF = re.compile(r"&#(?=[0-9])0*+([0-9]*+)")
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}


def decoded(t: str) -> str:
    """Character references of a text as characters; a number beyond all characters stays one, however long."""
    if "&" not in t:
        return t
    return html.unescape(_LONG_REF.sub(lambda m: "&#" + (m[1][:8] or "0"), t) if "&#" in t else t)


def pieces(s: str) -> list[tuple[str, str, str]]:
    """A page as ("", text, "") and (name, attributes, kind) with kind "open", "self" or "close"; comments, scripts and styles are left out, the latter two as "raw"."""
    out: list[tuple[str, str, str]] = []
    at, begin, n, whole = 0, 0, len(s), True
    last = {x: s.rfind(x) for x in (">", "-->", "]]>")}
    while (lt := s.find("<", at)) >= 0:
        at = lt + 1
        if s.startswith("<!--", lt):
            end = s.find("-->", lt + 2) + 3 if last["-->"] >= lt + 2 else n
        elif s.startswith("<![CDATA[", lt) and last["]]>"] > lt:
            end = s.find("]]>", lt) + 3
        elif lt > last[">"]:
            break
        elif s[at : at + 1] in ("!", "?") or (s[at : at + 1] == "/" and not s[at + 1 : at + 2].isalpha()):
            end = s.find(">", at) + 1
        elif name := _NAME.match(s, lt):
            inside = _INSIDE.match(s, name.end()) if whole else None
            whole = inside is not None
            end = inside.end() if inside else s.find(">", name.end()) + 1
            tag, attrs = name[1].lower(), s[name.end() : end - 1]
            out.append(("", s[begin:lt], ""))
            if s[at] == "/":
                out.append((tag, "", "close"))
            elif tag in UNCLOSED:
                out.append((tag, "", "raw"))
                e = _END[tag].search(s, end)
                end = e.end() if e else n
            else:
                out.append((tag, attrs, "self" if attrs.endswith("/") else "open"))
            begin = at = end
            continue
        else:
            continue
        out.append(("", s[begin:lt], ""))
        begin = at = end
    out.append(("", s[begin:], ""))
    return out


def closings(parts: list[tuple[str, str, str]]) -> dict[int, int]:
    """Where each element of RAW that has an end tag of its own ends."""
    out, begun = {}, {t: [] for t in RAW}
    for i, (tag, _, kind) in enumerate(parts):
        if tag in begun:
            if kind == "open":
                begun[tag].append(i)
            elif kind == "close" and begun[tag]:
                out[begun[tag].pop()] = i
    return out


def head_end(parts: list[tuple[str, str, str]], at: int, ends: dict[int, int]) -> int:
    """The first piece after the head that begins at ``at``: after its end tag, or the first text or element that cannot stand in it."""
    i = at + 1
    while i < len(parts):
        tag, text, kind = parts[i]
        if not tag and text.strip():
            return i
        if tag == "head" and kind == "close":
            return i + 1
        if tag and tag not in IN_HEAD and not (kind == "close" and tag not in ("body", "html", "br")):
            return i
        i = ends.get(i, i) + 1
    return i


class _Open:
    """The open elements, with the places of each name, of the blocks and of those that end a search."""

    def __init__(self):
        self.name, self.node = ["#root"], [0]
        self.at: dict[str, list[int]] = {}
        self.blocks, self.scopes, self.links = [0], [0], 0

    def push(self, tag: str, node: int) -> None:
        i = len(self.name)
        self.name.append(tag)
        self.node.append(node)
        self.at.setdefault(tag, []).append(i)
        if tag not in INLINE:
            self.blocks.append(i)
        if tag in SCOPE:
            self.scopes.append(i)
        self.links += tag == "a"

    def pop_to(self, i: int, ended: list[int], now: int) -> None:
        """Closes the elements from i on; the blocks among them end at run ``now``."""
        while len(self.name) > i:
            tag, node = self.name.pop(), self.node.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                ended[node] = now
            if tag in SCOPE:
                self.scopes.pop()
            self.links -= tag == "a"

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in names if self.at.get(t)), default=0)


class Page:
    """Block nodes of a page: tag, parent (-1 for the root), depth, attribute token bits; and text runs with their owners."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.bits = ["#root"], [-1], [0], [0]
        self.begin, self.last = [0], [0]
        #: (owner node, text, in a link)
        self.runs: list[tuple[int, str, bool]] = []
        self._read(pieces(source))

    def _node(self, tag: str, attrs: str, up: int) -> int:
        bits = 0
        if attrs:
            for v in _ATTR.findall(attrs):
                for w in _SPLIT.split(_CAMEL.sub(" ", v).lower()):
                    if w:
                        for j, t in enumerate(TOKENS):
                            if w in t:
                                bits |= 1 << j
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.bits.append(bits)
        self.begin.append(len(self.runs))
        self.last.append(len(self.runs))
        return len(self.tag) - 1

    def _read(self, parts: list[tuple[str, str, str]]) -> None:
        stack, ends, i = _Open(), closings(parts), 0
        run = lambda t, link=False: self.runs.append((stack.node[-1], t, link))
        close = lambda at: stack.pop_to(at, self.last, len(self.runs))
        while i < len(parts):
            tag, content, kind = parts[i]
            i += 1
            if not tag:
                if content:
                    run(decoded(content), stack.links > 0)
            elif kind == "close":
                at = stack.last((tag,))
                if at and (tag not in INLINE or at > stack.blocks[-1]):
                    close(at)
                if tag not in INLINE:
                    run("\n\0")
            elif tag == "head":
                i = head_end(parts, i - 1, ends)
                run(" ")
            elif tag in _RAW:
                i = ends.get(i - 1, i - 1) + 1
                run(" ")
            elif tag in VOID:
                run(" " if tag in INLINE else "\n\0")
            elif tag in INLINE:
                stack.push(tag, stack.node[-1])
            else:
                for names in (("p",), *(CLOSES[tag],) * 3) if tag in CLOSES else (("p",),):
                    at = stack.last(names)
                    if at and at >= stack.scopes[-1]:
                        close(at)
                stack.push(tag, self._node(tag, content, stack.node[-1]))
        close(1)
        self.last[0] = len(self.runs)

    def blocks(self, keep: np.ndarray) -> list[str]:
        """Texts of consecutive runs of one owner between block boundaries, for the owners to keep."""
        out, now, owner = [], [], None
        for node, t, _ in self.runs:
            if node != owner or t == "\n\0":
                if now:
                    out.append((owner, " ".join("".join(now).split())))
                now, owner = [], node
            if t != "\n\0":
                now.append(t)
        if now:
            out.append((owner, " ".join("".join(now).split())))
        return [t for o, t in out if t and keep[o]]

    def features(self) -> np.ndarray:
        """One row for each node; sums over subtrees come from the runs that a node spans."""
        n = len(self.tag)
        parent, depth = np.array(self.parent), np.array(self.depth)
        size = np.array([len(t.strip()) if t != "\n\0" else 0 for _, t, _ in self.runs] or [0], float)
        link = np.array([a for *_, a in self.runs] or [False])
        stop = np.array([t.count(".") + t.count("!") + t.count("?") for _, t, _ in self.runs] or [0], float)
        comma = np.array([t.count(",") for _, t, _ in self.runs] or [0], float)
        total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[np.array(self.last)] - c[np.array(self.begin)]
        chars, linked, stops, commas = total(size), total(size * link), total(stop), total(comma)
        own = np.bincount([o for o, *_ in self.runs] or [0], weights=size, minlength=n)
        below, kids, paragraphs = np.ones(n), np.zeros(n), np.array([t == "p" for t in self.tag], float)
        rank, seen = np.zeros(n), {}
        for i in range(n - 1, 0, -1):
            below[parent[i]] += below[i]
            paragraphs[parent[i]] += paragraphs[i]
            kids[parent[i]] += 1
        for i in range(1, n):
            rank[i] = seen.get(parent[i], 0)
            seen[parent[i]] = rank[i] + 1
        kind = np.array([_GROUP.get(t, -1) for t in self.tag])
        hot = (kind[:, None] == np.arange(len(GROUPS))).astype(float)
        bits = ((np.array(self.bits)[:, None] >> np.arange(len(TOKENS))) & 1).astype(float)
        mine = np.concatenate([hot, bits], axis=1)
        above = np.zeros_like(mine)
        for i in range(1, n):
            above[i] = np.maximum(above[parent[i]], mine[parent[i]])
        up = np.maximum(parent, 0)
        whole = max(1.0, chars[0])
        runs = max(1, len(self.runs))
        extra = np.stack(
            [
                depth, np.log1p(chars), chars / whole, linked / np.maximum(chars, 1), np.log1p(below), np.log1p(chars / below), np.log1p(own), np.log1p(kids), rank / np.maximum(kids[up], 1),
                np.log1p(rank), paragraphs / below, np.log1p(paragraphs), chars / np.maximum(chars[up], 1), np.array(self.begin) / runs, np.array(self.last) / runs, stops / np.maximum(chars, 1) * 100, commas / np.maximum(chars, 1) * 100,
            ],
            axis=1,
        )
        return np.concatenate([mine, above, extra], axis=1)
