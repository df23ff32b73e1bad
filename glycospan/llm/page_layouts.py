"""Page layouts with known main text, for fitting the extractor."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np

#: Put before each run of main text; a private code point that no page should hold.
MARK = "\ue000"

_PLAIN = ["wrap", "row", "col", "box", "inner", "block", "c1", "g2", "x", "unit", "outer", "grid"]
#: Tags and attribute values that parts of a page may have.
_PARTS = {
    "nav": (["nav", "div", "ul", "div"], ["nav", "main-nav", "menu", "navigation", "breadcrumbs", "toolbar"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "top", "topbar"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "legal", "copyright"]),
    "side": (["aside", "div", "section"], ["sidebar", "side", "rail", "widget", "right-rail"]),
    "notice": (["div", "section", "p"], ["cookie-notice", "consent", "alert", "banner", "popup", "message"]),
    "ad": (["div", "aside", "p"], ["ad", "ads", "advert", "sponsored", "promo", "ad-box"]),
    "share": (["div", "ul"], ["share", "social", "follow-us"]),
    "comments": (["section", "div"], ["comments", "comment-list", "discussion", "responses replies"]),
    "related": (["section", "div", "aside"], ["related", "recommended", "more-stories", "popular", "trending"]),
    "form": (["form", "div"], ["search", "login-form", "newsletter", "subscribe", "signup"]),
}
_MAIN = (["article", "main", "div", "section", "div"], ["content", "article", "post", "entry-content", "story", "main-text", "page-body"])


class _Writer:
    def __init__(self, words: list[list[str]], random: np.random.Generator):
        self.pages = [w for w in words if len(w) > 5] or [["lorem", "ipsum,", "dolor", "sit", "amet."] * 40]
        self.random = random

    def one(self, choices):
        return choices[int(self.random.integers(len(choices)))]

    def often(self, share: float) -> bool:
        return bool(self.random.random() < share)

    def some(self, low: int, high: int) -> range:
        return range(int(self.random.integers(low, high + 1)))

    def text(self, low: int, high: int, stop: bool = True) -> str:
        page, size = self.one(self.pages), int(self.random.integers(low, high + 1))
        at = int(self.random.integers(max(1, len(page) - size)))
        text = " ".join(page[at : at + size]).replace(MARK, "")
        if stop and self.often(0.8):
            text = text.rstrip(".,") + "."
        return html.escape(text, quote=False)

    def attributes(self, names: list[str], telling: float) -> str:
        name = self.one(names) if self.often(telling) else self.one(_PLAIN)
        return self.one(["", f' class="{name}"', f' class="{self.one(_PLAIN)} {name}"', f' id="{name}"']) if self.often(0.85) else ""

    def link(self, text: str) -> str:
        return f'<a href="/{int(self.random.integers(1000))}">{text}</a>'

    def part(self, kind: str, telling: float) -> str:
        tags, names = _PARTS[kind]
        tag = self.one(tags) if self.often(telling) else "div"
        if kind in ("nav", "share"):
            items = [self.link(self.text(1, 3, False)) for _ in self.some(2, 9)]
            body = "".join(f"<li>{x}</li>" for x in items) if tag == "ul" or self.often(0.6) else " | ".join(items)
            body = body if tag == "ul" or not body.startswith("<li>") else f"<ul>{body}</ul>"
        elif kind == "header":
            body = f"<h1>{self.text(1, 4, False)}</h1>" * self.often(0.3) + f"<p>{self.text(2, 8)}</p>" * self.often(0.6) + (self.part("nav", telling) if self.often(0.5) else "") or self.text(1, 4)
        elif kind == "footer":
            body = "&copy; " * self.often(0.7) + self.text(2, 14) + "".join(f"<p>{self.link(self.text(1, 3, False))}</p>" for _ in self.some(0, 4))
        elif kind in ("side", "related"):
            heads = "h3" if self.often(0.5) else "h4"
            body = f"<{heads}>{self.text(1, 3, False)}</{heads}>" + "".join(self.one([f"<p>{self.text(5, 30)}</p>", f"<p>{self.link(self.text(3, 9, False))}</p>", f"<ul><li>{self.link(self.text(2, 7, False))}</li></ul>"]) for _ in self.some(1, 6))
        elif kind == "comments":
            body = f"<h3>{self.text(1, 2, False)}</h3>" * self.often(0.6) + "".join(f'<div{self.attributes(["comment", "reply"], telling)}><b>{self.text(1, 2, False)}</b><p>{self.text(4, 60)}</p></div>' for _ in self.some(1, 6))
        elif kind == "form":
            body = f"<label>{self.text(1, 4, False)}</label><input name=q><button>{self.text(1, 2, False)}</button>" + f"<p>{self.text(3, 20)}</p>" * self.often(0.4)
        else:
            body = self.text(4, 35) + (" " + self.link(self.text(1, 3, False)) if self.often(0.4) else "")
            body = f"<p>{body}</p>" if self.often(0.4) and tag != "p" else body
        return f"<{tag}{self.attributes(names, telling)}>{body}</{tag}>"

    def main(self, telling: float) -> str:
        out = []
        if self.often(0.8):
            head = self.one(["h1", "h1", "h2"])
            words = self.one("AQÉÑЖ7") if self.often(0.04) else self.text(1, 14, False)
            title = f"<{head}>{MARK}{words}</{head}>"
            out.append(f"<header>{title}</header>" if self.often(0.15) else title)
        blocks = self.one(["p", "p", "p", "open", "div", "br"])
        sizes = self.one([[(1, 8)], [(5, 25)], [(1, 5), (5, 60), (20, 150)], [(20, 150)]])
        for _ in self.some(1, self.one([3, 14, 14])):
            text = MARK + self.text(*self.one(sizes))
            if self.often(0.15):
                text += " " + self.link(self.text(1, 4, False)) + " " + self.text(3, 20)
            if self.often(0.04):
                text += f' <span class="{self.one(_PARTS["ad"][1])}">{self.text(1, 12)}</span> ' + (MARK + self.text(3, 20)) * self.often(0.5)
            kind = self.one(["list", "quote", "head", "table", "terms", "code", "figure"]) if self.often(0.15) else blocks
            if kind == "list":
                out.append("<ul>" + "".join(f"<li>{MARK}{self.text(2, 20)}</li>" for _ in self.some(2, 6)) + "</ul>")
            elif kind == "quote":
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind == "terms":
                out.append("<dl>" + "".join(f"<dt>{MARK}{self.text(1, 4, False)}<dd>{MARK}{self.text(2, 20)}" for _ in self.some(1, 5)) + "</dl>")
            elif kind == "code":
                out.append(f"<pre>{text}</pre>")
            elif kind == "figure":
                out.append(f"<figure><img src=a.png><figcaption>{MARK}{self.text(2, 20)}</figcaption></figure>")
            elif kind == "head":
                out.append(f"<h2>{MARK}{self.text(1, 8, False)}</h2>")
            elif kind == "table":
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.text(1, 4)}</td><td>{MARK}{self.text(1, 4)}</td></tr>" for _ in self.some(1, 4)) + "</table>")
            else:
                text = f"<b>{text}</b>" if self.often(0.1) else text
                out.append({"p": f"<p>{text}</p>", "open": f"<p>{text}", "div": f"<div>{text}</div>", "br": f"{text}<br><br>"}[kind])
            if self.often(0.06):
                out.append(self.part(self.one(["ad", "share", "related", "form"]), telling))
        tags, names = _MAIN
        body = "".join(out)
        if self.often(0.25):  # an article without a container
            return body
        tag = self.one(tags) if self.often(telling) else "div"
        page = f"<{tag}{self.attributes(names, telling)}>{body}</{tag}>"
        for _ in self.some(0, 2):
            page = f"<div{self.attributes(['main', 'content', 'page'], telling)}>{page}</div>"
        return page

    def page(self) -> str:
        telling = self.one([1.0, 1.0, 0.8, 0.5, 0.0])
        before = [self.part(k, telling) for k in ("notice", "header", "nav", "ad", "form", "side") if self.often(0.5)]
        after = [self.part(k, telling) for k in ("share", "comments", "related", "ad", "side", "form", "nav", "footer", "notice") if self.often(0.45)]
        if self.often(0.2):  # nothing but the article
            before, after = [], []
        head = f"<head><title>{self.text(2, 10, False)}</title><script>var a='<p>';</script></head>"
        body = "".join(before) + (self.main(telling) if self.often(0.97) else "") + "".join(after)
        # browsers put in a head, a body and a root that are not there
        return self.one([f"<html>{head}<body>{body}</body></html>"] * 4 + [f"<html><body>{body}</body></html>", f"<body>{body}</body>", body])


def layouts(words: list[list[str]], count: int, seed: int) -> Iterator[str]:
    """Pages made of the given words, in which each run of main text holds a MARK."""
    writer = _Writer(words, np.random.default_rng(seed))
    for _ in range(count):
        yield writer.page()
