"""Labelled pages from which the HTML model is trained, dealt by a seeded rule.

``y="1"`` marks an element of the main text and ``y="0"`` one that isn't;
elements below it inherit the label, others count as 0.  Layouts, names and
lengths vary: the main text stands in an article, in elements with telling,
meaningless or misleading names or with none, or in the body itself, and the
other parts around and inside it do too.
"""

from __future__ import annotations

import random
from collections.abc import Callable

_WORDS = "harbour town keeps two calendars one for the tides and market older people still answer in first when asked second winter boats return late with salt nets lamps along quay children count bells before rain reaches northern wall".split()
_TELLING = {
    "menu": ["menu", "nav main-nav", "navbar", "navigation", "breadcrumb"], "head": ["header", "site-header", "masthead", "banner"], "foot": ["footer", "site-footer", "copyright"],
    "side": ["sidebar", "related", "widget", "aside-box", "share social"], "ad": ["ad", "advert", "ads-top", "sponsored promo", "banner-ad"], "notice": ["cookie-notice", "consent popup", "notice", "newsletter subscribe", "alert"],
    "form": ["search", "login", "signup"], "talk": ["comments", "comment-list", "replies discussion", "respond"], "main": ["content", "post entry-content", "story", "article-body", "main-text", "entry"],
}
_MISLEADING = ["post related-free", "story no-sidebar", "entry shareable ad", "article comment-less", "text with-banner", "no-sidebar", "with-related", "shareable search-result"]


class _Maker:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.marks, self.length = True, 1

    def sentence(self, least: int = 4, most: int = 18) -> str:
        words = self.rng.choices(_WORDS, k=self.rng.randint(least, most))
        return " ".join(words).capitalize() + self.rng.choice(["."] * 8 + ["?", "!", ""]) * self.marks

    def prose(self, least: int, most: int) -> str:
        parts = [self.sentence() for _ in range(self.rng.randint(least, most))]
        if self.rng.random() < 0.2:
            parts.insert(0, f'<a href="/l">{self.sentence(2, 4)}</a>')
        return self.rng.choice(["{}", "{}", "{}", "<b>{}</b>", "<b>{}<br>", "<i>{}</i>"]).format(" ".join(parts))

    def name(self, part: str) -> str:
        """Attributes: telling, meaningless or none."""
        how = self.rng.random()
        if how < 0.2:
            return ""
        meaningless = "".join(self.rng.choices("bcdfghjklmnpqrstvwxz", k=self.rng.randint(2, 6))) + self.rng.choice(["", "-in", "-1", "_box"])
        value = self.rng.choice(_TELLING[part]) if how < 0.75 else meaningless
        return f' {self.rng.choice(["class", "class", "id"])}="{value}"'

    def links(self, least: int = 3, most: int = 9) -> str:
        return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in self.rng.choices(_WORDS, k=self.rng.randint(least, most)))

    def told(self, tag: str, part: str, inner: str) -> str:
        """An element that is known by its tag or by a telling name."""
        named = tag if tag in ("nav", "header", "footer", "aside", "form") else f'{tag} class="{self.rng.choice(_TELLING[part])}"'
        return f'<{named} y="0">{inner}</{tag}>'

    def menu(self) -> str:
        tag = self.rng.choice(["nav", "div", "div", "ul"])
        inner = self.links() if tag == "ul" else f"<ul>{self.links()}</ul>" if self.rng.random() < 0.8 else '<a href="/">Home</a> &gt; <a href="/n">News</a>'
        return f'<{tag}{self.name("menu")} y="0">{inner}</{tag}>'

    def head(self) -> str:
        inner = self.rng.choice(["<h1>The Daily Paper</h1><p>News since 1901</p>", '<a href="/">The Daily Paper</a>', "<p>The Daily Paper</p>"])
        tag = self.rng.choice(["header", "div"])
        return f'<{tag}{self.name("head")} y="0">{inner}</{tag}>'

    def foot(self) -> str:
        inner = self.rng.choice(["&copy; paper.example &middot; All rights reserved", "<p>Copyright paper.example</p><p>Contact and imprint</p>", f"<ul>{self.links()}</ul><p>{self.sentence()}</p>", f"&copy; {self.sentence()} {self.sentence()}"])
        tag = self.rng.choice(["footer", "footer", "div"])
        return f'<{tag}{self.name("foot")} y="0">{inner}</{tag}>'

    def side(self) -> str:
        inner = self.rng.choice([f"<h2>Most read</h2><ul>{self.links()}</ul>", f"<h3>Related</h3><ul>{self.links()}</ul><p>{self.prose(1, 3)}</p>", f'<a href="/a">{self.prose(1, 2)}</a>', '<a href="#">Share</a><a href="#">Post</a>', f"<h3>About</h3><p>{self.prose(1, 4)}</p>"])
        return self.told(self.rng.choice(["aside", "div", "div"]), "side", inner)

    def ad(self) -> str:
        if self.rng.random() < 0.3:  # short enough to be known without a name
            return f'<div{self.name("ad")} y="0">{self.sentence(2, 7)}</div>'
        return self.told(self.rng.choice(["div", "section", "aside"]), "ad", self.rng.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", '<a href="/x">Sale</a>']))

    def notice(self) -> str:
        if self.rng.random() < 0.4:
            return f'<div{self.name("notice")} y="0"><p>{self.sentence()}</p><button>{self.rng.choice(["Accept", "OK", "Go"])}</button></div>'
        return self.told("div", "notice", f"<p>{self.prose(1, 3)}</p>" + self.rng.choice(["", "<button>OK</button>", '<form><input name="m"><button>Go</button></form>']))

    def form(self) -> str:
        return f'<form{self.name("form")} y="0"><label>Search</label><input name="q"><button>Find</button>{self.rng.choice(["", f"<p>{self.prose(1, 2)}</p>", "<select><option>one<option>two</select>", "<textarea>x</textarea>"])}</form>'

    def talk(self) -> str:
        if self.rng.random() < 0.3:  # known by its heading alone
            tag = self.rng.choice(["div", "section", "ul"])
            item = "<li><b>{0}</b> <p>{1}</p></li>" if tag == "ul" else self.rng.choice(["<div><b>{0}</b> <p>{1}</p></div>", "<div><p>{1}</p></div>"])
            each = "".join(item.format(self.rng.choice(_WORDS), self.prose(1, 4)) for _ in range(self.rng.randint(1, 6)))
            heading = self.rng.choice(["{} replies", "{} comments", "Comments ({})", "Discussion", "Replies"]).format(self.rng.randint(1, 40))
            return f'<div{self.rng.choice(["", " id=c12", " class=xq-b"])} y="0"><h3>{heading}</h3>{f"<{tag}>{each}</{tag}>" if tag == "ul" else each}</div>'
        each = "".join(self.rng.choice(['<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", '<article class="comment"><p>{}</p></article>']).format(self.prose(1, 4)) for _ in range(self.rng.randint(1, 5)))
        return self.told(self.rng.choice(["section", "div"]), "talk", f"<h2>Comments</h2>{each}")

    def body(self) -> list[str]:
        """The main text as elements that stand beside each other.

        Some pages have texts without any marks, and some very long paragraphs.
        """
        self.marks, self.length = self.rng.random() < 0.8, self.rng.choice([1, 1, 1, 1, 8])
        rng, out = self.rng, []
        if rng.random() < 0.8:
            title = rng.choice(["h1", "h1", "h2"])
            out.append(f"<{title}>{self.sentence(2, 9)}</{title}>")
        for _ in range(rng.choice([1, 2, 3, 5, 9])):
            how = rng.random()
            if how < 0.75:
                out.append(f"<p>{self.prose(1, 6 * self.length)}</p>")
            elif how < 0.8:
                out.append(f"<p>{self.prose(1, 3)}")
            elif how < 0.84:
                out.append(f"<ul><li>{self.sentence()}</li><li>{self.sentence(2, 5)}</li></ul>")
            elif how < 0.88:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif how < 0.92:
                out.append(f"<h2>{self.sentence(1, 5)}</h2>")
            elif how < 0.95:
                out.append("<table><tr><th>Day</th><th>Tide</th></tr><tr><td>Monday</td><td>three metres</td></tr></table>")
            elif how < 0.97:
                out.append(f"<figure><figcaption>{self.sentence(2, 8)}</figcaption></figure>")
            else:
                out.append(f"<div><p>{self.prose(1, 3)}</p><div><p>{self.prose(1, 3)}</p></div></div>")
        self.marks, self.length = True, 1
        return out

    def framed(self, parts: list[str], inside: str) -> str:
        rng = self.rng
        how = rng.random()
        if how < 0.15:  # in the body itself
            return "".join(p.replace(">", ' y="1">', 1) for p in parts) + inside
        if inside:
            parts = [*parts]
            parts.insert(rng.randint(1, len(parts)), inside)
        if how < 0.5 and rng.random() < 0.3 and parts[0].startswith(("<h1", "<h2")):
            parts = [f"<header>{parts[0]}</header>", *parts[1:]]
        content = "".join(parts)
        if how < 0.3:
            return f'<article y="1">{content}</article>'
        if how < 0.4:
            return f'<main><article{self.name("main")} y="1">{content}</article></main>'
        if how < 0.5:
            tag = rng.choice(["article", "main", "div"])
            return f'<{tag} class="{rng.choice(_MISLEADING[: 5 if tag == "div" else None])}" y="1">{content}</{tag}>'
        tag = rng.choice(["div", "div", "div", "section", "main", "td"])
        main = f'<{tag}{self.name("main")} y="1">{content}</{tag}>'
        main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
        return f'<div{self.name("main")}>{main}</div>' if rng.random() < 0.3 else main

    def page(self) -> str:
        rng = self.rng
        some: Callable[[list[Callable[[], str]], float], str] = lambda makers, p: "".join(m() for m in makers if rng.random() < p)
        inside = rng.choice([lambda: self.told("div", "ad", self.prose(1, 3)), lambda: self.told("div", "ad", f"<p>{self.sentence(2, 5)}</p>"), self.side, self.talk])() if rng.random() < 0.4 else ""
        before = some([self.notice], 0.3) + some([self.head], 0.5) + some([self.menu], 0.8) + some([self.ad], 0.5) + some([self.form], 0.15)
        after = some([self.ad], 0.2) + some([self.side], 0.5) + some([self.talk], 0.4) + some([self.form, self.notice], 0.2) + some([self.foot], 0.85)
        if rng.random() < 0.05:  # nothing but a text
            text = rng.choice(["<br>", "<br><br>\n", "\n"]).join(self.prose(1, 5) for _ in range(rng.randint(1, 6)))
            return f'<html><head><title>t</title></head><body y="1">{text}</body></html>' if rng.random() < 0.5 else text
        whole = before + self.framed(self.body(), inside) + after
        if rng.random() < 0.3:
            whole = f'<div{rng.choice(["", " id=wrap", " class=page"])}>{whole}</div>'
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{whole}</body></html>"


def labelled_pages(n: int = 600, seed: int = 1) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
