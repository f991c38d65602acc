"""Labelled pages to train the extractor on: pages made by rule, each block known to be main text or not.

Pages differ in which parts they have, in the elements and names that mark the parts, in nesting and in
how well they close their tags. Words are made up, so that the field learns markup and shape, not words.
"""

from __future__ import annotations

import random

# Names that pages commonly give to their parts.
NAMES = {
    "content": "content|article|post|entry|story|main|body|text|article-body|post-content|entry-content|main-content|story-body|page-content",
    "menu": "nav|menu|navbar|navigation|main-nav|topnav|site-nav|breadcrumb|breadcrumbs|links|tabs",
    "header": "header|masthead|site-header|top|banner|logo|branding|topbar|page-header",
    "footer": "footer|site-footer|bottom|copyright|legal|colophon|foot",
    "sidebar": "sidebar|side|aside|widget|widgets|rail|secondary|related|recommended|popular|trending|more|tags|author-box",
    "advert": "ad|ads|advert|advertisement|sponsor|sponsored|promo|promotion|banner-ad|adbox|ad-slot|dfp",
    "notice": "notice|cookie|cookies|cookie-notice|consent|gdpr|alert|banner|popup|modal|overlay|newsletter|subscribe|paywall|warning|privacy",
    "form": "form|login|search|search-form|signup|contact-form|subscribe-form|poll",
    "comments": "comments|comment|comment-list|comment-body|replies|reply|respond|discussion|disqus|responses|comments-area|feedback|reviews",
    "share": "share|social|sharing|share-bar|follow|toolbar|print|meta-links|buttons|pagination|pager",
}
PLAIN = "wrap container row col inner outer box grid page layout site block clearfix module section".split()


class Writer:
    """Writes one page and keeps the label and text of every block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = ["".join(self.r.choice("bcdfghklmnprstvz") + self.r.choice("aeiouéüö") for _ in range(1)) + self.r.choice(["", "n", "r", "s", "t"]) for _ in range(40)]
        self.words = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(300)]
        self.html: list[str] = []
        self.labels: list[int] = []
        self.careless = self.r.random() < 0.3

    def some(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out, start = [], True
        for k in range(n):
            w = self.r.choice(self.words)
            out.append(w.capitalize() if start else w)
            start = False
            if self.r.random() < 0.1 and k < n - 1:
                out[-1] += self.r.choice([".", ".", ",", ",", ",", "?", "&amp;"])
                start = out[-1][-1] in ".?"
        return " ".join(out)

    def sentence(self, low: int, high: int) -> str:
        odd = self.r.random()
        if odd < 0.06:
            return " | ".join(self.r.choice(self.words) for _ in range(self.r.randint(3, high)))
        if odd < 0.12:
            return " ".join(self.r.choice(self.words).upper() + "!!" for _ in range(self.r.randint(3, high)))
        if odd < 0.18:
            return " ".join(self.r.choice(self.words) + self.r.choice(["***", "$$$", "###", "%%%", "&amp;&amp;&amp;"]) for _ in range(self.r.randint(3, high)))
        return self.some(low, high) + self.r.choice([".", ".", ".", "!", "?", "&hellip;", ""])

    def put(self, tag: str, text: str, label: int, attributes: str = "", close: bool = True) -> None:
        self.html.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if close and not (self.careless and tag in ("p", "li", "td")) else ""))
        self.labels.append(label)

    def name(self, part: str) -> str:
        n = self.r.choice(NAMES[part].split("|"))
        style = self.r.random()
        if style < 0.15:
            return f' id="{n}"'
        if style < 0.5:
            n = f"{self.r.choice(PLAIN)} {n}" if self.r.random() < 0.5 else f"{n}-{self.r.choice(PLAIN)}"
        return f' class="{n}"'

    def open(self, part: str, semantic: str | None, sure: float = 0.8) -> str:
        """Opens the element of a part: its semantic element, or a div with a telling name, seldom a plain one."""
        if semantic and self.r.random() < 0.6:
            tag, attributes = semantic, self.name(part) if self.r.random() < 0.4 else ""
        else:
            tag, attributes = self.r.choice(["div", "div", "section"]), self.name(part) if self.r.random() < sure + 0.2 else f' class="{self.r.choice(PLAIN)}"'
        self.html.append(f"<{tag}{attributes}>")
        return f"</{tag}>"

    def links(self, n: int, low: int = 1, high: int = 3) -> None:
        if self.r.random() < 0.7:
            self.html.append("<ul>")
            for _ in range(n):
                self.put("li", f'<a href="/{self.r.choice(self.words)}">{self.some(low, high)}</a>', 0)
            self.html.append("</ul>")
        else:
            self.put("div", self.r.choice([" | ", " ", " &middot; "]).join(f'<a href="#">{self.some(low, high)}</a>' for _ in range(n)), 0)

    def menu(self) -> None:
        end = self.open("menu", "nav")
        self.links(self.r.randint(3, 9))
        self.html.append(end)

    def header(self) -> None:
        end = self.open("header", "header")
        self.put(self.r.choice(["h1", "div", "p", "h2"]), f'<a href="/">{self.some(1, 4)}</a>' if self.r.random() < 0.6 else self.some(1, 5), 0)
        if self.r.random() < 0.5:
            self.put("p", self.some(3, 10), 0)
        if self.r.random() < 0.5:
            self.menu()
        self.html.append(end)

    def footer(self) -> None:
        end = self.open("footer", "footer")
        if self.r.random() < 0.5:
            self.links(self.r.randint(2, 6))
        line = f"&copy; {self.r.choice(self.words)}.example.org &middot; {self.sentence(4, 18)}" if self.r.random() < 0.7 else self.sentence(4, 25)
        if self.r.random() < 0.5:
            self.html.append(line)
            self.labels.append(0)
        else:
            self.put("p", line, 0)
        self.html.append(end)

    def aside(self) -> None:
        end = self.open("sidebar", "aside")
        for _ in range(self.r.randint(1, 3)):
            if self.r.random() < 0.6:
                self.put(self.r.choice(["h2", "h3", "h4", "div"]), self.some(1, 4), 0)
            if self.r.random() < 0.6:
                self.links(self.r.randint(2, 6), 2, 8)
            else:
                self.put("p", self.sentence(6, 30), 0)
        self.html.append(end)

    def filler(self, part: str) -> None:
        end = self.open(part, None, 0.9)
        for _ in range(self.r.randint(1, 2)):
            text = self.sentence(3, 30)
            if self.r.random() < 0.5:
                self.html.append(text)
                self.labels.append(0)
                break
            self.put(self.r.choice(["p", "div"]), text, 0)
        self.html.append(end)

    def form(self) -> None:
        end = self.open("form", "form")
        nested = end != "</form>"
        if nested:
            self.html.append("<form action='/x'>")
        for _ in range(self.r.randint(1, 3)):
            self.put("label", self.some(1, 4), 0)
            self.html.append('<input name="q">')
        self.put("button", self.some(1, 2), 0)
        if self.r.random() < 0.3:
            self.put("p", self.sentence(5, 20), 0)
        if nested:
            self.html.append("</form>")
        self.html.append(end)

    def comments(self) -> None:
        end = self.open("comments", None, 0.95)
        if self.r.random() < 0.7:
            self.put(self.r.choice(["h2", "h3", "div"]), self.some(1, 4), 0)
        listed = self.r.random() < 0.5
        if listed:
            self.html.append("<ol>")
        for _ in range(self.r.randint(1, 5)):
            self.html.append("<li>" if listed else '<div class="comment">')
            if self.r.random() < 0.6:
                self.put("div", self.some(1, 3), 0)
            for _ in range(self.r.randint(1, 2)):
                self.put("p", self.sentence(5, 60), 0)
            self.html.append("</li>" if listed else "</div>")
        if listed:
            self.html.append("</ol>")
        self.html.append(end)

    def article(self) -> None:
        inner = self.r.random()
        ends = [self.open("content", "article" if self.r.random() < 0.7 else "main")]
        if inner < 0.3:
            ends.append(self.open("content", None))
        if self.r.random() < 0.8:
            self.put(self.r.choice(["h1", "h1", "h2"]), self.sentence(1, 14), 1)
        if self.r.random() < 0.15:
            self.filler("share")
        for _ in range(self.r.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            kind = self.r.random()
            if kind < 0.66:
                text = self.sentence(1, 120)
                if self.r.random() < 0.3:
                    cut = text.split(" ")
                    at = self.r.randrange(len(cut))
                    cut[at] = f"<{(t := self.r.choice(['b', 'i', 'em', 'a', 'span']))}>{cut[at]}</{t}>"
                    text = " ".join(cut)
                if self.r.random() < 0.1:
                    self.html.append("<p><b>" + text + "<br>")
                    self.labels.append(1)
                else:
                    self.put("p", text, 1)
            elif kind < 0.74:
                self.put(self.r.choice(["h2", "h3", "h4"]), self.some(1, 9), 1)
            elif kind < 0.82:
                self.html.append("<ul>")
                for _ in range(self.r.randint(1, 5)):
                    self.put("li", self.sentence(1, 25), 1)
                self.html.append("</ul>")
            elif kind < 0.86:
                self.put("blockquote", self.sentence(5, 50), 1)
            elif kind < 0.89:
                self.put("pre", self.some(3, 30), 1)
            elif kind < 0.92:
                self.html.append("<table>")
                for _ in range(self.r.randint(1, 3)):
                    self.html.append("<tr>")
                    for _ in range(self.r.randint(1, 3)):
                        self.put("td", self.some(1, 5), 1)
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif kind < 0.94:
                self.html.append('<figure><img src="x.png">')
                self.put("figcaption", self.sentence(3, 15), 1)
                self.html.append("</figure>")
            elif kind < 0.98:
                self.filler("advert")
            else:
                self.aside()
        if self.r.random() < 0.15:
            self.comments()
        if self.r.random() < 0.1:
            self.filler("share")
        self.html += reversed(ends)

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><title>" + self.some(1, 8) + "</title><style>p{margin:0}</style></head><body>")
        wraps = r.randint(0, 2)
        for _ in range(wraps):
            self.html.append(f'<div class="{r.choice(PLAIN)}">')
        for chance, part in ((0.5, self.header), (0.7, self.menu), (0.2, lambda: self.filler("notice")), (0.3, lambda: self.filler("advert")), (0.15, self.form), (0.15, self.aside)):
            if r.random() < chance:
                part()
        if r.random() < 0.97:
            self.article()
        for chance, part in ((0.3, self.comments), (0.3, self.aside), (0.2, self.form), (0.2, lambda: self.filler("share")), (0.2, lambda: self.filler("advert")), (0.2, self.menu), (0.75, self.footer), (0.1, lambda: self.filler("notice"))):
            if r.random() < chance:
                part()
        self.html.append("</div>" * wraps + ("</body></html>" if r.random() < 0.9 else ""))
        return "".join(self.html), self.labels


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[int]]]:
    """n pages with the label of each leaf block in page order."""
    return [Writer(seed * 1_000_003 + k).page() for k in range(n)]
