"""A grammar of page layouts that writes pages together with the label of each block.

It stands in for labelled pages, of which there are none: an article in one of many wrappers, and
around and inside it what pages carry besides. Texts are invented words, so that the labeller can't
lean on a language; only menus, notices, forms and the like use words of their own now and then.
"""

from __future__ import annotations

import numpy as np

# What such parts are called, and words they use.
MENU = "nav menu navbar navigation main-menu top-menu site-nav topnav links primary-nav".split()
HEADER = "header site-header masthead top banner-top branding page-header logo tagline".split()
FOOTER = "footer site-footer page-footer bottom colophon copyright legal credits".split()
SIDEBAR = "sidebar side aside widget widget-area rail right-col related related-posts recent popular trending recommended more-stories tags archive toc".split()
NOTICE = "notice cookie cookie-banner consent gdpr alert popup modal overlay banner message toast paywall disclaimer notification".split()
ADVERT = "ad ads advert advertisement sponsored promo promoted adsense ad-slot banner-ad adbox partner-content sponsor promotion".split()
FORM = "form newsletter subscribe signup search search-form login contact-form".split()
COMMENTS = "comments comment-list commentlist responses discussion disqus replies reader-comments comment-section user-comments".split()
COMMENT = "comment reply response comment-body comment-text comment-content message-body".split()
SHARE = "share social share-bar social-links sharing follow".split()
CRUMBS = "breadcrumb breadcrumbs crumbs path".split()
META = "byline meta post-meta author date published timestamp dateline".split()
ARTICLE = "article post entry content post-content entry-content article-body story story-body main-content text body-text post-body article-content".split()
NEUTRAL = "container wrapper row col inner box section block clearfix group grid layout page".split()
WORDS_OF = {
    "menu": "home about contact news sports blog login search products services help faq shop archive".split(),
    "footer": "copyright © all rights reserved privacy policy terms of use contact imprint sitemap inc ltd".split(),
    "notice": "we use cookies to improve your experience accept settings privacy consent by continuing please enable javascript".split(),
    "ad": "advertisement sponsored buy now save off deal offer free trial shop today order limited".split(),
    "form": "email name password submit search subscribe sign up newsletter send your enter remember me".split(),
    "comment": "reply says posted ago like report thanks great article agree comment comments leave a guest".split(),
    "side": "related posts popular recent trending read more tags categories archive recommended you may also".split(),
    "share": "share tweet facebook email print whatsapp follow us copy link".split(),
}
SYLLABLES = "an be ca de er fo ga hi in jo ka le mi no or pa qu re sa ti un ve wa xi ye zo th sh ch st nd ing tion ment é è ç ü ö ß ñ ó".split()


class Writer:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.html: list[str] = []
        self.labels: list[int] = []
        self.bare = rng.random() < 0.15  # a page without telling names
        style = rng.random()
        self.mark = "" if style < 0.8 else self.pick(["!!", "***", "&amp;&amp;&amp;", "%%%", " |", "$$$"])
        self.odd_entries, self.terse = rng.random() < 0.4, rng.random() < 0.3
        self.echo = self.words(1, 4).capitalize() + "." if rng.random() < 0.12 else ""
        self.upper = rng.random() < 0.06

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, items):
        return items[self.rng.integers(len(items))]

    def count(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(self.count(1, 4)))

    def words(self, low: int, high: int, kind: str = "", share: float = 0.0) -> str:
        out = [self.pick(WORDS_OF[kind]) if kind and self.chance(share) else self.word() for _ in range(self.count(low, high))]
        return " ".join(out)

    def sentences(self, low: int, high: int, kind: str = "", share: float = 0.0) -> str:
        out = []
        for _ in range(self.count(low, high)):
            s = self.words(1, 18, kind, share)
            if self.mark and not kind:
                s = " ".join(w + self.mark for w in s.split())
            out.append((s.upper() if self.upper and not kind else s[0].upper() + s[1:]) + ".")
        return " ".join(out)

    def open(self, tag: str, names: list[str] | None = None) -> str:
        if not names or self.bare or self.chance(0.1):
            return f"<{tag}>"
        name = self.pick(names)
        if self.chance(0.25):
            name = f"{self.pick(NEUTRAL)} {name}" if self.chance(0.5) else f"{self.pick(['js', 'c', 'x', 'the', 'w'])}-{name}"
        key = self.pick(["class", "class", "id"])
        extra = ' style="margin:0"' if self.chance(0.1) else ""
        return f'<{tag} {key}="{name}"{extra}>'

    def leaf(self, before: str, text: str, after: str, label: int) -> None:
        self.html.append(f"{before}{text}{after}")
        self.labels.append(label)

    def raw(self, text: str) -> None:
        self.html.append(text)

    def space(self) -> None:
        self.raw(self.pick(["", "\n", "\n  ", " "]))

    # Parts that are not main text.

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def entry(self, low: int, high: int, kind: str, share: float) -> str:
        text = self.words(low, high, kind, share)
        if self.odd_entries:
            text = self.pick([text, text.capitalize(), text + ".", text + ",", self.sentences(1, 2), self.words(1, 1) + self.mark])
        return text

    def link_list(self, kind: str, low: int = 3, high: int = 9, share: float = 0.5) -> None:
        tag = self.pick(["ul", "ul", "ol"])
        self.raw(f"<{tag}>")
        for _ in range(self.count(low, high)):
            self.leaf("<li>", self.link(self.entry(1, 4, kind, share)), self.pick(["</li>", "</li>", ""]), 0)
            self.space()
        self.raw(f"</{tag}>")

    def menu(self) -> None:
        tag = self.pick(["nav", "nav", "nav", "div", "ul"])
        if tag == "ul":
            self.raw(self.open("ul", MENU))
            for _ in range(self.count(3, 8)):
                self.leaf("<li>", self.link(self.entry(1, 3, "menu", 0.4)), "</li>", 0)
            self.raw("</ul>")
            return
        self.raw(self.open(tag, MENU if tag == "div" or self.chance(0.4) else None))
        if self.chance(0.75):
            self.link_list("menu", share=self.pick([0.0, 0.6]))
        else:
            self.leaf("", " ".join(self.link(self.words(1, 2, "menu", 0.4)) for _ in range(self.count(3, 8))), "", 0)
        self.raw(f"</{tag}>")

    def header(self) -> None:
        tag = self.pick(["header", "header", "div"])
        self.raw(self.open(tag, HEADER if tag == "div" or self.chance(0.5) else None))
        self.leaf(self.open(self.pick(["div", "p"]), HEADER), self.words(1, 4), self.pick(["</div>", "</p>"]), 0) if self.chance(0.5) else self.leaf(
            "<h1>" if self.chance(0.4) else "<h2>", self.words(1, 4), "</h1></h2>", 0
        )
        if self.chance(0.4):
            self.leaf("<p>", self.sentences(1, 1) if self.chance(0.5) else self.words(3, 8), "</p>", 0)
        if self.chance(0.5):
            self.menu()
        if self.chance(0.2):
            self.form()
        self.raw(f"</{tag}>")

    def footer(self) -> None:
        tag = self.pick(["footer", "footer", "footer", "div"])
        self.raw(self.open(tag, FOOTER if tag == "div" or self.chance(0.4) else None))
        if self.chance(0.4):
            self.link_list("footer")
        for _ in range(self.count(1, 3)):
            wrap = self.pick([("<p>", "</p>"), ("<div>", "</div>"), ("<small>", "</small><hr>"), ("", "<hr>")])
            text = f"&copy; {self.word()}.example.com &middot; {self.sentences(1, 2)}" if self.chance(0.4) else (
                self.sentences(1, 2, "footer", self.pick([0.0, 0.5])) if self.chance(0.7) else self.words(2, 8, "footer", 0.7))
            self.leaf(wrap[0], text, wrap[1], 0)
        self.raw(f"</{tag}>")

    def sidebar(self) -> None:
        tag = self.pick(["aside", "aside", "div", "section"])
        self.raw(self.open(tag, SIDEBAR if tag != "aside" or self.chance(0.5) else None))
        for _ in range(self.count(1, 3)):
            if self.chance(0.6):
                self.leaf(self.pick(["<h2>", "<h3>", "<h4>"]), self.words(1, 4, "side", 0.5), self.pick(["</h2>", "</h3>", "</h4>"]), 0)
            if self.chance(0.5):
                self.link_list("side", share=0.2)
            else:
                self.leaf("<p>", self.sentences(1, 4, "side", self.pick([0.0, 0.2])), "</p>", 0)
        self.raw(f"</{tag}>")

    def notice(self) -> None:
        tag = self.pick(["div", "div", "section", "p", "dialog"])
        self.raw(self.pick(["<dialog>", "<dialog open>"]) if tag == "dialog" else f'<{tag} {self.pick(["class", "id", "role"])}="{self.pick(NOTICE)}">')
        if tag == "p":
            self.leaf("", self.sentences(1, 3, "notice", self.pick([0.0, 0.5])), "", 0)
        else:
            for _ in range(self.count(1, 2)):
                self.leaf("<p>" if self.chance(0.6) else "<div>", self.sentences(1, 3, "notice", self.pick([0.0, 0.5])), "</p></div>", 0)
                self.raw(f'<{tag} class="{self.pick(NOTICE)}">')
            if self.chance(0.5):
                self.leaf("<button>", self.words(1, 2, "notice", 0.5), "</button>", 0)
            for _ in range(3):
                self.raw(f"</{tag}>")
            return
        self.raw(f"</{tag}>")

    def advert(self) -> None:
        tag = self.pick(["div", "div", "div", "section", "aside", "ins"])
        self.raw(f'<div {self.pick(["class", "id"])}="{self.pick(ADVERT)}">' if tag == "ins" else f'<{tag} {self.pick(["class", "class", "id"])}="{self.pick(ADVERT)}">')
        if self.chance(0.6):
            self.leaf("", self.sentences(1, 4, "ad", self.pick([0.0, 0.0, 0.3])), "", 0)
        else:
            for _ in range(self.count(1, 3)):
                self.leaf("<p>", self.sentences(1, 3, "ad", self.pick([0.0, 0.3])), "</p>", 0)
        self.raw("</div>" if tag == "ins" else f"</{tag}>")

    def form(self) -> None:
        self.raw(self.open("form", FORM))
        for _ in range(self.count(1, 4)):
            kind = self.pick(["label", "p", "option", "button", "legend"])
            before, after = {"option": ("<select><option>", "</option></select>")}.get(kind, (f"<{kind}>", f"</{kind}>"))
            text = self.sentences(1, 2, "form", 0.2) if kind == "p" else self.words(1, 4, "form", 0.5)
            self.leaf(before, text, after, 0)
            if self.chance(0.5):
                self.raw('<input type="text" name="q">')
        self.raw("</form>")

    def comments(self) -> None:
        tag = self.pick(["div", "section", "ol", "ul", "aside"])
        self.raw(f'<{tag} {self.pick(["class", "id"])}="{self.pick(COMMENTS)}">')
        inner = "li" if tag in ("ol", "ul") else self.pick(["div", "article", "div", "section"])
        if inner != "li" and self.chance(0.6):
            self.leaf("<h3>", self.words(1, 3, "comment", 0.7), "</h3>", 0)
        for _ in range(self.count(1, 6)):
            self.raw(self.open(inner, COMMENT))
            if self.chance(0.6):
                self.leaf(self.pick(["<div>", "<p>"]), self.words(1, 4, "comment", 0.3), "</p></div>" if inner != "div" else "", 0)
            for _ in range(self.count(1, 3)):
                self.leaf("<p>", self.sentences(1, 5, "comment", self.pick([0.0, 0.1])), "</p>", 0)
            self.raw(f"</{inner}>")
        if self.chance(0.4) and inner != "li":
            self.form()
        self.raw(f"</{tag}>")

    def small(self) -> None:
        names, kind = self.pick([(SHARE, "share"), (CRUMBS, "menu"), (META, "comment")])
        text = " ".join(self.link(self.words(1, 2, kind, 0.5)) for _ in range(self.count(2, 5)))
        self.leaf(f'<div class="{self.pick(names)}">', text if names is not META else self.words(2, 5, kind, 0.3), "</div>", 0)

    # The article.

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.count(0, 2)):
            k = self.count(0, len(words) - 1)
            words[k] = self.pick([f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", self.link(words[k]), f"<span>{words[k]}</span>", f"{words[k]}<br>"])
        return " ".join(words)

    def main(self) -> None:
        wrappers = self.pick([["article"], ["article"], ["article"], ["main"], ["main", "article"], ["div"], ["div", "div"], ["section"], ["main", "div"], ["div", "article"]])
        names = [self.open(t, ARTICLE if k == len(wrappers) - 1 or self.chance(0.4) else NEUTRAL) for k, t in enumerate(wrappers)]
        if wrappers in (["div"], ["div", "div"], ["section"]) and not self.bare:
            names[-1] = f'<{wrappers[-1]} {self.pick(["class", "id"])}="{self.pick(ARTICLE)}">'
        for n in names:
            self.raw(n)
        if self.chance(0.8):
            level = self.pick(["h1", "h1", "h2"])
            self.leaf(f"<{level}>", self.sentences(1, 2) if self.chance(0.5) else self.words(1, 12), f"</{level}>", 1)
        if self.chance(0.15):
            self.small()
        odd = self.chance(0.25)
        for k in range(self.count(15, 70) if self.chance(0.15) else self.count(1, 12)):
            kind = self.rng.random()
            if k == 0 and odd:
                self.leaf("<p><b>", self.sentences(1, 4), "<br>", 1)
            elif kind < 0.72:
                text = self.echo if self.echo and self.chance(0.8) else self.words(1, 3).capitalize() + "." if self.chance(0.5 if self.terse else 0.15) else self.sentences(1, 8)
                self.leaf("<p>", self.inline(text), self.pick(["</p>", "</p>", "</p>", ""]), 1)
            elif kind < 0.8:
                self.leaf("<h2>", self.words(1, 6), "</h2>", 1)
            elif kind < 0.86:
                self.raw("<ul>")
                for _ in range(self.count(2, 5)):
                    self.leaf("<li>", self.words(2, 12), "</li>", 1)
                self.raw("</ul>")
            elif kind < 0.9:
                self.leaf("<blockquote>", self.sentences(1, 3), "</blockquote>", 1)
            elif kind < 0.93:
                self.raw("<table><tr>")
                for _ in range(self.count(2, 5)):
                    self.leaf("<td>", self.words(1, 4), "</td>", 1)
                self.raw("</tr></table>")
            elif kind < 0.95:
                self.leaf("<pre>", self.words(3, 9), "</pre>", 1)
            elif kind < 0.97:
                self.raw("<figure><img src='a.png'>")
                self.leaf("<figcaption>", self.words(3, 9), "</figcaption></figure>", 1)
            else:
                self.leaf("<div>", self.sentences(1, 4), "</div>", 1)
            if self.chance(0.06):
                self.pick([self.advert, self.advert, self.sidebar, self.notice, self.form])()
            self.space()
        for t in reversed(wrappers):
            self.raw(f"</{t}>")

    def page(self) -> tuple[str, list[int]]:
        if self.chance(0.9):
            self.raw("<!DOCTYPE html><html><head><meta charset='utf-8'>")
            self.leaf("<title>", self.words(1, 10), "</title>", 0)
            self.raw("<style>p{margin:0}</style><script>var a='</p>';</script></head><body>")
        outer = self.chance(0.35)
        if outer:
            self.raw(self.open("div", NEUTRAL))
        for part, p in ((self.notice, 0.25), (self.header, 0.4), (self.menu, 0.65), (self.small, 0.2), (self.form, 0.1), (self.advert, 0.45), (self.sidebar, 0.15)):
            if self.chance(p):
                part()
                self.space()
            if self.chance(0.1):
                self.raw(f"<!-- {self.word()} <p>{self.word()}</p> -->")
        self.main()
        for part, p in ((self.small, 0.2), (self.advert, 0.25), (self.comments, 0.4), (self.sidebar, 0.35), (self.form, 0.2), (self.notice, 0.2), (self.footer, 0.8)):
            if self.chance(p):
                part()
                self.space()
        if outer:
            self.raw("</div>")
        self.raw("</body></html>")
        return "".join(self.html), self.labels


def sample_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    return Writer(rng).page()
