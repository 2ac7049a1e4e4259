"""Made-up web pages with known main text, to train the block labeller.

The layouts follow common practice: semantic elements or classes or neither,
blogs, news, forums, manuals and old table layouts, well-formed or not.  The
words are random syllables of several scripts, so that only structure, a few
stock phrases and the shape of texts can be learned.
"""

from __future__ import annotations

from html import escape

import numpy as np

#: Stands in each block of main text; the labeller never sees it.
MARK = "\ue000"

# Names that pages give to parts, and stock phrases of these parts.
_NAMES = {
    "main": "content main article post entry story body text page single article-body post-content entry-content main-content story-body prose markdown-body documentation hentry mw-parser-output",
    "wrap": "wrapper container outer inner layout row col site page-wrap grid box root app holder",
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs links tabs toc pagination pager skip-links navbox",
    "head": "header masthead site-header top banner branding page-header topbar logo tagline",
    "foot": "footer site-footer bottom colophon copyright legal page-footer credits",
    "side": "sidebar side aside widget rail related recommended secondary popular trending see-also more-stories",
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot adbox sponsor commercial",
    "note": "cookie-notice notice cookie consent gdpr alert popup modal newsletter-notice banner-notice warning message overlay paywall",
    "form": "form login search subscribe newsletter signup contact-form search-box",
    "talk": "comments comment comment-list responses discussion disqus replies reader-comments comment-body feedback",
    "share": "share social share-buttons sharing follow tags meta-links",
}

_PHRASES = {
    "nav": "Home|About us|Contact|News|Products|Next page|Back to top|Inicio|Accueil|Startseite",
    "head": "Welcome to our site|The daily news|Official blog",
    "foot": "All rights reserved.|Privacy policy|Terms of use|Powered by our team|Imprint|Site map",
    "side": "Related articles|You may also like|Popular posts|Recent posts|About the author",
    "ad": "Advertisement|Sponsored content|Buy now and save|Limited offer, order today!",
    "note": "We use cookies to improve your experience.|Accept all cookies|This site uses cookies.|Sign up for our newsletter.|Please enable JavaScript.",
    "form": "Search|Subscribe|Log in|Your email address|Submit|Password",
    "talk": "Reply|Leave a comment|Great post, thanks!|Comments|says:",
    "share": "Share this|Follow us|Tweet|Tags:",
}

#: Different words of a page's text.
VOCABULARY = 250
#: Letters of several scripts, from which a page draws its syllables, and marks that may stick to words.
_SCRIPTS = [("bcdfghklmnprstvwz", "aeiou"), ("bcdfghklmnprstvzñçß", "aeiouáéíöüèêà"), ("бвгдклмнпрст", "аеиоуя"), ("βγδκλμνπρστ", "αειου"), ("的一是不了人我在有他", "大中上个国年到说们为")]
_MARKS = "!?*#$%&@~^+=|/<>_-:;"


class _Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.own, self.foreign = self.vocabulary(), self.vocabulary()
        self.marks = [self.pick(_MARKS) * int(self.rng.integers(1, 4)) for _ in range(4)]

    def vocabulary(self) -> list[str]:
        """Words of one to four of sixty syllables of a script."""
        first, second = _SCRIPTS[int(np.searchsorted([0.4, 0.8, 0.88, 0.94], self.rng.random()))]
        every = [c + v for c in first for v in second] + [v + c for c in first for v in second]
        parts = [every[i] for i in self.rng.integers(0, len(every), 60).tolist()]
        draws = self.rng.integers(0, 60, (VOCABULARY, 4)).tolist()
        return ["".join(parts[i] for i in d[:n]) for d, n in zip(draws, self.rng.integers(1, 5, VOCABULARY).tolist(), strict=True)]

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return self.pick(self.own)

    def words(self, lo: int, hi: int) -> list[str]:
        return [self.own[i] for i in self.rng.integers(0, VOCABULARY, int(self.rng.integers(lo, hi + 1))).tolist()]

    def sentence(self, lo: int = 3, hi: int = 18) -> str:
        ws = self.words(lo, hi)
        if len(ws) > 6 and self.chance(0.5):
            ws[len(ws) // 2] += ","
        return " ".join(ws).capitalize() + self.pick("....!?")

    def prose(self, style: str, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        if style == "loud":
            return " ".join(w.upper() + self.pick(["", "!", "!!"]) for w in self.words(3 * n, 9 * n))
        if style == "marks":
            return " ".join(w + (self.pick(self.marks) if self.chance(0.8) else "") for w in self.words(3 * n, 9 * n))
        if style == "list":
            return self.pick([" | ", ", ", " / "]).join(self.words(3 * n, 9 * n))
        if style == "again":
            return " ".join(w for _ in range(n) for w in [self.word()] * int(self.rng.integers(2, 20)))
        if style == "short":
            return " ".join(self.words(1, 3)).capitalize() + self.pick([".", ".", ""])
        if style == "plain":
            return " ".join(self.words(3 * n, 9 * n))
        if style == "data":
            return f"{self.sentence()} {self.rng.integers(1e9)} {self.word()}@{self.word()}.org {self.sentence()}"
        return " ".join(self.sentence() for _ in range(n))

    def attr(self, kind: str, plain: float = 0.12) -> str:
        if self.chance(plain):
            return ""
        name = self.pick(_NAMES[kind].split())
        if self.chance(0.2):
            name += " " + self.pick(["large", "dark", "x1", "col-8", "clearfix", "js-block", "first"])
        how = self.pick(["class", "class", "id"])
        quote = self.pick(['"', '"', "'"])
        return f" {how}={quote}{name}{quote}"

    def inline(self, text: str) -> str:
        """Text as markup: references, and sometimes inline elements, which may stay open, or line breaks."""
        out = escape(text, quote=self.chance(0.3))
        for _ in range(int(self.rng.choice([0, 0, 0, 1, 2]))):
            ws = out.split(" ")
            k = int(self.rng.integers(len(ws)))
            tag = self.pick("b i em strong span a code u small font abbr mark sup math".split())
            ws[k] = self.pick([f"<{tag}>{ws[k]}</{tag}>", f"<{tag}>{ws[k]}</{tag}>", f"<{tag}>{ws[k]}", f"{ws[k]}<br>", f"{ws[k]}&nbsp;", f"{ws[k]}<br/>"])
            out = " ".join(ws)
        return out

    def main_block(self, style: str) -> str:
        kind = self.rng.random()
        say = lambda lo, hi: MARK + self.inline(self.prose(style, lo, hi))
        close = lambda tag: "" if self.chance(0.15) else f"</{tag}>"
        if kind < 0.68:
            tag = self.pick(["p", "p", "p", "p", "p", "p", "div"])
            lead = self.pick(["", "", "", "", f"<{self.pick(['b', 'i', 'font', 'strong', 'center'])}>"])
            return f"<{tag}{self.pick(['', '', '', self.attr('main')])}>{lead}{say(1, 7)}{self.pick(['', '', '', '<br>'])}{close(tag) if tag == 'p' else '</div>'}"
        if kind < 0.77:
            tag = self.pick(["h2", "h3", "h4"])
            return f"<{tag}>{MARK}{self.inline(' '.join(self.words(2, 8)).capitalize())}</{tag}>"
        if kind < 0.84:
            tag = self.pick(["ul", "ol"])
            return f"<{tag}>{''.join(f'<li>{say(1, 2)}' + close('li') for _ in range(int(self.rng.integers(2, 6))))}</{tag}>"
        if kind < 0.87:
            return f"<dl>{''.join(f'<dt>{say(1, 1)}<dd>{say(1, 3)}' for _ in range(int(self.rng.integers(1, 4))))}</dl>"
        if kind < 0.9:
            return f"<blockquote><p>{say(1, 5)}</p></blockquote>"
        if kind < 0.93:
            return f"<pre>{'<code>' if self.chance(0.5) else ''}{MARK}{escape(' '.join(self.words(4, 12)))}{self.pick([' { }', ';', ''])}</pre>"
        if kind < 0.95:
            return f"<figure><img src='a.png' alt='{self.word()}'><figcaption>{say(1, 1)}</figcaption></figure>"
        if kind < 0.98:
            rows = "".join("<tr>" + "".join(f"<{c}>{MARK}{' '.join(self.words(1, 3))}</{c}>" for c in [self.pick(["td", "th"]), "td"]) + "</tr>" for _ in range(int(self.rng.integers(2, 5))))
            return f"<table>{rows}</table>"
        return f"<section><p>{say(1, 6)}</p></section>"

    def foreign_prose(self, lo: int, hi: int) -> str:
        """A text beside the main one, often in other words."""
        own = self.own
        if self.chance(0.5):
            self.own = self.foreign
        out = self.prose(self.pick(["normal", "normal", "short", "plain", "list", "marks"]), lo, hi)
        self.own = own
        return out

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{" ".join(self.words(1, 3))}</a>' for _ in range(int(self.rng.integers(2, 9)))]
        how = self.rng.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick([" ", " | ", " &middot; "]).join(items) if how < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def chrome(self, kind: str) -> str:
        """A piece that is not main text."""
        div = lambda body, plain=0.0: f"<div{self.attr(kind, plain)}>{body}</div>"
        say = lambda a=1, b=3: escape(self.pick(_PHRASES[kind].split("|")) if self.chance(0.25) else self.foreign_prose(a, b))
        wrap = lambda x: self.pick(["{}", "<p>{}</p>", "<span>{}</span>"]).format(x)
        if kind == "nav":
            return f"<nav{self.attr('nav', 0.5)}>{self.links()}</nav>" if self.chance(0.6) else div(self.links())
        if kind == "head":
            body = self.pick(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "{}", "<a href='/'>{}</a>", "<h2>{}</h2>"]).format(" ".join(self.words(1, 5)))
            if self.chance(0.4):
                body += f"<p>{say(1, 1)}</p>"
            if self.chance(0.4):
                body += self.chrome("nav")
            return f"<header{self.attr('head', 0.5)}>{body}</header>" if self.chance(0.6) else div(body)
        if kind == "foot":
            body = self.pick(["&copy; {}", "<p>&copy; {}</p>", "{}", "<p>{}</p><p>{}</p>", "&copy; www." + self.word() + ".com &middot; {}"])
            body = body.format(say(), say()) if body.count("{}") == 2 else body.format(say())
            return f"<footer{self.attr('foot', 0.5)}>{body}{self.links() if self.chance(0.3) else ''}</footer>" if self.chance(0.6) else div(body)
        if kind == "side":
            body = self.pick(["<h3>{}</h3>", "<h4>{}</h4>", "{}"]).format(" ".join(self.words(1, 3))) + self.pick([self.links(), wrap(say()), f"<ul><li>{say()}</li><li>{say()}</li></ul>"])
            return f"<aside{self.attr('side', 0.5)}>{body}</aside>" if self.chance(0.6) else div(body)
        if kind == "form":
            body = f"<label>{' '.join(self.words(1, 3))}</label><input name='q'><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button>"
            if self.chance(0.5):
                body = f"<p>{say(1, 2)}</p>" + body
            return f"<form{self.attr('form', 0.5)} action='/s'>{body}</form>"
        if kind == "talk":
            tag = self.pick(["div", "li", "article", "p"])
            one = lambda: f"<{tag}{self.attr('talk', 0.3)}>{self.pick(['', '<b>' + self.word() + '</b> ', '<h4>' + self.word() + '</h4>'])}{wrap(escape(self.prose(self.pick(['normal', 'short', 'plain']), 1, 5)))}</{tag}>"
            body = self.pick(["", f"<h3>{' '.join(self.words(1, 2))}</h3>", f"<h2>{self.rng.integers(99)} {self.word()}</h2>"]) + "".join(one() for _ in range(int(self.rng.integers(1, 6))))
            if tag == "li":
                body = f"<ul{self.attr('talk')}>{body}</ul>"
            outer = self.pick(["div", "section", "aside"])
            return f"<{outer}{self.attr('talk', 0)}>{body}</{outer}>"
        if kind in ("ad", "note"):
            body = wrap(say(1, 4)) + (f"<button>{self.word()}</button>" if kind == "note" and self.chance(0.5) else "")
            tag = self.pick(["div", "div", "aside", "section", "p", "dialog" if kind == "note" else "ins"])
            return f"<{tag}{self.attr(kind, 0)}>{body}</{tag}>"
        return div(self.pick([self.links(), wrap(say(1, 1))]))

    def noise(self) -> str:
        return self.pick(["<!-- {} -->", "<script>var a='</p>{}';</script>", "<style>.a{{color:red}} /* {} */</style>", "<svg width=1><path d='M0 0'/></svg><!-- {} -->", "<template><p>{}</p></template>", "<img src='a.png' alt='{}'>"]).format(self.word())

    def byline(self) -> str:
        """Who wrote it and when, beside the title; no part of the text."""
        return f"<div{self.attr('share', 0)}>{' '.join(self.words(1, 3))}, {self.rng.integers(1, 29)} {self.word()} {self.rng.integers(1995, 2030)}</div>"

    def page(self) -> str:
        style = self.pick(["normal"] * 6 + ["loud", "marks", "marks", "list", "again", "plain", "data", "short"])
        title = self.prose(style, 1, 2) if self.chance(0.4) else " ".join(self.words(1, 9)).capitalize()
        title = title[: int(self.rng.integers(15, 120))].strip()
        body = [self.main_block(style if self.chance(0.8) else "normal") for _ in range(int(self.rng.choice([0, 1, 2, 3, 5, 8, 13, 25])))]
        for _ in range(int(self.rng.choice([0, 0, 1, 2]))):  # stray short lines, stock phrases among them, are main text too
            line = self.pick(_PHRASES[self.pick(["foot", "side", "talk"])].split("|")) if self.chance(0.3) else self.prose(self.pick(["short", "normal", "again", "plain"]), 1, 1)
            body.insert(int(self.rng.integers(0, len(body) + 1)), f"<p>{MARK}{self.inline(line)}" + self.pick(["</p>", ""]))
        if not body or self.chance(0.8):
            top = f"<h1>{MARK}{escape(title)}</h1>"
            if self.chance(0.15):
                top = f"<header>{top}</header>"
            if self.chance(0.3):  # a standfirst that often says the title again
                top += f"<p>{self.pick(['', '<b>', '<i>'])}{MARK}{escape(title if self.chance(0.5) else self.prose(style, 1, 2))}"
            body.insert(0, top)
            if self.chance(0.1):
                body.insert(1, self.byline())
        for _ in range(int(self.rng.choice([0, 0, 0, 1, 2]))):
            body.insert(int(self.rng.integers(1, len(body) + 1)), self.chrome(self.pick(["ad", "note", "side", "share", "nav", "form", "ad"])))
        if self.chance(0.1):
            body.append(self.chrome("foot"))
        if self.chance(0.12):
            body.append(self.chrome("talk"))
        tag = self.pick(["article", "article", "article", "main", "div", "div", "section", "td", ""])
        article = self.pick(["", chr(10)]).join(body)
        if tag:  # else a plain page, straight in the body
            article = f"<{tag}{self.attr('main', 0 if tag in ('div', 'section') else 0.6)}>{article}</{tag}>"
        if tag == "td":  # columns of an old layout
            cell = f"<td{self.attr('nav', 0.5)}>{self.links()}</td>"
            article = f"<table><tr>{self.pick([cell + article, article + cell, article])}</tr></table>"
        if self.chance(0.25):
            article = f"<main{self.attr('wrap', 0.6)}>{article}</main>"
        before = [self.chrome(k) for k in ("note", "head", "nav", "ad", "form", "side") if self.chance(0.5 if k in ("head", "nav", "ad") else 0.2)]
        after = [self.chrome(k) for k in ("share", "talk", "side", "ad", "form", "nav", "note", "foot") if self.chance(0.7 if k == "foot" else 0.25)]
        if self.chance(0.1):
            before.append(f"<noscript><p>{self.pick(_PHRASES['note'].split('|'))}</p></noscript>")
        if self.chance(0.2):
            self.rng.shuffle(before)
        parts = [*before, article, *after]
        for _ in range(int(self.rng.integers(0, 3))):
            parts.insert(int(self.rng.integers(len(parts) + 1)), self.noise())
        for _ in range(int(self.rng.choice([0, 0, 1, 2]))):
            parts = [f"<div{self.attr('wrap')}>", *parts, "</div>"]
        end = self.pick(["</body></html>", "</body></html>", "", "</html>"])
        return f"<!DOCTYPE html><html><head><title>{escape(title)}</title>{self.noise()}</head><body>{self.pick(['', chr(10)]).join(parts)}{end}"


def made_up(n: int, seed: int = 1) -> list[str]:
    """n pages; each block of main text holds MARK."""
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]
