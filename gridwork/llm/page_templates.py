"""Labelled training pages: layouts put together by rule from a seed.

Every page is a nest of parts; each part is main text or not. The names of
classes, the tags, the order of parts and the amount of text vary, so that no
single sign (a tag, a name, much text) decides.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ar be ca de do el en er fa ga he il in ka la le ma mi na no on or pa que ra re sa si ta te tion um un ve wa za".split()


class Layout:
    """One page: the html, and the main text as it should come out."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []
        self.semantic = self.r.random() < 0.5
        self.named = self.r.random() < 0.85
        self.html = self.page()

    def words(self, low: int, high: int) -> str:
        r = self.r
        w = ["".join(r.choices(_SYLLABLES, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
        for i in range(0, len(w), r.randint(3, 14)):
            w[i] = w[i].capitalize()
        return " ".join(x + r.choice(("", "", "", "", ",", ".")) for x in w)

    def sentence(self, low: int = 4, high: int = 25) -> str:
        return self.words(low, high).rstrip(",.").capitalize() + "."

    def box(self, tag: str, names: str, inside: str) -> str:
        """A part under a semantic tag, a named div or (rarely) a bare one."""
        r = self.r
        name = r.choice(names.split())
        name = r.choice((name, name, f"{name}-wrap", f"site-{name}", f"{name} box", f"l-{name}"))
        attribute = f' {r.choice(("class", "class", "id"))}="{name}"' if self.named or not self.semantic else ""
        if self.semantic and r.random() < 0.8:
            return f"<{tag}{attribute if r.random() < 0.5 else ''}>{inside}</{tag}>"
        return f"<div{attribute}>{inside}</div>"

    def links(self, n: int) -> str:
        one = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(n)]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>"
        return self.r.choice((" ", " | ", "")).join(one)

    def nav(self) -> str:
        return self.box("nav", "nav menu navbar navigation breadcrumb pagination toc", self.links(self.r.randint(2, 9)))

    def header(self) -> str:
        inside = self.r.choice((f"<h1>{self.words(1, 4)}</h1>", f'<div class="logo">{self.words(1, 3)}</div>', f"<p>{self.words(2, 7)}</p>"))
        return self.box("header", "header masthead topbar branding banner", inside + (self.nav() if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        inside = self.r.choice(("", "<p>")) + f"&copy; {self.words(1, 3)} &middot; {self.sentence()}"
        return self.box("footer", "footer copyright legal bottom", inside + (self.links(4) if self.r.random() < 0.4 else ""))

    def advert(self) -> str:
        inside = self.r.choice((self.sentence(3, 30), f"<p>{self.sentence(3, 30)}</p>", f'<p>{self.sentence()}</p><a href="/x">{self.words(1, 3)}</a>'))
        name = self.r.choice("ad ads advert advertisement sponsor sponsored promo promotion ad-banner".split())
        tag = self.r.choice(("div", "div", "aside", "section"))
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{name}">{inside}</{tag}>'

    def notice(self) -> str:
        name = self.r.choice("cookie cookie-notice consent gdpr notice alert popup modal newsletter subscribe paywall disclaimer warning".split())
        inside = "".join(f"<p>{self.sentence(5, 30)}</p>" for _ in range(self.r.randint(1, 2))) if self.r.random() < 0.7 else self.sentence(5, 30)
        return f'<div {self.r.choice(("class", "id"))}="{name}">{inside}{self.r.choice(("", "<button>OK</button>"))}</div>'

    def sidebar(self) -> str:
        r = self.r
        parts = [f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(r.randint(3, 7)), f"<p>{self.sentence()}</p>" * r.randint(1, 3)))
                 for _ in range(r.randint(1, 3))]
        return self.box("aside", "sidebar aside rail widget related recommended popular trending", "".join(parts))

    def comments(self) -> str:
        r = self.r
        one = [f'<{t} class="{r.choice(("comment", "reply", "comment-item"))}"><p>{self.words(1, 2)}</p><p>{self.sentence(4, 40)}</p></{t}>'
               if r.random() < 0.6 else f"<{t}><b>{self.words(1, 1)}</b>: {self.sentence(4, 40)}</{t}>"
               for t in [r.choice(("div", "li", "article"))] for _ in range(r.randint(1, 8))]
        inside = f"<h3>{self.words(1, 2)}</h3>" * (r.random() < 0.6) + "".join(one)
        name = r.choice("comments comment-list discussion replies disqus reader-comments responses".split())
        return f'<{(t := r.choice(("section", "div", "ul", "ol")))} {r.choice(("class", "id"))}="{name}">{inside}</{t}>'

    def form(self) -> str:
        inside = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 1)}</button>'
        return f'<form action="/go">{self.r.choice(("", f"<p>{self.sentence()}</p>", f"<h3>{self.words(1, 3)}</h3>"))}{inside}</form>'

    def share(self) -> str:
        return f'<div class="{self.r.choice(("share", "social", "tags", "byline meta", "post-meta"))}">{self.links(3) if self.r.random() < 0.6 else self.words(2, 6)}</div>'

    def article(self) -> str:
        r, out = self.r, []

        def kept(text: str) -> str:
            self.main.append(text.replace("<b>", "").replace("</b>", ""))
            return text

        if r.random() < 0.8:
            title = f"<h1>{kept(self.words(1, 10))}</h1>"
            out.append(f"<header>{title}</header>" if self.semantic and r.random() < 0.2 else title)
        if r.random() < 0.15:
            out.append(self.share())
        bare = r.random() < 0.12  # text straight in the container, parted by line breaks
        for i in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            text = self.words(1, 4) if r.random() < 0.15 else " ".join(self.sentence() for _ in range(r.randint(1, 6)))
            if bare:
                out.append(kept(text) + "<br>")
            elif kind < 0.06:
                out.append("<ul>" + "".join(f"<li>{kept(self.sentence(2, 12))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.10:
                out.append(f"<blockquote><p>{kept(text)}</p></blockquote>")
            elif kind < 0.13:
                out.append("<table>" + "".join(f"<tr><td>{kept(self.words(1, 3))}</td><td>{kept(self.words(1, 3))}</td></tr>"
                                               for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.16:
                out.append(f"<pre>{kept(self.words(3, 20))}</pre>")
            elif kind < 0.22:
                out.append(f"<h2>{kept(self.words(1, 6))}</h2>")
            elif kind < 0.34:
                out.append(f"<p><b>{kept(text)}<br>")  # left open, as pages often do
            elif kind < 0.42:
                out.append(f"<div>{kept(text)}</div>")
            else:
                out.append(f"<p>{kept(text)}</p>" if r.random() < 0.8 else f'<p>{kept(text)} <a href="/l">{kept(self.words(1, 3))}</a></p>')
            if r.random() < 0.04:
                out.append(r.choice((self.advert, self.notice, self.share, self.form))())
        inside = "".join(out)
        if r.random() < 0.15:  # nothing says that it is the main part
            return r.choice((inside, f"<div>{inside}</div>", f"<div><div>{inside}</div></div>"))
        if self.semantic or r.random() < 0.3:
            inside = f"<article>{inside}</article>"
            if r.random() < 0.4:
                inside = f"<main>{inside}</main>"
        else:
            name = r.choice("article post story entry content main article-body post-content entry-content text".split())
            inside = f'<div {r.choice(("class", "id"))}="{name}">{inside}</div>'
        return inside

    def page(self) -> str:
        r = self.r
        before = [p for p, chance in ((self.header, 0.5), (self.nav, 0.6), (self.notice, 0.25), (self.advert, 0.45), (self.form, 0.15)) if r.random() < chance]
        after = [p for p, chance in ((self.share, 0.2), (self.comments, 0.35), (self.sidebar, 0.45), (self.advert, 0.2),
                                     (self.form, 0.2), (self.notice, 0.15), (self.footer, 0.75)) if r.random() < chance]
        if r.random() < 0.2:
            before.append(self.sidebar)
        if r.random() < 0.1:  # hardly anything beside the article
            before, after = before[:r.randint(0, 1)], after[:r.randint(0, 1)]
        body = "".join(p() for p in before) + self.article() + "".join(p() for p in after)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f'<div class="{r.choice(("page", "wrapper", "container", "row", "site"))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body>{body}</body></html>"
