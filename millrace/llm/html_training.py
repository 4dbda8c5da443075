"""Labelled pages for the node classifier: made up from many layouts, with the main text marked.

Elements of main text carry ``data-main="1"``.  Words are invented, so nothing but structure can be learned.
"""

from __future__ import annotations

import random

_NAV = "nav navbar menu topnav mainmenu navigation site-nav breadcrumb breadcrumbs pagination pager tabs skip-link toolbar sitemap toc-nav".split()
_HEAD = "header site-header masthead topbar page-header banner logo branding head".split()
_FOOT = "footer site-footer page-footer colophon copyright legal bottom foot credits".split()
_SIDE = "sidebar side aside widget widget-area related related-posts recommended popular trending archive blogroll left-col right-col secondary complementary rail more-stories".split()
_NOTICE = "cookie cookie-banner consent gdpr notice alert announcement popup modal overlay privacy-notice message disclaimer infobar toast".split()
_AD = "ad ads advert advertisement ad-slot adsense sponsor sponsored promo promotion banner-ad dfp commercial ad-container".split()
_COMMENT = "comments comment comment-list commentlist discussion respond replies disqus reader-comments comment-body feedback responses".split()
_SHARE = "share social social-share sharing follow share-buttons tags tag-list post-meta-links".split()
_FORM = "form search search-form login signup subscribe newsletter contact-form poll survey".split()
_MAIN = "article post content entry entry-content post-content article-body story story-body main main-content body-text text article-text post-body hentry page-content".split()
_PART = "post item block section entry paragraph para row card content-block text-block chapter lead intro body-section wp-block question answer step update".split()
_ICONS = ("<svg class='icon'/>", "<svg class='icon'><path d='M0 0'/></svg>", "<i class='fa fa-x'></i>", "<img src='x.png' alt='x'>", "<svg viewBox='0 0 1 1'><title>t</title><use href='#a'/></svg>")
_WRAP = "wrapper container page site wrap layout row grid inner outer col col-8 columns content-area shell app root".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouäéó") for _ in range(self.r.randint(1, 2))) for _ in range(60)]

    def words(self, lo: int, hi: int, stop: bool = True) -> str:
        r = self.r
        out = ["".join(r.choices(self.syllables, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        if r.random() < 0.1:
            out = [w + r.choice(("!!", "%%%", "***", "&amp;", " |")) for w in out]
        if r.random() < 0.2:
            out = [str(r.randint(0, 3000)) if r.random() < 0.12 else w for w in out]
        for i in range(r.randint(5, 14), len(out), r.randint(6, 16)):
            out[i] += r.choice((".", ",", ".", ";"))
        s = " ".join(out)
        return (s[:1].upper() + s[1:] + ("." if stop else "")) if r.random() < 0.9 else s.upper()

    def attr(self, names: list[str], chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names)
        if r.random() < 0.2:
            name += r.choice(("-1", "_block", "-wrap", "-inner", " clearfix", " box"))
        return f' {r.choice(("class", "class", "class", "id"))}="{name}"'

    def links(self, lo: int, hi: int) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.words(1, 3, False)}</a>' for i in range(r.randint(lo, hi))]
        kind = r.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice((" ", " | ", " &middot; ")).join(items) if kind < 0.9 else "".join(f"<div>{x}</div>" for x in items)

    def nav(self) -> str:
        tag = self.r.choice(("nav", "nav", "nav", "div", "ul"))
        if tag == "ul":
            return f"<ul{self.attr(_NAV, 1)}>" + "".join(f'<li><a href="#">{self.words(1, 2, False)}</a></li>' for _ in range(self.r.randint(3, 9))) + "</ul>"
        return f"<{tag}{self.attr(_NAV, 0.5 if tag == 'nav' else 1)}>{self.links(2, 9)}</{tag}>"

    def header(self) -> str:
        r = self.r
        tag = r.choice(("header", "header", "div"))
        inner = r.choice((f"<h1><a href='/'>{self.words(1, 4, False)}</a></h1>", f"<div class='logo'>{self.words(1, 3, False)}</div>", f"<p>{self.words(2, 8)}</p>", ""))
        return f"<{tag}{self.attr(_HEAD, 0.5 if tag == 'header' else 1)}>{inner}{self.nav() if r.random() < 0.7 else ''}{self.form() if r.random() < 0.2 else ''}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(("footer", "footer", "footer", "div"))
        inner = f"&copy; {r.randint(1999, 2030)} {self.words(1, 4, False)}" if r.random() < 0.7 else self.words(3, 20)
        if r.random() < 0.5:
            inner += f" &middot; {self.words(3, 25)}"
        if r.random() < 0.3:
            inner = f"<p>{inner}</p>"
        return f"<{tag}{self.attr(_FOOT, 0.4 if tag == 'footer' else 1)}>{self.links(2, 6) if r.random() < 0.4 else ''}{inner}</{tag}>"

    def sidebar(self) -> str:
        r = self.r
        tag = r.choice(("aside", "aside", "div", "section"))
        inner = "".join(r.choice((lambda: f"<h3>{self.words(1, 3, False)}</h3>{self.links(2, 7)}", lambda: f"<p>{self.words(5, 40)}</p>", lambda: f"<div>{self.words(4, 30)}</div>"))() for _ in range(r.randint(1, 3)))
        return f"<{tag}{self.attr(_SIDE, 0.5 if tag == 'aside' else 1)}>{inner if r.random() < 0.85 else self.words(4, 40)}</{tag}>"

    def notice(self) -> str:
        r = self.r
        tag = r.choice(("div", "div", "section", "p", "dialog"))
        text = self.words(4, 35)
        return f"<{tag}{self.attr(_NOTICE, 1)}>{text if tag == 'p' or r.random() < 0.5 else f'<p>{text}</p>'}{'<button>Ok</button>' if r.random() < 0.5 and tag != 'p' else ''}</{tag}>"

    def ad(self) -> str:
        r = self.r
        tag = r.choice(("div", "div", "div", "section", "aside", "ins"))
        text = self.words(2, 40)
        inner = r.choice((text, text, f"<p>{text}</p>", f'<a href="x"><img src="a.png"></a> {text}', f'<a href="x">{text}</a>', f"<h4>{self.words(1, 4)}</h4><p>{text}</p>"))
        return f"<!-- ad --><{tag}{self.attr(_AD, 1)}>{inner}</{tag}>"

    def form(self) -> str:
        r = self.r
        inner = "".join(f"<label>{self.words(1, 2, False)}</label><input name='q'>" for _ in range(r.randint(1, 3)))
        text = f"<p>{self.words(3, 25)}</p>" if r.random() < 0.5 else ""
        f = f"<form{self.attr(_FORM, 0.5)}>{text}{inner}<button>{self.words(1, 2, False)}</button></form>"
        return f if r.random() < 0.7 else f"<div{self.attr(_FORM, 1)}><h3>{self.words(1, 4, False)}</h3>{f}</div>"

    def comments(self) -> str:
        r = self.r
        tag = r.choice(("section", "div", "ol", "ul", "div"))
        kid = "li" if tag in ("ol", "ul") else r.choice(("div", "article", "p", "section"))
        one = lambda: f"<{kid}{self.attr(['comment', 'reply', 'comment-body', 'media'], 0.7)}>" + (r.choice((lambda: f"<b>{self.words(1, 2, False)}</b> {self.words(3, 60)}", lambda: self.words(3, 60)))() if kid == "p" else r.choice((lambda: f"<p>{self.words(3, 60)}</p>", lambda: f"<cite>{self.words(1, 2, False)}</cite><p>{self.words(3, 40)}</p><p>{self.words(3, 40)}</p>", lambda: self.words(3, 50)))()) + f"</{kid}>"
        head = f"<h3>{self.words(1, 3, False)}</h3>" if tag not in ("ol", "ul") and r.random() < 0.6 else ""
        return f"<{tag}{self.attr(_COMMENT, 1)}>{head}{''.join(one() for _ in range(r.randint(1, 6)))}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attr(_SHARE, 1)}>{self.links(2, 5)}</div>"

    def junk(self) -> str:
        r = self.r
        return r.choices((self.ad, self.share, self.form, self.notice, self.sidebar, self.comments), (5, 2, 2, 1, 1, 0))[0]()

    def article(self) -> str:
        r = self.r
        m = ' data-main="1"'
        title = self.words(1, 12, r.random() < 0.5)
        parts = []
        if r.random() < 0.85:
            h = r.choice(("h1", "h1", "h1", "h2"))
            t = f"<{h}{m}{self.attr(['title', 'headline', 'entry-title'], 0.3)}>{title}</{h}>"
            parts.append(f"<header>{t}</header>" if r.random() < 0.12 else t)
        if r.random() < 0.15:
            parts.append(f"<p{m}{self.attr(['byline', 'date', 'meta', 'author'], 1)}>{self.words(2, 6)}</p>")
        n = r.choices((1, 2, 3, 5, 8, 14, 40), (4, 3, 3, 3, 2, 1, 0.5))[0]
        lo, hi = r.choice(((1, 4), (3, 15), (10, 60), (30, 150))) if n < 40 else (4, 25)
        block = r.choice(("p", "p", "p", "p", "p", "div", "#text", "wrapped", "wrapped", "mixed"))
        shell, name = r.choice(("div", "div", "section", "li")), self.attr(_PART, 0.8)
        for i in range(n):
            text = self.words(lo, hi)
            if r.random() < 0.06:
                text = f"{self.words(1, 8, False)} {r.choice(_ICONS)} {text}"
            if block == "wrapped":
                head = f"<h3{m}>{self.words(1, 5, False)}</h3>" if r.random() < 0.2 else ""
                body = text if r.random() < 0.15 else "".join(f"<p{m}>{x}</p>" for x in [text, *(self.words(lo, hi) for _ in range(r.choices((0, 1, 2), (6, 2, 1))[0]))])
                parts.append(f"<{shell}{m}{name}>{head}{body}</{shell}>")
                continue
            if block == "mixed":
                kind = r.choice(("p", "p", "div", "div", "blockquote", "pre", "address", "dl"))
                parts.append(f"<dl><dt{m}>{self.words(1, 3, False)}</dt><dd{m}>{text}</dd></dl>" if kind == "dl" else f"<{kind}{m}{self.attr(_PART, 0.2)}>{text}</{kind}>")
                continue
            if r.random() < 0.15:
                text = f"{text} <a href='/x'>{self.words(1, 3, False)}</a> {self.words(1, 8)}"
            if r.random() < 0.1:
                text += f" <span{m}{self.attr(['x', 'term', 'hl'], 1)}>{self.words(1, 5)}</span>"
            kind = r.random()
            if block == "#text" or i == 0 and kind < 0.08:
                parts.append(f"<p{m}><b>{text}<br>" if r.random() < 0.7 else f"<p{m}>{text}")
            elif kind < 0.8:
                body = f"<b>{text}<br>" if r.random() < 0.12 and block == "p" else text
                parts.append(f"<{block}{m}>{body}" + ("" if r.random() < 0.12 and block == "p" else f"</{block}>"))
            elif kind < 0.86:
                parts.append(f"<h2{m}>{self.words(1, 6, False)}</h2><p{m}>{text}</p>")
            elif kind < 0.92:
                li = "".join(f"<li{m}>{self.words(1, 25)}</li>" for _ in range(r.randint(1, 6)))
                parts.append(r.choice((f"<ul>{li}</ul>", f"<ol>{li}</ol>")))
            elif kind < 0.95:
                parts.append(f"<blockquote{m}><p{m}>{text}</p></blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td{m}>{self.words(1, 4, False)}</td><td{m}>{self.words(1, 4, False)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
            elif kind < 0.985:
                parts.append(f"<figure><img src='i.png'><figcaption{m}>{self.words(2, 15)}</figcaption></figure>")
            else:
                parts.append(f"<pre{m}>{text}</pre>")
        for _ in range(r.choices((0, 1, 2), (6, 3, 1))[0]):
            parts.insert(r.randint(1, len(parts)), self.junk())
        if r.random() < 0.08:
            parts.append(f"<footer>{self.words(2, 12)}</footer>")
        if r.random() < 0.12:
            parts.append(self.comments())
        tag = r.choices(("article", "div", "main", "section", "td"), (6, 3, 1, 1, 0.3))[0]
        inner = "".join(parts)
        if r.random() < 0.2:
            inner = f"<div{self.attr(_MAIN)}>{inner}</div>"
        if tag == "td":
            return f"<table><tr><td>{self.sidebar()}</td><td{self.attr(_MAIN)}>{inner}</td></tr></table>"
        return f"<{tag}{self.attr(_MAIN, 0.4 if tag in ('article', 'main') else 1)}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        some = lambda f, p: f() if r.random() < p else ""
        main = self.article()
        if r.random() < 0.06:  # nothing but the text
            return f"<html><head><title>{self.words(2, 8)}</title></head><body>{main}</body></html>"
        if r.random() < 0.08 and "<td" not in main[:200]:  # no element of its own around the text
            main = main[main.index(">") + 1 : main.rindex("<")]
        after = "".join(some(f, p) for f, p in ((self.share, 0.15), (self.comments, 0.3), (self.ad, 0.2), (self.form, 0.1), (self.sidebar, 0.1)))
        around = [some(self.sidebar, 0.25), main + after, some(self.sidebar, 0.3)]
        middle = "".join(around)
        for _ in range(r.choices((0, 1, 2), (5, 4, 1))[0]):
            middle = f"<{(t := r.choice(('div', 'div', 'main', 'section')))}{self.attr(_WRAP, 0.8)}>{middle}</{t}>"
        top = [some(self.notice, 0.2), some(self.header, 0.5), some(self.nav, 0.6), some(self.ad, 0.5), some(self.form, 0.08)]
        if r.random() < 0.3:
            r.shuffle(top)
        body = "".join(top) + middle + some(self.ad, 0.1) + some(self.notice, 0.1) + some(self.footer, 0.85)
        if r.random() < 0.03:
            body = "".join(top) + self.footer()  # a page without main text
        head = f"<head><meta charset='utf-8'><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled_pages(n: int = 2_400, seed: int = 0) -> list[str]:
    return [_Page(seed * 1_000_003 + i).page() for i in range(n)]
