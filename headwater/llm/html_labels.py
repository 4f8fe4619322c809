"""The labelled table of the HTML classifier: pages written in many layouts. Each block of text holds one mark word
(q<number>z) by which its label is known. Frames come with telling tags, telling names, neutral names or none at all;
names also mislead: articles sit in wrappers named after their layout, and their paragraphs carry names of frames."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren su ta vel no dar pi es or un zel ga bri tho quen al vi".split()
#: Class names that say nothing.
_NEUTRAL = "box c1 c2 row col-8 x-17 wrap inner block unit u-3 grid cell pane zone t-body l-main css-1a2b _3kf clearfix container".split()
_CUES = {
    "footer": ("© {y} {w}", "Copyright {y} {w}. All rights reserved.", "&copy; {w} &middot; {w}", "Terms of use · Privacy policy {w}", "{w} powered by {w}", "{w}"),
    "notice": ("We use cookies to improve {w}.", "This site uses cookies. {w}", "Subscribe to our newsletter {w}", "Your privacy matters: {w}", "Please log in to continue {w}"),
    "advert": ("Advertisement {w}", "Sponsored: {w}", "{w}", "{w} {w}.", "{w}."),
    "form": ("Sign in to leave a reply {w}", "Leave a comment {w}", "Log in {w}", "Email {w}"),
    "side": ("Related articles {w}", "Most read {w}", "{w}.", "About the author {w}.", "Follow us {w}"),
    "share": ("Share this {w}", "Follow us on {w}", "Share on {w}"),
}
_NAMES = {
    "menu": "nav navbar main-menu top-navigation breadcrumbs", "footer": "footer site-footer colophon page-footer", "notice": "cookie-notice gdpr-banner newsletter alert popup",
    "advert": "ad ads ad-slot advertisement sponsored promo", "side": "sidebar widget related aside trending", "form": "login search-form newsletter-form", "share": "share social-links sharing",
    "comments": "comments comment-list discussion replies",
}
_TAGS = {"menu": "nav", "footer": "footer", "side": "aside", "form": "form", "notice": "dialog"}


class _Writer:
    def __init__(self, rng: random.Random, first: int):
        self.rng, self.next, self.labels = rng, first, {}
        self.short = rng.random() < 0.25  # a page of a few words

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randrange(1, 4)))

    def prose(self, n: int, label: int, link: float = 0.0, stop: bool = True) -> str:
        """``n`` words, the first a mark; a share of them in links."""
        mark = f"q{self.next}z"
        self.next += 1
        self.labels[mark] = label
        words = [mark] + [self.word() for _ in range(n - 1)]
        for i in range(len(words)):
            if self.rng.random() < link:
                words[i] = f"<a href='/{self.word()}'>{words[i]}</a>"
            elif self.rng.random() < 0.08 and i and stop:
                words[i] += self.rng.choice(".,.")
            if self.rng.random() < 0.01:
                words[i] = f"<b>{words[i]}</b>"
        return " ".join(words) + (self.rng.choice(".....!?") if stop and self.rng.random() < 0.93 else "")

    def length(self) -> int:
        """Words of a paragraph: mostly some tens, at times a few, at times hundreds."""
        k = self.rng.random()
        if self.short:
            return self.rng.randrange(1, 14)
        return self.rng.randrange(1, 9) if k < 0.2 else self.rng.randrange(8, 60) if k < 0.7 else self.rng.randrange(50, 320)

    def wrap(self, kind: str, inner: str, how: str) -> str:
        """The container of a frame: told by its tag, by a name, by a neutral name, by nothing, or none."""
        rng = self.rng
        if how == "tag" and kind in _TAGS:
            return f"<{_TAGS[kind]}>{inner}</{_TAGS[kind]}>"
        if how in ("tag", "name"):
            tag = rng.choice(("div", "div", "section"))
            return f"<{tag} {rng.choice(('class', 'class', 'id'))}='{rng.choice(_NAMES[kind].split())}'>{inner}</{tag}>"
        if how == "bare":
            return inner if inner.startswith("<") else f"<div>{inner}</div>"
        return f"<div class='{rng.choice(_NEUTRAL)}'>{inner}</div>" if how == "neutral" else f"<div>{inner}</div>"

    def cue(self, kind: str, words: int, label: int = 0) -> str:
        """A phrase of such frames with some words, one of them the mark."""
        text = self.rng.choice(_CUES[kind]).replace("{y}", str(self.rng.randrange(1999, 2030)))
        pieces = text.split("{w}")
        said = self.prose(max(1, words // max(1, len(pieces) - 1)), label, stop=False)
        rest = [" ".join(self.word() for _ in range(max(1, words // 2))) for _ in pieces[2:]]
        return pieces[0] + "".join(w + p for w, p in zip([said, *rest], pieces[1:]))

    def links(self, n: int, words: int) -> str:
        items = [f"<a href='/{self.word()}'>{self.prose(self.rng.randrange(1, words + 1), 0, stop=self.rng.random() < 0.3)}</a>" for _ in range(n)]
        return self.rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "".join(f"<div>{x}</div>" for x in items), "<p>" + " | ".join(items) + "</p>"))

    def frame(self, kind: str, how: str) -> str:
        rng = self.rng
        if kind == "menu":
            return self.wrap(kind, self.links(rng.randrange(2, 9), 3), how)
        if kind == "comments":
            n = rng.randrange(1, 6)
            body = "".join(rng.choice(("<p>{}</p>", "<div class='x-17'><p>{}</p></div>", "<li>{}</li>", "<article><p>{}</p></article>")).format(self.prose(rng.randrange(2, 60), 0)) for _ in range(n))
            # without any name, the heading tells
            head = "" if how in ("tag", "name") and rng.random() < 0.6 else f"<h3>{rng.choice(('Comments', f'{n} comments', 'Reader comments', f'{n} replies', 'Leave a reply'))}</h3>"
            return self.wrap(kind, head + body, how)
        if kind == "side" and rng.random() < 0.5:
            inner = f"<h4>{self.prose(rng.randrange(1, 4), 0, stop=False)}</h4>" + self.links(rng.randrange(2, 6), 8)
        elif how in ("tag", "name") and rng.random() < 0.5:  # prose like any other: only the container tells
            text = self.prose(rng.choice((rng.randrange(1, 9), rng.randrange(4, 90))), 0)
            inner = rng.choice((f"<p>{text}</p>", text))
        elif how not in ("tag", "name") and kind in ("side", "advert"):
            links = self.links(rng.randrange(2, 6), 9)
            label = f"<div>{self.prose(rng.randrange(1, 8), 0, stop=False)}</div>"  # a link list's label, among links
            inner = rng.choice((f"<p>{self.cue(kind, rng.randrange(1, 5))}</p>{links}", links, links + label + self.links(rng.randrange(2, 5), 5), label + links))
        else:
            inner = rng.choice(("<p>{}</p>", "{}", "<div>{}</div>")).format(self.cue(kind, rng.randrange(1, 14)))
        if how not in ("tag", "name") and kind in ("footer", "notice", "form", "share") and not any(c in inner.lower() for c in ("©", "&copy;", "copyright", "cookie", "privacy", "subscribe", "log in", "sign in", "leave a", "share", "follow", "powered")):
            inner = f"<p>© {rng.randrange(1999, 2030)} {self.prose(rng.randrange(1, 6), 0, stop=False)}</p>"
        return self.wrap(kind, inner, how)

    def article(self, inside: list[str], misleading: bool, bounded: bool) -> str:
        """Heading, paragraphs, lists, quotes and tables, with frames among them. Where an element bounds the article, its
        lines may sound like those of frames."""
        rng = self.rng
        parts = []
        for _ in range(rng.randrange(1, 4 if self.short else 10)):
            text = self.prose(self.length(), 1, link=rng.choice((0, 0, 0, 0.05, 0.2)))
            if bounded and rng.random() < 0.2:
                text = self.cue(rng.choice(("footer", "notice", "form", "side", "share")), rng.randrange(1, 9), 1)
            shape = rng.random()
            name = f" class='{rng.choice(('side note', 'story top-bottom', 'more', 'share-price', 'ad-hoc', 'related-work', 'notice', 'social-history', 'alert', 'form-of-life'))}'" if misleading and text.count(" ") > 8 and rng.random() < 0.3 else ""
            if shape < 0.62:
                parts.append(rng.choice((f"<p{name}>{text}</p>", f"<p{name}>{text}</p>", f"<p{name}>{text}", f"<div{name}>{text}</div>", f"<div class='{rng.choice(_NEUTRAL)}'><p{name}>{text}</p></div>")))
            elif shape < 0.72:
                parts.append(f"<h{rng.randrange(2, 5)}>{self.prose(rng.randrange(1, 9), 1, stop=False)}</h2><p>{text}</p>")
            elif shape < 0.84:
                parts.append("<ul>" + "".join(f"<li>{self.prose(rng.randrange(1, 25), 1, stop=rng.random() < 0.5)}" for _ in range(rng.randrange(1, 6))) + "</ul>")
            elif shape < 0.9:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif shape < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{self.prose(rng.randrange(1, 6), 1, stop=False)}<td>{self.prose(rng.randrange(1, 6), 1, stop=False)}" for _ in range(2)) + "</table>")
            else:
                parts.append(f"<p{name}><b>{text}<br><p>{self.prose(rng.randrange(1, 40), 1)}</p>")
            if inside and rng.random() < 0.3:
                parts.append(inside.pop())
        title = f"<h1>{self.prose(rng.randrange(1, 14), 1, stop=False)}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.15:
            title = f"<header>{title}</header>"
        return title + "".join(parts) + "".join(inside)

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.08:  # text and nothing else
            return "".join(rng.choice(("<p>{}</p>", "<p>{}", "{}<br><br>", "<div>{}</div>")).format(self.prose(self.length(), 1)) for _ in range(rng.randrange(1, 5)))
        semantic, named = rng.random() < 0.6, rng.random() < 0.5
        misleading = rng.random() < 0.35
        hows = ("tag", "tag", "name", "neutral") if semantic else ("name", "name", "tag", "neutral", "bare") if named else ("neutral", "none", "bare", "bare", "tag")
        some = lambda kind, p: [self.frame(kind, rng.choice(hows))] if rng.random() < p else []
        told = lambda kind, p: [self.frame(kind, rng.choice(("tag", "name")))] if rng.random() < p else []
        top = some("menu", 0.85) + some("notice", 0.3) + (told("advert", 0.5) if semantic or named else [])
        if rng.random() < 0.35:
            brand = self.prose(rng.randrange(1, 8), 0, stop=False)
            top.insert(0, rng.choice((f"<header>{self.links(1, 3)}<p>{brand}</p></header>", f"<header><a href='/'>{self.word()}</a> {brand}</header>", f"<header class='{rng.choice(_NEUTRAL)}'><div>{brand}</div></header>")))
        rng.shuffle(top)
        inside = (told("advert", 0.4) + told("side", 0.25) + told("share", 0.3)) if semantic or named else []
        body = self.article(inside, misleading, semantic)
        if semantic:
            tag = rng.choice(("article", "article", "main", "article"))
            body = f"<{tag}>{body}</{tag}>"
            if misleading and rng.random() < 0.4:
                body = f"<div class='more'>{body}</div>"
        elif rng.random() < 0.7:
            body = f"<div class='{rng.choice(('content', 'post-body', 'entry', 'story', *_NEUTRAL))}'>{body}</div>"
        after = some("side", 0.4) + some("form", 0.25) + some("comments", 0.35 if semantic or named else 0.25)
        rng.shuffle(after)
        whole = body + "".join(after)
        if misleading and rng.random() < 0.5:  # names of the layout around everything
            whole = f"<div class='{rng.choice(('layout has-sidebar', 'with-menu', 'page nav-left', 'footer-sticky', 'social', 'widget-area'))}'>{whole}</div>"
        foot = "".join(some("footer", 0.85))
        return f"<html><head><title>{self.word()}</title></head><body>{''.join(top)}{whole}{foot}</body></html>"


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, dict[str, int]]]:
    """``n`` pages with the label of each mark word: 1 for article text."""
    out = []
    for k in range(n):
        writer = _Writer(random.Random(f"{seed}:{k}"), 1)
        out.append((writer.page(), writer.labels))
    return out
