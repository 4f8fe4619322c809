"""HTML pages as flat text blocks. One pass over the page; no pattern backtracks, an element costs a fixed amount of
memory whatever its depth, and each is opened and closed once."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of HTML: elements that part text into blocks, elements without readable text, elements whose content is
# raw text, elements without content, what a head may hold, inline elements, and elements that bound what an end tag or
# a block reaches.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template svg math iframe object embed canvas audio video map select textarea title head noframes noembed button".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe noframes xmp noembed".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
INLINE_TAGS = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BOUNDS = frozenset("td th table caption html template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Start tags that end an open element of the second set, whose end tags may be left out.
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}

#: Tags of what stands around articles; a header or footer counts only outside an article.
FRAME_TAGS = {"nav": 3, "menu": 3, "footer": 3, "aside": 2, "form": 2, "fieldset": 2, "dialog": 2, "header": 1}
# Words of class, id and role names that stand for frames, for readers' comments and for the article.
FRAME_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager masthead banner topbar footer colophon sidebar aside related recommended trending widget widgets "
    "cookie cookies consent gdpr popup modal overlay paywall newsletter subscribe alert alertdialog ad ads advert adverts advertisement advertising sponsor sponsored promo promotion outbrain taboola "
    "login search share sharing social teaser teasers complementary contentinfo".split()
)
COMMENT_WORDS = frozenset("comment comments discussion disqus replies respond".split())
BODY_WORDS = frozenset("article content post entry main story".split())

_SPACE = re.compile(r"\s+")
#: The rest of a start tag behind its name, as browsers read it; only the end of the page makes it fail.
_REST = re.compile(r"(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?+|=)*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]++)))?+")
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
_COMMENT_END = re.compile(r"--!?>")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    tag: str
    node: int

    @property
    def link_density(self) -> float:
        return min(1.0, self.link_words / self.words) if self.words else 0.0


@dataclass(frozen=True, slots=True)
class Context:
    """What encloses an element, itself included. ``named_frame``: the innermost container that a name makes a frame."""

    articles: int = 0
    article: int = -1
    frame_tag: int = 0
    named_frame: int = -1
    named_inside: bool = False
    named_body: bool = False
    named_comment: bool = False


class Page:
    def __init__(self):
        self.blocks: list[Block] = []
        self.parents: list[int] = [-1]
        self.contexts: list[Context] = [Context()]
        self.mains: list[int] = []  # elements h1, article and main
        self.top_articles: list[int] = []  # article and main elements outside others

    def holds_main(self) -> np.ndarray:
        """For each element, whether an h1, article or main element is it or lies in it."""
        out = np.zeros(len(self.parents), bool)
        for i in self.mains:
            while i >= 0 and not out[i]:
                out[i] = True
                i = self.parents[i]
        return out

    def words_inside(self, words: np.ndarray) -> np.ndarray:
        """For each element, the sum of ``words`` over the blocks inside it."""
        out = np.zeros(len(self.parents))
        for b, w in zip(self.blocks, words.tolist()):
            out[b.node] += w
        for i in range(len(out) - 1, 0, -1):  # children come after their parents
            out[self.parents[i]] += out[i]
        return out

    def group_sums(self, words: np.ndarray) -> np.ndarray:
        """For each block, the sum over the blocks of the same container: the parent of the block's own element."""
        sums: dict[int, float] = defaultdict(float)
        groups = [max(self.parents[b.node], 0) for b in self.blocks]
        for g, w in zip(groups, words.tolist()):
            sums[g] += w
        return np.array([sums[g] for g in groups])


def _named(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether the attributes name a frame, comments, an article, and whether they hide the element."""
    frame = comment = body = hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = set(re.split(r"[-_]+", word))
                frame = frame or bool(parts & FRAME_WORDS)
                comment = comment or bool(parts & COMMENT_WORDS)
                body = body or bool(parts & BODY_WORDS)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return frame, comment, body, hidden


_named_short = lru_cache(maxsize=20_000)(_named)


def read(page: str) -> Page:
    """The blocks of a page, in order, with the elements around them."""
    out = Page()
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements: tag, number, silent
    open_at: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack
    bounds: list[int] = []
    blocks_open: list[int] = [0]
    ended: set[int] = set()  # inline elements whose end tag came while a block inside was open
    links = 0

    def flush() -> None:
        words = _SPACE.sub(" ", "".join(text)).strip()
        if words:
            at = blocks_open[-1]
            out.blocks.append(Block(words, words.count(" ") + 1, len("".join(linked).split()), stack[at][0], stack[at][1]))
        text.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not stack[-1][2]:
            s = html.unescape(raw) if "&" in raw else raw
            text.append(s)
            if links:
                linked.append(s)

    def close(to: int) -> None:
        """End the elements from place ``to`` of the stack on."""
        nonlocal links
        while len(stack) > to:
            at = len(stack) - 1
            tag, number, _ = stack[-1]
            if tag in BLOCK_TAGS:
                flush()
                blocks_open.pop()
            stack.pop()
            if tag in BOUNDS:
                bounds.pop()
            if at in ended:
                ended.discard(at)
                continue
            open_at[tag].pop()
            if tag == "a":
                links -= 1
                linked.append(" ")

    def end_head() -> None:
        if open_at["head"] and stack[-1][0] == "head":
            close(open_at["head"][0])

    def between(raw: str) -> None:
        if raw and not raw.isspace():
            end_head()
        say(raw)

    def end_tag(tag: str) -> None:
        nonlocal links
        if tag in HEADINGS:  # any heading's end tag ends the open one
            tag = max(HEADINGS, key=lambda h: open_at[h][-1] if open_at[h] else 0)
        places = open_at[tag]
        if not places:
            if tag in BLOCK_TAGS:
                flush()
        elif tag in INLINE_TAGS and places[-1] < blocks_open[-1]:
            # misnested: the inline element ends, the blocks inside it go on
            ended.add(places.pop())
            if tag == "a":
                links -= 1
                linked.append(" ")
        elif not (bounds and places[-1] < bounds[-1] and tag not in ("table", "body", "html", "article", "main", "section", "tr", "tbody", "thead", "tfoot")):
            close(places[-1])

    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0 or at + 1 >= n:
            between(page[pos:])
            break
        mark = page[at + 1]
        if mark == "!" or mark == "?":
            between(page[pos:at])
            if page.startswith("<!--", at):
                m = None if page.startswith((">", "->"), at + 4) else _COMMENT_END.search(page, at + 4)
                pos = m.end() if m else page.find(">", at) + 1 if page.startswith((">", "->"), at + 4) else n
            elif page.startswith("<![CDATA[", at):
                stop = page.find("]]>", at)
                pos = n if stop < 0 else stop + 3
            else:
                stop = page.find(">", at)
                pos = n if stop < 0 else stop + 1
            continue
        closing = mark == "/"
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            if closing:
                between(page[pos:at])
                stop = page.find(">", at)
                pos = n if stop < 0 else stop + 1
            else:  # a "<" that opens no tag is text
                between(page[pos : at + 1])
                pos = at + 1
            continue
        between(page[pos:at])
        rest = _REST.match(page, name.end())
        if rest is None:  # the page ends inside a tag
            break
        tag, pos = name[0].lower(), rest.end()
        if closing:
            end_tag(tag)
            continue
        if tag not in HEAD_TAGS:
            end_head()
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if open_at["p"] and not (bounds and bounds[-1] > open_at["p"][-1]):  # a block ends an open paragraph
                close(open_at["p"][-1])
        if tag in IMPLIED and stack[-1][0] in IMPLIED[tag]:
            close(len(stack) - 1)
        attributes = rest[0][:-1]
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS | RAW_TAGS | INLINE_TAGS:
            continue
        frame, comment, body, hidden = (_named_short if len(attributes) < 200 else _named)(attributes) if "=" in attributes or "hidden" in attributes.lower() else (False,) * 4
        _, parent, silent = stack[-1]
        silent = silent or hidden or tag in SILENT_TAGS
        if tag in RAW_TAGS:
            m = _END_OF[tag].search(page, pos)
            if not silent:
                say(page[pos : m.start() if m else n])
            stop = page.find(">", m.end()) if m else -1
            pos = n if stop < 0 else stop + 1
            continue
        number = parent
        c = out.contexts[parent]
        article = tag in ("article", "main")
        frame_tag = FRAME_TAGS.get(tag, 0)
        if frame_tag and (tag == "header" or tag == "footer") and c.articles:
            frame_tag = 0 if tag == "header" else 1
        if tag == "body" or tag == "html":  # names of the whole page tell nothing
            frame = comment = body = False
        if tag in BLOCK_TAGS or frame or comment or body:
            number = len(out.parents)
            out.parents.append(parent)
            if article or frame_tag > c.frame_tag or frame or comment or body:
                c = Context(
                    c.articles + article,
                    number if article else c.article,
                    max(c.frame_tag, frame_tag),
                    number if frame else c.named_frame,
                    c.named_inside or frame and c.articles > 0,
                    c.named_body or body and not frame,
                    c.named_comment or comment,
                )
            out.contexts.append(c)
            if article or tag == "h1":
                out.mains.append(number)
            if article and c.articles == 1:
                out.top_articles.append(number)
        place = len(stack)
        stack.append((tag, number, silent))
        open_at[tag].append(place)
        if tag in BLOCK_TAGS:
            blocks_open.append(place)
        if tag in BOUNDS:
            bounds.append(place)
        if tag == "a":
            links += 1
            linked.append(" ")
    flush()
    return out
