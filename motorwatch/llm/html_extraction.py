"""Main text of web pages by a tree-structured graphical model.

The block elements of a page and the runs of text in them form a tree. Each node is content or not; an element is content if
any text below it is. Potentials tie a child to its parent: below an element without content nothing is content; below one with
content a child is content with a probability that its features give (tag, words of class, id and role, share of
linked text, amount of text). Each run of text adds evidence of its own (length, links, full stops). Sum-product
messages pass from the leaves to the root and back and give the exact marginal of each run of text; runs at one half and
above are the main text.

The model is trained from labelled pages: about ``train_pages`` pages (four times as many at most, none over a million characters)
that mark their article with an ``article`` element, drawn by a hash of the id, and variants of them, in which the same content and the same
boilerplate stand in other containers (:data:`CONTENT_FRAMES`, :data:`OTHER_FRAMES`), so that the model knows more layouts
than the pages happen to use. The model is a few hundred numbers. Pages are extracted where they lie, nothing is shuffled.

Scripts, styles, templates, comments and the head never hold text, nor do text fields, embedded frames and the titles, descriptions and
metadata of drawings; a template that is never closed hides nothing. Elements that a browser closes by itself are closed; a tag that never ends
is text. ``br`` counts as white space.

Defined results: NULL and empty pages have an empty text; without labelled pages the variants' frames alone are learnt, on invented words; repeated pages have equal
texts; any depth of nesting and length of page is read to its end.
"""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, small_batches
from .quality_classifier import Ftrl, sigmoid

TRAIN_PAGES = 300
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no markup, up to their closing tag or the end of the page, as in a browser. All but ``xmp`` hold no text.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: In drawings and formulas, tags do not break a run of text. Some hold no text of the page; blocks of HTML end the drawing or formula.
ALIEN = frozenset("svg math".split())
_ALIEN_HIDDEN = frozenset("style script title desc metadata".split())
_ALIEN_SPACED = frozenset("text mtr mtd annotation annotation-xml".split())
_ALIEN_ENDS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strike strong sub sup table tt u ul var address article aside details dialog fieldset figure footer form "
    "header main nav section summary".split()
)
#: An opening tag closes an open element of these kinds.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}
#: Words of class, id and role, by what they say about an element.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs toolbar topbar skip",
    "header": "header masthead banner branding logo hero tagline byline meta",
    "footer": "footer foot copyright legal colophon bottom",
    "side": "sidebar aside side rail widget related recommended recommendations complementary more trending popular teaser tags",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense adslot commercial dfp",
    "notice": "notice notices cookie cookies consent gdpr alert warning modal popup overlay newsletter subscribe subscription message paywall disclaimer",
    "comment": "comment comments commentlist reply replies respond response responses discussion disqus feedback thread reader",
    "form": "form search login signin signup register contact",
    "share": "share sharing social follow like buttons",
    "content": "content article post entry story main body text maincontent articlebody postbody prose page copy",
}
_GROUP = {word: group for group, words in WORDS.items() for word in words.split()}
#: An attribute's name and value as browsers read them, and all attributes of a tag; a quote that is never closed is part of a name.
_ATTRIBUTE = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+("[^"]*+"|'[^']*+'|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+))?+""")
_ATTRIBUTES = re.compile(rf"(?:[ \t\n\r\f/]++|{_ATTRIBUTE.pattern})*+")
_NAMING = ("class", "id", "role", "itemprop")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")


class Page:
    """Nodes in page order, parents first: elements with tag and word groups, and runs of text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups = [-1], ["body"], [()]
        self.text: list[str | None] = [None]
        self.linked = [0]
        self._read(source)

    def _node(self, parent: int, tag: str, groups: tuple, text: str | None, linked: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.groups.append(groups)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]
        parts: list[str] = []
        links = linked = at = 0
        size, lower, last_template = len(source), None, 0
        alien: list[str] = []  # open drawings, formulas, and HTML inside drawings
        mute = ""  # the open element in them that holds no text

        def lowered() -> str:
            nonlocal lower
            if lower is None:
                lower = source.lower() if source.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), source)
            return lower

        def flush() -> None:
            nonlocal linked
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                self._node(stack[-1][1], "#text", (), text, min(linked, len(text)))
            linked = 0

        def close(depth: int) -> None:
            flush()
            del stack[depth:]

        while at < size:
            start = source.find("<", at)
            if start < 0:
                start = size
            if start > at and not mute:
                parts.append(source[at:start])
                linked += (start - at) if links else 0
            if start == size:
                break
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            foreign = bool(alien) and alien[-1] != "foreignobject"
            if foreign and source.startswith("<![CDATA[", start):
                end = source.find("]]>", start + 9)
                end = size if end < 0 else end
                parts.append("" if mute else html.escape(source[start + 9 : end], quote=False))
                at = min(end + 3, size)
                continue
            if source.startswith(("<!", "<?"), start):
                end = source.find(">", start)
                at = size if end < 0 else end + 1
                continue
            name = _NAME.match(source, start + 1)
            if not name:
                parts.append("" if mute else "<")
                at = start + 1
                continue
            end = self._tag_end(source, name.end())
            if end < 0:
                parts.append(source[start:])
                break
            tag, inside, at = name[0].lower(), source[name.end() : end], end + 1
            if tag.startswith("/"):
                tag = tag[1:]
                if tag == mute:
                    mute = ""
                elif tag in ALIEN or tag == "foreignobject":
                    if tag in alien:
                        del alien[len(alien) - 1 - alien[::-1].index(tag) :]
                        mute = ""
                elif foreign and tag in _ALIEN_SPACED:
                    parts.append(" ")
                elif tag == "a":
                    links = max(links - 1, 0)
                elif tag == "br" or tag == "p" and all(t != "p" for t, _ in stack[-3:]):
                    parts.append(" ")
                elif tag not in INLINE:
                    wall = "template" if at <= last_template else tag
                    depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] in (tag, wall)), 0)
                    if depth and stack[depth][0] == tag:
                        node = stack[depth][1]
                        close(depth)
                        links = 0
                        if foreign:
                            alien.clear()
                            mute = ""
                        if tag == "template":
                            for of_nodes in (self.parent, self.tag, self.groups, self.text, self.linked):
                                del of_nodes[node:]
                continue
            if foreign:
                if tag in _ALIEN_ENDS:
                    while alien and alien[-1] != "foreignobject":
                        alien.pop()
                    mute = ""
                elif tag in _ALIEN_HIDDEN:
                    mute = mute or ("" if inside.endswith("/") else tag)
                    continue
                elif tag in _ALIEN_SPACED:
                    parts.append(" ")
                    continue
                elif tag not in ALIEN and tag not in ("foreignobject", "a"):
                    continue
            if tag in ALIEN or tag == "foreignobject" and foreign:
                if not inside.endswith("/"):
                    alien.append(tag)
                continue
            if tag in RAW and not inside.endswith("/"):
                stop = lowered().find(f"</{tag}", at)
                while stop >= 0 and source[stop + 2 + len(tag) : stop + 3 + len(tag)] not in tuple(" \t\n\r\f/>"):
                    stop = lower.find(f"</{tag}", stop + 1)
                stop = size if stop < 0 else stop
                if tag == "xmp":
                    flush()
                    links = 0
                    if stack[-1][0] == "p":
                        stack.pop()
                    stack.append((tag, self._node(stack[-1][1], tag, word_groups(inside), None, 0)))
                    parts.append(html.escape(source[at:stop], quote=False))
                    close(len(stack) - 1)
                end = source.find(">", stop) if stop < size else -1
                if end >= 0:
                    end = max(end, self._tag_end(source, stop + 2 + len(tag)))
                at = size if end < 0 else end + 1
                continue
            if tag in INLINE:
                if tag == "a" and not inside.endswith("/"):
                    links = 1
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag in ("html", "body", "head"):
                flush()
                continue
            flush()
            links = 0
            if tag in VOID:
                continue
            if tag == "template":
                last_template = lowered().rfind("</template") if not last_template else last_template
            elif stack[-1][0] == "p" and tag != "noscript":
                stack.pop()
            shut, stop = _CLOSES.get(tag, ()), _STOPS.get(tag, {"table"})
            for d in range(len(stack) - 1, 0, -1) if shut else ():
                if stack[d][0] in stop or stack[d][0] == "template":
                    break
                if stack[d][0] in shut:
                    del stack[d:]
                    break
            node = self._node(stack[-1][1], tag, word_groups(inside), None, 0)
            if not inside.endswith("/"):
                stack.append((tag, node))
        flush()

    @staticmethod
    def _tag_end(source: str, at: int) -> int:
        """Where the tag's ``>`` stands, outside quoted values; -1 if the tag never ends."""
        end = _ATTRIBUTES.match(source, at).end()
        return end if end < len(source) else -1


def word_groups(attributes: str) -> tuple:
    if "=" not in attributes:
        return ()
    found = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        for token in _TOKEN.findall(value) if name.lower().endswith(_NAMING) else ():
            group = _GROUP.get(token.lower())
            if group:
                found.add(group)
    return tuple(sorted(found))


def _bin(value: float, borders: tuple) -> int:
    return sum(value >= b for b in borders)


_LENGTHS, _SHARES = (1, 20, 60, 150, 400, 1200), (0.05, 0.3, 0.7)


def features(page: Page) -> tuple[list[list[str] | None], list[str | None], list[float]]:
    """Per node: the features of an element's tie to its parent, the kind of evidence of a run of text, and its weight.

    Runs next to each other are alike, so their evidence is not independent: together the runs of one container
    (the element around the blocks) weigh as much as half a run of its own.
    """
    n = len(page.parent)
    chars, linked = [len(t) if t else 0 for t in page.text], list(page.linked)
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    ties: list[list[str] | None] = [None]
    kinds: list[str | None] = [None]
    for i in range(1, n):
        share = _bin(linked[i] / max(chars[i], 1), _SHARES)
        amount = _bin(chars[i], _LENGTHS)
        if page.text[i] is None:
            tag, groups = page.tag[i], page.groups[i]
            named = [f"group {g}" for g in groups] or ["no group"]
            ties.append([f"tag {tag}", f"share {share}", f"amount {amount}", *named, f"tag {tag} {bool(groups)}"])
            kinds.append(None)
        else:
            ties.append([f"text in {page.tag[page.parent[i]]}"])
            ended = page.text[i][-1] in ".!?:;\"'”»"
            kinds.append(f"{share} {amount} {ended}")
    container = [page.parent[page.parent[i]] if k and page.parent[i] else 0 for i, k in enumerate(kinds)]
    runs: dict[int, int] = {}
    for c, k in zip(container, kinds, strict=True):
        if k:
            runs[c] = runs.get(c, 0) + 1
    return ties, kinds, [0.5 / runs[c] if k else 0.0 for c, k in zip(container, kinds, strict=True)]


class Model:
    """Weights of the parent-child potentials and likelihoods of the evidence of text."""

    #: Probability of content below an element without any.
    STRAY = 1e-4

    def __init__(self, weights: dict[str, float], evidence: dict[str, float]):
        self.weights, self.evidence = weights, evidence

    def marginals(self, page: Page) -> list[float]:
        """Probability of content per node, by sum-product over the tree."""
        n, parent = len(page.parent), page.parent
        ties, kinds, weigh = features(page)
        stray, weights = self.STRAY, self.weights
        tie = [1.0] * n
        up_no, up_yes = [1.0] * n, [1.0] * n  # evidence below and at a node, given its label
        to_no, to_yes = [1.0] * n, [1.0] * n  # message to the parent, given the parent's label
        for i in range(n - 1, 0, -1):
            p = tie[i] = sigmoid(weights.get("bias", 0.0) + sum(weights.get(f, 0.0) for f in ties[i]))
            yes = up_yes[i] * (math.exp(weigh[i] * self.evidence.get(kinds[i], 0.0)) if kinds[i] else 1.0)
            no, up_yes[i] = up_no[i], yes
            to_yes[i] = p * yes + (1 - p) * no
            to_no[i] = stray * yes + (1 - stray) * no
            up = parent[i]
            a, b = up_yes[up] * to_yes[i], up_no[up] * to_no[i]
            scale = a + b
            up_yes[up], up_no[up] = a / scale, b / scale
        down = [1.0] * n  # probability of content given everything outside the node's subtree and inside it
        for i in range(1, n):
            up = parent[i]
            # The parent's belief without this child's message, then through the tie.
            yes, no = down[up] / max(to_yes[i], 1e-300), (1 - down[up]) / max(to_no[i], 1e-300)
            p = tie[i]
            a = (yes * p + no * stray) * up_yes[i]
            b = (yes * (1 - p) + no * (1 - stray)) * up_no[i]
            down[i] = a / (a + b) if a + b > 0 else 0.0
        return down

    def extract(self, source: str) -> str:
        page = Page(source)
        return "\n".join(t for t, m in zip(page.text, self.marginals(page), strict=True) if t is not None and m >= 0.5)


def fit(labelled: list[tuple[Page, list[bool]]], epochs: int = 4) -> Model:
    """Potentials from pages whose runs of text are labelled."""
    numbers: dict[str, int] = {"bias": 0}
    rows, seen = [], {}
    for page, truth in labelled:
        content = list(truth)
        for i in range(len(content) - 1, 0, -1):
            content[page.parent[i]] |= content[i]
        ties, kinds, _ = features(page)
        for i in range(1, len(content)):
            if kinds[i]:
                seen.setdefault(kinds[i], [0, 0])[content[i]] += 1
            if content[page.parent[i]]:
                at = [0, *(numbers.setdefault(f, len(numbers)) for f in ties[i])]
                rows.append((np.array(sorted(set(at))), int(content[i])))
    model = Ftrl(len(numbers), alpha=0.5, l1=0.0, l2=1e-3)
    for _ in range(epochs):
        for at, y in rows:
            model.learn(at, np.ones(len(at)), y)
    learnt = model.weights(slice(None))
    totals = [sum(s[k] for s in seen.values()) + len(seen) + 1 for k in (0, 1)]
    evidence = {k: math.log((s[1] + 1) / totals[1] / ((s[0] + 1) / totals[0])) for k, s in seen.items()}
    return Model({f: float(learnt[i]) for f, i in numbers.items()}, evidence)


CONTENT_FRAMES = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
    '<div id="main-content"><div>{}</div></div>', '<div class="post-body">{}</div>', '<section class="entry">{}</section>',
    '<div class="page"><div class="story-text">{}</div></div>', '<div role="main">{}</div>', "<div><div>{}</div></div>",
    '<main id="main"><section>{}</section></main>', '<div itemprop="articleBody">{}</div>',
)
#: {links} is a list of links, {short} a few words, {long} sentences, {field} a form's inside.
OTHER_FRAMES = (
    "<nav><ul>{links}</ul></nav>", '<ul class="menu">{links}</ul>', '<div id="navbar"><a href="/">{short}</a> <a href="/">{short}</a></div>',
    '<div class="breadcrumbs"><a href="/">{short}</a> &gt; {short}</div>', "<header><h1>{short}</h1></header>", "<header><p>{short}</p><ul>{links}</ul></header>",
    '<div class="site-header">{short}</div>', '<div id="header"><h2>{short}</h2><p>{long}</p></div>', "<footer>{short}</footer>", "<footer><p>{long}</p><ul>{links}</ul></footer>",
    '<div class="footer">&copy; {short}</div>', "<aside><h3>{short}</h3><p>{long}</p></aside>", "<aside><ul>{links}</ul></aside>", "<aside>{long}</aside>",
    '<div class="sidebar"><h4>{short}</h4><p>{long}</p><ul>{links}</ul></div>', '<div id="related"><ul>{links}</ul></div>', '<div class="ad">{long}</div>',
    '<div class="advert"><p>{long}</p></div>', '<div class="sponsored"><a href="/x">{short}</a></div>', '<section class="promo"><p>{long}</p></section>',
    '<div class="cookie-notice"><p>{long}</p><button>{short}</button></div>', '<div class="notice">{long}</div>', '<div id="newsletter"><p>{long}</p></div>',
    '<div class="alert" role="alert">{long}</div>', "<form>{field}</form>", '<form action="/s"><p>{long}</p>{field}</form>', '<div class="search">{field}</div>',
    '<section class="comments"><h3>{short}</h3><p>{long}</p><p>{long}</p></section>', '<div id="comments"><div class="comment"><p>{long}</p></div></div>',
    '<ol class="commentlist"><li><p>{long}</p></li><li><p>{long}</p></li></ol>', '<ul class="comments"><li>{long}</li></ul>', '<div class="share"><a href="/f">{short}</a></div>',
    "<button>{short}</button>", "<select><option>{short}<option>{short}</select>",
)


def variants(blocks: list[tuple[str, str]], words: list[str], draw: random.Random) -> tuple[str, set[str]]:
    """A page with these blocks as content, in frames drawn at random, and the texts of its other blocks."""

    def short() -> str:
        return " ".join(draw.choice(words) for _ in range(draw.randint(1, 5)))

    def long() -> str:
        return " ".join(" ".join(draw.choice(words) for _ in range(draw.randint(4, 16))).capitalize() + "." for _ in range(draw.randint(1, 4)))

    def other() -> str:
        links = "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(draw.randint(2, 8)))
        field = f"<label>{short()}</label><input><button>{short()}</button>"
        frame = draw.choice(OTHER_FRAMES)
        return "\x01" + re.sub(r"\{(\w+)\}", lambda m: {"short": short, "long": long}.get(m[1], lambda: links if m[1] == "links" else field)(), frame) + "\x02"

    inside = [f"<{tag}>{html.escape(text, quote=False)}</{tag}>" for tag, text in blocks]
    for _ in range(draw.choice((0, 0, 1, 2))):
        inside.insert(draw.randint(1, len(inside)), other())
    around = lambda: "".join(other() for _ in range(draw.randint(0, 4)))
    body = around() + draw.choice(CONTENT_FRAMES).replace("{}", "".join(inside)) + around()
    return f"<div>{body}</div>" if draw.random() < 0.3 else body


def excerpt(blocks: list[tuple[str, str]], draw: random.Random) -> list[tuple[str, str]]:
    """All blocks, or a few of them, some cut to a sentence: articles are short as well."""
    if draw.random() < 0.5:
        at = draw.randrange(len(blocks))
        blocks = blocks[at : at + draw.randint(1, 4)]
    return [(tag, text.split(". ")[0] if draw.random() < 0.3 else text) for tag, text in blocks]


def marked_page(body: str) -> tuple[Page, list[bool]]:
    """A page whose parts between marks are not content."""
    depth, marked = 0, []
    for piece in re.split("([\x01\x02])", body):
        depth += {"\x01": 1, "\x02": -1}.get(piece, 0)
        if piece not in ("\x01", "\x02"):
            marked.append(re.sub(r">([^<]+)", lambda m: ">\x03" + m[1], piece) if depth else piece)
    page = Page("".join(marked))
    truth = [t is not None and "\x03" not in t for t in page.text]
    page.text = [t.replace("\x03", "").strip() if t else t for t in page.text]
    return page, truth


def article_page(source: str) -> tuple[Page, list[bool]] | None:
    """A page that marks its article itself."""
    page = Page(source)
    inside = [t == "article" for t in page.tag]
    for i in range(1, len(inside)):
        inside[i] |= inside[page.parent[i]]
    truth = [t is not None and y for t, y in zip(page.text, inside, strict=True)]
    return (page, truth) if any(truth) else None


def train(pages: DataFrame, page_id: str = "page_id", source: str = "html", train_pages: int = TRAIN_PAGES, copies: int = 6) -> Model:
    """A model from at most about ``train_pages`` pages of the table and ``copies`` variants of each."""
    small_batches(pages.sparkSession)
    total = pages.count()
    draw = F.pmod(F.xxhash64(pages[page_id].cast("string"), F.lit(5)), F.lit(1 << 30))
    known = pages.where(draw < min(1 << 30, (train_pages << 30) // max(total, 1))).where(F.length(pages[source]) < 1 << 20)
    sample = sorted(r[0] for r in known.select(pages[source]).where(pages[source].isNotNull()).limit(4 * train_pages).collect())
    return train_from(sample, copies)


def train_from(sample: list[str], copies: int = 6) -> Model:
    random_draw = random.Random(3)
    labelled = [found for found in map(article_page, sample) if found]
    contents = [[(page.tag[page.parent[i]], t) for i, t in enumerate(page.text) if truth[i]] for page, truth in labelled]
    if not contents:
        invented = "ka lo mi ne ru sa to vu".split()
        contents = [[("h1", "Ka lo"), *[("p", " ".join(random_draw.choice(invented) for _ in range(random_draw.randint(4, 60))) + ".") for _ in range(4)]] for _ in range(40)]
    words = sorted({w for blocks in contents for _, t in blocks[:3] for w in t.lower().split()})[:20000] or ["x"]
    for blocks in contents:
        kept = [(tag if tag in ("p", "h1", "h2", "h3", "li", "blockquote") else "p", t) for tag, t in blocks]
        for _ in range(copies):
            labelled.append(marked_page(variants(excerpt(kept, random_draw), words, random_draw)))
    return fit(labelled)


def extract(pages: DataFrame, model: Model, source: str = "html") -> DataFrame:
    """``row`` (the page), ``text`` and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.evidence))

    def make():
        held = Model(*shared.value)

        def work(values: list) -> list:
            texts = [held.extract(v.decode("utf-8", "replace")) if v else "" for v in values]
            return [texts, [len(t) for t in texts]]

        return work

    return over_texts(pages, pages[source], make, "text string, n_chars bigint")
