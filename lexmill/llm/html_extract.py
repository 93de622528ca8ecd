"""Main text of web pages by template deduction from equivalence classes of tokens of same-host pages."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: Pages of a host are dealt into blocks of about so many by the hash of id and url; one template is deduced from a block
#: (from parts of it, if it has three times as many pages, or more characters).
BLOCK_PAGES, BLOCK_CHARS = 64, 4_000_000
#: Share of a layout's pages that an equivalence class must occur on, and pages from which on repeated text is template.
SUPPORT, TEXT_PAGES = 0.5, 4

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Element names by what HTML says of them.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul video".split())
CLOSES_P = BLOCK - {"br", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "head", "html", "body", "title"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th", "blockquote", "aside", "nav", "form"}
NEVER = set("head nav aside footer form button select option dialog menu template svg math canvas object audio video map datalist input".split())
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Class names and ids that pages use for what is not the article, alone or joined to one another (cookie-notice).
ASIDE_WORDS = set("ad ads adv advert adverts advertisement advertising adsense adbox banner banners promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar sidebars comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar newsletter subscribe subscription signup login search widget widgets pagination pager copyright".split())


@dataclass
class Text:
    """A piece of text: its block, its path of element keys (innermost first), its token, and what surrounds it; marked: aside by a name of ASIDE_WORDS."""

    block: int
    up: tuple
    at: int
    aside: bool
    main: bool
    link: bool
    value: str
    marked: bool = False

    @property
    def path(self) -> tuple[str, ...]:
        out, here = [], self.up
        while here:
            out.append(here[0])
            here = here[1]
        return tuple(reversed(out))


@dataclass
class Named:
    """An element with a class or id of ASIDE_WORDS; one that turns out to hold the article is no aside."""

    holds: bool = False


@dataclass
class Page:
    tokens: list[str] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)


def aside_name(name: str) -> bool:
    """Whether a class or id is one of ASIDE_WORDS or made of nothing else; has-comments or related-work aren't."""
    parts = [w.lower() for w in PARTS.findall(name) if not w.isdigit()]
    return name.lower() in ASIDE_WORDS or bool(parts) and all(w in ASIDE_WORDS for w in parts)


def parse(html: str) -> Page:
    """Tokens (elements by path, opening and closing, and pieces of text by path) and texts of a page, however malformed.

    A key is a digest of the path and the element's name, and paths share their outer part, so nesting costs no more
    than its depth.
    """
    page, stack, block, at, low = Page(), [], 0, 0, None
    inside: list[tuple[Text, tuple[Named, ...]]] = []  # texts in elements with such names

    def shut(n: int) -> None:
        nonlocal block
        while len(stack) > n:
            name, key, *_ = stack.pop()
            page.tokens.append(f"/{key}")
            block += name in BLOCK

    def text(value: str) -> None:
        if value and not value.isspace():
            page.tokens.append(f"={stack[-1][1] if stack else ''}={' '.join(value.split())}")
            page.texts.append(Text(block, stack[-1][5] if stack else (), len(page.tokens) - 1, bool(stack and stack[-1][2]), bool(stack and stack[-1][3]), bool(stack and stack[-1][4]), unescape(value)))
            if stack and stack[-1][6]:
                inside.append((page.texts[-1], stack[-1][6]))
        elif value and page.texts and page.texts[-1].block == block:
            page.texts[-1].value += " "

    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "p" and not any(s[0] == "p" for s in stack):
                block += 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    shut(i)
                    break
            continue
        block += name in BLOCK
        if name in VOID:
            continue
        if name in CLOSES_P or name in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" and name in CLOSES_P or stack[i][0] in SIBLINGS.get(name, ()):
                    shut(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if name in RAW:
            low = html.lower() if low is None else low
            end = low.find(f"</{name}", at) if len(low) == len(html) else -1
            if end < 0 and (close := re.compile(f"</{name}", re.I).search(html, at)):
                end = close.start()
            at = len(html) if end < 0 else end
            if end >= 0 and (gt := html.find(">", end)) >= 0:
                at = gt + 1
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3] or m[6] or "")}
        inside_main = bool(stack and stack[-1][3])
        words = {w.lower() for w in PARTS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
        role = attrs.get("role", "").lower()
        aside = bool(stack and stack[-1][2]) or name in NEVER or role in ASIDE_ROLES or (not inside_main and name == "header")
        here = name in ("article", "main") or role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
        main = inside_main or here
        around = stack[-1][6] if stack else ()
        if here:
            for n in around:
                n.holds = True
        elif name not in ("html", "body") and name not in HEADINGS and any(aside_name(w) or w.lower() == "header" and not inside_main for w in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()):
            around = (*around, Named())
        label = f">{name}" + "".join(f".{w}" for w in sorted(words) if not w.isdigit())
        key = blake2b(f"{stack[-1][1] if stack else ''}{label}".encode("utf-8", "replace"), digest_size=9).hexdigest() + label
        stack.append((name, key, aside, main, bool(stack and stack[-1][4]) or name == "a", (key, stack[-1][5] if stack else ()), around))
        page.tokens.append(key)
    shut(0)
    for x, around in inside:
        x.marked = any(not n.holds for n in around)
    return page


@dataclass
class Template:
    """The valid classes of a layout, outer before inner: the order of a class's tokens, its parent (-1: none) and slot there."""

    classes: list[tuple[str, ...]] = field(default_factory=list)
    parents: list[tuple[int, int]] = field(default_factory=list)
    texts: set[str] = field(default_factory=set)


def _tuples(tokens: list[str], order: tuple[str, ...]) -> list[list[int]] | None:
    """Where a class's tokens stand on a page, one list for each time it occurs; None if they don't come in order, time by time."""
    place = {t: i for i, t in enumerate(order)}
    at = [(i, place[t]) for i, t in enumerate(tokens) if t in place]
    if any(p != i % len(order) for i, (_, p) in enumerate(at)) or len(at) % len(order):
        return None
    return [[i for i, _ in at[k : k + len(order)]] for k in range(0, len(at), len(order))]


def _in_order(lists: list[list[str]]) -> list[str]:
    """The tokens of the first list as far as their order is that of all others."""
    order = lists[0]
    for tokens in lists[1:]:
        place, kept, last = {t: i for i, t in enumerate(tokens)}, [], -1
        for t in order:  # a token that breaks the order leaves the class
            if place[t] > last:
                kept.append(t)
                last = place[t]
        order = kept
    return order


def deduce(pages: list[Page]) -> Template:
    """The template of pages of one layout, by equivalence classes of tokens.

    Tokens are grouped by their vector of counts over the distinct pages. A class counts if it occurs on enough pages
    and is valid: each page holds its tokens in one order, time after time, and each time lies in one and the same slot
    (between two neighbouring tokens) of the class around it. The class that occurs once on each page is the trunk; it
    keeps the tokens whose order agrees. The others nest in slots, smallest spans innermost. From TEXT_PAGES distinct
    pages on, pieces of text in the trunk are template text where their element holds no other text on any page: a
    paragraph that recurs among others stays.
    """
    distinct = list({tuple(p.tokens): p for p in pages}.values())
    out = Template()
    if len(distinct) < 2:
        return out
    vectors: dict[str, list[int]] = defaultdict(lambda: [0] * len(distinct))
    for i, p in enumerate(distinct):
        for t, n in Counter(p.tokens).items():
            vectors[t][i] = n
    classes: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for t, v in vectors.items():
        if sum(map(bool, v)) >= max(2, SUPPORT * len(distinct)):
            classes[tuple(v)].add(t)
    ones = (1,) * len(distinct)
    found = []  # (mean span, order, tuples by page)
    for v, tokens in classes.items():
        first = next(p for p, n in zip(distinct, v, strict=True) if n)
        order = tuple(dict.fromkeys(t for t in first.tokens if t in tokens))
        if v == ones:
            order = tuple(_in_order([[t for t in p.tokens if t in tokens] for p in distinct]))
        where = [_tuples(p.tokens, order) for p in distinct] if order else [None]
        if all(w is not None for w in where):
            spans = [t[-1] - t[0] for w in where for t in w]
            found.append((v != ones, -sum(spans) / len(spans), order, where))
    found.sort(key=lambda x: x[:3])
    slots = [[(-1, 0)] * len(p.tokens) for p in distinct]
    for _, _, order, where in found:
        homes = {s[i] for s, w in zip(slots, where, strict=True) for t in w for i in (t[0], t[-1])}
        inside = {s[i] for s, w in zip(slots, where, strict=True) for t in w for i in t}
        if len(inside) != 1 or homes != inside:
            continue  # reaches over slots of the class around it
        k = len(out.classes)
        out.classes.append(order)
        out.parents.append(next(iter(homes)))
        for s, w in zip(slots, where, strict=True):
            _fill(s, w, k)
        if k == 0 and out.parents[0] == (-1, 0) and len(distinct) >= TEXT_PAGES and all(len(x) == 1 for x in where):
            trunk = set(order)
            own = {t.split("=", 2)[1] for p in distinct for t in p.tokens if t[0] == "=" and t not in trunk}
            out.texts = {t for t in order if t[0] == "=" and t.split("=", 2)[1] not in own}
    return out


def _fill(slots: list[tuple[int, int]], where: list[list[int]], k: int) -> None:
    """Mark the slots of class k: (k, j) from its j-th token up to the next; behind the last token is the slot around it."""
    for t in where:
        for j, (a, b) in enumerate(zip(t, t[1:], strict=False)):
            slots[a:b] = [(k, j)] * (b - a)


def slots(page: Page, template: Template) -> list[tuple[int, int]]:
    """For each text of a page the slot it is in: (class, slot of the class), innermost."""
    out = [(-1, 0)] * len(page.tokens)
    trunk = -1
    for k, order in enumerate(template.classes):
        where = _tuples(page.tokens, order)
        if where:
            _fill(out, where, k)
            for t in where[:1]:
                trunk = max(trunk, t[-1]) if k == 0 else trunk
    for i in range(trunk, len(out)) if trunk >= 0 else ():
        out[i] = (0, len(template.classes[0]) - 1) if out[i] == (-1, 0) else out[i]
    return [out[x.at] for x in page.texts]


def _fixed(page: Page, template: Template) -> set[int]:
    """Numbers of the texts in blocks that are template text throughout, unless the page is mostly that (copies of one another)."""
    blocks: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(page.texts):
        blocks[x.block].append(i)
    out = {i for b in blocks.values() if all(page.tokens[page.texts[i].at] in template.texts for i in b) for i in b}
    kept = [(i in out, len(x.value)) for i, x in enumerate(page.texts) if not (x.aside or x.marked) and not x.link and (x.main or not any(y.main for y in page.texts))]
    return out if 2 * sum(n for f, n in kept if f) < sum(n for _, n in kept) else set()


def _root(key: str) -> bool:
    return key.split(">", 1)[1].split(".")[0] in ("html", "body")


def main_texts(pages: list[Page]) -> list[str]:
    """The main text of each page of one block."""
    named = [any(x.main for x in p.texts) for p in pages]
    layouts = [[p for p, n in zip(pages, named, strict=True) if n is side] for side in (True, False)]
    templates = [deduce(x) for x in layouts]
    plain, template = layouts[1], templates[1]
    where = [slots(p, template) for p in plain]
    fixed = {id(p): _fixed(p, templates[0 if n else 1]) for p, n in zip(pages, named, strict=True)}
    # slots that hold text of a page's own, and the deepest path that all text in the larger ones shares
    size: dict[tuple[int, int], int] = defaultdict(int)
    for p, at in zip(plain, where, strict=True):
        for i, (x, s) in enumerate(zip(p.texts, at, strict=True)):
            if not (x.aside or x.marked) and not x.link and i not in fixed[id(p)]:
                size[s] += len(x.value)
    shared: tuple[str, ...] | None = None
    for p, at in zip(plain, where, strict=True):
        for i, (x, s) in enumerate(zip(p.texts, at, strict=True)):
            if not (x.aside or x.marked) and not x.link and i not in fixed[id(p)] and 20 * size[s] >= max(size.values()):
                path, n = x.path, 0
                if shared is not None:
                    while n < min(len(shared), len(path)) and shared[n] == path[n]:
                        n += 1
                shared = path if shared is None else shared[:n]
    # where only one element, such as the one paragraph of each page, holds own text, its neighbours belong to it
    while shared and (_root(shared[-1]) or shared[-1].rsplit(">", 1)[-1].split(".")[0] not in ("div", "section", "td")):
        shared = shared[:-1]
    at_of = {id(p): at for p, at in zip(plain, where, strict=True)}
    out = []
    for p, has in zip(pages, named, strict=True):
        free = [(x, s) for i, (x, s) in enumerate(zip(p.texts, at_of.get(id(p), [None] * len(p.texts)), strict=True)) if not (x.aside or x.marked) and i not in fixed[id(p)]]
        if has:
            chosen = [x for x, _ in free if x.main]
        else:
            chosen = [x for x, s in free if (x.path[: len(shared)] == shared if shared else not size or s in size)]
            chosen = chosen or [x for x, _ in free if not x.link]
        if not chosen:  # names alone never empty a page
            chosen = [x for x in p.texts if not x.aside and (x.main or not has and not x.link)]
        blocks: dict[int, list[str]] = defaultdict(list)
        for x in chosen:
            blocks[x.block].append(x.value)
        out.append(" ".join(" ".join("".join(b).split()) for b in blocks.values() if not "".join(b).isspace()))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    The pages of each host are dealt into blocks of about BLOCK_PAGES, so no task holds a host, and a template is
    deduced from each block, apart for pages with and without article or main elements. Blocks of text that are template
    text are left out wherever they stand. Of pages without such elements the text is what lies in the deepest element
    around the slots with most own text, or if that is the body what is in slots with own text; article and main
    elements, where a page has them, mark the article, whichever slots they hold. What is marked as menu, form, advert,
    comment and the like is left out: by element or role, or by a whole class name or id, which counts for no heading,
    article, main element or what holds one, and never empties a page; such texts differ from page to page as articles
    do, so no template tells them apart. Words within a piece of text are no tokens: common words would fall into
    classes by chance, and the article must stay whole. Copies of one article keep their text. Null, empty and textless
    pages give ''; null urls share a host; repeated rows and null ids stay; other columns are left out.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    src = pages.select(id_col, url_col, html_col, host.alias("__host"))
    sizes = pages.select(host.alias("__host")).groupBy("__host").count().where(F.col("count") > BLOCK_PAGES)
    several, _ = small(sizes.select(F.col("__host").alias("__h"), F.ceil(F.col("count") / BLOCK_PAGES).cast("int").alias("__n")))
    salted = src.join(several, F.col("__host") == F.col("__h"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(id_col, url_col), F.col("__n")).cast("int"), F.lit(0)))
    dealt = salted.select(id_col, url_col, html_col, "__host", "__salt").repartition("__host", "__salt").sortWithinPartitions("__host", "__salt", id_col, url_col)
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars, key = 0, None

        def out() -> pa.RecordBatch:
            texts = iter(main_texts([parse(h) for _, _, h in held if h]))
            texts = [next(texts) if h else "" for _, _, h in held]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], types[0]), pa.array([r[1] for r in held], types[1]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

        types = None
        for b in batches:
            types = types or (b.schema.field(0).type, b.schema.field(1).type)
            for i in range(b.num_rows):
                row = tuple(b.column(c)[i].as_py() for c in range(5))
                if held and (row[3:] != key or len(held) == 3 * BLOCK_PAGES or chars > BLOCK_CHARS):
                    yield out()
                    held.clear()
                    chars = 0
                key, chars = row[3:], chars + len(row[2] or "")
                held.append(row[:3])
        if held:
            yield out()

    return dealt.mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars bigint")
