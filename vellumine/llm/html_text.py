"""Main text of web pages by gradient-boosted trees over DOM nodes with hierarchical decoding.

A tolerant parser makes a tree of block elements; inline elements only add to the text of the block around them. Each block has features of
its tag, the tokens of its attributes, its depth, the text, links and sentences of its subtree, its siblings and its ancestors.
A token or tag above a block also counts by the share of the page's text that stands under it, as a form or a "sidebar-left" around a whole page says little.
Names such as has-sidebar or with-comments tell what a block holds besides and are no tokens of it.
Trees give the log odds that a block is main text. Decoding picks the labels with the greatest sum of log odds among those in which a
dropped block has no kept descendant. A page of which nothing is kept is read again without the names and tags of menus, frames, sides and forms on blocks that hold
half of its text and two paragraphs or more, and with BENEFIT more for blocks that stand under no telling name or tag. The kept blocks' text is decoded, its white space made single, and joined in page order.

The trees are trained on PAGES made-up pages of many layouts, whose main text is known; the training is a function of a seed alone.

Cases: null or empty html, or none kept: an empty text. A page of one paragraph, also right in the body, is main text. Text of maths, drawings and media is text of the block around it. Broken, unclosed or cut markup is read as far as it goes: an unclosed tag at the end is dropped.
Repeated rows are read each. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import boosting
from vellumine.llm.joins import unused
from vellumine.plans.scratch import ship

PAGES, SEED = 800, 3
#: HTML elements by their role for the parser.
BLOCKS = set("""html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption
nav header footer aside form fieldset details summary address center hgroup dialog menu""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
MUTE = set("script style template noscript iframe textarea select button title head option datalist".split())
RAW = set("script style textarea title iframe noscript template".split())
#: A start tag of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
KEEPS_OPEN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|data-role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Groups of attribute tokens, in English, German, French and Spanish.
GROUPS = {
    "main": "article content main post entry story body text blog page copy prose articlebody read single inhalt artikel beitrag contenu articulo contenido cuerpo".split(),
    "title": "title headline heading titel titre titulo".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc topbar tabs pagination pager skip brotkrumen navegacion".split(),
    "frame": "header footer masthead banner copyright colophon site bottom top legal kopf kopfzeile fuss fusszeile impressum entete pied cabecera pie".split(),
    "side": "sidebar aside side rail widget widgets related recommended more popular trending tags archive seitenleiste randspalte barre laterale barra lateral".split(),
    "ads": "ad ads advert advertisement sponsor sponsored promo promotion promoted adsense dfp affiliate werbung anzeige publicite publicidad anuncio".split(),
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert banner warning paywall hinweis avis aviso".split(),
    "form": "form newsletter subscribe subscription signup login search register email contact suche anmeldung recherche connexion buscar".split(),
    "talk": "comment comments commentlist reply replies respond disqus discussion reader readers feedback kommentar kommentare commentaire commentaires comentario comentarios".split(),
    "social": "share sharing social follow like tweet facebook teilen partager compartir".split(),
}
#: Log odds that a second reading adds for blocks under no telling name or tag.
BENEFIT = 2.0
#: A name that begins so tells what a block holds besides, or lacks.
BESIDES = {"has", "with", "no", "without", "hide", "show", "mit", "ohne", "avec", "sans", "con", "sin"}
_GROUP = {t: i for i, words in enumerate(GROUPS.values()) for t in words}
TAGS = ["article", "main", "section", "div", "p", "h", "ul", "li", "table", "td", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "figure", "body", "dl"]
_TAG = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": 5 for i in range(1, 7)} | {"ol": 6, "menu": 10, "tr": 8, "tbody": 8, "thead": 8, "th": 9, "dt": 19, "dd": 19, "figcaption": 17, "html": 18, "fieldset": 14}
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("tag", "parent", "groups", "pieces", "length", "link", "links", "stops", "kids")

    def __init__(self, tag: str, parent: int, groups: int):
        self.tag, self.parent, self.groups = tag, parent, groups
        self.pieces: list[tuple[int, str]] = []
        self.length = self.link = self.links = self.stops = self.kids = 0


def groups_of(attributes: str) -> int:
    """Bits of the groups of attribute tokens; the highest for a hidden element."""
    return _groups(attributes) if len(attributes) > 300 else _known_groups(attributes)


def _groups(attributes: str) -> int:
    bits = 0
    for value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            tokens = _WORD.findall(_CAMEL.sub(" ", name).lower())
            for token in tokens if tokens and tokens[0] not in BESIDES else ():
                if token in _GROUP:
                    bits |= 1 << _GROUP[token]
    return bits | (1 << 20 if HIDDEN.search(attributes) else 0)


_known_groups = lru_cache(20_000)(_groups)


def parse(page: str) -> list[Block]:
    """Blocks in page order, the root first; each with its own pieces of text and their order. Time is linear in the page, also where tags are never closed."""
    blocks = [Block("body", -1, 0)]
    here, stack, anchor, order = 0, [], 0, 0  # stack: (tag, index of the block to go back to or -1)
    opened: dict[str, list[int]] = {}  # places in the stack of each tag that is open
    solid: list[int] = []  # places in the stack of blocks
    endless: set[str] = set()  # tags that are closed nowhere from here on
    at, buffer = 0, []

    def top(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def push(tag, back):
        opened.setdefault(tag, []).append(len(stack))
        if back >= 0:
            solid.append(len(stack))
        stack.append((tag, back))

    def flush():
        nonlocal order
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                b = blocks[here]
                b.pieces.append((order, text))
                b.length += len(text)
                b.stops += text.count(".") + text.count("!") + text.count("?") + text.count(",")
                order += 1

    def add(raw):
        text = entities.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        if anchor:
            blocks[here].link += len(text)

    def close(depth):
        nonlocal here
        while len(stack) > depth:
            tag, back = stack.pop()
            opened[tag].pop()
            if back >= 0:
                solid.pop()
                flush()
                here = back

    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            if tag == "a":
                anchor = 0
            elif tag == "p" and not opened.get("p"):
                flush()
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag == "br" or tag == "hr":
            buffer.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in MUTE and not m[3].endswith("/"):
            if tag != "head":
                found = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if not found:
                    endless.add(tag)
                if tag in RAW or found:
                    at = found.end() if found else len(page) if tag in RAW else at
            else:
                found = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                if found:
                    at = found.start() if found[0].lower().startswith("<body") else found.end()
            continue
        if tag == "a":
            anchor = 1
            blocks[here].links += 1
            continue
        if tag not in BLOCKS:
            if not m[3].endswith("/"):
                push(tag, -1)
            continue
        # a block ends an open paragraph, and an item the one before it
        while solid:
            if tag in CLOSES:
                i = top(("p", *CLOSES[tag]))
                if i <= top(KEEPS_OPEN[tag]):
                    break
            elif stack[i := solid[-1]][0] != "p":
                break
            last = stack[i][0]
            close(i)
            if last != "p" and tag not in ("tr", "tbody"):
                break
        if tag in ("html", "body"):
            blocks[0].groups |= groups_of(m[3]) if m[3] else 0
            continue
        flush()
        anchor = 0
        push(tag, here)
        blocks[here].kids += 1
        blocks.append(Block(tag, here, groups_of(m[3]) if m[3] else 0))
        here = len(blocks) - 1
    add(page[at:])
    flush()
    return blocks


NAMES = ["tag", *(f"is_{t}" for t in TAGS), *(f"own_{g}" for g in GROUPS), *(f"over_{g}" for g in GROUPS), *(f"share_over_{g}" for g in GROUPS), "under_article", "under_aside", "under_form", "under_p_box", "share_under_aside", "share_under_form", "hidden", "depth", "own", "length", "link_share", "links", "stops", "share", "blocks", "paragraphs", "siblings", "place", "share_of_parent", "sibling_mean", "like_siblings", "mean_block"]


TELLING = [i for i, name in enumerate(NAMES) if name in {"is_nav", "is_header", "is_footer", "is_aside", "is_form", "under_aside", "under_form", "hidden"} | {f"{k}_{g}" for k in ("own", "over") for g in GROUPS if g not in ("main", "title")}]
#: Groups and tags that a second reading leaves out on blocks which hold most of the page.
LOOSE = sum(1 << list(GROUPS).index(g) for g in ("menu", "frame", "side", "form", "social"))


def features(trees: list[list[Block]], again: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all blocks of all trees, each block's parent in the same numbering (-1: root), and the first block of each tree. Again: as a second reading sees them."""
    first = np.cumsum([0, *map(len, trees)])
    blocks = [b for t in trees for b in t]
    n = len(blocks)
    base = np.repeat(first[:-1], np.diff(first))
    parent = np.array([b.parent for b in blocks], np.int64)
    parent = np.where(parent < 0, -1, parent + base)
    tag = np.array([_TAG.get(b.tag, 3) for b in blocks])
    groups = np.array([b.groups for b in blocks], np.int64)
    own, link, links, stops, kids = (np.array([getattr(b, k) for b in blocks], float) for k in ("length", "link", "links", "stops", "kids"))
    depth = np.zeros(n, np.int64)
    over = np.zeros(n, np.int64)
    above = np.zeros(n, np.int64)
    under = np.zeros((n, len(GROUPS) + 2))
    total = np.stack([own, link, links, stops, np.ones(n), (tag == 4).astype(float), (own > 0).astype(float)], axis=1)
    # parents stand before their children: down by levels, up by levels
    level = 0
    rows = np.flatnonzero(parent < 0)
    levels = [rows]
    children_of = np.argsort(parent, kind="stable")
    begin = np.searchsorted(parent[children_of], np.arange(n), "left")
    end = np.searchsorted(parent[children_of], np.arange(n), "right")
    while len(rows):
        counts = end[rows] - begin[rows]
        idx = np.repeat(begin[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        rows = children_of[idx]
        if len(rows):
            level += 1
            depth[rows] = level
            levels.append(rows)
    for rows in reversed(levels[1:]):
        np.add.at(total, parent[rows], total[rows])
    up = np.maximum(parent, 0)
    length = total[:, 0]
    page = length[base]
    share = length / np.maximum(page, 1)
    if again:
        wide = (share >= 0.5) & (total[:, 5] >= 2)
        groups = np.where(wide, groups & ~LOOSE, groups)
        tag = np.where(wide & np.isin(tag, (10, 11, 12, 13, 14)), 3, tag)
    kind = (1 << 0) * np.isin(tag, (0, 1)) | (1 << 1) * np.isin(tag, (10, 11, 12, 13)) | (1 << 2) * (tag == 14) | (1 << 3) * (tag == 4)
    held = np.stack([*((groups >> i) & 1 for i in range(len(GROUPS))), (kind >> 1) & 1, (kind >> 2) & 1], axis=1) * share[:, None]
    for rows in levels[1:]:
        over[rows] = over[parent[rows]] | groups[parent[rows]]
        above[rows] = above[parent[rows]] | kind[parent[rows]]
        under[rows] = np.maximum(under[parent[rows]], held[parent[rows]])
    siblings = np.where(parent < 0, 1, kids[up])
    place = np.zeros(n)
    place[children_of] = np.arange(n) - begin[np.maximum(parent[children_of], 0)]
    place = np.where(parent < 0, 0, place / np.maximum(siblings, 1))
    mean = np.where(parent < 0, length, (total[up, 0] - own[up]) / np.maximum(siblings, 1))
    same = np.bincount(up * 32 + tag, minlength=32 * n)[up * 32 + tag] / np.maximum(siblings, 1)
    cols = [tag, *(tag == i for i in range(len(TAGS))), *((groups >> i) & 1 for i in range(len(GROUPS))), *((over >> i) & 1 for i in range(len(GROUPS))), *under.T[: len(GROUPS)], *((above >> i) & 1 for i in range(4)), *under.T[len(GROUPS) :], ((groups | over) >> 20) & 1]
    cols += [depth, np.log1p(own), np.log1p(length), total[:, 1] / np.maximum(length, 1), total[:, 2], 100 * total[:, 3] / np.maximum(length, 1), share, total[:, 4], total[:, 5], siblings, place, length / np.maximum(total[up, 0], 1), np.log1p(mean), same, np.log1p(length / np.maximum(total[:, 6], 1))]
    return np.stack([np.asarray(c, float) for c in cols], axis=1), parent, first


def decode(odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which blocks to keep: the labels of greatest sum in which no dropped block has a kept descendant."""
    n = len(odds)
    keep, drop = odds.copy(), -odds
    order = range(n - 1, -1, -1)  # children stand after their parents
    up = parent.tolist()
    k, d = keep.tolist(), drop.tolist()
    for i in order:
        p = up[i]
        if p >= 0:
            k[p] += k[i] if k[i] > d[i] else d[i]
            d[p] += d[i]
    out = np.zeros(n, bool)
    for i in range(n):
        out[i] = (up[i] < 0 or out[up[i]]) and (up[i] < 0 or k[i] > d[i])
    return out


class Extractor:
    def __init__(self, model: boosting.Boosted):
        self.model = model

    def texts(self, pages: list[str]) -> list[str]:
        trees = [parse(p or "") for p in pages]
        out = self._read(trees)
        missed = [i for i, t in enumerate(out) if not t and len(trees[i]) > 1]
        for i, text in zip(missed, self._read([trees[i] for i in missed], True), strict=True):
            out[i] = text
        return out

    def _read(self, trees: list[list[Block]], again: bool = False) -> list[str]:
        if not trees:
            return []
        x, parent, first = features(trees, again)
        odds = np.clip(self.model.log_odds(x), -6, 6)
        if again:
            odds += BENEFIT * (x[:, TELLING].sum(axis=1) == 0)
        kept = decode(odds, parent)
        own = odds > 0  # text right under a kept container counts by the container's own odds
        out = []
        for t, lo in zip(trees, first, strict=False):
            pieces = [piece for i, b in enumerate(t) if kept[lo + i] and (own[lo + i] or b.parent >= 0) for piece in b.pieces]
            pieces.sort()
            out.append(" ".join(text for _, text in pieces))
        return out


MARK = ""


def made_up(rng: np.random.Generator) -> str:
    """A page of a random layout, in whose main text each piece ends in MARK."""
    pick = lambda *a: a[int(rng.random() * len(a))]
    chance = lambda p: rng.random() < p
    syllables = ("th", "en", "la", "or", "ti", "es", "de", "un", "ra", "so", "mi", "ch")

    def words(n):
        sizes = rng.integers(1, 5, max(1, n)).tolist()
        drawn = iter(rng.integers(0, len(syllables), sum(sizes)).tolist())
        return " ".join("".join(syllables[next(drawn)] for _ in range(size)) for size in sizes)

    def sentence(n):
        out = words(n).capitalize()
        return (out.replace(" ", ", ", 1) if chance(0.4) else out) + pick(".", ".", ".", "!", "")

    def prose(mark, n=None):
        n = int(rng.integers(1, 7)) if n is None else n
        out = " ".join(sentence(int(rng.integers(1, 25))) for _ in range(n))
        if chance(0.2):
            at = out.find(" ")
            out = out[:at] + ' <a href="/x">' + words(2) + "</a>" + out[at:] if at > 0 else out
        if chance(0.1):
            out = "<b>" + out + ("</b>" if chance(0.5) else "<br>")
        return out + (MARK if mark else "")

    def classes(*names):
        name = pick(*names)
        return f' {pick("class", "class", "id")}="{pick("", "", "site-", "page-", "x ", "c12 ")}{name}{pick("", "", "-wrap", "-inner", " row", "1")}"'

    def links(n):
        return "".join(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))

    def menu():
        inner = f"<ul>{links(int(rng.integers(2, 12)))}</ul>" if chance(0.7) else "".join(f'<a href="/">{words(1)}</a> ' for _ in range(5))
        return pick(f"<nav>{inner}</nav>", f"<nav{classes('main-nav', 'menu', 'navbar')}>{inner}</nav>", f"<div{classes('nav', 'menu', 'breadcrumb', 'navigation', 'topbar')}>{inner}</div>", f"<ul{classes('menu', 'nav', 'breadcrumbs')}>{links(5)}</ul>")

    def head():
        inner = pick(f"<h1>{words(2)}</h1>", f"<p>{words(4)}</p>", f'<a href="/">{words(2)}</a>', words(3)) + (menu() if chance(0.4) else "")
        return pick(f"<header>{inner}</header>", f"<div{classes('header', 'masthead', 'banner', 'site-header')}>{inner}</div>")

    def foot():
        inner = pick(f"&copy; {words(1)}.example.com &middot; {sentence(8)}", f"<p>{sentence(6)}</p>", f"<ul>{links(4)}</ul><p>&copy; {words(2)}</p>")
        return pick(f"<footer>{inner}</footer>", f"<footer{classes('footer', 'colophon')}>{inner}</footer>", f"<div{classes('footer', 'copyright', 'legal', 'bottom')}>{inner}</div>")

    def side():
        inner = pick(f"<h3>{words(2)}</h3><ul>{links(6)}</ul>", f"<h2>{words(2)}</h2><p>{prose(False, 2)}</p>", f"<p>{prose(False, 3)}</p>", prose(False, 2))
        return pick(f"<aside>{inner}</aside>", f"<aside{classes('sidebar', 'related')}>{inner}</aside>", f"<div{classes('sidebar', 'side', 'related', 'widget', 'recommended', 'popular')}>{inner}</div>")

    def advert():
        inner = pick(prose(False, 1), f"<p>{prose(False, 2)}</p>", f'<a href="/ad">{words(4)}</a>')
        return pick("<!-- ad 1 -->", "") + pick(f"<div{classes('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-box')}>{inner}</div>", f"<aside{classes('ad', 'sponsor')}>{inner}</aside>", f"<section{classes('promo', 'ads')}>{inner}</section>")

    def notice():
        inner = pick(f"<p>{prose(False, 1)}</p><button>OK</button>", prose(False, 2), f"<p>{prose(False, 2)}</p>")
        return pick(f"<div{classes('cookie', 'consent', 'cookie-notice', 'popup', 'modal', 'gdpr', 'notice', 'alert')}>{inner}</div>", f'<div role="{pick("alert", "dialog")}"{classes("cookie", "notice")}>{inner}</div>', f"<section{classes('cookie-banner', 'notice')}>{inner}</section>", f"<dialog>{inner}</dialog>")

    def form():
        inner = f"<label>{words(2)}</label><input name=q><p>{prose(False, 1)}</p><button>{words(1)}</button>"
        return pick(f"<form>{inner}</form>", f"<form{classes('newsletter', 'search', 'login', 'subscribe')}>{inner}</form>", f"<div{classes('newsletter', 'signup', 'subscribe')}><form>{inner}</form></div>", f"<div{classes('newsletter', 'subscribe')}><p>{prose(False, 1)}</p></div>")

    def talk():
        one = lambda: pick(f"<div{classes('comment')}><p>{prose(False)}</p></div>", f"<li{classes('comment', 'reply')}><b>{words(1)}</b><p>{prose(False)}</p></li>", f"<article{classes('comment')}><p>{prose(False)}</p></article>", f"<p>{prose(False)}</p>")
        inner = (f"<h{int(rng.integers(2, 4))}>{words(1)}</h3>" if chance(0.5) else "") + "".join(one() for _ in range(int(rng.integers(1, 6))))
        return pick(f"<section{classes('comments', 'discussion')}>{inner}</section>", f"<div{classes('comments', 'disqus', 'replies', 'comment-list', 'reader-comments')}>{inner}</div>", f"<ol{classes('commentlist', 'comments')}>{inner}</ol>")

    def social():
        return f"<div{classes('share', 'social')}>{pick(words(3), f'<ul>{links(3)}</ul>')}</div>"

    def inside():
        n = int(rng.integers(1, 16)) if chance(0.7) else 1
        if n == 1 and chance(0.4):  # text without a paragraph of its own
            return "<br>".join(prose(True) for _ in range(pick(1, 1, 2)))
        parts = [f"<h1>{sentence(int(rng.integers(1, 12)))}{MARK}</h1>"] if chance(0.75 if n > 1 else 0.4) else []
        few = n < 3 and chance(0.15)  # a short notice of a few words
        for _ in range(n):
            r = rng.random()
            if few:
                parts.append(f"<p>{pick('', '<b>')}{sentence(int(rng.integers(1, 6)))}{MARK}{pick('</p>', '</p>', '', '<br>')}")
            elif r < 0.78:
                parts.append(f"<p>{prose(True)}{pick('</p>', '</p>', '')}")
            elif r < 0.84:
                parts.append(f"<h2>{words(int(rng.integers(1, 6)))}{MARK}</h2>")
            elif r < 0.88:
                parts.append("<ul>" + "".join(f"<li>{prose(True, 1)}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.91:
                parts.append(f"<blockquote>{pick('<p>', '')}{prose(True, 2)}</blockquote>")
            elif r < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{words(2)}{MARK}</td><td>{words(1)}{MARK}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.95:
                parts.append(f"<div><p>{prose(True)}</p></div>")
            elif r < 0.97:
                parts.append(f"<pre>{words(9)}{MARK}</pre>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{words(5)}{MARK}</figcaption></figure>")
        for extra in (advert, social, form, side, notice, talk):
            if chance(0.12):
                parts.insert(int(rng.integers(0, len(parts) + 1)) if extra is not talk else len(parts), extra())
        return "".join(parts)

    body = inside()
    shell = pick("article", "article", "article", "main", "div", "div", "section", "plain", "bare", "odd")
    if shell == "plain":
        core = f"<{(box := pick('div', 'div', 'section', 'center'))}>{body}</{box}>"
    elif shell == "bare":  # right in the body
        core = body
    elif shell == "odd":  # names that tell nothing
        core = f'<div class="{words(1)}">{body}</div>'
    elif shell == "div":
        core = f"<div{classes('content', 'article', 'main', 'post', 'entry', 'story', 'article-body', 'text', 'inhalt', 'artikel', 'contenu', 'contenido')}>{body}</div>"
    else:
        core = f"<{shell}{classes('post', 'content', 'entry') if chance(0.4) else ''}>{body}</{shell}>"
    if chance(0.3):
        core = pick(f"<main>{core}</main>", f"<div{classes('container', 'wrapper', 'page', 'content')}>{core}{side() if chance(0.4) else ''}</div>")
    if chance(0.15):
        core = f"<h1>{sentence(6)}{MARK}</h1>" + core
    if chance(0.15):  # names of other groups, and forms, around the main text
        other = pick("sidebar", "side", "widget", "popular", "archive", "tags", "more", "related", "banner", "top", "header", "site", "modal", "menu", "tabs", "signup", "register", "follow")
        box = pick("div", "div", "section", "article")
        core = f'<{box} {pick("class", "class", "id")}="{pick("", "", "page ", "story ", "layout ")}{other}{pick("", "-page", "-left", "-layout", " wrap")}">{core}{side() if chance(0.3) else ""}</{box}>'
    if chance(0.06):
        core = pick(f"<form>{core}</form>", f"<fieldset>{core}</fieldset>", f"<form{classes('form', 'main', 'register')}>{core}</form>")
    few = 0.35 if chance(0.4) else 1.0  # many pages have little around the text
    before = [f() for f, p in ((notice, 0.25), (head, 0.4), (menu, 0.6), (advert, 0.4), (form, 0.1), (side, 0.15)) if chance(few * p)]
    after = [f() for f, p in ((social, 0.15), (talk, 0.35), (side, 0.3), (advert, 0.25), (form, 0.2), (menu, 0.1), (notice, 0.1), (foot, 0.7)) if chance(few * p)]
    if chance(0.3):
        rng.shuffle(before)
    page = "".join(before) + core + "".join(after)
    if chance(0.2):
        page = f"<div{classes('wrapper', 'page', 'container')}>{page}</div>"
    if chance(0.12):
        page = pick(f"<form>{page}</form>", f"<form action=/x{classes('form', 'page', 'search')}>{page}</form>", f'<form id="{words(1)}Form">{page}</form>')
    return f"<!DOCTYPE html><html lang=en><head><title>{words(3)}</title></head><body>{page}</body></html>"


@lru_cache(2)
def trained(pages: int = PAGES, seed: int = SEED) -> Extractor:
    """Blocks of made-up pages, labelled by whether half of their subtree's text is main text."""
    rng = np.random.default_rng(seed)
    trees = [parse(made_up(rng)) for _ in range(pages)]
    good = []
    for t in trees:
        main, whole = np.zeros(len(t)), np.zeros(len(t))
        for i in range(len(t) - 1, -1, -1):
            for _, text in t[i].pieces:
                whole[i] += len(text)
                main[i] += len(text) if MARK in text else 0
            if t[i].parent >= 0:
                main[t[i].parent] += main[i]
                whole[t[i].parent] += whole[i]
        good.append(main >= np.maximum(1, 0.5 * whole))
    x, _, _ = features(trees)
    return Extractor(boosting.train(x, np.concatenate(good).astype(float), trees=90, depth=5))


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns of keep, text and n_chars of every row."""
    ship(spark)
    shared = spark.sparkContext.broadcast(trained())
    own = pages.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(html_col).alias(unused(pages, "html")))
    fields = own.schema.fields[:-1]

    def run(batches):
        for b in batches:
            column = b.column(len(fields))
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = shared.value.texts(column.slice(lo, 200).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    schema = type(own.schema)(list(fields)).add("text", "string").add("n_chars", "long")
    return own.mapInArrow(run, schema)
