"""HTML extraction: the contiguous region of a page whose words and tags score most."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from itertools import cycle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import map_slices

#: Elements whose contents are never text of the page; of an empty svg or math element nothing is swallowed.
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
NAME = re.compile(r"/?([a-zA-Z][^\s/>\"'<=]*+)")
#: Attributes: quoted values may hold < and >; outside quotes a < ends a tag that was never closed.
ATTRIBUTES = re.compile(r"(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+")
NAMING = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements that do not end a block of text; a line break stands for a space.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3".split())
LANDMARKS = frozenset(["article", "main"])
LISTS = frozenset("li ul ol".split())
#: Elements whose names tell something; others tell something only by class, id and role.
TELLING = frozenset("nav footer aside form button dialog menu fieldset header figcaption address".split())
#: Words that take the meaning off the one behind them, as in has-sidebar or no-print.
NEGATING = frozenset("with has no without".split())
#: What readers' comments are named, which may be article elements; these are no landmarks.
REMARKS = frozenset("comment comments reply replies".split())
#: An element with more than this share of a page's words is a wrapper, on pages without a heading or landmark.
WRAPS = 0.6


def tokens_of(tag: str, rest: str, in_landmark: bool) -> tuple[str, ...]:
    """What an element tells: its name in angle brackets, and the words of its class, id and role."""
    out = {f"<{tag}>"} if tag in TELLING and not (tag == "header" and in_landmark) else set()
    if "=" in rest and tag not in ("body", "html"):
        for m in NAMING.finditer(rest):
            words = WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "").lower())
            out.update(w for before, w in zip(["", *words], words, strict=False) if before not in NEGATING and w not in NEGATING)
    return tuple(sorted(out))


@dataclass
class Block:
    """A run of text without a block-level tag in it, the tags before it, and where it stands."""

    text: str
    words: int
    linked: int
    element: int
    landmark: bool
    listed: bool
    heading: bool
    tags: list[str] = field(default_factory=list)
    tokens: frozenset[str] = frozenset()


def scan(page: str, at: int) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in one forward pass: 'text', 'start', 'end'. No part of the page is read over and
    over: a comment or raw element that is never closed ends the page, a tag that is never closed is left out."""
    size = len(page)
    while at < size:
        low = page.find("<", at)
        if low < 0:
            yield "text", page[at:], ""
            return
        if low > at:
            yield "text", page[at:low], ""
        follows = page[low + 1 : low + 2]
        if follows in ("!", "?"):
            if page.startswith("!--", low + 1):
                ends = [e + n for mark, n in (("-->", 3), ("--!>", 4)) if (e := page.find(mark, low + 2)) >= 0]
                at = min(ends) if ends else size
            else:
                high = page.find(">", low)
                at = high + 1 if high >= 0 else size
            continue
        m = NAME.match(page, low + 1)
        if not m:
            yield "text", "<", ""
            at = low + 1
            continue
        name, start = m[1].lower(), follows != "/"
        high = ATTRIBUTES.match(page, m.end()).end()
        rest = page[m.end() : high]
        if page[high : high + 1] == ">":
            at = high + 1
        elif page[high : high + 1] == "<" or high == size:
            at = high
            continue
        else:  # a quote that is never closed
            close = page.find(">", high)
            at = close + 1 if close >= 0 else size
        if start and name in RAW:
            if name in ("svg", "math") and rest.endswith("/"):
                continue
            close = RAW_END[name].search(page, at)
            at = close.end() if close else size
            continue
        yield ("start" if start else "end"), name, rest


def blocks_of(page: str, known: frozenset[str] | None = None) -> tuple[list[Block], bool]:
    """The blocks of a page in order, and whether it has a landmark (article, main).

    Of tokens only the ``known`` ones count, which bounds what a block holds, so time is linear in the page.
    """
    body = re.search(r"<body\b", page, re.I)
    head = re.search(r"</head\s*>", page, re.I)
    stack: list[tuple[str, int]] = []  # name and number of each open element
    listing: list[int] = []  # places in the stack of lists and their items
    telling: list[int] = []  # numbers of the open elements that tell something
    opened: Counter[str] = Counter()
    told: list[tuple[str, ...]] = []  # of each element that tells something, and the one around it
    parents: list[int] = []
    outside = 0
    found: dict[str, tuple[int, ...]] = {}  # the elements around the first main, heading and article
    seen = False
    out: list[Block] = []
    parts: list[str] = []
    tags: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked, tags
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), linked, telling[-1] if telling else -1, opened["article"] + opened["main"] > 0, opened["li"] > 0, any(opened[h] for h in HEADINGS), tags))
            tags = []
        parts, linked = [], 0

    def leave(name: str) -> None:
        """Close all elements down to the innermost of this name."""
        nonlocal outside
        while True:
            last, number = stack.pop()
            opened[last] -= 1
            if listing and listing[-1] == len(stack):
                listing.pop()
            if telling and telling[-1] == number:
                telling.pop()
                outside -= told[number][0] in OUTSIDE
            if last == name:
                return

    for kind, name, rest in scan(page, head.end() if head else body.start() if body else 0):
        if kind == "text":
            text = entities.unescape(name) if "&" in name else name
            parts.append(text)
            if opened["a"]:
                linked += len(text.split())
            continue
        if name == "br":
            parts.append(" ")
            continue
        if kind == "end":
            ends_block = name not in INLINE or (opened[name] > 0 and stack[-1][0] == name and bool(telling) and telling[-1] == stack[-1][1])
            if ends_block:
                close()
            tags.append("/" + name)
            if opened[name] > 0:
                leave(name)
            continue
        in_landmark = opened["article"] + opened["main"] > 0
        tokens = tokens_of(name, rest, in_landmark) if "=" in rest or name in TELLING else ()
        if name not in INLINE or tokens:
            close()
        tags.append(name)
        if name not in INLINE and opened["p"]:
            leave("p")  # a paragraph ends where another block begins
        if name in VOID:
            continue
        if name == "a" and opened["a"]:
            leave("a")
        if name == "li" and listing and stack[listing[-1]][0] == "li":
            leave("li")
        if name in ("main", "h1", "article") and name not in found and not outside:
            found[name] = tuple(telling)
        seen |= name in LANDMARKS and not (REMARKS & {*tokens, *(told[telling[-1]] if telling else ())})
        if name in LISTS:
            listing.append(len(stack))
        stack.append((name, len(told) if tokens else -1))
        opened[name] += 1
        if tokens:
            parents.append(telling[-1] if telling else -1)
            telling.append(len(told))
            told.append(tokens)
            outside += tokens[0] in OUTSIDE
        if rest.endswith("/") and name not in ("a", "li", "p", "div", "span", "article", "main", "section"):
            leave(name)
    close()

    around = next((set(found[n]) for n in ("main", "h1", "article") if n in found), None)
    if around is None:
        words = [0] * len(told)
        for block in out:
            if block.element >= 0:
                words[block.element] += block.words
        for i in range(len(told) - 1, -1, -1):  # an element comes behind the one around it
            if parents[i] >= 0:
                words[parents[i]] += words[i]
        total = sum(b.words for b in out)
        around = {i for i, n in enumerate(words) if n > WRAPS * total}
    # what wraps the article tells nothing by its class or id
    paths: list[frozenset[str]] = []
    for i, tokens in enumerate(told):
        own = {t for t in tokens if (t[0] == "<" or i not in around) and (known is None or t in known)}
        above = paths[parents[i]] if parents[i] >= 0 else frozenset()
        paths.append(above if own <= above else above | own)
    for block in out:
        block.tokens = paths[block.element] if block.element >= 0 else frozenset()
    return out, seen


#: Names that sort before all others in an element's tokens and mean that nothing in it can be the article.
OUTSIDE = frozenset("<nav> <footer> <aside> <form> <header> <dialog> <menu>".split())
BASE = ("plain", "linked", "in_landmark", "past_landmark", "listed", "heading")


def features(block: Block, seen: bool) -> dict[str, float]:
    """What the score of a block's words depends on: BASE, the tokens of the elements around it, and outside landmarks the words of a short block."""
    out = {"plain": 1.0, "linked": block.linked / block.words, "in_landmark": float(block.landmark), "past_landmark": float(seen and not block.landmark), "listed": float(block.listed), "heading": float(block.heading)}
    out |= dict.fromkeys(block.tokens, 1.0)
    if block.words <= SHORT_BLOCK and not block.landmark:
        for word in set(WORD.findall(block.text.lower().replace("©", " copyright "))):
            out[f"word {word}"] = 1.0 / block.words**0.5
    return out


#: Words of a block up to which the words themselves tell something, such as those of a notice.
SHORT_BLOCK = 30


@dataclass
class Weights:
    """Scores: of a word by its block's features, and of tags by name (never above 0)."""

    words: dict[str, float]
    tags: dict[str, float]
    other_tag: float

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.words)

    def each(self, block: Block, seen: bool) -> float:
        """The score of each word of a block."""
        return min(4.0, max(-4.0, sum(self.words.get(name, 0.0) * x for name, x in features(block, seen).items())))

    def tag_score(self, block: Block) -> float:
        return sum(self.tags.get(t, self.other_tag) for t in block.tags)


def learn(pages: list[tuple[str, set[str]]], rounds: int = 15, least: int = 4, ridge: float = 0.3) -> Weights:
    """Weights from labelled pages, given as html and the set of block texts that belong to the article.

    Words: logistic regression of being in the article on the features (those of ``least`` blocks at least), blocks
    weighted by the roots of their lengths. Tags: the log of how much likelier a tag is before article blocks than
    before others, at most -0.01.
    """
    rows, labels, sizes = [], [], []
    tags: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for page, article in pages:
        blocks, seen = blocks_of(page)
        for block in blocks:
            inside = block.text in article
            rows.append(features(block, seen))
            labels.append(float(inside))
            sizes.append(block.words**0.5)
            tags[inside].update(block.tags)
    times = Counter(name for row in rows for name in row)
    names = sorted(n for n, t in times.items() if t >= least)
    place = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, row in enumerate(rows):
        for name, value in row.items():
            if name in place:
                x[i, place[name]] = value
    y, size = np.array(labels), np.array(sizes)
    weights = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (size * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names))
        weights += np.linalg.solve(curve, x.T @ (size * (y - p)) - ridge * weights)
    total = [sum(t.values()) + 1 for t in tags]
    odds = {t: np.log((tags[1][t] + 1) / total[1]) - np.log((tags[0][t] + 1) / total[0]) for t in tags[0] | tags[1]}
    return Weights(dict(zip(names, weights.tolist(), strict=True)), {t: min(-0.01, float(v) / 10) for t, v in odds.items()}, -0.01)


#: Names that labelled pages give to what is not the article, and to the article or parts of it; common words of all texts;
#: phrases around articles.
ASIDE_NAMES = (
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar side widget widgets related recommended recommendations trending popular share sharing social comment "
    "comments reply replies respond disqus nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager login "
    "search searchbox tags copyright skip contentinfo complementary form teaser outbrain taboola header adv adverts advertising aside searchbar"
).split()
ARTICLE_NAMES = "content article post entry story main body text page blog section prose paragraph lead intro title headline section".split()
NEUTRAL_NAMES = "box row col wrap wrapper container inner outer item block left right top bottom print clearfix grid unit list bar links area".split()
COMMON = (
    "the of and a to in is you that it he was for on are as with his they I at be this have from or one had by but not what all were we when your can "
    "said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more "
    "write go see number no way could people my than first been call who its now find long down day did get come made may part over new take only also us our "
    "top back read site follow improve accept leave log must very much here after before again still another because through"
).split()
PHRASES = (
    "Copyright {year} all rights reserved|© {year} {name}|{name} all rights reserved|We use cookies to improve this site|This site uses cookies accept|Accept all cookies|"
    "Subscribe to our newsletter|Sign up for our newsletter|Share this article|Share on {name}|Leave a comment|Leave a reply|Comments are closed|Log in to comment|"
    "Advertisement|Sponsored content|Related articles|Read more about {name}|You may also like|Terms of use|Privacy policy|Terms and privacy policy|Back to top|Skip to content|Follow us on {name}"
).split("|")


def labelled_pages(number: int = 900, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages made by rule, with their article's blocks: several layouts with and without landmarks, in wrappers of any
    name, and around and inside the article menus, headers, notices, adverts, sidebars, forms, comments and footers."""
    rng = np.random.default_rng(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi zo ka lu".split()
    one = lambda names: str(names[rng.integers(len(names))])
    plain = random.Random(seed)
    word = lambda: "".join(plain.choices(syllables, k=plain.randint(4, 7)))
    prose = lambda low, high: " ".join(plain.choice(COMMON) if plain.random() < 0.4 else word() for _ in range(plain.randrange(low, high)))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{word()}">{prose(1, 4)}</a></li>' for _ in range(n)) + "</ul>"
    phrase = lambda: one(PHRASES).format(year=rng.integers(1995, 2030), name=word())
    chance = lambda x: rng.random() < x

    turn = cycle(ASIDE_NAMES)

    def named(names: list[str]) -> str:
        words = [next(turn) if names is ASIDE_NAMES else one(names), *([one(NEUTRAL_NAMES)] if chance(0.4) else [])]
        return f' {one(["class", "class", "id"])}="{one(["-", "_", " "]).join(words)}"'

    def outside(marked: bool = False) -> str:
        text = one([prose(2, 25), prose(20, 90), phrase(), phrase() + " " + prose(1, 6)])
        return one([
            f"<div{named(ASIDE_NAMES)}>{text}</div>", f"<div{named(ASIDE_NAMES)}><p>{text}</p><p>{prose(3, 30)}</p></div>", f"<p{named(ASIDE_NAMES)}>{text}</p>",
            f"<section{named(ASIDE_NAMES)}>{links(3)}</section>", f"<aside>{text}</aside>", f"<div{named(ASIDE_NAMES)}><h3>{one([prose(1, 4), phrase()])}</h3>{text}</div>",
            f"<form action='/s'><label>{prose(1, 6)}</label><input><button>{word()}</button></form>", f"<div{named(ASIDE_NAMES)}>{text}{links(2)}</div>",
            *([] if marked else [f"<div>{phrase()}</div>", f"<p>{phrase()}</p>", f"<p>{phrase()}</p>"]),
        ])

    pages = []
    for _ in range(number):
        article = [prose(3, 12), *(prose(4, 80) for _ in range(rng.integers(1, 12)))]
        if chance(0.3):
            article.append(prose(1, 4))
        title = f"<h1>{article[0]}</h1>"
        if chance(0.3):
            title = one([f"<header>{title}</header>", f'<div class="{one(["article", "post", "entry", "story"])}-header">{title}</div>', f"<div{named(ARTICLE_NAMES)}>{title}</div>"])
        body = ""
        for text in article[1:]:
            body += one([f"<p>{text}</p>", f"<p>{text}", f"<p>{text}</p>", f"<ul><li>{text}</li></ul>", f"<blockquote>{text}</blockquote>", f"<p{named(ARTICLE_NAMES)}>{text}</p>"])
            if chance(0.25):
                body += outside(marked=True)
        if chance(0.3):
            body = f"<div{named(ARTICLE_NAMES + ['social history post', 'shared story text'])}>{body}</div>"
        shell = [("<article>", "</article>"), ("<main><article>", "</article></main>"), (f"<div{named(ARTICLE_NAMES)}>", "</div>"), ("<main>", "</main>"), (f"<article{named(ARTICLE_NAMES)}>", "</article>"), ("<table><tr><td>", "</td></tr></table>")][rng.integers(6)]
        if "<header>" in title and not shell[0].startswith(("<a", "<m")):
            title = f"<h1>{article[0]}</h1>"  # outside a landmark a header is the site's
        before = [f"<nav>{one([links(rng.integers(3, 9)), prose(1, 8), prose(2, 30)])}</nav>", f"<header><div>{prose(1, 5)}</div></header>", f"<div>{links(3)}</div>", outside(), outside()]
        after = [f"<footer>{one([prose(3, 25), phrase()])}</footer>", f'<section class="comments"><h2>{prose(1, 3)}</h2><p>{prose(3, 40)}</p><article class="comment"><p>{prose(3, 60)}</p></article></section>', f'<div id="comments"><div class="comment">{prose(3, 60)}</div></div>', f"<aside>{prose(3, 25)}{links(3)}</aside>", f"<div>{links(4)}</div>", outside(), outside()]
        if shell[0].startswith(("<a", "<m")):  # beside a landmark, text without any sign of its own is not the article either
            before += [f"<div>{prose(3, 30)}</div>", f"<p>{prose(3, 30)}</p>"]
            after += [f"<div>{prose(3, 30)}</div>", f"<p>{prose(3, 30)}</p>"]
        some = lambda parts: "".join(p for p in parts if chance(0.5))
        wrap = (f"<div{named(ASIDE_NAMES + NEUTRAL_NAMES)}>", "</div>") if chance(0.3) else ("", "")
        pages.append((f"<html><head><title>{article[0]}</title></head><body>{wrap[0]}{some(before)}{shell[0]}{title}{body}{shell[1]}{some(after)}{wrap[1]}</body></html>", set(article)))
    return pages


#: The lowest score of a block's words.
PARTS = -20.0


@cache
def default_weights() -> Weights:
    return learn(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the greatest sum (the earliest, then the longest, of equals); empty if no score is above 0."""
    best, top, total, start = (0, 0), 0.0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > top or total == top and best[0] == start and top > 0:
            best, top = (start, i + 1), total
    return best


def main_text(page: str | None, weights: Weights) -> str:
    """The article of a page: the blocks of the best run, without those whose own words score below 0.

    What scores below 0 inside a landmark, such as an advert, parts nothing: it is left out and counts 0 in the run;
    elsewhere its words count PARTS at least, however many they are.
    """
    if not page:
        return ""
    blocks, seen = blocks_of(page, weights.known)
    each = [weights.each(b, seen) for b in blocks]
    scores = [0.0 if e < 0 and b.landmark else max(PARTS, b.words * e) + weights.tag_score(b) for b, e in zip(blocks, each, strict=True)]
    start, end = best_run(scores)
    return "\n".join(b.text for b, e in zip(blocks[start:end], each[start:end], strict=True) if e >= 0)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None
) -> DataFrame:
    """The main text of each whole page: ``id_col``, ``url_col``, text and n_chars (code points).

    A page is read once, in time linear in its length, into blocks of text. A word scores by where its block stands (in
    an article or main element or past it, in links, lists or headings), by the names, classes and ids of the elements
    around it, and in short blocks outside landmarks by the words beside it; a tag scores by its name. All these ``weights`` are learned
    from labelled pages (default: made by rule, see labelled_pages). One scan finds the contiguous run of the greatest
    sum; blocks in it whose words score below 0 are left out. Elements around the first main element or headline tell
    nothing by their class or id, as they wrap the article. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by newlines.

    One row per input row. A null or empty page, or one without a run above 0, has an empty text; null ids and urls
    and repeated rows are kept; an empty table gives no rows; broken markup is read as far as it goes. Other columns
    are not read.
    """
    chosen = weights or default_weights()

    def make(rows: dict[str, list]) -> dict[str, object]:
        texts = [main_text(h, chosen) for h in rows["_html"]]
        return {id_col: rows[id_col], url_col: rows[url_col], "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = dict(pages.dtypes)
    thin = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("_html"))
    return map_slices(thin, make, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
