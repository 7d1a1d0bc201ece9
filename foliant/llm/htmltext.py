"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block elements.  The first pass classifies each
block by its length, link density and stop-word density:

* blocks inside elements that never hold the article (navigation, forms,
  scripts ...), or inside elements with a class, id or role that names such a
  part, are bad.  Names never condemn ``html`` or ``body``, and what holds an
  ``article`` or ``main`` only where one of at least its size stands outside
  such parts (for comments: where any stands outside).  Forms, and elements
  whose name only begins or ends with the word of a part, are neutral around
  most of the page;
* blocks of mostly links are bad;
* long blocks with enough stop words are good, without them bad; where the page
  as a whole has few known stop words, its own frequent short words take their
  place, and blocks with ends of sentences count as prose;
* blocks of middle length are good or near good by their stop words;
* short blocks, and blocks without a verdict, are ambiguous.

The second pass gives ambiguous and near good blocks the label of their nearest
decided neighbours: of equal labels that one; of different labels, near good
blocks and blocks that share the neighbour's container follow the good one,
other blocks the bad one.  At an end of the page the missing neighbour counts
as bad.  Headings follow the block behind them.

Null and empty pages have an empty text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import sliced

#: Frequent function words of English, French, German, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in"
    " into is it its more no not of on one or other our she so some such than that the their them then there these they this"
    " to up was we were what when which who will with would you your"
    " au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour"
    " qu que qui sa se ses son sont sur un une vous"
    " als am auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer es für hat ich ihr im ist mit"
    " nach nicht nur oder sich sie sind und um von vor war was wie wir wird zu zum zur über"
    " al como con cuando del el ella entre era esta este fue ha hay la las lo los me muy más nos para pero por porque se si sin"
    " sobre su sus también tiene todo un una y ya"
    " che chi ci come da dal della di e gli ho il io lei loro nel non per più questo sono tra una uno"
    " ao ele em foi isso mas mesmo na nas nem no nos não o os ou pela pelo quando seu sua são um uma".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: Elements that never hold the article.
ASIDE = frozenset(
    "nav footer aside form head title script style noscript iframe template svg select option button textarea input label menu"
    " dialog object canvas audio video header".split()
)
#: Words that name such a part, and words that may stand beside them in a class, id or role.
PART = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disclaimer|disqus|footer|gdpr|header|"
    r"login|masthead|menu|modal|nav\w*|newsletter|notice|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|share|"
    r"sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|trending|widget",
    re.I,
)
BESIDE = frozenset(
    "area articles bar block bottom box buttons container form global group icons inner item items link links list main outer page"
    " panel posts primary secondary section site slot stories top unit wrap wrapper".split()
)
#: Words that name a part where a longer name begins or ends with them, and those that deny it.
EDGE = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|footer|gdpr|menu|nav|navbar|navigation|newsletter|"
    r"notice|pagination|popup|promo|related|replies|reply|sharing|sidebar|sponsor\w*|subscribe",
    re.I,
)
DENIED = frozenset("has is no not tag tags with without".split())
COMMENTS = re.compile(r"comments?|disqus|replies|reply", re.I)
BETWEEN = re.compile(r"[-_]+")
ARTICLE = frozenset(("article", "main"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>?|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\u2026](?:\s|$)|[\u0964\u3002\uff01\uff1f]")

LONG, SHORT = 200, 70
LINKS_MOST = 0.5
#: A form, or an element with a doubtful name, with more than this share of the page's text is neutral.
SOFT_MOST = 0.5
#: Words of a page that stand in for unknown stop words: at most so long, found at least so often.
STOP_LENGTH, STOP_COUNT = 4, 2
#: Prose ends a sentence at least once in so many characters.
SENTENCE_MOST = 400
STOPS_LOW = 0.12


@lru_cache(maxsize=4096)
def names_part(name: str) -> str:
    """What a class, id or role says: ``whole`` or ``edge`` of it names a part, ``comments`` being one of its own, or nothing."""
    words = [w for w in BETWEEN.split(name.lower()) if w]
    if not words or (len(words) > 1 and words[0] in DENIED):
        return ""
    parts = [bool(PART.fullmatch(w)) for w in words]
    whole = any(parts) and all(part or w in BESIDE for part, w in zip(parts, words, strict=True))
    if not (whole or EDGE.fullmatch(words[0]) or EDGE.fullmatch(words[-1])):
        return ""
    comments = COMMENTS.fullmatch(words[0]) or COMMENTS.fullmatch(words[-1])
    return ("whole" if whole else "edge") + (" comments" if comments else "")


class Aside:
    """An element that may condemn what it contains.

    ``hard`` ones always do, named ones unless spared, ``soft`` ones unless
    spared or around most of the page.  ``outer`` is the next such element
    around, ``within`` tells whether it or one around is named, ``holds`` is the
    size of the largest article inside.
    """

    __slots__ = ("outer", "hard", "soft", "named", "within", "comments", "holds", "spared", "bad", "size")

    def __init__(self, outer: Aside | None, hard: bool, named: str = "", form: bool = False):
        self.outer, self.hard, self.named = outer, hard or (outer is not None and outer.hard), bool(named)
        self.soft = not named.startswith("whole") if named else form
        self.within = self.named or (outer is not None and outer.within)
        self.comments = "comments" in named or (outer is not None and outer.comments)
        self.holds, self.spared, self.bad, self.size = -1, False, False, 0


class Block:
    __slots__ = ("text", "linked", "within", "aside", "heading", "container", "label", "_words")

    def __init__(self, text: str, linked: int, within: Aside | None, heading: bool, container: int):
        self.text, self.linked, self.within, self.heading, self.container = text, linked, within, heading, container
        self.aside, self.label, self._words = False, "", None

    def words(self) -> list[str]:
        if self._words is None:
            self._words = WORD.findall(self.text.lower())
        return self._words


def spare(found: list[Block], asides: list[Aside], homes: list[tuple[int, Aside | None]]) -> None:
    """Spares elements that hold the article.  ``homes`` lists every article with the element around it."""
    size: Counter[int] = Counter()
    for block in found:
        size[block.container] += len(block.text)
    free = 0
    for container, x in homes:
        if x is not None:
            x.holds = max(x.holds, size[container])
        if x is None or not (x.within or x.hard):
            free = max(free, size[container])
    for x in reversed(asides):
        if x.outer is not None:
            x.outer.holds = max(x.outer.holds, x.holds)
    for x in asides:
        x.spared = x.holds >= 0 and not (x.named and free and (x.comments or free >= x.holds))
        x.soft = x.soft and not (x.comments and free)


def judged(found: list[Block], asides: list[Aside]) -> None:
    """Settles which elements, listed from the outside in, condemn their blocks."""
    for x in asides:
        x.bad = x.hard or (x.outer is not None and x.outer.bad) or not (x.soft or x.spared)
    total = 0
    for block in found:
        x = block.within
        if x is None or not x.bad:
            total += len(block.text)
            if x is not None:
                x.size += len(block.text)
    for x in reversed(asides):
        if x.outer is not None:
            x.outer.size += x.size
    for x in asides:
        x.bad = x.bad or (x.outer is not None and x.outer.bad) or (x.soft and not x.spared and x.size <= SOFT_MOST * total)
    for block in found:
        block.aside = block.within is not None and block.within.bad


def _named(attributes: str) -> str:
    """The strongest that the names of an element say."""
    if not attributes:
        return ""
    said = {names_part(w) for x in ATTRIBUTE.findall(attributes) for w in next(filter(None, x), "").split()}
    return max(said, default="")


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, white space collapsed."""
    out: list[Block] = []
    held: list[str] = []
    linked = 0
    stack: list[tuple[str, Aside | None, int]] = []  # element, aside around it, article or main around it
    asides: list[Aside] = []
    homes: list[tuple[int, Aside | None]] = []
    #: open elements by name: an end tag without one, of which broken pages have many, is passed over at once
    held_open: Counter[str] = Counter()
    links, containers, at = 0, 0, 0

    def leave(i: int) -> None:
        for e, _, _ in stack[i:]:
            held_open[e] -= 1
        del stack[i:]

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                top = stack[-1] if stack else ("", None, 0)
                out.append(Block(text, linked, top[1], any(e in HEADINGS for e, _, _ in stack[-3:]), top[2]))
            held.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            held.append(raw)
            if links:
                linked += len(raw)

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS or name in ASIDE:
            close()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1) if held_open[name] > 0 else ():
                if stack[i][0] == name:
                    leave(i)
                    break
            continue
        if name in VOID:
            continue
        inside, container = (stack[-1][1], stack[-1][2]) if stack else (None, 0)
        if name in ("html", "body"):
            inside = None
        else:
            named = _named(m[3])
            # a header within an article is its title
            aside = name in ASIDE and not (name == "header" and container)
            # a doubtful name says nothing of an article
            if aside or (named and not (name in ARTICLE and named == "edge")):
                inside = Aside(inside, aside and name != "form", named, name == "form")
                asides.append(inside)
        if name in ARTICLE and not (inside is not None and inside.hard):
            containers += 1
            container = containers
            homes.append((container, inside))
        if name == "a":
            links += 1
        if name == "p":
            # an open paragraph ends where the next begins
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] == "p":
                    leave(i)
                    break
            if links and not held_open["a"]:
                links = 0
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not m[3].endswith("/"):
            stack.append((name, inside, container))
            held_open[name] += 1
    close()
    spare(out, asides, homes)
    judged(out, asides)
    return out


def page_words(found: list[Block]) -> frozenset[str] | None:
    """The page's own stop words where it has few known ones, else none."""
    texts = [b.words() for b in found if not b.aside and b.linked <= LINKS_MOST * len(b.text) and len(b.text) >= SHORT]
    total = sum(map(len, texts))
    if not total or sum(stops_in(words, STOP_WORDS) for words in texts) >= STOPS_LOW * total:
        return None
    counts = Counter(chain.from_iterable(texts))
    return frozenset(w for w, n in counts.items() if n >= STOP_COUNT and len(w) <= STOP_LENGTH)


def stops_in(words: list[str], known: frozenset[str]) -> int:
    return sum(map(known.__contains__, words))


def first_pass(block: Block, own: frozenset[str] | None = None) -> str:
    """The first label of a block; ``own`` are the page's stop words where the known ones do not fit."""
    if block.aside:
        return "bad"
    size = len(block.text)
    if block.linked > LINKS_MOST * size:
        return "bad"
    if block.heading or size < SHORT:
        return "short"
    words = block.words()
    known = STOP_WORDS if own is None else STOP_WORDS | own
    stops = stops_in(words, known) / max(1, len(words))
    prose = own is not None and len(SENTENCE.findall(block.text)) * SENTENCE_MOST >= size
    if stops >= STOPS_LOW or prose:
        return "good" if size >= LONG else "near"
    return "short" if block.container or size < LONG else "bad"


def second_pass(found: list[Block]) -> None:
    """Replaces the labels short and near by good or bad."""
    labels = [b.label for b in found]
    n = len(found)
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        if labels[i] in ("good", "bad"):
            last = i
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] in ("good", "bad"):
            last = i
    # a page without a decided good block: near good ones are its text
    if "good" not in labels:
        for i, block in enumerate(found):
            block.label = "good" if labels[i] == "near" or (labels[i] == "short" and block.container) else "bad"
        return
    for i, block in enumerate(found):
        if labels[i] not in ("short", "near"):
            continue
        low, high = before[i], after[i]
        a = labels[low] if low >= 0 else "bad"
        b = labels[high] if high >= 0 else "bad"
        if a == b:
            good = a == "good"
        else:
            neighbour = low if a == "good" else high
            same = block.container and found[neighbour].container == block.container
            good = labels[i] == "near" or bool(same) or (block.heading and b == "good" and high >= 0)
        if a == b == "bad" and block.container and labels[i] == "near":
            good = True
        block.label = "good" if good else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    own = page_words(found)
    for block in found:
        block.label = first_pass(block, own)
    second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in sliced(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
