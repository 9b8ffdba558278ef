"""Main-text extraction by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks from the markup around
them (navigation, footers, adverts, forms, comments ... are boilerplate) and from their text: density of
stop words, length and density of links. Short or otherwise ambiguous blocks stay undecided; the second
pass gives each the label of its nearest decided neighbours in the same region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its "
        "more no not of on one only or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour que qui sa se ses son sont sur un une vous "
        "aber als am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch oder sich sie sind so über um und uns von vor war was wie wir wird zu zum zur "
        "al como con de del el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por que se si sin sobre son su sus también un una y ya"
    ).split()
)
#: Elements that hold no article text, elements that do not part blocks, and words in class, id or role that mark boilerplate.
NOISE_TAGS = frozenset("nav header footer aside form menu dialog button select option noscript template svg canvas object audio video label fieldset head".split())
#: Items of lists and tables: full of links, they are menus, even inside an article.
ITEM_TAGS = frozenset("li ul ol dl dd dt td th tr table".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_WORDS = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
        "comment comments disqus replies cookie cookies notice consent gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations "
        "widget pagination pager toolbar contentinfo complementary search alert dialog"
    ).split()
)
#: First parts of class names that only describe an element which is not such a thing itself.
FLAG_WORDS = frozenset("no not non has have with without is hide show layout page body wrap wrapper container".split())
#: First parts of class names of a headline's element, and noise words that no amount of text makes an article.
ARTICLE_WORDS = frozenset("article post entry story".split())
NEVER_ARTICLE = frozenset("comment comments disqus replies cookie cookies consent gdpr newsletter".split())
#: Elements around each other that may be pardoned on one page; it is read once more for each.
MOST_WRAPPERS = 40
_RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-z!?/][^>]*>|<[!?][^>]*>",
    re.I | re.S,
)
#: The start of a tag that is cut off; any other '<' is text.
_TAIL = re.compile(r"<[a-z/!?]", re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z]+", re.I)
_WORD = re.compile(r"\w+")


class Block:
    __slots__ = ("parts", "links", "root", "region", "item")

    def __init__(self, root: int, region: bool, item: bool):
        self.parts, self.links, self.root, self.region, self.item = [], 0, root, region, item


def _noisy(tag: str, attrs: str) -> str:
    """Why an element is boilerplate: 'never' and 'tag' hold whatever is in it, 'whole' (a class, id or role is a noise word, or a form)
    unless no long text is elsewhere, 'part' (one begins or ends with such a word) unless most long text is in it; '' if it is none.
    """
    why = "" if tag not in NOISE_TAGS else "whole" if tag == "form" else "tag"
    if "=" not in attrs:
        return why
    for value in _ATTR.findall(attrs):
        for name in value.strip("\"'").lower().split():
            parts = _NAME.findall(name)
            if not parts or parts[0] in FLAG_WORDS or parts[0] in ARTICLE_WORDS and parts[-1] == "header":
                continue
            hit = [w for w in (parts[0], parts[-1]) if w in NOISE_WORDS]
            # An article is itself, whatever its classes are called, unless one is nothing but a noise word.
            if not hit or tag == "main" or tag == "article" and name not in NOISE_WORDS:
                continue
            new = "never" if NEVER_ARTICLE.intersection(hit) else "whole" if name in NOISE_WORDS else "part"
            why = max(why, new, key=("", "part", "whole", "tag", "never").index)
    return why


def blocks_of(html: str) -> list[tuple[str, float, bool, bool, bool]]:
    """Non-empty blocks in page order: text, share of its characters in links, in boilerplate markup, in an article, a list item.

    An element that its name condemns is read as any other if it holds the page's long text (see _noisy);
    what is boilerplate within it stays so.
    """
    pardoned: frozenset[int] = frozenset()
    for _ in range(MOST_WRAPPERS + 1):
        blocks, reasons = _scan(html, pardoned)
        long = [(len(t), root) for t, links, root, _, _ in blocks if links <= 0.5 and _is_long(t)]
        free, total = sum(n for n, root in long if root < 0), sum(n for n, _ in long)
        inside: dict[int, int] = {}
        for n, root in long:
            inside[root] = inside.get(root, 0) + n
        holds = [r for r, n in inside.items() if r >= 0 and (reasons[r] == "part" and 2 * n > total or reasons[r] in ("part", "whole") and not free)]
        if not holds:
            break
        # Each round pardons one more element, the one with most text.
        pardoned |= {max(holds, key=lambda r: (inside[r], -r))}
    return [(t, links, root >= 0, region, item) for t, links, root, region, item in blocks]


def _is_long(text: str, words: int = 20, chars: int = 100) -> bool:
    return len(text) >= chars and (len(text.split()) >= words or not text.isascii() and len(text) >= chars)


def _scan(html: str, pardoned: frozenset[int]) -> tuple[list[tuple[str, float, int, bool, bool]], dict[int, str]]:
    """The blocks of a page, each with the place of the boilerplate element around it (-1: none), and why those elements are boilerplate. Pardoned ones are none."""
    end = html.rfind(">") + 1
    tail = _TAIL.search(html, end)
    html, rest = html[:end], html[end : tail.start() if tail else None]
    out: list[Block] = [Block(-1, False, False)]
    noise_tag, noise_depth, root, region, link, at = "", 0, -1, 0, 0, 0
    reasons: dict[int, str] = {}

    def add(text: str) -> None:
        if text:
            out[-1].parts.append(text)
            if link:
                out[-1].links += len(text.strip())

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if at == end and (m["raw"] and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I) or m[0].startswith("<!--") and not m[0].endswith("-->")):
            rest = ""  # still inside an element or comment that is cut off
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            link = 0 if m["end"] else 1
        closing, main = bool(m["end"]), tag in ("article", "main")
        before = (bool(noise_tag), region > 0)
        if noise_tag:
            if tag == noise_tag:
                noise_depth += -1 if closing else 1
                if not noise_depth:
                    noise_tag, root = "", -1
            elif main and not closing and not region and not _noisy(tag, m["attrs"]):
                noise_tag, root = "", -1  # an element left open does not swallow the article
        elif not closing and tag not in VOID_TAGS and tag not in ("html", "body") and m.start() not in pardoned and (why := _noisy(tag, m["attrs"])):
            noise_tag, noise_depth, root = tag, 1, m.start()
            reasons[root] = why
        if main and not noise_tag:
            region = max(0, region + (-1 if closing else 1))
        if tag == "br":
            add(" ")
        elif tag not in INLINE_TAGS or (bool(noise_tag), region > 0) != before:
            link = 0
            out.append(Block(root if noise_tag else -1, region > 0, tag in ITEM_TAGS and not closing))
    add(html[at:] + rest)
    found = []
    for b in out:
        text = " ".join(unescape("".join(b.parts)).split())
        if text:
            found.append((text, min(1.0, b.links / len(text)), b.root, b.region, b.item))
    return found, reasons


def first_pass(text: str, links: float, noise: bool, region: bool, item: bool, has_region: bool, long_words: int = 20, stop_high: float = 0.25, stop_low: float = 0.1, link_most: float = 0.5, has_stop: bool = True) -> bool | None:
    """True: article text; False: boilerplate; None: ambiguous. has_stop: does the page have stop words? If not, length decides."""
    if noise or has_region and not region:
        return False
    if links > link_most:
        return None if region and not item else False  # a linked paragraph of an article goes with its neighbours
    if not has_stop:
        return True if _is_long(text, long_words) else None
    words = _WORD.findall(text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if len(words) < long_words:
        return True if region and len(words) >= long_words / 2 and stop >= stop_high else None
    if stop >= stop_high or region:
        return True
    return None if stop >= stop_low else False


def second_pass(labels: list[bool | None], default: bool) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbour; ties between neighbours, and none at all, give default."""
    n = len(labels)
    left, right = [(n + 1, None)] * n, [(n + 1, None)] * n
    for side, order in ((left, range(n)), (right, reversed(range(n)))):
        seen: tuple[int, bool | None] = (-1, None)
        for i in order:
            if labels[i] is not None:
                seen = (i, labels[i])
            if seen[1] is not None:
                side[i] = (abs(i - seen[0]), seen[1])
    out = []
    for i in range(n):
        (dl, a), (dr, b) = left[i], right[i]
        if labels[i] is not None:
            out.append(labels[i])
        elif a is None and b is None or a != b and dl == dr:
            out.append(default)
        else:
            out.append(bool(a if dl <= dr else b))
    return out


def main_text(html: str | None) -> str:
    blocks = blocks_of(html) if html else []
    has_region = any(b[3] and not b[2] for b in blocks)
    if has_region:
        blocks = [b for b in blocks if b[3]]
    has_stop = any(w in STOP_WORDS for b in blocks if not b[2] for w in _WORD.findall(b[0].lower()))
    labels = [first_pass(*b, has_region, has_stop=has_stop) for b in blocks]
    # Markup noise inside an article says nothing about the text beside it.
    kept = [i for i, b in enumerate(blocks) if not (has_region and b[2])]
    final = second_pass([labels[i] for i in kept], has_region)
    return "\n\n".join(blocks[i][0] for i, good in zip(kept, final) if good)


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of pages (page_id, url, html).

    Returns a row per page: page_id, url, text (blocks of the article in page order, joined by two
    newlines; white space in a block is one space; character references are decoded).

    Null or empty html, or a page without article text: empty text. Elements left open, markup cut off
    at the end and stray '<' are tolerated. A null page_id or url is returned as null. Pages of any length
    are read whole. Repeated rows are extracted alike. An empty table gives no rows; other columns are
    ignored.
    """
    # Ids as text: pandas would round integers beside a null.
    base = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [main_text(h) for h in pdf["html"]]})

    return base.mapInPandas(run, "page_id string, url string, text string").withColumn("page_id", F.col("page_id").cast(dict(pages.dtypes)["page_id"]))
