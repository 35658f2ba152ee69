"""Main text of web pages by minimum-cut labelling (operator 4).

A page falls into blocks at its block-level tags. A classifier with fixed weights gives each
block a log-odds of being content, from the tags, classes and roles it lies in, its length,
punctuation and share of link text. The log-odds becomes the capacity between the block and
the content terminal (if positive) or the boilerplate terminal (if negative). Smoothness edges
join neighbours in page order, weaker the further apart they lie in the document tree, and
neighbours among the blocks of one container. The minimum cut, found by augmenting paths,
parts content from boilerplate at least total cost; blocks on the content side are returned.

Null and empty pages, and pages without content, give an empty text of length 0. Broken
markup (unclosed or crossing tags, a bare ``<``) is read as a browser roughly would. Rows are
answered one by one: repeated rows and ids, null ids and urls and further columns change
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import released, steps

#: Tags that begin and end a block; all others are inline.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li"
    " main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th"
    " thead title tr ul".split()
)
#: Tags with text that is never markup; the whole element is dropped.
RAW_TAGS = ("script", "style", "template", "svg", "math", "object", "canvas", "audio", "video", "xmp")
VOID_TAGS = {"hr"}
#: A new element of these closes an open one of the same set below the same parent.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CLOSES |= {tag: {"p"} for tag in BLOCK_TAGS if tag not in _CLOSES and tag not in ("button", "option", "caption")}

#: Log-odds that an element adds to all blocks in it.
TAG_WEIGHTS = dict.fromkeys("nav footer aside form menu button select textarea head noscript iframe dialog option fieldset search".split(), -9.0)
TAG_WEIGHTS |= {"header": -6.0, "article": 4.0, "main": 2.5, "figcaption": 0.5}
#: By words of class, id and role.
NAME_WEIGHTS = dict.fromkeys(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget widgets rail"
    " footer colophon copyright legal cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " newsletter subscribe subscription signup login search share sharing social comment comments commentlist reply"
    " replies respond disqus reader feedback related recommended trending teaser teasers outbrain taboola masthead"
    " contentinfo complementary dialog form hidden disclaimer paywall discussion".split(),
    -9.0,
)
NAME_WEIGHTS |= {"header": -6.0}
NAME_WEIGHTS |= dict.fromkeys("article articlebody entry post story content main text body".split(), 1.5)
#: An element that names its page region as content outweighs the page's outer wrappers only.
BIAS, LINK_WEIGHT, ADJACENT, CONTAINER = -0.5, -4.0, 1.0, 0.5

_MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile("[\"'>]")
_COMMENT_END = re.compile("--!?>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A word of up to so many letters before others in a name only says whose name it is.
_SPACE_OF_NAMES = 2
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}


class _Block:
    __slots__ = ("text", "node", "weight", "linked", "tag")

    def __init__(self, text, node, weight, linked, tag):
        self.text, self.node, self.weight, self.linked, self.tag = text, node, weight, linked, tag


def _named(name: str) -> float | None:
    """The log-odds of one name; None if it says nothing.

    Words of boilerplate count where they begin or end the name; inside it they qualify
    something else (a price of shares).
    """
    words = [w.lower() for w in _WORD.findall(name)]
    while len(words) > 1 and len(words[0]) <= _SPACE_OF_NAMES and words[0] not in NAME_WEIGHTS:
        words = words[1:]
    found = [NAME_WEIGHTS[w] for w in words if NAME_WEIGHTS.get(w, 0) > 0]
    found += [NAME_WEIGHTS[w] for w in (words[:1] + words[-1:]) if NAME_WEIGHTS.get(w, 0) < 0]
    return (min(found) if min(found) < 0 else max(found)) if found else None


def _weight(tag: str, attributes: str) -> float:
    weight = TAG_WEIGHTS.get(tag, 0.0)
    if attributes and tag not in ("html", "body"):
        names = {name for m in _NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()}
        found = [w for w in map(_named, names) if w is not None]
        if found:
            weight += min(found) if min(found) < 0 else max(found)
        if _HIDDEN.search(attributes):
            weight -= 9.0
    return weight


def tokens(page: str):
    """(text before, closing, tag name, attributes) of each tag, and the last text with no tag.

    One pass: a tag ends at the first ``>`` outside quotes. Where no such one follows, quotes
    count for nothing in the rest of the page, and a tag without any ``>`` is text.
    """
    at, kept, end, quoted, last = 0, 0, len(page), True, page.rfind(">")
    while match := _MARKUP.search(page, at):
        begin = match.start()
        if match[1]:
            stop = _COMMENT_END.search(page, match.end())
            yield page[kept:begin], "", "", ""
            at = kept = stop.end() if stop else end
        elif match[2] or match[3]:
            close = "]]>" if match[2] else ">"
            stop = page.find(close, match.end())
            yield page[kept:begin], "", "", ""
            at = kept = stop + len(close) if stop >= 0 else end
        elif begin > last:
            break
        else:
            stop = _tag_end(page, match.end()) if quoted else -1
            if stop < 0:
                quoted, stop = False, page.find(">", match.end())
            at = (yield page[kept:begin], match[4], match[5].lower(), page[match.end() : stop], stop + 1) or stop + 1
            kept = at
    yield page[kept:], "", "", ""


def _tag_end(page: str, at: int) -> int:
    """Where the first ``>`` outside quotes stands; -1 if there is none."""
    while match := _STOP.search(page, at):
        if match[0] == ">":
            return match.start()
        at = page.find(match[0], match.end()) + 1
        if not at:
            break
    return -1


def blocks(page: str) -> tuple[list[_Block], list[int], list[int]]:
    """The blocks of a page in order; and the parent and the depth of each element they lie in."""
    found: list[_Block] = []
    parents, depths = [0], [0]
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # tag, element, log-odds so far
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, node, weight = stack[-1]
                found.append(_Block(text, node, weight, min(1.0, linked / len(text)), tag))
            parts.clear()
        linked = 0

    def pop(upto):
        for tag, _, _ in stack[upto:]:
            opened[tag] -= 1
        del stack[upto:]

    read, skip = tokens(page), None
    while True:
        try:
            token = read.send(skip) if skip is not None else next(read)
        except StopIteration:
            break
        skip = None
        piece, closing, tag, attributes, *after = token
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not tag:
            continue
        if tag in _RAW_ENDS:
            if not closing and not attributes.endswith("/"):
                stop = _RAW_ENDS[tag].search(page, after[0])
                skip = stop.end() if stop else len(page)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if closing:
                if opened.get(tag):
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    pop(depth)
            elif tag not in VOID_TAGS:
                closes = _CLOSES.get(tag, ())
                while stack[-1][0] in closes:
                    pop(len(stack) - 1)
                parents.append(stack[-1][1])
                depths.append(len(stack))
                opened[tag] = opened.get(tag, 0) + 1
                stack.append((tag, len(parents) - 1, stack[-1][2] + _weight(tag, attributes)))
    flush()
    return found, parents, depths


def log_odds(block: _Block) -> float:
    """How far the classifier takes a block for content."""
    length = len(block.text)
    score = BIAS + block.weight + min(2.0, length / 60) + LINK_WEIGHT * block.linked
    if block.text[-1] in ".!?;:\"”»…。":
        score += 0.5
    if block.tag in ("p", "pre", "blockquote", "h1", "h2", "h3"):
        score += 0.75
    return score


def edges(found: list[_Block], parents: list[int], depths: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks and their capacities."""
    made, last = [], {}
    for i, block in enumerate(found):
        if i:
            # Steps up to the common element; neighbours in a page are few steps apart in all.
            a, b, apart = block.node, found[i - 1].node, 0
            while a != b:
                if depths[a] >= depths[b]:
                    a = parents[a]
                else:
                    b = parents[b]
                apart += 1
            made.append((i - 1, i, ADJACENT / (1 + apart / 2)))
        parent = parents[block.node] if block.tag == "p" or block.tag.startswith("h") and block.node else block.node
        if last.get(parent, i) < i - 1:
            made.append((last[parent], i, CONTAINER))
        last[parent] = i
    return made


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source side of the minimum cut.

    A positive score is the capacity from the source, a negative one that to the sink.
    """
    spare = list(scores)
    room: list[dict[int, float]] = [{} for _ in scores]
    for a, b, capacity in links:
        room[a][b] = room[a].get(b, 0.0) + capacity
        room[b][a] = room[b].get(a, 0.0) + capacity
    source = [False] * len(scores)  # can reach no sink any more
    for start in range(len(scores)):
        while spare[start] > 0 and not source[start]:
            before, queue, sink = {start: start}, deque([start]), -1
            while queue and sink < 0:
                node = queue.popleft()
                for other, capacity in room[node].items():
                    if capacity > 1e-12 and other not in before and not source[other]:
                        before[other] = node
                        if spare[other] < 0:
                            sink = other
                            break
                        queue.append(other)
            if sink < 0:
                for node in before:
                    source[node] = True
                break
            flow, node = min(spare[start], -spare[sink]), sink
            while node != start:
                flow, node = min(flow, room[before[node]][node]), before[node]
            node = sink
            while node != start:
                room[before[node]][node] -= flow
                room[node][before[node]] += flow
                node = before[node]
            spare[start] -= flow
            spare[sink] += flow
    return source


def main_text(page: str | None) -> str:
    """The content blocks of a page, one on a line."""
    found, parents, depths = blocks(page or "")
    if not found:
        return ""
    content = minimum_cut([log_odds(b) for b in found], edges(found, parents, depths))
    return "\n".join(b.text for b, keep in zip(found, content, strict=True) if keep)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main text and its length in code points for every page."""

    def run(batches):
        for part in steps(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), lengths],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(released(run), SCHEMA)


def query(spark, sf_dir):
    from strata.llm.common import read

    return extract(read(spark, sf_dir, "pages"))
