"""Main text of web pages by tree scoring.

The page is parsed to a tree in one pass, in time that grows with its length only; parts that are never article text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out by tag, role
or class name.  Each remaining text block passes points for its length and commas to its ancestors, half as many with
each level; a container's points are discounted by its link density.  The article or main around the best
container, or else that container, is kept whole, and so is what stands beside it unless that is mostly links.  The
blocks are joined in page order.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What stands in a tag: anything, with quoted values whole.
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
#: One attribute: its whole name, and its value in quotes or bare.
_ATTR = re.compile(r"""([^\s/>=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head script style noscript template title nav footer aside form button select option textarea input label fieldset dialog iframe object embed svg canvas audio video map menu xmp noembed noframes".split())
ROLES = frozenset("navigation banner comment contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id names that mark a part as no article text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr header masthead menu nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related recommended replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that as the head of a name say that readers' comments stand there, wherever that is.
COMMENTS = frozenset("comment comments commenter commenters commentlist disqus replies reply respond responses talkback".split())
#: Words that make a name say how something is rather than what stands there.
STATES = frozenset("allow allowed closed disable disabled enable enabled has have hide is no not open show with without".split())
#: Those that within an article mark its own head.
TOPS = frozenset(("header", "masthead", "banner"))
#: Words that may stand beside those of NAMES in a name within an article, which marks no junk if it holds any other.
PLAIN = frozenset("area articles bar block body bottom box btn button buttons container content form group icons inline inner item items label left link links list more outer panel posts right section slot small stories text title top unit wrap wrapper".split())
#: Words that may follow a word of COMMENTS in the name of such a part.
STRUCTURE = PLAIN | frozenset("app author avatar count counter date embed feed heading holder main meta module number page pane permalink region root tab thread threads time tree user users view zone".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
BONUS = {"article": 10.0, "main": 8.0}
#: Parts of tables: what stands around the whole table is beside them too.
PARTS = frozenset("td th tr tbody thead tfoot caption".split())


class Node:
    __slots__ = ("tag", "up", "out", "kids", "points", "chars", "linked")

    def __init__(self, tag: str, up: "Node | None", out: bool):
        self.tag, self.up, self.out = tag, up, out
        self.kids: list = []
        self.points, self.chars, self.linked = 0.0, 0, 0


def _tags(page: str):
    """(start, end, closing, tag, attributes) of each tag in order; the tag of comments and declarations is None.

    A quote that nothing closes makes all later tags end at their first >.  So does a tag that never ends otherwise.
    """
    pos, n, strict = 0, len(page), True
    while (start := page.find("<", pos)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            pos = n if end < 0 else end + 3
            yield start, pos, "", None, ""
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            pos = n if end < 0 else end + 1
            yield start, pos, "", None, ""
            continue
        m = _NAME.match(page, start)
        if not m:
            pos = start + 1
            continue
        end = _INSIDE.match(page, m.end()).end() if strict else n
        if end >= n or page[end] != ">":
            strict = False
            end = page.find(">", m.end())
            if end < 0:
                return
        pos = end + 1
        # the caller may jump ahead, over the contents of a script
        jump = yield start, pos, m[1], m[2].lower(), page[m.end() : end]
        if jump is not None:
            pos = jump
            yield None


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _names_comments(words: list[str]) -> bool:
    """Whether a name's head, its last word but for those of mere structure, is one for readers' comments."""
    return STATES.isdisjoint(words) and next((w for w in reversed(words) if w not in STRUCTURE), "") in COMMENTS


def _names_junk(value: str, within: bool) -> bool:
    """Whether a class or id names a part that is no article text; within an article only a name for comments does, or one that says nothing else."""
    for name in value.split():
        words = _words(name)
        hit = NAMES.intersection(words)
        if not within and hit or hit - TOPS and NAMES.union(PLAIN).issuperset(words) or _names_comments(_words(name.split("--")[0])):
            return True
    return False


def _left_out(tag: str, attrs: str, within: bool, names: bool) -> bool:
    """within: the element lies in an article."""
    if tag in LEFT_OUT:
        return True
    if tag == "header":
        return not within
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "itemprop" and value.lower() == "comment" or name == "itemtype" and value.lower().rstrip("/").endswith(("schema.org/comment", "schema.org/usercomments")):
            return True
        if name == "id" and tag in HEADINGS:  # made from the heading's words
            continue
        if name in ("class", "id") and names and not (tag in ("html", "body", "main") or tag == "article" and not within) and _names_junk(value, within):
            return True
    return False


def parse(page: str, names: bool = True) -> list[Node]:
    """All nodes of a page's tree, parents first; text children are strings.  names: leave parts out by their class and id names too.  Broken markup is mended as browsers do: blocks end an open p."""
    root = at = Node("html", None, False)
    nodes, opened = [root], {"html": 1}  # how many elements of each tag are open
    seen = 0

    def leave(to: Node):
        nonlocal at
        while at is not to:
            opened[at.tag] -= 1
            at = at.up

    tags = _tags(page)
    for start, end, closing, tag, attrs in tags:
        if start > seen and not at.out:
            at.kids.append(html.unescape(page[seen:start]))
        seen = end
        if tag is None:
            continue
        if closing:
            x = at if opened.get(tag) else None
            while x is not None and x.tag != tag:
                x = None if tag not in BLOCKS and x.tag in BLOCKS else x.up  # a stray inline end tag does not end a block
            if x is not None and x.up is not None:
                leave(x.up)
            continue
        if tag in VOID:
            at.kids.append(Node(tag, at, at.out))
            continue
        if tag in BLOCKS:
            ends = ("p", tag) if tag == "li" else ("p", "dd", "dt") if tag in ("dd", "dt") else ("p",)
            last, x, left = None, at, sum(opened.get(e, 0) for e in ends)
            while left and x is not None and (x.tag not in BLOCKS or x.tag in ends):
                if x.tag in ends:
                    last, left = x, left - 1
                x = x.up
            if last is not None:
                leave(last.up)
            if tag == "body" and opened.get("body") or tag == "html" and at is root:
                continue
        node = Node(tag, at, at.out or _left_out(tag, attrs, bool(opened.get("article")), names))
        if not node.out:
            at.kids.append(node)
            nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            seen = close.end() if close else len(page)
            tags.send(seen)
            continue
        if not attrs.rstrip().endswith("/") or tag in BLOCKS:
            at = node
            opened[tag] = opened.get(tag, 0) + 1
    if seen < len(page) and not at.out:
        at.kids.append(html.unescape(page[seen:]))
    return nodes


def _blocks(root: Node):
    """(owner, text, linked characters) of each text block in page order."""
    held: list[str] = []
    linked = 0
    owners = [root]  # open blocks, the innermost last

    def flush():
        nonlocal held, linked
        text = " ".join("".join(held).split())
        out = (owners[-1], text, linked) if text else None
        held, linked = [], 0
        return out

    stack: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while stack:
        node, k, link = stack.pop()
        if k == 0 and node.tag in BLOCKS:
            if out := flush():
                yield out
            owners.append(node)
        if k < len(node.kids):
            stack.append((node, k + 1, link))
            kid = node.kids[k]
            if isinstance(kid, str):
                held.append(kid)
                linked += len(kid.strip()) if link else 0
            elif kid.tag == "br":
                held.append(" ")
            elif not kid.out:
                stack.append((kid, 0, link or kid.tag == "a"))
        elif node.tag in BLOCKS:
            if out := flush():
                yield out
            owners.pop()


def _article(best: Node) -> Node | None:
    """The outermost article that holds the best container, or else main."""
    out, x = None, best
    while x is not None:
        if x.tag == "article" or x.tag == "main" and (out is None or out.tag == "main"):
            out = x
        x = x.up
    return out


def _beside(best: Node, blocks: list) -> list[str]:
    """Texts of the best container and of what stands beside it without being mostly links.  A container alone in another counts as that one."""
    levels, x = set(), best
    while x.up is not None:
        levels.add(id(x.up))
        if x.tag not in PARTS and any(k.strip() if isinstance(k, str) else k is not x and k.kids for k in x.up.kids):
            break
        x = x.up
    sides: dict[int, int] = {}
    sizes: dict[int, list[int]] = {}
    places = []
    for k, (owner, text, linked) in enumerate(blocks):
        path, x = [], owner
        while x is not None and id(x) not in sides and id(x) != id(best) and id(x) not in levels and not (x.up is not None and id(x.up) in levels):
            path.append(id(x))
            x = x.up
        # text right in a level is a side by itself; what lies in none is not kept
        side = 0 if x is None else sides.get(id(x), -k - 1 if id(x) in levels and x is not best else id(x))
        if side > 0:
            sides[id(x)] = side
        sides.update(dict.fromkeys(path, max(side, 0)))
        places.append(side)
        size = sizes.setdefault(side, [0, 0])
        size[0] += len(text)
        size[1] += min(linked, len(text))
    return [text for (_, text, _), side in zip(blocks, places, strict=True) if side == id(best) or side and 2 * sizes[side][1] <= sizes[side][0]]


def extract(page: str | None) -> str:
    """The main text of a page: blocks joined by newlines; null, empty or without text: the empty string."""
    if not page:
        return ""
    for names in (True, False):  # a name on a wrapper of the whole page says nothing
        nodes = parse(page, names)
        blocks = list(_blocks(nodes[0]))
        if blocks:
            break
    else:
        return ""
    for owner, text, linked in blocks:
        x = owner if owner.tag in CONTAINERS else owner.up or owner
        x.points += (0.5 if owner.tag in HEADINGS else 1.0) + text.count(",") + text.count("、") + len(text) / 100
        x.chars += len(text)
        x.linked += min(linked, len(text))
    for x in reversed(nodes):  # children before parents
        if x.up is not None:
            x.up.points += x.points / 2
            x.up.chars += x.chars
            x.up.linked += x.linked
    score = lambda x: (x.points + BONUS.get(x.tag, 0.0)) * (1 - x.linked / max(1, x.chars))
    best = max((x for x in nodes if x.tag in CONTAINERS and x.chars), key=score, default=nodes[0])
    return "\n".join(_beside(_article(best) or best, blocks))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html); n_chars counts code points.

    Null or empty html gives an empty text; very long pages, and deeply nested ones, are read whole; of containers of
    one score the first is the best; rows come back as they are, repeated
    ones and null ids too; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
