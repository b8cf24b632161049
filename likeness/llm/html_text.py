"""Main text of web pages; what many pages of a host share is their template.

Pass one parses each page, hashes its block subtrees and counts, per host, on how
many different pages each hash occurs.  Pass two parses again, deletes subtrees that
recur, and those whose element or class says they are no article text, and joins
what is left block by block.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import map_rows, text_of
from likeness.plans.materialise import keyed_join, store

# A subtree is template when it occurs on this many different pages of its host, and on
# this share of them.
MIN_PAGES = 5
MIN_SHARE = 0.05
# Pages whose longest blocks outside a subtree are the same hold copies of one article.
BESIDE = 2
# Template hashes up to this many (8 bytes each) are sent to every task; more are joined.
SENT_HASHES = 2_000_000

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head nav footer aside form button select input menu dialog fieldset datalist canvas audio video map".split()
)
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody table figcaption".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt li legend option optgroup summary tbody td tfoot th thead tr".split())
# An element that opens ends these elements of its kind, up to the container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
}
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "commentlist consent contentinfo cookie cookies cookiebar copyright disqus discussion footer gdpr header "
    "masthead menu menubar modal nav navbar navigation newsletter notice notification notifications pager "
    "pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets navigation "
    "complementary responses overlay paywall alert toast".split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_MARKED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "marks", "hidden", "parts", "holds", "inner", "titled", "hash")

    def __init__(self, tag: str, marks: str = "", hidden: bool = False):
        self.tag, self.marks, self.hidden = tag, marks, hidden
        self.parts: list = []
        self.holds = self.inner = self.titled = False
        self.hash = 0


def _attributes(text: str) -> tuple[str, bool]:
    marks, hidden = [], False
    for name, value in _MARKED.findall(text):
        value = value.strip("\"'").lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            hidden = True
        else:
            marks.append(value)
    return " ".join(marks), hidden


class _Tags:
    """The markup of a page, token by token, in time that grows with the page however broken it is."""

    def __init__(self, page: str):
        self.page = page
        # Quotes from which a tag is known not to end: no scan passes the same one twice in vain.
        self.dead: set[int] = set()
        self.raw_ends: dict[str, re.Pattern] = {}

    def _end(self, at: int) -> int:
        """The place of the tag's closing mark, quoted ones passed over; -1 if there is none."""
        page, seen = self.page, []
        while True:
            stop = _STOP.search(page, at)
            if stop and page[stop.start()] == ">":
                return stop.start()
            if not stop or stop.start() in self.dead:
                break
            seen.append(stop.start())
            close = page.find(stop[0], stop.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, closing) of the markup after ``at``; comments and the like have no name."""
        page, start = self.page, at
        while (start := page.find("<", start)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", False
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                return start, len(page) if end < 0 else end + 3, "", "", False
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                return start, len(page) if end < 0 else end + 1, "", "", False
            name = _NAME.match(page, start + 1)
            end = self._end(name.end()) if name else -1
            if end >= 0:
                return start, end + 1, name[2].lower(), page[name.end() : end], bool(name[1])
            start += 1
        return None

    def raw_end(self, tag: str, at: int) -> int:
        end = self.raw_ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I)).search(self.page, at)
        return end.end() if end else len(self.page)


class _Open:
    """The open elements, and by name where they stand, so none is looked for along the whole path."""

    def __init__(self, root: Node):
        self.path = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        if node.tag in BLOCK:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def cut(self, at: int) -> None:
        """Ends the element at this place and all inside it."""
        while len(self.path) > at:
            node = self.path.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def parse(page: str) -> Node:
    """A tree of elements and decoded text; never fails, whatever the markup."""
    root = Node("html")
    tags, now = _Tags(page), _Open(root)
    at = 0
    while True:
        found = tags.next(at)
        text = page[at : found[0]] if found else page[at:]
        if text:
            now.path[-1].parts.append(html.unescape(text))
        if not found:
            return root
        _, at, tag, attributes, closing = found
        if not tag:
            continue
        if closing:
            if place := now.last((tag,)):
                now.cut(place)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                at = tags.raw_end(tag, at)
            continue
        if tag in ("html", "body"):
            continue
        # A block ends the paragraph it stands in.
        if tag in CLOSES_P and now.blocks and now.path[now.blocks[-1]].tag == "p":
            now.cut(now.blocks[-1])
        if tag in ENDS:
            ended, stop = ENDS[tag]
            place = now.last(ended)
            if place > now.last(stop - ended):
                now.cut(place)
        node = Node(tag, *(_attributes(attributes) if attributes else ()))
        now.path[-1].parts.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            now.push(node)


def _post_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node))
    return order[::-1]


def _is_article(node: Node) -> bool:
    if _by_role(node):
        return False
    return node.tag in ("article", "main") or "main" in node.marks.split() or "articlebody" in node.marks


def _by_role(node: Node) -> bool:
    """Whether element name, class, id or role say that this is no article text."""
    if node.tag in DROPPED or node.hidden:
        return True
    return bool(node.marks) and not MARKS.isdisjoint(_WORDS.findall(node.marks))


def hashed(root: Node) -> list[Node]:
    """All nodes, children first, with ``hash`` set.

    ``holds`` says that an article is here or inside, ``inner`` that an ``article`` element is
    inside, and ``titled`` that a title is here or inside.
    """
    order = _post_order(root)
    for node in order:
        made = xxhash.xxh64(f"{node.tag}\0{node.marks}")
        for part in node.parts:
            if isinstance(part, Node):
                made.update(part.hash.to_bytes(8, "little"))
                node.holds |= part.holds
                node.inner |= part.inner or (part.tag == "article" and not _by_role(part))
                node.titled |= part.titled
            else:
                made.update(_SPACE.sub(" ", part).encode("utf-8", "surrogatepass"))
        node.hash = made.intdigest()
        node.holds |= _is_article(node)
        node.titled |= node.tag in ("h1", "h2")
    return order


def _articles(root: Node) -> list[Node]:
    """The outermost article elements, looked for under marked elements only if there are none elsewhere.

    A page without any is its own article.
    """
    for under_marked in (False, True):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            marked = _by_role(node)
            if not marked and (node.tag == "article" or (_is_article(node) and not node.inner)):
                found.append(node)
            elif not marked or (under_marked and node.holds):
                stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
        if found:
            return found
    return [root]


def _main_blocks(articles: list[Node], place: dict[int, int]) -> list[tuple[int, int, int]]:
    """(length, hash, place) of the blocks of text that role lets stay, longest first."""
    blocks, stack = [], list(articles)
    while stack:
        node = stack.pop()
        own, inline = [], [*reversed(node.parts)]
        while inline:
            part = inline.pop()
            if isinstance(part, str):
                own.append(part)
            elif part.tag in BLOCK:
                if not (_by_role(part) or part.tag == "header"):
                    stack.append(part)
            elif not _by_role(part):
                inline.extend(reversed(part.parts))
        text = _SPACE.sub(" ", "".join(own)).strip()
        if text:
            hashed_text = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
            blocks.append((len(text), hashed_text, place[id(node)]))
    return sorted(blocks, reverse=True)


def subtrees(page: str) -> tuple[dict[int, int], int]:
    """Hashes of a page's block subtrees, each with a hash of the main text beside it, and one of the page's articles.

    Beside a subtree stand the longest blocks outside it: those of an article's
    copies are the same whatever advert or menu each page has.
    """
    root = parse(page)
    order = hashed(root)
    articles = _articles(root)
    blocks = _main_blocks(articles, {id(n): i for i, n in enumerate(order)})
    # Blocks and characters before each place.
    many, much = [0] * (len(order) + 1), [0] * (len(order) + 1)
    for length, _, at in blocks:
        many[at + 1], much[at + 1] = 1, length
    many, much = list(accumulate(many)), list(accumulate(much))
    size: dict[int, int] = {}
    found: dict[int, int] = {}
    for i, node in enumerate(order):
        # A subtree is a run of the order that ends with its root.
        size[id(node)] = n = 1 + sum(size[id(p)] for p in node.parts if isinstance(p, Node))
        if node.tag not in BLOCK or node.tag in ("html", "body", "article", "main", "head"):
            continue
        beside = []
        # A subtree of several blocks with most of the text is no template as a whole; its blocks may be.
        if many[i + 1] - many[i + 1 - n] < 2 or 2 * (much[i + 1] - much[i + 1 - n]) <= much[-1]:
            beside = list(islice((text for _, text, at in blocks if not i - n < at <= i), BESIDE))
        context = xxhash.xxh64_intdigest(" ".join(map(str, beside)))
        found[node.hash] = min(context, found.get(node.hash, context))
    return found, xxhash.xxh64_intdigest("\n".join(f"{a.hash}" for a in articles))


def main_text(page: str | None, templates=frozenset()) -> str:
    """The blocks of the page's article, without roles that are not article text and without templates."""
    root = parse(page or "")
    hashed(root)
    articles = _articles(root)
    inside = articles[0] is not root
    blocks: list[str] = []
    open_: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(open_)).strip()
        if text:
            blocks.append(text)
        open_.clear()

    for article in articles:
        stack: list = [article]
        while stack:
            part = stack.pop()
            if part is None:
                close()
            elif isinstance(part, str):
                open_.append(part)
            elif part.tag in ("br", "hr", "img", "wbr"):
                if part.tag == "hr":
                    close()
                elif part.tag == "br":
                    open_.append(" ")
            elif part is not article and _removed(part, inside, templates):
                if part.tag in BLOCK:
                    close()
            else:
                block = part.tag in BLOCK
                if block:
                    close()
                    stack.append(None)
                stack.extend(reversed(part.parts))
        close()
    return "\n\n".join(blocks)


def _removed(node: Node, inside: bool, templates) -> bool:
    if _by_role(node) or node.tag == "header":
        titled = inside and (node.tag == "header" or "header" in node.marks) and node.titled
        return not titled
    if node.tag not in BLOCK:
        return False
    # Sentences of an article may well recur (quotations, copies): there only other blocks count as template.
    return node.hash in templates and not (inside and node.tag in PROSE)


# ---------------------------------------------------------------- on tables

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    """The lower-case host of an absolute address; empty for others and NULL."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def template_hashes(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(host, hash, n): subtrees beside at least ``min_pages`` different main texts, and this share of the host's pages.

    Pages that are copies of each other count once.  ``host`` is a hash of the name.
    """

    def make(rows: dict[str, list]) -> dict:
        host, hashes, context = [], [], []
        for h, page in zip(rows["host"], rows["page"]):
            found, own = subtrees(page)
            # Hash 0 stands for the page itself.
            host += [h] * (len(found) + 1)
            hashes += [*found, 0]
            context += [*found.values(), own]
        return {
            "host": host,
            "hash": np.array(hashes, np.uint64).view(np.int64),
            "context": np.array(context, np.uint64).view(np.int64),
        }

    chosen = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), text_of(html_col).alias("page"))
    seen = map_rows(chosen, make, "host bigint, hash bigint, context bigint").distinct()
    counts = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    counts = store(counts)
    hosts = store(counts.df.filter("hash = 0").select("host", F.col("n").alias("pages")))
    # A host with fewer pages than ``min_pages`` has no row: there the minimum alone decides.
    found = keyed_join(counts.df.filter("hash <> 0"), hosts.df, {"host": "host"}, hosts.small, "pages", counts.rows)
    enough = F.col("n") >= F.coalesce("pages", F.lit(0)) * min_share
    return found.filter(enough).select("host", "hash", "n")


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    sent: int = SENT_HASHES,
) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``; NULL or empty html has empty text.

    The template table is sent to all tasks while its measured size allows; beyond
    ``sent`` hashes each page is joined with those of its own subtrees that are
    templates, hosts and subtrees that hold many rows apart from the others.
    """
    templates = store(template_hashes(pages, url_col, html_col, min_pages))
    kinds = dict(pages.dtypes)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        text_of(html_col).alias("page"),
        F.xxhash64(host_of(F.col(url_col))).alias("host"),
    )
    schema = f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string"
    if templates.rows <= sent:
        known = np.sort(_host_and_hash(*_columns(templates.df)))
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def make(part: dict[str, list]) -> dict:
            table = shared.value
            texts = [main_text(p, _Sent(table, h)) for p, h in zip(part["page"], part["host"])]
            return {"page_id": part["page_id"], "url": part["url"], "text": texts}

        return map_rows(rows, make, schema)

    def own(part: dict[str, list]) -> dict:
        keys, hashes, hosts = [], [], []
        for key, h, page in zip(part["key"], part["host"], part["page"]):
            found = list(subtrees(page)[0])
            keys += [key] * len(found)
            hosts += [h] * len(found)
            hashes += found
        return {"key": keys, "host": hosts, "hash": np.array(hashes, np.uint64).view(np.int64)}

    def joined(part: dict[str, list]) -> dict:
        texts = [
            main_text(p, frozenset(h & 0xFFFFFFFFFFFFFFFF for h in t or ()))
            for p, t in zip(part["page"], part["templates"])
        ]
        return {"page_id": part["page_id"], "url": part["url"], "text": texts}

    keyed = rows.withColumn("key", F.xxhash64("host", "page"))
    total = templates.df.agg(F.sum("n")).first()[0]
    hits = keyed_join(
        map_rows(keyed.select("key", "host", "page"), own, "key bigint, host bigint, hash bigint").distinct(),
        templates.df, {"host": "host", "hash": "hash"}, False, "n", total,
    ).filter("n is not null")
    lists = hits.groupBy("key").agg(F.collect_set("hash").alias("templates"))
    return map_rows(keyed.join(lists, "key", "left"), joined, schema)


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("host", "hash").toArrow()
    return table["host"].to_numpy(), table["hash"].to_numpy()


def _host_and_hash(host, subtree) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (np.asarray(host, np.int64) * np.int64(0x5851F42D4C957F2D)) ^ np.asarray(subtree, np.int64)


class _Sent:
    """Membership of a host's subtree hashes in the sorted table that was sent."""

    def __init__(self, table: np.ndarray, host: int):
        self.table, self.host = table, host

    def __contains__(self, subtree: int) -> bool:
        key = _host_and_hash([self.host], np.array([subtree], np.uint64).view(np.int64))[0]
        at = np.searchsorted(self.table, key)
        return bool(at < len(self.table) and self.table[at] == key)
