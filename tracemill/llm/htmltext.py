"""Main text of web pages by removing what the pages of a host share.

1. Every page is parsed into a tree; each element outside running text is hashed with all it holds (tags, class, id, text).
2. Spark counts, per host and hash, on how many *different* articles' pages the subtree stands: copies of a page count once, so an
   article that a host shows under a hundred addresses is no template.
3. A subtree on at least LEAST_PAGES such pages of its host, or on FEW_PAGES that are half of the host's different articles, is deleted,
   wherever it stands: menus, notices, adverts, boxes.  Running text of the article itself (paragraphs, headings, quotes, tables, lists without links, blocks without a
   name, rows of blocks of one name) and subtrees with at least half of the article's text are never deleted for recurring: texts may share passages.
4. What needs no counting goes as well: elements that are never text (scripts, styles, forms, ``nav``, ``aside``, ``footer`` ...),
   hidden ones, and those whose role, class or id names a menu, header, footer, sidebar, notice, advert or comments.  Class and id words
   are layout names as well (``content-sidebar-wrap``): they never remove the article, what holds it, or half of the page's text;
   only a whole name such as ``comments`` beside other text does.  In an article a name with words of another kind (``share-price-table``) removes no paragraphs and tables.

The article is the largest ``article`` left, else ``main`` (or role ``main``), else an element marked ``articleBody``, else the body.  Its blocks are
joined by one line feed; in a page without such an element, the block that holds most of the running text stands for the article when articles
are told apart and text blocks are kept.  In a block character references are decoded and white space becomes one space.

Hosts and hashes are shuffled as (host, hash, page) rows that are counted before they meet.  A page is shuffled, compressed, only if
a candidate stands in its text, so that the counts decide; the list of deleted hashes that goes back to it is no longer than its own
elements.  The text of every other page is known when it is read.

Defined cases: null html is an empty page; a page without text has the empty text.  A null or malformed url belongs to the empty host.
Repeated rows are extracted each and count as one page.  Tags that never close end with their parent; a tag cut off by the end of the page
is dropped.  Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Run, byte_slices

LEAST_PAGES = 10
FEW_PAGES = 3  # enough on a host where they are half of the different articles
HOST_SALTS = 32

# Element names of HTML and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
NEVER = frozenset(
    "script style noscript template head title form button select textarea input option nav aside footer dialog menu iframe object embed svg math canvas audio video map noframes noembed".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table caption tbody thead tfoot tr td th dl dt dd li ol ul hgroup".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus gdpr login menu modal nav navbar "
    "navigation newsletter notice overlay pagination pager popup promo promoted recommended related reply respond search share sharing sidebar signin signup skyscraper social sponsor sponsored subscribe "
    "subscription toolbar topbar widget".split()
)
# Words that may stand beside those in a name of furniture; any other word says that the name speaks of the text (share-price-table).
LAYOUT = frozenset(
    "area article articles author bar block body bottom box btn button buttons card col column container content count feed footer form foot group head header icon icons inner item items js label left "
    "line link links list main message more news note outer page panel photo policy post posts right row section site slot small stories story text thread title top unit wide wrap wrapper".split()
)
REPLIES = frozenset("comment comments commentlist disqus respond reply".split())  # may be longer than the article they answer
FRAME_ONLY = frozenset("header footer masthead".split())  # such words inside an article may name its own headline
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "attributes", "children", "parent", "hash", "size", "own", "links", "spared")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.spared = False

    def walk(self) -> Iterator[Element]:
        """This element and all below it, parents first."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def parse(page: str) -> Element:
    """The tree of a page; text is kept with its references undecoded."""
    root = current = Element("html", {}, None)
    at, length = 0, len(page)
    while at < length:
        found = _TOKEN.search(page, at)
        if not found:
            current.children.append(page[at:])
            break
        if found.start() > at:
            current.children.append(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[6]
        if not tag:
            continue
        tag = tag.lower()
        if not (found[4] or found[8]):  # cut off by the end of the page
            break
        if found[1] or found[5]:
            current = _close(current, tag)
            continue
        raw = found[3] or found[7] or ""
        attributes = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in reversed(_ATTRIBUTE.findall(raw))} if raw.strip(" /\n\t\r") else {}
        if tag == "html":
            continue
        current = _make_room(current, tag)
        element = Element(tag, attributes, current)
        current.children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else length])
            at = end.end() if end else length
        elif tag not in VOID and not raw.endswith("/"):
            current = element
        elif raw.endswith("/") and tag not in VOID and tag not in ("path", "circle", "rect", "use", "line", "g", "svg"):
            current = element  # HTML ignores the slash of other elements
    return root


def _close(current: Element, tag: str) -> Element:
    node: Element | None = current
    while node is not None and node.tag != tag:
        # An inline end tag does not close blocks that opened inside it.
        if tag in INLINE and node.tag in BLOCK:
            return current
        node = node.parent
    return node.parent if node is not None and node.parent is not None else current


def _make_room(current: Element, tag: str) -> Element:
    """Close what the start of ``tag`` ends: an open paragraph, or a sibling item without end tag."""
    if tag in CLOSES_P:
        node: Element | None = current
        while node is not None and node.tag in INLINE:
            node = node.parent
        if node is not None and node.tag == "p" and node.parent is not None:
            current = node.parent
        elif node is not None and re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", node.tag) and node.parent is not None:
            current = node.parent
    if tag in SIBLINGS:
        node, scope = current, SCOPES[tag]
        while node is not None and node.tag not in scope:
            if node.tag in SIBLINGS[tag] and node.parent is not None:
                current = node.parent
            node = node.parent
    return current


def measure(root: Element) -> None:
    """Set hash, text size and link text size of all elements, leaves first."""
    for node in reversed(list(root.walk())):
        state = blake2b(digest_size=8)
        attributes = node.attributes
        state.update(f"<{node.tag} {attributes.get('class', '')} {attributes.get('id', '')}>".encode("utf-8", "surrogatepass"))
        size = own = links = 0
        for child in node.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                if text:
                    own += len(text)
                    state.update(b"t" + text.encode("utf-8", "surrogatepass"))
            else:
                size += child.size
                links += child.links
                state.update(b"e" + child.hash.to_bytes(8, "little", signed=True))
        size += own
        node.own, node.size, node.links = (0, 0, 0) if node.tag in RAW else (own, size, size if node.tag == "a" else links)
        node.hash = int.from_bytes(state.digest(), "little", signed=True)


def is_marked(node: Element, inside: bool) -> bool:
    """Whether the element's tag, role or state says that it is no main text."""
    if node.tag in NEVER:
        return True
    attributes = node.attributes
    if node.tag == "header" and not inside:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("aria-modal") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    return attributes.get("role", "").lower() in ROLES


def is_named(node: Element, inside: bool) -> bool:
    """Whether a word of the element's class or id names furniture."""
    if not node.attributes or node.tag in ("body", "main", "html"):
        return False
    words = set(_WORDS.findall(f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower()))
    if words & FURNITURE:
        return not (inside and speaks_of_text(node) and holds_prose(node))
    return not inside and bool(words & FRAME_ONLY)


def speaks_of_text(node: Element) -> bool:
    """Whether each name with a furniture word has words of another kind as well."""
    parts = [set(_WORDS.findall(name)) for name in whole_names(node)]
    return all(any(not w.isdigit() for w in words - FURNITURE - FRAME_ONLY - LAYOUT) for words in parts if words & FURNITURE)


def holds_prose(node: Element) -> bool:
    """Whether a paragraph, quote or table in the element is more text than links."""
    return any(n.tag in ("p", "table", "blockquote", "pre", "dl") and 2 * n.links < n.size for n in node.walk())


def whole_names(node: Element) -> set[str]:
    return set(f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower().split())


def is_furniture(node: Element, inside: bool) -> bool:
    """Whether the element says by itself that it is no main text."""
    return is_marked(node, inside) or (not node.spared and is_named(node, inside))


def find_article(root: Element) -> Element:
    """The element that holds the main text, the whole tree if none says so; sets which elements no class or id word removes.

    An article under such a word counts if the word is part of a layout name, or if there is no other.
    """
    found: dict[bool, list[list[Element]]] = {named: [[], [], []] for named in (False, True)}
    whole: set[int] = set()
    total, stack = 0, [(root, False, False, False)]
    while stack:
        node, inside, named, exact = stack.pop()
        if node is not root:
            if is_marked(node, inside):
                continue
            if is_named(node, inside):
                named, exact = True, exact or bool(whole_names(node) & (FURNITURE | FRAME_ONLY))
        total += node.own
        if exact:
            whole.add(id(node))
        if node.tag == "article" and not inside:
            found[named][0].append(node)
        elif node.tag == "main" or node.attributes.get("role", "").lower() == "main":
            found[named][1].append(node)
        elif node.attributes.get("itemprop", "").lower() == "articlebody":
            found[named][2].append(node)
        inner = inside or node.tag == "article"
        stack.extend((c, inner, named, exact) for c in reversed(node.children) if not isinstance(c, str))
    article, other = (next((max(kind, key=lambda n: n.size) for kind in found[named] if kind), root) for named in (False, True))
    if article is root:
        article = other
    else:
        article = max([article, *(n for kind in found[True] for n in kind if id(n) not in whole)], key=lambda n: n.size)
    _spare(article, article is not root, total)
    return article


def _spare(article: Element, marked: bool, total: int) -> None:
    """Mark the elements of the article whose class or id names furniture, but which hold too much of its text to be that."""
    text: dict[int, int] = {}
    plain, order, stack = 0, [], [(article, False)]
    while stack:
        node, named = stack.pop()
        if node is not article:
            if is_marked(node, marked):
                continue
            named = named or is_named(node, marked)
        plain += 0 if named else node.own
        order.append((node, named))
        stack.extend((c, named) for c in node.children if not isinstance(c, str))
    for node, _ in reversed(order):
        text[id(node)] = node.own + sum(text.get(id(c), 0) for c in node.children if not isinstance(c, str))
    for node, named in order:
        if not named or 2 * text[id(node)] < text[id(article)]:
            continue
        names = whole_names(node)
        if plain and (names & REPLIES or 2 * node.links >= node.size or (2 * text[id(node)] < total and names & FURNITURE)):
            continue
        node.spared = True


def find_core(article: Element, root: Element) -> Element:
    """The article, or on a page that marks none the lowest block with more than half of the text of its paragraphs, headings, quotes and tables."""
    if article is not root:
        return article
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is not root and is_furniture(node, False):
            continue
        prose = inside or (node.tag in PROSE and 2 * node.links < node.size)
        order.append((node, prose))
        stack.extend((c, prose) for c in node.children if not isinstance(c, str))
    text: dict[int, int] = {}
    for node, prose in reversed(order):
        text[id(node)] = (node.size - node.links if prose else 0) or sum(text.get(id(c), 0) for c in node.children if not isinstance(c, str))
    core = root
    while True:
        below = [c for c in core.children if not isinstance(c, str) and text.get(id(c), 0)]
        most = max(below, key=lambda c: text[id(c)], default=core)
        # Parts of one article stand side by side under the same name.
        name = most.attributes.get("class", "")
        parts = sum(c.tag == most.tag and c.attributes.get("class", "") == name for c in below) if name or most.tag == "section" else 1
        if most is core or most.tag in PROSE or most.tag in INLINE or parts > 1 or 2 * text[id(most)] <= text[id(core)]:
            return core
        core = most


def article_hash(core: Element, article: Element) -> int:
    """What tells articles apart: all of a marked article, else the text blocks of the core, or all of it if there are none."""
    if core is article and core.parent is not None:
        return core.hash
    state, stack, some = blake2b(digest_size=8), [core], False
    while stack:
        node = stack.pop()
        if node is not core and is_furniture(node, False):
            continue
        if node.tag in PROSE and 2 * node.links < node.size:
            state.update(node.hash.to_bytes(8, "little", signed=True))
            some = True
        else:
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return int.from_bytes(state.digest(), "little", signed=True) if some else core.hash


def running_blocks(core: Element) -> set[int]:
    """Blocks of the core that are running text, whatever their tag.

    Text blocks; and, as long as all above them are so too, blocks without class, id and role, or three and more neighbours of one tag and class
    that hold half of the text.  Links must be the smaller part.  A single block with a name of its own is a box and may be a template.
    """
    found, stack = set(), [(core, True)]
    while stack:
        node, plain = stack.pop()
        alike: dict[tuple[str, str], list[int]] = {}
        below = [c for c in node.children if not isinstance(c, str)]
        for child in below:
            group = alike.setdefault((child.tag, child.attributes.get("class", "")), [0, 0])
            group[0] += 1
            group[1] += child.size
        for child in below:
            count, size = alike[child.tag, child.attributes.get("class", "")]
            unnamed = not child.attributes.keys() & {"class", "id", "role"}
            text = child.tag in PROSE or (plain and (unnamed or (count >= 3 and 2 * size >= core.size)))
            if text and 2 * child.links < child.size:
                found.add(id(child))
            stack.append((child, plain and text))
    return found


def candidates(article: Element, root: Element) -> Iterator[Element]:
    """Elements that go if they recur: those outside running text, and not what holds most of the article."""
    core = find_core(article, root)
    within, running = set(map(id, core.walk())), running_blocks(core)
    above, node = {id(root)}, core
    while node is not None:
        above.add(id(node))
        node = node.parent
    for node in root.walk():
        if id(node) in above or node.tag in INLINE or node.tag in NEVER or node.tag in ("body", "head") or not node.size:
            continue
        if (id(node) in within and 2 * node.size >= core.size) or (article is root and 2 * node.size >= root.size):
            continue
        if id(node) in running:
            continue
        yield node


def depends_on_counts(article: Element, root: Element) -> bool:
    """Whether a candidate stands in the text that is left, so that the counts decide about it."""
    waiting = {id(n) for n in candidates(article, root)}
    marked, stack = article is not root, [article]
    while waiting and stack:
        node = stack.pop()
        if id(node) in waiting:
            return True
        stack.extend(c for c in node.children if not isinstance(c, str) and not is_furniture(c, marked))
    return False


def shared_subtrees(page: str) -> tuple[int, list[int], bool]:
    """A hash of the article's text, the hashes of the candidates, and whether the text depends on their counts."""
    root = parse(page)
    measure(root)
    article = find_article(root)
    return article_hash(find_core(article, root), article), sorted({n.hash for n in candidates(article, root)}), depends_on_counts(article, root)


def main_text(page: str, recurring: set[int] | None) -> str | None:
    """The article without furniture and without the candidates whose hash is in ``recurring``; None if that is not known but needed."""
    root = parse(page)
    measure(root)
    article = find_article(root)
    if recurring is None and depends_on_counts(article, root):
        return None
    deleted = {id(n) for n in candidates(article, root) if n.hash in recurring} if recurring else set()
    marked = article is not root
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    stack: list[Element | str | None] = [article]
    while stack:
        node = stack.pop()
        if node is None:
            end_block()
        elif isinstance(node, str):
            line.append(html.unescape(node))
        elif node is not article and (id(node) in deleted or is_furniture(node, marked)):
            if node.tag in BLOCK:
                end_block()
        elif node.tag in ("br", "td", "th"):
            line.append(" ")
            stack.append(" ")
            stack.extend(reversed(node.children))
        else:
            if node.tag in BLOCK:
                end_block()
                stack.append(None)
            stack.extend(reversed(node.children))
    end_block()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


ELEMENTS = "page_key binary, host string, article long, subtree long, page_id long, url string, html binary"


def _count_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per candidate, one without a subtree per page, and one with the compressed page where the text depends on counts."""
    coder = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part, texts in byte_slices(batch, "html"):
            rows, articles, subtrees, waiting, packed = [], [], [], [], []
            for row, page in enumerate(texts):
                article, found, depends = shared_subtrees(page)
                rows += [row] * (1 + len(found))
                articles += [article] * (1 + len(found))
                subtrees += [None, *found]
                if depends:
                    waiting.append(row)
                    packed.append(coder.compress(page.encode("utf-8", "surrogatepass")))
            keys, more = part.take(pa.array(rows, pa.int64())), part.take(pa.array(waiting, pa.int64()))
            none = lambda n, kind: pa.nulls(n, kind)
            columns = {
                "page_key": pa.chunked_array([keys.column("page_key"), more.column("page_key")]),
                "host": pa.chunked_array([keys.column("host"), more.column("host")]),
                "article": pa.chunked_array([pa.array(articles, pa.int64()), none(len(waiting), pa.int64())]),
                "subtree": pa.chunked_array([pa.array(subtrees, pa.int64()), none(len(waiting), pa.int64())]),
                "page_id": pa.chunked_array([none(len(rows), pa.int64()), more.column("page_id")]),
                "url": pa.chunked_array([none(len(rows), pa.string()), more.column("url").cast(pa.string())]),
                "html": pa.chunked_array([none(len(rows), pa.binary()), pa.array(packed, pa.binary())]),
            }
            yield pa.table(columns).combine_chunks().to_batches()[0] if rows or waiting else pa.RecordBatch.from_pylist([], schema=pa.table(columns).schema)


TEXTS = "page_id long, url string, text string"


def _texts(ids: pa.Array, urls: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, urls.cast(pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _extract_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages whose text no count can change."""
    for batch in batches:
        for part, pages in byte_slices(batch, "html"):
            found = _texts(part.column("page_id"), part.column("url"), [main_text(page, None) for page in pages])
            yield found.filter(pa.compute.is_valid(found.column("text")))


def _extract_waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other pages, with the subtrees of theirs that recur."""
    coder = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            pages = (coder.decompress(p).decode("utf-8", "surrogatepass") for p in part.column("html").to_pylist())
            found = [main_text(page, set(hashes or ())) for page, hashes in zip(pages, part.column("recurring").to_pylist(), strict=True)]
            yield _texts(part.column("page_id"), part.column("url"), found)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    run = Run(pages.sparkSession, "htmltext")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("host", host(F.col("url")))
    rows = rows.withColumn("page_key", F.unhex(F.md5(F.concat_ws("\n", "host", "html").cast("binary"))))
    first_pass = run.land(rows.mapInArrow(_count_elements, ELEMENTS), "elements")
    elements = first_pass.where(F.col("html").isNull()).select("page_key", "host", "article", "subtree")
    waiting = first_pass.where(F.col("html").isNotNull()).select("page_key", "host", "page_id", "url", "html")
    different = elements.select("host", "subtree", "article").distinct()
    counted = different.where(F.col("subtree").isNotNull()).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
    # Half of the articles can be fewer than least_pages only on hosts of few articles; a host of many has its rows dealt over the salts.
    sizes = different.where(F.col("subtree").isNull()).groupBy("host").agg(F.count(F.lit(1)).alias("articles")).where(F.col("articles") < 2 * least_pages)
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
    few = counted.where((F.col("pages") >= FEW_PAGES) & (F.col("pages") < least_pages)).withColumn("salt", F.pmod("subtree", F.lit(HOST_SALTS)).cast("int"))
    few = few.join(sizes, ["host", "salt"]).where(2 * F.col("pages") >= F.col("articles"))
    recurring = counted.where(F.col("pages") >= least_pages).select("host", "subtree").unionAll(few.select("host", "subtree"))
    # Only pages whose text depends on the counts get them; all others are done where they are read.
    asked = elements.where(F.col("subtree").isNotNull()).join(waiting.select("page_key").distinct(), "page_key", "left_semi").select("page_key", "host", "subtree").distinct()
    lists = asked.join(recurring, ["host", "subtree"]).groupBy("page_key").agg(F.collect_set("subtree").alias("recurring"))
    rest = waiting.join(lists, "page_key", "left").select("page_id", "url", "html", "recurring").mapInArrow(_extract_waiting, TEXTS)
    known = rows.select("page_id", "url", "html").mapInArrow(_extract_known, TEXTS)
    return known.unionAll(rest).withColumn("n_chars", F.char_length("text").cast("long"))
