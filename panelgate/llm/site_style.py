"""Main text of web pages with the help of a site style tree.

Pages of one host are merged into a tree: an element meets the same element of
another page when the paths and the sequences of siblings on the way agree. An
element whose children are arranged alike everywhere and a text that stands at the
same place of most pages carry little information; branches of low importance are
removed from each page. Menus, forms and the like are known by their elements; what a
class or id says is a doubt about an element, which its importance takes in.
"""

import html
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.llm.common import materialize

# Elements that start a block of text, that have no end tag, whose
# content is no markup, and that never belong to the main text.
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table "
    "tbody tfoot thead tr ul caption menu dialog".split()
)
SPACED = set("br td th img input wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
NOISE_TAGS = set(
    "head nav header footer aside form script style noscript template iframe svg button select "
    "textarea object canvas audio video dialog menu title xmp noembed noframes math".split()
)
NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr header hidden login masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promotion related replies "
    "reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
    "widgets".split()
)
NOISE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar "
                  "navigation search".split())
CLOSED_BY = {  # an open element of the key ends where one of the values starts
    "p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "tbody": {"tbody", "tfoot"}, "thead": {"tbody", "tfoot"},
}

# Words in front of a listed one that say it is not meant, and words
# behind one that only say what kind of box it is.
NEGATIONS = set("has have is no non not with without".split())
BOXES = set(
    "area bar block box btn button buttons column container content icon inner item items left "
    "link links list outer panel right row section slot top unit wrap wrapper".split()
)

# Production parameters: weight of an element's own presentation against its children,
# importance below which a branch goes, pages of importance 1 that every place counts
# besides its own, and how many more inside an article, as a share of the host's pages;
# pages of importance 0, as shares of the place's own, for elements whose names mention
# a listed word, or are made of one.
DAMPING, LOW, KEEP, ARTICLE_KEEP = 0.9, 0.3, 2, 0.1
MENTIONED, NAMED = 1, 2
DOUBT = {0: 0.0, MENTIONED: 0.5, NAMED: 4.0}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def host_of(url: str | None) -> str:
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].partition(":")[0].lower()


def _attributes(text):
    found = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(text):
        found.setdefault((name or bare).lower(), a or b or c)
    return found


def _is_noise(tag, attributes):
    """Whether markup says that an element is no text to read here, whatever it is called."""
    if tag in NOISE_TAGS:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes:
        return True
    if attributes.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


def doubt_of(tag: str, attributes: dict) -> int:
    """How much an element's class and id speak against it: 0, ``MENTIONED`` or ``NAMED``.

    What a name means stands at its end, less the kind of box: ``comment-list`` holds
    comments and ``user-comments`` too, while ``share-price`` is a price, ``related-work``
    is work and ``has-sidebar`` is something beside a sidebar.
    """
    if tag in ("html", "body", "article", "main"):
        return 0
    most = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [n.lower() for n in _NAME.findall(name)]
        if not NOISE_NAMES.intersection(words):
            continue
        # The head of an entry holds its title and belongs to it.
        if "header" in words and {"entry", "article", "post"}.intersection(words):
            continue
        most = max(most, MENTIONED)
        while len(words) > 1 and words[-1] in BOXES:
            words.pop()
        if words[-1] in NOISE_NAMES and not NEGATIONS.intersection(words[:-1]):
            return NAMED
    return most


class Page:
    """Elements outside of known noise, and the text blocks they own, in page order.

    ``elements`` holds ``[parent, signature, children]``, ``blocks`` ``(owner, text)``.
    ``region`` is the first article or main element that owns a text, else the root.
    ``narrow`` says that text stands outside of articles which hold half of it or more.
    ``doubts`` holds what names say against elements, ``named`` the blocks in branches
    that are called noise; where these hold more than half of the page's text and no
    article has any, the names only count as mentioned.
    """

    def __init__(self, source: str):
        self.elements, self.blocks = [[-1, "", []]], []
        self.articles, self.doubts = set(), {}
        self._stack, self._names = [0], [""]
        self._text, self._noise = [], 0
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            if found is None:
                self._words(source[at:])
                break
            self._words(source[at : found.start()])
            at = found.end()
            close, tag, rest = (found.group(i) if found.group(2) else found.group(i + 3) for i in (1, 2, 3))
            if tag is None:
                continue
            tag = tag.lower()
            if close:
                self._close(tag)
            else:
                self._open(tag, rest or "")
                if tag in RAW and not rest.rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = len(source) if end is None else end.start()
        self._flush()
        self.within = [self._within(owner) for owner, _ in self.blocks]
        self.region = min((i for i in self.within if i is not None), default=0)
        self.named = {i for i, (owner, _) in enumerate(self.blocks) if self._in_named(owner)}
        size, named = [0, 0], 0
        for n, (i, (_, text)) in enumerate(zip(self.within, self.blocks)):
            if n in self.named:
                named += len(text)
            else:
                size[i is not None] += len(text)
        if named > size[0] and not size[1]:
            self.named = set()
            self.doubts = dict.fromkeys(self.doubts, MENTIONED)
            size = [0, 0]
            for i, (_, text) in zip(self.within, self.blocks):
                size[i is not None] += len(text)
        self.narrow = 0 < size[0] <= size[1]

    def _in_named(self, i):
        while i >= 0 and self.doubts:
            if self.doubts.get(i) == NAMED:
                return True
            i = self.elements[i][0]
        return False

    def _within(self, i):
        """The outermost article that holds an element."""
        found = None
        while i >= 0:
            found = i if i in self.articles else found
            i = self.elements[i][0]
        return found

    def _words(self, text):
        if text and not self._noise:
            self._text.append(text)

    def _flush(self):
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._stack[-1], text))
            self._text = []

    def _open(self, tag, rest):
        attributes = _attributes(rest) if rest.strip() else {}
        noise = _is_noise(tag, attributes)
        if tag in SPACED and not self._noise:
            self._text.append(" ")
        doubt = doubt_of(tag, attributes) if attributes and not noise and not self._noise else 0
        inline = tag not in BLOCKS
        noise = noise or (inline and doubt == NAMED)
        # Inside of noise inline elements are followed, too, to tell their end tags apart.
        if inline and not noise and not self._noise:
            return
        if not self._noise and not inline:
            self._flush()
        while self._names[-1] in CLOSED_BY and tag in CLOSED_BY[self._names[-1]]:
            self._pop()
        if tag in VOID:
            return
        self._names.append(tag)
        if noise or self._noise:
            self._noise += 1
            self._stack.append(self._stack[-1])
            return
        i = len(self.elements)
        if doubt:
            self.doubts[i] = doubt
        parent = self._stack[-1]
        signature = f"{tag}.{' '.join(sorted(attributes.get('class', '').split()))}"
        self.elements.append([parent, signature, []])
        self.elements[parent][2].append(i)
        self._stack.append(i)
        if tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article"):
            self.articles.add(i)

    def _close(self, tag):
        if tag not in self._names[1:]:
            return
        if tag in BLOCKS and not self._noise:
            self._flush()
        while self._names[-1] != tag:
            self._pop()
        self._pop()

    def _pop(self):
        if self._noise:
            self._noise -= 1
        else:
            self._flush()
        self._names.pop()
        self._stack.pop()

    def content(self) -> list[tuple[int, str]]:
        """Blocks of a page that no other page of its host helps to judge.

        Where articles hold half of the text or more, these are the articles' blocks.
        """
        return [
            b for n, (i, b) in enumerate(zip(self.within, self.blocks))
            if n not in self.named and not (self.narrow and i is None)
        ]

    def without(self, low: set[int]) -> list[tuple[int, str]]:
        """Blocks without those of low importance and those in branches called noise.

        A page of which nothing would be left is a copy of others and only loses the latter.
        """
        left = [b for n, b in enumerate(self.blocks) if n not in low and n not in self.named]
        return left or [b for n, b in enumerate(self.blocks) if n not in self.named]


def _hash(*values):
    return xxhash.xxh3_64_intdigest("\0".join(map(str, values))) - (1 << 63)


def nodes(page: Page, host: str) -> list[tuple]:
    """``(place, parent, kind, node, value, below)`` of the page's part of its host's tree.

    ``node`` names the merged node of the host, ``value`` what this page has there: an element's
    sequence of children, or a text. ``place`` of a text is its block's number, kind 1
    a text outside and 2 one inside an article; kind 0 is an element outside and 4 one
    inside (or the article), plus 8 for every degree of doubt; kind 3 is the page. ``below`` counts the texts and the elements
    with text that an element has as children; of the page, twice its texts, and one more
    where it is ``narrow``.
    """
    out = [(-1, -1, 3, _hash("page", host), 0, 2 * len(page.blocks) + page.narrow)]
    keys, styles = {0: _hash("root", host)}, {}
    for i, (parent, _, children) in enumerate(page.elements):
        styles[i] = _hash(*[page.elements[c][1] for c in children])
        for nth, child in enumerate(children):
            keys[child] = _hash(keys[i], styles[i], nth)
    needed: dict = {}
    counts: dict = {}
    for number, ((owner, text), article) in enumerate(zip(page.blocks, page.within)):
        inside = article is not None
        nth = counts[owner] = counts.get(owner, -1) + 1
        out.append((number, owner, 2 if inside else 1, _hash(keys[owner], styles[owner], "text", nth), _hash(text), 0))
        while owner >= 0 and owner not in needed:
            needed[owner] = 4 if inside else 0
            inside = inside and owner != article
            owner = page.elements[owner][0]
    below = {i: counts.get(i, -1) + 1 for i in needed}
    for i in needed.keys() - {0}:
        below[page.elements[i][0]] += 1
    doubts = page.doubts.get
    out += [
        (i, page.elements[i][0], needed[i] + 8 * doubts(i, 0), keys[i], styles[i], below[i])
        for i in sorted(needed)
    ]
    return out


def low_blocks(found: list[dict]) -> list[int]:
    """Numbers of the blocks that lie in branches of low importance.

    ``found`` holds the page's nodes with ``pages`` and ``styles`` of the merged node,
    its ``entropy`` (base: its pages) and ``same``, the pages that have this value.
    An element is as important as its presentation varies and its children are; the
    children are those of the page's own arrangement. Children that ``found`` lacks are
    of this page alone and have importance 1. Every importance is drawn towards 1 the
    more, the fewer pages have the place, and inside articles more than outside. What an
    element is called draws it towards 0 (``DOUBT``): one whose name mentions a listed word
    goes where its children repeat, one that is called so however they vary, and then says
    nothing about its parent.
    """
    # Repeated rows of a page bring its nodes more than once.
    found = list({(f["kind"], f["place"]): f for f in found}.values())
    page = next((f for f in found if f["kind"] == 3), None)
    if page is None:
        return []
    low = set()
    elements = {f["place"]: f for f in found if f["kind"] % 4 == 0}
    below: dict = {}
    importance = {}

    def shrunk(f, value):
        doubt = f["kind"] // 8
        more = KEEP + (ARTICLE_KEEP * page["pages"] if f["kind"] % 8 in (2, 4) else 0)
        more = 0 if doubt == NAMED else more
        return (f["pages"] * value + more) / (f["pages"] * (1 + DOUBT[doubt]) + more)

    for f in found:
        if f["kind"] in (1, 2):
            alike = math.log(f["same"]) / math.log(f["pages"]) if f["pages"] > 1 else 0.0
            below.setdefault(f["parent"], []).append((("text", f["place"]), shrunk(f, 1.0 - alike)))
    for i in sorted(elements, reverse=True):  # children come after their parents
        f = elements[i]
        own = f["entropy"] if f["pages"] > 1 else 1.0
        share = DAMPING ** f["styles"]
        children = below.get(i, [])
        alone = f["below"] - len(children)
        heard = [v for (kind, place), v in children if kind == "text" or elements[place]["kind"] // 8 < NAMED]
        mean = (sum(heard) + alone) / (len(heard) + alone) if heard or alone else 1.0
        importance[i] = shrunk(f, (1 - share) * own + share * mean)
        below.setdefault(f["parent"], []).append((("element", i), importance[i]))

    def remove(i):
        for (kind, place), value in below.get(i, []):
            if kind == "text":
                low.add(place)
            else:
                remove_stack.append(place)

    # Branches that are called noise go with every page and are not listed.
    called = {i for i, f in elements.items() if f["kind"] // 8 == NAMED}
    remove_stack = [
        i for i, v in importance.items()
        if v < LOW and elements[i]["parent"] >= 0 and i not in called
    ]
    seen = set()
    while remove_stack:
        i = remove_stack.pop()
        if i not in seen:
            seen.add(i)
            remove(i)
    for i, children in below.items():
        if i not in called:
            low.update(place for (kind, place), v in children if kind == "text" and v < LOW)
    return sorted(low)


NODES = "page_id {0}, key long, place int, parent int, kind int, node long, value long, below int"


def site_nodes(keyed: DataFrame) -> DataFrame:
    """All pages' nodes, one row each."""
    kind = keyed.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "html")]
            of, rows = [], []
            for i, (key, url, source) in enumerate(zip(*columns)):
                for n in nodes(Page(source), host_of(url)):
                    of.append(i)
                    rows.append((key, *n))
            found = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            arrays = [batch.column("page_id").take(pa.array(of, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["page_id", "key", "place", "parent", "kind", "node", "value", "below"]
            )

    return keyed.mapInArrow(run, NODES.format(kind))


def removals(keyed: DataFrame) -> DataFrame:
    """``(page_id, key, low)`` for pages that lose blocks; ``low`` lists their numbers.

    With an empty ``low`` come narrow pages that other pages of the host judged.

    Values are counted before they are shuffled, so a host with a third of all pages
    sends one row per task for what its pages share.
    """
    kind = keyed.schema["page_id"].dataType.simpleString()
    found = site_nodes(keyed)
    # Written down, as it is used twice and each use would read all pages' markup.
    counted = materialize(found.groupBy("node", "value").agg(F.count("*").alias("same")), "values")
    logs = F.col("same") * F.log(F.col("same").cast("double"))
    merged = counted.groupBy("node").agg(
        F.sum("same").alias("pages"), F.count("*").alias("styles"), F.sum(logs).alias("logs")
    ).filter(F.col("pages") >= 2)
    # -sum(p log p) with p = same / pages, as a share of log(pages).
    entropy = F.when(
        F.col("pages") > 1, 1 - F.col("logs") / (F.col("pages") * F.log(F.col("pages").cast("double")))
    ).otherwise(1.0)
    shared = counted.join(merged, "node").select(
        "node", "value", "same", "pages", "styles", entropy.alias("entropy")
    )
    # A text that no other page has is important whatever the tree says: it only counts
    # in ``below`` of its owner. So do elements no other page has, with all inside them.
    telling = found.join(shared, ["node", "value"]).filter(
        "kind % 4 = 0 or kind = 3 or same > 1"
    )
    by_page = telling.groupBy("page_id", "key").agg(F.collect_list(F.struct(
        "place", "parent", "kind", "pages", "styles", "entropy", "same", "below")).alias("nodes"))

    def run(batches):
        for batch in batches:
            of_pages = batch.column("nodes").to_pylist()
            low = [low_blocks(n) for n in of_pages]
            low = [
                found if found or any(n["kind"] == 3 and n["below"] % 2 for n in of) else None
                for found, of in zip(low, of_pages)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("key"), pa.array(low, pa.list_(pa.int32()))],
                ["page_id", "key", "low"],
            )

    judged = by_page.mapInArrow(run, f"page_id {kind}, key long, low array<int>")
    return judged.filter(F.col("low").isNotNull())


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    ``text`` joins the main blocks by two line feeds, each with its white space
    narrowed to single spaces; it is empty for null, empty or text-less pages. A page
    alone on its host is taken as a whole, less its noise, or less what stands outside
    of articles that hold half of its text or more. Repeated rows are extracted alike,
    each once; an empty table gives none. Pages count whole, however long or deep;
    columns other than these three are not read, whatever their names.
    """
    keyed = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
        F.xxhash64("page_id", "url", "html").alias("key"),
    )
    # Written down, the list has a known size: Spark moves whole pages only for a long one.
    low = removals(keyed).groupBy("page_id", "key").agg(F.first("low").alias("low"))
    low = materialize(low.withColumnsRenamed({"page_id": "of", "key": "of_key"}), "low")
    joined = keyed.join(
        low, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left"
    ).select("page_id", "url", "html", "low")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = []
            for source, gone in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist()):
                page = Page(source)
                blocks = page.content() if gone is None else page.without(set(gone))
                texts.append("\n\n".join(t for _, t in blocks))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
