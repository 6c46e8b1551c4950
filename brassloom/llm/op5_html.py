"""HTML extraction with site style trees.

The pages of a host are merged into one tree of styles: a node stands for all
block elements with the same path of tag and class names (digits are one sign,
levels below ``DEEPEST``, where browsers stop nesting too, belong to the one there). It counts the pages that hold
it, the ways in which its children are laid out (presentation styles) and, at its
text blocks, on how many pages each block occurs (content features).

* A block's importance falls with the entropy of its place over the pages: 1 for
  one that stands on a single page, 0 for one on all. What is link text counts
  nothing. A node's content is that of the blocks at or below it.
* A node's own importance joins the entropy of its presentation styles and its
  content (``composite``).
* The information of a node is the text at or below it, weighed by importance.
  From the root the tree is followed down while one branch holds more than half
  of its parent's information in a single element of its pages; the way ends at
  the branch that lays out the main text, or at ``article`` or ``main``.
* A branch beside the way has the importance of its node times its reach: its
  information on a page that holds it, against that of the branch on the way.
* Declared roles (``nav``, ``footer``, class ``ad`` ...) are a prior on importance. Beside
  the way it is ``PRIOR[0]`` for a host of one page and rises to ``PRIOR[1]`` for one of
  ``KNOWN`` pages, so the tree overrules names where it knows the host. Inside the
  main text, where no statistics tell reader comments from text, it is ``INSIDE``.

Branches below ``LEAST`` importance are removed from each page. Inside the main text
a branch without a declared role is removed only on hosts of ``PAGES`` pages and more
and never a heading, paragraph or list item, whatever holds it, since a host may hold
copies of one article. A host of one page has no entropy to go by: reach and prior
decide. A host's statistics are sums that Spark adds up from all its pages; no host's
pages meet in one task.

Text blocks are what block elements delimit. References are decoded, white space
becomes one space, blocks are joined in page order by one space. Scripts, styles,
form controls and elements that are not shown never hold text.

Edge cases: null html is empty, and its text too. Malformed markup never fails:
unclosed elements end with their parents, what isn't a tag is text. Pages of any length and
any markup are read in time that grows with their length. Pages with a
null or unreadable url share one host. Repeated pages count as pages; further
columns are ignored by the query, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brassloom.llm.common import save, ship, small_batches, table

LEAST, PAGES, DAMPING = 0.2, 4, 0.9
#: The weight of declared roles beside the way (on one page, on KNOWN pages and more) and inside the main text.
PRIOR, KNOWN, INSIDE = (0.1, 0.5), 20, 0.15
#: What a recurring block still counts, so that hosts on which all recurs have a main text; the share that leads on; elements a page at most on the way.
FLOOR, LEADS, SINGLE = 0.1, 0.5, 1.25
#: Levels of the tree: the depth to which browsers nest elements.
DEEPEST = 512
#: Hosts and removed branches (8 bytes each) up to which they are broadcast.
FEW = 100_000
#: Paths whose numbers a worker remembers.
REMEMBER = 200_000

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_NEITHER, _SPACE = re.compile(r"[^>=]*"), re.compile(r"\s*")
#: An attribute's name and value; values in quotes are passed over as a whole.
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'=/]""")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag closes when they are open, up to the element that bounds the search.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements that hold no text to read.
_NEVER = frozenset("script style noscript template head button select textarea input iframe object embed svg canvas audio video title".split())
#: Elements whose role isn't the main text (``header`` only outside article and main).
_ROLES = frozenset("nav aside footer form dialog menu".split())
#: Elements that hold a whole page or its main text, whatever their names say.
_WHOLE = frozenset("html body main article".split())
#: Whole names in class, id or role that declare a part that is no main text; so do names made of these words, neutral ones and numbers only (``cookie-notice``, ``ad-2``, ``comment-list``).
_NOISE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted related reply replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_NEUTRAL = frozenset("area bar block bottom box column container count form inner item left list outer panel primary right row secondary section site slot thread top unit wrap wrapper zone".split())
#: Elements that recurrence alone never removes.
_KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6 p blockquote pre li td".split())

#: What a node is: declared, at or below a declared one, kept, the end of the way, holding block elements, a paragraph or main heading.
DECLARED, BELOW, KEPT, END, LAYOUT, PLAIN, HEADING = (1 << k for k in range(7))
ROOT = 0


def _attributes(raw: str) -> dict[str, str]:
    """Names and values; of a repeated name, the first, as in browsers."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw or ""):
        if m[1]:
            out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def _unseen(tag: str, of: dict[str, str]) -> bool:
    return tag in _NEVER or "hidden" in of or of.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", of.get("style", "")))


def _declared(tag: str, of: dict[str, str], in_main: bool) -> bool:
    if tag in _ROLES or (tag == "header" and not in_main):
        return True
    if tag in _WHOLE:
        return False
    names = (x for name in ("class", "id", "role") for x in of.get(name, "").split())
    return any(not _NOISE.isdisjoint(words) and (_NOISE | _NEUTRAL).issuperset(words) for words in (re.findall(r"[^-_0-9]+", x) for x in names))


def _main(tag: str, of: dict[str, str]) -> bool:
    return tag in ("article", "main") or "main" in of.get("role", "").split() or "articlebody" in of.get("itemprop", "").split()


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Numbers(dict):
    """The number of a node: a hash of its parent's number, its tag and classes, and whether its role is declared."""

    def __missing__(self, key: tuple[int, str, str, bool]) -> int:
        if len(self) > REMEMBER:
            self.clear()
        above, tag, classes, declared = key
        name = ".".join([tag, *sorted(re.sub(r"\d+", "0", classes).split())])
        self[key] = out = _hash(f"{above} {name} {declared}")
        return out


_numbers = _Numbers()


class Tags:
    """What a page's markup consists of, in one pass: each `<` is looked at once, and what lies ahead without an end is remembered."""

    def __init__(self, page: str):
        self.page = page
        self.last, self.comments = page.rfind(">"), page.rfind("-->")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        # Marks places where attributes were read, outside of quotes, in tags that turned out to have no end.
        self.endless = bytearray()

    def at(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The next markup from a place on: its begin, its end, a slash for end tags, the tag (empty for comments and declarations), its attributes."""
        page = self.page
        while (at := page.find("<", at)) >= 0 and at < self.last:
            if page.startswith("<!--", at) and self.comments >= at + 4:
                return at, page.index("-->", at + 4) + 3, "", "", ""
            if page[at + 1] in "!?":
                return at, page.index(">", at + 2) + 1, "", "", ""
            if m := _NAME.match(page, at + 1):
                end = self._end(m.end())
                if end >= 0:
                    return at, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at += 1
        return None

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at a place; -1 if it doesn't. A value in quotes may hold anything."""
        page, passed = self.page, []
        while not self.endless[at : at + 1].strip(b"\0"):
            begin = at
            at, quoted = self._outside(at)
            passed.append((begin, at))
            if not quoted:
                if at < len(page):
                    return at
                break
            at = page.index(page[quoted], quoted + 1) + 1
        self.endless = self.endless or bytearray(len(page))
        for begin, end in passed:
            self.endless[begin:end] = b"\1" * (end - begin)
        return -1

    def _outside(self, at: int) -> tuple[int, int]:
        """The next `>` (or the page's end) or, if one comes first, the place where a quoted value begins, and the quote's place."""
        page = self.page
        while True:
            at = _NEITHER.match(page, at).end()
            if at == len(page) or page[at] == ">":
                return at, 0
            quote = _SPACE.match(page, at + 1).end()
            if quote < len(page) and page[quote] in self.quotes and self.quotes[page[quote]] > quote:
                return quote, quote
            at += 1


class Page:
    """A page read: blocks as (path, text, code points of it that are links), and of each node's path its children in order, elements and flags."""

    def __init__(self, page: str, gone: frozenset[int] = frozenset(), faded: frozenset[int] = frozenset()):
        """gone: nodes that are removed; faded: nodes removed but for what _KEPT elements below them hold."""
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.nodes: dict[tuple[int, ...], list] = {(ROOT,): [[], 1, 0]}
        # Of each open element: tag, path, whether it is dropped (2) or faded (1), inside a link, inside article or main.
        first = ("", (ROOT,), 0, False, False)
        self.stack, self.state = [first], first
        # The depths at which each tag, and any block element, is open.
        self.depths: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.parts: list[str] = []
        self.links, self.block = 0, (ROOT,)
        self._read(page, gone, faded)

    def _flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(raw.split())
            if text:
                self.blocks.append((self.block, text, min(len(text), self.links)))
            self.parts, self.links = [], 0

    def _close(self, depth: int) -> None:
        if self.open_blocks and self.open_blocks[-1] >= depth:
            self._flush()
        for tag, *_ in self.stack[depth:]:
            self.depths[tag].pop()
        del self.stack[depth:]
        while self.open_blocks and self.open_blocks[-1] >= depth:
            self.open_blocks.pop()
        self.state = self.stack[-1]

    def _depth(self, names) -> int:
        """The depth of the innermost open element of these names, 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _text(self, raw: str) -> None:
        if raw and not self.state[2]:
            if not self.parts:
                self.block = self.state[1]
            raw = entities.unescape(raw)
            self.parts.append(raw)
            if self.state[3]:
                self.links += len(raw)

    def _open(self, tag: str, raw: str, gone: frozenset[int], faded: frozenset[int]) -> None:
        of = _attributes(raw)
        _, path, dropped, link, in_main = self.state
        declared = _declared(tag, of, in_main)
        in_main |= _main(tag, of)
        if _unseen(tag, of):
            dropped = 2
        if tag in _BLOCK and dropped < 2 and len(path) < DEEPEST:
            node = _numbers[path[-1], tag, of.get("class", ""), declared]
            above = self.nodes[path]
            above[2] |= LAYOUT
            if not above[0] or above[0][-1] != node:
                above[0].append(node)
            flags = DECLARED * declared | BELOW * bool(declared or above[2] & BELOW) | KEPT * (tag in _KEPT) | END * _main(tag, of) | PLAIN * (tag in ("p", "h1")) | HEADING * (tag == "h1")
            path = (*path, node)
            at = self.nodes.setdefault(path, [[], 0, 0])
            at[1] += 1
            at[2] |= flags
            if node in gone:
                dropped = 2
            elif dropped == 1 and tag in _KEPT:
                dropped = 0
            elif node in faded:
                dropped = 1
        elif declared and tag not in _BLOCK:
            dropped = 2
        self.state = (tag, path, dropped, link or tag == "a", in_main)
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append(self.state)

    def _read(self, page: str, gone: frozenset[int], faded: frozenset[int]) -> None:
        at, tags = 0, Tags(page)
        while found := tags.at(at):
            begin, end, slash, tag, raw = found
            self._text(page[at:begin])
            at = end
            if not tag:
                continue
            if slash:
                if depth := self._depth((tag,)):
                    self._close(depth)
                continue
            if tag in _BLOCK:
                self._flush()
            if tag in _VOID:
                continue
            if tag in _RAW:
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = page.find(">", closing.end()) + 1 if closing else 0
                if not at:
                    at = len(page)
                    break
                continue
            if tag in _BLOCK and (depth := self._depth(("p",))) and depth == self.open_blocks[-1]:
                # A paragraph ends where another block begins, and so do its unclosed inline elements.
                self._close(depth)
            if tag in _CLOSES:
                names, bounds = _CLOSES[tag]
                if (depth := self._depth(names.split())) > self._depth(bounds):
                    self._close(depth)
            self._open(tag, raw, gone, faded)
        self._text(page[at:])
        self._flush()


def main_text(page: str, gone: frozenset[int] = frozenset(), faded: frozenset[int] = frozenset()) -> str:
    return " ".join(b[1] for b in Page(page, gone, faded).blocks)


def host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


_FEATURES = {"host": pa.string(), "path": pa.list_(pa.int64()), "is_style": pa.bool_(), "feature": pa.int64(), "elements": pa.int64(), "flags": pa.int64(), "chars": pa.int64(), "links": pa.int64()}


def style_features(pages: DataFrame) -> DataFrame:
    """A row for each node of a page (its children's order is the feature) and for each different block at a node (its text is)."""

    def rows_of(of: str, page: str) -> list[tuple]:
        read = Page(page)
        rows = [(of, list(p), True, _hash(" ".join(map(str, children))), n, flags, 0, 0) for p, (children, n, flags) in read.nodes.items()]
        found: dict[tuple, list[int]] = {}
        for path, text, links in read.blocks:
            at = found.setdefault((path, _hash(text)), [0, 0, 0])
            at[0], at[1], at[2] = at[0] + 1, at[1] + len(text), at[2] + links
        return rows + [(of, list(p), False, h, n, read.nodes[p][2], chars, links) for (p, h), (n, chars, links) in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [r for of, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows_of(of, page or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FEATURES.values())], names=list(_FEATURES))

    ship(pages.sparkSession)
    return pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path array<long>, is_style boolean, feature long, elements long, flags long, chars long, links long")


def _has(flag: int, of: str = "flags") -> Column:
    return F.col(of).bitwiseAND(flag) != 0


def tree(features: DataFrame) -> DataFrame:
    """host, path and flags of each node of the hosts' trees, with pages, elements, composite importance and information (info)."""
    counts = features.groupBy("host", "path", "is_style", "feature").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("elements", "chars", "links")], F.bit_or("flags").alias("flags"))
    counts = save(counts, "style-counts")
    styles = counts.where("is_style").groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum("elements").alias("elements"), F.bit_or("flags").alias("flags"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"), F.count("*").alias("styles"))
    styles = save(styles, "style-nodes")
    log = F.ln(F.greatest(F.col("pages"), F.lit(2)))
    own = F.when(F.col("pages") <= 1, 1.0).otherwise((log - F.col("nlogn") / F.col("pages")) / log)
    # A block on n of m pages has entropy log n / log m over them: 1 where it is on all, 0 where it is on one.
    leaf = F.when(F.col("pages") <= 1, 1.0).otherwise(1.0 - F.least(F.lit(1.0), F.ln("n") / log))
    plain = F.col("chars") - F.col("links")
    # What counts of a block is on how many pages it is, so blocks are summed by that before they meet their node.
    alike = counts.where("NOT is_style").groupBy("host", "path", "n").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.bit_or("flags").alias("flags"))
    at = alike.join(styles.select("host", "path", "pages"), ["host", "path"])
    info = plain * (FLOOR + (1 - FLOOR) * leaf) * F.when(_has(BELOW), PRIOR[0]).otherwise(1.0)
    leaves = at.groupBy("host", "path").agg(F.sum(plain * leaf).alias("worth"), F.sum(info).alias("info"), F.sum("chars").alias("chars"), F.bit_or("flags").alias("flags"))
    # A node's content is that of all blocks at or below it.
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))
    sums = leaves.select("host", F.explode(above).alias("path"), "worth", "info", "chars", _has(HEADING).alias("heading"))
    content = sums.groupBy("host", "path").agg(F.sum("worth").alias("worth"), F.sum("info").alias("info"), F.sum("chars").alias("chars"), F.max("heading").alias("heading"))
    of = F.coalesce(F.col("worth") / F.col("chars"), F.lit(0.0))
    weight = F.pow(F.lit(DAMPING), F.col("styles"))
    return styles.join(content, ["host", "path"], "left").select(
        "host", "path", "pages", "elements", "flags", of.alias("content"), F.greatest(of, (1 - weight) * own + weight * of).alias("composite"), F.coalesce("info", F.lit(0.0)).alias("info"), F.coalesce("heading", F.lit(False)).alias("heading")
    )


def ways(nodes: DataFrame) -> DataFrame:
    """host, path and info of a page, for each node on the way from the root to the main text."""
    up = F.slice("path", 1, F.size("path") - 1)
    above = nodes.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("info").alias("_info"), _has(END).alias("_end"))
    inner = nodes.where(F.size("path") > 1).join(above, (F.col("host") == F.col("_h")) & (up == F.col("_p")))
    leads = inner.where((F.col("info") > LEADS * F.col("_info")) & ~F.col("_end") & _has(LAYOUT) & (F.col("elements") <= SINGLE * F.col("pages")))
    good = save(nodes.where(F.size("path") == 1).select("host", "path", "info", "pages").unionByName(leads.select("host", "path", "info", "pages")), "style-leads")
    # On the way is a node all of whose ancestors lead on as well.
    steps = good.select("host", F.col("path").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path"))
    whole = steps.join(good.select("host", "path"), ["host", "path"]).groupBy("host", F.col("of").alias("path")).agg(F.count("*").alias("steps")).where(F.col("steps") == F.size("path"))
    return good.join(whole.select("host", "path"), ["host", "path"]).select("host", "path", (F.col("info") / F.col("pages")).alias("each"))


def importances(features: DataFrame, prior: tuple[float, float] | None = PRIOR, inside: float = INSIDE) -> DataFrame:
    """The nodes of the trees with where they stand (way, beside or inside) and their importance."""
    nodes = save(tree(features), "style-tree")
    way = save(ways(nodes), "style-way")
    ends = way.groupBy("host").agg(F.max_by("path", F.size("path")).alias("end"))
    known = nodes.where(F.size("path") == 1).select(F.col("host").alias("_h"), F.col("pages").alias("known"))
    known = ends.join(known, F.col("host") == F.col("_h")).drop("_h")
    level = way.select("host", F.size("path").alias("level"), "each")
    placed = nodes.withColumn("level", F.size("path")).join(known, "host").join(level, ["host", "level"], "left")
    on_way = F.slice("end", 1, F.col("level")) == F.col("path")
    beside = (F.col("level") <= F.size("end")) & (F.slice("end", 1, F.col("level") - 1) == F.slice("path", 1, F.col("level") - 1))
    within = F.slice("path", 1, F.size("end")) == F.col("end")
    place = F.when(on_way, "way").when(F.when(F.col("level") > 1, beside), "beside").when(within, "inside").otherwise("below")
    reach = F.when(F.col("each") > 0, F.least(F.lit(1.0), F.col("info") / F.col("pages") / F.col("each"))).otherwise(1.0)
    low, high = prior or (1.0, 1.0)
    fades = F.least(F.lit(1.0), (F.col("known") - 1) / F.lit(float(KNOWN - 1)))
    weight = F.when(~_has(DECLARED), 1.0).when(F.col("place") == "beside", low + (high - low) * fades).otherwise(inside)
    placed = placed.withColumn("place", place)
    importance = F.when(F.col("place") == "beside", F.col("composite") * reach).otherwise(F.col("composite")) * weight
    return placed.select("host", "path", "pages", "flags", "place", "heading", "content", importance.alias("importance"))


def removed(found: DataFrame, least: float = LEAST, at_least: int = PAGES) -> DataFrame:
    """host, node and faded (whether what _KEPT elements hold below it stays) of each branch that goes."""
    low = found.where(F.col("importance") < least)
    plain = ~_has(DECLARED) & (_has(PLAIN) | F.col("heading") & (F.col("content") >= least))
    gone = (F.col("place") == "beside") & ~plain | (F.col("place") == "inside") & _has(DECLARED)
    faded = (F.col("place") == "inside") & ~_has(KEPT) & (F.col("pages") >= at_least)
    return low.where(gone | faded).select("host", F.element_at("path", -1).alias("node"), (~gone).alias("faded"))


def extract(pages: DataFrame, least: float = LEAST, at_least: int = PAGES, prior: tuple[float, float] | None = PRIOR, inside: float = INSIDE) -> DataFrame:
    """page_id, url, text and n_chars: the main text of each page. prior None: names have no weight beside the main text; least 0: nothing is removed."""
    low = save(removed(importances(style_features(pages), prior, inside), least, at_least), "style-low")
    rows = pages.select("page_id", "url", "html", host().alias("_host"))
    ids = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = []
            for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                low = low or ()
                texts.append(main_text(page or "", frozenset(x["node"] for x in low if not x["faded"]), frozenset(x["node"] for x in low if x["faded"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    each = F.collect_list(F.struct("node", "faded")).alias("low")
    if low.count() <= FEW:
        joined = rows.join(F.broadcast(low.groupBy(F.col("host").alias("_h")).agg(each)), F.col("_host") == F.col("_h"), "left")
    else:
        joined = _by_page(rows, low, each)
    return joined.select("page_id", "url", "html", "low").mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")


def _by_page(rows: DataFrame, low: DataFrame, each: Column) -> DataFrame:
    """rows with those removed branches that they hold: looked up by (host, node), so no host's branches meet in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [(k, of, n) for k, of, page in zip(*(c.to_pylist() for c in batch.columns)) for n in {p[-1] for p in Page(page or "").nodes}]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64()))], names=["_k", "host", "node"])

    # Pages with the same host and html hold the same branches.
    keyed = rows.withColumn("_key", F.xxhash64("_host", "html"))
    held = keyed.select("_key", "_host", "html").mapInArrow(run, "_k long, host string, node long").distinct()
    lists = held.join(low, ["host", "node"]).groupBy("_k").agg(each)
    return keyed.join(lists, F.col("_key") == F.col("_k"), "left")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
