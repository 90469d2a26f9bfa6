"""Operator 11: main text of web pages, by site style trees.

Each page is read into its tree of blocks (inline marks are part of their block's text), without
what a tag or a name says is no article: comments of the markup, scripts, styles, hidden
elements, menus, headers, footers, sidebars, notices, adverts, forms, reader comments (DROPPED,
NAMES).  If the page has `article` or `main` elements with text, the outermost of them are the page;
else it is the body.  A form that holds such an element is kept.

The trees of one host are merged into a style tree, those of pages with and without articles apart.  An element's key is a hash of the host and of the
way to it: the sequences of tags and classes of the children, from the root down.
In a sequence, neighbours of one kind count as one; the first, the last and the others have a key each.

1. Pages are counted by tree, and by element and style (the sequence of its children).
2. A leaf's text is cut into at most RUNS runs of words; runs are counted by leaf, with the sum of
   n log n over pages, from which comes a run's entropy over the pages.
3. With M pages in a tree, a leaf's importance is 1 - (mean entropy of its runs, as often as they occur) / log M; an element's
   presentation has 1 - (mean log of the number of pages that share a style) / log M, so
   what one page has alone is 1, what all have alike is 0, and two copies on a large host lose little.
   An element with l styles has (1 - DECAY^l) of its presentation's importance and DECAY^l of
   its children's mean, level by level from the deepest (at most LEVELS rounds).
4. A branch in which no node reaches LOW goes from every page; inside `article` or `main`, copies of
   one article may be many, and the bar is lower: half of the tree's pages must have it.
   A page that would lose all its text this way loses none.

Fewer than LEAST_PAGES pages, and urls without a host, have no style tree.  Keys of low branches are few
(templates, not pages): up to BROADCAST_KEYS of them go to every task; beyond, pages and keys are joined.

Character references are decoded; white space (as Unicode has it) inside a block becomes one space, blocks
are trimmed and joined by one newline; `br` is white space.  Unclosed elements end with their parents, unclosed
comments and scripts with the page.  Elements below LEVELS belong to the block structure, but not to the style tree: their text is
text of the element above.  Null html is empty; null ids and urls stay; repeated rows each have a row and count as pages.
Texts of any length are read whole.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import sliced, table
from cartoweave.plans.components import ensure_checkpoint_dir

RUNS, DECAY, LOW, LEAST_PAGES, LEVELS = 4, 0.9, 0.2, 5, 64
BROADCAST_KEYS = 1_000_000

# Element names of HTML, and words of class names, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("applet aside audio button canvas datalist dialog footer map menu nav noscript object select svg template video".split())
NAMES = frozenset(
    """ad ads adsense advert advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo
    cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification
    overlay pager pagination popup promo promotion reactions recommendations recommended related replies respond search share sharing sidebar
    signup social sponsor sponsored subscribe subscription toolbar topbar widget""".split()
)
#: Words that make a class name speak of something else: has-sidebar, no-ads.
NEGATED = frozenset("has have no not with without".split())
#: What an opening tag ends, if it is open not far above.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {f"h{i}": tuple(f"h{j}" for j in range(1, 7)) for i in range(1, 7)}
NEAR = 8

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}


class Block:
    """An element of a page: its tag with its classes, and its texts and blocks in page order."""

    __slots__ = ("label", "kids", "above", "form", "article", "depth")

    def __init__(self, label: str, above: Block | None, form: bool = False, article: bool = False):
        self.label, self.kids, self.above, self.form, self.article = label, [], above, form, article
        self.depth = above.depth + 1 if above else 0


def _reads(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Of an opening tag: is it dropped with all in it, does it hold the article, and its label."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next(filter(None, values), ""))
    classes = found.get("class", "").split()
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    gone = tag in DROPPED or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    if not gone and tag not in ("html", "body"):
        for name in (*classes, found.get("id", ""), role):
            words = {w.lower() for w in _NAME.findall(name)}
            if not words.isdisjoint(NAMES if inside else NAMES | {"header"}) and words.isdisjoint(NEGATED):
                gone = True
    article = tag in ("article", "main") or role in ("article", "main") or found.get("itemprop", "") == "articleBody"
    return gone or (tag == "header" and not inside), article and not gone, ".".join([tag, *sorted("".join(_NAME.findall(c)) for c in classes)])


def blocks_of(text: str) -> list[Block]:
    """The page's blocks, parents first; the first is the whole page."""
    root = Block("", None)
    every, stack, opened = [root], [("", root, False, False)], Counter()  # tag, block it writes to, dropped, is a block
    said, dropped, inside, at, quotes = [], 0, 0, 0, True

    def flush():
        if said:
            words = " ".join(html.unescape("".join(said)).split())
            said.clear()
            if words:
                stack[-1][1].kids.append(words)

    def close():
        nonlocal dropped, inside
        tag, block, gone, is_block = stack[-1]
        if is_block and not dropped:
            flush()
        stack.pop()
        opened[tag] -= 1
        dropped -= gone
        inside -= block.article and is_block and block is not stack[-1][1]

    while at < len(text):
        to = text.find("<", at)
        if to != at:
            if not dropped:
                said.append(text[at:] if to < 0 else text[at:to])
            if to < 0:
                break
        if text.startswith("<!--", to):
            end = text.find("-->", to + 2)
            at = len(text) if end < 0 else end + 3
            continue
        m = _TAG.match(text, to) if quotes else None
        if m is None and text[to + 1 : to + 3].lstrip("/")[:1].isalpha():
            quotes = False  # a quote of this page is never closed
            m = _PLAIN_TAG.match(text, to)
            if m is None:
                break  # an unclosed tag ends with the page
        if m is None:
            if text[to + 1 : to + 2] in ("!", "?", "/"):
                end = text.find(">", to)
                at = len(text) if end < 0 else end + 1
            else:
                if not dropped:
                    said.append("<")
                at = to + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    close()
                close()
            elif tag not in INLINE and not dropped:
                flush()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(text, at)
            if end is None:
                break
            at = text.find(">", end.start()) + 1 or len(text)
            continue
        if tag in VOID:
            if not dropped:
                said.append(" ")
                if tag == "hr":
                    flush()
            continue
        if dropped or not (m[3] or tag in DROPPED or tag in ("article", "main", "header")):
            gone, article, label = False, False, tag
        else:
            gone, article, label = _reads(tag, m[3], inside > 0)
        is_block = tag not in INLINE
        if not is_block and not gone:
            continue
        if m[3].endswith("/") and tag not in DROPPED and not is_block:
            continue
        if is_block:
            if opened["p"] > 0 and stack[-1][0] == "p":
                close()
            for back in range(1, min(NEAR, len(stack))) if any(opened[t] > 0 for t in ENDS.get(tag, ())) else ():
                if stack[-back][0] in ENDS[tag]:
                    for _ in range(back):
                        close()
                    break
                if stack[-back][0] in ("ul", "ol", "dl", "table", "select"):
                    break
            if not dropped:
                flush()
        block = stack[-1][1]
        if is_block and not gone and not dropped and block.depth < LEVELS:
            block = Block(label, block, tag == "form", article)
            block.above.kids.append(block)
            every.append(block)
            inside += article
        elif is_block:
            block = stack[-1][1]
        stack.append((tag, block, gone, is_block))
        opened[tag] += 1
        dropped += gone
    if not dropped:
        flush()
    return every


def read_page(text: str | None) -> tuple[bool, list]:
    """Is the page its articles, and what it consists of: texts and blocks, without empty ones and forms."""
    every = blocks_of(text or "")
    full, holds = set(), set()
    for b in reversed(every):  # children before parents
        b.kids = [k for k in b.kids if isinstance(k, str) or (id(k) in full and (not k.form or id(k) in holds))]
        if b.kids:
            full.add(id(b))
            if b.article or any(id(k) in holds for k in b.kids if isinstance(k, Block)):
                holds.add(id(b))
    if id(every[0]) not in holds:
        return False, every[0].kids
    tops, stack = [], [every[0]]
    while stack:
        b = stack.pop()
        if b.article:
            tops.append(b)
        else:
            stack.extend(k for k in reversed(b.kids) if isinstance(k, Block) and id(k) in holds)
    return True, tops


def _key(*parts) -> int:
    """A signed 64-bit key."""
    return int(np.uint64(xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))).astype(np.int64))


def walk(host: str, inside: bool, kids: list, low=frozenset()):
    """(element, style above it, depth, its style or 0 for a leaf, texts of a leaf), in page order; branches whose element is in `low` are left out."""
    stack = [(_key(host, inside), 0, 0, kids)] if kids else []
    while stack:
        element, above, depth, kids = stack.pop()
        if element in low:
            continue
        if all(isinstance(k, str) for k in kids):
            yield element, above, depth, 0, kids
            continue
        labels = ["#" if isinstance(k, str) else k.label for k in kids]
        runs = [0]
        for a, b in zip(labels, labels[1:], strict=False):
            runs.append(runs[-1] + (a != b))
        style = _key(element, *(x for i, x in enumerate(labels) if not i or runs[i] != runs[i - 1]))
        yield element, above, depth, style, None
        keys, below = {}, []
        for i, k in enumerate(kids):
            place = "first" if not i or runs[i] != runs[i - 1] else "last" if i + 1 == len(kids) or runs[i] != runs[i + 1] else "other"
            name = (runs[i], place)
            if name not in keys:
                keys[name] = _key(style, *name)
            below.append((keys[name], style, depth + 1, [k] if isinstance(k, str) else k.kids))
        stack.extend(reversed(below))


def runs_of(texts: list[str]) -> list[str]:
    """A leaf's words in at most RUNS runs for each text."""
    out = []
    for t in texts:
        words = t.split(" ")
        size = -(-len(words) // RUNS)
        out += [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
    return out


_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


def _rows(batches):
    """(host, is the page its articles, what it consists of) of each page that has a host."""
    for b in sliced(batches):
        for url, text in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            if host := host_of(url):
                yield host, *read_page(text)


def _batches(rows, schema: pa.Schema, size: int = 1 << 15):
    """Tuples as record batches."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def styles(pages: DataFrame) -> DataFrame:
    """host, element, above, depth, inside, style, n: on how many pages each element has each style.  Depth -1 counts the tree's pages; `host` is its key."""
    schema = pa.schema([(c, pa.int64()) for c in ("host", "element", "above", "depth")] + [("inside", pa.bool_()), ("style", pa.int64())])

    def run(batches):
        def rows():
            for host, inside, kids in _rows(batches):
                own = _key(host, inside)
                yield own, own, 0, -1, False, 0
                for element, above, depth, style in dict.fromkeys(x[:4] for x in walk(host, inside, kids)):
                    yield own, element, above, depth, inside, style

        return _batches(rows(), schema)

    return pages.select("url", "html").mapInArrow(run, "host long, element long, above long, depth long, inside boolean, style long").groupBy("host", "element", "above", "depth", "inside", "style").agg(F.count("*").alias("n"))


def leaf_entropies(pages: DataFrame) -> DataFrame:
    """element, entropy: the mean, over a leaf's runs of words as often as they occur, of the entropy of a run's pages."""
    schema = pa.schema([("element", pa.int64()), ("run", pa.int64()), ("n", pa.int64()), ("w", pa.float64())])

    def run(batches):
        def rows():
            for host, inside, kids in _rows(batches):
                found = Counter()
                for element, *_, texts in walk(host, inside, kids):
                    if texts:
                        for r in runs_of(texts):
                            found[element, _key(r)] += 1
                for (element, r), n in found.items():
                    yield element, r, n, n * log(n)

        return _batches(rows(), schema)

    runs = pages.select("url", "html").mapInArrow(run, "element long, run long, n long, w double").groupBy("element", "run").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    return runs.groupBy("element").agg((F.sum(F.col("n") * F.log("n") - F.col("w")) / F.sum("n")).alias("entropy"))


def importance(pages: DataFrame) -> DataFrame:
    """element, inside, pages, comp, most: composite importance of the elements that more than one page has, and the most in their branch."""
    ensure_checkpoint_dir(pages.sparkSession)
    counted = styles(pages).checkpoint()
    hosts = counted.where(f"depth = -1 AND n >= {LEAST_PAGES}").select("host", F.col("n").alias("pages"))
    nodes = counted.where("depth >= 0").groupBy("host", "element", "above", "depth", "inside").agg(F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("w"))
    # what one page has alone has importance 1, and all in it too
    nodes = nodes.where("m > 1").join(hosts, "host").join(leaf_entropies(pages), "element", "left")
    nodes = nodes.withColumn("own", 1 - F.col("w") / F.col("m") / F.log("pages")).withColumn("leaf", 1 - F.col("entropy") / F.log("pages")).drop("w", "entropy").checkpoint()
    shared = counted.where("depth >= 0 AND n > 1").select("element", "style", "n")
    deepest = nodes.agg(F.max("depth")).first()[0]
    done = None
    level = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        # styles of one page are not in `shared`: their children have importance 1
        of_style = here.select("element", "leaf", "m").join(shared, "element")
        if level is None:
            of_style = of_style.withColumn("below", F.lit(None).cast("double")).withColumn("top", F.lit(None).cast("double"))
        else:
            below = level.groupBy(F.col("above").alias("style")).agg((F.sum(F.col("m") * F.col("comp")) / F.sum("m")).alias("below"), F.max("most").alias("top"))
            of_style = of_style.join(below, "style", "left")
        value, top = (F.when(F.col("style") == 0, F.coalesce("leaf", F.lit(1.0))).otherwise(F.coalesce(c, F.lit(1.0))) for c in ("below", "top"))
        seen = of_style.groupBy("element").agg(F.sum(F.col("n") * value).alias("v"), F.sum("n").alias("shared"), F.max(top).alias("top"))
        share = F.pow(F.lit(DECAY), F.col("l"))
        comp = (1 - share) * F.col("own") + share * (F.coalesce("v", F.lit(0.0)) + F.col("m") - F.coalesce("shared", F.lit(0))) / F.col("m")
        level = here.join(seen, "element", "left").withColumn("comp", comp)
        # a leaf has no presentation of its own
        level = level.withColumn("comp", F.when((F.col("l") == 1) & F.col("leaf").isNotNull(), F.col("leaf")).otherwise(F.col("comp")))
        most = F.greatest("comp", F.when(F.coalesce("shared", F.lit(0)) < F.col("m"), F.lit(1.0)).otherwise(F.coalesce("top", F.lit(0.0))))
        level = level.withColumn("most", most).select("element", "above", "inside", "pages", "m", "comp", "most").checkpoint()
        done = level if done is None else done.unionByName(level)
    if done is None:
        return nodes.select("element", "inside", "pages", F.col("own").alias("comp"), F.col("own").alias("most"))
    return done.select("element", "inside", "pages", "comp", "most")


def low_branches(pages: DataFrame) -> DataFrame:
    """element: keys of the branches of no importance, of all hosts."""
    half = F.log(F.lit(2.0)) / F.log("pages")
    bar = F.when(F.col("inside"), F.least(F.lit(LOW), half)).otherwise(F.lit(LOW))
    return importance(pages).where(F.col("most") < bar).select("element")


def main_text(url: str | None, text: str | None, low) -> str:
    """The texts of a page, but for low branches, unless that were all."""
    inside, kids = read_page(text)
    host = host_of(url)
    for skip in (low, frozenset()) if host and low else (frozenset(),):
        out = "\n".join(t for *_, texts in walk(host or "", inside, kids, skip) for t in texts or ())
        if out:
            break
    return out


def _extracted(pages: DataFrame, low_of) -> DataFrame:
    """page_id, url, text, n_chars; low_of gives the low keys of a batch's rows."""

    def run(batches):
        for b in sliced(batches):
            texts = [main_text(*x) for x in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), low_of(b), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract(pages: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    low = low_branches(pages).checkpoint()
    if low.limit(broadcast_keys + 1).count() <= broadcast_keys:
        keys = frozenset(r[0] for r in low.collect())  # broadcast_keys at most
        return _extracted(pages, lambda b: [keys] * b.num_rows)
    # equal rows have one id, and the same low keys
    pages = pages.withColumn("row", F.xxhash64("page_id", "url", "html"))
    schema = pa.schema([("row", pa.int64()), ("element", pa.int64())])

    def run(batches):
        def rows():
            for b in sliced(batches):
                for row, url, text in zip(*(b.column(c).to_pylist() for c in ("row", "url", "html")), strict=True):
                    if host := host_of(url):
                        yield from ((row, e) for e in {x[0] for x in walk(host, *read_page(text))})

        return _batches(rows(), schema)

    has = pages.select("row", "url", "html").mapInArrow(run, "row long, element long").join(low, "element").groupBy("row").agg(F.collect_set("element").alias("low"))
    return _extracted(pages.join(has, "row", "left"), lambda b: [frozenset(x or ()) for x in b.column("low").to_pylist()])


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
