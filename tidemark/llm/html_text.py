"""Main text of web pages (operator 7): a site style tree of each host and entropy-based importance.

An element node of the tree is a path of elements with their classes. Its presentation nodes are the
sequences of children that pages show there, its content nodes the texts. Both have an importance by
entropy over the host's pages, an element's composite importance is the discounted mean over its branch,
and a branch all of whose elements are unimportant is removed, wherever it lies.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, table

#: An element below this composite importance is unimportant.
IMPORTANCE = 0.5
#: A branch that markup leaves in doubt is kept from this importance on.
IMPORTANT = 0.9
#: Pages that full importance counts as before any is seen: few pages of a host prove little.
PRIOR_PAGES = 4
#: Weight of an element's descendants against itself, per level; descendants this many levels down and
#: more, of a weight below 0.002, are left out.
DISCOUNT, LEVELS = 0.9, 64
#: What markup says ahead of the tree: no main text; main text unless unimportant; none unless important.
NOISE, KEEP, DOUBT = 0, 1, 2
#: Up to so many pages with branches that the tree decides are broadcast to the pages, more are joined by shuffle.
PAGES_BROADCAST = 50_000

# Elements of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
SILENT = set("head title script style noscript template iframe object canvas svg textarea select button audio video map datalist".split())
RAW = set("script style title textarea noscript iframe template".split())
# Names of elements, roles and classes that say that a branch is no main text.
NOISE_TAGS = set("nav header footer aside form dialog menu fieldset".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login form search share sharing social related recommended "
    "comment comments commentlist disqus reply replies pagination pager copyright legal hidden".split()
)
HEADINGS = {"header", "masthead", "banner"}
MAIN_TAGS = {"article", "main"}
CLOSES_HEAD = set("body p div article main section header nav footer aside h1 h2 h3 h4 h5 h6 ul ol dl table form figure blockquote pre hr img a span center".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+")


@dataclass
class Element:
    """An element node of a page: ``number`` is the page's own, ``above`` its parent's."""

    path: int
    above: int
    children: list[int]


@dataclass
class Block:
    path: int  # number of the element node
    text: str
    named_noise: bool
    in_main: bool
    doubt: bool  # a part of a class or id is a noise name
    below_noise: bool  # in a main element below a wrapper with a noise name, tag or role


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks of a page in order, and its element nodes: siblings of one label are one node, whose
    children are those of all of them in order."""
    out: list[Block] = []
    elements = [Element(_hash(""), -1, [])]
    number: dict[tuple[int, str], int] = {}
    # tag, element, noise by name, noise by tag or role, main, silent, doubt, below noise
    stack: list[tuple[str, int, bool, bool, bool, bool, bool, bool]] = [("", 0, False, False, False, False, False, False)]
    open_tags: dict[str, int] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                _, element, named, noise, main, _, doubt, below = stack[-1]
                out.append(Block(element, line, named or noise, main, doubt, below))

    def cut(k: int) -> None:
        for tag, *_ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    def close(names: set[str], until: set[str] = frozenset()) -> None:
        if not any(open_tags.get(name) for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                cut(k)
                return
            if stack[k][0] in until:
                return

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if not stack[-1][5]:
            text.append(page[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "br":
            text.append(" " if tag else "")
            continue
        if tag in CLOSES_HEAD and not m[1] and open_tags.get("head"):
            close({"head"})
        if tag in INLINE:
            continue
        if m[1]:
            if tag == "p" and not open_tags.get("p"):
                flush()
            close({tag})
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if tag in CLOSES_P:
            close({"p"}, {"article", "section", "div", "td", "th", "li", "body"})
        if tag in SAME_CLOSES:
            close(SAME_CLOSES[tag], {"ul", "ol", "dl", "table", "menu", "select"})
        _, above, named, was_noise, was_main, silent, doubt, below = stack[-1]
        # an article's own header holds its title
        names, noise, label = set(), tag in NOISE_TAGS and not (tag == "header" and was_main), tag
        for a in _ATTRIBUTE.finditer(m[3]) if m[3] else ():
            name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if name in ("class", "id"):
                names.update(value.split())
                label += ("." if name == "class" else "#") + " ".join(sorted(value.split()))
            noise |= name == "role" and value in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
        main = was_main or tag in MAIN_TAGS
        if tag not in ("html", "body", *MAIN_TAGS):
            if was_main:
                names -= HEADINGS  # an article's own heading, like its header element
            named |= bool(names & NOISE_NAMES)
            doubt |= any(part in NOISE_NAMES for name in names for part in _NAME.findall(name))
        elif main and not was_main:
            # a wrapper above a main element, such as a form around the whole page, leaves it in doubt alone
            named, was_noise, doubt, below = False, False, False, named or doubt or was_noise
        own = number.get((above, label))
        if own is None:
            own = number[above, label] = len(elements)
            elements.append(Element(_hash(str(elements[above].path), label), above, []))
        elements[above].children.append(own)
        stack.append((tag, own, named, was_noise or noise, main, silent or tag in SILENT, doubt, below))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            close_at = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close_at.end() if close_at else end
            cut(len(stack) - 1)
    flush()
    return out, elements


def blocks(page: str) -> list[Block]:
    return parsed(page)[0]


def priors(found: list[Block]) -> list[int]:
    """What markup says of each block of a page. A main element below a wrapper that is noise by name, tag
    or role is one only if the page has no other."""
    mains = [b for b in found if b.in_main and not b.named_noise]
    other = any(not b.below_noise for b in mains)
    noise = lambda b: b.named_noise or b.below_noise and other
    return [NOISE if noise(b) else DOUBT if b.doubt or mains and not b.in_main else KEEP for b in found]


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _hash(*parts: str) -> int:
    raw = "\0".join(parts).encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) | zlib.crc32(raw[::-1]) << 31


def style_nodes(pages: DataFrame) -> DataFrame:
    """Every page's nodes of its host's tree: a content node per text and a presentation node per element,
    with what markup says of a content. ``article`` names the page's longest text: pages that share it are
    copies of one article and tell the template once. ``above`` lists the element and those above it,
    nearest first; a task gives it once for each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[str, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            for url, raw, digest in zip(*(c.to_pylist() for c in batch.columns)):
                found, elements = parsed(raw or "")
                site, holding = host(url), {b.path for b in found}
                article = _hash(max((b.text for b in found), key=lambda x: (len(x), x), default=""))
                used = set()
                for b in found:
                    k = b.path
                    while k not in used and k >= 0:
                        used.add(k)
                        k = elements[k].above
                rows += [(site, elements[b.path].path, _hash(b.text), digest, article, prior, None) for b, prior in dict(zip(((b.path, b.text) for b in found), zip(found, priors(found)))).values()]
                for k in sorted(used):
                    path, above = elements[k].path, None
                    if (site, path) not in told:
                        if len(told) >= 1_000_000:
                            told.clear()
                        told.add((site, path))
                        above, up = [], k
                        while up >= 0 and len(above) < LEVELS:
                            above.append(elements[up].path)
                            up = elements[up].above
                    shown = [c for c in elements[k].children if c in used]
                    style = _hash(*(str(elements[c].path) for c in shown)) if shown else None if k in holding else 0
                    rows.append((site, path, style, digest, article, None, above))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "node", "digest", "article", "prior", "above"])

    return pages.select("url", "html", "digest").mapInArrow(run, "host string, path bigint, node bigint, digest bigint, article bigint, prior int, above array<bigint>")


def importances(nodes: DataFrame) -> DataFrame:
    """(host, path, above, pages, weight, importance) of each element by itself.

    A content on c of the m distinct pages that have its element is spread evenly over them: entropy
    log_m c, importance 1 - log_m c; an element's is the mean over its contents, weighted by pages. Of
    presentations, the entropy to base m of their shares of pages. Pages are distinct articles. PRIOR_PAGES pages of full importance
    are added. Sums are taken before any join, so a path that all pages share is no single task."""
    content = F.col("prior").isNotNull()
    counts = nodes.select("host", "path", "node", content.alias("content"), "article").distinct().groupBy("host", "path", "node", "content").agg(F.count(F.lit(1)).alias("c"))
    spread = F.col("c") * F.log("c")
    some = F.col("node").isNotNull() & ~F.col("content")
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("content"), F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("content"), F.col("c"))).alias("shown"), F.sum(F.when(F.col("content"), spread)).alias("content_spread"),
        F.sum(F.when(some, F.col("c"))).alias("styled"), F.sum(F.when(some, spread)).alias("style_spread"),
    )
    log_m = F.greatest(F.log("pages"), F.lit(1e-9))
    content_part = F.coalesce(F.col("shown") - F.when(F.col("pages") > 1, F.col("content_spread") / log_m).otherwise(0.0), F.lit(0.0))
    style_part = F.coalesce(F.when(F.col("pages") > 1, (F.col("styled") * F.log("styled") - F.col("style_spread")) / log_m).otherwise(F.col("styled")), F.lit(0.0))
    weight = F.coalesce("shown", F.lit(0)) + F.coalesce("styled", F.lit(0))
    raw = (content_part + style_part) / weight
    paths = nodes.where("above is not null").groupBy("host", "path").agg(F.first("above").alias("above"))
    out = sums.withColumns({"weight": weight, "importance": (raw * F.col("pages") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)})
    return out.where("weight > 0").select("host", "path", "pages", "weight", "importance").join(paths, ["host", "path"])


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, composite, greatest): the composite importance of each element, a mean over its
    branch weighted by pages and DISCOUNT for each level, and the greatest in the branch."""
    own = materialize(importances(nodes), "importance")
    down = own.select("host", "path", "weight", "importance", F.posexplode("above").alias("levels", "element"))
    share = F.col("weight") * F.pow(F.lit(DISCOUNT), F.col("levels"))
    composite = down.groupBy("host", F.col("element").alias("path")).agg((F.sum(share * F.col("importance")) / F.sum(share)).alias("composite"))
    whole = materialize(own.select("host", "path", "above", "pages").join(composite, ["host", "path"]), "composite")
    best = whole.select("host", F.explode("above").alias("path"), "composite").groupBy("host", "path").agg(F.max("composite").alias("greatest"))
    return whole.drop("above").join(best, ["host", "path"])


def decided(tree: DataFrame, threshold: float = IMPORTANCE, important: float = IMPORTANT) -> DataFrame:
    """(host, path, prior) where the tree decides against the prior: KEEP in a branch whose elements are
    all below the threshold, DOUBT that is important."""
    against = F.when(F.col("greatest") < threshold, KEEP).when(F.col("composite") >= important, DOUBT)
    return tree.select("host", "path", against.alias("prior")).where("prior is not null")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page's whole html.

    Blocks are runs of text between block-level tags; character references are decoded, white space
    becomes one space, and blocks are joined by line breaks in page order. All elements with text are
    in the host's style tree, and any unimportant branch is removed, in a main element too. Markup that
    names a role (nav, footer, class "ad", ...) is a prior that importance does not outweigh, since
    adverts and comments differ from page to page. On a page with a main element, blocks outside it,
    and those with a noise name as a part of a class ("ad-slot"), stay only if important.

    Null and empty html gives an empty text. A null url belongs to the host ''. Pages with equal html and
    url have equal texts and count once in the tree, those with a null page_id too; every row gives a
    row; an empty table gives no rows; pages of any length or depth are read whole; other columns
    are not read, so they cannot clash."""
    source = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    source = source.withColumn("digest", F.xxhash64("url", "html"))
    nodes = materialize(style_nodes(source), "style-nodes")
    tree = materialize(style_tree(nodes), "tree")
    against = decided(tree)
    turns = nodes.where("prior is not null").select("host", "path", "prior", "digest").distinct().join(against, ["host", "path", "prior"], "left_semi")
    # A page's own list of branches is no longer than the page. Spark splits a skewed host.
    turns = materialize(turns.groupBy("digest").agg(F.collect_set(F.struct("path", "prior")).alias("against")), "branches")
    discard(nodes, tree)
    few = len(turns.select(F.lit(1)).take(PAGES_BROADCAST + 1)) <= PAGES_BROADCAST
    joined = source.join(F.broadcast(turns) if few else turns, "digest", "left").select("page_id", "url", "html", "against")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, against in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found, elements = parsed(raw or "")
                turned = {(d["path"], d["prior"]) for d in against or ()}
                kept = [b for b, prior in zip(found, priors(found)) if prior != NOISE and (prior == KEEP) != ((elements[b.path].path, prior) in turned)]
                texts.append("\n".join(b.text for b in kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
