"""HTML extraction (operator 12): site templates found by hashing element subtrees and counting them per host.

Each page is parsed by a scanner and an explicit stack (:func:`elements`). Every element gets a hash of its tag, its text and
its children's hashes. Pass one hands Spark one row for each distinct subtree of a page, and Spark counts, per host and
subtree, the different pages that hold it: copies of one page count once. A subtree on ``MIN_PAGES`` pages or more and on
``MIN_SHARE`` of the host's different pages is template, so a host has at most (elements of a page / share) of them,
however many pages it has. Pass two parses again and leaves out template subtrees, elements that are no article by their
tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), and
joins the blocks of what is left.

The main text is that of the ``article`` or ``main`` elements where there are any, else of the body. Inside them recurring prose
stays, since pages may share passages; recurring subtrees go there only if most of their text is links.

Defined cases: null html and empty html have no text; a null url is a host of its own, the empty one; pages are a row each,
repeated rows and ids too; unclosed, misnested and broken-off markup is read as far as it goes; ``br`` is white space; an
empty table gives an empty result; other columns are ignored. Nothing is cut off, whatever a page's length or depth.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import broadcast_if_small, materialize, slices, table

#: A subtree is template from so many different pages of its host on, if they are this share of the host's different pages.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: Shares of a host that its pages are dealt into where its templates are too many to broadcast.
SALT = 32

# Element names of the HTML standard, and the words by which sites name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset("td th br option".split())
NO_TEXT = frozenset(
    "script style noscript template head title nav aside footer form button input select textarea fieldset iframe object embed canvas svg math audio video dialog menu xmp noembed noframes".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
CLOSED_BY = {
    "li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
    "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}),
    "tbody": ("tbody thead tfoot tr td th", {"table"}), "thead": ("tbody thead tfoot tr td th", {"table"}), "tfoot": ("tbody thead tfoot tr td th", {"table"}),
}
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form toolbar".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar "
    "footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related recommended pagination pager "
    "comments comment disqus respond widget masthead topbar toolbar skip".split()
)
#: Names that only mark boilerplate outside of an article, where they may also name its own parts.
HEADER_NAMES = frozenset({"header"})
#: Beside one of these a name tells of the layout (``no-sidebar``) and not of the element.
LAYOUT_NAMES = frozenset("no has with without".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?P<end>>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Element:
    tag: str
    parent: int
    skip: bool = False  # no article, by its own tag, role or names
    inside: bool = False  # in an article or main element
    root: bool = False  # an outermost article or main element
    dead: bool = False  # itself or in an element that is no article
    pieces: list = field(default_factory=list)  # text, or numbers of children
    hash: int = 0
    letters: int = 0
    link_letters: int = 0


def _names(attrs: str) -> tuple[set[str], str]:
    """Words of class and id, and the role."""
    words, role = set(), ""
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        if key.lower() == "role":
            role = value.strip().lower()
        else:
            for name in value.split():
                parts = {w.lower() for w in _NAME.findall(name)}
                words |= parts if LAYOUT_NAMES.isdisjoint(parts) else set()
    return words, role


def elements(page: str) -> list[Element]:
    """The elements of a page in order, the document itself first, with hashes of their subtrees."""
    found = [Element("#document", -1)]
    stack = [0]
    open_tags: dict[str, int] = {}

    def close(upto: int) -> None:
        """Close elements until ``upto`` are open."""
        while len(stack) > upto:
            number = stack.pop()
            one = found[number]
            open_tags[one.tag] = open_tags.get(one.tag, 1) - 1
            _seal(found, one)

    def close_tag(tags, stops) -> None:
        for at in range(len(stack) - 1, 0, -1):
            tag = found[stack[at]].tag
            if tag in tags:
                close(at)
                return
            if tag in stops:
                return

    at, n = 0, len(page)
    while at < n:
        match = _TOKEN.search(page, at)
        start = match.start() if match else n
        if start > at:
            found[stack[-1]].pieces.append(page[at:start])
        if not match:
            break
        at = match.end()
        tag = match["tag"]
        if tag is None or (not match["end"] and at == n):
            continue
        tag = tag.lower()
        if match["close"]:
            if open_tags.get(tag):
                close_tag((tag,), ())
            elif tag == "br":
                found[stack[-1]].pieces.append(" ")
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            close_tag(("p",), ("button", "td", "th", "caption", "table", "object", "#document"))
        if tag in CLOSED_BY:
            tags, stops = CLOSED_BY[tag]
            for _ in tags.split():
                close_tag(tags.split(), stops)
        attrs = match["attrs"]
        above = found[stack[-1]]
        one = Element(tag, stack[-1])
        inside = above.inside or above.root
        one.inside = inside
        words, role = _names(attrs) if "=" in attrs else ((), "")
        one.skip = tag in NO_TEXT or role in NO_ARTICLE_ROLES or (tag not in ("html", "body", "article", "main") and not NO_ARTICLE_NAMES.isdisjoint(words))
        one.skip = one.skip or (not inside and (tag == "header" or not HEADER_NAMES.isdisjoint(words)) and tag not in ("html", "body", "article", "main"))
        # an article inside an article is a reader's comment or a teaser
        one.skip = one.skip or (inside and tag == "article" and open_tags.get("article", 0) > 0)
        one.dead = above.dead or one.skip
        one.root = not inside and not one.dead and tag in ("article", "main")
        number = len(found)
        found.append(one)
        above.pieces.append(number)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            _seal(found, one)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            one.pieces.append(page[at : end.start() if end else n])
            at = end.start() if end else n
        stack.append(number)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    close(0)
    return found


def _seal(found: list[Element], one: Element) -> None:
    """Hash and letters of an element whose children are sealed."""
    digest = xxhash.xxh64(one.tag.encode())
    for piece in one.pieces:
        if isinstance(piece, int):
            child = found[piece]
            digest.update(child.hash.to_bytes(8, "little", signed=True))
            one.letters += child.letters
            one.link_letters += child.link_letters
        else:
            text = " ".join(piece.split())
            digest.update(b"\0" + text.encode("utf-8", "surrogatepass"))
            one.letters += len(text)
    if one.tag == "a":
        one.link_letters = one.letters
    one.hash = digest.intdigest() - (1 << 63)


def countable(one: Element) -> bool:
    """Whether the element goes if it is template: inside articles only what is mostly links, elsewhere anything with text."""
    if one.tag in ("#document", "html", "body") or one.root or not one.letters:
        return False
    return not one.inside or (one.tag != "a" and 2 * one.link_letters > one.letters)


def subtrees(page: str) -> tuple[int, list[int]]:
    """Hash of the page and of its distinct subtrees that may be template."""
    found = elements(page)
    return found[0].hash, sorted({one.hash for one in found if countable(one)})


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, each on a line."""
    found = elements(page)
    roots = any(one.root for one in found)
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    # element, next piece, whether its text counts, whether it counts only headings
    stack = [(0, 0, not roots, False)]
    while stack:
        number, k, counts, headings = stack.pop()
        one = found[number]
        if k == 0 and one.tag in BLOCK:
            end_block()
        elif k == 0 and one.tag in CELL:
            line.append(" ")
        if k == len(one.pieces):
            if one.tag in BLOCK:
                end_block()
            elif one.tag in CELL:
                line.append(" ")
            continue
        piece = one.pieces[k]
        stack.append((number, k + 1, counts, headings))
        if not isinstance(piece, int):
            if counts and not headings:
                line.append(_html.unescape(piece))
            continue
        child = found[piece]
        if child.skip or (child.hash in template and countable(child)):
            if child.tag in BLOCK:
                end_block()
            continue
        only = (headings or (child.inside and child.tag == "header")) and child.tag not in HEADINGS
        stack.append((piece, 0, counts or child.root, only))
    end_block()
    return "\n".join(blocks)


def host(url):
    """Host of a url, in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        pages, lists = [], []
        for page in batch.column("html").to_pylist():
            number, found = subtrees(page or "")
            pages.append(number)
            lists.append(found)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(pages, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["host", "page", "subtrees"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host and its template subtrees (array of hashes), of hosts that have any. ``pages``: host, html."""
    seen = materialize(pages.select("host", "html").mapInArrow(_hashed, "host string, page long, subtrees array<long>"), "html-subtrees")
    different = seen.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # a page's copies all have its subtrees, so that one row of each page is enough
    single = seen.select("host", "page", F.explode("subtrees").alias("subtree")).distinct()
    counts = single.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    counts = materialize(counts, "html-counts")
    totals = broadcast_if_small(materialize(different.where(F.col("pages") >= min_pages), "html-hosts"))
    template = counts.join(totals, "host").where(F.col("n") >= F.ceil(F.col("pages") * min_share))
    return template.groupBy("host").agg(F.collect_set("subtree").alias("template"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(page or "", frozenset(template or ())) for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text of each page of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    template = materialize(site_templates(rows, min_pages, min_share), "html-templates")
    if template.isEmpty():
        joined = rows.withColumn("template", F.lit(None).cast("array<long>"))
    elif template.select(F.sum(F.size("template") + 8)).first()[0] * 8 <= 2 << 20:
        joined = rows.join(F.broadcast(template), "host", "left")
    else:
        salted = template.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "_salt"], "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_extracted, "page_id long, url string, text string")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: SQL does not parse HTML; over pages whose markup is that of the given tables, regular expressions find the same text.
SQL = {
    "op12_html_extraction": r"""
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages),
blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(inner_html, '</?(p|h1)>'), lambda b:
  trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', chr(1)), '&amp$', chr(1)), chr(1), '&'), '\s+', ' ', 'g'))) AS parts FROM body),
texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda b: b <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts""",
}
QUERIES = {"op12_html_extraction": op12_html_extraction}
