"""HTML main text by wrapper induction over the pages of a host (operator 7)."""

from __future__ import annotations

import json
import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .urls import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split())
#: Elements never shown as text, and page furniture.
HIDDEN = frozenset("script style noscript template head iframe object svg math canvas audio video textarea select".split())
FURNITURE = frozenset("nav aside footer form button dialog menu".split())
#: Words of class, id and role that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent "
    "contentinfo complementary cookie cookies disqus dropdown footer gdpr menu modal nav navbar navigation newsletter "
    "notice notification pagination pager popup promo related replies reply search share sharing sidebar social "
    "sponsor sponsored subscribe subscription toolbar widget".split())
#: Where an article stands.
CONTENT = frozenset(("article", "main"))
#: Models a host; distinct pages, and their share of those that have a place, on which a template text stands.
MODELS, LEAST_PAGES, SHARE = 4, 3, 2 / 3
#: What tells pages apart is the rest of their html.
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
#: Elements nested deeper than this count as part of the element at that depth.
MAX_DEPTH = 256

_CLOSES_P = BLOCKS - {"html", "body", "option", "optgroup", "title"}
_SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = frozenset("ul ol dl table select article section div td th blockquote body main".split())


class Node:
    __slots__ = ("tag", "words", "sure", "parts", "path")

    def __init__(self, tag: str, words: frozenset[str], sure: bool = False):
        self.tag, self.words, self.sure, self.parts, self.path = tag, words, sure, [], None


#: A comment, a tag with quoted or unquoted attributes, any other declaration, text, a stray bracket.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>|[^<]+|<", re.S)
_SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_MARKS = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "xmp")}


def parse(html: str | None) -> Node:
    """A tolerant tree of elements and text; unclosed elements end where the next block demands it."""
    html = html or ""
    root = Node("", frozenset())
    stack, deeper = [root], []
    at, size = 0, len(html)

    def close(tag, stop):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                deeper.clear()
                return
            if stack[i].tag in stop:
                return

    while at < size:
        token = _TOKEN.match(html, at)
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            text = token[0]
            if text[0] != "<" or text == "<":
                stack[-1].parts.append(unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if token[1] or token[4]:
            if deeper and tag in deeper:
                while deeper.pop() != tag:
                    pass
            else:
                close(tag, _SCOPE - {tag} if tag == "p" or tag not in BLOCKS else ())
            continue
        if tag in _CLOSES_P:
            close("p", _SCOPE)
        for other in _SAME_CLOSES.get(tag, ()):
            close(other, _SCOPE - {other})
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else size
        if len(stack) > MAX_DEPTH:
            if tag not in VOID:
                deeper.append(tag)
            stack[-1].parts.append(" ")
            continue
        attributes = token[3] or token[6] or ""
        words, sure = frozenset(), False
        if attributes:
            # The id of a heading, a paragraph or an inline element is a slug of its text and says nothing of its part.
            named = tag in BLOCKS and tag not in _SLUGGED
            marks = " ".join((m[2] or m[3] or m[4] or "").lower() for m in _MARKS.finditer(attributes)
                             if named or m[1].lower() != "id")
            words = frozenset(marks.replace("-", " ").replace("_", " ").split())
            sure = bool(words & FURNITURE_WORDS) and not FURNITURE_WORDS.isdisjoint(marks.split())
        node = Node(tag, words, sure)
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node)
    return root


def is_furniture(node: Node, in_content: bool) -> bool:
    if node.tag in HIDDEN or node.tag in FURNITURE or node.words & FURNITURE_WORDS:
        return True
    return not in_content and (node.tag == "header" or "header" in node.words or "masthead" in node.words)


def text_size(node: Node) -> int:
    """Characters of text below an element, without white space at the ends and what is never shown."""
    total, todo = 0, [node]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, str):
                total += len(part.strip())
            elif part.tag not in HIDDEN:
                todo.append(part)
    return total


def is_dropped(node: Node, in_content: bool, whole: Node) -> bool:
    """Whether an element is furniture that does not hold the main text.

    ``body`` and ``html`` never are. A form, or an element that has a furniture
    word only as part of a longer name (``has-sidebar``), is not if more than half
    of the text of ``whole`` stands in it.
    """
    if not is_furniture(node, in_content):
        return False
    if node.tag in HIDDEN:
        return True
    if node.tag in ("body", "html"):
        return False
    if node.sure or (node.tag in FURNITURE and node.tag != "form") or node.tag == "header":
        return True
    return 2 * text_size(node) <= text_size(whole)


def summarise(root: Node) -> list:
    """Summary tree [signature, text hash, children, number]: siblings of one signature are one node.

    Repeated items of a list or paragraphs of a text so become one slot. Every
    element keeps the number of its summary node.
    """
    texts: list[list[str]] = [[]]
    children: list[dict[str, list]] = [{}]
    tree = ["", 0, [], 0]
    nodes = [tree]
    root.path = 0
    pending = [root]
    while pending:
        node = pending.pop()
        mine, held = children[node.path], texts[node.path]
        for part in node.parts:
            if isinstance(part, str):
                held.append(part)
                continue
            key = ".".join([part.tag, *sorted(part.words)]) if part.words else part.tag
            below = mine.get(key)
            if below is None:
                below = mine[key] = [key, 0, [], len(nodes)]
                nodes[node.path][2].append(below)
                nodes.append(below)
                texts.append([])
                children.append({})
            part.path = below[3]
            pending.append(part)
    for node, held in zip(nodes, texts):
        text = " ".join("".join(held).split())
        node[1] = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) & (1 << 62) - 1
    return tree


def align(model: list, page: list) -> dict[int, int]:
    """Simple tree matching: page summary node -> model summary node of the largest order-keeping match."""
    sizes: dict[tuple[int, int], tuple[int, list]] = {}

    def match(a, b) -> int:
        if a[0] != b[0]:
            return 0
        key = (a[3], b[3])
        if key not in sizes:
            left, right = a[2], b[2]
            best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
            for i, x in enumerate(left):
                for j, y in enumerate(right):
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(x, y))
            sizes[key] = (best[-1][-1] + 1, best)
        return sizes[key][0]

    found: dict[int, int] = {}
    if match(model, page):
        todo = [(model, page)]
        while todo:
            a, b = todo.pop()
            found[b[3]] = a[3]
            best = sizes[(a[3], b[3])][1]
            i, j = len(a[2]), len(b[2])
            while i and j:
                gain = match(a[2][i - 1], b[2][j - 1])
                if gain and best[i][j] == best[i - 1][j - 1] + gain:
                    i, j = i - 1, j - 1
                    todo.append((a[2][i], b[2][j]))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return found


def own_texts(root: Node):
    """(element, hash of the text that stands in it and in none of its elements), where there is any."""
    todo = [root]
    while todo:
        node = todo.pop()
        held = []
        for part in node.parts:
            (held if isinstance(part, str) else todo).append(part)
        text = " ".join("".join(held).split())
        if text:
            yield node, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) & (1 << 62) - 1


def best_model(models: list[tuple[list, int]], page: list) -> tuple[int, dict[int, int]]:
    """(number, alignment) of the model (tree, nodes) that shares most with the page; the first of equal ones."""
    size, todo = 0, [page]
    while todo:
        size += 1
        todo += todo.pop()[2]
    best, number, found = -1.0, 0, {}
    for i, (model, nodes) in enumerate(models):
        pairs = align(model, page)
        share = 2 * len(pairs) / (nodes + size)
        if share > best:
            best, number, found = share, i, pairs
    return number, found


def find_regions(root: Node, within: bool) -> list[Node]:
    """The articles of a page outside of furniture or, ``within`` it, of elements that only words make furniture."""
    regions: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in CONTENT or node.words & {"articlebody"}:
            regions.append(node)
            continue
        todo += [p for p in reversed(node.parts) if not isinstance(p, str) and (
            not is_furniture(p, False) or p.tag in ("body", "html")
            or within and p.tag not in HIDDEN and (p.tag == "form" or p.tag not in FURNITURE)
            and not (p.tag in CONTENT and p.sure))]
    return regions


def blocks_of(root: Node, template: frozenset[Node]) -> list[str]:
    """The content blocks in page order: what varies in the articles of the page, or in all of it if it has none.

    ``template`` are the page's elements whose own text the host repeats.
    """
    regions = find_regions(root, False) or find_regions(root, True)
    in_content = bool(regions)
    out: list[str] = []
    held: list[str] = []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    for region in regions or [root]:
        stack = [(region, iter(region.parts))]
        flush()
        while stack:
            node, parts = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
                if node.tag in BLOCKS:
                    flush()
            elif isinstance(part, str):
                if node not in template:
                    held.append(part)
            elif part.tag == "br":
                held.append(" ")
            elif not is_dropped(part, in_content, region):
                if part.tag in BLOCKS:
                    flush()
                stack.append((part, iter(part.parts)))
        flush()
    return out


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    For every host the element trees of up to ``MODELS`` different pages are
    models, those of the smallest hash of their share of all hashes; every page of
    the host is aligned by simple tree matching with the model that it shares most
    with. An element's own text is template if it stands at one place of the model
    on at least ``LEAST_PAGES`` different pages and on ``SHARE`` of the different
    pages that have a text at that place; pages of the same visible words are one.
    What varies is a slot. A page in which nothing varies keeps all of its text.
    Of the slots, ``article`` and ``main`` elements choose the main text where a
    page has them; furniture, known by element and by the words of class, id and
    role, is left out, but not where the main text stands in it.

    The alignment of a page is one row's work and its findings are counted per
    host, place and text, first within each batch, so a host with a third of all
    pages is spread like any other. Models, wrappers and the numbers of copies are
    written before they are joined: the join sends them to the pages where their
    size is known to allow it and shuffles both sides where not.

    A null or empty page has an empty text. A null address, or one without host,
    belongs to the host of the empty name. Repeated rows give the same text
    again; an empty table gives no rows; other columns are not read.
    """
    picked = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                          host_of(F.col(url)).alias("host"))
    kind = dict(picked.dtypes)["page_id"]
    told = picked.withColumn("words", F.xxhash64(F.regexp_replace("html", UNSEEN, " ")))

    def outline(batches):
        for batch in batches:
            trees = [json.dumps(summarise(parse(h)), ensure_ascii=False, separators=(",", ":"))
                     for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees, pa.string())],
                                             ["host", "share", "model"])

    def reader():
        """Trees and sizes of models, each read once."""
        known: dict[str, tuple[list, int]] = {}

        def read(sources):
            for source in sources:
                if source not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[source] = json.loads(source), 0
                    size, todo = 0, [known[source][0]]
                    while todo:
                        size += 1
                        todo += todo.pop()[2]
                    known[source] = known[source][0], size
                yield known[source]

        return lambda sources: list(read(sources))

    def matched(batches):
        read = reader()
        for batch in batches:
            found: dict[tuple[str, int, int, int], float] = {}
            for host, html, sources, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
                root = parse(html)
                number, pairs = best_model(read(sources), summarise(root))
                texts = {(pairs[n.path], text) for n, text in own_texts(root) if n.path in pairs}
                # -1 counts the pages that have any text at the place.
                for place, text in texts | {(place, -1) for place, _ in texts}:
                    spot = host, number, place, text
                    found[spot] = found.get(spot, 0.0) + 1 / copies
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()),
                 pa.array([k[2] for k in found], pa.int32()), pa.array([k[3] for k in found], pa.int64()),
                 pa.array(list(found.values()), pa.float64())], ["host", "number", "node", "text", "n"])

    models = told.filter("html <> ''").groupBy("host", F.pmod("words", F.lit(MODELS)).cast("int").alias("share")).agg(
        F.min_by("html", F.struct(F.xxhash64("html"), F.col("html"))).alias("html")).mapInArrow(
        outline, "host string, share int, model string")
    models = materialise(models.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("share", "model"))).alias("m")).select(
        "host", F.col("m.model").alias("models")), "models")
    copies = materialise(told.groupBy("host", "words").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    findings = told.join(models, "host").join(copies, ["host", "words"], "left").select(
        "host", "html", "models", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(
        matched, "host string, number int, node int, text long, n double")
    counted = findings.groupBy("host", "number", "node", "text").agg(F.sum("n").alias("n")).filter(
        F.col("n") > LEAST_PAGES - 1e-6)
    constant = counted.groupBy("host", "number", "node").agg(
        F.max(F.when(F.col("text") == -1, F.col("n"))).alias("all"),
        F.collect_list(F.when(F.col("text") != -1, F.struct("text", "n"))).alias("texts")).select(
        "host", F.struct("number", "node", F.filter(
            "texts", lambda t: t["n"] > F.col("all") * SHARE - 1e-6)["text"].alias("texts")).alias("spot"))
    wrappers = materialise(models.join(constant.filter(F.size("spot.texts") > 0), "host").groupBy("host").agg(
        F.first("models").alias("models"), F.collect_list("spot").alias("template")), "wrappers")

    def extracted(batches):
        read, templates = reader(), {}
        for batch in batches:
            texts = []
            column = batch.column(4)
            for host, source, sources, i in zip(*(batch.column(i).to_pylist() for i in (5, 2, 3)), range(batch.num_rows)):
                root = parse(source)
                same: frozenset[Node] = frozenset()
                if sources:
                    if host not in templates:
                        if len(templates) > 1000:
                            templates.clear()
                        templates[host] = {(x["number"], x["node"], t) for x in column[i].as_py() for t in x["texts"]}
                    number, pairs = best_model(read(sources), summarise(root))
                    same = frozenset(n for n, text in own_texts(root)
                                     if (number, pairs.get(n.path), text) in templates[host])
                # Without anything that varies there is no telling the template from the text.
                texts.append("\n".join(same and blocks_of(root, same) or blocks_of(root, frozenset())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return picked.join(wrappers, "host", "left").select(
        "page_id", "url", "html", "models", "template", "host").mapInArrow(
        extracted, f"page_id {kind}, url string, text string, n_chars long")
