"""HTML extraction by wrapper induction: the DOM trees of a host's pages are aligned by simple tree matching.

A host's template is the union of its aligned trees. Every page is then aligned to it, and all texts shown at each
template node are counted by the pages that show them. A text on most pages that show its node is template; all others
fill a slot and are content, however often a value comes again. In parts that HTML itself sets apart from the content
(navigation, page footer, advertisement) any text that several pages show is template.
Templates are built for each part of the pages and merged in two steps, and texts are counted by one aggregation, so
no task sees all pages of a large host.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, bound_batches, slices, stored

#: A template text is on more than this share of the pages that show its node, and on this share of the host's pages.
MOST, RARE = 0.5, 0.05
#: Deepest nesting, most siblings.
DEPTH, WIDE = 60, 48
#: Hosts whose partial templates a task holds at once.
HOSTS = 2000

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<(script|style|head|noscript|template|svg)\b.*?(?:</\1\s*>|$)|<!?[a-zA-Z/?][^>]*(?:>|$)", re.S | re.I)
_TAG = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"\s*([^"\s]+)|'\s*([^'\s]+)|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Tags and classes of parts beside the content; a footer or header within these tags belongs to the content.
_ASIDE = frozenset("nav aside menu .nav .navbar .menu .breadcrumb .breadcrumbs .sidebar .ad .ads .advert .advertisement .banner .sponsored .cookie .footer".split())
_EDGE, _CONTENT = frozenset(("footer", "header")), frozenset(("article", "main", "section", "blockquote"))
#: An opening tag ends an open element of these names, unless an element of the second set lies between.
_ENDS = {"p": ({"p"}, {"div", "article", "section", "li", "td", "body", "blockquote"}), "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
for _name in ("div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "footer", "nav", "header", "blockquote", "pre", "form"):
    _ENDS[_name] = _ENDS["p"]


class Node:
    """An element: label, texts ``(place, block, text)`` directly in it, children; runs of equal siblings are one node."""

    __slots__ = ("label", "texts", "children")

    def __init__(self, label):
        self.label, self.texts, self.children = label, [], []


def parse(source: str) -> Node:
    """DOM tree of the visible part. Comments, scripts, styles and the head are left out, open elements are closed as
    browsers do, elements nested deeper than ``DEPTH`` are folded into their ancestor."""
    root = Node("#root")
    stack, names, place, block, at, deep = [root], ["#root"], 0, 0, 0, 0

    def add(raw):
        nonlocal place
        text = " ".join(entities.unescape(raw).split())
        if text:
            stack[-1].texts.append((place, block, text))
            place += 1

    def close(to):
        nonlocal block
        if any(n in _BLOCK for n in names[to:]):
            block += 1
        del stack[to:], names[to:]

    for m in _PIECE.finditer(source):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = _TAG.match(m.group())
        if m.group(1) or not tag:
            continue
        name = tag.group(1).lower()
        if m.group().startswith("</"):
            for i in range(len(names) - 1, 0, -1):
                if names[i] == name:
                    close(i)
                    break
            continue
        ended, barrier = _ENDS.get(name, ((), ()))
        for i in range(len(names) - 1, 0, -1):
            if names[i] in ended:
                close(i)
                break
            if names[i] in barrier:
                break
        if name in _VOID:
            if name in ("br", "hr"):
                block += 1
            continue
        if name in _BLOCK:
            block += 1
        if len(stack) > DEPTH:
            continue
        kind = _CLASS.search(m.group())
        node = Node(name + "." + next(x for x in kind.groups() if x is not None) if kind else name)
        stack[-1].children.append(node)
        if not m.group().endswith("/>"):
            stack.append(node)
            names.append(name)
    if at < len(source):
        add(source[at:])
    return fold(root)


def fold(node: Node) -> Node:
    """Makes one node of neighbouring siblings with one label; of all such siblings where more than ``WIDE`` remain."""
    for everywhere in (False, True):
        if everywhere and len(node.children) <= WIDE:
            break
        out, last = [], {}
        for child in node.children:
            same = last.get(child.label)
            if same is not None and (everywhere or out[-1] is same):
                same.texts += child.texts
                same.children += child.children
            else:
                out.append(child)
                last[child.label] = child
        node.children = out
    for child in node.children:
        fold(child)
    return node


def matching(a: list, b: list, label_a, label_b, children_a, children_b, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of siblings: the size of the largest order-keeping match and its pairs."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    weight = {}
    for i in range(n):
        for j in range(m):
            w = 0
            if label_a(a[i]) == label_b(b[j]):
                key = (id(a[i]), id(b[j]))
                if key not in memo:
                    memo[key] = 1 + matching(children_a(a[i]), children_b(b[j]), label_a, label_b, children_a, children_b, memo)[0]
                w = weight[i, j] = memo[key]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return best[n][m], pairs[::-1]


# A template node is [label, children]; numbered, it is [label, children, number, whether beside the content].


def _template(node: Node) -> list:
    return [node.label, [_template(c) for c in node.children]]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def merge(a: list, b: list) -> list:
    """``a`` grown by template ``b`` of the same label: aligned nodes are merged, others inserted where they belong."""
    if b[1]:
        if len(a[1]) == len(b[1]) and all(x[0] == y[0] for x, y in zip(a[1], b[1])):
            pairs = [(i, i) for i in range(len(a[1]))]
        else:
            label, children = (lambda x: x[0]), (lambda x: x[1])
            _, pairs = matching(a[1], b[1], label, label, children, children, {})
        partner = {j: i for i, j in pairs}
        out, done = [], 0
        for j, child in enumerate(b[1]):
            if j in partner:
                out += a[1][done : partner[j]]
                out.append(merge(a[1][partner[j]], child))
                done = partner[j] + 1
            else:
                out.append(child)
        a[1] = out + a[1][done:]
    return a


def number(template: list) -> list:
    """``template`` with its nodes numbered in their order, and those beside the content marked."""
    todo, n = [(template, False, False)], 0
    while todo:
        node, aside, content = todo.pop()
        tag, _, kind = node[0].lower().partition(".")
        aside = aside or tag in _ASIDE or "." + kind in _ASIDE or (tag in _EDGE and not content)
        node += (n, aside)
        n += 1
        todo += [(child, aside, content or tag in _CONTENT) for child in reversed(node[1])]
    return template


def align(page: Node, template: list) -> list[tuple[int, int, int, str, bool]]:
    """``(place, block, node, text, beside the content)`` of a page's texts in order; node -1 where nothing matches."""
    found = []

    def walk(node, known):
        at, aside = (-1, False) if known is None else known[2:]
        found.extend((place, block, at, text, aside) for place, block, text in node.texts)
        partner: dict = {}
        if known is not None and node.children:
            if len(node.children) == len(known[1]) and all(x.label == y[0] for x, y in zip(node.children, known[1])):
                partner = {i: known[1][i] for i in range(len(node.children))}
            else:
                _, pairs = matching(node.children, known[1], lambda x: x.label, lambda x: x[0], lambda x: x.children, lambda x: x[1], {})
                partner = {i: known[1][j] for i, j in pairs}
        for i, child in enumerate(node.children):
            walk(child, partner.get(i))

    walk(page, template)
    return sorted(found)


def host(url: Column) -> Column:
    """Host of a URL in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, pages, template)`` of all pages with HTML; the template is pickled."""

    def part(batches):
        held: dict[str, list] = {}

        def flush():
            rows = [(h, zlib.crc32(packed) % 64, n, packed) for h, (n, t) in held.items() for packed in [pickle.dumps(t, 5)]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["host", "part", "pages", "template"])

        for batch in slices(batches):
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = _template(parse(source))
                if h in held:
                    held[h] = (held[h][0] + 1, merge(held[h][1], new))
                else:
                    if len(held) >= HOSTS:
                        yield flush()
                    held[h] = (1, new)
        if held:
            yield flush()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["pages", "template"], ascending=[False, True], ignore_index=True)
        total = pickle.loads(rows.template[0])
        for other in rows.template[1:]:
            merge(total, pickle.loads(other))
        return pd.DataFrame({"host": [rows.host[0]], "part": [0], "pages": [rows.pages.sum()], "template": [pickle.dumps(total, 5)]})

    schema = "host string, part int, pages long, template binary"
    partial = pages.where(F.col(f"`{html}`").isNotNull()).select(host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")).mapInArrow(part, schema)
    for key in (["host", "part"], ["host"]):
        partial = partial.groupBy(key).applyInPandas(join, schema)
    return partial.select("host", "pages", "template")


def aligned(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id, host, page, nodes, hashes, asides, blocks, texts)``: the texts of every page in order, aligned to the host's
    template; pages that show the same have the same ``page``."""
    known = stored(templates(pages, url, html))
    total = known.agg(F.sum(F.length("template"))).first()[0] or 0
    rows = pages.select(F.col(f"`{id}`").alias("id"), host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    joined = rows.join(F.broadcast(known) if total <= BROADCAST_LIMIT else known, "host", "left").select("id", "host", "html", "template")

    def run(batches):
        cache: dict[bytes, list] = {}
        for batch in slices(batches):
            out = []
            for source, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if source is None:
                    out.append((None,) * 6)
                    continue
                if packed not in cache:
                    if len(cache) >= HOSTS:
                        cache.clear()
                    cache[packed] = number(pickle.loads(packed))
                found = align(parse(source), cache[packed])
                nodes, hashes = [x[2] for x in found], [_hash(x[3]) for x in found]
                out.append((_hash(repr((nodes, hashes))), nodes, hashes, [x[4] for x in found], [x[1] for x in found], [x[3] for x in found]))
            kinds = (pa.int64(), *map(pa.list_, (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], ["id", "host", "page", "nodes", "hashes", "asides", "blocks", "texts"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, host string, page long, nodes array<int>, hashes array<long>, asides array<boolean>, blocks array<int>, texts array<string>")


def constants(texts: DataFrame, limit: float = MOST) -> DataFrame:
    """``(host, constant)``: the texts of ``aligned`` pages that are template, as pairs of a node and a text's hash.

    Counted are the different pages of a host. A text of two pages or more is template where it is on more than
    ``limit`` of the pages that show its node, and on ``RARE`` of all; beside the content, in any case.
    """
    pages = texts.where("page is not null").select("host", "page", "nodes", "hashes", "asides").dropDuplicates(["host", "page"])
    each = F.array_distinct(F.arrays_zip("nodes", "hashes", "asides"))
    node = F.transform(F.array_distinct("nodes"), lambda n: F.struct(n.alias("nodes"), F.lit(None).cast("long").alias("hashes"), F.lit(False).alias("asides")))
    whole = F.array(F.struct(F.lit(-2).alias("nodes"), F.lit(None).cast("long").alias("hashes"), F.lit(False).alias("asides")))
    counts = pages.select("host", F.explode(F.concat(each, node, whole)).alias("x")).select("host", "x.*").groupBy("host", "nodes", "hashes", "asides").agg(F.count("*").alias("n"))
    counts = stored(counts.where("n >= 2 and nodes != -1"))
    shown = counts.where("hashes is null").select("host", "nodes", F.col("n").alias("shown"))
    of_host = shown.where("nodes = -2").select("host", F.col("shown").alias("pages"))
    found = counts.where("hashes is not null").join(shown, ["host", "nodes"]).join(of_host, "host")
    found = found.where(F.col("asides") | ((F.col("n") > F.lit(limit) * F.col("shown")) & (F.col("n") >= RARE * F.col("pages"))))
    return found.groupBy("host").agg(F.collect_list(F.struct("nodes", "hashes")).alias("constant"))


def extract_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", limit: float = MOST) -> DataFrame:
    """``(id, host, content, n_content, n_template)`` of every row of ``pages``.

    A null HTML gives null content, an empty one empty content. A host with a single page has no repeated text, so
    all its text is content; pages without a host form one group. Pages that show the same count once, repeated rows all
    give a row, an empty table none; a page of any length is parsed whole. Other columns are dropped.
    """
    bound_batches(pages.sparkSession)
    kind = pages.schema[id].dataType.simpleString()
    texts = stored(aligned(pages, id, url, html))
    known = stored(constants(texts, limit))
    total = known.agg(F.sum(F.size("constant"))).first()[0] or 0
    joined = texts.join(F.broadcast(known) if 32 * total <= BROADCAST_LIMIT else known, "host", "left").select("id", "host", "nodes", "hashes", "blocks", "texts", "constant")

    def run(batches):
        cache: dict[str, set] = {}
        for batch in slices(batches):
            out = []
            hosts, nodes, hashes, blocks, texts = (batch.column(k).to_pylist() for k in range(1, 6))
            for i, h in enumerate(hosts):
                if texts[i] is None:
                    out.append((None, None, None))
                    continue
                if h not in cache:
                    if len(cache) >= HOSTS:
                        cache.clear()
                    cache[h] = {(x["nodes"], x["hashes"]) for x in batch.column(6)[i].as_py() or ()}
                out.append(extract(nodes[i], hashes[i], blocks[i], texts[i], cache[h]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32())))], [id, "host", "content", "n_content", "n_template"])

    return joined.mapInArrow(run, f"`{id}` {kind}, host string, content string, n_content int, n_template int")


def extract(nodes: list, hashes: list, blocks: list, texts: list, constant: set) -> tuple[str, int, int]:
    """Content of a page, blocks as lines, and how many of its texts are content and template."""
    lines: list[list[str]] = []
    last, kept = None, 0
    for node, hash, block, text in zip(nodes, hashes, blocks, texts):
        if (node, hash) in constant:
            continue
        if block != last:
            lines.append([])
        lines[-1].append(text)
        last, kept = block, kept + 1
    return "\n".join(" ".join(x) for x in lines), kept, len(texts) - kept
