"""HTML extraction by a site style tree.

The element trees of all pages of a host are merged: elements with the same path of tags, classes and
ids are one node, where ids with digits, which name single posts, and the digits of classes don't count. A node's presentation importance is the normalised entropy of the child sequences
that its elements have; its content importance is one less the normalised entropy with which its pieces
of text, links and images spread over the host's pages, weighted by occurrence. Composite importance
mixes a node's own with its children's, and a branch goes when no node in it reaches LEAST.

All sums that entropies need are additive, so one aggregation over (host, node, feature) gives them; a
host's tree is as large as its variety of structure, however many pages it has. Pages are parsed
once more to leave the branches out.

A text that a site repeats from a pool is only seen to be repeated once the site has far more pages than
the pool has texts: what less than about pages ** LEAST different texts take turns in goes.

Defined results: null html gives null text, empty html ""; scripts, styles, comments and the head never
count. Pages without a host are only stripped of those. Nodes of one page are fully important, so a
host's only page keeps all its text. Equal pages of a host make their content less important. Columns
other than page_id, url and html aren't read; unclosed and crossed tags are repaired.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm import kernel
from lakemill.llm.frames import by_chunk, fixed

LEAST, FADE = 0.65, 0.9
#: Removed nodes go to every worker up to this many, and by a join on the host beyond it.
BROADCAST_NODES = 200_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<raw>script|style|noscript|template)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(class|id|href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_HIDING = re.compile(r"<!--|<(?:script|style|noscript|template)\b", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul br".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in _BLOCK - {"li", "dt", "dd", "tr", "td", "th", "br", "html", "body"}}
_FENCE = frozenset("table ul ol dl div article section body html nav select".split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def host(url: str | None) -> str | None:
    """The host of a URL in lower case, without port and user; None where there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else None


def walk(page: str) -> Iterator[tuple[str, int, int, str]]:
    """Events of a page: ("open", node, parent, key), ("close", node, ...), ("text", node, 0, text), ("link", node, 0, address)."""
    stack: list[tuple[str, int]] = []
    at: dict[str, list[int]] = defaultdict(list)  # the places of open elements by tag
    fences: list[int] = []

    def close(i: int) -> Iterator[tuple[str, int, int, str]]:
        while len(stack) > i:
            t, node = stack.pop()
            at[t].pop()
            if t in _FENCE:
                fences.pop()
            yield "close", node, 0, t

    # nothing that begins after the last > is a tag, so it isn't looked for there
    end = page.rfind(">") + 1
    done = 0
    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > done:
            yield "text", stack[-1][1] if stack else 0, 0, page[done : m.start()]
        done = m.end()
        tag = m["tag"]
        if not tag:
            if done == end and _unended(m):
                done = len(page)
            continue
        tag = tag.lower()
        if m["end"]:
            if at[tag]:
                yield from close(at[tag][-1])
            continue
        shut = _CLOSES.get(tag)
        if shut:
            i = max((at[t][-1] for t in shut if at[t]), default=-1)
            if i > (fences[-1] if fences else -1):
                yield from close(i)
        key, address = tag, None
        if m["attrs"]:
            for name, a, b, c in _NAMES.findall(m["attrs"]):
                name, value = name.lower(), a or b or c
                if name == "class":
                    key += f"|class={' '.join(_DIGITS.sub('#', value).split())}"
                elif name == "id":
                    key += "" if _DIGITS.search(value) else f"|id={' '.join(value.split())}"
                else:
                    address = value
        parent = stack[-1][1] if stack else 0
        node = _hash(f"{parent}/{key}")
        yield "open", node, parent, key
        if address:
            yield "link", node, 0, address
        if tag in _VOID or m["attrs"].endswith("/"):
            yield "close", node, 0, tag
        else:
            at[tag].append(len(stack))
            if tag in _FENCE:
                fences.append(len(stack))
            stack.append((tag, node))
    rest = page[done:]
    if hidden := _HIDING.search(rest):
        rest = rest[: hidden.start()]
    if rest:
        yield "text", stack[-1][1] if stack else 0, 0, rest
    yield from close(0)


def _unended(m: re.Match) -> bool:
    """Whether a comment or raw element goes on to the end."""
    if m["raw"]:
        return not re.search(rf"</{m['raw']}\s*>\Z", m[0][-64:], re.IGNORECASE)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


def _gather(pages: list[tuple[str, str]]) -> Counter:
    """Sums (host, node, parent, kind, feature) -> (n, n ln n) over pages; kinds: 0 page, 1 style, 2 content."""
    out: dict[tuple, list[float]] = defaultdict(lambda: [0, 0.0])
    for site, page in pages:
        content: Counter = Counter()
        parents: dict[int, int] = {}
        open_: list[tuple[int, list[str]]] = []
        for what, node, parent, text in walk(page):
            if what == "open":
                if open_:
                    open_[-1][1].append(text)
                parents[node] = parent
                open_.append((node, []))
            elif what == "close":
                at, kids = open_.pop()
                style = out[site, at, parents[at], 1, _hash(" ".join(kids))]
                style[0] += 1
            elif node and (text := " ".join(text.split())):
                content[node, _hash(text)] += 1
        for node, parent in parents.items():
            out[site, node, parent, 0, 0][0] += 1
        for (node, feature), n in content.items():
            x = out[site, node, parents[node], 2, feature]
            x[0] += n
            x[1] += n * math.log(n)
    return out


def _tree(table: pa.Table) -> pa.Table:
    """Of one host the nodes whose branches go, from the sums of each node."""
    site = table["host"][0].as_py()
    parent, sums = {}, defaultdict(dict)
    for r in table.to_pylist():
        parent[r["node"]] = r["parent"]
        sums[r["node"]][r["kind"]] = (r["n"], r["kinds"], r["nlogn"], r["spread"])
    kids = defaultdict(list)
    for node, up in parent.items():
        kids[up].append(node)
    order, todo = [], list(kids[0])
    while todo:
        node = todo.pop()
        order.append(node)
        todo += kids[node]
    value, most = {}, {}
    for node in reversed(order):
        s = sums[node]
        pages = s.get(0, (1, 1, 0, 0))[0]
        n, styles, nlogn, _ = s.get(1, (1, 1, 0.0, 0.0))
        look = 1.0 if n <= 1 else max(0.0, (math.log(n) - nlogn / n) / math.log(n))
        parts = [value[k] for k in kids[node]]
        if 2 in s:
            c, _, clogc, spread = s[2]
            parts.append(1.0 if pages <= 1 else 1 - min(1.0, max(0.0, (clogc - spread) / (c * math.log(pages)))))
        if kids[node]:
            fade = FADE**styles
            value[node] = (1 - fade) * look + fade * sum(parts) / len(parts)
        else:
            value[node] = parts[0] if parts else 1.0 if pages <= 1 else 0.0
        most[node] = max([value[node], *parts, *(most[k] for k in kids[node])])
    gone = [k for k in order if most[k] < LEAST]
    return pa.table({"host": pa.array([site] * len(gone), pa.string()), "node": pa.array(gone, pa.int64())})


def removed(pages: DataFrame) -> DataFrame:
    """(host, node) of the branches of every site that have no important node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        both = [(h, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True) if p and (h := host(u))]
        sums = _gather(both)
        if not sums:
            return None
        keys, values = list(zip(*sums, strict=True)), list(zip(*sums.values(), strict=True))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(keys, kinds, strict=True)), pa.array(values[0], pa.int64()), pa.array(values[1], pa.float64())], ["host", "node", "parent", "kind", "feature", "n", "spread"])

    rows = by_chunk(pages.select("url", "html"), run, "host string, node bigint, parent bigint, kind int, feature bigint, n bigint, spread double", text="html", limit=8 * kernel.CHUNK_BYTES)
    features = rows.groupBy("host", "node", "parent", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("spread").alias("spread"))
    nodes = features.groupBy("host", "node", "parent", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("spread").alias("spread"))
    return nodes.groupBy("host").applyInArrow(lambda x: _tree(x), "host string, node bigint")


def text_of(page: str | None, gone: set[int] | frozenset[int]) -> str | None:
    """The text outside the head and the removed nodes; blocks on lines of their own."""
    if page is None:
        return None
    out: list[str] = []
    depth = hidden = 0
    for what, node, _, text in walk(page):
        if what == "open":
            depth += 1
            tag = text.split("|", 1)[0]
            if not hidden and (tag == "head" or node in gone):
                hidden = depth
            if tag in _BLOCK:
                out.append("\n")
        elif what == "close":
            if hidden == depth:
                hidden = 0
            depth -= 1
            if text in _BLOCK:
                out.append("\n")
        elif what == "text" and not hidden:
            out.append(text.replace("\n", " ").replace("\r", " "))
    lines = (" ".join(entities.unescape(x).split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every page without the branches that its site repeats."""
    gone = fixed(removed(pages))
    schema = "page_id bigint, text string"
    if gone.count() <= BROADCAST_NODES:
        by = defaultdict(set)
        for site, node in gone.toLocalIterator():
            by[site].add(node)
        shared = pages.sparkSession.sparkContext.broadcast(dict(by))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [text_of(p, shared.value.get(host(u), frozenset())) for u, p in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

        return by_chunk(pages.select("page_id", "url", "html"), run, schema, text="html")

    sites = gone.groupBy("host").agg(F.collect_list("node").alias("gone"))
    named = pages.select("page_id", "html", F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_of(p, frozenset(g or ())) for p, g in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return by_chunk(named.join(sites, "host", "left").select("page_id", "html", "gone"), joined, schema, text="html")
