"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags with their place and its whole text nodes. Tokens that
occur equally often on each page of a host share an occurrence vector and form a class;
classes on (nearly) all pages of a host that keep their order and nest are its template.
Tags of the template that stand once on a page are its frame; the text between them is in
slots, told apart by the innermost frame tag around it. What a slot holds over all pages of
the host decides: from the root down, the frame tag with the bulk of the text that is neither
template nor link is the main slot, as long as its siblings hold little beside it. The text
of a page is what its main slot holds, without template text. On hosts without a template,
and on pages that do not have the frame, markup decides alone; inside the main slot it takes
out what occurrence cannot tell from paragraphs (forms, menus, adverts, readers' comments).

Occurrence vectors are sums of hashes, so they combine before any shuffle; pages that are
exact copies count once.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


@dataclass(frozen=True)
class TemplateParams:
    min_pages: int = 3  # distinct pages of a host below which nothing is called template
    support: float = 0.9  # share of a host's pages a template class is on
    min_class: int = 2  # tokens in a valid class
    bulk: float = 0.5  # share of the text around it that a main slot holds at least
    beside: float = 0.25  # what a sibling may hold at most of the text of a main slot


_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|template|textarea|select)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Markup that says it is no part of an article.
_BOILER_TAG = frozenset("head nav footer aside form button dialog menu title".split())
_BOILER_NAME = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|notices?|comments?|sidebar|menu|nav|navbar|navigation|footer)(?:$|[-_\s])", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html"}
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass(slots=True)
class Block:
    """A text node's block: its text, the paths of the tags around it, what markup says, and its characters in links."""

    text: str
    path: tuple  # of full paths, outermost first
    boiler: bool
    linked: int
    heading: bool


def parse(html: str) -> tuple[list[Block], list[str]]:
    """Blocks, and the tags as full paths, in order. Digits in attributes are folded, so numbered ids are one token."""
    blocks, tags, stack, buf, at = [], [], [], [], 0  # stack: (full path, boilerplate, main, name)
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buf).split())
        buf.clear()
        if text:
            blocks.append(Block(text, tuple(s[0] for s in stack), any(s[1] for s in stack), min(linked, len(text)), any(s[3] in _HEADING for s in stack)))
        linked = 0

    def words(raw: str) -> None:
        nonlocal linked
        got = entities.unescape(raw)
        buf.append(got)
        if any(s[3] == "a" for s in stack):
            linked += len(got.strip())

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            words(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:  # a closing tag
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][3] == name:
                    if name not in _BLOCK and any(s[1] or s[2] for s in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if name in _BLOCK or name in ("title", "head", "button"):
            flush()
        if name == "br":
            buf.append(" ")
        if name in _CLOSES_P and stack:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][3] == "p":
                    del stack[k:]
                    break
                if stack[k][3] in _BLOCK:
                    break
        if name == "li":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][3] == "li":
                    del stack[k:]
                    break
                if stack[k][3] in ("ul", "ol", "menu"):
                    break
        attrs = " ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(m[4])) if m[4] else ""
        inside = any(s[2] for s in stack)
        boiler = name in _BOILER_TAG or (name == "header" and not inside) or bool(attrs and _BOILER_NAME.search(attrs) and name not in ("html", "body", "article", "main"))
        main = name in ("article", "main") or attrs == "main"
        own = f"{name} {re.sub('[0-9]+', '0', attrs)}" if attrs else name
        path = f"{stack[-1][0]}/{own}" if stack else own
        tags.append(path)
        if name not in _VOID and not m[4].endswith("/"):
            if boiler and name not in _BLOCK:
                flush()
            stack.append((path, boiler, main, name))
    if at < len(html):
        words(html[at:])
    flush()
    return blocks, tags


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


#: How a token is written before it is hashed.
def tag_token(path: str) -> int:
    return _hash("t" + path)


def text_token(path: tuple, text: str) -> int:
    return _hash(f"x{path[-1] if path else ''}\x00{text}")


def tokens(html: str) -> tuple[dict[int, int], list[tuple[int, str, float, int]]]:
    """Occurrences on a page by token (tags with their path, text nodes with theirs), and what its tags hold.

    The latter: (token, path, place of the first in the page between 0 and 1, characters
    inside that are no link's) of every tag path.
    """
    blocks, tags = parse(html)
    out: dict[int, int] = {}
    place: dict[str, float] = {}
    for i, t in enumerate(tags):
        place.setdefault(t, (i + 1) / (len(tags) + 1))
        h = tag_token(t)
        out[h] = out.get(h, 0) + 1
    held: dict[str, int] = {}
    for b in blocks:
        h = text_token(b.path, b.text)
        out[h] = out.get(h, 0) + 1
        for p in dict.fromkeys(b.path):
            held[p] = held.get(p, 0) + len(b.text) - b.linked
    return out, [(tag_token(p), p, at, held.get(p, 0)) for p, at in place.items()]


def _page_tokens(pages: DataFrame) -> DataFrame:
    """host, page (hash of the html), its tokens with counts, and what its tags hold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tag = pa.list_(pa.struct([("tok", pa.int64()), ("path", pa.string()), ("place", pa.float64()), ("held", pa.int64())]))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                hosts, pages_, keys, counts, tags = [], [], [], [], []
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t, held = tokens(html or "")
                    hosts.append(host_of(url))
                    pages_.append(_hash(html or ""))
                    keys.append(list(t))
                    counts.append(list(t.values()))
                    tags.append([dict(zip(("tok", "path", "place", "held"), h)) for h in held])
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages_, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(tags, tag)], names=["host", "page", "tok", "n", "tags"])

    return pages.select("url", "html").mapInArrow(run, "host string, page long, tok array<long>, n array<int>, tags array<struct<tok:long,path:string,place:double,held:long>>")


def classes(pages: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(host, pages, vec, toks, tags): each host's classes that are large and frequent enough.

    A class is the tokens of equal support and equal occurrence vector (a sum of hashes over
    pages); tags hold those of them that stand once on a page: path, mean place and characters
    held over all pages. Tokens on fewer than ``min_pages`` pages, that is nearly all texts,
    go before anything meets by host.
    """
    each = staged(_page_tokens(pages), "page-tokens")
    once = each.groupBy("host", "page").agg(F.first("tok").alias("tok"), F.first("n").alias("n"), F.first("tags").alias("tags"))  # copies count once
    once = staged(once, "pages-once")
    drop_staged(each)
    long = once.select("host", "page", F.explode(F.arrays_zip("tok", "n")).alias("x")).select("host", "page", "x.tok", "x.n")
    size = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= params.min_pages)
    vec = long.groupBy("host", "tok").agg(F.count(F.lit(1)).alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("vec"), F.max("n").alias("most")).filter(F.col("on") >= params.min_pages)
    often = vec.join(size, "host").filter(F.col("on") >= F.ceil(F.lit(params.support) * F.col("pages")))
    tags = once.select("host", F.explode("tags").alias("x")).groupBy("host", F.col("x.tok").alias("tok")).agg(F.first("x.path").alias("path"), F.avg("x.place").alias("place"), F.sum("x.held").alias("held"))
    full = often.join(tags, ["host", "tok"], "left")
    tag = F.when((F.col("most") == 1) & F.col("path").isNotNull(), F.struct("path", "place", "held"))
    valid = full.groupBy("host", "pages", "on", "vec").agg(F.collect_list("tok").alias("toks"), F.collect_list(tag).alias("tags")).filter(F.size("toks") >= params.min_class)
    return valid.select("host", "pages", "vec", F.array_sort("toks").alias("toks"), F.array_sort("tags").alias("tags"))


def templates(pages: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(host, template, frame): the tokens of each host's valid classes, and its frame tags as (path, place, held) in their order.

    Hosts with fewer than ``min_pages`` distinct pages have no template.
    """
    found = classes(pages, params)
    frame = F.array_sort(F.transform(F.flatten(F.collect_list("tags")), lambda t: F.struct(t["place"].alias("place"), t["path"].alias("path"), t["held"].alias("held"))))
    return found.groupBy("host").agg(F.flatten(F.collect_list("toks")).alias("template"), frame.alias("frame"))


def main_slot(frame: list[tuple[float, str, int]], params: TemplateParams = TemplateParams()) -> str | None:
    """The path of the main slot: from the root down the frame tag with the bulk of the text, while its siblings hold little beside it.

    Frame tags that do not nest (a tag before the one around it) are left out. None: no frame.
    """
    place = {p: at for at, p, _ in frame}
    held = {p: n for _, p, n in frame if all(place.get(q, -1.0) < place[p] for q in _around(p) if q in place)}
    inner: dict = {}
    for p in held:
        up = next((q for q in reversed(_around(p)) if q in held), None)
        inner.setdefault(up, []).append(p)
    at = None
    while True:
        kids = [p for p in inner.get(at, []) if _name(p) not in _HEADING and _name(p) != "p"]
        if not kids:
            return at
        best = max(kids, key=lambda p: (held[p], p))
        around = held[at] if at else sum(held[p] for p in kids)
        if held[best] < params.bulk * around or not held[best] or any(held[p] > params.beside * held[best] for p in kids if p != best):
            return at
        at = best


def _around(path: str) -> list[str]:
    """Paths of the tags around a path, outermost first."""
    steps = path.split("/")
    return ["/".join(steps[:k]) for k in range(1, len(steps))]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(" ", 1)[0]


def extract(html: str | None, template: set[int], main: str | None = None) -> str:
    """Text of the main slot without template text, a block a line.

    Where template text makes up half or more of the text in the slot, the host holds near
    copies, and what they share there is content. Headings that stand before the slot, under the
    tags around it, belong to it. A page without the slot is judged by its markup alone.
    """
    blocks, _ = parse(html or "")
    kept = [b for b in blocks if not b.boiler]
    if main is not None and any(main in b.path for b in kept):
        first = next(i for i, b in enumerate(kept) if main in b.path)
        around = set(_around(main))
        kept = [b for i, b in enumerate(kept) if main in b.path or (i < first and b.heading and all(p in around or _name(p) in _HEADING for p in b.path))]
    same = [text_token(b.path, b.text) in template for b in kept]
    slot = [main is None or main in b.path for b in kept]
    copies = 2 * sum(len(b.text) for b, t, i in zip(kept, same, slot) if t and i) >= sum(len(b.text) for b, i in zip(kept, slot) if i)
    return "\n".join(b.text for b, t, i in zip(kept, same, slot) if not t or (i and copies))


def main_text(pages: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null html gives an empty text, a null url has the host ``""``.

    Repeated rows give repeated rows and count once for the template; an empty table gives no rows;
    other columns take no part.
    """
    found = templates(pages, params)

    def slots(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            frames = [[(f["place"], f["path"], f["held"]) for f in x] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_slot(f, params) for f in frames], pa.string())], names=["host", "template", "main"])

    found = staged(found.mapInArrow(slots, "host string, template array<long>, main string"), "templates")
    url_host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", url_host.alias("host")).join(found, "host", "left").select("page_id", "url", "html", "template", "main")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [extract(h, set(t or ()), m) for h, t, m in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
