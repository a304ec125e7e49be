"""Main-text extraction by deducing each host's page template from equivalence classes of tokens.

A token is a tag in its role, the path of open elements, or a block of text in its role. Tokens of one
host that occur equally often in every page have the same occurrence vector and form an equivalence
class. The vectors are never gathered: each page adds a hash of its count to the token's signature, modulo
2**64, so a host of any size is aggregated in parts. Classes that are frequent are the template: an element
whose start and end are in one class is valid, valid elements nest by their paths, and blocks of text that
nearly all pages have are furniture of the page. What is left between the template's tokens are its slots,
whose sizes follow from the same counts. The main slot is the template's article element or, on hosts
without one, the smallest valid element that holds practically all text which is neither furniture nor
boilerplate. Everything in it is extracted but (where it is the whole body) furniture and nested menus,
headers of the page, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.

Pages are parsed twice, once to count and once to extract, in time linear in their length.

Defined results: null or empty html gives an empty text; a page without the template's main slot is
read by its own article or main element, or else its whole body without boilerplate; a null url counts
as a host without name; a host of fewer than ``LEAST_PAGES`` different pages has no furniture, nor one whose pages have nothing else. Repeated rows
get equal results, and an input without rows gives none. Columns of the input are kept.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm.storage import free_name, materialise
from haulframe.llm.tokens import frugal

#: A class is frequent if its tokens occur in this share of a host's pages.
SUPPORT = 0.5
#: Furniture is a block of text in this share of a host's pages, and in so many different ones.
FURNITURE = 0.8
LEAST_PAGES = 4
#: The main slot of hosts without article elements holds this share of the text that is left.
MAIN_SHARE = 0.95
#: What is known of all hosts is broadcast up to this size together, else joined by host.
BROADCAST_BYTES = 8 << 20
#: A quote in a tag that isn't closed within so many characters is no quote.
QUOTE_REACH = 1 << 16

# Fixed values of the markup language and of customary names in it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer aside form script style noscript template iframe svg head title button select textarea menu dialog object".split())
BOILERPLATE_NAMES = frozenset("ad ads adbox advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus respond cookie cookies consent notice notices alert popup modal newsletter subscribe share sharing social related widget toolbar login signup".split())
HEADER_NAMES = frozenset(("header", "masthead"))
#: What compounds of those names may hold besides, as in sidebar-left or share-buttons.
FILLERS = frozenset("area bar block box buttons container content form inner left links list main outer overlay panel posts primary right secondary section site slot top unit wrap wrapper".split())
#: Their names never make them boilerplate, as generated ids are slugs of the heading; of a section that holds for the id only.
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MAIN = frozenset(("article", "main"))
_CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li td th tr dd dt".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
_STOPS = frozenset(("ul", "ol", "table", "article", "main", "div", "section", "body", "td", "dl", "select"))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that matter for which others end with a new one.
_ENDING = _STOPS | frozenset(_CLOSED_BY)
#: Elements that are no container of an article.
_LEAVES = TEXT_ELEMENTS | frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr".split())


def _hash(text: str) -> int:
    """A signed 64-bit hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _named_dull(names: list[str], dull_names: frozenset[str]) -> bool:
    """Whether one of the names is a boilerplate name or a compound of such and fillers."""
    for name in names:
        parts = {p for p in re.split(r"[_-]+", name) if p}
        if parts & dull_names and parts <= dull_names | FILLERS:
            return True
    return False


_paths: dict[tuple[int, str], int] = {}


class Element:
    """An open element: its name, its role (a hash of the path of names with class, id and role), the role around it, whether it stands in an article, and whether it or one around it is boilerplate."""

    __slots__ = ("name", "path", "parent", "depth", "main", "dull", "size")

    def __init__(self, name: str, attributes: str, above: "Element | None"):
        given = [(m[0].lower(), next(x for x in m[1:] if x).strip().lower()) for m in _NAMED.findall(attributes) if any(m[1:])] if attributes else []
        self.name, self.size = name, 0
        self.depth = above.depth + 1 if above else 1
        self.parent = above.path if above else 0
        key = self.parent, ".".join([name, *(x for _, x in given)])
        if key not in _paths:
            if len(_paths) > 1 << 16:
                _paths.clear()
            _paths[key] = _hash(f"{key[0]}>{key[1]}")
        self.path = _paths[key]
        self.main = name in MAIN or bool(above and above.main)
        # the header of an article belongs to it
        dull_names = BOILERPLATE_NAMES - HEADER_NAMES if self.main else BOILERPLATE_NAMES
        self.dull = bool(above and above.dull) or name in BOILERPLATE or name == "header" and not self.main
        if given and not self.dull and name not in TEXT_ELEMENTS and name not in ("html", "body", *MAIN):
            ids = [x for kind, x in given if kind == "id" and name != "section"]
            names = [y for kind, x in given if kind != "id" for y in x.split()]
            # outside an article one part of a class or role is enough
            self.dull = _named_dull([*ids, *names], dull_names) or not self.main and any(p in dull_names for x in names for p in re.split(r"[_-]+", x))


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, "") in page order; comments and raw contents are left out."""
    at, n, last = 0, len(page), page.rfind(">")
    begin = 0  # of the text that isn't given out yet
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        kind = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end, found = page.find("-->", at + 4), None
            end = n if end < 0 else end + 3
        elif at > last:  # nothing can end any more but a comment
            at += 1
            continue
        elif kind in ("!", "?"):
            end, found = page.find(">", at) + 1, None
        else:
            found = _TAG.match(page, at, at + QUOTE_REACH)
            if found is None:
                named = _NAME.match(page, at)
                if named is None:  # a lone <
                    at += 1
                    continue
                end = page.find(">", named.end()) + 1
                if not end:
                    break
                found = (kind == "/", named[1], page[named.end() : end - 1])
            else:
                end = found.end()
                found = found.groups()
        if begin < at:
            yield "text", page[begin:at], ""
        at = begin = end
        if found is None:
            continue
        name = found[1].lower()
        if found[0]:
            yield "end", name, ""
            continue
        yield "start", name, found[2]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = begin = close.end() if close else n
            yield "end", name, ""
    if begin < n:
        yield "text", page[begin:], ""


def events(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """("start" or "end", element, "") for tags and ("text", element around it, text), in page order.

    Unclosed elements end where the markup says they do; ends without a start are ignored.
    """
    stack: list[Element] = []
    ending: list[int] = []  # places in the stack of elements that may end with others
    open_names: Counter = Counter()

    def pop() -> Element:
        if ending and ending[-1] == len(stack) - 1:
            ending.pop()
        e = stack.pop()
        open_names[e.name] -= 1
        return e

    for kind, name, rest in _tags(page):
        if kind == "text":
            yield "text", stack[-1] if stack else None, name
            continue
        if kind == "end":
            if open_names[name] > 0:
                while True:
                    e = pop()
                    yield "end", e, ""
                    if e.name == name:
                        break
            continue
        while ending:  # elements that this one ends
            place = next((i for i in reversed(ending) if name in _CLOSED_BY.get(stack[i].name, ()) or stack[i].name in _STOPS), -1)
            if place < 0 or name not in _CLOSED_BY.get(stack[place].name, ()):
                break
            while len(stack) > place:
                yield "end", pop(), ""
        element = Element(name, rest, stack[-1] if stack else None)
        yield "start", element, ""
        if name in VOID:
            continue
        if name in _ENDING:
            ending.append(len(stack))
        stack.append(element)
        open_names[name] += 1
    while stack:
        yield "end", pop(), ""


def blocks(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """events, with the text outside boilerplate gathered to ("block", element, text): white space as single spaces, references decoded."""
    held: list[str] = []
    owner: Element | None = None

    def flush() -> Iterator[tuple[str, Element | None, str]]:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            if owner is not None:
                owner.size += len(text)
            yield "block", owner, text

    around: list[Element] = []  # open elements that aren't inline
    for kind, element, text in events(page):
        if kind == "text":
            if not (element and element.dull):
                if not held:
                    owner = around[-1] if around else None
                held.append(text)
            continue
        if element.name == "br":
            if held:
                held.append(" ")
        elif element.name not in INLINE:
            yield from flush()
            if kind == "start" and element.name not in VOID:
                around.append(element)
            elif kind == "end" and around and around[-1] is element:
                around.pop()
                if around:
                    around[-1].size += element.size
        yield kind, element, ""
    yield from flush()


def tokens_of(page: str) -> dict[tuple, list[int]]:
    """Tokens (kind, role, text, name, role around it, depth, boilerplate) of a page with their numbers and characters.

    The kinds are < and / for tags (with the characters of text in the element at /) and T for blocks of text.
    """
    out: dict[tuple, list[int]] = {}
    for kind, e, text in blocks(page):
        if kind == "block":
            token, size = ("T", e.path if e else 0, _hash(text), "", 0, 0, False), len(text)
        else:
            if e.name in INLINE or e.name in VOID:
                continue
            token, size = ("<" if kind == "start" else "/", e.path, 0, e.name, e.parent, e.depth, e.dull), e.size if kind == "end" else 0
        held = out.setdefault(token, [0, 0])
        held[0] += 1
        held[1] += size
    return out


def extract(page: str | None, slots: set[int] | None, furniture: set[tuple[int, int]] | None = None) -> str:
    """The text of the elements whose role is in slots, in page order, but for the furniture (role, hash of the text); see the module for pages without a slot."""
    if not page:
        return ""
    found = list(blocks(page))
    started = {e.path: e for kind, e, _ in found if kind == "start"}
    if not slots or not any(p in started and not started[p].dull for p in slots):
        slots = {e.path for e in started.values() if e.name in MAIN and not e.dull}
    if not slots:
        slots = {e.path for e in started.values() if e.name == "body"} or {0}
    inside = 1 if 0 in slots else 0
    out: list[str] = []
    for kind, e, text in found:
        if kind == "block":
            if inside and not (furniture and not (e and e.main) and (e.path if e else 0, _hash(text)) in furniture):
                out.append(text)
        elif e.path in slots and e.name not in VOID:
            inside += 1 if kind == "start" else -1
    return " ".join(out)


def host_of(url: Column) -> Column:
    """What stands between :// and the next of / ? # in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


_KEY = ["host", "kind", "path", "text", "name", "parent", "depth", "dull"]
_COUNTED = "host string, kind string, path bigint, text bigint, name string, parent bigint, depth int, dull boolean, vector bigint, pages bigint, occurrences bigint, size bigint, seen bigint"
_COUNTED_ARROW = pa.schema([
    ("host", pa.string()), ("kind", pa.string()), ("path", pa.int64()), ("text", pa.int64()), ("name", pa.string()), ("parent", pa.int64()), ("depth", pa.int32()), ("dull", pa.bool_()),
    ("vector", pa.int64()), ("pages", pa.int64()), ("occurrences", pa.int64()), ("size", pa.int64()), ("seen", pa.int64()),
])


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _mixed(key: int, count: int) -> int:
    """A hash of a page and a count."""
    x = (key ^ count * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frugal(batches):
        held: dict[tuple, list[int]] = {}
        for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            mixed: dict[int, int] = {}
            bit = 1 << (_mixed(key, 0) & 63)
            # the token without a kind counts the pages
            for token, (n, size) in [*tokens_of(page or "").items(), (("", 0, 0, "", 0, 0, False), (1, 0))]:
                if n not in mixed:
                    mixed[n] = _mixed(key, n)
                row = held.get((host, *token))
                if row is None:
                    held[(host, *token)] = [mixed[n], 1, n, size, bit]
                else:
                    row[0] += mixed[n]
                    row[1] += 1
                    row[2] += n
                    row[3] += size
                    row[4] |= bit
        rows = [(*k, _signed(v[0]), *v[1:4], _signed(v[4])) for k, v in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_COUNTED_ARROW), _COUNTED_ARROW)], schema=_COUNTED_ARROW)


_DEDUCED = "host string, slots array<bigint>, paths array<bigint>, texts array<bigint>"
_DEDUCED_ARROW = pa.schema([("host", pa.string()), ("slots", pa.list_(pa.int64())), ("paths", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))])


def deduce(tokens: list[dict]) -> tuple[set[int], set[tuple[int, int]]]:
    """Roles of the main slot and the furniture (role, text) from a host's frequent tokens; the counts are those of all its pages.

    tokens: dicts of kind, path, text, name, parent, depth, dull, vector, pages, occurrences, size, different, host_pages.
    """
    classes: dict[tuple, set] = {}  # occurrence vector to its tokens
    by_role: dict[tuple, dict] = {}
    for t in tokens:
        classes.setdefault((t["vector"], t["pages"], t["occurrences"]), set()).add((t["kind"], t["path"], t["text"]))
        by_role[t["kind"], t["path"]] = t
    # valid elements: both ends are in one class
    valid = {p: by_role["/", p] for c in classes.values() for kind, p, _ in c if kind == "<" and ("/", p, 0) in c}

    def above(path: int) -> Iterator[int]:
        """The valid elements around a role, from the inside; the template's nesting."""
        while path in valid:
            yield path
            path = valid[path]["parent"]

    named = {p for p, t in valid.items() if t["name"] in MAIN and not t["dull"]}
    if named:
        return {p for p in named if not any(q in named for q in above(valid[p]["parent"]))}, set()
    texts = [t for t in tokens if t["kind"] == "T" and t["pages"] >= FURNITURE * t["host_pages"] and t["different"] >= LEAST_PAGES]
    left = {p: t["size"] for p, t in valid.items()}  # text of each slot: all in the element but the furniture
    for t in texts:
        for p in above(t["path"]):
            left[p] -= t["size"]
    bodies = [p for p, t in valid.items() if t["name"] == "body"]
    whole = left[bodies[0]] if bodies else max(left.values(), default=0)
    if whole <= 0:  # the pages are all alike
        return set(), set()
    holding = [p for p, t in valid.items() if t["name"] not in _LEAVES and not t["dull"] and left[p] >= MAIN_SHARE * whole]
    deepest = max((valid[p]["depth"] for p in holding), default=0)
    slots = {p for p in holding if valid[p]["depth"] == deepest}
    # within an element of its own the article may well repeat a passage; furniture stands around it
    narrow = all(valid[p]["name"] not in ("html", "body") for p in slots) and bool(slots)
    return slots, set() if narrow else {(t["path"], t["text"]) for t in texts}


def _deduced(table: pa.Table) -> pa.Table:
    slots, furniture = deduce(table.to_pylist())
    known = sorted(furniture)
    return pa.table([pa.array([x], f.type) for x, f in zip((table.column("host")[0].as_py(), sorted(slots), [p for p, _ in known], [t for _, t in known]), _DEDUCED_ARROW)], schema=_DEDUCED_ARROW)


def templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, its main slots (roles), and its furniture as roles and hashes of the texts."""
    keyed = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(page).alias("key"), F.col(page).alias("page"))
    sums = [F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector"), *(F.sum(c).alias(c) for c in ("pages", "occurrences", "size")), F.bit_or("seen").alias("seen")]
    counted = keyed.mapInArrow(_count, _COUNTED).groupBy(*_KEY).agg(*sums).withColumn("different", F.bit_count("seen"))
    # a token of one page alone is part of no template; of most pages these are nearly all blocks of text
    counted = materialise(counted.where("kind = '' OR different > 1"))
    whole = counted.where("kind = ''").select("host", F.col("pages").alias("host_pages"))
    frequent = counted.where("kind <> ''").join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    # the vectors are sums modulo 2**64
    vector = F.pmod(F.col("vector"), F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("string").alias("vector")
    return frequent.select(*_KEY, vector, "pages", "occurrences", "size", "different", "host_pages").groupBy("host").applyInArrow(_deduced, _DEDUCED)


def _read(page_at: int, n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set, set]] = {}
        for batch in frugal(batches):
            texts = []
            hosts, slots, paths, blocks_of = (batch.column(n + k) for k in range(4))
            for i, page in enumerate(batch.column(page_at)):
                host = hosts[i].as_py()
                if host not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[host] = set(slots[i].as_py() or ()), set(zip(paths[i].as_py() or (), blocks_of[i].as_py() or ()))
                texts.append(extract(page.as_py(), *known[host]))
            made = [*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)

    return run


def extract_main(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """pages with text and n_chars (the names are lengthened if pages has them)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    known = materialise(templates(pages, url, page))
    names: list[str] = []
    for n in ("host", "slots", "paths", "texts"):
        names.append(free_name(n, [*pages.columns, *names]))
    host = names[0]
    size = known.agg(F.sum(F.octet_length("host") + 8 * (F.size("slots") + F.size("paths") + F.size("texts")) + 64)).head()[0] or 0
    known = known.toDF(*names)
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    both = pages.withColumn(host, host_of(F.col(url))).join(known, host, "left").select(*pages.columns, *names)
    schema = T.StructType(list(pages.schema.fields))
    for name, kind in (("text", T.StringType()), ("n_chars", T.LongType())):
        schema = schema.add(free_name(name, schema.names), kind)
    at = [c.lower() for c in pages.columns].index(page.lower())
    return both.mapInArrow(_read(at, len(pages.columns), to_arrow_schema(schema)), schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main(pages).select("page_id", "url", "text", "n_chars")
