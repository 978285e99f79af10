"""Main-text extraction by equivalence-class template deduction (after Arasu and
Garcia-Molina, "Extracting Structured Data from Web Pages").

Tokens. A page is read as tokens: an element with its path (tags with their first
class or id, digits made alike), and a text block with its path. Containers that
repeat on a page ("the second div of body") are tokens by their ordinal too: where
all pages of a host have the same number of them, the ordinal tells their roles apart.
A token's occurrence vector over the pages of its host is how often it occurs on each.
Vectors are not stored: a page adds hash(page, count) to an exclusive-or, so tokens of
a host share a vector if, and but for hash collisions only if, they share the sum. One
aggregate with map-side combining thus covers all pages of all hosts, a host with a
third of them included.

Copies. Pages of a host with the same tokens are one page for the template: groups of
copies are no evidence of one. All counts below are of such distinct pages.

Classes. An equivalence class is the tokens of a host with one vector; it is valid if
it has two tokens or more (an element counts as its start and its end) and enough support (``SUPPORT`` of the host's pages or
``ENOUGH`` pages, whichever is less; two at least). Paths make valid classes nest: the
occurrences of an element's token lie inside those of its parent's token.

Template. The elements of valid classes delimit slots. The template decides for each
whether it is open or closed, from all pages of the host:
  text       a block on half of the pages that have its element is fixed: closed
  constant   a slot whose content is the same on all pages: closed
  links      a slot that is mostly links: closed
  named      a slot that most pages name as no content (navigation, header, footer,
             aside, form, advert, notice, comments): closed, unless the names would
             close over ``BULK`` of the host's text and no main element has any: then they
             are wrong, and the slots with most of it open again
  main       article and main elements exclude what is outside of them if they hold a
             tenth of the text that names leave open; else such names are wrong
In main elements ``constant`` and ``text`` need ``ENOUGH`` pages, so that a few near
copies don't make their common paragraphs a template, and ``links`` needs lists.

Extraction. The text of a page is what lies in open slots, in page order. What names
call no content inside an open slot, on so few pages that it is in no class, goes too.
Names are whole classes, or ids of containers; ids of headings and sections, and parts
of slugs, are no names. Names that authors give to parts of a text ("discussion") count
outside of main elements only. A host with one distinct page has no template, and a
template that leaves nothing of a page is none of this page: there the names decide,
by the rules for ``named`` and ``main``. ``by_template`` tells which of the two decided,
``n_slots`` how many slots gave text.

Defined results
  null, empty html   empty text
  broken markup      unclosed elements end with their parent; a cut tag ends the page;
                     where quotes don't match, tags end at the next ">"
  null url           such pages form a host of their own
  repeated rows      each has its row
  ties               slots with equal figures are decided alike
  very long, deep    whole; work and memory in proportion to the page
  extra columns      are ignored, whatever their names
  empty table        empty result
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

SUPPORT = 0.1
ENOUGH = 10
FEW = 3
FIXED = 0.5
LINKS = 0.6
BULK = 0.9
MAIN_SHARE = 0.1
#: Templates are broadcast up to so many numbers in all (8 bytes each).
BROADCAST_NUMBERS = 1_000_000
BROADCAST_ROWS = 20_000
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_PLAIN_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split()
)
_ENDS_P = _BLOCK - {"br", "td", "th", "caption", "option", "legend", "summary", "figcaption"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same kind, up to the elements that hold such.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLD_SIBLINGS = frozenset("ul ol dl table select body".split())
_HOLD_P = frozenset("td th table article section div body blockquote li".split())
#: Containers whose ordinal on a page may tell their role.
_ORDINAL = frozenset("div section table ul ol dl td span center".split())
_OUT = frozenset("nav footer aside form head button".split())
_OUT_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion sidebar side-bar menu navbar navigation nav breadcrumb breadcrumbs pagination pager"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments discussion replies disqus respond"
    " related recommended share sharing social footer masthead widget toolbar skip-link form search".split()
)
#: With these, names of several words are still those of parts of a page ("site-footer").
_PART_WORDS = frozenset(
    "area bar block bottom box buttons container content global header icons inner left links list main outer page panel posts primary right secondary section site top wrap wrapper".split()
)
#: Names that authors give to parts of a text as well: inside of it they count for nothing.
_WEAK_WORDS = frozenset("alert banner consent discussion form menu notice notices promotion recommended related replies respond search share sharing social subscription".split())
#: Elements whose ids name parts of a page; those of headings, sections and text are slugs.
_ID_TAGS = frozenset("div ul ol table header".split())
_MAIN_WORDS = frozenset("article-body articlebody post-content entry-content article-content main-content story-body post-body story maincontent".split())


def host_of(url: str | None) -> str | None:
    if url is None:
        return None
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


ROOT = _hash("page")


@lru_cache(maxsize=1 << 16)
def _path(outer: int, tag: str, name: str) -> int:
    """The token of an element, from that of the element around it."""
    return _hash(str(outer), tag, name)


def _names_of(attributes: str) -> tuple[str, list[str], list[str]]:
    """The name by which the path knows the element, its classes with its role, and
    its ids."""
    found: list[str] = []
    classes, ids = [], []
    for m in _NAME.finditer(attributes):
        names = (m[2] or m[3] or m[4] or "").lower().replace("_", "-").split()
        found += names
        (ids if m[1].lower() == "id" else classes).extend(names)
    return (re.sub(r"\d+", "0", found[0]) if found else ""), classes, ids


def _is_out(name: str, inside: bool) -> bool:
    """Whether a whole name is one of no content; ``inside`` a main element."""
    words = {name} if name in _OUT_WORDS else set(name.split("-"))
    named = words & _OUT_WORDS
    return bool(named - _WEAK_WORDS if inside else named) and words <= _OUT_WORDS | _PART_WORDS


class Node:
    """An element. ``named``: its own names say no content; ``out``: so do its own or
    those of an element around it; ``main``: the outermost main element around it."""

    __slots__ = ("tag", "token", "ordinal", "up", "block", "named", "out", "main", "link", "shut", "held")

    def __init__(self, tag: str, name: str, up: Node | None):
        self.tag, self.up, self.ordinal, self.shut, self.held = tag, up, 0, False, False
        self.named, self.out, self.main = False, False, None
        if up is None:
            self.token, self.block, self.link = ROOT, self, False
        else:
            self.token, self.link = _path(up.token, tag, name), up.link or tag == "a"
            self.block = self if tag in _BLOCK else up.block


def read_page(page: str | None) -> tuple[list[tuple[Node, str | None]], list[Node]]:
    """The text runs with their element, in page order, with a None-text run at each
    block boundary; and all elements, outer before inner, the page itself first."""
    text = page or ""
    root = Node("", "", None)
    stack, runs, nodes = [root], [], [root]
    is_open: Counter[str] = Counter()  # open elements by tag: spares searches
    seen: Counter[int] = Counter()
    mark, at = _MARK, 0

    def say(piece: str) -> None:
        if piece:
            runs.append((stack[-1], html_lib.unescape(piece)))

    def pop_to(k: int) -> None:
        if k == len(stack) - 1:
            last = stack.pop()
            is_open[last.tag] -= 1
            if last.tag in _BLOCK:
                runs.append((stack[-1], None))
            return
        if any(n.tag in _BLOCK for n in stack[k:]):
            runs.append((stack[k - 1], None))
        is_open.subtract(n.tag for n in stack[k:])
        del stack[k:]

    def end_open(tags: set[str], holders: frozenset[str]) -> None:
        if any(is_open[t] > 0 for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return pop_to(k)
                if stack[k].tag in holders:
                    return

    said = 0
    while (opens := _OPENS.search(text, at)) is not None:
        m = mark.match(text, opens.start())
        if m is None and mark is _MARK:
            mark = _PLAIN_MARK
            m = mark.match(text, opens.start())
        if m is None:
            if re.match(r"</?[a-zA-Z]|<!", text[opens.start() : opens.start() + 3]):
                say(text[said : opens.start()])  # a cut tag ends the page
                return runs, nodes
            at = opens.start() + 1
            continue
        say(text[said : m.start()])
        said = at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if stack[-1].tag == tag and len(stack) > 1:
                pop_to(len(stack) - 1)
            elif is_open[tag] > 0:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(text, at)
            said = at = end.end() if end else len(text)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                runs.append((stack[-1], None))
            continue
        if tag in _ENDS_P:
            end_open({"p"}, _HOLD_P)
        if tag in _SIBLINGS:
            end_open(_SIBLINGS[tag], _HOLD_SIBLINGS)
        up = stack[-1]
        name, classes, ids = _names_of(m[3]) if "=" in m[3] else ("", [], [])
        node = Node(tag, name, up)
        is_main = tag in ("article", "main") or not _MAIN_WORDS.isdisjoint(classes + ids)
        inside = up.main is not None
        node.named = tag in _OUT or (tag == "header" and not inside) or (
            tag not in ("html", "body") and not is_main and any(_is_out(w, inside) for w in classes + (ids if tag in _ID_TAGS else []))
        )
        node.out = up.out or node.named
        node.main = up.main or (node if is_main and not node.out else None)
        if tag in _ORDINAL:
            seen[node.token] += 1
            node.ordinal = seen[node.token]
        nodes.append(node)
        if tag in _BLOCK:
            runs.append((node, None))
        if not m[3].endswith("/") or tag in _BLOCK:
            stack.append(node)
            is_open[tag] += 1
    say(text[said:])
    return runs, nodes


class Block(NamedTuple):
    node: Node
    text: str
    linked: int
    links: int


def blocks(runs: list[tuple[Node, str | None]], keep: Callable[[Node], bool]) -> Iterator[Block]:
    """Blocks of the runs to keep, white space made single, with their block element,
    the characters in links, and the links."""
    first, parts, linked, links = None, [], 0, 0
    for node, piece in [*runs, (None, None)]:
        if piece is None:
            if first is not None:
                joined = " ".join("".join(parts).split())
                yield Block(first.block, joined, min(linked, len(joined)), links)
            first, parts, linked, links = None, [], 0, 0
        elif keep(node):
            parts.append(piece)
            if not piece.isspace():
                first = first or node
                if node.link:
                    linked, links = linked + len(piece.strip()), links + 1


def _text_token(node: Node, text_hash: int) -> int:
    return _hash("t", str(node.token), str(text_hash))


def _ordinal_token(node: Node) -> int:
    return _hash("n", str(node.token), str(node.ordinal))


#: What a page says of a token. ``kind`` 0 is an element, the page itself included, 1 a
#: text block, 2 an element by its ordinal; ``n`` the occurrences (of the plain element
#: for kind 2). Content, characters, those in links and links are of what names leave
#: open, in elements that names close of all inside.
TOKEN = "token long, kind byte, n int, content long, chars long, linked long, links long, whole boolean, named boolean, main boolean, inside boolean, heading boolean, parent long"


def page_tokens(page: str | None) -> dict[int, tuple]:
    """token -> the other fields of ``TOKEN``, for tokens with text."""
    runs, nodes = read_page(page)
    held: dict[Node, list[int]] = {}
    out: dict[int, list] = {}
    for named in (False, True):
        for b in blocks(runs, lambda n, named=named: n.out == named):
            h = _hash("t", b.text)
            mine = held.setdefault(b.node, [0, 0, 0, 0])
            mine[:] = _hash(str(mine[0]), str(h)), mine[1] + len(b.text), mine[2] + b.linked, mine[3] + b.links
            if not named:
                found = out.setdefault(_text_token(b.node, h), [1, 0, h, len(b.text), b.linked, b.links, False, False, False, b.node.main is not None, False, b.node.token])
                found[1] += 1
    for node in reversed(nodes):  # inner before outer
        if node in held and node.up is not None and not (node.named and not node.up.out):
            mine, outer = held[node], held.setdefault(node.up, [0, 0, 0, 0])
            outer[:] = _hash(str(outer[0]), str(mine[0])), outer[1] + mine[1], outer[2] + mine[2], outer[3] + mine[3]
    all_open = held.get(nodes[0], [0, 0, 0, 0])[1]
    times = Counter(n.token for n in nodes if n in held or n.ordinal)
    for node in nodes:
        if node not in held:
            continue
        h, chars, linked, links = held[node]
        facts = [
            chars == all_open and not node.out, node.named and not node.up.out, node.main is node, node.main not in (None, node), node.tag in _HEADINGS,
            node.up.token if node.up else 0,
        ]
        found = out.get(node.token)
        if found is None:
            out[node.token] = [0, 1, h, chars, linked, links, *facts]
        else:
            found[1:6] = found[1] + 1, _hash(str(found[2]), str(h)), found[3] + chars, found[4] + linked, found[5] + links
            found[6] = found[3] == all_open and not node.out
        if node.ordinal and times[node.token] > 1:
            out[_ordinal_token(node)] = [2, times[node.token], h, chars, linked, links, *facts[:5], node.token]
    return {k: tuple(v) for k, v in out.items()}


def shut_by_names(found: list[Block]) -> list[Block]:
    """Of blocks that no name closes: those in main elements, if these hold enough."""
    inside = [b for b in found if b.node.main is not None]
    weight = lambda bs: sum(len(b.text) - b.linked for b in bs)
    return inside if inside and weight(inside) >= MAIN_SHARE * weight(found) else found


class Template(NamedTuple):
    closed: frozenset[int]
    reopened: frozenset[int]
    mains: frozenset[int]
    slots: frozenset[int]


NO_TEMPLATE = Template(frozenset(), frozenset(), frozenset(), frozenset())


def main_text(page: str | None, template: Template = NO_TEMPLATE) -> tuple[str, int, bool]:
    """The text, the slots that gave some, and whether the template decided."""
    runs, nodes = read_page(page)
    if template.slots:
        for n in nodes:  # outer before inner
            if n.up is not None:
                own = n.token in template.closed or (n.ordinal and _ordinal_token(n) in template.closed) or (n.named and n.token not in template.reopened)
                n.shut = n.up.shut or bool(own)
                n.held = n.up.held or n.token in template.mains
        texts_closed = bool(template.closed)
        found = [b for b in blocks(runs, lambda n: not n.shut) if not texts_closed or _text_token(b.node, _hash("t", b.text)) not in template.closed]
        if any(b.node.held for b in found):
            found = [b for b in found if b.node.held]
        if found:
            slots = set()
            for b in found:
                n = b.node
                while n.token not in template.slots and n.up is not None:
                    n = n.up
                slots.add(n.token)
            return " ".join(b.text for b in found), len(slots), True
    return " ".join(b.text for b in shut_by_names(list(blocks(runs, lambda n: not n.out)))), 0, False


def host_tokens(pages: DataFrame) -> DataFrame:
    """(host, occurs, and the fields of ``TOKEN``): a row per token of each distinct page
    of each host; ``occurs`` is the token's part in its occurrence vector."""
    names = [f.split()[0] for f in TOKEN.split(", ")]
    kinds = {"long": pa.int64(), "byte": pa.int8(), "int": pa.int32(), "boolean": pa.bool_()}
    shape = pa.schema([("host", pa.string()), ("occurs", pa.int64()), *((f.split()[0], kinds[f.split()[1]]) for f in TOKEN.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for url, page in zip(*batch.columns, strict=True):
                host, found = host_of(url.as_py()), page_tokens(page.as_py())
                key = str(_hash(repr(found)))
                rows += [(host, _hash(key, str(v[1])), token, *v) for token, v in found.items()]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)
                    rows = []
            columns = list(zip(*rows, strict=True)) or [[]] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)

    source = bounded_batches(pages).select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # What a page is told by is in ``occurs``: copies count once.
    return source.mapInArrow(run, f"host string, occurs long, {TOKEN}").select("host", "occurs", *names).distinct()


def templates(pages: DataFrame) -> DataFrame:
    """(host, closed, reopened, mains, slots): the tokens of the template of each host
    that has two distinct pages or more."""
    most = lambda name: (F.avg(F.col(name).cast("int")) > 0.5).alias(name)
    seen = host_tokens(pages).groupBy("host", "token", "kind").agg(
        F.count(F.lit(1)).alias("support"), F.bit_xor("occurs").alias("vector"), F.min("n").alias("n_min"), F.max("n").alias("n_max"),
        (F.min("content") == F.max("content")).alias("constant"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("links").alias("links"),
        F.bool_or("whole").alias("whole"), most("named"), most("main"), most("inside"), F.bool_or("heading").alias("heading"), F.min("parent").alias("parent"),
    ).where("support >= 2")
    seen = checkpointed(seen)
    plain = F.when(F.col("kind") == 0, F.col("chars") - F.col("linked"))
    sizes = seen.groupBy(F.col("host").alias("h")).agg(
        F.max(F.when(F.col("token") == ROOT, F.col("support"))).alias("pages"), F.coalesce(F.sum(F.when(F.col("token") == ROOT, plain)), F.lit(0)).alias("left"),
        F.coalesce(F.sum(F.when(F.col("named"), plain)), F.lit(0)).alias("gone"), F.coalesce(F.sum(F.when(F.col("main"), plain)), F.lit(0)).alias("held"),
    )
    sizes = sizes.withColumn("pages", F.coalesce("pages", F.lit(2)))
    sizes = F.broadcast(sizes) if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else checkpointed(sizes)
    enough = F.greatest(F.lit(2.0), F.least(F.lit(SUPPORT) * F.col("pages"), F.lit(float(ENOUGH))))
    wide = checkpointed(seen.join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("support") >= enough).drop("h"))
    classes = checkpointed(wide.groupBy(F.col("host").alias("h"), F.col("vector").alias("v")).agg(F.sum(F.when(F.col("kind") == 1, 1).otherwise(2)).alias("size")).where("size >= 2").drop("size"))
    valid = wide.join(classes, F.col("host").eqNullSafe(F.col("h")) & (F.col("vector") == F.col("v")), "left_semi")
    few = F.when(F.col("inside") | F.col("main"), float(ENOUGH)).otherwise(float(FEW))
    elements = valid.where("kind <> 1")
    once = F.when(F.col("kind") == 0, F.col("n_max") == 1).otherwise(F.col("n_min") == F.col("n_max")) & ~F.col("whole")
    lists = ~F.col("heading") & (~(F.col("inside") | F.col("main")) | (F.col("links") >= 3 * F.col("support")))
    constant = once & F.col("constant") & (F.col("support") >= few)
    linked = once & (F.col("linked") > LINKS * F.col("chars")) & lists
    text = F.col("left") + F.col("gone")
    reopened = F.col("named") & (F.col("held") == 0) & (F.col("gone") > BULK * text) & (F.col("chars") - F.col("linked") >= 0.5 * text) & (F.col("support") >= FEW) & ~F.col("constant")
    mains = F.col("main") & (F.col("held") >= MAIN_SHARE * F.col("left"))
    decided = elements.select(
        "host", "token", (constant | linked | (F.col("named") & ~reopened)).alias("closed"), reopened.alias("reopened"), mains.alias("mains"), (F.col("kind") == 0).alias("slots"),
    )
    around = checkpointed(wide.where("kind = 0").select(F.col("host").alias("h"), F.col("token").alias("t"), F.col("support").alias("around")))
    fixed = (
        valid.where("kind = 1").join(around, F.col("host").eqNullSafe(F.col("h")) & (F.col("parent") == F.col("t")))
        .where(F.col("support") >= F.greatest(few, F.lit(FIXED) * F.col("around")))
        .select("host", "token", F.lit(True).alias("closed"), F.lit(False).alias("reopened"), F.lit(False).alias("mains"), F.lit(False).alias("slots"))
    )
    pick = lambda name: F.collect_set(F.when(F.col(name), F.col("token"))).alias(name)
    return decided.unionByName(fixed).groupBy("host").agg(pick("closed"), pick("reopened"), pick("mains"), F.collect_set(F.when(F.col("slots") & ~F.col("closed"), F.col("token"))).alias("slots"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_slots, by_template) of each row of ``pages`` (page_id,
    url, html)."""
    found = checkpointed(templates(pages))
    size = found.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("closed") + F.size("reopened") + F.size("mains") + F.size("slots")), F.lit(0)).alias("numbers")).first()
    if size["rows"] <= BROADCAST_ROWS and size["numbers"] <= BROADCAST_NUMBERS:
        found = F.broadcast(found)

    @F.pandas_udf("string")
    def hosts(urls):
        return urls.map(host_of, na_action="ignore")

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    joined = source.withColumn("h", hosts("url")).join(found, F.col("h").eqNullSafe(F.col("host")), "left").select("page_id", "url", "html", "closed", "reopened", "mains", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, slots, told = [], [], []
            for i in range(batch.num_rows):
                template = Template(*(frozenset(batch.column(c)[i].as_py() or ()) for c in range(3, 7)))
                text, n, by_template = main_text(batch.column(2)[i].as_py(), template)
                texts.append(text)
                slots.append(n)
                told.append(by_template)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(slots, pa.int32()), pa.array(told, pa.bool_())], names=["page_id", "url", "text", "n_slots", "by_template"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_slots int, by_template boolean")
