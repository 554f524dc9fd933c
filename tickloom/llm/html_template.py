"""Main text of web pages by template deduction with equivalence classes.

A page is a stream of tokens: elements, told apart by the path of steps (tag and normalised class) above them, and
texts, told apart by their element and wording. Over the different pages of a host, tokens whose occurrence vectors
are equal (the same count on the same pages) form an equivalence class; the vectors are compared by sums of hashes
that Spark aggregates, so a host with a third of all pages costs one row a token and task. A class of two tokens or
more on most pages is valid, and a valid class nests in the one its tokens lie under: an element belongs to the
template if its class is valid and its parent belongs to it. What is not of the template fills the slots of the
nearest template element around it.

Slots, not pages, are judged: a slot whose text is mostly links, or that lies in furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments; told by tags, roles and, as a hint, names), is no article's. A
template element that holds half of the host's text is no furniture. Names that an article may use as well count only for elements of the template. Texts of
the template (the same words on nearly all pages) outside article and main elements are boilerplate, unless they are
most of what a page says. What the other slots hold is the article; a last pass reads it out of every page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, join_by_key
from tickloom.llm.url_templates import host_of
from tickloom.ship import in_arrow

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SILENT = frozenset("script style noscript template svg head title textarea select button iframe object canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: A start tag of the key closes these open elements.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"caption"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
SCOPES = frozenset("table td th ul ol dl body article section main aside nav header footer form div".split())
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Names of furniture, and names that an article's own parts may have too.
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|menu|nav\w*|breadcrumbs?|sidebar|aside|footer|header|masthead|topbar|toolbar|cookies?|consent|gdpr|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|widget|comments?|commentlist|disqus|replies|pagination|pager|skip)(?:$|[-_\s\d])",
    re.I,
)
WEAK = re.compile(r"(?:^|[-_\s])(?:promo\w*|side|notices?|alert|share|sharing|social|related|recommend\w*|reply|respond|discussion|copyright|legal|disclaimer)(?:$|[-_\s\d])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: How sure an element is furniture by itself: not, by a weak name, or surely.
PLAIN, MAYBE, SURE = 0, 1, 2
#: The page itself, parent of all.
ROOT = 0
SETS = ["roles", "texts", "out", "cleared"]


class Element(NamedTuple):
    role: int
    parent: int
    hint: int
    titled: bool


class Block(NamedTuple):
    element: int
    text: str
    linked: int


def _id(*parts: object) -> int:
    """A hash as a signed long."""
    made = xxhash.xxh64_intdigest("/".join(map(str, parts)))
    return made - (1 << 64) if made >> 63 else made


@lru_cache(1 << 16)
def _child(role: int, step: str) -> int:
    return _id(role, step)


@lru_cache(1 << 14)
def _named(tag: str, attributes: str) -> tuple[str, int]:
    """The element's step in a path, and how sure it is furniture by its tag, name, role or style."""
    step, hint = tag, SURE if tag in FURNITURE else PLAIN
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return step, hint
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main"):
                hint = max(hint, SURE if NAMES.search(value) else MAYBE if WEAK.search(value) else PLAIN)
            if name == "class" and value.split():
                step += "." + re.sub(r"[\d/]+", "0", ".".join(sorted(value.split())))
        elif name == "role":
            hint = max(hint, SURE if value.strip().lower() in ROLES else PLAIN)
        elif name == "style":
            hint = max(hint, SURE if HIDDEN.search(value) else PLAIN)
        elif name == "hidden" or value.strip().lower() == "true":
            hint = SURE
    return step, hint


def parse(page: str | None) -> tuple[list[Element], list[Block]]:
    """Elements (the first is the page), and text blocks in page order with the number of their element.

    Broken markup never raises; time and memory are linear in the page, however deep it nests.
    """
    elements, blocks = [Element(ROOT, -1, PLAIN, False)], []
    if not page:
        return elements, blocks
    stack: list[tuple[str, int, bool]] = []  # tag, element, silent
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split()) if text else ""
        if whole:
            blocks.append(Block(stack[-1][1] if stack else 0, whole, linked))
        text.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][2]):
            made = html.unescape(raw) if "&" in raw else raw
            text.append(made)
            if links:
                linked += len(made.strip())

    def close(down_to: int) -> None:
        flush()
        for tag, *_ in stack[down_to:]:
            opened[tag] -= 1
        del stack[down_to:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in SILENT:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in SCOPES and tag in ("p", "li", "dt", "dd", "td", "th", "tr"):
                    break
            else:
                if tag == "p":
                    flush()
            continue
        flush()
        if tag in BLOCKS:
            links = 0 if tag not in ("li", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6") else links
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in SCOPES), -1) if opened["p"] else -1
            if k >= 0 and stack[k][0] == "p":
                close(k)
            for k in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in ("td", "th", "div") or stack[k][0] == "table":
                    break
        step, hint = _named(tag, m[3])
        parent, silent = stack[-1][1:] if stack else (0, False)
        above = elements[parent]
        if tag == "header" and not above.titled:
            hint = SURE  # an article's own header is part of it; one outside is the site's
        elements.append(Element(_child(above.role, step), parent, hint, above.titled or tag in ("article", "main")))
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else end
            if stop:
                shut = page.find(">", at)
                at = end if shut < 0 else shut + 1
            continue
        stack.append((tag, len(elements) - 1, silent or tag in SILENT))
        opened[tag] += 1
    flush()
    return elements, blocks


def text_role(element: Element, text: str) -> int:
    return _id(element.role, "text", text)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each token on each page as sums by host: pages, occurrences and two sums of hashes of (page, count)."""
    names = ["host", "role", "text", "pages", "n", "one", "two"]
    for batch in batches:
        sums: dict[tuple[str, int, bool], list[int]] = {}
        for host, key, page in zip(batch.column("host").to_pylist(), batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
            elements, blocks = parse(page.as_py())
            seen = Counter((e.role, False) for e in elements)
            seen.update((text_role(elements[b.element], b.text), True) for b in blocks)
            for (role, text), n in seen.items():
                row = sums.setdefault((host, role, text), [0] * 4)
                mark = xxhash.xxh64_intdigest(f"{key}:{n}")
                for k, x in enumerate((1, n, mark >> 33, mark & 0x7FFFFFFF)):
                    row[k] += x
        rows = [(*k, *v) for k, v in sums.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)


def _rows(pages: DataFrame) -> DataFrame:
    url, page = F.col("url").cast("string"), F.col("html").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), page.alias("html"))


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """host, role, text, pages, class for each token: those of one host with equal occurrence vectors have one class."""
    vector = F.struct("pages", "n", "one", "two")
    return tokens.withColumn("class", F.xxhash64("host", vector))


def deduce(pages: DataFrame, common: float = 0.5, repeated: float = 0.8, least: int = 5) -> DataFrame:
    """host, n, roles, texts: number of pages, template elements and template texts of each host.

    A class is valid if it has two tokens or more and is on at least `common` of the host's pages, so a host's template
    has at most 1 / `common` times the tokens of a page. Texts are of the template if they are on `repeated` of the
    pages of a host that has `least` or more. Null and empty html is a page without tokens of its own, and null
    addresses share the empty host.
    """
    rows = _rows(pages)
    schema = "host string, role long, text boolean, pages long, n long, one long, two long"
    tokens = in_arrow(rows.select("host", "page_id", "html"), _tokens, schema)
    tokens = checkpointed(tokens.groupBy("host", "role", "text").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "one", "two"))))
    many = tokens.where((F.col("role") == ROOT) & ~F.col("text")).select("host", F.col("pages").alias("host_pages"))
    classes = equivalence_classes(tokens)
    sizes = classes.groupBy("class").agg(F.count("*").alias("size"))
    often = F.when(F.col("text"), (F.col("pages") >= repeated * F.col("host_pages")) & (F.col("host_pages") >= least)).otherwise(F.col("pages") >= common * F.col("host_pages"))
    valid = classes.join(many, "host").where(often).join(sizes.where("size > 1"), "class", "left_semi")
    made = valid.groupBy("host").agg(F.collect_list(F.when(~F.col("text"), F.col("role"))).alias("roles"), F.collect_list(F.when(F.col("text"), F.col("role"))).alias("texts"))
    return checkpointed(many.join(made, "host", "left").select("host", F.col("host_pages").alias("n"), "roles", "texts"))


def _with_template(rows: DataFrame, templates: DataFrame, columns: list[str], most: int = 4_000_000) -> DataFrame:
    """Rows with the columns of their host's template: broadcast where these are `most` ids at most, else joined by host."""
    sizes = templates.agg(F.count("*"), F.sum("n"), *(F.sum(F.coalesce(F.size(c), F.lit(0))) for c in columns)).first()
    if sizes[0] + sum(x or 0 for x in sizes[2:]) <= most:
        return rows.join(F.broadcast(templates.select("host", *columns)), "host")
    return join_by_key(rows, templates.select("host", "n", *columns), "host", "n", sizes[1])


def slots_of(elements: list[Element], roles: set[int], cleared: set[int] = frozenset()) -> tuple[list[int], list[bool]]:
    """For each element its slot (the nearest template element, by number), and whether it lies in furniture.

    An element belongs to the template if its role does and its parent belongs to it. Template elements that are
    `cleared` are no furniture, whatever their hint.
    """
    slot, odd = [0], [False]
    for k, e in enumerate(elements[1:], 1):
        member = slot[e.parent] == e.parent and e.role in roles
        hinted = e.hint == SURE or e.hint == MAYBE and member
        slot.append(k if member else slot[e.parent])
        odd.append(odd[e.parent] or hinted and not (member and e.role in cleared))
    return slot, odd


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and linked text of each slot of a host, and, apart, of all that lies in a template element with a hint."""
    for batch in batches:
        sums: dict[tuple[str, int, bool], list[int]] = {}
        for host, page, roles in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("roles"), strict=True):
            elements, blocks = parse(page.as_py())
            slot, _ = slots_of(elements, set(roles.as_py() or ()))
            mass = [[0, 0] for _ in elements]
            for b in blocks:
                for row in (mass[b.element], sums.setdefault((host, elements[slot[b.element]].role, False), [0, 0])):
                    row[0] += len(b.text)
                    row[1] += b.linked
            for k in range(len(elements) - 1, 0, -1):
                e = elements[k]
                rows = [mass[e.parent]]
                if slot[k] == k and e.hint != PLAIN and mass[k][0]:
                    rows.append(sums.setdefault((host, e.role, True), [0, 0]))
                for row in rows:
                    row[0] += mass[k][0]
                    row[1] += mass[k][1]
        rows = [(*k, *v) for k, v in sums.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["host", "slot", "hinted", "chars", "linked"])


def judge_slots(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """The templates with `out` and `cleared`: slots that are no article's for their links, and elements that are no
    furniture although they look like it, as they hold half of their host's text or more, and not mostly links."""
    rows = _with_template(_rows(pages).select("host", "html"), templates, ["roles"])
    slots = in_arrow(rows.select("host", "html", "roles"), _slots, "host string, slot long, hinted boolean, chars long, linked long")
    slots = checkpointed(slots.groupBy("host", "slot", "hinted").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    total = slots.where("not hinted").groupBy("host").agg(F.sum("chars").alias("total"))
    links = 2 * F.col("linked") > F.col("chars")
    judged = slots.join(total, "host").groupBy("host").agg(
        F.collect_list(F.when(links & ~F.col("hinted"), F.col("slot"))).alias("out"), F.collect_list(F.when(F.col("hinted") & ~links & (2 * F.col("chars") >= F.col("total")), F.col("slot"))).alias("cleared")
    )
    return checkpointed(templates.join(judged, "host", "left"))


def article(page: str | None, roles: set[int], texts: set[int], out: set[int], cleared: set[int]) -> str:
    """The blocks in the article's slots of a page, without texts of the template unless they are half of what is there."""
    elements, blocks = parse(page)
    slot, odd = slots_of(elements, roles, cleared)
    found = [b for b in blocks if not odd[b.element] and elements[slot[b.element]].role not in out]
    # what stands within an article or main element on page after page is the site's way of writing, not its frame
    own = [b for b in found if elements[b.element].titled or text_role(elements[b.element], b.text) not in texts] if texts else found
    # where most of a page is on the other pages too, these are copies of one article
    if 2 * sum(len(b.text) for b in own) > sum(len(b.text) for b in found):
        found = own
    return "\n\n".join(b.text for b in found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row; null and empty html gives an empty text.

    Null addresses share the empty host. Repeated rows each have theirs; extra columns are ignored.
    """
    templates = judge_slots(pages, deduce(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*([set(x.as_py() or ()) for x in batch.column(c)] for c in SETS), strict=True)
            texts = [article(h.as_py(), *own) for h, own in zip(batch.column("html"), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = _with_template(_rows(pages), templates, SETS).select("page_id", "url", "html", *SETS)
    return in_arrow(joined, run, "page_id long, url string, text string, n_chars long")
