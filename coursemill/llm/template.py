"""Main text of HTML pages by deducing the page template of each host.

A token is a tag or a text node together with the path of elements around it. Tokens of one host
that occur equally often in the same pages (equal occurrence vectors) were written by the same part
of the page template: they form an equivalence class. A class counts if it is large (several
tokens), frequent (nearly all pages of the host) and valid: in a page its tokens come in one order,
and its spans nest with those of other classes. The valid classes, nested, are the template; what
lies between their tokens are slots, the data of the page.

A page's text is taken from the slots inside its article. Without an article element, it is the
smallest template element that holds most of the slot text. Parts that are menus, adverts, forms,
comments and the like by element or attribute never count. Template text (text nodes that nearly
all pages share) is dropped inside article elements too. Occurrence vectors are over the distinct
contents of a host: copies of one article are one page, whatever surrounds them, and do not turn the
article into template.

Occurrence vectors are compared by an order-free hash (xor over contents of a hash of content and count),
so they aggregate before and after the shuffle, and a host with most of the pages is no large group.
A host's template has at most (tokens of a page / support) entries, whatever the number of pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.session import materialise

#: Share of a host's pages that a template token occurs in, tokens in a class, pages of a host.
SUPPORT = 0.95
LEAST_CLASS = 3
LEAST_PAGES = 3
#: Share of a page's slot text that its main element holds, where it has no article element.
MAIN_SHARE = 0.6
#: Pages whose tokens a task holds before it hands them on.
HELD_PAGES = 500

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
NEVER = frozenset("head nav footer aside form button select label menu dialog audio video canvas input".split())
MAIN = frozenset("article main".split())
# Words in class, id or role that mark a part as no main text.
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments commentlist respond reply replies disqus discussion share sharing social "
    "related recommended widget complementary contentinfo search toolbar pagination pager".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")


@dataclass(slots=True)
class Node:
    """An open element: its place in the path, and what its text belongs to."""

    tag: str
    path: str
    dropped: bool
    main: bool
    number: int


@dataclass(slots=True)
class Token:
    """A tag or text node; ``inner`` numbers the elements around it, outermost first."""

    role: str
    text: str | None
    breaks: bool
    dropped: bool
    main: bool
    inner: tuple[int, ...]


def _attributes(source: str) -> tuple[str, bool, bool]:
    """(class as a path mark, boilerplate, main) of a tag's attributes."""
    mark, boilerplate, main = "", False, False
    for name, value in ATTRIBUTE.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name == "class":
            mark = "." + ".".join(sorted(value.lower().split()))
        if name in ("class", "id", "role"):
            words = {w.lower() for w in NAME_PARTS.findall(value)}
            boilerplate |= not words.isdisjoint(BOILERPLATE)
            main |= name == "role" and value.lower() == "main"
        elif name == "itemprop":
            main |= value == "articleBody"
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            boilerplate = True
        elif name == "style":
            boilerplate |= "display:none" in value.replace(" ", "").lower()
    return mark, boilerplate, main


# An opening tag of the key ends an open element of the values.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def tokenise(source: str) -> list[Token]:
    """Tags and text nodes in page order; scripts, styles, comments and the document's title are left out."""
    tokens: list[Token] = []
    stack = [Node("", "", False, False, 0)]
    inner: tuple[int, ...] = (0,)
    number, at, size = 0, 0, len(source)
    while at < size:
        m = TOKEN.match(source, at)
        at = m.end()
        top = stack[-1]
        text = m["text"]
        if text is not None:
            text = entities.unescape(text) if "&" in text else text
            tokens.append(Token(top.path + "#", text, False, top.dropped, top.main, inner))
            continue
        tag, closing, attrs = (m["tag"], m["close"], m["attrs"]) if m["tag"] else (m["tag2"], m["close2"], m["attrs2"])
        if not tag:
            continue
        if m["tag2"] and not source[:at].endswith(">"):
            break  # the page ends inside a tag
        tag = tag.lower()
        if closing:
            if tag == "p" or tag in BLOCKS or any(n.tag == tag for n in stack):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        gone = stack[depth]
                        del stack[depth:]
                        inner = tuple(n.number for n in stack)
                        tokens.append(Token(f"/{gone.path}", None, tag in BLOCKS, True, False, inner))
                        break
                    if stack[depth].tag in MAIN and tag not in ("body", "html"):
                        break  # a stray end tag doesn't end the article
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            if not attrs.endswith("/"):
                at = end.end() if end else size
            continue
        if tag in BLOCKS and top.tag == "p":
            stack.pop()
            top = stack[-1]
        ends = CLOSED_BY.get(tag, ())
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ends:
                del stack[depth:]
                break
            if stack[depth].tag in ("ul", "ol", "dl", "table", "article", "main"):
                break
        top = stack[-1]
        structural = tag in BLOCKS or tag in NEVER or tag in ("td", "th", "span", "a")
        mark, boilerplate, main = _attributes(attrs) if attrs else ("", False, False)
        path = f"{top.path}/{tag}{mark}"
        main = main or tag in MAIN
        dropped = tag in NEVER or (boilerplate and tag not in ("body", "html", "article", "main")) or (tag == "header" and not top.main)
        number += 1
        # words between cells stay apart
        tokens.append(Token(path, " " if tag in ("br", "td", "th") else None, tag in BLOCKS, top.dropped or dropped, top.main or main, (*(n.number for n in stack), number)))
        if tag not in VOID and structural and not attrs.endswith("/"):
            stack.append(Node(tag, path, top.dropped or dropped, top.main or main, number))
        inner = tuple(n.number for n in stack)
    return tokens


def role_hash(token: Token) -> int | None:
    """The token's kind: its path, and for text nodes the words too. White space has none."""
    if token.text is None:
        return xxhash.xxh64_intdigest(token.role) >> 1
    words = " ".join(token.text.split())
    return xxhash.xxh64_intdigest(f"{token.role}{words}") >> 1 if words else None


def content_hash(tokens: list[Token]) -> int:
    """What makes pages copies of each other: the text of their main elements, or all text where there is none."""
    lines = [(t.main and not t.dropped, " ".join(t.text.split())) for t in tokens if t.text is not None]
    main = [words for inside, words in lines if inside and words]
    return xxhash.xxh64_intdigest("\n".join(main or [words for _, words in lines if words])) >> 1


PAGES = "host string, content long, roles array<long>, counts array<int>, places array<int>"


def page_statistics(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, occurrences, a hash of the occurrence vector and the mean first place.

    Pages of one host with equal content (see ``content_hash``) count once. The role -1 counts the pages of a host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, HELD_PAGES):
                part = batch.slice(start, HELD_PAGES)
                contents, sizes, roles, numbers, places = [], [0], [], [], []
                for source in part.column("html").to_pylist():
                    tokens = tokenise(source)
                    counts: dict[int, list[int]] = {-1: [1, 0]}
                    for place, token in enumerate(tokens):
                        role = role_hash(token)
                        if role is not None:
                            counts.setdefault(role, [0, place])[0] += 1
                    contents.append(content_hash(tokens))
                    sizes.append(len(counts))
                    roles.extend(counts)
                    numbers.extend(n for n, _ in counts.values())
                    places.extend(place for _, place in counts.values())
                offsets = pa.array(np.cumsum(sizes), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((roles, pa.int64()), (numbers, pa.int32()), (places, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array(contents, pa.int64()), *lists], ["host", "content", "roles", "counts", "places"]
                )

    seen = pages.select("host", "html").mapInArrow(run, PAGES)
    distinct = seen.groupBy("host", "content").agg(F.min(F.struct("roles", "counts", "places")).alias("page"))
    tokens = distinct.select("host", "content", F.explode(F.arrays_zip("page.roles", "page.counts", "page.places")).alias("token"))
    return (
        tokens.select("host", "content", F.col("token.roles").alias("role"), F.col("token.counts").alias("n"), F.col("token.places").alias("place"))
        .groupBy("host", "role")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum("n").alias("occurrences"),
            F.bit_xor(F.xxhash64("content", "n")).alias("vector"),
            F.avg("place").alias("place"),
        )
    )


def templates(stats: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per host: ``template``, its frequent large classes as (role, class, place) entries."""
    hosts = stats.where("role = -1").select("host", F.col("pages").alias("_all"))
    frequent = (
        stats.where("role <> -1")
        .join(hosts.where(F.col("_all") >= LEAST_PAGES), "host")
        .where(F.col("pages") >= F.col("_all") * F.lit(support))
    )
    kind = F.xxhash64("pages", "occurrences", "vector")
    entries = F.sort_array(F.collect_list(F.struct("place", "role", kind.alias("kind"))))
    return frequent.groupBy("host").agg(entries.alias("template"))


@dataclass
class Template:
    """Role to class, and each class's roles in template order."""

    kinds: dict[int, int] = field(default_factory=dict)
    order: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, entries) -> Template:
        made = cls()
        for entry in [] if entries is None else entries:
            made.order.setdefault(entry["kind"], []).append(entry["role"])
        made.order = {k: v for k, v in made.order.items() if len(v) >= LEAST_CLASS}
        made.kinds = {role: k for k, v in made.order.items() for role in v}
        return made


def valid_classes(roles: list[int | None], template: Template) -> set[int]:
    """Classes whose tokens come equally often and in order on this page, and nest with larger ones."""
    seen: dict[int, list[int]] = {}
    for place, role in enumerate(roles):
        kind = template.kinds.get(role)
        if kind is not None:
            seen.setdefault(kind, []).append(place)
    valid: dict[int, tuple[int, int]] = {}
    for kind, places in sorted(seen.items(), key=lambda x: (-len(template.order[x[0]]), x[0])):
        width = len(template.order[kind])
        first = [roles[p] for p in places[:width]]
        in_order = len(places) % width == 0 and all(roles[p] == first[i % width] for i, p in enumerate(places))
        span = (places[0], places[-1])
        if in_order and len(set(first)) == width and all(
            span[1] < a or b < span[0] or (a <= span[0] and span[1] <= b) or (span[0] <= a and b <= span[1]) for a, b in valid.values()
        ):
            valid[kind] = span
    return set(valid)


def _blocks(tokens: list[Token], taken: list[bool]) -> str:
    blocks, open_text = [], []
    for token, take in zip(tokens, taken):
        if token.breaks and open_text:
            blocks.append("".join(open_text))
            open_text = []
        if take and token.text is not None:
            open_text.append(token.text)
    blocks.append("".join(open_text))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(source: str, template: Template) -> str:
    """The page's main text: one line per block."""
    tokens = tokenise(source)
    roles = [role_hash(t) for t in tokens]
    valid = valid_classes(roles, template)
    in_template = [template.kinds.get(r) in valid for r in roles]
    slots = [t.text is not None and not t.dropped and not f for t, f in zip(tokens, in_template)]
    if any(t.main and not t.dropped and t.text and t.text.strip() for t in tokens):
        return _blocks(tokens, [s and t.main for t, s in zip(tokens, slots)])
    if not any(s and t.text.strip() for t, s in zip(tokens, slots)):
        return _blocks(tokens, [not t.dropped for t in tokens])
    inside: dict[int, int] = {}
    for token, slot in zip(tokens, slots):
        if slot:
            size = len("".join(token.text.split()))
            for number in token.inner:
                inside[number] = inside.get(number, 0) + size
    templated = {0} | {t.inner[-1] for t, f in zip(tokens, in_template) if f and t.text is None and not t.role.startswith("/")}
    total = inside.get(0, 0)
    main = max((n for n in templated if inside.get(n, 0) >= MAIN_SHARE * total), key=lambda n: n)
    return _blocks(tokens, [s and main in t.inner for t, s in zip(tokens, slots)])


def host_of(url):
    """Lower-case host of a url column without user and port; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def main_texts(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null html is an empty page, whose text is empty. Pages without a url share the host ''. Repeated
    rows are extracted alike. Hosts with fewer than three pages have no template; their pages rely on
    elements and attributes alone. Other columns are ignored; an empty table gives an empty result.
    """
    held = pages.select(
        F.col("page_id").cast("long"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        host_of("url").alias("host"),
    )
    known = materialise(templates(page_statistics(held), support), "templates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for host, source, entries in zip(batch["host"], batch["html"], batch["template"]):
                if host not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[host] = Template.of(entries)
                texts.append(extract(source, made[host]))
            yield pd.DataFrame(
                {"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], dtype="int64")}
            )

    return held.join(known, "host", "left").mapInPandas(run, "page_id long, url string, text string, n_chars long")
