"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements (named by their path of block elements, with class and id) and its text blocks. A
token's occurrence vector over a host's pages says how often each page holds it; tokens of one vector form a class.
Vectors aren't gathered: an exclusive-or of hashes of (page, number) stands for one, so that classes come from
two grouped aggregations, whatever a host's size. Pages of a host with the same html count once.

A class is valid if it spans enough of the host's pages, holds several tokens, and occurs once a page, so that its
tokens nest by their paths. The elements of valid classes are the host's template; what lies in an element but in none
of the template's inner ones is its slot. Text blocks of valid classes outside articles are the template's own text.
The slot of the innermost template element that holds most of what isn't a menu, a notice or template text is the
content (with the article around it, or the headings beside it), and a page's text is what that slot holds.

Inside articles two kinds of elements are no content: those with a class, id or role that hold the same text on most of
the host's pages and no other text on any, and those that stand on several pages, any number of times on each, and
whose name speaks of notices, adverts or comments. Headings are neither, and text without such an element stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rename_columns, slices, texts, written


@dataclass(frozen=True)
class Params:
    """pages, share: of a host's pages that a valid class spans at least. tokens: that it holds at least. cover: share
    of the open text that the content element holds where there are no articles. links: share of linked text that
    makes a block a menu's. broadcast_bytes: up to which the templates are sent whole to the tasks; they are joined otherwise."""

    pages: int = 3
    share: float = 0.6
    tokens: int = 3
    cover: float = 0.8
    links: float = 0.9
    broadcast_bytes: int = 32 << 20


# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog button select option fieldset audio video canvas".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
#: Words of classes, ids and roles that name what is no article text.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies discussion reactions related recommended recommendations pagination pager widget toolbar copyright legal "
    "footer masthead topbar skip search complementary contentinfo hidden".split()
)
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<odd>[^>]*+)(?:>|\Z)))""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)")
_HEADING = re.compile("h[1-6]|hgroup")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A block's text, the path of block elements around it and their numbers in the page, whether it lies in an
    article, outside of any content by its elements' names, and among links only; and the paths of elements around it,
    in an article, that have a class, id or role and aren't headings."""

    text: str
    path: tuple[str, ...]
    article: bool
    outside: bool
    linked: bool
    opened: tuple[int, ...] = ()
    named: tuple[str, ...] = ()


def _names(attrs: str) -> tuple[str, bool]:
    """What names an element besides its tag (digits left out), and whether that marks it as no article text."""
    label, marked = "", False
    for m in _NAMED.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "hidden":
            marked = True
        else:
            label += "." + re.sub(r"[0-9]+", "", value).strip()
            marked |= _speaks(value)
    return label, marked


def _speaks(name: str) -> bool:
    return any(w.lower() in MARKS for w in _SPLIT.split(name))


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in its order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, int, bool]] = []  # tag, name in the path, outside, article, number, named
    opened = 0
    held: list[str] = []
    linked = total = 0
    in_link = at = 0

    def flush() -> None:
        nonlocal linked, total
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            top = stack[-1] if stack else ("", "", False, False, 0, False)
            path = tuple(s[1] for s in stack)
            named = tuple("/".join(path[: i + 1]) for i, s in enumerate(stack) if s[5])
            out.append(Block(text, path, top[3], top[2], linked >= 0.9 * total, tuple(s[4] for s in stack), named))
        linked = total = 0

    def add(part: str) -> None:
        nonlocal linked, total
        if part:
            held.append(part)
            n = len(part.strip())
            total += n
            linked += n * bool(in_link)

    while (m := _TAG.search(html, at)) is not None:
        add(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "a":
                in_link = max(in_link - 1, 0)
            if tag not in INLINE:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        attrs = m["attrs"] or m["odd"] or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else len(html)
            if tag not in ("svg", "math", "object", "script", "style", "noscript"):
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link += 1
            elif tag == "br":
                add(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
            stack.pop()
        label, marked = _names(attrs) if attrs else ("", False)
        before = stack[-1] if stack else ("", "", False, False, 0, False)
        article = before[3] or tag in ("article", "main")
        marked = marked and tag not in ("html", "body", "article", "main")
        bad = before[2] or tag in OUTSIDE or (tag == "header" and not before[3]) or (marked and not before[3])
        opened += 1
        stack.append((tag, tag + label, bad, article, opened, before[3] and label != "" and not _HEADING.fullmatch(tag)))
    add(html[at:])
    flush()
    return out


def _slot_text(page: list[Block]) -> list[Block]:
    """Blocks that may be content by what is around them."""
    return [b for b in page if not b.outside and (b.article or not b.linked)]


def _tokens(page: list[Block]) -> tuple[dict[str, int], dict[str, int]]:
    """Numbers of the page's tokens, and characters of open text by path. Tokens are elements (e), open texts outside
    articles (t), and texts in articles with each named element around them (x)."""
    counts: dict[str, int] = {}
    chars: dict[str, int] = {}
    seen: set[int] = set()
    for b in page:
        for i, number in enumerate(b.opened):
            if number not in seen:
                seen.add(number)
                key = "e" + "/".join(b.path[: i + 1])
                counts[key] = counts.get(key, 0) + 1
    for b in _slot_text(page):
        key = "/".join(b.path)
        chars[key] = chars.get(key, 0) + len(b.text)
        for token in [f"x{e}\n{b.text}" for e in b.named] if b.article else ["t" + b.text]:
            counts[token] = counts.get(token, 0) + 1
    return counts, chars


def _digested(token: str) -> str:
    """A token with the digest of its text, which may be long."""
    if token[:1] == "t":
        return "t" + xxhash.xxh3_128_hexdigest(token.encode("utf-8", "surrogatepass"))
    if token[:1] == "x":
        element, _, text = token.partition("\n")
        return f"{element}\n{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"
    return token


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregated (host, token, pages, single, vector, chars): the token "" counts the host's pages."""
    held: dict[tuple[str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=["host", "token", "pages", "single", "vector", "chars"])

    for batch in slices(batches, 128):
        for of, html in zip(texts(batch.column("host")), texts(batch.column("html")), strict=True):
            page = xxhash.xxh3_128_hexdigest(html.encode("utf-8", "surrogatepass"))
            counts, chars = _tokens(blocks(html))
            counts[""] = 1
            for token, n in counts.items():
                v = held.setdefault((of, _digested(token)), [0, 0, 0, 0])
                v[0] += 1
                v[1] += n == 1
                v[2] ^= int.from_bytes(xxhash.xxh64_digest(f"{page}|{n}".encode()), "little", signed=True)
            for path, n in chars.items():
                held.setdefault((of, "c" + path), [0, 0, 0, 0])[3] += n
        if len(held) > 50_000:
            yield out()
            held = {}
    yield out()


def _path_share(path: str, of: str) -> bool:
    return path == of or path.startswith(of + "/")


def _content(elements: list[str], held: dict[str, int], p: Params) -> list[str]:
    """The content element among those of the template (which occur once a page): the innermost that holds most open
    text; an article or main around it; or what is around it as long as only headings come in addition."""
    total = sum(held.values())
    under = lambda e: {q for q in held if _path_share(q, e)}
    wide = [e for e in elements if total and sum(held[q] for q in under(e)) >= p.cover * total]
    if not wide:
        return []
    found = max(wide, key=lambda e: (e.count("/"), e))
    around = sorted((e for e in elements if e != found and _path_share(found, e)), key=len, reverse=True)
    for e in [found, *around]:
        if re.match(r"(?:article|main)(?:\.|$)", e.rsplit("/", 1)[-1]):
            return [e]
    for e in around:
        if not all(re.search(r"/(?:h[1-6]|hgroup|header)[^/]*$", q) for q in under(e) - under(found)):
            break
        found = e
    return [found]


def _template(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Of each host (elements of valid classes, texts of valid classes, characters by path), its content elements."""
    for batch in slices(batches, 256):
        content = []
        for elements, paths, chars in zip(batch.column("elements").to_pylist(), batch.column("paths").to_pylist(), batch.column("chars").to_pylist(), strict=True):
            elements = [e[1:] for e in elements or ()]
            content.append(_content(elements, dict(zip([x[1:] for x in paths or ()], chars or (), strict=True)), p))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(content, pa.list_(pa.string())), batch.column("own")], names=["host", "content", "own"])


def _by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token) of elements -> (host, element) of those inside articles that aren't content by their names."""
    for batch in batches:
        hosts, found = [], []
        for of, token in zip(batch.column("host").to_pylist(), batch.column("token").to_pylist(), strict=True):
            *around, own = token[1:].split("/")
            tag, _, label = own.partition(".")
            if label and not _HEADING.fullmatch(tag) and _speaks(label) and any(re.match(r"(?:article|main)(?:\.|$)", e) for e in around):
                hosts.append(of), found.append(token[1:])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string())], names=["host", "element"])


def _different(pages: DataFrame) -> DataFrame:
    """(host, html) of pages with a host, without copies: only those with copies are shuffled."""
    of = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    own = pages.select(of.alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("host <> ''").withColumn("digest", F.md5("html"))
    copied = written(own.groupBy("host", "digest").count().where("count > 1").select("host", "digest"))
    one = own.join(copied, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.min("html").alias("html"))
    return own.join(copied, ["host", "digest"], "left_anti").select("host", "html").unionByName(one.select("host", "html"))


def templates(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """pages (page_id, url, html) -> (host, content: paths of the content elements, doubted: of elements in articles that
    aren't content, own: digests of the template's own texts outside articles), for hosts that have any."""
    p = params
    counted = _different(pages).mapInArrow(_counted, "host string, token string, pages long, single long, vector long, chars long")
    counted = written(counted.where("host <> ''").groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("single").alias("single"), F.expr("bit_xor(vector)").alias("vector"), F.sum("chars").alias("chars")))
    all_pages = counted.where("token = ''").select("host", F.col("pages").alias("n"))
    tokens = counted.where("token rlike '^[et]' and single = pages").join(all_pages, "host").where((F.col("pages") >= p.pages) & (F.col("pages") >= p.share * F.col("n")))
    # A class has a vector of its own; its members are as many as a page has tokens, at most.
    sizes = tokens.groupBy("host", "vector", "pages").agg(F.count("*").alias("members")).where(F.col("members") >= p.tokens)
    valid = tokens.join(sizes, ["host", "vector", "pages"], "left_semi")
    parts = valid.groupBy("host").agg(F.collect_list(F.when(F.col("token").startswith("e"), F.col("token"))).alias("elements"), F.collect_list(F.when(F.col("token").startswith("t"), F.substring("token", 2, 32))).alias("own"))
    # Text counts at the innermost valid element around it, so that a host has as many rows as its template has elements.
    under = counted.where("token rlike '^c'").select("host", "token", "chars").join(parts.select("host", "elements"), "host")
    slot = F.expr("array_max(transform(filter(elements, e -> token = concat('c', substr(e, 2)) or startswith(token, concat('c', substr(e, 2), '/'))), e -> struct(length(e) as n, concat('c', substr(e, 2)) as path))).path")
    slots = under.select("host", slot.alias("path"), "chars").where("path is not null").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    slots = slots.groupBy("host").agg(F.collect_list("path").alias("paths"), F.collect_list("chars").alias("chars"))
    content = parts.join(slots, "host", "left").select("host", "elements", "paths", "chars", "own").mapInArrow(partial(_template, p=p), "host string, content array<string>, own array<string>")

    # Elements of articles: those of one text, and those that their names speak against.
    several = (F.col("pages") >= p.pages) & (F.col("pages") >= p.share * F.col("n"))
    inside = counted.where("token rlike '^x'").withColumn("element", F.expr("substring(token, 2, instr(token, chr(10)) - 2)"))
    same = inside.groupBy("host", "element").agg(F.min(F.col("single") == F.col("pages")).alias("once"), F.min("pages").alias("pages")).where(F.col("once") & (F.col("pages") >= p.pages))
    same = same.join(all_pages, "host").where(several).select("host", "element")
    named = counted.where(F.col("token").startswith("e") & (F.col("pages") >= p.pages)).select("host", "token").mapInArrow(_by_name, "host string, element string")
    off = same.union(named).groupBy("host").agg(F.collect_set("element").alias("doubted"))
    none = F.array().cast("array<string>")
    return content.join(off, "host", "full").select("host", *(F.coalesce(c, none).alias(c) for c in ("content", "doubted", "own")))


def main_text(html: str, content: list[str] | None = None, own: list[str] | None = None, doubted: list[str] | None = None) -> str:
    """The page's main text, by its host's template if there is one. A page that the template says nothing of is taken
    by itself: its articles, or else all that isn't named as something else."""
    page = _slot_text(blocks(html))
    known, off = set(own or ()), set(doubted or ())
    free = [b for b in page if not off.intersection(b.named)]
    free = [b for b in free if b.article or not known or xxhash.xxh3_128_hexdigest(("t" + b.text).encode("utf-8", "surrogatepass")) not in known]
    free = free or page  # a template of texts alone leaves no page empty
    kept = [b for b in free if any(_path_share("/".join(b.path), c) for c in content or ())]
    if not kept:
        kept = [b for b in free if b.article] or free
    return "\n".join(b.text for b in kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        parts = (batch.column(c).to_pylist() for c in ("content", "own", "doubted"))
        text = [main_text(h, *x) for h, *x in zip(texts(batch.column("html")), *parts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", params: Params = Params()) -> DataFrame:
    """pages -> (page_id, url, text string, n_chars long), one row per row of pages.

    Null and empty html has the empty text. Pages whose url is null or has no host belong to no host: they are taken
    by themselves, as are pages of hosts with too few pages for a template. Ids may be null or repeat; other columns
    are ignored; an empty table gives an empty result.
    """
    own = rename_columns(pages, page_id=id_col, url=url_col, html=html_col)
    found = written(templates(own, params))
    size = found.agg(F.sum(F.expr("length(host) + aggregate(concat(content, doubted), 0, (s, x) -> s + length(x)) + 40 * size(own)"))).first()[0] or 0
    of = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    # Pages without a host get a key each, so that they don't meet in one partition.
    keyed = own.withColumn("host", F.when(of != "", of).otherwise(F.concat(F.lit("?"), F.xxhash64("page_id", "html").cast("string"))))
    joined = keyed.join(F.broadcast(found) if size <= params.broadcast_bytes else found, "host", "left")
    kind = dict(own.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "content", "own", "doubted").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
