"""Personal data, plain and disguised, with the places in the source.

Plain identifiers are found in the text itself. For disguised ones, transducers rewrite the text and keep, for each
character they write, which source characters it stands for: character references become what they name, look-alike
characters the ASCII ones they imitate, spelled digits digits, and at/dot disguises "@" and ".". The same rules then
run on the rewritten text, and what they find there is mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rename_columns, slices, texts

KINDS = ("email", "ip", "card", "phone")

# The look-behinds change nothing in what is found (a search that fails at the start of a run of digits fails inside
# it too); they keep the search linear in long runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers (kind, start, end), by kind; leftmost and without overlap within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p) < 256 for p in (q.lstrip("0") or "0" for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Letters of other scripts that look like ASCII ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορυι", "ABEZHIKMNOPTYXvopui", strict=True))
OTHERS = {"ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l", "՝": "'", "օ": "o", "ո": "n", "ս": "u", "։": ":", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " "}
#: Characters without width: they are dropped.
NO_WIDTH = frozenset("­​‌‍⁠﻿")
#: The words for the digits from 0 to 9 in English, German, French and Spanish.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_SPELLED = {w: str(d) for line in DIGIT_WORDS for d, w in enumerate(line.split())} | {"oh": "0"}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_NUMBER = rf"(?:(?:{_WORD})(?!\w)|[0-9]++)"
#: Spelled digits, digits and a plus, with what may stand between them: marks and line breaks go, full stops stay.
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ -]?)?{_NUMBER}(?:(?:[ ,\-/()\[\]\r\n]{{1,3}}|\.| ?(?:dot|point|punkt|punto)(?= ) ?){_NUMBER})*+(?!\w)", re.I)
_TOKEN = re.compile(rf"(?P<plus>plus|\+)|(?P<digit>{_NUMBER})|(?P<dot>dot|point|punkt|punto|\.)|[ ,\-/()\[\]\r\n]+", re.I)
_HAS_WORD = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = re.compile(rf"(?:(?<=[^ _])[ _]+)?+{_OPEN} ?(?:at|@|arroba|chez) ?{_CLOSE}[ _]*|(?<=\w)[_-]at[_-](?=\w)", re.I)
_DOT = re.compile(rf"(?:(?<=[^ ]) +)?+{_OPEN} ?(?:dot|\.|point|punkt|punto) ?{_CLOSE} *|(?<=\w)_dot_(?=\w)", re.I)
#: Bare words count in one context only: local part, at, host, and "dot" between the host's parts; or a local part that no word of prose is.
_BARE = re.compile(r"(?<![\w.@+-])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+-]*+(?: +(?:dot|punkt|punto) +[A-Za-z0-9][A-Za-z0-9._%+-]*+)*+)(?P<at> +(?:at|arroba) +| +@ +| +@|@ +)(?P<host>[A-Za-z0-9-]+(?:(?: +(?:dot|punkt|punto|\.) +|\.)[A-Za-z0-9-]+)+)", re.I)
#: A local part with a blank after each letter.
_LETTERS = re.compile(r"(?<![\w.@+-])(?:[A-Za-z0-9._] ){2,}[A-Za-z0-9](?= *@)")
_INNER_DOT = re.compile(r"[A-Za-z0-9]\.[A-Za-z0-9]")
#: Character references: by number, and the named ones of what identifiers hold.
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|commat|period|plus|hyphen|dash|lowbar|nbsp|lpar|rpar|sol);")
#: "dot" between digits.
_DIGITS_DOT = re.compile(r"(?<=[0-9]) ?[(\[]? ?\b(?:dot|point|punkt|punto)\b ?[)\]]? ?(?=[0-9])", re.I)
_BARE_DOT = re.compile(r" +(?:dot|punkt|punto|\.) +", re.I)


def _plain(c: str) -> str | None:
    """The ASCII character that c imitates; None if it imitates none, "" for one without width."""
    if c in NO_WIDTH:
        return ""
    if (x := CYRILLIC.get(c) or GREEK.get(c) or OTHERS.get(c)) is not None:
        return x
    d = unicodedata.decimal(c, None)
    if d is not None:
        return str(d)
    x = unicodedata.normalize("NFKC", c)
    return x if len(x) == 1 and x.isascii() else None


_IMITATES: dict[str, str | None] = {}


class Rewritten:
    """A text and, for each character, the source range it stands for and whether it was changed."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def replace(self, spans: list[tuple[int, int, str]]) -> None:
        """Each range (in order, without overlap) by a text, every character of which stands for the whole range."""
        if not spans:
            return
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for a, b, new in spans:
            text += self.text[at:a], new
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[at:a] + b"\1" * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


def _look_alikes(r: Rewritten) -> None:
    wanted = {}
    for c in set(r.text):
        if not c.isascii():
            if c not in _IMITATES and len(_IMITATES) < 100_000:
                _IMITATES[c] = _plain(c)
            if (x := _IMITATES[c] if c in _IMITATES else _plain(c)) is not None:
                wanted[c] = x
    if wanted:
        r.replace([(m.start(), m.end(), wanted[m[0]]) for m in re.finditer("[" + re.escape("".join(wanted)) + "]", r.text)])


def _references(r: Rewritten) -> None:
    found = ((m.start(), m.end(), unescape(m[0])) for m in _REFERENCE.finditer(r.text))
    r.replace([x for x in found if len(x[2]) == 1])


def _spelled_digits(r: Rewritten) -> None:
    """Each spelled digit next to digits, a plus or other spelled ones; the rules for identifiers reject prose."""
    if not _HAS_WORD.search(r.text):
        return
    spans = []
    for m in _RUN.finditer(r.text):
        if not _HAS_WORD.search(m[0]):
            continue
        for t in _TOKEN.finditer(r.text, m.start(), m.end()):
            new = "+" if t["plus"] else _SPELLED.get(t[0].lower(), t[0]) if t["digit"] else "." if t["dot"] else ""
            spans.append((t.start(), t.end(), new))
    r.replace(spans)


def _at_and_dot(r: Rewritten, low: str) -> None:
    if any(c in low for c in "[({<_-"):
        r.replace([(m.start(), m.end(), "@") for m in _AT.finditer(r.text)])
        r.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(r.text)])
    if not ("@" in low or ((" at " in low or " arroba " in low) and (any(f" {w} " in low for w in ("dot", "punkt", "punto")) or _INNER_DOT.search(r.text)))):
        return
    r.replace([(i, i + 1, "") for m in _LETTERS.finditer(r.text) for i in range(m.start() + 1, m.end(), 2)])
    spans = []
    for m in _BARE.finditer(r.text):
        inner, dotted = (list(_BARE_DOT.finditer(r.text, m.start(part), m.end(part))) for part in ("local", "host"))
        if dotted or "@" in m["at"] or re.search(r"[0-9._]", m["local"].strip(".")):
            spans += [*((d.start(), d.end(), ".") for d in inner), (m.start("at"), m.end("at"), "@"), *((d.start(), d.end(), ".") for d in dotted)]
    r.replace(spans)


def disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that the transducers bring to light: places in the source, none that overlaps a plain one of its kind."""
    r = Rewritten(text)
    if "&" in text:
        _references(r)
    if not r.text.isascii():
        _look_alikes(r)
    _spelled_digits(r)
    r.replace([(m.start(), m.end(), ".") for m in _DIGITS_DOT.finditer(r.text)])
    _at_and_dot(r, r.text.lower())
    if not any(r.changed):
        return []
    # Of each kind: where plain ones begin and end, in order, and where the last one found ends.
    by_start, last = sorted(plain, key=lambda x: x[1]), dict.fromkeys(KINDS, 0)
    begins, ends = ({k: [x[i] for x in by_start if x[0] == k] for k in KINDS} for i in (1, 2))
    out = []
    for kind, a, b in find(r.text):
        if any(r.changed[a:b]):
            s, e = r.start[a], max(r.end[a:b])
            before = bisect_left(begins[kind], e) - 1
            if s >= last[kind] and (before < 0 or ends[kind][before] <= s):
                out.append((kind, s, e))
                last[kind] = e
    return out


def in_order(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n: list[list[int]] = [[], [], [], [], []]
        digest, spans = [], []
        for text in texts(batch.column("text")):
            base = find(text)
            more = disguised(text, base)
            for i, kind in enumerate(KINDS):
                n[i].append(sum(k == kind for k, _, _ in base))
            n[4].append(len(more))
            digest.append(hashlib.sha256(in_order(base).encode()).hexdigest())
            spans.append(in_order(base + more))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "n_disguised", "base_sha256", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, n_email, n_ip, n_card, n_phone, n_disguised long, base_sha256, spans string), one row per row of docs.

    The numbers by kind count plain identifiers, n_disguised those that only the transducers find. spans lists both as
    kind:start:end (code points, end exclusive), by start and then kind; base_sha256 is the digest of the plain ones'
    list. Null and empty texts have none. Ids may be null or repeat; other columns are ignored; an empty table gives
    an empty result.
    """
    own = rename_columns(docs, doc_id=id_col, text=text_col)
    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(_found, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_disguised long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with each identifier, plain or disguised, replaced by its kind in angle brackets; of overlapping ones the first counts."""
    base = find(text)
    out, at = [], 0
    for kind, a, b in sorted(base + disguised(text, base), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += text[at:a], f"<{kind.upper()}>"
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def _redacted(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        new = pa.array([None if t is None else redacted(t) for t in batch.column(text_col).to_pylist()], pa.string())
        yield batch.set_column(batch.schema.get_field_index(text_col), text_col, new)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with text_col redacted; a null text stays null, other columns stay as they are."""
    return docs.mapInArrow(partial(_redacted, text_col=text_col), docs.schema)
