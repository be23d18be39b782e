"""Chunk windows, offline embeddings and entities, vector distances: all native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: A word of a capital letter, and letters and digits.
NAME = r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z0-9]++(?![\p{L}\p{N}_])"
#: A text's beginning, up to its fifth word and what follows it.
BEGINNING = r"^[^\p{L}\p{N}_]*+((?:[\p{L}\p{N}_]++[^\p{L}\p{N}_]*+){1,5})"


def windows(body: str, max_chars: int = 1200, overlap: int = 150) -> Column:
    """windows_sql() as a Column."""
    return F.expr(windows_sql(body, max_chars, overlap))


def windows_sql(body: str, max_chars: int = 1200, overlap: int = 150) -> str:
    """array<struct<s int, e int>> of a text column: paragraphs packed greedily into windows of max_chars, longer
    paragraphs split hard; every window but the first begins overlap characters earlier. Blank text has none."""
    if max_chars < 1 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be at least 1, overlap from 0 to below max_chars")
    spans = f"regexp_extract_all({body}, r'(?s)(.*?\\n[ \\t]*\\n|.+\\z)', 1)"
    flush = "if(a.cs < 0, a.w, concat(a.w, array(struct(a.cs AS s, a.ce AS e))))"
    state = "array<struct<s:int,e:int>>"
    fold = f"""aggregate({spans}, named_struct('w', cast(array() AS {state}), 'cs', -1, 'ce', -1, 'pos', 0), (a, p) -> CASE
        WHEN length(p) > {max_chars} THEN named_struct('w', concat({flush}, transform(sequence(0, cast((length(p) - 1) div {max_chars} AS int)), i -> struct(a.pos + i * {max_chars} AS s, a.pos + least(length(p), (i + 1) * {max_chars}) AS e))), 'cs', -1, 'ce', -1, 'pos', a.pos + length(p))
        WHEN a.cs < 0 THEN named_struct('w', a.w, 'cs', a.pos, 'ce', a.pos + length(p), 'pos', a.pos + length(p))
        WHEN a.pos + length(p) - a.cs <= {max_chars} THEN named_struct('w', a.w, 'cs', a.cs, 'ce', a.pos + length(p), 'pos', a.pos + length(p))
        ELSE named_struct('w', {flush}, 'cs', a.pos, 'ce', a.pos + length(p), 'pos', a.pos + length(p)) END, a -> {flush})"""
    moved = f"transform({fold}, (w, i) -> struct(if(i = 0, w.s, greatest(w.s - {overlap}, 0)) AS s, w.e AS e))"
    return (f"CASE WHEN {body} IS NULL OR trim(BOTH ' \\n\\t\\r' FROM {body}) = '' THEN cast(array() AS {state}) WHEN length({body}) <= {max_chars} THEN array(struct(0 AS s, length({body}) AS e)) ELSE {moved} END")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def embed(text: Column, dim: int = 16) -> Column:
    """Token-hash embedding: each token adds one at sha256(token) mod dim; then unit length (zeros without tokens)."""
    if dim in (1, 2, 4, 8, 16):
        # The last digit of each hash tells the place: all of them as one string, bound once, of which each digit is counted.
        digits = F.array_join(F.transform(tokens(F.lower(text)), lambda t: F.substring(F.sha2(t, 256), 64, 1)), "")
        number = lambda own, d: F.length(own) - F.length(F.replace(own, F.lit(f"{d:x}"), F.lit("")))
        count = lambda own, i: reduce(lambda a, b: a + b, [number(own, d) for d in range(i, 16, dim)]).cast("double")
        return unit(F.transform(F.array(digits), lambda own: F.array(*(count(own, i) for i in range(dim))))[0])
    slot = lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda acc, i: (acc * (1 << 32) + F.conv(F.substr(F.sha2(t, 256), i * 8 + 1, F.lit(8)), 16, 10).cast("long")) % dim).cast("int")
    # Bound once by the outer transform: each token is hashed once, not once for each dimension.
    slots = F.array(F.transform(tokens(F.lower(text)), slot))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double"))
    return unit(F.transform(slots, counts)[0])


def unit(v: Column) -> Column:
    return F.transform(F.array(v), lambda x: F.transform(F.array(norm(x)), lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda y: y / n)))[0])[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or unequally long vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def squared_l2(a: Column, b: Column) -> Column:
    """Null if either is; an error for unequally long vectors."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    lengths = F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" components"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), d).otherwise(F.raise_error(lengths))


def entity_names(text: Column) -> Column:
    """Capitalised words of letters and digits, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), 0))


def title(text: Column) -> Column:
    """The first five words, with blanks between them."""
    return F.array_join(tokens(F.regexp_extract(text, BEGINNING, 1)), " ")
