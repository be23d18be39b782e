"""A substring index of names: postings of their grams, and an exact check of what they find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names are cut into grams of one to so many characters: shorter tokens are a gram themselves.
SIZE = 3


def grams(names: DataFrame, id_col: str = "entity_id", name_col: str = "normal") -> DataFrame:
    """(id, name) -> (gram, id), each once: the runs of one to three characters of each name."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(name_col) - (n - 1)), lambda i: F.substr(F.col(name_col), i, F.lit(n)))
    parts = [F.when(F.length(name_col) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in range(1, SIZE + 1)]
    return names.select(F.explode(F.array_distinct(F.concat(*parts))).alias("gram"), F.col(id_col).alias(id_col))


def token_grams(token: str) -> list[str]:
    """What a name that matches a token must hold. _ and % stand for other characters in a token, as in LIKE."""
    runs = [r for r in token.replace("%", "_").split("_") if r]
    return sorted({r[i : i + SIZE] for r in runs for i in range(max(1, len(r) - SIZE + 1))})


def match(postings: DataFrame, names: DataFrame, tokens: list[str], limit: int = 50, id_col: str = "entity_id", name_col: str = "normal") -> DataFrame:
    """The rows of names whose name holds one of the tokens, the first by id. Only the postings of the tokens' grams are
    read, and the names that hold all of a token's; those are compared. A token of nothing but wildcards is looked for in
    all names; without tokens nothing matches."""
    fits = lambda some: reduce(lambda a, b: a | b, [F.col(name_col).like(f"%{t}%") for t in some], F.lit(False))
    by_gram = {t: token_grams(t) for t in tokens}
    found = names.where(fits([t for t, g in by_gram.items() if not g])) if not all(by_gram.values()) else None
    narrow = {t: g for t, g in by_gram.items() if g}
    if narrow:
        every = sorted({g for gs in narrow.values() for g in gs})
        has = postings.where(F.col("gram").isin(every)).groupBy(id_col).agg(F.collect_set("gram").alias("_has"))  # no more than the tokens have
        holds = reduce(lambda a, b: a | b, [F.size(F.array_except(F.array(*map(F.lit, gs)), F.col("_has"))) == 0 for gs in narrow.values()])
        some = names.join(has.where(holds).select(id_col), id_col, "left_semi").where(fits(narrow))
        found = some if found is None else found.union(some.select(*found.columns)).distinct()
    return (names.limit(0) if found is None else found).orderBy(id_col).limit(limit)
