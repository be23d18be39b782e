import random
import re
from collections import Counter

import pytest

from quillmesh.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, bucket int, value long, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """(text, lang, source) as documents, with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, la, s, "x", 1, 2, 3, 4) for i, (t, la, s) in enumerate(rows)], SCHEMA)


def by_hand(rows, least, top):
    rows = [(TERM.findall((t or "").translate(LOWER)), la or "", s or "") for t, la, s in rows]
    out = set()
    for lang in {la for _, la, _ in rows}:
        own = [(w, s) for w, la, s in rows if la == lang]
        docs = Counter(t for w, _ in own for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        per = {s: Counter() for _, s in own}
        for w, s in own:
            per[s].update(w)
        q, p = shares(sum(per.values(), Counter())), {s: shares(c) for s, c in per.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in per:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in per if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if per[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)}
    return out


def corpus():
    rng = random.Random(7)
    words = [*(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)), "É", "日本", "mixED"]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1 + (k % 5) * (i % 7)) for i in range(len(words))], k=rng.randint(0, 60))), rng.choice(["en", "fr", None]), f"s{k % 9}") for k in range(300)]
    return rows + [(None, "en", "s1"), ("", None, None), ("1 2 3 _", "en", "silent"), ("alone", "xx", "only"), ("rare", "zz", "a"), ("rarer", "zz", "b")] + [("hot Hot-hot9hot", "en", "s1")] * 150


# the sketch of 2^4 cells lets everything through, one of 2^18 almost nothing else; blocks of 2 sources, buckets of 16 counts
@pytest.mark.parametrize("bits, window, sources, entries", [(18, 1 << 18, 256, 1 << 16), (4, 50, 2, 16)])
def test_against_brute_force(spark, bits, window, sources, entries):
    rows = corpus()
    p = divergence.Params(min_docs=10, top=7, bits=bits, window=window, sources=sources, entries=entries)
    got = divergence.divergence(table(spark, rows).repartition(5), params=p).collect()
    want = by_hand(rows, 10, 7)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sketch_never_underestimates(spark):
    rows = [(f"often{chr(97 + i % 20)} once{chr(97 + i // 20)}{chr(97 + i % 20)}", "en", "s") for i in range(200)]
    p = divergence.Params(min_docs=10, bits=18)
    bits = divergence.frequent(table(spark, rows).repartition(7).select("lang", "text"), p)
    may = lambda t: all(row[c[0] >> 3] >> (7 - (c[0] & 7)) & 1 for row, c in zip(bits, divergence._cells("en", [t.encode()], p)))
    assert all(may(f"often{chr(97 + i)}") for i in range(20))
    assert sum(may(f"once{chr(97 + i // 20)}{chr(97 + i % 20)}") for i in range(200)) == 0


def test_long_texts_and_pieces(spark):
    assert [w for part in divergence._word_lists(b"ab1cd" * 1000 + b"x" * 300 + b" y", piece=7) for w in part] == (b"ab1cd" * 1000 + b"x" * 300 + b" y").translate(divergence.LETTERS).split()
    rows = [("a b " * 300_000 + "z" * 100_000, "en", "s"), ("a " * 5, "en", "t")]
    p = divergence.Params(min_docs=1, bits=12)
    assert {tuple(r) for r in divergence.divergence(table(spark, rows), params=p).collect()} == by_hand(rows, 1, 10)


def test_empty(spark):
    assert divergence.divergence(table(spark, []), params=divergence.Params(bits=8)).count() == 0
