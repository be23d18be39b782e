import random

import pytest

from quillmesh.llm import url_filter

SCHEMA = "page_id long, url string, html string, host int, path int, rule long, row int, verdict long"


def pages(spark, rows):
    """(page_id, url), with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, u, "<p>", 1, 2, 3, 4, 5) for i, u in rows], SCHEMA)


def by_hand(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, after = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = after[: min([i for i in map(after.find, "?#") if i >= 0], default=len(after))]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


ODD = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/EN/", "x://a.b.example.com/en/#q", "http://notexample.com/en/",
    "http://net/es/", "http://xnet/es/", "http://.net/fr/a", "http://a..net/fr/", "http://net./fr/", "http://net/fr", "http://com?u=http://net/es/", "http://u@com:80/", "http://É.com/", "http://com//", "http://" + "a." * 20_000 + "com/" + "p" * 50_000,
]


@pytest.mark.parametrize("params", [url_filter.Params(), url_filter.Params(prefix=1, shapes=1, sent=0), url_filter.Params(prefix=2, shapes=3, sent=2)])
def test_odd_urls(spark, params):
    rows = [(i if i % 5 else None, u) for i, u in enumerate(ODD)] + [(3, ODD[7])] * 3
    got = url_filter.verdicts(pages(spark, rows), url_filter.rule_table(spark), params=params).collect()
    want = [(i, *by_hand(u, url_filter.RULES)) for i, u in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("params", [url_filter.Params(), url_filter.Params(prefix=1, shapes=2, sent=0)])
def test_many_rules_against_brute_force(spark, params):
    rng = random.Random(3)
    name = lambda: ".".join(rng.choice(["a", "b", "com", "x"]) for _ in range(rng.randint(1, 4)))
    way = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 5)))
    rules = list({(name(), way()): None for _ in range(80)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules] + [(*rules[0], "block"), (*rules[0], "allow")]
    rows = [(i, f"http://{name()}{way()}{rng.choice(['', '?q', '#f'])}") for i in range(300)] + [(1000, f"http://{rules[0][0]}{rules[0][1]}")] * 200
    table = url_filter.rule_table(spark, [*rules, (None, "/", "block"), ("a", None, "block")])
    got = url_filter.verdicts(pages(spark, rows), table, params=params).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *by_hand(u, rules))) for i, u in rows)


def test_empty(spark):
    assert url_filter.verdicts(pages(spark, []), url_filter.rule_table(spark)).count() == 0
    got = url_filter.verdicts(pages(spark, [(1, "http://com/")]), url_filter.rule_table(spark, []), params=url_filter.Params(default="block")).collect()
    assert [tuple(r) for r in got] == [(1, "com", "/", None, "block")]
