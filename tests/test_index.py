"""Versions of an index: what a change writes, who may commit, models, events by chunk, and what stays behind."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import providers, text
from quillmesh.operators import index, retrieve
from quillmesh.sources import markdown, scratch, store
from quillmesh.sources.store import Change


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "id string, hash string")


def size(spark, root):
    fs, at = scratch.filesystem(spark, root)
    return fs.getContentSummary(at).getLength()


def state(spark, root, name="documents", version=None):
    return sorted(map(tuple, store.load(spark, root, name, version).collect()))


def test_versions(spark, tmp_path):
    root, gone = str(tmp_path / "log"), lambda *x: spark.createDataFrame([(i,) for i in x], "owner string")
    assert store.current(spark, root) == 0 and store.load(spark, root, "documents") is None
    store.commit(spark, root, {"documents": Change(rows(spark, ("a", "1"), ("b", "1")))})
    store.commit(spark, root, {"documents": Change(rows(spark, ("a", "2"), ("c", "1")), gone("a"))})
    assert state(spark, root) == [("a", "2"), ("b", "1"), ("c", "1")] and state(spark, root, version=1) == [("a", "1"), ("b", "1")]
    store.commit(spark, root, {"documents": Change(None, gone("c", "zz"))})
    store.commit(spark, root, {"documents": Change(rows(spark, ("c", "3")), gone("b"))})
    want = [("a", "2"), ("c", "3")]
    assert state(spark, root) == want and store.get(spark, root, "documents", "c") == {"id": "c", "hash": "3"} and store.get(spark, root, "documents", "b") is None
    # of two builds that start from one version, one is told so and nothing of it is read
    with pytest.raises(store.Conflict):
        store.commit(spark, root, {"documents": Change(rows(spark, ("x", "9")))}, based=3)
    assert state(spark, root) == want and store.current(spark, root) == 4
    assert store.compact(spark, root, most=3) == ["documents"] and state(spark, root) == want and len(store.listing(spark, root)["documents"]["rows"]) == 1
    assert store.vacuum(spark, root) == 0  # all are young
    assert store.vacuum(spark, root, seconds=-60) == 7 and state(spark, root) == want
    store.commit(spark, root, {"documents": Change(replace=True)})
    assert state(spark, root) == []


def test_one_file_of_a_thousand(spark, tmp_path):
    root = str(tmp_path / "index")
    name = F.concat(F.lit("n"), F.col("id").cast("string"))
    say = lambda n: F.concat(F.lit("# Head\nWord "), n, F.lit(" Names [[n"), ((F.col("id") + 1) % 1000).cast("string"), F.lit("]] #t"), (F.col("id") % 7).cast("string"))
    files = spark.range(1000).select(F.concat(name, F.lit(".md")).alias("path"), say(name).alias("text"))
    index.build(spark, files, root)
    before = size(spark, root)
    other = files.withColumn("text", F.when(F.col("path") == "n7.md", F.concat("text", F.lit(" More"))).otherwise(F.col("text")))
    r = index.build(spark, other, root).first()
    assert (r.indexed, r.unchanged, r.removed) == (1, 999, 0)
    # Parquet files have a footer of some kB each; rows in proportion are far below that
    written = {n: store.load(spark, root, n).count() for n in ("documents", "chunks")}
    assert written == {"documents": 1000, "chunks": 1000}
    grown = size(spark, root) - before
    added = store.delta(spark, root, 2)
    assert added["documents"] == (1, 1) and added["chunks"] == (1, 1) and added["links"] == (1, 1) and added["nodes"][0] < 12 and added["edges"][0] < 12
    assert grown < before / 3
    assert not [p for p in scratch._MADE if "scratch" in p and p.startswith(root)]


def embedders():
    class Flat(providers.Embedder):
        def __init__(self, name, dim):
            self.name, self.dim = name, dim

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t))] * self.dim for t in texts]

    return Flat("a/b", 2), Flat("c", 3)


def test_vectors_by_model(spark, tmp_path):
    root, (one, two) = str(tmp_path / "index"), embedders()
    files = spark.createDataFrame([("a.md", "xx"), ("b.md", "yyyy")], "path string, text string")
    index.build(spark, files, root, one, semantic=False)
    r = index.build(spark, files, root, two, semantic=False).first()  # nothing has changed, but this model has no vectors
    assert (r.indexed, r.unchanged) == (0, 2)
    assert {len(v.vector) for v in index.vectors(spark, root, two).collect()} == {3} and {len(v.vector) for v in index.vectors(spark, root, one).collect()} == {2}
    near = retrieve.nearest(index.vectors(spark, root, two), retrieve.literal([4.0, 4.0, 4.0]), 1).first()
    assert near.distance == 0
    with pytest.raises(Exception, match="components"):
        retrieve.nearest(index.vectors(spark, root, two), retrieve.literal([4.0, 4.0]), 1).collect()
    with pytest.raises(ValueError):
        index.vectors(spark, root)
    # a file that fails is tried again, though it hasn't changed; a changed one loses the other model's vectors
    files = spark.createDataFrame([("a.md", "xx"), ("b.md", "bad")], "path string, text string")
    assert index.build(spark, files, root, one, semantic=False).first().errors == 1
    assert index.vectors(spark, root, two).count() == 1 and index.vectors(spark, root, one).count() == 1
    one.embed = lambda texts: [[1.0, 1.0]] * len(texts)
    r = index.build(spark, files, root, one, semantic=False).first()
    assert (r.indexed, r.errors) == (0, 0) and index.vectors(spark, root, one).count() == 2


def teller(log):
    class Teller(providers.EventExtractor):
        def event(self, text, heading, title):
            with open(log, "a") as f:
                f.write(text.split()[0] + "\n")
            if "bad" in text:
                raise RuntimeError("no")
            kind, *names = text.split()
            return providers.Event(title=title, content=text, entities=[providers.Entity(n, "person" if kind == "p" else "") for n in names])

    return Teller()


def test_events_by_chunk(spark, tmp_path):
    """Edit, delete and failure: only what is new, changed or failed is asked for again."""
    root, log = str(tmp_path / "index"), tmp_path / "log"
    files = lambda **t: spark.createDataFrame([(p + ".md", x) for p, x in t.items()], "path string, text string")
    asked = lambda: sorted(log.read_text().split()) if log.exists() else []
    index.build(spark, files(a="n Ann Bob", b="m Bob", c="bad", d="k Cid"), root, semantic=False)
    r = index.build_events(spark, root, teller(str(log))).first()
    assert (r.events, r.failed, r.entities, r.links, r.seen) == (3, 1, 3, 4, 4) and asked() == ["bad", "k", "m", "n"]
    log.unlink()
    r = index.build_events(spark, root, teller(str(log))).first()  # the failed one only
    assert (r.events, r.failed, r.seen) == (3, 1, 1) and asked() == ["bad"]
    log.unlink()
    index.build(spark, files(a="n Ann Bob", b="p BOB Dan", c="x Eve", e="bad"), root, semantic=False)
    assert store.load(spark, root, "events").count() == 3  # readers of this version see the events as they were
    r = index.build_events(spark, root, teller(str(log))).first()
    assert (r.events, r.failed, r.seen) == (3, 1, 3) and asked() == ["bad", "p", "x"]
    names = {n.name: n.type for n in store.load(spark, root, "event_nodes").collect()}
    assert names == {"Ann": "", "Bob": "person", "Cid": "", "Dan": "person", "Eve": ""}  # the first name, the first type that isn't empty
    live = {e.chunk_id for e in store.load(spark, root, "events").collect()}
    assert {x.chunk_id for x in store.load(spark, root, "event_entities").collect()} == live and all(e.model == "vectors_mock_embed_16" for e in store.load(spark, root, "events").collect())
    one, _ = embedders()
    index.build_events(spark, root, teller(str(log)), one)
    assert {len(e.embedding) for e in store.load(spark, root, "events").collect()} == {2}
    assert index.build_events(spark, root, teller(str(log)), one, full=True).first().seen == 4


def test_nothing_stays_behind(spark, tmp_path):
    root = str(tmp_path / "index")
    before = set(scratch._MADE)
    index.build(spark, spark.createDataFrame([("a.md", "# A\nOne [[b]]"), ("b.md", "Two")], "path string, text string"), root)
    assert set(scratch._MADE) == before
    kept = scratch.cut(spark.range(3))
    assert kept.count() == 3 and scratch.clear(spark, len(before)) == 1


def test_markdown_against_rules_by_regular_expressions():
    """Places of code, links and tags in texts made of their marks."""
    import random
    import re

    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["`", "```", "~~~", "[", "[[", "]", "]](", ")", "#", "a", "é", "/", " ", "\n", "|"]) for _ in range(rng.randint(0, 24)))
        masked = markdown.without_code(t)
        assert len(masked) == len(t) and all(m in (c, " ") for m, c in zip(masked, t))
        found = list(markdown.inline(masked))
        assert [(a, b) for k, a, b, _ in found if k == "wiki"] == [m.span() for m in re.finditer(r"\[\[[^\]\n]+\]\]", masked)]
        assert [s for k, _, _, s in found if k == "tag"] == re.findall(r"(?:(?<=^)|(?<=[^\w#]))#([A-Za-z0-9][\w/-]*)", masked)
        assert [a for _, a, _, _ in found] == sorted(a for _, a, _, _ in found)


def test_vectors_made_afterwards(spark, tmp_path):
    """A build without vectors, and the vectors of a model that chunks lack, are what a build with vectors makes."""
    root, whole = str(tmp_path / "a"), str(tmp_path / "b")
    files = lambda *bodies: spark.createDataFrame([(f"{i}.md", b) for i, b in enumerate(bodies)], "path string, text string")
    for first in (True, False):
        corpus = files("Ann met Bob.", "# One\nTwo _three") if first else files("Ann met Bob.", "# One\nFour", "Five")
        index.build(spark, corpus, root, embed=False)
        assert first == (index.vector_table() not in store.listing(spark, root))
        index.add_vectors(spark, root)
        index.build(spark, corpus, whole)
        got, want = ({r.id: r.vector for r in index.vectors(spark, at).collect()} for at in (root, whole))
        assert got == want and len(got) == (2 if first else 3)
    edges = [{tuple(r) for r in store.load(spark, at, "edges").select("src", "dst", "type", "meta").collect()} for at in (root, whole)]
    assert edges[0] == edges[1] and any(e[2] == "relates_to" for e in edges[0])


@pytest.mark.parametrize("body", ["Abc_ Abc Ab1 aBc Äbc XÄ A B2 _Cd Ef", "", " \n", "one two, three. four five six", "...a", "Ab Ab\nCd"])
def test_names_and_titles(spark, body):
    df = spark.createDataFrame([(body,)], "t string").select(text.entity_names(F.col("t")).alias("names"), text.title(F.col("t")).alias("title"), *(text.embed(F.col("t"), d).alias(f"v{d}") for d in (2, 8, 16)))
    r, words = df.first(), re.findall(r"\w+", body)
    assert r.names == list(dict.fromkeys(w for w in words if re.fullmatch("[A-Z][a-zA-Z0-9]+", w))) and r.title == " ".join(words[:5])
    for d in (2, 8, 16):
        n = [0] * d
        for w in re.findall(r"\w+", body.lower()):
            n[int(hashlib.sha256(w.encode()).hexdigest(), 16) % d] += 1
        size = math.sqrt(sum(x * x for x in n)) or 1.0
        assert r[f"v{d}"] == [x / size for x in n]
