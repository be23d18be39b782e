"""Substring index, clusters, interval joins, hubs, tables of queries, the engine's entry, table functions and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.engine import Engine, Offline
from quillmesh.functions import tables, text
from quillmesh.operators import batch, clusters, graph, index, interval, names, retrieve, skew
from quillmesh.sources import store


def test_names_against_a_scan(spark):
    rng = random.Random(3)
    rows = [(f"e{i:03}", "".join(rng.choice("abé_ ") for _ in range(rng.randint(0, 9)))) for i in range(200)] + [("e900", None)]
    found = spark.createDataFrame(rows, "entity_id string, normal string").cache()
    postings = names.grams(found).cache()
    tokens = ["".join(rng.choice("abé_") for _ in range(rng.randint(1, 8))) for _ in range(12)]
    for some in [[t] for t in tokens[:8]] + [tokens, ["_"], ["__", "ab"], []]:
        want = [(i, n) for i, n in rows if n is not None and any(_like(n, t) for t in some)][:20]
        assert [tuple(r) for r in names.match(postings, found, some, 20).collect()] == want


def _like(name, token):
    """Whether some part of a name fits a token whose _ stands for any character."""
    return any(len(name) - i >= len(token) and all(t in ("_", c) for t, c in zip(token, name[i:])) for i in range(len(name) + 1))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_clusters_against_a_scan(spark, tmp_path, metric):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12, 6))[rng.integers(0, 12, 600)] * 5 + rng.standard_normal((600, 6)) * 0.2
    x[::50], x[7] = x[3], 0
    v = spark.createDataFrame([(f"v{i:03}", [float(a) for a in r]) for i, r in enumerate(x)] + [("none", None)], "id string, vector array<double>").cache()
    clusters.write(v, str(tmp_path / metric), 24, metric)
    for q in (x[0], x[3], rng.standard_normal(6), np.zeros(6), -x[10]):
        q = [float(a) for a in q]
        found = clusters.search(spark, str(tmp_path / metric), q, 9)
        want = retrieve.nearest(v.where("vector is not null"), retrieve.literal(q), 9, metric).collect()
        assert [tuple(r) for r in found.rows.collect()] == [tuple(r) for r in want]
    assert clusters.search(spark, str(tmp_path / metric), [float(a) for a in x[0]], 9).read < 16  # of 24
    assert clusters.search(spark, str(tmp_path / metric), [0.0] * 6, 10_000).rows.count() == 600
    with pytest.raises(ValueError):
        clusters.search(spark, str(tmp_path / metric), [1.0], 9)
    clusters.write(v.limit(0), str(tmp_path / "empty"), metric=metric)
    assert clusters.search(spark, str(tmp_path / "empty"), [1.0], 3).rows.count() == 0


def test_interval_join(spark):
    rng = random.Random(1)
    points = [(k, p) for k in "ab" for p in {rng.randint(-5, 400) for _ in range(60)}] + [("a", None), (None, 3)]
    ranges = [(k, i, s, s + rng.randint(0, 90)) for k in "ac" for i, s in enumerate(rng.choices(range(300), k=40))]
    p, r = spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(ranges, "k string, i int, s int, e int")
    for width in (1, 7, 1000):
        got = interval.interval_join(p, r, ["k"], "at", "s", "e", width).select("k", "at", "i").collect()
        assert sorted(map(tuple, got)) == sorted((k, a, i) for k, a in points if None not in (k, a) for c, i, s, e in ranges if c == k and s <= a < e)
    first = interval.first_range(p, r, ["k"], "at", "s", "e", 50, "s", "i", "one").collect()
    assert len(first) == len(points) and all((f.one is None) == (not any(c == f.k and f.at is not None and s <= f.at < e for c, i, s, e in ranges)) for f in first)


def test_one_long_section_stays_linear(spark):
    """10,000 links and 10,000 chunks of one section: looked at are a few chunks for each link."""
    n = 10_000
    points = spark.range(n).select(F.lit("d").alias("doc"), (F.col("id") * 1050 + 17).alias("pos"))
    ranges = spark.range(n).select(F.lit("d").alias("doc"), "id", (F.col("id") * 1050).alias("s"), (F.col("id") * 1050 + 1200).alias("e"))
    looked = interval.binned(points, ranges, ["doc"], "pos", "s", "e", 1200).count()
    assert n <= looked <= 4 * n and interval.interval_join(points, ranges, ["doc"], "pos", "s", "e", 1200).count() == 2 * n - 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hub_join(spark, how):
    many = spark.createDataFrame([("hub" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, 1000), ("none", 1001)], "k string, i int")
    few = spark.createDataFrame([("hub", 1), ("k0", 2), ("k3", 3), (None, 4)], "k string, v int")
    got = skew.hub_join(many, few, "k", "i", many.groupBy("k").count(), 10, how).select("k", "i", "v").collect()
    assert sorted(map(str, got)) == sorted(map(str, many.join(few, "k", how).select("k", "i", "v").collect()))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("engine") / "index")
    rows = [(f"f{i}.md", f"# Part {i}\nWord{i} and Common [[f{(i + 1) % 6}]]\n\n## Sub\n" + "Long Text. " * (i * 40) + f"#tag{i % 2}") for i in range(6)]
    e = Engine(spark, root, Offline(16))
    e.build(files=spark.createDataFrame(rows, "path string, text string"))
    e.build_events()
    return e


def test_batch_is_one_query_after_the_other(spark, built):
    tracker = spark.sparkContext.statusTracker()
    asked = ["Word1 and Common", "Long Text", "tag", "Part 5", "nothing of this"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, q string").select("qid", text.embed(F.col("q")).alias("query"))
    c, v, n, e = (*(store.load(spark, built.root, t) for t in ("chunks",)), index.vectors(spark, built.root), *(store.load(spark, built.root, t) for t in ("nodes", "edges")))
    jobs = []
    for many in (1, 5):
        spark.sparkContext.setJobGroup(f"batch{many}", "")
        rows = batch.dual(queries.where(F.col("qid") < many), c, v, n, e, k=4).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"batch{many}")))
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[0] - jobs[1]) <= 3  # the plan is one; small joins may take a job more or less
    for i, q in enumerate(asked):
        own = v.crossJoin(spark.range(1).select(text.embed(F.lit(q)).alias("qv")))
        want = retrieve.dual(c, own, n, e, F.col("qv"), k=4).collect()
        assert sorted((r.id, r.doc_id, round(r.score, 12), r.from_graph) for r in rows if r.qid == i) == sorted((r.id, r.doc_id, round(r.score, 12), r.from_graph) for r in want)


def test_batch_of_events(spark):
    links = spark.createDataFrame([("v1", "a"), ("v1", "b"), ("v2", "b"), ("v2", "c"), ("v3", "c"), ("v4", "d")], "event_id string, entity_id string")
    seeds = spark.createDataFrame([(1, "v1"), (2, "v3"), (2, "v4"), (3, "v9")], "qid int, id string")
    got = {tuple(r) for r in batch.expand_events(links, seeds, 2).collect()}
    for q in (1, 2, 3):
        alone = retrieve.expand_events(links, seeds.where(F.col("qid") == q).select("id"), 2).collect()
        assert {(i, h) for n, i, h in got if n == q} == {tuple(r) for r in alone}


def test_entry(spark, built, tmp_path):
    found = built.retrieve("Word1 and Common", 3).collect()
    assert len(found) == 3 and found[0].text and found[0].source_path.startswith("f") and found[0].score >= found[1].score
    assert built.retrieve("  \n", 3).count() == 0
    with pytest.raises(ValueError):
        built.retrieve("x", 0)
    silent = Engine(spark, built.root)
    with pytest.raises(RuntimeError, match="no embedder"):
        silent.retrieve("Word1")
    assert "vectors" not in silent.stats() and built.stats()["vectors"] == built.stats()["chunks"] == 15
    events = silent.retrieve_events("the word1?", 3, 1).collect()
    assert events[0].hop == 0 and events[0].shared == 1 and silent.retrieve_events(" ").count() == 0
    assert built.retrieve_events("Word1", 3).count() == 3
    none = Engine(spark, str(tmp_path / "none"))
    assert none.retrieve_events("x").count() == 0
    with pytest.raises(ValueError):
        none.documents()
    docs = built.documents().collect()
    assert sorted(d.n_chunks for d in docs) == [2, 2, 2, 3, 3, 3] and built.document(docs[0].id)["path"] == docs[0].path and built.document("d_") is None
    node = built.node(docs[0].id + "_s0")
    assert node["type"] == "section" and built.chunk(docs[0].id + "_s0_c0")["doc_id"] == docs[0].id and built.neighbours(docs[0].id).count() == 2


def test_table_functions(spark):
    tables.register(spark, 20, 5)
    body = "# A\ntext [[b#c|d]]\n## B\n[w](https://x) [x](y.md)"
    spark.createDataFrame([("a.md", body), ("n.md", None)], "path string, text string").createOrReplaceTempView("given")
    got = spark.sql("SELECT path, s.sec_idx, s.section_path FROM given, LATERAL markdown_sections(path, text) s ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [("a.md", 0, "A"), ("a.md", 1, "A > B")]
    assert [tuple(r) for r in spark.sql("SELECT target, anchor FROM given, LATERAL markdown_links(path, text) ORDER BY pos").collect()] == [("b", "c"), ("y.md", None)]
    spark.createDataFrame([("b", "x" * 15 + "\n\n" + "y" * 44)], "path string, text string").createOrReplaceTempView("longer")
    assert [tuple(r) for r in spark.sql("SELECT chunk_idx, char_start, char_end FROM longer, LATERAL chunk_windows(text) ORDER BY 1").collect()] == [(0, 0, 17), (1, 12, 37), (2, 32, 57), (3, 52, 61)]


def test_a_corpus_as_a_stream(spark, tmp_path):
    """Three batches, one of them replayed: the index is that of the newest files."""
    root, source = str(tmp_path / "index"), tmp_path / "in"
    source.mkdir()
    schema = "path string, text string, mtime double"

    def batch_of(n, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{n}"))
        part = next((tmp_path / f"b{n}").glob("part-*"))
        part.rename(source / f"{n}.json")

    def run(checkpoint):
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        q = index.follow(spark, files, root, str(tmp_path / checkpoint), semantic=False).trigger(availableNow=True).start()
        q.awaitTermination()
        return store.current(spark, root)

    batch_of(1, ("a.md", "old", 1.0), ("a.md", "# A\n[[b]]", 2.0))
    batch_of(2, ("b.md", "# B", 3.0))
    assert run("c1") == 2
    batch_of(3, ("b.md", "# B\nmore", 4.0), ("c.md", "new", 4.0))
    assert run("c1") == 3
    state = lambda: {d.path: d.hash for d in store.load(spark, root, "documents").collect()}
    before = state()
    assert set(before) == {"a.md", "b.md", "c.md"} and store.load(spark, root, "edges").where("type = 'links_to'").count() == 1
    # batch 3 again, as after a crash before its commit was noted
    again = spark.createDataFrame([("b.md", "# B\nmore", 4.0), ("c.md", "new", 4.0)], schema)
    r = index.build(spark, again, root, semantic=False, partial=True).first()
    assert (r.indexed, r.unchanged, r.removed) == (0, 2, 0) and state() == before


def test_graph_ranks_in_queries(spark):
    rows = spark.createDataFrame([(i % 3, f"n{i % 11}", i % 2) for i in range(33)], "qid int, id string, hop int").dropDuplicates(["qid", "id"])
    got = {(r.qid, r.id): r["rank"] for r in batch.ranked(rows, "hop", "id").collect()}
    for q in range(3):
        own = sorted((r.hop, r.id) for r in rows.where(F.col("qid") == q).collect())
        assert [got[q, i] for _, i in own] == list(range(1, len(own) + 1))
    assert graph.ranked_all(rows.limit(0), "hop").count() == 0


def test_rounded_distances_are_ties(spark):
    """Distances that differ by their rounding errors alone are ties, which the ids decide."""
    rows = [("b", [1.0 - 1e-13]), ("a", [1.0]), ("c", [0.5])]
    vectors = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = spark.createDataFrame([(1, [0.0])], "qid long, query array<double>")
    assert [r.id for r in retrieve.nearest(vectors, retrieve.literal([0.0]), 2).collect()] == ["c", "b"]
    assert [r.id for r in retrieve.nearest(vectors, retrieve.literal([0.0]), 2, digits=9).collect()] == ["c", "a"]
    assert {r.id: r["rank"] for r in batch.nearest(asked, vectors, 3, digits=9).collect()} == {"c": 1, "a": 2, "b": 3}
