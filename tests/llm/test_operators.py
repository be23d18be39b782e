import dataclasses
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quillmesh.llm import decontaminate, embedding_dedup, html_text, id_files, licenses, minhash_dedup, packing, pii, quality, toxicity
from quillmesh.llm.common import alnum_words, hub_join, packed, unpacked
from quillmesh.llm.components import components
from quillmesh.llm.tokens import ChunkEncoder, encoder

DOCS = "doc_id long, text string, rep long, bucket long, label int, score double"
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def docs(spark, rows):
    """Rows of (doc_id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long = " ".join(f"word{rng.randint(0, 500)}" for _ in range(20_000))
    return docs(spark, [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "one two"), (5, long), (6, "x" * 50_000), (7, "a  b \n c\x00 é")])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


@pytest.mark.parametrize("params", [minhash_dedup.Params(), minhash_dedup.Params(block=3, block_bytes=4096)])
def test_minhash_against_brute_force(spark, params):
    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base = words(rng, 80)
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(80)] = "changed"
            texts.append(" ".join(w))
    sets = [set(minhash_dedup.shingles(t).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, enumerate(texts)), params=params).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_minhash_odd(spark, odd, none):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(odd).collect()), key=str)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and got.count((4, 1, 4, True)) == 2 and (0, 1, None, True) in got and len(got) == 9
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_minhash_repeated_ids(spark):
    """Rows of one id with several texts are linked each by its own text."""
    rng = random.Random(3)
    base = [words(rng, 60) for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(base[i % 6])
        w[rng.randrange(60)] = f"other{rng.randint(0, 3)}"
        rows.append((i % 15, " ".join(w)))
    got = minhash_dedup.near_duplicates(docs(spark, rows), carry=("text",)).collect()
    sets = [set(minhash_dedup.shingles(t).tolist()) for _, t in rows]
    comp = [i for i, _ in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert sorted((r.doc_id, r.text, r.component_id) for r in got) == sorted((i, t, c) for (i, t), c in zip(rows, comp))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = minhash_dedup.sketch(x[:800], 400), minhash_dedup.sketch(x[100:], 400)
    assert abs((a == b).mean() - 700 / 900) < 0.08
    one = minhash_dedup.sketch(x[:1], 64)
    assert len(set(one.tolist())) > 60


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (2, 1)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_components_with_hubs(spark):
    hub = [(500, i) for i in range(1, 500)] + [(i, 500) for i in range(501, 1000)]
    chain = [(i, i + 1) for i in range(2000, 2040)]
    rows = hub + chain + [(999, 2040)] * 2 + [(7, 7)]
    links = spark.createDataFrame(rows, "a long, b long")
    got = {tuple(r) for r in components(links).collect()}
    assert got == {(i, 1) for i in [*range(1, 1000), *range(2000, 2041)]}
    few = spark.createDataFrame([(k, k * 10) for k in (1, 2, 3)], "k long, v long")
    many = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (None, 1), (9, 1)], "k long, x long")
    joined = hub_join(many, few, "k", "x", many.groupBy("k").count(), 32)
    assert sorted(map(tuple, joined.collect())) == sorted([(1, i, 10) for i in range(100)] + [(2, 0, 20)])


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 32))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.1, 0.25, 0.35, 0)]).astype(np.float32)
    label = np.tile(np.arange(30) % 3, 5)
    rows = [(i, v.tolist(), int(k), 1) for i, (v, k) in enumerate(zip(x, label))]
    rows += [(900, None, 1, 1), (901, [0.0] * 32, 1, 1), (902, [float("nan")] * 32, 1, 1), (903, x[0].tolist(), None, 1), (904, [None] * 32, 0, 1), (905, [], 0, 1)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    for block in (1024, 4):
        p = embedding_dedup.Params(block=block)
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int"), params=p).collect()}
        found = sum(got[i].n_links for i in range(len(x)))
        assert len(got) == len(rows) and 0.99 * near.sum() <= found <= near.sum()
        assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
        assert all(got[i].component_id <= i for i in range(len(x)))
    # null ids link with nothing by themselves; rows that repeat an id are vectors each
    some = [(1, x[0].tolist(), 0), (1, x[0].tolist(), 0), (None, x[0].tolist(), 0), (None, x[1].tolist(), 0), (2, x[0].tolist(), 0), (3, x[0].tolist(), 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(some, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got), key=str) == [(0, 0, None, True), (0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def brute_hits(text, items, window=10):
    w, hit, named = alnum_words(text), set(), set()
    for item, t in items:
        v = alnum_words(t or "")
        m = min(window, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit |= set(range(j, j + m))
                    named.add(str(item))
    return len(w), len(hit), sorted(named)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, odd, none, block_bytes):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 5, 10, 14])))) for i in range(6)] + [(9, None)]
    rows = [(i, ", ".join(rng.choices(vocab, k=60)).upper()) for i in range(15)] + [(20, None), (21, items[3][1] or "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, sum(r.hits[1::2]) - sum(r.hits[::2]), r["items"]) for r in decontaminate.overlaps(docs(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert got == {i: brute_hits(t or "", items) for i, t in rows}
    assert decontaminate.contamination(odd, bench, block_bytes=block_bytes).count() == 9
    assert decontaminate.contamination(none, bench, block_bytes=block_bytes).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench.limit(0)).collect())


def test_pii(spark, odd, none):
    text = "Ann ann@a.org or bob (at) mail (dot) com, 10.0.0.1, +49 170 1234567, 4111 1111 1111 1111; jоe@mаil.com"
    r = pii.personal_data(docs(spark, [(1, text)])).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_disguised) == (1, 1, 1, 1, 2)
    kinds = {text[int(a) : int(b)]: k for k, a, b in (s.split(":") for s in r.spans.split(","))}
    assert kinds["bob (at) mail (dot) com"] == "email" and kinds["jоe@mаil.com"] == "email" and len(kinds) == 6
    assert pii.redacted("call plus four nine one two three four five six seven eight nine") == "call <PHONE>"
    assert pii.redacted("look at example.com, one or two dots") == "look at example.com, one or two dots"
    assert all(x.spans == "" for x in pii.personal_data(odd).collect()) and pii.personal_data(none).count() == 0
    assert {x.doc_id: x.text for x in pii.redact(odd).collect()}[1] is None


def test_pii_few_spelled_digits():
    """One or two spelled digits in a number, line breaks and brackets between them."""
    for text, want in [("call +49 170 one two 34567 now", "call <PHONE> now"), ("at 10.0.0.five it", "at <IP> it"), ("card 4111 1111 1111 111 one.", "card <CARD>."), ("plus four nine (one seven zero)\n1234567", "<PHONE>"), ("+49 (170) 123 six\nseven", "<PHONE>")]:
        assert pii.redacted(text) == want
    for text in ("one or two of 30, 40, one.", "in 2019 one saw 12.5 and two.Then 3", "un 5x, six-pack 7"):
        assert pii.redacted(text) == text


def test_pii_spoken_and_referenced():
    """Dotted local parts, "dot" between digits, character references; prose stays."""
    for text, want in [
        ("ask john dot smith at example dot com today", "ask <EMAIL> today"), ("jane (dot) doe (at) mail (dot) org", "<EMAIL>"), ("at 5 192 dot 168 dot 1 dot 20 is", "at 5 <IP> is"),
        ("write jane&#64;example.com or bob&commat;x&period;org.", "write <EMAIL> or <EMAIL>."), ("the dot at the end at home, 3 point 5 &amp; more", "the dot at the end at home, 3 point 5 &amp; more"),
    ]:
        assert pii.redacted(text) == want


def test_pii_base_rules_against_plain_expressions():
    """The plain identifiers of random texts, by the rules as regular expressions without any of the search's shortcuts."""
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def digits(text):
        return "".join(c for c in text if c.isdigit())

    def plain(text):
        out = [("email", m.start(), m.end()) for m in email.finditer(text)]
        out += [("ip", m.start(), m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in card.finditer(text):
            d = [int(c) for c in digits(m[0])][::-1]
            if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
                out.append(("card", m.start(), m.end()))
        return out + [("phone", m.start(), m.end()) for m in phone.finditer(text) if 10 <= len(digits(m[0])) <= 15]

    rng = random.Random(21)
    parts = ["a@b.c", "x", "@", ".", "..", "1", "25", "255", "256", "4111 1111 1111 1111", "4111-1111", "+49 ", "+1 (", ")", " ", "-", "170 1234567", "10.0.0.1", "é", "\n", "%", "_", "0", "a.b-c@d-e.f.g"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert sorted(pii.find(text)) == sorted(plain(text)), text


def test_packing(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.choice([1, 5, 20, 90, 200])))) for i in range(60)]
    got = packing.pack(docs(spark, rows), BYTES, size=256, with_ids=True).toPandas()
    t = Tokenizer.from_file(BYTES)
    for i, text in rows:
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert b"".join(own.ids) == ids.tobytes() and list(own.start) == [0, *np.cumsum(own.length)[:-1]] and (own.length.iloc[1:] == 256).all()
        assert all(zlib.crc32(b) == c for b, c in zip(own.ids, own.ids_crc32))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 256 and list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    assert packing.pack(odd, BYTES).where("piece = 0").count() == 9 and packing.pack(none, BYTES).count() == 0


def best(lengths, size):
    """The least number of sequences, by exhaustion."""
    lengths, most = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= most[0]:
            return
        if i == len(lengths):
            most[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return most[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(6)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        left, fixed = np.bincount(lengths, minlength=21).astype(np.int64), [0]

        def fix(n, *sizes):
            fixed[0] += n
            for s in sizes:
                left[s] -= n

        packing._reduce(left, 20, fix)
        rest = [s for s in range(21) for _ in range(left[s])]
        assert fixed[0] + best(rest, 20) == best(lengths, 20)


def test_added_tokens_as_the_library(spark):
    """Texts that hold the string of an added token get the library's ids."""
    for path in (BYTES, WORDS):
        t = Tokenizer.from_file(path)
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        texts = ["a <|endoftext|> b", "a<|endoftext|>b c.", *(f"x {a} y {a}z" for a in added)]
        with open(path, encoding="utf-8") as f:
            assert [x.tolist() for x in encoder(f.read()).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_as_the_library():
    """Texts of plain and odd characters in any order get the library's ids, from one batch or several."""
    rng = random.Random(8)
    parts = ["a", "The", "É", "ß", "İ", "ŉ", "Ж", "ё", "×", "ª", "²", "12", "7", " ", " ", " ", "  ", "\n", "\n", "\r", "\t", "\xa0", "\u200a", "\x00", "'s", "'LL", "’", ".", ",", "%%%", "_", "<|", "|>", "</w>", "\u0301", "\u030c", "J", "漢", "한", "😀", "Σ", "ς", "λόγος", "\u212a", "Ġ", "\ufeff", "\\", "]"]
    batches = [["".join(rng.choices(parts, k=rng.choice((0, 1, 2, 4, 9, 40)))) for _ in range(rng.choice((1, 3, 200)))] for _ in range(30)]
    for path in (BYTES, WORDS):
        t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            e = encoder(f.read())
        assert e.sure
        for texts in [*batches, [""], ["", " "], []]:
            assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_words_are_asked_once():
    """Words with other marks, lines or capitals aren't asked of the library again."""
    rng = random.Random(9)
    with open(WORDS, encoding="utf-8") as f:
        e = ChunkEncoder(f.read())
    some = ["".join(rng.choices("aeionrst", k=8)) for _ in range(1000)]
    asked, ids = [], e._ids
    e._ids = lambda texts: asked.extend(texts) or ids(texts)
    e.encode([" ".join(some)])
    before = sum(map(len, asked))
    e.encode([" ".join(f"{w.title()}{rng.choice(('%%%', '!!', ');'))} ({w}.\n{v}" for w, v in zip(some, some[1:], strict=False))])
    assert before > 8000 and sum(map(len, asked)) < before + 100


def test_id_files(spark, odd, none):
    v = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 3, np.uint32)
    assert (id_files.decode_values(*id_files.encode_values(v), len(v)) == v).all() and id_files.encode_values(v[:0]) == (b"", b"")
    got = id_files.round_trip(odd.where("doc_id is not null"), WORDS, block_ids=100).collect()
    t = Tokenizer.from_file(WORDS)
    want = {(r.doc_id, zlib.crc32(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for r in odd.collect() if r.doc_id}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in got) and [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1]]
    assert id_files.round_trip(none, WORDS).count() == 0


def test_licenses(spark, odd, none):
    rows = [(1, "Some prose here.\nReleased under the MIT license\nmore"), (2, "Licensed under CC BY 4.0."), (3, "nothing of the kind"), (4, "This program is free software: you can redistribute it and/or modify it under the terms\nof the GNU General Public License as published by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.")]
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert (got[1].license, got[1].dice, got[2].license, got[3].license, got[4].license) == ("mit", 1.0, "cc-by-4.0", None, "gpl-3.0")
    assert all(r.n_passages == 0 for r in licenses.license_scan(odd).collect()) and licenses.license_scan(none).count() == 0


def test_licenses_in_other_words(spark):
    """Notices inside longer lines, several in one, and paragraphs of whole licence texts; the same rows as the SQL."""
    rows = [
        (1, "Foo is free software, released under the MIT License, see LICENSE."), (2, "x " * 50 + "Licensed under the Apache License, Version 2.0. y and Licensed under CC BY 4.0 z" + " q" * 9), (2, None), (None, "Released under the MIT License."),
        (3, "The above copyright notice and this permission notice shall be included in all copies or\nsubstantial portions of the Software."), (4, "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
        (5, licenses.TEMPLATES[28][1]), (6, "a line\n\n" + licenses.TEMPLATES[24][1].replace("COPYRIGHT HOLDERS", "CONTRIBUTORS") + "\n\nmore"), (7, "the mit license says what a license is, under law, released"),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.license_scan(t).toPandas()
    by = dict(zip(got.doc_id.fillna(0), got.licenses))
    twice = sorted(got[got.doc_id == 2].licenses)
    assert by[1] == "mit" and twice == ["", "apache-2.0,cc-by-4.0"]
    assert (by[3], by[4], by[5], by[6], by[7], by[0]) == ("mit", "apache-2.0", "bsd", "mit", "", "mit")
    agree_with_sql(t, got)


def agree_with_sql(t, got):
    """The SQL compares every window with every template."""
    import duckdb

    c = duckdb.connect()
    c.register("documents", t.toPandas())
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False)))
    assert key(c.sql(licenses.oracle()).df().astype({"doc_id": float})) == key(got.astype({"doc_id": float}))


def test_licenses_with_edits_anywhere(spark):
    """A notice inside 600 other words, with a word changed, left out or added at every place of it."""
    rng, rows = random.Random(8), []
    for name, text in (licenses.TEMPLATES[1], licenses.TEMPLATES[5], licenses.TEMPLATES[9]):
        own = text.split()
        for at in range(len(own)):
            for new in ([], ["other"], [own[at], "other"]):
                around = words(rng, 600)
                rows.append((name, " ".join([*around[:200], *own[:at], *new, *own[at + 1 :], *around[200:]])))
    t = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, text string").repartition(8)
    got = licenses.license_scan(t).toPandas().set_index("doc_id")
    # where the one word that tells versions is changed, or the window's end cuts it off, another version is as near
    near = {"gpl-3.0": {"gpl-3.0", "gpl-2.0", "lgpl-3.0"}}
    assert [i for i, (name, _) in enumerate(rows) if got.license[i] not in near.get(name, {name})] == []
    few = t.where("doc_id % 9 = 0")
    agree_with_sql(few, licenses.license_scan(few).toPandas())
    grams = licenses.bigrams(licenses.TEMPLATES[5][1])
    assert len(licenses.anchors(licenses.TEMPLATES[5][1], dict.fromkeys(grams, 1), 0.8)) == len(grams) // 3 + 1


def test_identifiers_with_blanks_and_many_of_them():
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.disguised(t, pii.find(t))]
    assert found("write jane @ example . com now") == [("email", "jane @ example . com")] and found("to j a n e @ example.com") == [("email", "j a n e @ example.com")]
    assert found("I am at home . com is no host") == [] and found("a @ b") == []
    # overlaps are looked up, not compared one by one
    t = "".join(f"jane [at] e{i}.com or one@e{i}.com " for i in range(30_000))
    began = time.process_time()
    base = pii.find(t)
    more = pii.disguised(t, base)
    assert len(base) == len(more) == 30_000 and time.process_time() - began < 20
    spans = sorted((a, b) for _, a, b in base + more)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_signatures_by_size():
    p = embedding_dedup.Params()
    assert (p.sized(0).bits, p.sized(0).tables) == (16, 48) == (p.sized(4_000_000).bits, p.sized(4_000_000).tables)
    large = p.sized(4_000_000_000)
    assert large.bits == 26 and 100 < large.tables <= 250
    for q in (p.sized(10**6), large):
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** q.bits) ** q.tables <= 0.00135
    assert embedding_dedup.Params(bits=4, tables=2).sized(10**9).tables == 2


def test_html(spark):
    page = lambda i: f'<html><body><div class="top"><a>Home</a></div><div class="wrap"><div class="body"><h2>T {i}</h2><p>Text {i} &amp; more<p>Last {i*7}</div><p>Subscribe</p></div><div class="comments"><p>nice {i}</p></div></body></html>'
    rows = [(i, f"http://x.org/{i}", page(i), "c") for i in range(8)] + [(20, None, None, "c"), (21, "http://y.org", "<article>A <b>b</b> &lt;<script>x</script><nav>n</nav></article>", "c"), (22, "bad", "<p>un<closed", "c"), (23, "http://x.org/e", "", "c")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, content string")).collect()}
    assert got[3] == "T 3\nText 3 & more\nLast 21" and got[20] == "" and got[21] == "A b <" and got[23] == "" and len(got) == 12
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_by_template(spark):
    """Hosts without articles: headings stay, repeated paragraphs too; words of classes count inside articles only where
    the host's template has the element; repeated rows change nothing; and the template makes a difference."""
    page = lambda i: f'<html><body><div><a href="/">Home of all</a> pages of this paper</div><div id="w"><h2>T {i}</h2><p>Text {i} one two</p><p>more {i * 3} three</p></div><div>All rights kept by us</div></body></html>'
    rows = [(i, f"http://x.org/{i}", page(i)) for i in range(8)] * 2
    note = '<div class="legal">About law</div><h2 id="related-work">Related</h2><ol class="reply-steps"><li>one</ol>'
    art = lambda i: f'<body><article><h1>H {i}</h1><p>Text {i}.</p>{note if i == 3 else ""}<div class="comments"><p>nice {i}</p></div></article></body>'
    rows += [(100 + i, f"http://y.org/{i}", art(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "T 2\nText 2 one two\nmore 6 three" != html_text.main_text(page(2))
    assert got[3 + 100] == "H 3\nText 3.\nAbout law\nRelated\none" and got[104] == "H 4\nText 4."


def test_html_template_in_articles(spark):
    """A named element that holds one text on every page of a host goes; repeated sentences and headings stay, and so
    does a named element that has another text on some page."""
    page = lambda i: f'<body><article><h1>T {i}</h1><p>Read our paper daily</p><div class="box">Given by us <b>all</b></div><p class="lead">{"Other" if i == 4 else "Same"}</p><p>Text {i}</p></article></body>'
    rows = [(i, f"http://y.org/{i}", page(i)) for i in range(6)] + [(12, "http://alone.org", page(12))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T 3\nRead our paper daily\nSame\nText 3" and got[4] == "T 4\nRead our paper daily\nOther\nText 4" and got[12] == "T 12\nRead our paper daily\nGiven by us all\nSame\nText 12"


def test_html_adverts_and_comments_in_articles(spark):
    """Headings that all articles share stay; adverts, several in an article, and comments on some pages only go; names
    that speak of such things on single pages, and in headings on all, don't count."""
    ad = '<div class="ad">Buy {}</div>'
    said = '<section class="comments"><h3>Comments</h3><p>reader {} says no</p></section>'
    odd = '<section class="related-work"><p>Works before</p></section>'
    page = lambda i: f'<body><article><h1>T {i}</h1>{ad.format(i)}<h2>Ingredients</h2><p>Flour {i}</p>{ad.format(-i)}<h2 id="related">Method</h2><p>Stir well</p>{odd if i == 5 else ""}{said.format(i) if i % 2 else ""}</article></body>'
    rows = [(i, f"http://r.org/{i}", page(i)) for i in range(10)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T {i}\nIngredients\nFlour {i}\nMethod\nStir well" + ("\nWorks before" if i == 5 else "") for i in range(10))


def test_html_copies(spark):
    """Copies on a host are no template: their texts stay."""
    copy = "<body><p>One text</p><p>Two text</p><p>Three text</p></body>"
    rows = [(i, f"http://x.org/{i}", copy) for i in range(5)] + [(i, f"http://z.org/{i}", copy if i < 4 else f"<body><p>Other {i}</p></body>") for i in range(5, 3, -1)] + [(i, f"http://z.org/{i}", copy) for i in range(6, 10)]
    got = {r.url: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[url] == ("One text\nTwo text\nThree text" if html == copy else html[9:16]) for _, url, html in rows)
    assert html_text.main_text(copy, [], [xxhash.xxh3_128_hexdigest("t" + t) for t in ("One text", "Two text", "Three text")]) != ""


@pytest.mark.parametrize("which", ["toxicity", "quality"])
def test_classifiers(spark, odd, none, which):
    rng = random.Random(8)
    vocab, bad = [f"{a}{b}" for a in ("the", "an", "re", "ti") for b in ("on", "er", "ing", "es")], ["zqvile", "zqmean", "zqbad"]
    rows, labels = [], []
    for i in range(600):
        y = i % 3 == 0
        w = rng.choices(vocab, k=60)
        w = [x + "###" for x in w] if which == "quality" and not y else w
        if which == "toxicity" and y:
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "er", "es"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(y), 9))
    run = partial({"toxicity": toxicity.toxicity, "quality": quality.quality}[which], label_col=which)
    known = spark.createDataFrame(labels + [(None, 1, 9), (3, None, 9)], f"doc_id long, {which} int, score int")
    got = {r.doc_id: r for r in run(docs(spark, rows), known).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    folds = (5, 0) if which == "toxicity" else (4, 2)
    assert held == [i for i, _ in rows if zlib.crc32(str(i).encode()) % folds[0] == folds[1]]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in run(odd, known).collect()) and run(none, known).count() == 0
    assert run(odd, known.limit(0)).count() == 9


@pytest.mark.parametrize("sent", [500_000, 40])
def test_toxicity_against_dictionaries(spark, odd, sent):
    """The log-ratios of words and pairs and the texts' numbers are those of dictionaries, whether they are sent or
    joined."""
    rng = random.Random(12)
    some = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(120)]
    rows = [(i, " ".join(rng.choices(some[: 30 if i % 3 else 120], k=40)), int(i % 3 == 0)) for i in range(60)]
    p = toxicity.Params(sent_words=sent, sent_pairs=sent, sketch_bits=18)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"), p)
    assert (model.frequent > 0) == (model.frequent_pairs > 0) == (sent == 40)
    count, pairs, documents, held, d = [{}, {}], [{}, {}], {}, {}, p.discount
    both = lambda t: list(zip(["", *t.split()], t.split()))
    for _, text, y in rows:
        for to, xs in ((count[y], text.split()), (pairs[y], both(text)), (documents, set(text.split())), (held, set(both(text)))):
            for x in xs:
                to[x] = to.get(x, 0) + 1
    held = {x: k for x, k in held.items() if k >= 2}
    pairs = [{x: k for x, k in of.items() if x in held} for of in pairs]

    def ratios(of, documents):
        n = [sum(c.values()) for c in of]
        left = [min(d * len(c) / m, 1) for c, m in zip(of, n)]

        def ratio(x):
            shared = documents.get(x, 0) / sum(documents.values())
            like = [max(of[y].get(x, 0) - d, 0) / n[y] + left[y] * shared for y in (0, 1)]
            return np.log(like[1] / like[0]) if shared else np.log(left[1] / left[0])

        return ratio

    word, pair = ratios(count, documents), ratios(pairs, held)
    tried = [(i, " ".join(rng.choices(some[:40] + ["new", "newer"], k=rng.randint(1, 60)))) for i in range(25)] + [(80, rows[3][1]), (90, None), (91, "")]
    got = {r.doc_id: r.x for r in toxicity.measure(spark.createDataFrame(tried, "doc_id long, text string"), model, p).collect()}
    for i, text in tried:
        w = (text or "").split()
        want = []
        for own, value in ((w, word), ([x for x in both(text or "") if x in held], pair)):
            high = sorted((value(x) for x in set(own)), reverse=True)
            want += [sum(map(value, own)) / (sum(map(len, w)) + len(w)) if w else 0, high[0] if own else 0, sum(high[:3]) / 3, *(np.log1p(sum(h > c for h in high)) for c in p.cuts)]
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_toxicity_in_each_language(spark):
    """Held-out toxic texts are found in each language, where words of some begin like ordinary ones."""
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(known.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    got = toxicity.toxicity(rows, known).where("held_out").join(rows.select("doc_id", "lang", "toxic"), "doc_id").toPandas()
    for _, g in got[got.toxic > 0].groupby("lang"):
        assert g.predicted.mean() > 0.8
    assert got[got.toxic == 0].predicted.mean() < 0.01


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Null and repeated ids, repeated rows, null and empty texts, other columns, empty tables."""
    import corpus_pipeline as c

    rng = random.Random(17)
    vocab = [f"{a}{b}" for a in ("the", "an", "re", "ti", "mo") for b in ("on", "er", "ing", "es", "al", "um")]
    rows, labels = [], []
    for i in range(300):
        w = rng.choices(vocab, k=40)
        if i % 3 == 0:
            w[rng.randrange(40)] = "zqvile"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    item = " ".join(rng.choices(vocab, k=12))
    base = rows[1][1].split()
    near = " ".join(base[:-1] + ["changed"])
    rows += [(1, near), (1, near), (2, near), (400, rows[1][1]), (4, rows[4][1]), (None, rows[1][1]), (None, rows[1][1]), (5, rows[10][1])]
    rows += [(401, item), (None, f"{rows[7][1]} {item} more"), (7, f"so {item}"), (None, "zqvile " * 9), (402, None), (403, ""), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string, score int, rep long"
    t = spark.createDataFrame([(i, x, "en", "s", len(x or ""), "k", 1, 2) for i, x in rows], schema)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(c.STAGES)

    said = {(r.doc_id, r.text): r.predicted for r in toxicity.toxicity(t, spark.read.parquet(str(tmp_path / "labels.parquet")), carry=("text",)).collect()}
    got = stages["toxicity"](spark, t, str(tmp_path))
    assert left(got) == sorted((x for x in rows if not said[x]), key=str) and got.columns == list(c.COLUMNS)
    assert (None, "zqvile " * 9) not in left(got) and (None, rows[1][1]) in left(got) and {(402, None), (403, ""), (None, None)} <= set(left(got))

    sets = [set(minhash_dedup.shingles(x or "").tolist()) for _, x in rows]
    comp = [i for i, _ in rows]
    for _ in range(4):
        for i, p in enumerate(sets):
            for j, q in enumerate(sets):
                if p and q and comp[i] is not None and comp[j] is not None and 100 * len(p & q) >= 75 * len(p | q):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    keep = {x for x, p, k in zip(rows, sets, comp) if not p or x[0] is None}
    for k in {k for k, p in zip(comp, sets) if p and k is not None}:
        there = {x for x, c_ in zip(rows, comp) if c_ == k and x[0] == k and x[1]}
        kept = set(left(stages["minhash_near_dedup"](spark, t, str(tmp_path)))) if k == min(i for i in comp if i is not None) else kept
        assert len(there & kept) == 1
        keep |= there & kept
    assert kept == keep

    got = left(stages["benchmark_decontamination"](spark, t, str(tmp_path)))
    assert got == sorted((x for x in rows if not brute_hits(x[1] or "", [("b", item)])[1]), key=str) and len(got) < len(rows)
    mail = spark.createDataFrame([(None, "ask a@b.org now", "en", "s", 15), (1, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in stages["pii"](spark, mail, "").collect()), key=str) == [(1, None, 0), (None, "ask <EMAIL> now", 15)]
    for name, stage in c.STAGES:
        assert stage(spark, t.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline(spark):
    import corpus_pipeline as c

    out = c.run(spark, "/root/testdata/sf0.001").toPandas()
    assert [n for n, _ in c.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 2048).all()


def test_links_just_above_the_least_similarity(spark):
    """Of some thousand pairs that barely link, none is missed by all tables."""
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 6000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9301 * a + math.sqrt(1 - 0.9301**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(2 * i + k, i // 1000, v.tolist()) for i in range(6000) for k, v in enumerate((a[i], b[i]))]
    table = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == {2 * i + k: (1, 2 * i) for i in range(6000) for k in (0, 1)}


def test_pairs_are_packed():
    """A pair of words that wasn't sent is asked for with less than 9 bytes and comes back with less than 3."""
    rng = np.random.default_rng(6)
    keys, text, times = np.sort(rng.integers(0, 1 << 64, 45_000, dtype=np.uint64)), rng.integers(0, 9_000, 45_000).astype(np.uint32), np.ones(45_000, np.uint32)
    data = packed(keys, text, times)
    assert len(data) < 9 * len(keys) and all((a == b).all() for a, b in zip(unpacked(data, "<u4", "<u4"), (keys, text, times), strict=True))
    ratio, text = rng.choice(np.linspace(-3, 3, 60).astype(np.float32), len(text)), np.sort(text)
    data = toxicity._answer(text, ratio, times)
    assert len(data) < 3 * len(keys) and all((a == b).all() for a, b in zip(toxicity._answer_read(data), (text, ratio, times), strict=True))
    assert [len(x) for x in unpacked(packed(keys[:0], text[:0]), "<u4")] == [0, 0]


def test_passes_of_tables():
    """Each pass deals a vector to tables of its own, 48 at most for 16 bits."""
    p = embedding_dedup.Params().sized(4_000_000)
    vectors = pa.RecordBatch.from_pydict({"vec_id": [1, 2], "embedding": [[1.0, 2.0, 3.0], [1.0, 2.0, 3.5]], "label": ["a", "a"]})
    signed = next(embedding_dedup._signed(iter([vectors]), p, "<f4"))
    classes = pa.RecordBatch.from_arrays([signed.column(c) for c in ("vec_id", "peers", "codes")], names=["rep", "peers", "codes"])
    passes = [next(embedding_dedup._bucketed(iter([classes]), p, turn)) for turn in range(p.passes)]
    assert [b.num_rows for b in passes] == [2 * 48] * 3
    assert sorted(t for b in passes for t in b.column("tab").to_pylist()) == sorted(2 * list(range(144)))
    assert len({x for b in passes for x in b.column("bucket").to_pylist()}) > 144 * 0.9


def test_toxicity_asks_in_passes(spark, monkeypatch):
    """Words and pairs that weren't sent are asked in passes, whose shuffles stay in proportion to the texts however many
    of their pairs the model has; the rows and their numbers are those of one pass."""
    rng = random.Random(21)
    some = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(90)]
    t = spark.createDataFrame([(i, " ".join(rng.choices(some, k=60)), int(i % 3 == 0)) for i in range(200)], "doc_id long, text string, y int")
    own = t.select("doc_id", "text").union(spark.createDataFrame([(7, None), (None, "new words"), (None, "new words"), (None, None)], "doc_id long, text string"))
    p = toxicity.Params(sent_words=20, sent_pairs=20, sketch_bits=18, exchange=1e9)
    model = toxicity.fit(t, p)
    real, parts = toxicity._exchanged, []
    monkeypatch.setattr(toxicity, "_exchanged", lambda *a: parts.append(real(*a)) or parts[-1])
    of = lambda p: sorted(((r.doc_id, *np.round(r.x, 9)) for r in toxicity.measure(own, model, p).collect()), key=str)
    one = of(p)
    assert len(parts) == 1 and len(one) == 204
    few = toxicity.Params(sent_words=20, sent_pairs=20, sketch_bits=18, exchange=0.5)
    assert of(few) == one and len(parts) > 3
    assert sum(x.count() for x in parts[1:]) == 204 and max(x.count() for x in parts[1:]) < 204 * 2 / (len(parts) - 1)
    full = dataclasses.replace(model, rare=model.running)
    assert toxicity._passes(full, 1.0, few) == toxicity._passes(full, 0.0, few) == math.ceil(model.running * toxicity.ASKED_BYTES / 0.5)


def test_words_that_the_model_lacks_are_not_asked():
    """Only words that the sketch lets through are asked for; all that weren't sent count as unseen."""
    p = toxicity.Params(sketch_bits=18)
    rare = np.array([xxhash.xxh64_intdigest(w) for w in (b"rare", b"seldom")], np.uint64)
    sketch = np.zeros((2, 1 << 18), np.uint8)
    for row, at in zip(sketch, toxicity._cells(rare, 2, 18)):
        row[at] = 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    _, (words, pairs) = toxicity._Scorer(none, none, (np.packbits(sketch, axis=1), None), p).measure(["rare new newer rare", "seldom newest"])
    assert [x.tolist() for x in words.left[0]] == [[int(rare[0])], [0], [2]] and [x.tolist() for x in words.left[1]] == [[int(rare[1])], [1], [1]]
    assert words.unseen.tolist() == [3, 2] and words.all_unseen.tolist() == [4, 2] and not pairs.left


def test_shuffle_files_go_between_passes(tmp_path):
    """Once a table is stored and collected() has returned, the shuffle that made it leaves the disk."""
    code = """
import os, sys, time
from pyspark.sql import SparkSession
from quillmesh.llm.common import collected, written
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1] + "/l").config("spark.checkpoint.dir", sys.argv[1] + "/s").getOrCreate()
shuffles = lambda: sum(f.startswith("shuffle_") for _, _, files in os.walk(sys.argv[1] + "/l") for f in files)
for _ in range(3):
    written(s.range(100_000).repartition(4, "id"))
    assert shuffles()
    collected(s)
    end = time.time() + 10
    while shuffles() and time.time() < end:
        time.sleep(0.1)
    print("left", shuffles())
"""
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": os.pathsep.join(p or "." for p in sys.path)})
    assert done.stdout.split() == ["left", "0"] * 3, done.stderr[-2000:]


def test_crowded_buckets_move_no_vectors(spark):
    """Vectors that share buckets without linking are told apart by their sketches: what is shuffled stays below 250 bytes a
    vector and table, though each meets hundreds of the others."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 128)) * 0.1 + np.eye(128)[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert links.sum() == 0 and (u @ u.T).mean() > 0.4
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<double>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [got[i] for i in range(4000)] == links.tolist()
    assert shuffled() - before < 144 * 250 * 4000


def test_rounds_of_tables(spark, monkeypatch):
    """Tables dealt in more rounds and pairs checked in slices give the rows of one round; large groups of near copies are
    compared in blocks, small ones listed, and a pair counts once wherever it meets."""
    rng = np.random.default_rng(9)
    sizes = [1] * 200 + [2] * 30 + [5] * 10 + [30, 300]
    base = np.repeat(rng.standard_normal((len(sizes), 24)), sizes, axis=0)
    x = base + rng.standard_normal(base.shape) * 0.15
    x[1::50] = x[::50]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    table = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    p = embedding_dedup.Params(bits=6, tables=9, passes=4, block=16)
    made, real = [], embedding_dedup._candidates
    monkeypatch.setattr(embedding_dedup, "_candidates", lambda *a: made.append(real(*a)) or made[-1])
    of = lambda: sorted(map(tuple, embedding_dedup.near_duplicates(table, params=p).collect()))
    one = of()
    assert len(made) == 4 and [r[1] for r in one] == links.tolist()
    monkeypatch.setattr(embedding_dedup, "ROOM", 1)
    assert of() == one and 4 < len(made) - 4 < 36
    assert [t for k in range(8) for t in embedding_dedup._tabs(p, k, 2)] == list(range(36))
