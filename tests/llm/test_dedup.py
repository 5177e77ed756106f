"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash

from tideway.llm.components import connected_components
from tideway.llm.exact_dedup import exact_dedup
from tideway.llm.simhash import Forest, fingerprint, simhash_dedup, simhash_groups, trie_links

DOCS = "doc_id long, text string, keep_id string, _sh_row int"
ROWS = [
    (3, "a  b", "x", 1), (1, "a b", "y", 2), (2, "a\tb", None, 3), (4, None, "z", 4), (5, "", "z", 5), (None, "a b", "n", 6),
    (6, "a b ", "p", 7), (7, "unlike", "q", 8), (7, "unlike", "q", 8), (8, "word " * 30_000, "long", 9), (9, "É é", "u", 10),
]


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("parts", [1, 4])
def test_exact_cases(spark, parts):
    out = exact_dedup(spark.createDataFrame(ROWS, DOCS), parts=parts)
    assert out.columns == ["doc_id", "text", "_sh_row", "keep_id", "group_size", "kept", "text_sha256"]
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(ROWS)
    for r in got:
        same = [i for i, t, *_ in ROWS if normal(t) == normal(r["text"])]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == min(i for i in same if i is not None)
        assert r["text_sha256"] == hashlib.sha256(normal(r["text"]).encode()).hexdigest()
    kept = [(r["doc_id"]) for r in got if r["kept"]]
    assert sorted(kept) == [1, 4, 6, 7, 8, 9]


def test_exact_hot_text_is_cut(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 50}", "", 0) for i in range(3000)]
    out = exact_dedup(spark.createDataFrame(rows, DOCS).repartition(7), parts=8, carry=False).collect()
    hot = [r for r in out if r.doc_id % 3 == 0]
    assert {(r.keep_id, r.group_size) for r in hot} == {(0, 1000)} and [r.doc_id for r in hot if r.kept] == [0]
    for r in out:
        if r.doc_id % 3:
            same = [i for i, t, *_ in rows if t == f"text {r.doc_id % 50}"]
            assert (r.keep_id, r.group_size, r.kept) == (same[0], len(same), r.doc_id == same[0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup(none).count() == 0
    assert simhash_groups(none).count() == 0 and simhash_dedup(none).count() == 0


def slow_fingerprint(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprint():
    for text in (None, "", " \n", "One", "one TWO", "É É é", "a b c d e f " * 40, "x " * 70_000, "a\x1cb c\x85d e"):
        assert fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    for text in ("", "a b c", "ééé längere wörter hier und mehr als 32 bytes"):
        row = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) h").first()
        assert row.h % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_meets_every_near_pair_once(budget):
    rng = np.random.default_rng(budget)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) % 2**64 for _ in range(900)], np.uint64)
    fps = np.unique(np.concatenate((seeds[rng.integers(0, 40, 900)] ^ noise, rng.integers(0, 2**63, 300, dtype=np.uint64))))
    want = {(i, j) for j in range(len(fps)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= budget}
    met = []
    trie_links(fps, fps, 0, 0, budget, True, lambda i, j: met.extend(zip(i.tolist(), j.tolist())))
    assert len(met) == len(set(met)) and set(met) == want
    low = fps < 2**62
    a, b = fps[low], fps[~low & (fps < 2**63)]
    met = []
    trie_links(a, b, 2, 1, budget, False, lambda i, j: met.extend(zip(i.tolist(), j.tolist())))
    near = {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= budget}
    assert len(met) == len(set(met)) and set(met) == near


def test_forest():
    f = Forest(8)
    f.add(np.array([7, 5, 3]), np.array([5, 3, 1]))
    f.add(np.array([2]), np.array([6]))
    assert f.root.tolist() == [0, 1, 2, 1, 4, 1, 2, 1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(50, 60), (60, 50), (70, 70), (None, 3), (60, 55)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 55: 50, 70: 70}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_cases(spark):
    rows = ROWS + [(100 + i, " ".join(f"w{k}" for k in range(200 + i)), "m", i) for i in range(6)]
    out = simhash_groups(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "keep_id", "_sh_row", "fingerprint", "component_id", "kept"]
    got = out.select("doc_id", "text", "fingerprint", "component_id", "kept").collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(r.text) for r in got]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == slow_components([r.doc_id for r in got], prints)
    for c in {r.component_id for r in got}:
        assert [r.doc_id for r in got if r.component_id == c and r.kept] == [c]
    stay = simhash_dedup(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in stay.collect()) == sorted({r.component_id for r in got})
    assert stay.columns == ["doc_id", "text", "keep_id", "_sh_row"]


def test_simhash_query(spark, sf):
    from tideway.llm.queries import QUERIES

    got = QUERIES["op6_simhash"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = [slow_fingerprint(texts[r.doc_id]) for r in got]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == slow_components([r.doc_id for r in got], prints)
