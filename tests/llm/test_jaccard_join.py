"""Exact Jaccard join against brute force and SQL."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tideway.llm.jaccard_join import WordHashes, fold, jaccard_components, needed, overlap, shingle_set, signature, signature_bits

DOCS = "doc_id long, text string, n int, component_id string"


def slow_set(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    width = min(width, len(w))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if w else frozenset()


def slow_components(rows, width, least):
    sets = [slow_set(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], len(s), lowest[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def varied(rng, words, share, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" if rng.random() < share else w for w in words]


def planted(seed=1):
    """Chains, hubs, a template, copies and short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [" ".join(fresh(rng.randrange(1, 60))) for _ in range(60)]
    base = fresh(120)
    for share in (0.005, 0.02, 0.04, 0.06):
        texts += [" ".join(varied(rng, base, share)) for _ in range(15)]
    chain = fresh(100)
    for _ in range(25):  # each near the last, the ends far apart
        chain = chain[4:] + fresh(4)
        texts.append(" ".join(chain))
    template = fresh(70)
    texts += [" ".join(template + fresh(30)) for _ in range(30)]
    hub = fresh(200)
    texts += [" ".join(hub)] + [" ".join(hub[:at] + fresh(18) + hub[at + 18 :]) for at in range(0, 180, 6)]
    texts += ["a b", "A\tB", "a b c", "a b c d", "a b c d", "d c b a", "", "  ", None, "x", "é É", "é é"]
    rows = [(i, t, i % 3, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, "a b", 0, ""), (None, "lonely words of nobody", 0, ""), (3, "x", 0, ""), (3, "x", 0, "")]


@pytest.mark.parametrize("width, least, block", [(4, 85, 4), (5, 80, 7), (3, 100, 1024)])
def test_components(spark, width, least, block):
    rows = planted(width)
    out = jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5), width=width, least=least, block=block, bits=14)
    assert out.columns == ["doc_id", "text", "n", "n_shingles", "component_id"]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert got == slow_components(rows, width, least)


def test_loose_hub(spark):
    """A hub near many texts that are not near each other, in more blocks than one."""
    rng = random.Random(4)
    hub = [f"h{i}" for i in range(200)]
    texts = [hub] + [hub[:at] + [f"s{n}_{k}" for k in range(13)] + hub[at + 13 :] for n, at in enumerate(rng.randrange(0, 187) for _ in range(150))]
    rows = [(i, " ".join(t), 0, "") for i, t in enumerate(texts)]
    out = jaccard_components(spark.createDataFrame(rows, DOCS), block=16, bits=14)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == slow_components(rows, 4, 85)


def test_long_and_empty(spark):
    long = " ".join(f"w{i % 30_000}" for i in range(60_000))
    rows = [(1, long, 0, ""), (2, long + " tail", 0, ""), (3, "word " * 50_000, 0, ""), (4, "word word word word word", 0, ""), (5, "word word", 0, "")]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, DOCS), bits=14).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert jaccard_components(spark.createDataFrame([], DOCS), bits=14).count() == 0


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m, both = (int(x) for x in rng.integers(1, 900, 3))
        both = min(n, m, both)
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))[: n + m - both]
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        x, y = np.frombuffer(signature(a), np.uint8), np.frombuffer(signature(b), np.uint8)
        assert len(x) * 8 == signature_bits(len(a))
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
        common = len(np.intersect1d(a, b))
        assert overlap(a, b) == common <= (len(a) + len(b) - differ) // 2
        want = int(needed(np.int64(len(a)), np.int64(len(b)), 85))
        assert (common >= want) == (100 * common >= 85 * (len(a) + len(b) - common))


def test_shingles_are_the_words_runs():
    known = WordHashes()
    for text in ("", " \t", "a", "A b", "a  B c d", "a b c d a b c d a", "É é x y z"):
        assert len(shingle_set(text.encode(), 4, known)) == len(slow_set(text, 4))
    same = [shingle_set(t, 4, known).tolist() for t in (b"one two THREE four", b"ONE\ntwo three\x0bfour ")]
    assert same[0] == same[1]


def test_query(same_as_sql):
    same_as_sql("op11_jaccard_join")


def test_a_loose_group_is_verified_by_few_pairs(spark, monkeypatch):
    """Texts that are mostly near each other, none near all: links are looked for by one pair a text and round."""
    from tideway.llm import jaccard_join

    counts, verify = [], jaccard_join.verified

    def counted(pairs, stored, least):
        counts.append(pairs.count())
        return verify(pairs, stored, least)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(160)]
    rows = [(i, " ".join(varied(rng, base, rng.choice((0.015, 0.02, 0.025)), 10**6)), 0, "") for i in range(200)]
    out = jaccard_components(spark.createDataFrame(rows, DOCS), bits=14)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == slow_components(rows, 4, 85)
    assert max(counts) <= 2 * len(rows)


def test_rounds_end_when_few_pairs_are_left(spark, monkeypatch):
    """A small loose group among many texts takes one round, and classes are not put together again without a link."""
    from tideway.llm import jaccard_join

    rounds, near, joined = [], jaccard_join.nearest, jaccard_join.joined_classes

    def met(classes, links):
        assert not links.isEmpty()
        return joined(classes, links)

    monkeypatch.setattr(jaccard_join, "nearest", lambda *a: rounds.append(1) or near(*a))
    monkeypatch.setattr(jaccard_join, "joined_classes", met)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(160)]
    rows = [(i, " ".join(varied(rng, base, rng.choice((0.015, 0.02, 0.025)), 10**6)), 0, "") for i in range(30)]
    rows += [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)), 0, "") for i in range(30, 1830)]
    out = jaccard_components(spark.createDataFrame(rows, DOCS), bits=14)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == slow_components(rows, 4, 85)
    assert len(rounds) == 1
    apart = [(1, "a b c d e f", 0, ""), (2, "g h i j k l", 0, "")]
    assert [r.component_id for r in jaccard_components(spark.createDataFrame(apart, DOCS), bits=14).orderBy("doc_id").collect()] == [1, 2]


def test_short_tables_go_by_narrow_pairs_and_few_tasks(spark, monkeypatch):
    """Shingles that few texts share move no signatures through tiles; tables are not written by a task a partition."""
    from tideway.llm import components, jaccard_join

    met, tasks, tiles = [], [], jaccard_join.tiles

    def seen(rows, *more):
        met.append(rows.count())
        return tiles(rows, *more)

    def counted(df, label, **options):
        out = write(df, label, **options)
        tasks.append((label, len(out.inputFiles())))
        return out

    write = jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "tiles", seen)
    for module in (jaccard_join, components):
        monkeypatch.setattr(module, "materialise", counted)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in range(40):  # three texts share a third of their words and no link, a fourth is near the first
        head, tail = fresh(30), fresh(60)
        rows += [(4 * n + k, " ".join(head + (tail if k in (0, 3) else fresh(60)) + fresh(k)), 0, "") for k in range(4)]
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, DOCS), bits=14).collect()), key=str)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == slow_components(rows, 4, 85) and len({r[2] for r in got}) < len(rows)
    assert sum(met) == 0
    assert max(n for label, n in tasks if label not in ("narrow", "linked")) <= 16
