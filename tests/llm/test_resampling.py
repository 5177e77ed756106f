"""Importance resampling against plain loops and SQL."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from tideway.llm.resampling import States, resample, run_buckets, words_in

DOCS = "doc_id long, text string, weight string, _ir_n int"


def slow_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_runs(text, longest):
    w = slow_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def slow_resample(docs, goal, longest, buckets, percent, least):
    where = lambda run: crc32(run.encode()) % buckets
    s, t = (Counter(where(x) for text in texts for x in slow_runs(text, longest)) for texts in ([d[1] for d in docs], goal))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    rows = []
    for i, text, *_ in docs:
        runs = slow_runs(text, longest)
        weight = sum(gain(where(x)) for x in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r, d in zip(rows, docs) if len(slow_words(d[1])) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): n + 1 for n, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*r, drawn.get(id(r))) for r in rows)


ROWS = [
    (3, "One two three, four! FIVE-six", "a", 1), (None, "one two one two one", None, 2), (7, None, "b", 3), (8, "", "b", 3), (9, "?? !!", "c", 4),
    (4, "École école É x1  y", "d", 5), (4, "École école É x1  y", "d", 5), (1, "word " * 40_000, "long", 6),
    *[(20 + i, f"two words {i % 7} three one", "e", i) for i in range(30)],
]
GOAL = ["one two three", None, "", "three four five", "École words"]


@pytest.mark.parametrize("longest, head", [(1, 3), (1, 1000), (2, 2), (2, 1000), (3, 2), (3, 1000)])
def test_cases(spark, longest, head):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    goal = spark.createDataFrame([(g,) for g in GOAL], "text string")
    out = resample(docs, goal, longest=longest, buckets=97, percent=40, least=3, head=head)
    assert out.columns == ["doc_id", "text", "_ir_n", "n_features", "weight", "score", "rank"]
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
    assert got == slow_resample(ROWS, GOAL, longest, 97, 40, 3)


def test_empty_tables(spark):
    docs, goal = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([], "text string")
    assert resample(docs.limit(0), docs).count() == 0
    assert {r["rank"] for r in resample(docs, goal, least=10**6).collect()} == {None}
    assert sum(r["rank"] is not None for r in resample(docs, goal, percent=100, least=0).collect()) == len(ROWS)


def test_head_changes_nothing():
    words = words_in("the cat The cat sat on\tthe MAT été".encode())
    assert words == [b"the", b"cat", b"the", b"cat", b"sat", b"on", b"the", b"mat", "été".encode()]
    for longest in (1, 2, 3, 12):
        plain = run_buckets(words, longest, States(), {}, 1000)
        pair = b"the cat"
        assert (plain == run_buckets(words, longest, States({b"the": crc32(b"the")}), {pair: crc32(pair) % 1000}, 1000)).all()
    assert len(run_buckets([], 2, States(), {}, 10)) == 0


def test_query(same_as_sql):
    same_as_sql("op13_resampling")
