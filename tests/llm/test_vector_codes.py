"""Metric trees and vector codes against plain loops and SQL."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tideway.llm.metric_trees import anchors, exact_squared, grow, nearest
from tideway.llm.vector_codes import compress, with_group_error


def slow_nearest(points, entries):
    return [min(range(len(entries)), key=lambda e: (sum((int(a) - int(b)) ** 2 for a, b in zip(p, entries[e])), e)) for p in points]


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "few", "huge", "line"])
def test_trees_are_exact(kind):
    rng = np.random.default_rng(5)
    points = {
        "spread": rng.integers(-300, 300, (700, 6)), "equal": np.full((300, 3), 7), "few": rng.integers(-3, 3, (5, 2)),
        "clusters": rng.integers(-9, 9, (900, 4)) + 500 * rng.integers(0, 4, (900, 1)), "huge": rng.integers(-(1 << 26), 1 << 26, (200, 9)),
        "line": np.arange(400)[:, None] // 3,
    }[kind]
    for count in (1, 2, 17):
        entries = np.concatenate([points[rng.integers(0, len(points), count)]] * 2)  # every entry twice: ties
        tree = grow(points, leaf=8)
        assert sorted(tree.order) == list(range(len(points)))
        for i, (a, b) in enumerate(zip(tree.lo, tree.hi)):
            inside = points[tree.order[a:b]]
            assert (tree.sums[i] == inside.sum(axis=0)).all()
            assert (np.sqrt(((inside - tree.sums[i] / (b - a)) ** 2).sum(axis=1)) <= tree.radius[i] * (1 + 1e-9) + 1e-6).all()
        label, sums, counts = nearest(tree, points, entries)
        assert label.tolist() == slow_nearest(points, entries)
        for e in range(len(entries)):
            assert counts[e] == (label == e).sum() and (sums[e] == points[label == e].sum(axis=0)).all()


def test_owned_balls_spare_points(monkeypatch):
    import tideway.llm.metric_trees as trees

    rng = np.random.default_rng(1)
    points = rng.integers(-9, 9, (4000, 4)) + 10_000 * rng.integers(0, 8, (4000, 1))
    entries, seen = np.array([[10_000 * n] * 4 for n in range(8)]), []
    monkeypatch.setattr(trees, "exact_squared", lambda a, b: seen.append(len(a)) or exact_squared(a, b))
    assert trees.nearest(grow(points), points, entries)[0].tolist() == slow_nearest(points, entries)
    assert sum(seen) == len(entries)  # only the distances between entries: every ball was owned


def test_anchor_owners_are_nearest():
    points = np.random.default_rng(2).integers(0, 100, (300, 3)).astype(float)
    owner = anchors(points, 12)
    assert owner.max() == 11 and len(anchors(np.zeros((4, 2)), 3)) == 4
    assert anchors(np.zeros((4, 2)), 3).max() == 0


def slow_codes(rows, parts, k, rounds):
    fit = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fit = [(i, v) for i, v in fit if len(v) == len(fit[0][1])]
    wide = -(-len(fit[0][1]) // parts)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (wide * parts - len(v)) for _, v in fit]
    cut = [[v[p * wide : (p + 1) * wide] for v in whole] for p in range(parts)]
    books = [c[:k] for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            near = slow_nearest(cut[p], books[p])
            books[p] = [
                [math.floor(sum(col) / near.count(e)) for col in zip(*[v for v, n in zip(cut[p], near) if n == e])] if e in near else old
                for e, old in enumerate(books[p])
            ]
    near = [slow_nearest(cut[p], books[p]) for p in range(parts)]
    out = []
    for n, (i, _) in enumerate(fit):
        error = sum((a - b) ** 2 for p in range(parts) for a, b in zip(cut[p][n], books[p][near[p][n]]))
        out.append((i, "".join(f"{near[p][n]:02x}" for p in range(parts)), error))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [float(np.float32(x)) for x in rng.normal(0, 0.3, 10)]) for n in range(150)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1]), (200, None), (201, []), (202, [1.0, None] * 5), (203, [float("nan")] * 10),
             (204, [float("inf")] + [0.0] * 9), (-7, [float("-inf")] * 10), (205, [0.5]), (206, [0.0] * 10)]
    data = [(i, v, n % 3 if n % 4 else None, "x") for n, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, error string").repartition(3)
    coded, books = compress(df, parts=4, entries=9, rounds=3, chunk=40)
    assert coded.columns == ["vec_id", "embedding", "label", "code", "error"]
    got = with_group_error(coded, "label", "label_error").collect()
    want, digest = slow_codes(rows, 4, 9, 3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=key) == sorted(want, key=key)
    assert books.digest() == digest
    for r in got:
        assert r.label_error == sum(x.error for x in got if x.label == r.label)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    coded, books = compress(df)
    assert coded.count() == 0 and books.entries.shape == (4, 0, 1)


def test_query(same_as_sql):
    same_as_sql("op12_vector_codes")
