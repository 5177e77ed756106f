"""Packing, mixing and training order: exact round trips and invariants."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideway.llm import mixing
from tideway.llm.mixing import mix, pivot, settle, source_targets
from tideway.llm.packing import pack, places, shortest_pack_first
from tideway.llm.tokens import default_vocabulary, encode
from tideway.llm.training_order import permute, read_from, training_order

DOCS = "doc_id long, text string, source string, size int, length string"
ROWS = [
    (1, "one two three", "b", 0, "x"), (2, None, "a", 0, "x"), (3, "", None, 0, None), (None, "four five", None, 0, "x"),
    (4, "word " * 30_000, "a", 0, "x"), (5, "one two three", "b", 0, "x"), (5, "one two three", "b", 0, "x"),
    (6, "an <|endoftext|> inside", "c", 0, "x"), (7, "  spaces\n\n and  ends  　x ", "c", 0, "x"),
]


@functools.cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary()[0])


def whole_ids(text):
    return [*whole_tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_both_vocabulary_files_agree(text):
    assert [*encode(text, default_vocabulary()).tolist(), 0] == whole_ids(text)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 50), max_size=20))
def test_plan_places_everything(counts):
    plan = shortest_pack_first(counts, 64)
    placed = {}
    for packs, pattern in plan:
        assert sum(pattern) <= 64 and packs > 0
        for size in pattern:
            placed[size] = placed.get(size, 0) + packs
    assert placed == {k: v for k, v in counts.items() if v}
    rows = places(plan)
    for size, n in placed.items():
        ranges = sorted((r[1], r[2]) for r in rows if r[0] == size)
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def check_pieces(pieces, docs, length=1024):
    """Every id in one piece, sequences without gaps; returns the share of filling."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want = [np.array(whole_ids(t), "<u4") for _, t, *_ in docs]
    assert sum(p.length for p in pieces) == sum(map(len, want))
    for (doc, tokens), own in by_doc.items():
        texts = [w for (i, *_), w in zip(docs, want) if i == doc and len(w) == tokens]
        for p in own:
            assert p.ids in {w[p.start : p.start + p.length].tobytes() for w in texts}
        starts = {}
        for p in own:
            starts[p.start] = starts.get(p.start, 0) + 1
        assert set(starts.values()) == {len(texts)}
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return 1 - sum(p.length for p in pieces) / (length * len(by_seq)) if by_seq else 0


@pytest.mark.parametrize("parts", [1, 5])
def test_pack_cases(spark, parts):
    out = pack(spark.createDataFrame(ROWS, DOCS).repartition(parts))
    assert out.columns == ["doc_id", "text", "source", "size", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check_pieces(out.collect(), ROWS)
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_pack_query(spark, sf):
    from tideway.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pieces = pack(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"]).collect()
    assert check_pieces(pieces, docs) < 0.05
    told = {(r.doc_id, r.start): r.ids_crc32 for r in QUERIES["op7_packing"](spark, sf).collect()}
    assert told == {(p.doc_id, p.start): zlib.crc32(p.ids) for p in pieces}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 500), st.floats(0, 0.999)), min_size=1, max_size=40))
def test_pivot_keeps_words(rows):
    p, size, draw = (np.array(x) for x in zip(*rows))
    out = pivot(p, size, draw)
    assert abs((p * size).sum() - (out * size).sum()) < 1e-4 and ((out > 0) & (out < 1)).sum() <= 1
    end = settle(out, size, 0.3)
    assert set(end) <= {0.0, 1.0}
    assert abs((end * size).sum() - (p * size).sum()) <= size.max() + 1e-6


def test_pivot_is_unbiased():
    rng = np.random.default_rng(0)
    p, size = np.array([0.3, 0.3, 0.3, 0.3, 0.3]), np.array([90, 50, 20, 10, 5])
    total = np.zeros(5)
    for _ in range(4000):
        out = pivot(p, size, rng.random(5))
        total += np.where((out > 0) & (out < 1), rng.random(5) < out, out)
    assert np.abs(total / 4000 - 0.3).max() < 0.05


def slow_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "é": 1000, "Z": 7, None: 50}, {"a": 0, "b": 9}, {"x": 4}, {None: 3, "": 90}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_mix_cases(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 7)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = ROWS + [(100 + i, "w " * (1 + i * 7 % 90), ("hot" if i % 2 else f"s{i % 7}"), 0, "x") for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    out = mix(df)
    assert out.columns == ["doc_id", "text", "source", "length", "size", "source_size", "target", "copies"]
    got = out.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = slow_targets(sizes)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(want[source]) for r in own)
        assert all(0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[source]) <= max(r.size for r in own)
    again = {(r.doc_id, r.copies) for r in mix(df.repartition(5), carry=False).collect() if r.doc_id and r.doc_id >= 100}
    assert again == {(r.doc_id, r.copies) for r in got if r.doc_id and r.doc_id >= 100}
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_query(spark, sf):
    from tideway.llm.queries import QUERIES

    got = QUERIES["op10_mixing"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both["size"] == both.text.str.count(r"[^\x20\x09-\x0D]+")).all()
    for _, own in both.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    assert (got.taken <= 3 * got["size"]).all()


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(total):
    slots = permute(np.arange(total), total, 9)
    assert sorted(slots.tolist()) == list(range(total))
    assert (permute(slots, total, 9, back=True) == np.arange(total)).all()
    if total > 60:
        assert (slots != permute(np.arange(total), total, 10)).any() and (slots != np.arange(total)).mean() > 0.9


@pytest.mark.parametrize("parts", [1, 3])
def test_training_order(spark, tmp_path, parts):
    folder = str(tmp_path / "table")
    spark.createDataFrame(ROWS, DOCS).repartition(parts).write.parquet(folder)
    df = spark.read.parquet(folder)
    manifest, layout = training_order(df, length=64, per_shard=50, path=str(tmp_path / "shards"))
    rows = {r.slot: r for r in manifest.collect()}
    assert sorted(rows) == list(range(layout.total))
    records = list(read_from(layout))
    assert len(records) == layout.total
    for slot, ids in enumerate(records):
        r = rows[slot]
        assert (r.shard, r.record, len(ids)) == (slot // 50, slot % 50, 64) and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
    kept = sorted(i for slot, ids in enumerate(records) for i in ids[: rows[slot].n_tokens].tolist())
    assert kept == sorted(i for _, t, *_ in ROWS for i in whole_ids(t))
    at = layout.total // 2
    assert all((a == b).all() for a, b in zip(read_from(layout, at), records[at:]))
    # A second run leaves complete shards alone and repairs a torn one.
    files = sorted((tmp_path / "shards").iterdir())
    before = [f.stat().st_mtime_ns for f in files]
    files[0].write_bytes(b"torn")
    again, _ = training_order(df, length=64, per_shard=50, path=str(tmp_path / "shards"))
    assert {r.slot: r for r in again.collect()} == rows
    assert [f.stat().st_mtime_ns for f in files[1:]] == before[1:] and files[0].stat().st_size > 4
    empty, none = training_order(df.filter("false"), length=64)
    assert empty.count() == 0 and none.total == 0


def test_training_order_query(spark, sf):
    from tideway.llm.queries import QUERIES, table

    docs = table(spark, sf, "documents").select(F.spark_partition_id().alias("part"), "doc_id", "text").collect()
    runs, want = {}, []
    for part, doc, text in docs:
        runs.setdefault(part, []).extend((t, doc) for t in whole_ids(text))
    sequences = [run[at : at + 1024] for _, run in sorted(runs.items()) for at in range(0, len(run), 1024)]
    for slot, run in zip(permute(np.arange(len(sequences)), len(sequences), 20240601).tolist(), sequences):
        ids = np.array([t for t, _ in run] + [0] * (1024 - len(run)), "<u4")
        want.append((slot, slot // 4096, slot % 4096, run[0][1], len(run), zlib.crc32(ids)))
    assert sorted(tuple(r) for r in QUERIES["op4_training_order"](spark, sf).collect()) == sorted(want)
