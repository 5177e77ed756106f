"""The attention model and the scores made with it."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tideway.llm import lm
from tideway.llm.lm_scoring import score_texts

SMALL = lm.Shape(ids=40, symbols=32, classes=6, width=4, window=8, stride=5, buckets=4)


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 40, n) for n in (1, 3, 8, 9, 13, 40, 57)]
    follow = np.zeros((40, 4), np.float32)
    for d in docs[:5]:
        np.add.at(follow, (d, lm.bucket_of(np.concatenate(([39], d[:-1])), SMALL)), 1)
    return lm.start_model(follow, SMALL), docs


def test_windows_score_every_id_once():
    _, docs = small_model()
    docs.append(np.zeros(0, np.int64))
    inp, out, scored, doc = lm.windows(docs, 39, SMALL)
    for i, d in enumerate(docs):
        own = doc == i
        assert out[own][scored[own]].tolist() == d.tolist()
        assert inp[own][scored[own]].tolist() == [39, *d.tolist()][: len(d)]


def test_chances_sum_to_one():
    model, _ = small_model()
    context = np.array([3, 17, 20, 5])
    total = sum(10 ** (lm.score(model, [np.append(context, i)], 39)[0] - lm.score(model, [context], 39)[0]) for i in range(40))
    assert total == pytest.approx(1, rel=1e-4)


def test_no_window_sees_what_follows():
    model, _ = small_model()
    a, b = np.arange(8), np.array([0, 1, 2, 3, 4, 9, 9, 9])
    la, lb = (lm.forward(model.weights, model.symbol[x[None]])[0][0, :5] for x in (a, b))
    assert np.allclose(la, lb, atol=1e-6)


def test_gradients():
    model, docs = small_model()
    inp, out, scored, _ = lm.windows(docs, 39, SMALL)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    args = model.symbol[inp], model.cls[out], scored
    _, g = lm.gradients(w, *args)
    rng = np.random.default_rng(1)
    for k in w:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            old, e = w[k][at], 1e-4
            w[k][at] = old + e
            up = lm.gradients(w, *args)[0]
            w[k][at] = old - e
            down = lm.gradients(w, *args)[0]
            w[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=2e-5), k


def test_training_helps():
    rng = np.random.default_rng(2)
    docs = [np.array([(s + i * step) % 40 for i in range(60)]) for s, step in zip(rng.integers(0, 40, 60), rng.integers(1, 3, 60))]
    follow = np.zeros((40, 4), np.float32)
    for d in docs:
        np.add.at(follow, (d, lm.bucket_of(np.concatenate(([39], d[:-1])), SMALL)), 1)
    model = lm.start_model(follow, SMALL)
    before = lm.score(model, docs[:10], 39).sum()
    opt = lm.Adam(model.weights, 0.02)
    for e in range(8):
        lm.train(model, docs[10:], 39, opt, batch=16, seed=e)
    assert lm.score(model, docs[:10], 39).sum() > before + 50


def test_ids_are_those_of_the_words():
    from tideway.llm.lm_scoring import lower_words, subword_ids
    from tideway.llm.tokens import default_vocabulary, fast_encoder

    vocabulary = default_vocabulary()
    for text in ("The cat, the CAT's hat!", None, "", "É\u3000x\x85 y\x1c <|endoftext|> 12345 a\nb", "word " * 50):
        joined = b"".join(b" " + w for w in lower_words(text)).decode()
        assert subword_ids(text, vocabulary, 7).tolist() == [*fast_encoder(vocabulary).encode_ordinary(joined), 7]


def test_only_scored_positions_go_to_the_classes(monkeypatch):
    model, docs = small_model()
    inp, out, scored, _ = lm.windows(docs, 39, SMALL)
    met, classes = [], lm.classes
    monkeypatch.setattr(lm, "classes", lambda w, h: met.append(h.size // h.shape[-1]) or classes(w, h))
    lm.gradients(model.weights, model.symbol[inp], model.cls[out], scored)
    assert sum(met) == scored.sum() < scored.size


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def slow_base(rows):
    counts = Counter(w for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    return n, {
        (i, t): (zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)),
                 sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words_of(t)))
        for i, t in rows
    }


def test_score_cases(spark, monkeypatch):
    from tideway.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "HEAD", 3)  # so that most words take the way round the joined table
    rows = [(i, f"The cat {i} sat on THE mat") for i in range(30)] + [(30, None), (31, ""), (None, "null id"), (32, "only here É"), (33, "word " * 20_000), (1, "The cat 1 sat on THE mat")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, _lm_x string")
    out = score_texts(df, rounds=1, share=4)
    assert out.columns == ["doc_id", "text", "_lm_x", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    n, want = slow_base(rows)
    assert len(got) == len(rows)
    for r in got:
        held, tokens, known, base = want[r.doc_id, r.text]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score)
    assert score_texts(df.filter("false"), rounds=1).count() == 0


def test_score_query(spark, sf):
    from tideway.llm.queries import QUERIES

    got = QUERIES["op2_lm_scores"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n, want = slow_base([tuple(r) for r in docs])
    texts = {r.doc_id: r.text for r in docs}
    for r in got.itertuples():
        assert (r.held_out, r.n_tokens, r.n_known) == want[r.doc_id, texts[r.doc_id]][:3] and r.train_tokens == n
        assert r.base_score == pytest.approx(want[r.doc_id, texts[r.doc_id]][3])
    held = got[got.held_out]
    assert held.score.sum() > 1.6 * held.base_score.sum()  # negative numbers: not far below the word counts even when learned from little


def test_rounds_take_every_training_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tideway.llm import lm_scoring

    met = []
    monkeypatch.setattr(lm_scoring, "train_round", lambda model, texts, *rest: met.extend(bytes(r[0]) for r in texts.collect()))
    ids = {i: np.array([i, 39], "<u4").tobytes() for i in range(39)}
    df = spark.createDataFrame(list(ids.items()), "_lm_key int, _lm_ids binary")
    lm_scoring.fit(df, F.col("_lm_key"), np.ones((40, 4), np.float32), 39, SMALL)
    assert sorted(met) == sorted(ids.values())


def test_least_context_of_the_production_model():
    shape = lm.Shape()
    inp, out, scored, _ = lm.windows([np.arange(500)], 50256, shape)
    col = np.nonzero(scored[1:])[1]
    assert inp.shape[1] >= 32 and col.min() >= 8 and shape.classes >= 64
