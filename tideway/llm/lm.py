"""A causal self-attention language model in numpy on subword ids.

The chance of the next id is the chance of its class, given by one attention layer over the ids before it, times the
chance of the id inside its class, given by counts over all training texts of what follows a coarse code of the id before.
Classes are clusters of ids that follow similar ids. Texts are scored in overlapping windows: every id is scored once, with the earlier part of its window as
context, many windows to a batch under one causal mask.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: subword ids, input symbols, classes, width, window and how far windows move."""

    ids: int = 50257
    symbols: int = 4096
    classes: int = 64
    width: int = 16
    window: int = 32
    stride: int = 24
    buckets: int = 256


@dataclass
class Model:
    """What is learned. Counts travel as the cells that were seen; the table made of them is built where it is used."""

    shape: Shape
    symbol: np.ndarray  # of each id
    cls: np.ndarray  # of each id
    seen: tuple[np.ndarray, np.ndarray] | None  # flat cells (id, bucket of the id before) and their counts
    weights: dict[str, np.ndarray]
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}

    def without_counts(self) -> "Model":
        """All that training needs."""
        return Model(self.shape, self.symbol, self.cls, None, self.weights)

    @property
    def inside(self) -> np.ndarray:
        """Log chance of each id inside its class, by bucket of the id before; few sightings lean on the plain chance."""
        if self.table is None:
            shape, (cell, n) = self.shape, self.seen
            follow = np.zeros(shape.ids * shape.buckets, np.float32)
            follow[cell] = n
            follow = follow.reshape(shape.ids, shape.buckets)
            prior = follow.sum(axis=1, dtype=np.float64) + 0.1
            prior = (prior / np.bincount(self.cls, prior, shape.classes)[self.cls]).astype(np.float32)
            given = np.zeros((shape.classes, shape.buckets), np.float32)
            np.add.at(given, (self.cls[cell // shape.buckets], cell % shape.buckets), n)
            follow += 5 * prior[:, None]
            follow /= given[self.cls] + 5
            self.table = np.log(follow, out=follow)
        return self.table


def bucket_of(ids: np.ndarray, shape: Shape) -> np.ndarray:
    """Coarse code of the id before."""
    return ids % shape.buckets


def clusters(follow: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Class of each row of counts (id, bucket of the id before): k-means on square roots of shares, weighted by counts.

    Rows never seen share the last class with whatever else lands there.
    """
    n = follow.sum(axis=1)
    seen = np.flatnonzero(n)
    out = np.full(len(follow), k - 1, np.int64)
    if not len(seen):
        return out
    x = np.sqrt(follow[seen] / n[seen, None]).astype(np.float32)
    weight = n[seen].astype(np.float64)
    # The most frequent ids are classes to start from; ids alike in what they follow gather around them.
    order = np.argsort(-weight, kind="stable")
    centre = x[order[np.arange(k) % len(order)]].copy()
    centre += np.random.default_rng(seed).normal(0, 1e-3, centre.shape).astype(np.float32)
    near = np.zeros(len(seen), np.int64)
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre, dtype=np.float64)
        np.add.at(total, near, x * weight[:, None])
        size = np.linalg.norm(total, axis=1)
        live = size > 0
        centre[live] = (total[live] / size[live, None]).astype(np.float32)
    out[seen] = near
    return out


def start_model(follow: np.ndarray, shape: Shape, seed: int = 5) -> Model:
    """Classes and counts from ``follow`` (id, bucket of the id before), attention weights as drawn."""
    counts = follow.sum(axis=1).astype(np.float64)
    cls = clusters(follow, shape.classes)
    per_class = np.bincount(cls, counts + 0.1, shape.classes)
    rank = np.empty(shape.ids, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(shape.ids)
    half = shape.symbols // 2
    symbol = np.where(rank < half, rank, half + np.arange(shape.ids) % half)
    rng = np.random.default_rng(seed)
    d = shape.width

    def draw(*size: int, scale: float = 1.0) -> np.ndarray:
        return rng.normal(0, scale, size).astype(np.float32)

    weights = {
        "emb": draw(shape.symbols, d, scale=0.5), "pos": draw(shape.window, d, scale=0.1),
        "q": draw(d, d, scale=d**-0.5), "k": draw(d, d, scale=d**-0.5), "v": draw(d, d, scale=d**-0.5), "o": draw(d, d, scale=0.1),
        "out": draw(d, shape.classes, scale=0.05),
        "bias": np.log(per_class / per_class.sum()).astype(np.float32),
    }
    cell = np.flatnonzero(follow)
    seen = cell.astype(np.int32), follow.ravel()[cell].astype(np.float32)
    return Model(shape, symbol.astype(np.int32), cls.astype(np.int32), seen, weights)


def _sums(y: np.ndarray) -> np.ndarray:
    """Sums over the last axis."""
    return y @ np.ones(y.shape[-1], y.dtype)


def attend(w: dict[str, np.ndarray], symbols: np.ndarray):
    """State after each symbol (window, position, width), and what the gradient needs."""
    b, t = symbols.shape
    x = w["emb"][symbols]
    x += w["pos"][:t]
    d = x.shape[2]
    flat = x.reshape(b * t, d)
    # One product for all three; the parts are views.
    qkv = flat @ np.concatenate((w["q"] * x.dtype.type(d**-0.5), w["k"], w["v"]), axis=1)
    q, k, v = (qkv[:, i * d : i * d + d].reshape(b, t, d) for i in range(3))
    a = q @ k.transpose(0, 2, 1)
    np.exp(np.minimum(a, 30.0, out=a), out=a)  # bounded, so no maximum has to be taken out
    a *= np.tri(t, dtype=a.dtype)
    total = _sums(a)[..., None]
    z = a @ v
    z /= total
    h = z.reshape(b * t, d) @ w["o"]
    h += flat
    return h.reshape(b, t, d), (x, q, k, v, a, total, z)


def classes(w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Logits of the class of the next id, bounded above."""
    logits = h @ w["out"]
    logits += w["bias"]
    return np.minimum(logits, 60, out=logits)


def forward(w: dict[str, np.ndarray], symbols: np.ndarray):
    """Logits over classes (window, position, class) of what follows each symbol, and what the gradient needs."""
    h, (x, q, k, v, a, total, z) = attend(w, symbols)
    return classes(w, h), (x, q, k, v, a / total, z, h)


def log_classes(logits: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over classes; ``classes`` bounds logits, so no maximum has to be taken out."""
    return np.log(_sums(np.exp(logits)) + 1e-30)


def gradients(w: dict[str, np.ndarray], symbols: np.ndarray, target: np.ndarray, scored: np.ndarray):
    """(mean loss, gradients) of class chances over the scored positions; only these go on to the classes."""
    h, (x, q, k, v, a, total, z) = attend(w, symbols)
    b, t, d = x.shape
    flat = lambda y: y.reshape(b * t, d)
    at = np.flatnonzero(scored)
    h, chosen = flat(h)[at], (np.arange(len(at)), target.ravel()[at])
    p = classes(w, h)
    np.exp(p, out=p)
    p /= (_sums(p) + 1e-30)[:, None]
    n = max(1, len(at))
    loss = -np.log(np.maximum(p[chosen], 1e-30)).sum() / n
    p[chosen] -= 1
    p *= p.dtype.type(1 / n)
    g = {"out": h.T @ p, "bias": np.ones(len(p), p.dtype) @ p}
    dh = np.zeros((b * t, d), p.dtype)
    dh[at] = p @ w["out"].T
    g["o"] = flat(z).T @ dh
    dz = (dh @ w["o"].T).reshape(b, t, d)
    a /= total
    dqkv = np.empty((b * t, 3 * d), p.dtype)
    dq, dk, dv = (dqkv[:, i * d : i * d + d].reshape(b, t, d) for i in range(3))
    dv[...] = a.transpose(0, 2, 1) @ dz
    ds = dz @ v.transpose(0, 2, 1)
    ds -= _sums(dz * z)[..., None]  # the mean of ds under a, as z is that of v
    ds *= a
    np.multiply(ds @ k, p.dtype.type(d**-0.5), out=dq)
    dk[...] = ds.transpose(0, 2, 1) @ q  # q holds the scale already
    g["q"], g["k"], g["v"] = np.split(flat(x).T @ dqkv, 3, axis=1)
    dx = dqkv @ np.concatenate((w["q"], w["k"], w["v"]), axis=1).T
    dx += dh
    g["pos"] = np.zeros_like(w["pos"])
    g["pos"][:t] = dx.reshape(b, t * d).sum(axis=0).reshape(t, d)
    cell = symbols.reshape(-1, 1).astype(np.int64) * d + np.arange(d)
    g["emb"] = np.bincount(cell.ravel(), dx.ravel(), w["emb"].size).astype(p.dtype).reshape(w["emb"].shape)
    return loss, g


class Adam:
    """Plain Adam over named arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.w, self.rate, self.step = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def take(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            some = x - m
            some *= np.float32(0.1)
            m += some
            np.multiply(x, x, out=some)
            some -= v
            some *= np.float32(0.001)
            v += some
            np.sqrt(v, out=some)
            some += np.float32(1e-8)
            np.divide(m * np.float32(scale), some, out=some)
            self.w[k] -= some


def windows(docs: list[np.ndarray], start_id: int, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, scored, document) of the overlapping windows of all documents; every id is scored once.

    A document's first window scores all its ids, each later one the last ``stride``; inputs are the ids before the
    targets, ``start_id`` at the start. Positions past the end repeat the start id and are not scored.
    """
    t, s = shape.window, shape.stride
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([np.concatenate(([start_id], d)) for d in docs] + [np.full(t + 1, start_id)]).astype(np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    n = np.where(sizes > t, 1 + -(-(sizes - t) // s), np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(docs)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = nth[:, None] * s + np.arange(t)
    valid = at < sizes[doc][:, None]
    pos = base[doc][:, None] + np.where(valid, at, 0)
    scored = valid & ((nth == 0)[:, None] | (np.arange(t) >= t - s))
    return flat[pos], flat[pos + 1], scored, doc


def train(model: Model, docs: list[np.ndarray], start_id: int, opt: Adam, batch: int = 96, seed: int = 1) -> float:
    """One pass over the windows of ``docs``, updating the weights of ``opt``; mean loss."""
    inp, out, scored, _ = windows(docs, start_id, model.shape)
    order = np.random.default_rng(seed).permutation(len(inp))
    total, steps = 0.0, 0
    for at in range(0, len(order), batch):
        pick = order[at : at + batch]
        loss, g = gradients(opt.w, model.symbol[inp[pick]], model.cls[out[pick]], scored[pick])
        opt.take(g)
        total, steps = total + loss, steps + 1
    return total / max(1, steps)


def score(model: Model, docs: list[np.ndarray], start_id: int, batch: int = 256) -> np.ndarray:
    """log10 probability of each document."""
    inp, out, scored, doc = windows(docs, start_id, model.shape)
    total = np.zeros(len(docs))
    for at in range(0, len(inp), batch):
        cut = slice(at, at + batch)
        h, _ = attend(model.weights, model.symbol[inp[cut]])
        # Only the positions that are scored here go on to the classes.
        row, col = np.nonzero(scored[cut])
        before, now = inp[cut][row, col], out[cut][row, col]
        logits = classes(model.weights, h[row, col])
        logp = logits[np.arange(len(row)), model.cls[now]] - log_classes(logits)
        logp = logp + model.inside[now, bucket_of(before, model.shape)]
        total += np.bincount(doc[cut][row], logp, len(docs))
    return total / np.log(10)
