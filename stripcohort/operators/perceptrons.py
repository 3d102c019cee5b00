"""Perceptrons of all folds fitted at once: an evaluation of every fold's loss and gradient is one job.

Rows lie in blocks of one fold each, packed once. A task gives a block to the models of the other folds, as matrix products,
and adds their gradients up; a grouped sum adds up the tasks'. L-BFGS of each fold runs on these sums: the driver holds
coefficients, never rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.sources.shared import durable, forget

#: Rows of a block.
BLOCK = 1024


def _blocks(rows: DataFrame, fold: str) -> DataFrame:
    """fold, x, y: rows (fold, x, y) of a fold as bytes, up to BLOCK of them, in no more partitions than their number asks for."""
    few = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // BLOCK + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}

        def out(f: int) -> pa.RecordBatch:
            x, y = (np.concatenate(a) for a in zip(*kept.pop(f), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["f", "x", "y"])

        for batch in batches:
            if not len(batch):
                continue
            f, x, y = batch.column("f").to_numpy(), batch.column("x"), batch.column("y").to_numpy()
            sizes = x.value_lengths().to_numpy()
            if (sizes != sizes[0]).any():
                raise ValueError("rows have other numbers of features")
            values = x.flatten().to_numpy().reshape(len(y), -1)
            for own in np.unique(f):
                at = np.flatnonzero(f == own)
                for part in np.split(at, range(BLOCK, len(at), BLOCK)):
                    held = kept.setdefault(int(own), [])
                    if held and sum(len(b) for _, b in held) + len(part) > BLOCK:
                        yield out(int(own))
                        held = kept.setdefault(int(own), [])
                    held.append((values[part], y[part].astype(np.float64)))
        for own in list(kept):
            yield out(own)

    clean = rows.filter(F.col("y").isNotNull() & F.col(fold).isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    named = clean.select(F.col(fold).cast("int").alias("f"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"))
    return durable(named.repartition(few).mapInArrow(run, "f int, x binary, y binary"))


def _sums(blocks: DataFrame, models: list[int], part: Callable, top: bool = False) -> dict[int, np.ndarray]:
    """model -> the sum (or, with top, the largest) of part(model, x, y) over the blocks of all other folds."""
    both = np.maximum if top else np.add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, xs, ys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(ys)
                x = np.frombuffer(xs).reshape(len(y), -1)
                for m in models:
                    if m != f:
                        got = part(m, x, y)
                        found[m] = both(found[m], got) if m in found else got
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["m", "s"])

    def add(table: pa.Table) -> pa.Table:
        whole = both.reduce([np.frombuffer(s) for s in table.column("s").to_pylist()])
        return pa.table({"m": table.column("m").slice(0, 1), "s": pa.array([whole.tobytes()], pa.binary())})

    each = blocks.select("f", "x", "y").mapInArrow(run, "m int, s binary")
    return {r["m"]: np.frombuffer(bytes(r["s"])) for r in each.groupBy("m").applyInArrow(add, "m int, s binary").collect()}


def descent(w: np.ndarray, steps: int, tolerance: float = 1e-6, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS: yields points, is sent each one's loss and gradient, and returns the last point. Steps meet Wolfe's conditions, by bisection.

    It ends where ten steps in a row gain less than the tolerance of the first loss; a single short one may cross a flat region.
    """
    loss, g = yield w
    past: deque = deque(maxlen=memory)
    least, seen = tolerance * abs(loss), deque([loss], maxlen=10)
    for _ in range(steps):
        q, weights = g.copy(), []
        for s, t, r in reversed(past):
            weights.append(r * (s @ q))
            q -= weights[-1] * t
        if past:
            q /= past[-1][2] * (past[-1][1] @ past[-1][1])
        for s, t, r in past:
            q += (weights.pop() - r * (t @ q)) * s
        slope = g @ q
        if not slope > 0:
            return w
        low, high, size = 0.0, np.inf, 1.0 if past else min(1.0, 1 / np.sqrt(g @ g))
        for _ in range(30):
            at = w - size * q
            new, turned = yield at
            if not new <= loss - 1e-4 * size * slope:
                high = size
            elif turned @ q > 0.9 * slope:
                low = size
            else:
                break
            size = (low + high) / 2 if high < np.inf else 2 * low
        if not new <= loss:
            return w
        s, t = at - w, turned - g
        if s @ t > 0:
            past.append((s, t, 1 / (s @ t)))
        w, loss, g = at, new, turned
        if len(seen) == seen.maxlen and seen[0] - loss <= least:
            return w
        seen.append(loss)
    return w


def _layers(w: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every layer's matrix and offsets, out of one array."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(w: np.ndarray, sizes: list[int], z: np.ndarray) -> list[np.ndarray]:
    """What every layer gives: sigmoids, at last the classes' probabilities."""
    outs, layers = [z], _layers(w, sizes)
    for n, (m, b) in enumerate(layers):
        t = outs[-1] @ m + b
        if n < len(layers) - 1:
            outs.append(1 / (1 + np.exp(-np.clip(t, -700, 700))))
        else:
            t = np.exp(t - t.max(axis=1, keepdims=True))
            outs.append(t / t.sum(axis=1, keepdims=True))
    return outs


def loss_and_gradient(w: np.ndarray, sizes: list[int], z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed cross entropy of rows z of classes y (0, 1), then its gradient."""
    outs, layers, rows = _forward(w, sizes, z), _layers(w, sizes), np.arange(len(y))
    own = y.astype(int)
    loss = -np.log(np.maximum(outs[-1][rows, own], 1e-300)).sum()
    d, parts = outs[-1].copy(), []
    d[rows, own] -= 1
    for (m, _), low in zip(reversed(layers), reversed(outs[:-1]), strict=True):
        parts += [d.sum(axis=0), (low.T @ d).ravel()]
        d = (d @ m.T) * low * (1 - low)
    return np.concatenate([[loss], *reversed(parts)])


def cross_validated(rows: DataFrame, fold: str = "fold", k: int = 5, hidden: tuple[int, ...] = (100, 50), steps: int = 100, seed: int = 42) -> DataFrame:
    """fold, id, y, score (probability of class 1), pred of rows (id, y, x, fold): each fold scored by a perceptron of all other folds.

    Layers of sigmoids and two classes at the end, on features standardised by the training part (population deviation, a
    constant one becomes 0), fitted by L-BFGS from uniform weights as Spark's own classifier does. Rows with nulls in y or
    x train nothing; a fold whose training part lacks a class has no predictions.
    """
    rows = durable(rows.select("id", "y", F.col("x").cast("array<double>").alias("x"), fold))
    blocks = _blocks(rows, fold)
    first = _sums(blocks, list(range(k)), lambda m, x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    many = {m: s[0] for m, s in first.items() if 0 < s[1] < s[0]}
    models = sorted(many)
    mean = {m: first[m][2:] / many[m] for m in models}
    ends = _sums(blocks, models, lambda m, x, y: np.concatenate([x.max(axis=0), -x.min(axis=0)]), top=True)
    squares = _sums(blocks, models, lambda m, x, y: ((x - mean[m]) ** 2).sum(axis=0))
    d = {m: len(mean[m]) for m in models}
    inverse = {m: np.where((ends[m][: d[m]] == -ends[m][d[m] :]) | (squares[m] == 0), 0.0, 1 / np.sqrt(np.where(squares[m] == 0, 1, squares[m]) / many[m])) for m in models}
    sizes = {m: [d[m], *hidden, 2] for m in models}

    def begin(m: int) -> np.ndarray:
        random = np.random.default_rng(seed)
        return np.concatenate([random.uniform(-2.4, 2.4, a * b + b) / a for a, b in zip(sizes[m], sizes[m][1:], strict=False)])

    # every fold's next point, evaluated together
    fits, w = {m: descent(begin(m), steps) for m in models}, {}
    asked = {m: next(fit) for m, fit in fits.items()}
    while asked:
        now = dict(asked)
        sums = _sums(blocks, list(now), lambda m, x, y: loss_and_gradient(now[m], sizes[m], (x - mean[m]) * inverse[m], y))  # noqa: B023
        for m, s in sums.items():
            try:
                asked[m] = fits[m].send((s[0] / many[m], s[1:] / many[m]))
            except StopIteration as end:
                w[m] = end.value
                del asked[m]
    forget(blocks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, x, p = batch.column("_f").to_numpy(), batch.column("x"), np.zeros(len(batch))
            starts = np.cumsum(x.value_lengths().to_numpy()) - x.value_lengths().to_numpy()
            values = x.flatten().to_numpy()
            for m in np.unique(f):
                at = np.flatnonzero(f == m)
                p[at] = _forward(w[m], sizes[m], (values[starts[at][:, None] + np.arange(d[m])] - mean[m]) * inverse[m])[-1][:, 1]
            kept = [batch.column(n) for n in (fold, "id", "y")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array(p > 0.5)], names=[fold, "id", "y", "score", "pred"])

    whole = rows.filter(F.col(fold).isin(models) & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    made = rows.select(fold, "id", "y", F.lit(0.0).alias("score"), F.lit(True).alias("pred")).schema
    return whole.select(fold, "id", "y", "x", F.col(fold).cast("int").alias("_f")).mapInArrow(score, made)
