"""Quality classifier by compression: a zstandard dictionary of good texts against one of bad texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.llm.common import crc_of, free_names


@dataclass(frozen=True)
class Model:
    """Dictionaries by label and the weights of the calibration; without dictionaries the score is the prior."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    level: int
    window: int


def _pieces(text: bytes, window: int) -> list[bytes]:
    return [text[i : i + window] for i in range(0, len(text), window)]


def sizer(model: Model) -> object:
    """text -> compressed sizes under either dictionary, window by window over the whole text, and its own size."""

    def with_dictionary(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=model.level)
        return zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    good, bad = with_dictionary(model.good), with_dictionary(model.bad)

    def run(text: bytes) -> tuple[int, int, int]:
        parts = _pieces(text, model.window)
        return sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts), len(text)

    return run


def features(sizes: np.ndarray) -> np.ndarray:
    """A constant, and the difference of the compressed sizes by the text's own size, damped for short texts. 0 says nothing of a text."""
    good, bad, n = sizes.astype(float).T
    return np.column_stack([np.ones(len(n)), (bad - good) / (n + 16)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Newton's method for a weighted logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, sample_bytes: int = 16_000_000, dictionary: int = 1 << 16, level: int = 3, window: int = 500) -> Model:
    """Fits on a bounded sample of labelled rows whose crc32(doc_id) mod 5 isn't 0.

    The sample is the per_class rows of either label with the least hashes of their ids, and of those as many
    texts as sample_bytes hold: the first half makes the dictionaries, the second calibrates, weighted to the
    labels' shares among all training rows. A text of more than an eighth of sample_bytes is in the sample with evenly
    spaced windows of it, no more than those bytes; every text is scored whole.
    """
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of("doc_id") % 5 != 0)).select("doc_id", "quality")
    share = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = rows.filter("quality = 1").orderBy(*order).limit(per_class).union(rows.filter("quality = 0").orderBy(*order).limit(per_class))
    # per_class bounds this side
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "text", *[o.alias(f"o{i}") for i, o in enumerate(order)])
    by: dict[int, list[bytes]] = {0: [], 1: []}
    have = {0: 0, 1: 0}
    # a character has up to 4 bytes
    parts = max(1, sample_bytes // 8 // (4 * window))
    spread = F.expr(f"array_join(transform(sequence(0, {parts - 1}), i -> substring(text, cast(i * (length(text) div {parts}) + 1 as int), {window})), '')")
    some = F.when(F.octet_length("text") > sample_bytes // 8, spread).otherwise(F.col("text"))
    bounded = sample.withColumn("text", some).withColumn("bytes", F.octet_length("text")).filter("bytes > 0")
    for r in bounded.orderBy("o0", "o1", "text").limit(2 * per_class).toLocalIterator():
        q = r["quality"]
        if have[q] + r["bytes"] <= sample_bytes // 2:
            by[q].append(r["text"].encode())
            have[q] += r["bytes"]
    n = sum(share.values())
    prior = share.get(1, 0) / n if n else 0.5
    half = {q: x[: (len(x) + 1) // 2] for q, x in by.items()}
    pieces = {q: [p for t in x for p in _pieces(t, window)] for q, x in half.items()}
    if not all(pieces.values()):
        return Model(b"", b"", (), prior, level, window)
    made = {q: _dictionary(p, dictionary) for q, p in pieces.items()}
    model = Model(made[1], made[0], (), prior, level, window)
    size = sizer(model)
    rest = {q: x[len(half[q]) :] or x for q, x in by.items()}
    x = features(np.array([size(t) for q in (0, 1) for t in rest[q]]))
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.where(y == 1, prior / len(rest[1]), (1 - prior) / len(rest[0])) * len(y)
    told = x[:, 1] != 0
    if len(set(y[told])) < 2:
        return Model(b"", b"", (), prior, level, window)
    return Model(made[1], made[0], tuple(logistic(x[told], y[told], weight[told])), prior, level, window)


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary; the texts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and, last, score (0 to 1, higher: good likelier; score1 or so if docs has a score).

    Null and empty texts, texts of which both dictionaries make the same size (of a few bytes, mostly), and all texts without a
    model, score the labels' prior. Repeated rows score alike.
    """
    (name,) = free_names(docs.columns, "score")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = sizer(model) if model.weights else None
        for batch in batches:
            out = np.full(len(batch), model.prior)
            full = np.flatnonzero([bool(t) for t in batch])
            if size and len(full):
                values = batch.to_numpy()
                x = features(np.array([size(values[i].encode("utf-8", "replace")) for i in full]))
                known = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
                out[full] = np.where(x[:, 1] != 0, known, model.prior)
            yield pd.Series(out)

    return docs.withColumn(name, F.pandas_udf(run, "double")("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options: object) -> DataFrame:
    """One row for each row of docs: doc_id, held_out (crc32(doc_id) mod 5 is 0), score, predicted (1 if score >= threshold)."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **options))
    held = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
