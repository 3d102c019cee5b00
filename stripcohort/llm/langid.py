"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, each rotated by its place; a text's vector bundles (adds) its trigrams'. A language's
prototype bundles its training texts; a text gets the language of the nearest prototype by cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.llm.common import crc_of
from stripcohort.llm.wordhash import U, mix

#: Characters and texts that are profiled at a time (a longer text is a slice of its own), and trigrams that are bound at a time.
SLICE, SLICE_TEXTS, BLOCK = 1 << 18, 256, 1 << 13


class Profiler:
    """Trigrams of letters, lower-cased, with one mark for whatever stands between words."""

    def __init__(self, dims: int) -> None:
        self.dims = dims
        self.letter = np.full(0x110000, -1, np.int32)  # code point -> its number below; 0 for what is no letter
        self.chars, self.number = [" "], {" ": 0}
        self.vectors = self._vector(" ")[None]

    def _vector(self, char: str) -> np.ndarray:
        bits = mix(np.arange(self.dims // 64, dtype=U) + U((ord(char) + 1) * 0x9E3779B97F4A7C15 % 2**64))
        return (np.unpackbits(bits.view(np.uint8)).astype(np.float32) * 2 - 1).astype(np.float32)

    def _learn(self, points: np.ndarray) -> None:
        for point in points:
            char = chr(point)
            low = char.lower()[:1] if char.isalpha() else " "
            at = self.number.setdefault(low, len(self.chars))
            if at == len(self.chars):
                self.chars.append(low)
                if at == len(self.vectors):  # room doubles, so letters cost no copy each
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[at] = self._vector(low)
            self.letter[point] = at

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, trigram (its three letters' numbers packed) and how often."""
        points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        new = np.unique(points[self.letter[points] < 0])
        self._learn(new)
        ids = self.letter[points].astype(np.int64)
        bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
        row = np.searchsorted(bounds, np.arange(len(ids)), "right") - 1
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)  # one mark for a run of other characters
        ids, row = ids[keep], np.clip(row[keep], 0, max(len(texts) - 1, 0))
        if len(ids) < 3:
            return (np.zeros(0, np.int64),) * 3
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        n = len(self.chars)
        whole = (b != 0) | ((a != 0) & (c != 0) & (row[:-2] == row[2:]))
        code = ((row[1:-1] * n + a) * n + b) * n + c
        found, times = np.unique(code[whole], return_counts=True)
        tri = found % n**3
        return found // n**3, (tri // n**2 << 42) | (tri // n % n << 21) | tri % n, times

    def bind(self, packed: np.ndarray) -> np.ndarray:
        """The vectors of these trigrams."""
        out = np.roll(self.vectors[packed >> 42], 2, axis=1)
        out *= np.roll(self.vectors[(packed >> 21) & 0x1FFFFF], 1, axis=1)
        out *= self.vectors[packed & 0x1FFFFF]
        return out

    def bundles(self, texts: list[str], groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The bundled vectors of groups of texts (each text has a group's number), and whether a group has any trigram.

        Trigrams are bound a block at a time, so a text of many kinds of them takes no more memory.
        """
        row, packed, times = self.counts(texts)
        known, spot = np.unique(packed, return_inverse=True)
        order = np.argsort(spot, kind="stable")
        group, spot, times = groups[row[order]], spot[order], times[order]
        out = np.zeros((n_groups, self.dims))
        for lo in range(0, len(known), BLOCK):
            a, b = np.searchsorted(spot, [lo, lo + BLOCK])
            part = known[lo : lo + BLOCK]
            table = np.zeros((n_groups, len(part)), np.float32)
            np.add.at(table, (group[a:b], spot[a:b] - lo), times[a:b])
            out += table @ self.bind(part)
        return out, np.bincount(group, minlength=n_groups) > 0


def _slices(texts: list[str], most: int = SLICE, most_texts: int = SLICE_TEXTS) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (size + len(t) > most or i - lo >= most_texts):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def prototypes(docs: DataFrame, dims: int) -> dict[str, list[float]]:
    """Language -> bundled vector, of the rows of docs (text, lang). What reaches the driver is one vector per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dims), {}
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                names = sorted(set(langs[lo:hi]))
                number = {name: i for i, name in enumerate(names)}
                vectors, _ = profiler.bundles(texts[lo:hi], np.array([number[x] for x in langs[lo:hi]]), len(names))
                for name, vector in zip(names, vectors, strict=True):
                    sums[name] = sums.get(name, 0) + vector
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    parts = docs.select("text", "lang").mapInArrow(run, "lang string, vector array<double>")
    total = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v")).collect()
    return {r["lang"]: r["v"] for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, learned: dict[str, list[float]], dims: int) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text); score is (1 + cosine) / 2 of the nearest prototype, the first by name of equals."""
    names = list(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dims)
        proto = np.array([learned[n] for n in names], np.float64).reshape(len(names), dims)
        proto = (proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)).T
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for lo, hi in _slices(texts) if names else ():
                vectors, some = profiler.bundles(texts[lo:hi], np.arange(hi - lo), hi - lo)
                cosine = (vectors @ proto) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                full = np.flatnonzero(some)
                best[lo + full] = cosine[full].argmax(axis=1)
                score[lo + full] = np.clip((1 + cosine[full].max(axis=1)) / 2, 0, 1)
            # ids stay in Arrow: as pandas numbers, those beside a null would lose their low digits
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[b] if b >= 0 else "und" for b in best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, dims: int = 512) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows with a lang whose crc32(doc_id) mod 4 isn't 2 (held_out rows are the others). A text that is null or
    has no letter, or any text where nothing was learned, is ``und`` with score 0. Letters are those of Unicode,
    lower-cased; a trigram has a letter in its middle or on both sides. A null id is never held out.
    """
    assert dims % 64 == 0 and math.log2(dims) >= 6
    held = F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False))
    learned = prototypes(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held), dims)
    return predict(docs, learned, dims).select("doc_id", held.alias("held_out"), "lang_pred", "score")
