"""Similar strips: pairs whose correlation reaches a threshold, and the groups that they make."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.sources.shared import durable, forget

#: A pair at the threshold is missed with no more than this chance.
MISSED = 1e-8
#: Words of 64 signs by which candidates are compared before their vectors are.
WORDS = 4


def _total(c: object) -> object:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def most_apart(chance: float, bits: int, missed: float) -> int:
    """The least number of bits that more than which differ with no more than the chance `missed`, where each differs with `chance`."""
    left = 1.0
    for n in range(bits):
        left -= math.comb(bits, n) * chance**n * (1 - chance) ** (bits - n)
        if left <= missed:
            return n
    return bits


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, id, v: vectors of one or more components with mean 0 and length 1; none that are constant or hold a null.

    As an expression, a mean inside a lambda is taken anew for each component, and all of it for each row on both sides of a shuffle.
    """
    for batch in batches:
        if not len(batch):
            continue
        v = batch.column("v")
        flat, sizes = v.flatten(), v.value_lengths().to_numpy()
        x, starts = flat.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        with np.errstate(invalid="ignore", over="ignore"):
            x = x - np.repeat(np.add.reduceat(x, starts) / sizes, sizes)
            n = np.sqrt(np.add.reduceat(x * x, starts))
        lacks = np.logical_or.reduceat(flat.is_null().to_numpy(zero_copy_only=False), starts)
        keep = ~lacks & ~(n <= 0) & (np.maximum.reduceat(x, starts) != np.minimum.reduceat(x, starts))
        values = (x / np.repeat(np.where(n <= 0, 1.0, n), sizes))[np.repeat(keep, sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
        kept = [batch.column(c).filter(pa.array(keep)) for c in ("w", "id")]
        yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["w", "id", "v"])


def near_pairs(vectors: DataFrame, least: float = 0.97, seed: int = 7, within: str | None = None) -> DataFrame:
    """a, b, r: pairs a < b of vectors (id, v) whose Pearson correlation is least or more; with a column within, only pairs that agree in it.

    Candidates are confirmed on the vectors; a pair at the threshold isn't among them with a chance of 1 in 100 million. Equal vectors
    (that agree in within) are one: their least id stands for them. Vectors that are null or constant take no part.
    """
    vectors = vectors.withColumn("_w", F.col(within) if within else F.lit(0))
    lone = vectors.filter("v is not null and size(v) > 0").groupBy("_w", "v").agg(F.min("id").alias("id"))
    unit = lone.select(F.xxhash64("_w").alias("w"), "id", F.col("v").cast("array<double>").alias("v")).mapInArrow(_unit, "w long, id long, v array<double>")
    unit = durable(unit)
    of = lambda n, v: unit.select(F.col("id").alias(n), F.col("w").alias(f"_w{n}"), F.col("v").alias(v))
    both = candidates(unit, least, seed).join(of("a", "_x"), "a").join(of("b", "_y"), "b").filter("_wa = _wb")
    return both.select("a", "b", _total(F.zip_with("_x", "_y", lambda x, y: x * y)).alias("r")).filter(F.col("r") >= least)


def candidates(unit: DataFrame, least: float, seed: int = 7) -> DataFrame:
    """a, b: pairs a < b of unit vectors (id, w, v), of one w but for equal hashes, among which are those whose product is least or more.

    A pair shares the signs of random planes in one of several tables. The signs per table grow with the logarithm of the rows, so
    buckets of unlike vectors stay small, and the tables with them. Rows of a bucket carry 256 more signs: a pair that differs in more
    of them than one at the threshold does ends where it meets, so what is shuffled after that grows with the near pairs alone.
    """
    bits = max(14, math.ceil(math.log2(max(unit.count(), 2))))
    apart = math.acos(min(least, 1 - 1e-9)) / math.pi
    tables = max(1, math.ceil(math.log(MISSED / 2) / math.log1p(-((1 - apart) ** bits))))
    most = most_apart(apart, 64 * WORDS, MISSED / 2)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits)
        for batch in batches:
            if len(batch):
                m = np.stack(batch["v"].to_numpy())
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], tables * bits + 64 * WORDS))
                signs = m @ planes > 0
                keys = (signs[:, : tables * bits].reshape(len(m), tables, bits) * weights).sum(axis=2)
                more = np.packbits(signs[:, tables * bits :], axis=1).view(np.int64)
                yield pd.DataFrame({"id": batch["id"], "w": batch["w"], "keys": list(keys)} | {f"s{n}": more[:, n] for n in range(WORDS)})

    words = [f"s{n}" for n in range(WORDS)]
    signed = unit.select("id", "w", "v").mapInPandas(sign, "id long, w long, keys array<long>, " + ", ".join(f"{s} long" for s in words))
    keyed = durable(signed.select("id", *words, F.posexplode("keys").alias("t", "k"), "w").select("id", F.xxhash64("w", "t", "k").alias("k"), *words))
    # placed by bucket once, for both sides
    one, other = (keyed.repartition("k").select(F.col("id").alias(n), F.col("k").alias(f"_k{n}"), *[F.col(s).alias(f"_{s}{n}") for s in words]) for n in ("a", "b"))
    differ = sum((F.bit_count(F.col(f"_{s}a").bitwiseXOR(F.col(f"_{s}b"))) for s in words), F.lit(0))
    return one.join(other, (F.col("_ka") == F.col("_kb")) & (F.col("a") < F.col("b")) & (differ <= most)).select("a", "b").distinct()


def groups(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """id, group_id, size: connected components of pairs (a, b), named by their smallest member.

    Every round takes the least label around and jumps to that label's own, so chains halve; lineage is cut by a table in the shared folder.
    """
    # both directions of a pair out of one row, so the pairs are computed once
    edges = durable(pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    label = durable(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("g")).select("id", F.least("id", "g").alias("g")))
    for _ in range(rounds):
        near = edges.join(label.select(F.col("id").alias("b"), "g"), "b").groupBy(F.col("a").alias("id")).agg(F.min("g").alias("_g"))
        step = label.join(near, "id").select("id", F.col("g").alias("_old"), F.least("g", "_g").alias("g"))
        jump = label.select(F.col("id").alias("g"), F.col("g").alias("_far"))
        new = durable(step.join(jump, "g").select("id", "_old", F.least("g", "_far").alias("g")))
        forget(label)
        label = new
        if label.filter("_old <> g").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    size = label.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    return label.join(size, "g").select("id", F.col("g").alias("group_id"), "size")
