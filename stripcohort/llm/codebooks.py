"""Vectors as short codes: each part of a vector is replaced by the number of the nearest entry of its codebook.

All arithmetic is on whole numbers, so results don't depend on how rows are dealt. A k-d tree per codebook goes to all
tasks in each round; tasks send back sums per entry, never vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.llm import tokens
from stripcohort.llm.common import durable, free_names, sized

#: Quantised components up to this are squared and summed in 64 bits; others as Python's whole numbers.
SAFE = 1 << 25
LIMB = 31


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), exactly: 64-bit numbers if all are small, else Python's."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < SAFE / scale:
        return np.floor(values * scale).astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def tree_of(entries: list[list[int]]) -> tuple | list[int]:
    """k-d tree over a codebook's entries, as plain tuples for a broadcast: (axis, split, left, right), or the indexes of a leaf of one or two."""

    def node(at: list[int]) -> tuple | list[int]:
        if len(at) <= 2:
            return at
        axis = max(range(len(entries[0])), key=lambda c: max(entries[i][c] for i in at) - min(entries[i][c] for i in at))
        at = sorted(at, key=lambda i: (entries[i][axis], i))
        k = len(at) // 2
        return axis, entries[at[k]][axis], node(at[:k]), node(at[k:])

    return node(list(range(len(entries))))


class Search:
    """Nearest entries by a tree of tree_of(). Entries before a node's split have at most its value on the axis, the others at least."""

    def __init__(self, entries: list[list[int]], root: tuple | list[int]) -> None:
        self.small = all(abs(x) < 2 * SAFE for e in entries for x in e)
        self.entries, self.root = np.array(entries, np.int64 if self.small else object), root

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every point, of equals the lowest index.

        Nodes are visited for all points at once that still need them: first the side a point lies on, then the other
        one if the distance to the split doesn't exceed the best so far. Equal bounds are visited, since an entry with
        a lower index may lie there.
        """
        points = points if self.small and points.dtype == np.int64 else points.astype(object)
        entries = self.entries.astype(points.dtype)
        index = np.full(len(points), -1, np.int64)
        best = np.full(len(points), -1, points.dtype)  # none yet

        def visit(node: tuple | list[int], of: np.ndarray) -> None:
            if not len(of):
                return
            if isinstance(node, list):
                for i in node:
                    gap = points[of] - entries[i]
                    d = (gap * gap).sum(axis=1)
                    now, have = best[of], index[of]
                    nearer = np.array((have < 0) | (d < now) | ((d == now) & (i < have)), bool)
                    best[of[nearer]], index[of[nearer]] = d[nearer], i
                return
            axis, split, left, right = node
            low = np.array(points[of, axis] < split, bool)
            visit(left, of[low])
            visit(right, of[~low])
            gap = points[of, axis] - split
            near = np.array(gap * gap <= best[of], bool)
            visit(right, of[low & near])
            visit(left, of[~low & near])

        visit(self.root, np.arange(len(points)))
        return index, best


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows, codebooks): id, label, codes (entry of every part) and error (squared distances summed over parts) of every vector, and the entries by part.

    Vectors that are null or hold null or non-finite components take no part. Each component x counts as floor(scale * x).
    Codebooks begin with the parts of the vectors of the lowest ids (null ids last; of equal ids, the vectors in order);
    with fewer vectors than entries a codebook is shorter, with none there are no rows and no codebooks. Each round
    assigns every part and moves each entry to the floor of its parts' mean; entries without parts stay. The vectors are
    as long as the one of the lowest id, which must be a multiple of parts; longer or shorter ones raise an error that
    says so. An error too large for a long is null. Null ids and labels and repeated rows stay.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    fine = F.coalesce(F.size(x) > 0, F.lit(False)) & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    kept = vectors.filter(fine).select(F.col(id_col).alias("id"), label.alias("label"), x.cast("array<double>").alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    types = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id {types['id']}, label {types['label']}, codes array<int>, error long"
    if not first:
        return spark.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "label": label_col}), []
    width = len(first[0]["v"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    if other := kept.filter(F.size("v") != width).select("id", F.size("v").alias("n")).first():
        raise ValueError(f"the vector of id {other['id']} has {other['n']} components, not {width}")
    size = width // parts
    cut = lambda m, p: m[:, p * size : (p + 1) * size]
    start = quantised(np.array([r["v"] for r in first]), scale)
    books = [cut(start, p).tolist() for p in range(parts)]

    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([(b, tree_of(b)) for b in books])  # as large as the codebooks

        def sums(batches: Iterator[tuple], trees=trees) -> Iterator[pa.RecordBatch]:
            """part, entry, place, limb, sum: place -1 counts. Sums go in limbs of 31 bits, so that none overflows; all but huge numbers have one limb."""
            found: dict[tuple[int, int, int, int], int] = {}
            searches = [Search(*x) for x in trees.value]
            for (v,) in batches:
                q = quantised(_matrix(v, width), scale)
                for p, tree in enumerate(searches):
                    index, _ = tree.nearest(cut(q, p))
                    for i in np.unique(index).tolist():
                        mine = cut(q, p)[index == i]
                        found[p, i, -1, 0] = found.get((p, i, -1, 0), 0) + len(mine)
                        for c, s in enumerate(mine.sum(axis=0).tolist()):
                            found[p, i, c, 0] = found.get((p, i, c, 0), 0) + s
            rows = [(p, i, c, k, limb) for (p, i, c, _), s in found.items() for k, limb in enumerate(limbs(s))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()])], ["part", "entry", "place", "limb", "sum"])

        each = kept.select("v").mapInArrow(tokens.in_batches(sums, ["v"]), "part int, entry int, place int, limb int, sum long")
        whole: dict[tuple[int, int], dict[int, int]] = {}
        # a row for each number of a codebook, whatever the rows
        for r in each.groupBy("part", "entry", "place", "limb").agg(F.sum("sum").alias("sum")).collect():
            of = whole.setdefault((r["part"], r["entry"]), {})
            of[r["place"]] = of.get(r["place"], 0) + (r["sum"] << (LIMB * r["limb"]))
        for (p, i), of in whole.items():
            books[p][i] = [of[c] // of[-1] for c in range(size)]
        trees.destroy()

    final = spark.sparkContext.broadcast([(b, tree_of(b)) for b in books])

    def coded(batches: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        searches = [Search(*x) for x in final.value]
        for ids, labels, v in batches:
            q = quantised(_matrix(v, width), scale)
            found = [tree.nearest(cut(q, p)) for p, tree in enumerate(searches)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.int32)
            error = [e if e < 1 << 63 else None for e in sum(d.astype(object) for _, d in found).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(error, pa.int64())], ["id", "label", "codes", "error"])

    return kept.mapInArrow(tokens.in_batches(coded, ["id", "label", "v"]), schema).withColumnsRenamed({"id": id_col, "label": label_col}), books


def limbs(s: int) -> Iterator[int]:
    """A whole number as digits to base 2^31, the last one with the sign."""
    while not -(1 << LIMB) <= s < 1 << LIMB:
        yield s & ((1 << LIMB) - 1)
        s >>= LIMB
    yield s


def with_label_errors(coded: DataFrame, label_col: str = "label", error_col: str = "error") -> DataFrame:
    """Adds label_error: error summed over rows of equal labels, nulls together; null where a sum, or one of its errors, has no long.

    The rows are written once. Sums are made before anything moves, and a label's sum meets its rows by broadcast if
    labels are few, else by a shuffle that Spark may split.
    """
    rows = durable(coded)
    total, key = free_names(coded.columns, "label_error", "_label")
    exact = F.sum(F.col(error_col).cast("decimal(38,0)"))
    whole = F.when(F.count_if(F.col(error_col).isNull()) == 0, F.when(exact <= (1 << 63) - 1, exact)).cast("long")
    sums = sized(rows.groupBy(F.col(label_col).alias(key)).agg(whole.alias(total)))
    return rows.join(sums, rows[label_col].eqNullSafe(sums[key]), "left").drop(key)
