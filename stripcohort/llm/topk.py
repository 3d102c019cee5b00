"""Exact top-k by inner product with M-trees and best-first search.

Vectors are lifted to one more component, so that a larger inner product is a smaller Euclidean distance, in
which the triangle inequality holds. The upper two levels are routers that the driver knows: a bounded number of
pivots, and within each of them cells around routers of its own. A cell's vectors are one tree, or several of a
bounded size: nodes split around routers that are far from each other, down to pages, each with its router, its
covering radius and its distance to the parent's router. A query searches its own cell first; its k-th score then
rules out pivots, cells, nodes and entries, by stored distances where they are enough.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.llm.common import durable

PAGE, FAN = 128, 8
SLACK = 1e-9


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """row, id, v: components as floor(scale * x), and a number that tells rows apart. Vectors that are null, or hold null or a component that isn't finite, take no part.

    The caller writes the rows before it uses their numbers.
    """
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    finite = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    base = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x"))
    base = base.filter(F.col("x").isNotNull() & F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    # in range first: components beyond it are found by their norm, not cut to the largest long
    v = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-4e18), F.least(F.lit(4e18), c * scale))).cast("long"))
    return base.select(F.monotonically_increasing_id().alias("row"), "id", v.alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows as integers; a shorter vector counts as having zeros behind."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


class Space:
    """Distances of the lifted space, from exact integer products."""

    def __init__(self, most: int, width: int) -> None:
        self.most, self.width = most, width
        # sums of products up to 2**53 are exact as doubles, whose products are faster
        self.exact = np.float64 if most < 1 << 52 else np.int64

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of lifted vectors (data) with each other."""
        na, nb = (a * a).sum(1), (b * b).sum(1)
        lift = np.sqrt(np.maximum(self.most - na, 0).astype(float))[:, None] - np.sqrt(np.maximum(self.most - nb, 0).astype(float))[None, :]
        return np.sqrt(np.maximum(na[:, None].astype(float) + nb[None, :].astype(float) - 2 * (a @ b.T).astype(float), 0) + lift**2)

    def from_query(self, norm: float, products: np.ndarray) -> np.ndarray:
        """Of a query, whose lifted component is 0, from data with these products."""
        return np.sqrt(np.maximum(float(norm) + float(self.most) - 2 * products.astype(float), 0))

    def limit(self, norm: float, score: float) -> float:
        """The distance beyond which a score is below this one."""
        return np.inf if score == -np.inf else float(np.sqrt(max(float(norm) + float(self.most) - 2 * float(score), 0)) * (1 + SLACK) + SLACK)


def build(rows: np.ndarray, ids: np.ndarray, v: np.ndarray, space: Space) -> dict:
    """A tree's arrays. Entries page by page: rows, ids, v, own (distance to the page's router).

    Nodes, root first: router, radius, parent (distance to the parent's router), first and last (their children, or their entries
    if leaf). A node of more than PAGE entries is split around up to FAN members that are far from each other.
    """
    order = np.lexsort((rows, ids))
    numbers, ids, v = rows[order], ids[order], v[order]
    nodes: list[list] = []
    entries: list[np.ndarray] = []
    own: list[np.ndarray] = []
    done = 0
    queue: list[tuple[np.ndarray, int, np.ndarray]] = [(np.arange(len(ids)), 0, np.zeros(0))]
    nodes.append([0, 0.0, 0.0, 0, 0, False])
    far = space.between(v, v[:1])[:, 0]
    queue[0] = (np.arange(len(ids)), 0, far)
    nodes[0][1] = float(far.max())
    while queue:
        rows, at, far = queue.pop()
        if len(rows) <= PAGE:
            nodes[at][3:] = [done, done + len(rows), True]
            entries.append(rows)
            own.append(far)
            done += len(rows)
            continue
        routers = _spread(v[rows], far, FAN, space)
        to = space.between(v[rows], v[rows[routers]])
        child = to.argmin(1)
        if (np.bincount(child, minlength=len(routers)) > 0).sum() < 2:
            # vectors that no router parts: pages of what is there
            parts = [rows[i : i + PAGE] for i in range(0, len(rows), PAGE)]
            made = [(p, nodes[at][0], far[i * PAGE : i * PAGE + len(p)]) for i, p in enumerate(parts)]
        else:
            made = [(rows[child == c], int(rows[routers[c]]), to[child == c, c]) for c in range(len(routers)) if (child == c).any()]
        nodes[at][3:] = [len(nodes), len(nodes) + len(made), False]
        above = v[nodes[at][0]][None]
        for part, router, near in made:
            nodes.append([router, float(near.max()), float(space.between(v[router][None], above)[0, 0]), 0, 0, False])
            queue.append((part, len(nodes) - 1, near))
    place = np.concatenate(entries)
    columns = list(zip(*nodes, strict=True))
    return {
        "rows": numbers[place],
        "ids": ids[place],
        "v": v[place],
        "own": np.concatenate(own),
        "router": v[np.array(columns[0])],
        "radius": np.array(columns[1], float),
        "parent": np.array(columns[2], float),
        "first": np.array(columns[3], np.int64),
        "last": np.array(columns[4], np.int64),
        "leaf": np.array(columns[5], bool),
    }


def _spread(v: np.ndarray, far: np.ndarray, n: int, space: Space) -> list[int]:
    """Up to n of these vectors, the first the farthest by far, each other one the farthest from those before."""
    picked = [int(far.argmax())]
    least = space.between(v, v[picked])[:, 0]
    while len(picked) < min(n, len(v)) and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, space.between(v, v[picked[-1:]])[:, 0])
    return picked


def search(tree: dict, query: int, q: np.ndarray, k: int, floor: float, space: Space, tally: list[int] | None = None) -> list[tuple[int, int]]:
    """(score, id) of up to k best entries of a tree, none that is worse than floor, nor the query's own row. tally adds up distances computed, and entries."""
    norm = float(q @ q)
    best: list[tuple[int, int]] = []  # a heap, the worst first: (score, -id)
    computed = 1

    def limit() -> float:
        return space.limit(norm, max(best[0][0], floor) if len(best) == k else floor)

    at = float(space.from_query(norm, tree["router"][:1] @ q)[0])
    queue = [(max(at - tree["radius"][0], 0.0), 0, at)]
    while queue:
        least, node, at = heapq.heappop(queue)
        if least > limit():
            break
        a, b = tree["first"][node], tree["last"][node]
        if not tree["leaf"][node]:
            # children that the stored distance to this router rules out cost no product
            open_ = np.flatnonzero(np.abs(at - tree["parent"][a:b]) - tree["radius"][a:b] <= limit()) + a
            far = space.from_query(norm, tree["router"][open_] @ q)
            computed += len(open_)
            for c, d, r in zip(open_, far, tree["radius"][open_], strict=True):
                if d - r <= limit():
                    heapq.heappush(queue, (max(float(d - r), 0.0), int(c), float(d)))
            continue
        some = np.flatnonzero(np.abs(at - tree["own"][a:b]) <= limit()) + a
        computed += len(some)
        score = tree["v"][some] @ q
        fit = (score >= (max(best[0][0], floor) if len(best) == k else floor)) & (tree["rows"][some] != query)
        some, score = tree["ids"][some][fit], score[fit]
        # no more than k of a page can be among the k best
        for i in np.lexsort((some, -score))[:k]:
            entry = (int(score[i]), -int(some[i]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    if tally is not None:
        tally[0] += computed
        tally[1] += len(tree["ids"])
    return [(s, -i) for s, i in best]


TREE = "pivot int, cell int, part int, rows array<long>, ids array<long>, v array<long>, own array<double>, router array<long>, radius array<double>, parent array<double>, first array<long>, last array<long>, leaf array<boolean>"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 64, cells: int = 64, tree_rows: int = 4096, block: int = 512, **columns: str) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors by integer inner product, ties to the smaller vec_id.

    is_query is a condition on id. Every row is a query or candidate of its own, also where rows repeat a vec_id: only
    the query's own row never answers it, and queries that share an id have k answers each. Fewer than k other vectors give fewer rows; an empty table gives none. Other columns are left
    out. Routers come from samples of 16 * pivots vectors, and 16 * cells of a pivot that has more than tree_rows; every
    vector is indexed. Scores are longs: a vector whose quantised squares sum up to 2**62 or more is refused by its id.
    """
    spark = vectors.sparkSession
    base = durable(quantised(vectors, **columns))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total = base.agg(F.max(F.struct(norm.alias("n"), "id")).alias("top"), F.max(F.size("v")).alias("width")).first()
    kind = "query_id long, rank int, vec_id long, score long"
    if total["top"] is None:
        return spark.createDataFrame([], kind)
    if total["top"]["n"] >= 2.0**62 * (1 - 1e-9):
        raise ValueError(f"the vector of id {total['top']['id']} is too long for inner products that are longs")
    most = base.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0]
    space = Space(int(most), max(int(total["width"]), 1))
    sample = base.orderBy(F.xxhash64("row"), "row").limit(16 * pivots).collect()
    tops = _far_apart(_matrix(pd.Series([r["v"] for r in sample]), space.width), pivots, space)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = space.between(_matrix(b["v"], space.width), tops)
                yield b.assign(pivot=far.argmin(1), far=far.min(1))

    placed = durable(base.mapInPandas(assign, "row long, id long, v array<long>, pivot int, far double"))
    sizes = {r["pivot"]: (r["n"], r["far"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    # large pivots have routers of their own
    large = [p for p, (n, _) in sizes.items() if n > tree_rows]
    at = F.row_number().over(W.partitionBy("pivot").orderBy(F.xxhash64("row"), "row"))
    some = placed.filter(F.col("pivot").isin(large)).withColumn("at", at).filter(F.col("at") <= 16 * cells).select("pivot", "v").collect() if large else []
    inner = {p: np.array(tops[p][None]) for p in sizes}
    for p in large:
        inner[p] = _far_apart(_matrix(pd.Series([r["v"] for r in some if r["pivot"] == p]), space.width), cells, space)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v, pivot = _matrix(b["v"], space.width), b["pivot"].to_numpy()
            cell, near = np.zeros(len(b), int), np.zeros(len(b))
            for p in np.unique(pivot):
                own = np.flatnonzero(pivot == p)
                far = space.between(v[own], inner[p])
                cell[own], near[own] = far.argmin(1), far.min(1)
            if len(b):
                yield b.assign(cell=cell, near=near)[["row", "id", "v", "pivot", "cell", "near"]]

    celled = durable(placed.mapInPandas(deal, "row long, id long, v array<long>, pivot int, cell int, near double"))
    stats = {(r["pivot"], r["cell"]): (r["n"], r["near"]) for r in celled.groupBy("pivot", "cell").agg(F.count("*").alias("n"), F.max("near").alias("near")).collect()}
    # what one cell holds beyond a tree is dealt by hash: at this depth its vectors are near each other or equal.
    # this side has a row per cell, pivots * cells at most
    parts = F.broadcast(spark.createDataFrame([(int(p), int(c), -(-n // tree_rows)) for (p, c), (n, _) in stats.items()], "pivot int, cell int, n_parts int"))

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        t = build(group["row"].to_numpy(), group["id"].to_numpy(), _matrix(group["v"], space.width), space)
        return pd.DataFrame([{c: group[c].iloc[0] for c in ("pivot", "cell", "part")} | {c: a.ravel() for c, a in t.items()}])

    dealt = celled.join(parts, ["pivot", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), "n_parts").cast("int"))
    trees = durable(dealt.groupBy("pivot", "cell", "part").applyInPandas(plant, TREE))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, row in b.iterrows():
                tree = {c: np.asarray(row[c]) for c in ("rows", "ids", "own", "radius", "parent", "first", "last", "leaf")}
                tree |= {c: np.asarray(row[c]).reshape(-1, space.width).astype(space.exact) for c in ("v", "router")}
                for x in row["queries"]:
                    q = np.zeros(space.width, space.exact)
                    q[: len(x["qv"])] = x["qv"]
                    floor = -np.inf if x["floor"] is None or x["floor"] != x["floor"] else x["floor"]
                    out += [(x["qrow"], x["qid"], i, s) for s, i in search(tree, x["qrow"], q, k, floor, space)]
            yield pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

    place = ["pivot", "cell", "part"]

    def answers(asked: DataFrame) -> DataFrame:
        """Of asked (row, id, v, floor, pivot, cell, part): the answers of those trees. Queries go in blocks, so a tree that all ask is many small tasks."""
        one = F.struct(F.col("row").alias("qrow"), F.col("id").alias("qid"), F.col("v").alias("qv"), "floor")
        blocks = asked.groupBy(*place, "at").agg(F.collect_list(one).alias("queries"))
        return blocks.join(trees, place).select("queries", *trees.columns).mapInPandas(visit, "row long, query_id long, vec_id long, score long")

    asks = celled.filter(is_query)
    n_blocks = max(1, -(-asks.count() // block))
    asks = asks.withColumn("at", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(n_blocks)))
    asks = asks.join(parts, ["pivot", "cell"]).withColumn("part", F.pmod(F.xxhash64("row", F.lit("home")), "n_parts").cast("int")).drop("n_parts")
    asks = durable(asks)
    first = durable(answers(asks.withColumn("floor", F.lit(None).cast("double"))))
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("row", F.col("score").cast("double").alias("floor"))

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.array(sorted(sizes))
        reach = np.array([sizes[p][1] for p in upper])
        below = {p: np.array(sorted(c for q, c in stats if q == p)) for p in upper}
        radius = {p: np.array([stats[p, c][1] for c in below[p]]) for p in upper}
        parent = {p: space.between(inner[p], tops[p][None])[:, 0] for p in upper}
        for b in batches:
            out = []
            q = _matrix(b["v"], space.width)
            norms = (q.astype(float) ** 2).sum(1)
            for i, (home, cell, floor) in enumerate(zip(b["pivot"], b["cell"], b["floor"], strict=True)):
                limit = space.limit(norms[i], -np.inf if floor is None or floor != floor else floor)
                far = space.from_query(norms[i], tops[upper] @ q[i])
                there = []
                for p, d in zip(upper[far - reach <= limit], far[far - reach <= limit], strict=True):
                    c = below[p][np.abs(d - parent[p][below[p]]) - radius[p] <= limit]
                    near = space.from_query(norms[i], inner[p][c] @ q[i])
                    there += [(p, x) for x in c[near - radius[p][np.searchsorted(below[p], c)] <= limit]]
                there += [] if (home, cell) in there else [(home, cell)]
                out.append([{"pivot": int(p), "cell": int(c)} for p, c in there])
            yield b.drop(columns=["pivot", "cell"]).assign(there=out)[["row", "id", "v", "home", "home_cell", "home_part", "at", "floor", "there"]]

    kept = asks.join(kth, "row", "left").select("row", "id", "v", "pivot", "cell", F.col("pivot").alias("home"), F.col("cell").alias("home_cell"), F.col("part").alias("home_part"), "at", "floor")
    more = kept.mapInPandas(elsewhere, "row long, id long, v array<long>, home int, home_cell int, home_part int, at long, floor double, there array<struct<pivot:int,cell:int>>")
    spread = more.select("row", "id", "v", "floor", "at", "home", "home_cell", "home_part", F.inline("there"))
    spread = spread.join(parts, ["pivot", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    rest = answers(spread.filter("pivot <> home or cell <> home_cell or part <> home_part").select("row", "id", "v", "floor", "at", *place))
    return first.union(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _far_apart(v: np.ndarray, n: int, space: Space) -> np.ndarray:
    """Up to n of these vectors, each the farthest from those before."""
    v = np.unique(v, axis=0)
    return v[_spread(v, space.between(v, v[:1])[:, 0], n, space)]
