"""MinHash near-duplicate groups with tensored banding.

A few small collections of minhashes are computed (``halves`` of ``half_rows`` each); every pair
of collections is one hash table, so ``halves * half_rows`` minhashes give
``halves * (halves - 1) / 2`` tables: about the square root of the usual cost. Candidates are
confirmed on full shingle sets. Equal sets are one node from the start, so groups of copies cost
nothing; in a bucket members are compared with a pivot first, and only what is still apart is
compared pair by pair, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripcohort.llm.common import durable, forget, sized
from stripcohort.llm.wordhash import U, mix, shingle_hashes, slices, stream, texts, word_hashes

SHINGLE = 5


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
    """Each row's sorted distinct shingles and a 128-bit name of that set."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    names = [np.array([mix(s).sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U).tobytes() for s in sets]
    return sets, names


def sketches(docs: DataFrame, halves: int, half_rows: int, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, sid (names the shingle set; null if empty), keys (one per collection)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, odds = stream(3, halves * half_rows), stream(4, halves * half_rows) | U(1)
        for batch in batches:
            data, bounds = texts(batch.column(1))
            for lo, hi in slices(bounds):
                hashes, at = shingle_hashes(*word_hashes(data, bounds[lo : hi + 1]), shingle)
                sets, names = _distinct(hashes, at)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((hi - lo, halves), U)
                for j in range(halves):
                    for k in range(j * half_rows, (j + 1) * half_rows):
                        if len(full):
                            least = np.minimum.reduceat((hashes ^ seeds[k]) * odds[k], at[full])
                            keys[full, j] = mix(keys[full, j] + least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n),
                        pa.array([name if k else None for name, k in zip(names, n, strict=True)], pa.binary()),
                        pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "sid", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sid binary, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """sid and its whole sorted set, once per row of docs that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column(0))
            for lo, hi in slices(bounds):
                sets, names = _distinct(*shingle_hashes(*word_hashes(data, bounds[lo : hi + 1]), shingle))
                got = [(n, s.view(np.int64)) for n, s in zip(names, sets, strict=True) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.binary()), pa.array([s for _, s in got], pa.list_(pa.int64()))], ["sid", "grams"])

    return docs.select("text").mapInArrow(run, "sid binary, grams array<long>")


def _tables(reps: DataFrame) -> DataFrame:
    """key, sid: the buckets with two nodes or more, out of all tables.

    Only nodes whose keys of some two collections are not unique can meet another, so the pairs
    of collections are formed for those alone.
    """
    halves = reps.select("sid", F.posexplode("keys").alias("j", "u"))
    shared = halves.groupBy("j", "u").count().filter("count > 1").select("j", "u")
    left = halves.join(shared, ["j", "u"], "left_semi").groupBy("sid").agg(F.collect_list(F.struct("j", "u")).alias("k")).filter(F.size("k") > 1)
    first = left.select("sid", "k", F.explode("k").alias("a"))
    both = first.select("sid", "a", F.explode(F.filter("k", lambda x: x["j"] > F.col("a.j"))).alias("b"))
    keyed = durable(both.select(F.xxhash64("a.j", "b.j", "a.u", "b.u").alias("key"), "sid"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(full, "key")


def _linked(pairs: DataFrame, sets: DataFrame, alike: Column) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike."""
    one = sets.select(F.col("sid").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("sid").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(two, "b").join(one, "a")
    # sizes first: the smaller set can't be shared beyond its own size
    return both.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("both"), (F.size("ga") + F.size("gb")).alias("sum")).filter(alike).select("a", "b")


def _rest_linked(live: DataFrame, sets: DataFrame, percent: int, block: int = 256, block_grams: int = 500_000) -> DataFrame:
    """Links (a, b) between nodes that share a bucket but no component yet.

    Buckets that overlap are one family. Each family is dealt into blocks of a bounded number of nodes
    and shingles, and each pair of blocks is one small task: every pair is compared, yet no rows of pairs are made.
    """
    centre = live.groupBy("key").agg(F.min("sid").alias("c"))
    # a node hangs on its least centre alone, and that centre on the node's others: few edges however many buckets are shared
    hung = live.join(centre, "key").groupBy("sid").agg(F.min("c").alias("a"), F.collect_set("c").alias("others"))
    hung = hung.select("a", F.explode(F.array_union(F.array("sid"), F.col("others"))).alias("b"))
    family = components(hung.filter("a <> b").distinct())
    nodes = live.select("sid", "root", "size").distinct().join(family.select(F.col("node").alias("sid"), F.col("root").alias("family")), "sid")
    parts = nodes.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / block_grams)).cast("int").alias("parts"))
    dealt = nodes.join(parts, "family").join(sets, "sid").withColumn("at", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = spread.select("family", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "at", "sid", "root", "grams")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sid", ignore_index=True)
        mine = np.flatnonzero(group["at"] == group["i"])
        other = np.flatnonzero(group["at"] == group["j"])
        size = np.array([len(g) for g in group["grams"]])
        _, ids, times = np.unique(np.concatenate(group["grams"].to_list()), return_inverse=True, return_counts=True)
        node = np.repeat(np.arange(len(group)), size)
        some = times[ids] > 1  # a shingle of one node alone is shared with none
        order = np.argsort(ids[some], kind="stable")
        ids, node = ids[some][order], node[some][order]
        shared = np.zeros((len(mine), len(other)), np.float32)
        step, lo = 4096, 0
        spot = np.cumsum(np.concatenate([[0], np.diff(ids) > 0])) if len(ids) else ids
        while lo < len(ids):
            hi = int(np.searchsorted(spot, spot[lo] + step))
            has = np.zeros((len(group), step), np.float32)
            has[node[lo:hi], spot[lo:hi] - spot[lo]] = 1
            shared += has[mine] @ has[other].T
            lo = hi
        shared = shared.astype(np.int64)
        alike = 100 * shared >= percent * (size[mine][:, None] + size[other][None, :] - shared)
        root = {}

        def find(x: object) -> object:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        roots, sid = group["root"].to_list(), group["sid"].to_list()
        for x, y in zip(*np.nonzero(alike), strict=True):
            p, q = find(roots[mine[x]]), find(roots[other[y]])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((sid[mine[x]], sid[other[y]]))
        return pd.DataFrame(out, columns=["a", "b"])

    return pairs.groupBy("family", "i", "j").applyInPandas(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root of the connected components of links (a, b); root is the least node. Min-label rounds with pointer jumping."""
    edges = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = durable(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = durable(step.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")))
        forget(label)
        label = new
        if not new.filter("old <> root").limit(1).count():
            forget(edges)
            return new


def near_duplicates(docs: DataFrame, percent: int = 85, halves: int = 10, half_rows: int = 2, pivot_rounds: int = 2, block: int = 256, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text).

    Documents are linked if 100 * |A & B| >= percent * |A | B| over their distinct word shingles; a
    component's id is its least doc_id, and that document is kept. A text of fewer words than a
    shingle is one shingle; null, empty and blank texts have none and stay alone. Rows with equal
    sets are linked; rows that repeat a doc_id each come back; a null doc_id is never kept, its
    component is that of its copies (null without any).
    A pair at the threshold is missed by all 45 tables with a chance below 1 in 10,000, one above
    it with less. Other columns of docs are left out; an empty table gives no rows.
    """
    alike = F.expr(f"100 * both >= {percent} * (sum - both)")
    base = durable(sketches(docs, halves, half_rows, shingle))
    named = base.filter("sid is not null")
    reps = durable(named.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")))
    tables = durable(_tables(reps))
    # the node that shares most buckets with others is the likeliest centre of a family of copies
    weight = tables.groupBy("sid").agg(F.sum("n").alias("w"))
    buckets = durable(tables.join(weight, "sid").join(reps.select("sid", "n").withColumnRenamed("n", "size"), "sid").select("key", "sid", "w", "size"))
    wanted = sized(buckets.select("sid").distinct().join(reps, "sid").select("rep").distinct().withColumnRenamed("rep", "doc_id"))
    texts_of = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    unnamed = docs.select("doc_id", "text").filter("doc_id is null")
    sets = durable(shingle_sets(texts_of.unionByName(unnamed), shingle).groupBy("sid").agg(F.first("grams").alias("grams")))

    def fits(a: str, b: str) -> Column:
        return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")

    found: list[DataFrame] = []
    scratch: list[DataFrame] = []
    tried: DataFrame | None = None
    live = buckets.withColumn("root", F.col("sid"))
    for _ in range(pivot_rounds):
        top = durable(live.groupBy("key").agg(F.max(F.struct("w", "sid", "size")).alias("top")))
        pairs = live.join(top, "key").filter(F.col("sid") != F.col("top.sid")).filter(fits("size", "top.size")).select(F.least("sid", "top.sid").alias("a"), F.greatest("sid", "top.sid").alias("b")).distinct()
        pairs = durable(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        scratch += [top, pairs]
        found.append(durable(_linked(pairs, sets, alike)))
        roots = components(reduce(DataFrame.union, found))
        rooted = live.drop("root").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        # a pivot that was tried comes last next time
        scratch.append(roots)
        live = durable(rooted.join(apart, "key").join(top.select("key", F.col("top.sid").alias("was")), "key").withColumn("w", F.when(F.col("sid") == F.col("was"), -1).otherwise(F.col("w"))).drop("was"))
        scratch.append(live)
    found.append(durable(_rest_linked(live, sets, percent, block)))
    roots = components(reduce(DataFrame.union, found))
    scratch += [roots, reps, tables, buckets, wanted, sets]

    member = reps.select("sid", "rep").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ids = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = durable(member.join(ids, "root").select("sid", "component_id"))
    forget(*scratch, *found)
    out = base.select("doc_id", "n_shingles", "sid").join(of, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
