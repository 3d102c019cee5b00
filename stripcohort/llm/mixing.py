"""Mixing sources to target weights by blocks of words.

Every source's texts are one stream of words, cut into blocks of a fixed length. Output shards
draw their source counts from a multinomial; a source's slots are numbered through the shards
and mapped to its blocks by a pseudorandom permutation, one per pass over the source; blocks
are joined by their number. All of it is hashes of numbers, so a rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.llm.common import durable, free_names, sized

WORD = r"[^\x20\x09-\x0D]+"
#: Equal cells of [0, 1) by which a draw finds its source in an equi-join.
CELLS = 4096


def _uniform(*of: Column) -> Column:
    """Pseudorandom in [0, 1), to 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> also target: weights repeat over the sources in order of code points, null last.

    share of all words is dealt by weight; a target stops at most times its source's size and the
    excess goes to the others by weight, until none is above: the level at which the water stands.
    One row per source goes in; the windows run over that small table alone.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    full = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rise = W.orderBy("ratio", F.col("source").asc_nulls_last())
    full = full.withColumn("at", F.row_number().over(rise))
    below, everything = rise.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    level = full.withColumn("level", left / heavy)
    # below the water, a source is full; the level is that at the first source that isn't
    water = level.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything)["level"])
    return water.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("water", F.lit(float("inf")))).alias("target"))


def _offsets(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, source, size -> also at, the words of the source before it. Two levels: within chunks, then over a source's chunks."""
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)).cast("int"))
    inner = W.partitionBy("source", "chunk").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    within = dealt.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = dealt.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    outer = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("start"))
    return within.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select("doc_id", "source", "size", (F.col("start") + F.col("inner")).alias("at"))


def permuted(rows: DataFrame, index: str, n: str, key: list[Column], name: str, rounds: int = 8, walks: int = 64) -> DataFrame:
    """Adds name: the column index (0..n-1) under a pseudorandom permutation of 0..n-1, one per key.

    A Feistel network on pairs (left, right) of a x b numbers, a the rounded-up root of n; at least n and fewer than
    n + a of them. What lands at n or above goes through again. The places above are fewer than a, and no walk
    meets one twice, so walks are enough for sure up to n = walks ** 2; beyond, a walk that is longer has a
    chance below n ** (-walks / 2). Each round is a projection, compiled with the rest of the stage.
    """
    a, b, left, right, x, r = free_names(rows.columns, "_a", "_b", "_l", "_r", "_x", "_k")
    out = rows.withColumn(a, F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long")).withColumn(b, F.expr(f"(`{n}` + `{a}` - 1) div `{a}`")).withColumn(x, F.col(index).cast("long"))

    def half(k: Column, own: Column, other: Column, size: Column) -> Column:
        return F.pmod(own + F.pmod(F.xxhash64(*key, k, other), size), size)

    out = out.withColumns({left: F.expr(f"`{x}` div `{b}`"), right: F.pmod(x, b)})
    for k in range(rounds):
        own, other, size = (left, right, a) if k % 2 == 0 else (right, left, b)
        out = out.withColumn(own, half(F.lit(k), F.col(own), F.col(other), F.col(size)))
    out = out.withColumn(x, F.col(left) * F.col(b) + F.col(right))

    def again(at: Column) -> Column:
        """One more pass, as one expression: few rows need it."""
        pair = F.struct(F.floor(at / F.col(b)).alias("l"), F.pmod(at, F.col(b)).alias("r"))

        def one(p: Column, k: Column) -> Column:
            even = F.struct(half(k, p["l"], p["r"], F.col(a)).alias("l"), p["r"].alias("r"))
            odd = F.struct(p["l"].alias("l"), half(k, p["r"], p["l"], F.col(b)).alias("r"))
            return F.when(k % 2 == 0, even).otherwise(odd)

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pair, one, lambda p: p["l"] * F.col(b) + p["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), F.col(x), lambda at, _: F.when(at < F.col(n), at).otherwise(again(at)))
    return out.withColumn(name, F.when(F.col(x) < F.col(n), F.col(x)).otherwise(walk)).drop(a, b, left, right, x, r)


def _running(drawn: DataFrame, run: int = 4096) -> DataFrame:
    """Adds from, the n of a source's shards before this one: within runs of shards, then over a source's runs, so no task holds all shards of a source."""
    dealt = durable(drawn.withColumn("run", F.floor(F.col("shard") / run)))
    before = (W.unboundedPreceding, -1)
    inner = F.sum("n").over(W.partitionBy("source", "run").orderBy("shard").rowsBetween(*before))
    sums = dealt.groupBy("source", "run").agg(F.sum("n").alias("n"))
    start = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("run").rowsBetween(*before)), F.lit(0))
    starts = sums.select(F.col("source").alias("s"), F.col("run").alias("r"), start.alias("start"))
    both = dealt.withColumn("inner", F.coalesce(inner, F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    return both.withColumn("from", F.col("start") + F.col("inner")).drop("s", "r", "run", "start", "inner")


def draw_slots(by_source: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """source, source_size, target -> one row per slot of the mix: source, block, shard, pass.

    Each shard of shard_blocks slots draws its source counts at the targets' shares. A source's draws
    beyond its target fall away, and those it lacks after the last shard are drawn in make-up
    shards, so that totals are those of the targets to within a block.
    """
    spark = by_source.sparkSession
    # the last block of a source is short, so a slot is worth source_size / blocks words
    plan = by_source.filter("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("quota", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    rise = W.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(rise.rowsBetween(W.unboundedPreceding, 0)) / F.sum("target").over(W.partitionBy())
    plan = durable(plan.withColumn("hi", upto).withColumn("lo", F.coalesce(F.lag("hi").over(rise), F.lit(0.0))).withColumn("hi", F.when(F.lead("hi").over(rise).isNull(), 1.0).otherwise(F.col("hi"))))
    total = plan.agg(F.sum("quota")).first()[0] or 0
    cells = plan.select("source", "blocks", "quota", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    # the multinomial: every slot of a shard draws a source
    draws = spark.range(total).select(F.floor(F.col("id") / shard_blocks).alias("shard"), _uniform(F.lit(seed), F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = draws.join(sized(cells), "cell").filter("u >= lo and u < hi").groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n"), F.first("blocks").alias("blocks"), F.first("quota").alias("quota"))
    # numbers a source's slots through the shards; the make-up shard is the last
    last = (total // shard_blocks) + 1
    more = plan.select(F.lit(last).cast("long").alias("shard"), "source", F.col("quota").alias("n"), "blocks", "quota")
    runs = _running(drawn.union(more)).withColumn("to", F.least(F.col("from") + F.col("n"), F.col("quota"))).filter(F.col("from") < F.col("to"))
    # long runs are cut before they are numbered one by one
    cut = runs.withColumn("from", F.explode(F.expr(f"sequence(from, to - 1, {shard_blocks}L)"))).withColumn("to", F.least(F.col("to"), F.col("from") + shard_blocks))
    # so many tasks however few bytes the runs are
    tasks = max(1, min(total // 100_000 + 1, 20_000))
    slots = cut.repartition(tasks, "source", "from").select("source", "shard", "blocks", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("i"))
    turn = F.floor(F.col("i") / F.col("blocks"))
    slots = slots.withColumn("pass", turn).withColumn("at", F.col("i") % F.col("blocks"))
    return permuted(slots, "at", "blocks", [F.lit(seed), F.coalesce("source", F.lit("\x00")), F.col("pass")], "block").select("source", "block", "shard", "pass")


def mix(docs: DataFrame, block_words: int = 64, shard_blocks: int = 4096, seed: int = 7, chunks: int = 4096, **weights: object) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, source, text): the documents with source_size, target and place, and the slots of the mix.

    First frame: doc_id, source, size, at (place in the source's stream), source_size, target. Second: source, block,
    shard, pass; block b holds the words b * block_words and on of its source's stream.
    """
    counted = durable(docs.select("doc_id", "source", sizes(docs).alias("size")))
    base = durable(_offsets(counted, chunks))
    by_source = durable(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), **weights))
    side = sized(by_source.withColumnRenamed("source", "s"))
    return base.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s"), draw_slots(by_source, block_words, shard_blocks, seed)


def pieces(placed: DataFrame, block_words: int = 64) -> DataFrame:
    """The parts of documents that blocks hold: doc_id, source, size, at, block, first (word of the document), n."""
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    first = F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0))
    return cut.withColumn("first", first).withColumn("n", F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size")) - F.col("first"))


def mixed_pieces(docs: DataFrame, block_words: int = 64, **options: object) -> DataFrame:
    """The mix itself: shard, source, block, pass, doc_id, first, n: which words of which document each block of each shard holds."""
    placed, slots = mix(docs, block_words, **options)
    held = pieces(placed, block_words)
    # shuffled by hint: Spark judges exploded rows by the few bytes that they came from, and would broadcast all slots
    joined = held.withColumnRenamed("source", "s").join(slots.hint("merge"), F.col("s").eqNullSafe(F.col("source")) & (held["block"] == slots["block"]))
    return joined.select("shard", "source", slots["block"].alias("block"), "pass", "doc_id", "first", "n")


def taken(docs: DataFrame, block_words: int = 64, **options: object) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Null and blank texts have size 0 and nothing taken; a null source is a source of its own, last;
    repeated rows each have their own place. An empty table gives no rows.
    """
    placed, slots = mix(docs, block_words, **options)
    placed = durable(placed)
    times = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    held = pieces(placed, block_words)
    # shuffled by hint, as in mixed_pieces()
    got = held.join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    per = got.groupBy("doc_id", "source", "size", "at", "source_size", "target").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return per.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken")
