"""Boilerplate lines by their frequency within a site.

A line's ratio is the number of the host's pages that contain it over the host's pages. Only
hashes of lines are shuffled; the lines above the ratio are few per host (at most the mean
number of lines of a page divided by the ratio), so they go back to the texts as one short
array per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripcohort.llm.common import free_names, sized


def _line_key(line: Column) -> Column:
    """A 128-bit name of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """One row per host that has any: host and the keys of its boilerplate lines. A null host is a host of its own."""
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), _line_key))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    # the null key stands for the page itself: its count is the host's total
    page = F.array(F.lit(None).cast("struct<a:bigint,b:bigint>"))
    seen = pages.select(F.col(host).alias("host"), F.explode(F.concat(F.coalesce(keys, none), page)).alias("key"))
    counts = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("key").isNull() | (F.col("n") >= min_pages))
    totals = counts.filter("key is null").select(F.col("host").alias("of"), F.col("n").alias("total"))
    often = counts.filter("key is not null").join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > max_ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("key").alias("boilerplate"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """All columns of pages, the text without its host's boilerplate lines, and behind them n_lines (lines that aren't empty), n_dropped and emptied.

    A line is dropped everywhere on a host if more than max_ratio of its pages contain it; lines are
    compared whole. min_pages only stops a line from being a majority by itself: on a host of fewer than
    min_pages / max_ratio pages that many pages must have the line. A page that has nothing else loses all
    of its lines and is marked emptied, so that a caller can drop it or keep what it was. Empty lines never
    count and stay; a null text stays null with 0 lines; repeated rows count as pages each. Columns of pages
    keep their names and values: where one is called n_lines, n_dropped or emptied, the new one is the first
    free of n_lines1, n_lines2 and so on.
    """
    n_lines, n_dropped, emptied, of, found, kept = free_names(pages.columns, "n_lines", "n_dropped", "emptied", "_host", "_boilerplate", "_kept")
    side = sized(boilerplate(pages, host, text, max_ratio, min_pages)).select(F.col("host").alias(of), F.col("boilerplate").alias(found))
    lines = F.split(F.col(text), "\n")

    def solid(c: Column) -> Column:
        return F.size(F.filter(c, lambda x: x != "")).cast("long")

    rest = F.filter(lines, lambda x: (x == "") | ~F.array_contains(F.col(found), _line_key(x)))
    joined = pages.join(side, F.col(host).eqNullSafe(F.col(of)), "left")
    out = joined.withColumn(n_lines, F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(solid(lines)))
    out = out.withColumn(kept, F.when(F.col(found).isNotNull() & F.col(text).isNotNull(), rest))
    out = out.withColumn(n_dropped, F.when(F.col(kept).isNotNull(), F.col(n_lines) - solid(F.col(kept))).otherwise(F.lit(0).cast("long")))
    # texts without any of the lines keep their bytes as they are
    out = out.withColumn(text, F.when(F.col(n_dropped) > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))
    return out.select(*pages.columns, n_lines, n_dropped, ((F.col(n_dropped) > 0) & (F.col(n_dropped) == F.col(n_lines))).alias(emptied))
