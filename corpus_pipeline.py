"""Raw documents to a mixed training set: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.llm import decontamination, line_dedup, mixing, near_dedup, quality
from stripcohort.llm.common import durable, forget, free_names, fresh, scratch, sized, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, whole. Learns from the labelled rows among them.

    Null and empty texts score the labels' prior, so they stay where most labelled documents are good.
    """
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col(scored.columns[-1]) >= 0.3).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines; n_chars follows the text.

    A document that would be left empty keeps its text: what is nothing but lines of many others is a copy, and
    copies are the next stage's.
    """
    # the text as it came, under a name of its own, beside the one without lines
    (was,) = free_names(docs.columns, "_text")
    out = line_dedup.drop_boilerplate(docs.withColumn(was, F.col("text")))
    dropped, emptied = out.columns[-2:]
    cut = (F.col(dropped) > 0) & ~F.col(emptied)
    out = out.withColumn("text", F.when(F.col(emptied), F.col(was)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id (null last), of rows that share it any one.

    Rows are told apart by a number of their own, so a doc_id that stands on different texts, or on none, costs no text.
    Near are texts that share 80 % of their shingles of five words; op4's 85 % is its query's own. 13 collections
    of 2 miss a pair at 80 % with a chance of about 0.4 in 10,000 (10 would miss 7). Texts without words stay.
    """
    (row,) = free_names(docs.columns, "_row")
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent=80, halves=13)
    found = durable(found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group")))
    ids = rows.select(row, F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col(row).alias("row"))
    # the first of a group is found by partial minima, and joins are by row: a group of any size is no task's
    stays = found.join(ids, row).groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    gone = sized(found.select(row).join(stays, row, "left_anti"))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.taken(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier and the mix can't be said in SQL; tests/llm holds every stage against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and reread by the next, and removed after that."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh(spark)
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), path)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
