"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.sources.shared import durable, forget, fresh, hadoop_path, scratch, shared_dir

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "crc_of", "durable", "few", "forget", "free_names", "fresh", "lower_ascii", "scratch", "shared_dir", "sized", "table"]

#: A side is broadcast only after it has been shown to have no more rows, and no more bytes on disk, than these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialises a side of a join; marks it for broadcast only if its rows and bytes as written are few, else a shuffle join stays."""
    kept = durable(df)
    side = F.broadcast(kept) if few(kept, max_rows, max_bytes) else kept
    side.durable_path = kept.durable_path
    return side


def few(kept: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether what durable() wrote has no more rows and bytes than may be broadcast."""
    at, system = hadoop_path(kept.sparkSession, kept.durable_path)
    return system.getContentSummary(at).getLength() <= max_bytes and kept.count() <= max_rows


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Each wanted name, or the first of name1, name2, ... that no column has (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        free = next(n for n in [name, *[f"{name}{i}" for i in range(1, len(taken) + 2)]] if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def crc_of(doc_id: Column | str) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
