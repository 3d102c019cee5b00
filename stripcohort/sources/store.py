"""A store of feature tables: what was computed for one content and one set of parameters is read, not computed again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripcohort.sources import shared


def content_digest(rows: DataFrame) -> str:
    """A name of the rows, whatever their order and partitions: columns with their types, sums of two 64-bit hashes of every row, and how many there are.

    A hash of a row skips its nulls, so which of its columns are null goes into it too. Values are hashed by their own
    type, and so is what stands in arrays and structs, as JSON with its nulls.
    """
    kinds = sorted((f.name, f.dataType.json()) for f in rows.schema.fields)
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "struct", "map", "variant")}
    values = [F.to_json(F.struct(n), {"ignoreNullFields": "false"}) if n in nested else F.col(f"`{n}`") for n, _ in kinds]
    nulls = F.concat_ws("", F.lit("n"), *[F.col(f"`{n}`").isNull().cast("int").cast("string") for n, _ in kinds])
    named = {"a": F.xxhash64(nulls, *values), "b": F.xxhash64(F.lit("b"), nulls, *values)}
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("decimal(38,0)")).alias(k) for k, c in named.items()]).first()
    return hashlib.sha256(f"{kinds}|{sums['n']}|{sums['a']}|{sums['b']}".encode()).hexdigest()


def reused(root: str, rows: DataFrame, parameters: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table that compute makes of rows under these parameters; written below root the first time, read from there later.

    A table that was only written in part has no mark of success and is made again.
    """
    spark = rows.sparkSession
    digest = hashlib.sha256((content_digest(rows) + json.dumps(parameters, sort_keys=True)).encode()).hexdigest()
    path = f"{root.rstrip('/')}/features-{digest[:32]}"
    at, system = shared.hadoop_path(spark, f"{path}/_SUCCESS")
    if not system.exists(at):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
