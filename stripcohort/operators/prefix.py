"""Running sums and extremes, ranks and exact quantiles over keys of any size.

A key's points are cut into pieces by approximate quantiles, so no task sorts or holds a whole key: a window runs
within each piece, and what the pieces before it come to (a few numbers per key) is joined to it. Points are distinct
values with their counts, so a value that many rows share is one point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.sources.shared import durable

PIECES = 64
#: Points of a key that a task may sort and sum by itself.
WHOLE = 100_000
_BY = {"sum": F.sum, "max": F.max, "min": F.min}


def _side(df: DataFrame, keys: list[str], mark: str) -> DataFrame:
    return df.withColumnsRenamed({k: mark + k for k in keys})


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal, with a's keys once."""
    mark = "_on_"
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(mark + k)) for k in keys]) if keys else F.lit(True)
    return a.join(_side(b, keys, mark), on, how).drop(*[mark + k for k in keys])


def running(points: DataFrame, keys: list[str], at: str, what: dict[str, tuple[str, str]], pieces: int = PIECES) -> DataFrame:
    """Adds, for every name in what, the running sum, max or min of a column over rising at, the point itself included.

    what is name -> (sum, max or min; column). at is a number, no two points of a key have the same.

    The points are written to the shared folder, so what they are made of is read once. Keys that turn out to have few
    points each (WHOLE at most) are one window; only longer ones are cut into pieces.
    """
    points = durable(points)
    if (points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= WHOLE:
        line = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
        return points.withColumns({n: _BY[f](c).over(line) for n, (f, c) in what.items()})
    bounds = points.groupBy(*keys).agg(F.percentile_approx(F.col(at).cast("double"), [i / pieces for i in range(1, pieces)], 1000).alias("_bounds"))
    cut = joined(points, bounds, keys).withColumn("_piece", F.size(F.filter("_bounds", lambda b: b < F.col(at)))).drop("_bounds")
    inner = W.partitionBy(*keys, "_piece").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    within = cut.withColumns({f"_in_{n}": _BY[f](c).over(inner) for n, (f, c) in what.items()})
    sums = cut.groupBy(*keys, "_piece").agg(*[_BY[f](c).alias(f"_all_{n}") for n, (f, c) in what.items()])
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "_piece", *[_BY[f](f"_all_{n}").over(before).alias(f"_from_{n}") for n, (f, _) in what.items()])
    both = joined(within, starts, [*keys, "_piece"])

    def put(n: str, f: str) -> Column:
        a, b = F.col(f"_in_{n}"), F.col(f"_from_{n}")
        return a + F.coalesce(b, F.lit(0)) if f == "sum" else (F.greatest if f == "max" else F.least)(a, b)

    return both.withColumns({n: put(n, f) for n, (f, _) in what.items()}).select(*points.columns, *what)


def mean_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds a row's rank by rising value within its key, from 1, ties averaged. Rows are written once: they meet their values again, to the last bit."""
    rows = durable(rows)
    points = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(points, keys, value, {"_upto": ("sum", "_n")})
    return joined(rows, ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), [*keys, value])


def quantiles(rows: DataFrame, keys: list[str], value: str, of: dict[str, float]) -> DataFrame:
    """keys and, for every name, the quantile of value with linear interpolation between neighbours."""
    points = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running(points, keys, value, {"_upto": ("sum", "_n")})
    total = points.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    both = joined(upto, total, keys)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col(value)))

    ends = []
    for name, q in of.items():
        place = (F.col("_all") - 1) * F.lit(float(q))
        ends += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    out = both.groupBy(*keys).agg(*ends)
    return out.select(*keys, *[(F.col(f"_lo_{n}") + F.col(f"_part_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in of])
