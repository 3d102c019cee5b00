"""Queries on pixels, each with its SQL: channels, photometric operators, features, regions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripcohort.operators import blocks, comparison, features, neighbourhoods, photometric, regions, rules
from stripcohort.sources import views
from stripcohort.sources.views import sql

QUERIES: dict = {}
SQL: dict = {}

PX = "px as (select image_id, label, row, col, b as value from pixels)"
CHANNELS = """c0 as (select *, greatest(b, g, r) as top, least(b, g, r) as low, (299 * r + 587 * g + 114 * b + 500) // 1000 as gray from pixels),
ch as (select image_id, label, row, col, b, g, r, cast(gray as int) as gray, cast(floor(case when top = low then 0e0 when r = top then 30e0 * (g - b) / (top - low) when g = top then 60e0 + 30e0 * (b - r) / (top - low) else 120e0 + 30e0 * (r - g) / (top - low) end + 0.5e0) as int) as hue, cast(case when top = 0 then 0 else (510 * (top - low) + top) // (2 * top) end as int) as s, top as v from c0)"""
OTSU = """hist as (select image_id, value, count(*) as n from px group by all),
cum as (select image_id, value, sum(n) over u::double as w, sum(n * value) over u::double as s, sum(n) over (partition by image_id)::double as nn, sum(n * value) over (partition by image_id)::double as ss from hist window u as (partition by image_id order by value)),
between_ as (select *, (s * nn - w * ss) * (s * nn - w * ss) / (w * (nn - w)) as b from cum where w < nn),
otsu as (select image_id, value as threshold from between_ qualify row_number() over (partition by image_id order by b desc, value) = 1)"""


def query(of: str = "pixels", **more: str) -> object:
    def add(f: object) -> object:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(of, **more)
        return f

    return add


def mirror_sql(at: str, size: int) -> str:
    """A place beyond the border as its reflection."""
    return f"(case when {at} < 0 then -({at}) when {at} > {size - 1} then {2 * (size - 1)} - ({at}) else {at} end)"


def extreme_sql(name: str, of: str, size: int, pick: str) -> str:
    """The largest or least value of a view under an elliptic footprint."""
    foot = ", ".join(f"({d}, {k})" for d, x in neighbourhoods.ellipse(size) for k in range(-x, x + 1))
    return f"{name} as materialized (select image_id, r as row, c as col, {pick}(value) as value from (select image_id, row + d as r, col + k as c, value from {of} cross join (values {foot}) f(d, k)) join (select max(row) as h, max(col) as w from {of}) on r between 0 and h and c between 0 and w group by 1, 2, 3)"


def fine_sql(of: str) -> str:
    """Views bh5, bh11, bh21: closings less openings of a view (the sum of both hats)."""
    out = []
    for n in neighbourhoods.SCALES:
        out += [extreme_sql(f"hi{n}", of, n, "max"), extreme_sql(f"cl{n}", f"hi{n}", n, "min"), extreme_sql(f"lo{n}", of, n, "min"), extreme_sql(f"op{n}", f"lo{n}", n, "max")]
        out.append(f"bh{n} as (select image_id, row, col, c.value - o.value as value from cl{n} c join op{n} o using (image_id, row, col))")
    return ",\n".join(out)


def _blue(spark: SparkSession, d: str) -> DataFrame:
    return views.pixels(spark, d).select("image_id", "label", "row", "col", F.col("b").alias("value"))


def _mosaic(spark: SparkSession, d: str, channel: str = "g") -> DataFrame:
    return neighbourhoods.placed(views.mosaics(spark, d).select("image_id", "label", "row", "col", F.col(channel).alias("value")))


def _bare(spark: SparkSession, d: str, channel: str = "g") -> DataFrame:
    return neighbourhoods.placed(_mosaic(spark, d, channel).drop("label"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return _blue(spark, d).drop("label")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(more=CHANNELS, body="select image_id, row, col, gray, hue % 180 + case when hue < 0 then 180 else 0 end as h, s, v from ch")
def p1_channels(spark: SparkSession, d: str) -> DataFrame:
    return photometric.channels(views.pixels(spark, d)).select("image_id", "row", "col", "gray", "h", "s", "v")


@query(
    more=CHANNELS + ", reps(representation, channel) as (values ('original', 'gray'), ('histogram', 'gray'), ('clahe', 'gray'), ('blur', 'gray'), ('frangi', 'green'), ('gabor', 'green'), ('blackhat', 'green'), ('combined', 'green'))",
    body="select image_id, representation, channel, round(avg(case when channel = 'gray' then gray else g end), 6) as mean, count(*)::bigint as n from ch cross join reps group by 1, 2, 3",
)
def p14_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """The channel that every representation reads by default, and its mean before any transform."""
    out = photometric.fan_out(photometric.channels(views.pixels(spark, d)))
    return out.groupBy("image_id", "representation", "channel").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    more=PX
    + f""", k(i, w) as (values (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
bl as (select a.image_id, a.row, a.col, sum(y.w * x.w * b.value) as s from px a cross join k y cross join k x join px b on b.image_id = a.image_id and b.row = {mirror_sql("a.row + y.i", 8)} and b.col = {mirror_sql("a.col + x.i", 8)} group by 1, 2, 3)""",
    body="select image_id, row, col, cast((s + 128) // 256 as int) as value from bl",
)
def p5_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhoods.smoothed(_plain(spark, d), 8, 8)


GAUSS = "g(i, w) as (values " + ", ".join(f"({i}, {math.exp(-(i * i) / 4.5)!r}e0)" for i in range(-5, 6)) + "), gn as (select i, w / sum(w) over () as w from g)"


@query(
    more=PX
    + f""", {GAUSS}, bl as (select a.image_id, a.row, a.col, sum(y.w * x.w * b.value) as s from px a cross join gn y cross join gn x join px b on b.image_id = a.image_id and b.row = {mirror_sql("a.row + y.i", 8)} and b.col = {mirror_sql("a.col + x.i", 8)} group by 1, 2, 3),
h as (select *, md5(concat_ws('|', 0, image_id, row, col)) as h from px),
n as (select *, sqrt(-2 * ln((('0x' || substr(h, 1, 8))::bigint + 0.5e0) / 4294967296e0)) * cos(2 * pi() * (('0x' || substr(h, 9, 8))::bigint + 0.5e0) / 4294967296e0) * 8 as z from h)""",
    body="""select image_id, row, col, 'blur' as kind, cast(round_even(round(s, 9), 0) as int) as value from bl union all
select image_id, row, col, 'noise', cast(greatest(0, least(255, round_even(round(value + z, 9), 0))) as int) from n""",
)
def p16_disturbed(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian noise of deviation 8 and blur of sigma 1.5."""
    image = _plain(spark, d)
    parts = {"noise": neighbourhoods.noisy(image, 8.0), "blur": neighbourhoods.blurred(image, 1.5, 8, 8)}
    noise, blur = (df.select("image_id", "row", "col", F.lit(k).alias("kind"), "value") for k, df in parts.items())
    return noise.union(blur)


MOSAIC = "px as (select image_id, label, row, col, g as value from mosaics)"


@query(more=PX + ", c as (select *, count(*) over (partition by image_id order by value) as c, count(*) over (partition by image_id) as n from px), z as (select *, min(c) over (partition by image_id) as c0 from c)", body="select image_id, row, col, cast(case when n = c0 then value else round_even((c - c0) * 255e0 / (n - c0), 0) end as int) as value from z")
def p3_equalised(spark: SparkSession, d: str) -> DataFrame:
    return photometric.equalise(_plain(spark, d))


@query(more=PX + ", m as (select *, min(value) over w as lo, max(value) over w as hi from px window w as (partition by image_id))", body="select image_id, row, col, cast(case when hi = lo then 0 else floor((value - lo)::double / (hi - lo) * 255e0) end as int) as value from m")
def p10_min_max(spark: SparkSession, d: str) -> DataFrame:
    return photometric.min_max(_plain(spark, d))


@query(
    more=PX + ", e as (select image_id, quantile_cont(value, 0.02) as a, quantile_cont(value, 0.99) as z from px group by 1)",
    body="select image_id, row, col, cast(floor(round(pow(least(1e0, greatest(0e0, (value - a) / (z - a))), 0.7e0) * 255e0, 9)) as int) as value from px join e using (image_id)",
)
def p11_stretched(spark: SparkSession, d: str) -> DataFrame:
    return photometric.stretch(_plain(spark, d))


@query(
    more=PX + ", m as (select *, count(*) over w as n, sum(value) over w as s, sum(value * value) over w as q from px window w as (partition by image_id))",
    body="select image_id, row, col, cast(floor(least(255e0, greatest(0e0, (value - s::double / n) / (sqrt(n::double * q::double - s::double * s::double) / n) * 50e0 + 128e0))) as int) as value from m",
)
def p12_normalised(spark: SparkSession, d: str) -> DataFrame:
    return photometric.normalise(_plain(spark, d))


@query(more=PX, body="select image_id, row - 2 as row, col, value from px where row >= 2")
def p13_cropped(spark: SparkSession, d: str) -> DataFrame:
    return photometric.crop_upper(_plain(spark, d), 2)


@query(
    more=PX
    + """, k as (select *, unnest(['brightness-', 'brightness+', 'contrast-', 'contrast+', 'gamma-', 'gamma+']) as kind from px)""",
    body="""select image_id, row, col, kind, cast(least(255, greatest(0, case kind when 'brightness-' then value - 30 when 'brightness+' then value + 30 when 'contrast-' then round_even(value * 0.7e0, 0) when 'contrast+' then round_even(value * 1.3e0, 0)
  when 'gamma-' then floor(pow(value / 255e0, 0.7e0) * 255e0 + 0.5e0) else floor(pow(value / 255e0, 1.5e0) * 255e0 + 0.5e0) end)) as int) as value from k""",
)
def p15_perturbed(spark: SparkSession, d: str) -> DataFrame:
    return photometric.perturb(_plain(spark, d))


@query(more=PX, body="select image_id, count(*)::bigint as n, round(avg(value), 6) as mean from px where sqrt((col - 3.5e0) * (col - 3.5e0) + (row - 3.5e0) * (row - 3.5e0)) <= 4.0 and sqrt((col - 3.5e0) * (col - 3.5e0) + (row - 3.5e0) * (row - 3.5e0)) > 1.6 group by 1")
def p17_ring(spark: SparkSession, d: str) -> DataFrame:
    return photometric.ring(_plain(spark, d), 3.5, 3.5, 1.6, 4.0).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    more=PX
    + ", o(distance, angle, dr, dc) as (values "
    + ", ".join(str(o) for o in features.OFFSETS)
    + """), q as (select image_id, row, col, value // 4 as i from px),
m as (select a.image_id, distance, angle, a.i, b.i as j from q a cross join o join q b on b.image_id = a.image_id and b.row = a.row + dr and b.col = a.col + dc),
c as (select image_id, distance, angle, i, j, count(*) as n from (select * from m union all select image_id, distance, angle, j, i from m) group by all),
s as (select image_id, distance, angle, sum(n)::double as t, sum(n * (i - j) * (i - j)) as c2, sum(n * abs(i - j)) as c1, sum(n / (1e0 + (i - j) * (i - j))) as h, sum(n * n) as a, sum(n * i)::double as si, sum(n * i * i)::double as sii, sum(n * i * j)::double as sij from c group by all)""",
    body="select image_id, distance, angle, round(c2 / t, 6) as contrast, round(c1 / t, 6) as dissimilarity, round(h / t, 6) as homogeneity, round(sqrt(a / (t * t)), 6) as energy, round(case when t * sii = si * si then 1e0 else (t * sij - si * si) / (t * sii - si * si) end, 6) as correlation, round(a / (t * t), 6) as asm from s",
)
def f3_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.cooccurrence(_plain(spark, d)), "contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")


@query(
    more=PX + ", m as (select *, avg(value) over (partition by image_id) as m from px), p as (select image_id, min(m) as mean, avg(pow(value - m, 2)) as m2, avg(pow(value - m, 3)) as m3, avg(pow(value - m, 4)) as m4 from m group by 1)",
    body="select image_id, round(mean, 6) as mean, round(sqrt(m2), 6) as std, round(case when m2 = 0 then 0 else m3 / pow(m2, 1.5) end, 6) as skew, round(case when m2 = 0 then 0 else m4 / (m2 * m2) - 3 end, 6) as kurt from p",
)
def f4_intensity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.intensity(_plain(spark, d), ["image_id"]), "mean", "std", "skew", "kurt")


@query(more=PX + ", n as (select image_id, cast(least(31, value * 32 // 255) as int) as bin, count(*) as n from px group by all)", body="select image_id, bin, round(n / sum(n) over (partition by image_id) / (255e0 / 32), 6) as density from n")
def f4_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.histogram(_plain(spark, d), ["image_id"]), "density")


@query(more=CHANNELS, body="select image_id, " + ", ".join(f"round(avg({c}), 6) as mean_{c}, round(stddev_pop({c}), 6) as std_{c}" for c in ("b", "g", "r", "gray")) + " from ch group by 1")
def f10_colour_block(spark: SparkSession, d: str) -> DataFrame:
    ch = photometric.channels(views.pixels(spark, d))
    return ch.groupBy("image_id").agg(*[F.round(f(c), 6).alias(f"{n}_{c}") for c in ("b", "g", "r", "gray") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


@query(
    more=PX
    + ", "
    + OTSU
    + """, m as (select px.*, coalesce(value > threshold, false) as fg from px left join otsu using (image_id)),
e as (select image_id, -sum(p * log2(p)) as entropy from (select image_id, n / sum(n) over (partition by image_id) as p from hist) group by 1),
la as (select a.image_id, a.row, a.col, sum(w * b.value) as s from px a cross join (values (-1, -1, 2), (-1, 1, 2), (0, 0, -8), (1, -1, 2), (1, 1, 2)) f(i, j, w) join px b on b.image_id = a.image_id and b.row = """
    + mirror_sql("a.row + i", 8)
    + " and b.col = "
    + mirror_sql("a.col + j", 8)
    + """ group by 1, 2, 3),
ri as (select image_id, var_pop(s) / 65025 as ridge from la group by 1)""",
    body="""select image_id, round(any_value(ridge), 6) as ridge, round(avg(fg::int), 6) as density, round((avg(value) filter (fg) - avg(value) filter (not fg)) / (stddev_pop(value) filter (not fg) + 1e-6), 6) as cnr, round(stddev_pop(value) / 255, 6) as rms, round(any_value(entropy), 6) as entropy from m join e using (image_id) join ri using (image_id) group by 1""",
)
def f11_visibility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.visibility(_plain(spark, d), 8, 8), "density", "cnr", "rms", "entropy", "ridge")


@query(
    more=PX + ", " + OTSU + ", m as (select px.*, coalesce(value > threshold, false)::int as fg from px left join otsu using (image_id))",
    body="select image_id, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.9), 6) as p90, round(avg(fg), 6) as density, " + ", ".join(f"round(avg(value) filter (row * 3 // 8 = {k}), 6) as mean_{k}, round(avg(fg) filter (row * 3 // 8 = {k}), 6) as density_{k}" for k in range(3)) + " from m group by 1",
)
def f13_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Response statistics of an image, whole and by radial thirds."""
    image = _plain(spark, d)
    marked = image.join(features.otsu(image), "image_id").withColumn("fg", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).cast("double")).withColumn("third", F.floor(F.col("row") * 3 / 8))
    whole = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", 0.9).alias("p90"), F.avg("fg").alias("density")]
    parts = [F.avg(F.when(F.col("third") == k, F.col(c))).alias(f"{n}_{k}") for k in range(3) for n, c in (("mean", "value"), ("density", "fg"))]
    out = marked.groupBy("image_id").agg(*whole, *parts)
    return rounded(out, *[c for c in out.columns if c != "image_id"])


@query(more=PX + ", " + OTSU, body="select image_id, row, round(avg(coalesce(value > threshold, false)::int), 6) as share, round(avg(value), 6) as mean from px left join otsu using (image_id) group by 1, 2")
def f14_radial_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.radial_profile(_plain(spark, d)), "share", "mean")


@query(more=PX + ", " + OTSU + ", p as (select image_id, row, avg(coalesce(value > threshold, false)::int) as share, avg(value) as mean from px left join otsu using (image_id) group by 1, 2)", body="select image_id, round(avg(share) filter (row / 7e0 <= 1 / 3e0), 6) as share_inner, round(avg(share) filter (row / 7e0 >= 1 / 3e0), 6) as share_outer, round(avg(mean) filter (row / 7e0 <= 1 / 3e0), 6) as mean_inner, round(avg(mean) filter (row / 7e0 >= 1 / 3e0), 6) as mean_outer from p group by 1")
def f14_radial_thirds(spark: SparkSession, d: str) -> DataFrame:
    """The profile's means over the inner third of the rows, and over the rest."""
    profile = features.radial_profile(_plain(spark, d)).withColumn("at", F.col("row") / 7.0)
    inner, outer = F.col("at") <= 1 / 3, F.col("at") >= 1 / 3
    return profile.groupBy("image_id").agg(*[F.round(F.avg(F.when(on, F.col(c))), 6).alias(f"{c}_{n}") for c in ("share", "mean") for n, on in (("inner", inner), ("outer", outer))])


KINDS = """k as (select *, unnest(['brightness-', 'brightness+', 'contrast-', 'contrast+', 'gamma-', 'gamma+']) as kind from px),
pk as (select image_id, row, col, kind, cast(least(255, greatest(0, case kind when 'brightness-' then value - 30 when 'brightness+' then value + 30 when 'contrast-' then round_even(value * 0.7e0, 0) when 'contrast+' then round_even(value * 1.3e0, 0)
  when 'gamma-' then floor(pow(value / 255e0, 0.7e0) * 255e0 + 0.5e0) else floor(pow(value / 255e0, 1.5e0) * 255e0 + 0.5e0) end)) as int) as value from k)"""


@query(
    more=PX
    + ", "
    + OTSU
    + ", "
    + KINDS
    + ", "
    + OTSU.replace("from px", "from (select concat(image_id, '|', kind) as image_id, value from pk)").replace("hist", "khist").replace("cum", "kcum").replace("between_", "kbetween").replace("otsu as", "kotsu as")
    + """, j as (select p.image_id, kind, p.value as v, q.value as u, coalesce(p.value > o.threshold, false) as a, coalesce(q.value > t.threshold, false) as b from px p join pk q using (image_id, row, col) left join otsu o on o.image_id = p.image_id left join kotsu t on t.image_id = concat(p.image_id, '|', kind)),
c as (select image_id, kind, case when count_if(a) + count_if(b) > 0 then 2e0 * count_if(a and b) / (count_if(a) + count_if(b)) end as dice, corr(v, u) as r, (avg(v) filter (a) - avg(v) filter (not a)) / (stddev_pop(v) filter (not a) + 1e-6) as cnr, (avg(u) filter (b) - avg(u) filter (not b)) / (stddev_pop(u) filter (not b) + 1e-6) as cnr2 from j group by 1, 2)""",
    body="select image_id, kind, round(dice, 6) as dice, round(r, 6) as r, round(cnr, 6) as cnr, round(cnr2, 6) as cnr2, round(cnr2 / cnr, 6) as retained from c",
)
def m11_mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Structures of an image and of each point perturbation of it, each over its own threshold.

    Pixels are shuffled once, by image and before they are perturbed, in parts of 2000 images; thresholds meet them by image alone.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), views.table(spark, d, "embeddings").count() // 2000 + 1)
    clean = _plain(spark, d).repartition(parts, "image_id")
    per_kind = features.otsu(photometric.perturb(clean), ("image_id", "kind"))
    kinds = per_kind.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "threshold"))).alias("_t2"))
    each = clean.select("image_id", "value", F.inline(photometric.perturbations(F.col("value"))).alias("kind", "value2"))
    met = each.join(features.otsu(clean), "image_id").join(kinds, "image_id")
    over = lambda v, t: F.coalesce(F.col(v) > t, F.lit(False))
    both = met.select("image_id", "kind", "value", "value2", over("value", F.col("threshold")).alias("on"), over("value2", F.try_element_at("_t2", F.col("kind"))).alias("on2"))
    out = features.overlap(both, ["image_id", "kind"])
    return rounded(out, "dice", "r", "cnr", "cnr2", "retained")


@query(more=PX, body="select s as start, label, count(*)::bigint as n, round(avg(value), 6) as mean from px join (select unnest(range(0, 311, 10)) as s) on col * 45 >= s and col * 45 < s + 50 group by 1, 2")
def r1_sectors(spark: SparkSession, d: str) -> DataFrame:
    cut = features.sectors(_blue(spark, d), F.col("col") * 45, 310, 10, 50)
    return cut.groupBy("start", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(more=PX, body="select s as start, label, count(*)::bigint as n, round(avg(value), 6) as mean from px join (select unnest(range(0, 666, 5)) as s) on col * 90 >= s and col * 90 < s + 50 group by 1, 2")
def r2_pixel_sweep(spark: SparkSession, d: str) -> DataFrame:
    cut = features.sectors(_blue(spark, d), F.col("col") * 90, 665, 5, 50)
    return cut.groupBy("start", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


#: Views that validate regions: rows(region..., image_id, fold, y, dim, x) come before.
FOLDED = "fo as (select image_id, (row_number() over (partition by label order by md5(concat('42|', image_id::varchar)), image_id) - 1) % 5 as fold from (select distinct image_id, label from px))"


def centroid_sql(region: str) -> str:
    on = " and ".join(f"a.{c.strip()} = b.{c.strip()}" for c in region.split(","))
    of = ", ".join(f"a.{c.strip()}" for c in region.split(","))
    return f"""rw as (select {of}, a.image_id, fold, label, dim, x from feats a join fo using (image_id)),
fd as (select {region}, dim, fold, count(*) filter (label = 1) as n1, sum(x) filter (label = 1) as s1, count(*) as n, sum(x) as s, sum(x * x) as q from rw group by all),
tr as (select {of}, a.dim, a.fold, sum(b.n) as n, coalesce(sum(b.n1), 0) as n1, coalesce(sum(b.s1), 0) as s1, sum(b.s) as s, sum(b.q) as q from (select distinct {region}, dim, fold from fd) a join fd b on {on} and a.dim = b.dim and a.fold <> b.fold group by all),
mm as (select *, case when n1 > 0 then s1 / n1 end as m1, case when n - n1 > 0 then (s - s1) / (n - n1) end as m0, sqrt(greatest(q / n - (s / n) * (s / n), 0)) as sd from tr),
aw as (select {of}, a.image_id, a.fold, a.label, case when m0 is null or m1 is null then null when sd > 1e-9 then ((x - m0) / sd) * ((x - m0) / sd) - ((x - m1) / sd) * ((x - m1) / sd) else 0 end as d from rw a left join mm b on {on} and a.dim = b.dim and a.fold = b.fold),
pr as (select {region}, image_id, label = 1 as y, round(sum(d), 9) > 0 as pred from aw group by {region}, image_id, fold, label),
ce as (select {region}, count(pred) as n, count_if(y and pred) as tp, count_if(not y and not pred) as tn, count_if(not y and pred) as fp, count_if(y and not pred) as fn from pr group by {region})"""


VALIDATED = "n::bigint as n, round(coalesce((tp + tn) / nullif(n, 0), 0.5), 6) as acc, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as sens, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) as spec, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"
STATS = "unnest([0, 1]) as dim, unnest([avg(value), stddev_pop(value)]) as x"


def _validated(spark: SparkSession, cut: DataFrame, region: list[str], shapes: bool = False) -> DataFrame:
    """Validates the regions of cut (region, image_id, label, value) on mean and deviation, with shapes also on skewness and kurtosis."""
    labels = cut.select("image_id", "label").distinct()
    folds = rules.stratified_folds(labels, "label", key="image_id").select("image_id", "fold")
    stats = features.intensity(cut, [*region, "image_id", "label"])
    names = ["mean", "std", "skew", "kurt"] if shapes else ["mean", "std"]
    dims = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(n).alias("x")) for i, n in enumerate(names)])
    rows = stats.select(*region, "image_id", (F.col("label") == 1).alias("y"), F.inline(dims)).join(folds, "image_id")
    return rounded(regions.validated(rows, region), "acc", "sens", "spec", "f1")


CELL = "cells_ as (select image_id, label, cast((row - 10) // 4 as int) as cell_row, cast(col // 5 as int) as cell_col, value from px where row >= 10 and (row - 10) // 4 < 12 and col // 5 < 12)"
SHAPE = "mo as (select *, avg(value) over (partition by image_id, cell_row, cell_col) as mu from cells_), sh as (select image_id, label, cell_row, cell_col, min(mu) as mean, avg(pow(value - mu, 2)) as m2, avg(pow(value - mu, 3)) as m3, avg(pow(value - mu, 4)) as m4 from mo group by 1, 2, 3, 4), st as (select image_id, label, cell_row, cell_col, mean, sqrt(m2) as std, case when m2 = 0 then 0 else m3 / pow(m2, 1.5) end as skew, case when m2 = 0 then 0 else m4 / (m2 * m2) - 3 end as kurt from sh)"


@query("mosaics", more=", ".join([MOSAIC, CELL, SHAPE]), body="select image_id, cell_row, cell_col, round(mean, 6) as mean, round(std, 6) as std, round(skew, 6) as skew, round(kurt, 6) as kurt from st")
def r3_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Moments of every cell of a 12 x 12 grid below row 10; rows and columns that fill no cell fall away."""
    cells = features.grid_cells(_mosaic(spark, d), 12, 64, 64, top=10)
    return rounded(features.intensity(cells, ["image_id", "cell_row", "cell_col"]), "mean", "std", "skew", "kurt")


@query(
    "mosaics",
    more=", ".join([MOSAIC, CELL, SHAPE, FOLDED, "feats as (select image_id, label, cell_row, cell_col, unnest([0, 1, 2, 3]) as dim, unnest([mean, std, skew, kurt]) as x from st)", centroid_sql("cell_row, cell_col")]),
    body=f"select cell_row, cell_col, {VALIDATED} from ce",
)
def r3_grid_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Every cell validated on its moments; a cell that can't be fitted has accuracy 0.5."""
    cells = features.grid_cells(_mosaic(spark, d), 12, 64, 64, top=10)
    return _validated(spark, cells, ["cell_row", "cell_col"], shapes=True)


SECTOR = f"feats as (select image_id, label, s as start, {STATS} from px join (select unnest(range(0, 311, 10)) as s) on col * 45 >= s and col * 45 < s + 50 group by 1, 2, 3)"


def _sectors(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, features.sectors(_blue(spark, d), F.col("col") * 45, 310, 10, 50), ["start"])


@query(more=", ".join([PX, FOLDED, SECTOR, centroid_sql("start")]), body=f"select start::int as start, {VALIDATED} from ce")
def r4_sector_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every angular sector validated by itself, all in one pass."""
    return _sectors(spark, d)


@query(more=", ".join([PX, FOLDED, SECTOR, centroid_sql("start"), f"va as (select start::int as start, {VALIDATED} from ce)"]), body="select start, acc, cast(row_number() over (order by acc desc, start) as int) as place from va where acc >= 0.5")
def r5_sectors_above(spark: SparkSession, d: str) -> DataFrame:
    """Sectors of an accuracy of 0.5 or more, the best first."""
    return regions.of_at_least(_sectors(spark, d), "acc", 0.5, ["start"]).select("start", "acc", "place")


@query(
    more=", ".join([PX, FOLDED, f"feats as (select image_id, label, s as start, {STATS} from px join (select unnest(range(0, 666, 5)) as s) on col * 90 >= s and col * 90 < s + 50 group by 1, 2, 3)", centroid_sql("start")]),
    body="select start::int as start, n::bigint as n, round(1 - coalesce((tp + tn) / nullif(n, 0), 0.5), 6) as error from ce",
)
def r2_error_sweep(spark: SparkSession, d: str) -> DataFrame:
    """R2: the error rate of every window of the pixel sweep."""
    out = _validated(spark, features.sectors(_blue(spark, d), F.col("col") * 90, 665, 5, 50), ["start"])
    return out.select("start", "n", F.round(1 - F.col("acc"), 6).alias("error"))


@query("mosaics", more=", ".join([MOSAIC, FOLDED, f"feats as (select image_id, label, row * 100 // 64 as ring, {STATS} from px group by 1, 2, 3)", centroid_sql("ring")]), body=f"select ring::int as ring, {VALIDATED} from ce")
def r8_rings(spark: SparkSession, d: str) -> DataFrame:
    """Radial rings, of which there are 100, each validated by itself."""
    cut = _mosaic(spark, d).withColumn("ring", F.floor(F.col("row") * 100 / 64).cast("int"))
    return _validated(spark, cut, ["ring"])


@query(
    "mosaics",
    more=CHANNELS.replace("from pixels", "from mosaics")
    + """, lo as (select image_id, row, col, unnest(['blue', 'green', 'red', 'gray']) as method, unnest([b, g, r, gray]) as value from ch), px as (select concat(image_id, '|', method) as image_id, value from lo), """
    + OTSU
    + """, se as (select lo.*, threshold, floor(mod(degrees(atan2(31.5e0 - row, col - 31.5e0)) + 360, 360) / 30)::int as sector, sqrt((row - 31.5e0) * (row - 31.5e0) + (col - 31.5e0) * (col - 31.5e0)) as away from lo left join otsu on otsu.image_id = concat(lo.image_id, '|', method)),
cn as (select image_id, sector, method, count(*) as n, (avg(value) filter (value > threshold) - avg(value) filter (value <= threshold)) / (stddev_pop(value) filter (value <= threshold) + 1e-6) as cnr from se where away <= 30 and away > 8 group by 1, 2, 3 having count(*) >= 100)""",
    body="select image_id, sector, method, n::bigint as n, round(cnr, 6) as cnr, round(max(cnr) filter (method in ('gray', 'red')) over (partition by image_id, sector), 6) as best, round(cnr / nullif(max(cnr) filter (method in ('gray', 'red')) over (partition by image_id, sector), 0), 6) as gain from cn",
)
def r9_sector_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Contrast to noise in twelve sectors of a ring, per channel, beside the best of two baselines; sectors of under 100 pixels are left out."""
    ch = photometric.channels(views.mosaics(spark, d))
    methods = F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("value")) for n, c in (("blue", "b"), ("green", "g"), ("red", "r"), ("gray", "gray"))])
    long = ch.select("image_id", "row", "col", F.inline(methods))
    marked = long.join(features.otsu(long, ("image_id", "method")), ["image_id", "method"])
    out = features.angular_contrast(photometric.ring(marked, 31.5, 31.5, 8, 30), 31.5, 31.5, 12, ["image_id", "method"], least=100)
    gain = comparison.gain(out, ["image_id", "sector"], "method", ["gray", "red"], "cnr")
    return rounded(gain.select("image_id", "sector", "method", "n", "cnr", "best", "gain"), "cnr", "best", "gain")


@query(
    more=PX + ", m as (select s as start, round(abs(avg(value) filter (label = 1) - avg(value) filter (label = 0)), 6) as gap from px join (select unnest(range(0, 311, 10)) as s) on col * 45 >= s and col * 45 < s + 50 group by 1)",
    body="select cast(start as int) as start, gap, gap = max(gap) over () and start = min(start) filter (gap = (select max(gap) from m)) over () as best from m",
)
def r5_best_sector(spark: SparkSession, d: str) -> DataFrame:
    """Class gap of every sector, the first of the largest flagged. The window spans the sectors, whose number the data don't change."""
    cut = features.sectors(_blue(spark, d), F.col("col") * 45, 310, 10, 50)
    of = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    gaps = cut.groupBy("start").agg(F.round(F.abs(of(1) - of(0)), 6).alias("gap"))
    top = gaps.agg(F.max_by("start", F.struct(F.col("gap"), -F.col("start"))).alias("_top"))
    return gaps.crossJoin(F.broadcast(top)).select("start", "gap", (F.col("start") == F.col("_top")).alias("best"))


@query(more=PX, body="select image_id, case when row between 1 and 6 then 'stroma' else 'border' end as zone, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from px group by 1, 2")
def r7_radial_split(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("row").between(1, 6), "stroma").otherwise("border")
    return _plain(spark, d).groupBy("image_id", zone.alias("zone")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


#: Two-sided p of Welch's t by Simpson's rule over 400 steps of Student's density.
DIFF = """s as (select row, col, count(*) filter (label = 1) as n1, count(*) filter (label = 0) as n0, avg(value) filter (label = 1) as m1, avg(value) filter (label = 0) as m0, var_samp(value) filter (label = 1) as v1, var_samp(value) filter (label = 0) as v0 from px group by 1, 2),
t as (select row, col, (m1 - m0) / greatest(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 1e-9) as cohen_d, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) as welch_t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) as df from s),
p as (select *, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs(welch_t) / 1200 * list_sum(list_transform(range(0, 401), lambda i: (case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(abs(welch_t) * i / 400e0, 2) / df, -(df + 1) / 2))) as p from t),
r as (select *, p * count(*) over () / row_number() over (order by p, row, col) as st from p), q as (select *, least(1, min(st) over (order by p desc, row desc, col desc)) as q from r)"""


def _difference(spark: SparkSession, d: str) -> DataFrame:
    return blocks.difference_map(_blue(spark, d))


@query(more=PX + ", " + DIFF, body="select row, col, round(cohen_d, 6) as cohen_d, round(welch_t, 6) as welch_t, round(p, 6) as p, round(q, 6) as q from q")
def r10_difference_map(spark: SparkSession, d: str) -> DataFrame:
    """Cohen's d (pooled) and Welch's t of the classes at every place, its p, and q over all places."""
    return rounded(_difference(spark, d), "cohen_d", "welch_t", "p", "q")


@query(more=PX + ", " + DIFF, body="select round(median(abs(cohen_d)), 6) as median_d, round(max(abs(cohen_d)), 6) as max_d, round(avg((q < 0.05)::int), 6) as significant, round(avg(abs(cohen_d)) filter (row < 3), 6) as d_0, round(avg(abs(cohen_d)) filter (row between 3 and 5), 6) as d_1, round(avg(abs(cohen_d)) filter (row > 5), 6) as d_2 from q")
def r10_summary(spark: SparkSession, d: str) -> DataFrame:
    """The map's median and largest difference, its share of places with q below 0.05, and the mean difference by radial thirds."""
    out = blocks.difference_summary(_difference(spark, d), 8)
    return rounded(out, *out.columns)
