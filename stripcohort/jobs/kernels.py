"""Queries on filtered images and their features, each with its SQL: local equalisation, vessel maps, textures, gradients, unrolled rings.

The SQL joins every pixel to its neighbours and sums, from the formulas of the kernels; the operators take other ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripcohort.jobs import imaging
from stripcohort.jobs.imaging import CHANNELS, MOSAIC, OTSU, fine_sql, rounded
from stripcohort.operators import blocks, features, neighbourhoods, photometric
from stripcohort.sources import views
from stripcohort.sources.views import sql

QUERIES: dict = {}
SQL: dict = {}
N = 64


def query(more: str, body: str) -> object:
    def add(f: object) -> object:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql("mosaics", more=more, body=body)
        return f

    return add


def mirror_sql(at: str) -> str:
    return imaging.mirror_sql(at, N)


def reflect_sql(at: str) -> str:
    """A place beyond the border as its reflection, the edge repeated."""
    return f"(case when {at} < 0 then -({at}) - 1 when {at} > {N - 1} then {2 * N - 1} - ({at}) else {at} end)"


def equalised_sql(name: str, of: str) -> str:
    """A view with the locally equalised values of another: tiles of 8 x 8 pixels, histograms cut at 1."""
    look = ", ".join(f"t[(r{r} * 8 + c{c}) * 256 + value + 1] as {n}" for n, r, c in (("a", 1, 1), ("b", 1, 2), ("c", 2, 1), ("d", 2, 2)))
    return f"""{name}_h as (select image_id, row // 8 * 8 + col // 8 as tile, value, count(*) as n from {of} group by all),
{name}_e as (select image_id, tile, sum(greatest(0, n - 1)) as e from {name}_h group by all),
{name}_s as (select *, greatest(256 // greatest(e % 256, 1), 1) as step, unnest(range(0, 256)) as level from {name}_e),
{name}_l as (select s.image_id, s.tile, level, least(coalesce(n, 0), 1) + e // 256 + case when level % step = 0 and level // step < e % 256 then 1 else 0 end as n
  from {name}_s s left join {name}_h h on h.image_id = s.image_id and h.tile = s.tile and h.value = level),
{name}_c as (select image_id, tile, level, round_even(sum(n) over (partition by image_id, tile order by level) * 3.984375e0, 0) as t from {name}_l),
{name}_t as materialized (select image_id, list(t order by tile, level) as t from {name}_c group by image_id),
{name}_w as (select image_id, row, col, value, row / 8e0 - 0.5e0 as y, col / 8e0 - 0.5e0 as x from {of}),
{name}_n as (select *, greatest(0, floor(y))::int as r1, least(7, floor(y) + 1)::int as r2, greatest(0, floor(x))::int as c1, least(7, floor(x) + 1)::int as c2 from {name}_w),
{name} as materialized (select image_id, row, col, cast(round_even(round((a * (1 - x + floor(x)) + b * (x - floor(x))) * (1 - y + floor(y)) + (c * (1 - x + floor(x)) + d * (x - floor(x))) * (y - floor(y)), 9), 0) as int) as value
  from (select w.image_id, row, col, x, y, {look} from {name}_n w join {name}_t using (image_id)))"""


def vesselness_sql(name: str, of: str) -> str:
    """A view of the largest answer over four scales, before it is stretched."""
    return f"""fs(scale, s, rad) as (values (1, 1 / sqrt(2e0), 6), (2, 2 / sqrt(2e0), 11), (3, 3 / sqrt(2e0), 17), (4, 4 / sqrt(2e0), 23)),
f0 as (select scale, s, unnest(range(-rad, rad + 1)) as k from fs),
fg as (select scale, k, exp(-(k * k) / (2 * s * s)) / sum(exp(-(k * k) / (2 * s * s))) over (partition by scale) as g, s from f0),
fi as (select scale, k, g, k / (s * s) * g as d, unnest(range(0, {N})) as i from fg),
fm as (select scale, i, {reflect_sql("i + k")} as j, sum(g) as g, sum(d) as d from fi group by all),
fp as materialized (select a.scale, a.i, b.j, sum(a.g * b.g) as gg, sum(a.d * b.g) as dg, sum(a.g * b.d) as gd, sum(a.d * b.d) as dd from fm a join fm b on a.scale = b.scale and a.j = b.i group by all),
fw as materialized (select image_id, row, m.i as col, m.scale, sum(value / 255e0 * gg) as gg, sum(value / 255e0 * dg) as dg, sum(value / 255e0 * dd) as dd from {of} p join fp m on m.j = p.col group by all),
fh as (select image_id, m.i as row, col, w.scale, sum(w.gg * m.dd) as rr, sum(w.dg * m.gd) as rc, sum(w.dd * m.gg) as cc from fw w join fp m on m.scale = w.scale and m.j = w.row group by all),
fe as (select image_id, row, col, -(rr + cc) / 2 - sqrt(pow(rr - cc, 2) / 4 + rc * rc) as a, -(rr + cc) / 2 + sqrt(pow(rr - cc, 2) / 4 + rc * rc) as b from fh),
fl as (select image_id, row, col, case when abs(a) <= abs(b) then a else b end as l1, case when abs(a) <= abs(b) then b else a end as l2 from fe),
{name} as materialized (select image_id, row, col, round(max(exp(-pow(abs(l1) / greatest(l2, 1e-10), 2) / 0.5e0) * (1 - exp(-(l1 * l1 + l2 * l2) / 450e0))), 12) as value from fl group by all)"""


def oriented_sql(name: str, of: str) -> str:
    """A view of the largest absolute answer of eight oriented kernels."""
    turned = "(c * cos(pi() * o / 8) + r * sin(pi() * o / 8))"
    sums = ", ".join(f"abs(sum(p.value * w{o}))" for o in range(8))
    return f"""k0 as (select unnest(range(-10, 11)) as r), k1 as (select r, unnest(range(-10, 11)) as c from k0), k2 as (select r, c, unnest(range(0, 8)) as o from k1),
k3 as (select r, c, o, exp(-0.5e0 * (pow({turned}, 2) + 0.25e0 * pow(-c * sin(pi() * o / 8) + r * cos(pi() * o / 8), 2)) / 16) * cos(2 * pi() * {turned} / 10) as w from k2),
k4 as (select r, c, o, w - avg(w) over (partition by o) as w from k3),
k5 as (select r, c, {", ".join(f"max(w) filter (o = {o}) as w{o}" for o in range(8))} from k4 group by r, c),
k6 as (select q.image_id, q.row, q.col, {mirror_sql("q.row + r")} as tr, {mirror_sql("q.col + c")} as tc, k5.* from {of} q cross join k5),
{name} as materialized (select k6.image_id, k6.row, k6.col, round(greatest({sums}), 9) as value from k6 join {of} p on p.image_id = k6.image_id and p.row = tr and p.col = tc group by all)"""


def stretch_sql(name: str, of: str) -> str:
    return f"""{name}_e as (select image_id, quantile_cont(value, 0.02) as a, quantile_cont(value, 0.99) as z, min(value) as lo, max(value) as hi from {of} group by 1),
{name} as materialized (select image_id, row, col, cast(case when z - a >= 1e-12 then floor(round(pow(least(1e0, greatest(0e0, (value - a) / (z - a))), 0.7e0) * 255e0, 9)) when hi - lo < 1e-12 then 0 else floor((value - lo) / (hi - lo) * 255e0) end as int) as value from {of} join {name}_e using (image_id))"""


def min_max_sql(name: str, of: str) -> str:
    lo, hi = "min(value) over (partition by image_id)", "max(value) over (partition by image_id)"
    return f"{name} as materialized (select image_id, row, col, cast(case when {hi} - {lo} < 1e-12 then 0 else floor((value - {lo})::double / ({hi} - {lo}) * 255e0) end as int) as value from {of})"


BLACKHAT = fine_sql("eq") + ", bh as (select image_id, row, col, cast(bh5.value + bh11.value + bh21.value as int) as value from bh5 join bh11 using (image_id, row, col) join bh21 using (image_id, row, col))"
COMBINED = "fused as (select image_id, row, col, f.value / 255e0 * 0.6e0 + b.value / 255e0 * 0.4e0 as value from frangi f join blackhat b using (image_id, row, col))"
EQUALISED = MOSAIC + ", " + equalised_sql("eq", "px")


def _green(spark: SparkSession, d: str) -> DataFrame:
    return imaging._bare(spark, d)


def _even(spark: SparkSession, d: str) -> DataFrame:
    """The locally equalised green channel, which the vessel maps read."""
    return neighbourhoods.local_equalised(_green(spark, d), N, N)


def _fine(df: DataFrame, n: int) -> DataFrame:
    return neighbourhoods.placed(df.withColumn("value", F.round("value", n)))


@query(EQUALISED, "select image_id, row, col, value from eq")
def p4_local_equalised(spark: SparkSession, d: str) -> DataFrame:
    return _even(spark, d)


@query(EQUALISED + ", " + vesselness_sql("ve", "eq") + ", " + stretch_sql("frangi", "ve"), "select image_id, row, col, value from frangi")
def p6_vesselness(spark: SparkSession, d: str) -> DataFrame:
    return photometric.stretch(_fine(neighbourhoods.vesselness(_even(spark, d), N, N), 12))


@query(EQUALISED + ", " + oriented_sql("ga", "eq") + ", " + min_max_sql("gabor", "ga"), "select image_id, row, col, value from gabor")
def p7_oriented(spark: SparkSession, d: str) -> DataFrame:
    return photometric.min_max(_fine(neighbourhoods.oriented(_even(spark, d), N, N), 9))


@query(EQUALISED + ", " + BLACKHAT, "select image_id, row, col, value from bh")
def p8_fine_structures(spark: SparkSession, d: str) -> DataFrame:
    """Both hats at three scales, on the equalised image."""
    return neighbourhoods.fine_structures(_even(spark, d), N)


@query(
    ", ".join([EQUALISED, vesselness_sql("ve", "eq"), stretch_sql("frangi", "ve"), BLACKHAT, min_max_sql("blackhat", "bh"), COMBINED, min_max_sql("combined", "fused")]),
    "select image_id, row, col, value from combined",
)
def p9_combined(spark: SparkSession, d: str) -> DataFrame:
    return photometric.vessel_maps(_green(spark, d), N, N)["combined"]


@query(
    CHANNELS.replace("from pixels", "from mosaics")
    + f""", gr as (select image_id, row, col, gray as value from ch), px as (select image_id, row, col, g as value from ch),
c as (select *, count(*) over (partition by image_id order by value) as c, count(*) over (partition by image_id) as n from gr), z as (select *, min(c) over (partition by image_id) as c0 from c),
sm(i, w) as (values (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
s1 as (select a.image_id, a.row, a.col, sum(w * b.value) as value from gr a cross join sm join gr b on b.image_id = a.image_id and b.row = a.row and b.col = {mirror_sql("a.col + i")} group by 1, 2, 3),
s2 as (select a.image_id, a.row, a.col, sum(w * b.value) as value from s1 a cross join sm join s1 b on b.image_id = a.image_id and b.col = a.col and b.row = {mirror_sql("a.row + i")} group by 1, 2, 3), """
    + ", ".join([equalised_sql("eg", "gr"), equalised_sql("eq", "px"), vesselness_sql("ve", "eq"), stretch_sql("frangi", "ve"), oriented_sql("ga", "eq"), min_max_sql("gabor", "ga"), BLACKHAT, min_max_sql("blackhat", "bh"), COMBINED, min_max_sql("combined", "fused")]),
    """select image_id, 'original' as representation, row, col, value::int as value from gr union all
select image_id, 'histogram', row, col, cast(case when n = c0 then value else round_even((c - c0) * 255e0 / (n - c0), 0) end as int) from z union all
select image_id, 'clahe', row, col, value from eg union all
select image_id, 'blur', row, col, cast((value + 128) // 256 as int) from s2 union all
select image_id, 'frangi', row, col, value from frangi union all
select image_id, 'gabor', row, col, value from gabor union all
select image_id, 'blackhat', row, col, value from blackhat union all
select image_id, 'combined', row, col, value from combined""",
)
def p14_transformed(spark: SparkSession, d: str) -> DataFrame:
    """Every image under every transform."""
    return photometric.transformed(neighbourhoods.placed(photometric.channels(views.mosaics(spark, d))), N, N)


@query(
    EQUALISED
    + ", "
    + BLACKHAT
    + ", big as (select image_id, row, col, bh5.value as a, bh11.value as b, bh21.value as c from bh5 join bh11 using (image_id, row, col) join bh21 using (image_id, row, col)), "
    + OTSU.replace("from px", "from (select image_id, greatest(a, b, c) as value from big)")
    + """, on_ as (select *, case when a >= b and a >= c then 5 when b >= c then 11 else 21 end as scale from big join otsu using (image_id) where greatest(a, b, c) > threshold)""",
    """select image_id, scale, round(coalesce(n, 0) / (sum(n) over (partition by image_id)), 6) as share, round(mean, 6) as mean from
(select image_id, unnest([5, 11, 21]) as scale, unnest([avg(a), avg(b), avg(c)]) as mean from big group by 1) left join (select image_id, scale, count(*) as n from on_ group by 1, 2) using (image_id, scale)""",
)
def f15_dominant_scale(spark: SparkSession, d: str) -> DataFrame:
    """Which footprint answers most among structure pixels, of equals the smallest, and every footprint's mean answer."""
    answers = neighbourhoods.hats(_even(spark, d), N)
    return rounded(features.dominant_scale(answers.select("image_id", "row", "col", F.col("size").alias("scale"), (F.col("closed") - F.col("opened")).alias("value"))), "share", "mean")


@query(
    MOSAIC
    + f""", g as (select unnest(range(-6, 7)) as k), gn as (select k, exp(-(k * k) / 4.5e0) / sum(exp(-(k * k) / 4.5e0)) over () as w from g),
gi as (select k, w, unnest(range(0, {N})) as i from gn), bm as (select i, {mirror_sql("i + k")} as j, sum(w) as w from gi group by all),
rm as (select i // 4 as i, j, sum(w) / 2 as w from bm where i % 4 in (1, 2) group by all),
ac as materialized (select image_id, row, m.i as col, sum(value * w) as value from px p join rm m on m.j = p.col group by all)""",
    "select image_id, cast(m.i as int) as row, cast(col as int) as col, round(sum(value * w), 6) as value from ac p join rm m on m.j = p.row group by image_id, m.i, col",
)
def f1_reduced(spark: SparkSession, d: str) -> DataFrame:
    """The pixel vector: images at a quarter of their size."""
    return rounded(neighbourhoods.reduced(_green(spark, d), N, N), "value")


@query(
    MOSAIC
    + """, p0 as (select unnest(range(0, 16)) as p), p1 as (select p, round(-2 * sin(2 * pi() * p / 16), 5) as dr, round(2 * cos(2 * pi() * p / 16), 5) as dc from p0),
p2 as (select p, floor(dr)::int as a, floor(dc)::int as b, dr - floor(dr) as y, dc - floor(dc) as x from p1),
p3 as (select p, a + i as a, b + j as b, (case i when 0 then 1 - y else y end) * (case j when 0 then 1 - x else x end) as w from p2 cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)),
nb as (select q.image_id, q.row, q.col, p, round(sum(w * coalesce(n.value, 0)) - any_value(q.value), 9) >= 0 as bit from px q cross join p3 left join px n on n.image_id = q.image_id and n.row = q.row + a and n.col = q.col + b group by q.image_id, q.row, q.col, p),
st as (select image_id, row, col, bit, bit <> lag(bit) over (partition by image_id, row, col order by p) as flip from nb),
co as (select image_id, case when count_if(flip) <= 2 then count_if(bit) else 17 end as code from st group by image_id, row, col),
hi as (select image_id, cast(code as int) as bin, count(*) as n from co group by all)""",
    "select image_id, bin, round(n / sum(n) over (partition by image_id), 6) as density from hi",
)
def f2_binary_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.pattern_histogram(neighbourhoods.binary_patterns(_green(spark, d), N, N)), "density")


@query(
    MOSAIC
    + f""", k0 as (select unnest(range(-3, 4)) as r), k1 as (select r, unnest(range(-3, 4)) as c from k0), k2 as (select r, c, unnest(range(0, 8)) as o from k1), k3 as (select r, c, o, unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0]) as f from k2),
k4 as (select r, c, o, f, exp(-0.5e0 * (r * r + c * c)) / (2 * pi()) * cos(2 * pi() * f * (c * cos(o / 8e0 * pi()) + r * sin(o / 8e0 * pi()))) as w from k3),
nb as materialized (select q.image_id, q.row, q.col, r, c, n.value from px q cross join k1 join px n on n.image_id = q.image_id and n.row = (q.row + r + {N}) % {N} and n.col = (q.col + c + {N}) % {N}),
an as (select image_id, row, col, o, f, sum(value * w) as v from nb join k4 using (r, c) group by all),
mx as (select image_id, case when max(value) > 1 then 65025 else 1 end as s from px group by all)""",
    "select image_id, cast(o as int) as orientation, f as frequency, round(avg(v * v) / any_value(s), 6) as energy from an join mx using (image_id) group by image_id, o, f",
)
def f5_wave_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbourhoods.wave_energies(_green(spark, d), N, N), "energy")


@query(
    MOSAIC
    + """, gd as (select p.image_id, p.row, p.col, coalesce(rt.value - lf.value, 0) as gc, coalesce(dn.value - up.value, 0) as gr from px p
 left join px rt on rt.image_id = p.image_id and rt.row = p.row and rt.col = p.col + 1 left join px lf on lf.image_id = p.image_id and lf.row = p.row and lf.col = p.col - 1
 left join px dn on dn.image_id = p.image_id and dn.col = p.col and dn.row = p.row + 1 left join px up on up.image_id = p.image_id and up.col = p.col and up.row = p.row - 1),
tu as (select image_id, row // 32 as cell_row, col // 32 as cell_col, sqrt(gc * gc + gr * gr) as size, floor(round(fmod(degrees(atan2(gr, gc)) + 360, 180), 9) / 30)::int as bin from gd),
su as (select image_id, cell_row, cell_col, b as bin, coalesce(sum(size) filter (bin = b), 0) / 1024 as v from tu cross join (select unnest(range(0, 6)) as b) group by all),
n1 as (select *, least(0.2e0, v / sqrt(sum(v * v) over (partition by image_id, cell_row, cell_col) + 1e-10)) as v1 from su)""",
    "select image_id, cell_row::int as cell_row, cell_col::int as cell_col, bin::int as bin, round(v1 / sqrt(sum(v1 * v1) over (partition by image_id, cell_row, cell_col) + 1e-10), 6) as value from n1",
)
def f6_gradients(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbourhoods.oriented_gradients(_green(spark, d), N, N), "value")


def _circles(spark: SparkSession, d: str) -> DataFrame:
    """Two circles of every image, without a common centre; the outer one may leave the image."""
    ids = views.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image_id")).distinct()
    of = {"inner_x": 30 + F.col("image_id") % 4, "inner_y": F.lit(32), "inner_r": 6 + F.col("image_id") % 3, "outer_x": F.lit(32), "outer_y": F.lit(31), "outer_r": 28 + F.col("image_id") % 8}
    return ids.select("image_id", *[c.cast("double").alias(n) for n, c in of.items()])


@query(
    MOSAIC
    + """, ci as (select distinct image_id, 30e0 + image_id % 4 as ix, 32e0 as iy, 6e0 + image_id % 3 as ir, 32e0 as ox, 31e0 as oy, 28e0 + image_id % 8 as orr from px),
ro as (select *, unnest(range(0, 51)) as row from ci), pl as (select *, unnest(range(0, 180)) as col from ro),
xy as (select image_id, row, col, least(63, greatest(0, round((1 - row / 50e0) * (ix + ir * cos(col * 2 * pi() / 180)) + row / 50e0 * (ox + orr * cos(col * 2 * pi() / 180)), 9))) as x,
 least(63, greatest(0, round((1 - row / 50e0) * (iy + ir * sin(col * 2 * pi() / 180)) + row / 50e0 * (oy + orr * sin(col * 2 * pi() / 180)), 9))) as y from pl),
co as (select *, floor(x)::int as x0, floor(y)::int as y0, least(63, floor(x) + 1)::int as x1, least(63, floor(y) + 1)::int as y1 from xy)""",
    """select co.image_id, co.row::int as row, co.col::int as col, cast(floor(round((a.value * (1 - x + x0) + b.value * (x - x0)) * (1 - y + y0) + (c.value * (1 - x + x0) + d.value * (x - x0)) * (y - y0), 9)) as int) as value
from co join px a on a.image_id = co.image_id and a.row = y0 and a.col = x0 join px b on b.image_id = co.image_id and b.row = y0 and b.col = x1
join px c on c.image_id = co.image_id and c.row = y1 and c.col = x0 join px d on d.image_id = co.image_id and d.row = y1 and d.col = x1""",
)
def g4_unrolled(spark: SparkSession, d: str) -> DataFrame:
    """Rings between two circles as strips of 51 x 180."""
    return neighbourhoods.unrolled(_green(spark, d), _circles(spark, d), N, N, 51, 180)
