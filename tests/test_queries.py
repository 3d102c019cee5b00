"""Every query of the library against its SQL on a small scale."""

import math

import duckdb
import pytest

from stripcohort.jobs import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(shown(row[i]) for i in at) for row in result.fetchall())


def test_label_conflict_is_found(spark):
    from stripcohort.operators.audit import label_conflicts

    rows = spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, 0, "b"), (4, 0, "b")], "id long, label int, sha string")
    assert [tuple(r) for r in label_conflicts(rows).collect()] == [("a", 0, 1, 1, 2)]


def test_auc_of_one_class_is_null(spark):
    from stripcohort.operators.metrics import auc

    rows = spark.createDataFrame([("k", True, 0.5), ("k", True, 0.7)], "k string, y boolean, score double")
    assert auc(rows, ["k"]).first()["auc"] is None


def test_transformed_images_are_not_copies(spark):
    from stripcohort.operators import photometric

    gray = [10, 10, 20, 30, 30, 30, 40, 90]
    rows = [(1, 0, i, v, v, v) for i, v in enumerate(gray)]
    out = photometric.transformed(photometric.channels(spark.createDataFrame(rows, "image_id long, row int, col int, b int, g int, r int")), 1, 8)
    got = {n: [r["value"] for r in out.filter(f"representation = '{n}'").orderBy("col").collect()] for n in photometric.REPRESENTATIONS}
    assert got["original"] == gray
    assert got["histogram"] == [0, 0, 42, 170, 170, 170, 212, 255]
    assert {n for n, v in got.items() if v} == set(photometric.TRANSFORMS)  # a transform that isn't built has no rows


def test_high_half_holds_every_other_layout(spark):
    from stripcohort.jobs import cohort

    rows = spark.createDataFrame([("src3",), ("src12",), ("src20",), ("host",)], "layout string")
    assert {r[0] for r in cohort._half(rows, True).collect()} == {"src3"}
    assert {r[0] for r in cohort._half(rows, False).collect()} == {"src12", "src20", "host"}
