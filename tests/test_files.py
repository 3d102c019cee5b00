from stripcohort.sources import files


def test_class_folders_are_read_once(spark, tmp_path):
    for name, data in {"control/a.JPG": b"\xff\xd8\xff\xe0", "DM2/b.png": b"broken", "other/c.png": b"\x89PNG", "control/d.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    read = files.with_status(files.image_files(spark, str(tmp_path)))
    mapping = spark.createDataFrame([("a.JPG", "p1")], "file string, subject string")
    rows = files.with_mapping(read, mapping).select("file", "label", "readable", "subject").collect()
    assert sorted(map(tuple, rows), key=str) == [("a.JPG", 0, True, "p1"), ("b.png", 1, False, None)]


def test_tables_with_other_columns_unite(spark):
    out = files.united([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "b int, c int")])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2, None), (None, 3, 4)]


def test_written_tables_come_back(spark, tmp_path):
    rings = spark.createDataFrame([("f", 1, 0.5)], "file string, label int, pupil_iris_ratio double")
    files.write_geometry(rings, f"{tmp_path}/g")
    back = spark.read.csv(f"{tmp_path}/g", header=True)
    assert back.columns == files.GEOMETRY and back.first()["pupil_iris_ratio"] == "0.5" and back.first()["quality"] is None
    strips = spark.createDataFrame([(1, "x", 0, b"a"), (2, "x", 1, b"b"), (3, "y", 0, None)], "id long, layout string, label int, data binary")
    files.write_split(strips, f"{tmp_path}/s")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/s").filter("layout = 'x'").collect()) == [1, 2]
    files.write_series(strips, "id", ["label"], f"{tmp_path}/d")
    assert spark.read.csv(f"{tmp_path}/d", sep=" ", header=True).count() == 3


def test_regions_without_columns_and_constant_strips(spark):
    from stripcohort.operators import blocks

    image = spark.createDataFrame([(1, 0, c, 7) for c in range(4)] + [(2, 0, c, c) for c in range(4)], "image_id long, row int, col int, value int")
    regions = spark.createDataFrame([("none", 2, 2), ("half", 0, 2)], "region string, lo int, hi int")
    assert sorted((r["image_id"], r["region"], r["mean"]) for r in blocks.region_block(image, regions).collect()) == [(1, "half", 7.0), (2, "half", 0.5)]
    assert blocks.similarity(spark.createDataFrame([(1, 2)], "a long, b long"), image).first()["r"] is None


def test_near_pairs_leave_constant_and_null_vectors_out(spark):
    from stripcohort.operators import similar

    rows = [(1, [1.0, 2.0, 4.0]), (2, [2.0, 4.0, 8.0]), (3, [4.0, 2.0, 1.0]), (4, [1.0, 1.0, 1.0]), (5, None)]
    assert [(r["a"], r["b"]) for r in similar.near_pairs(spark.createDataFrame(rows, "id long, v array<double>")).collect()] == [(1, 2)]
