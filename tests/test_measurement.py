"""The format of measurement sets: what it reads, leaves out and refuses."""

import math

import pytest
from fringeworks.sources import measurement, vis_of, write_vis
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sets"))
    vis = vis_of(spark, SF)
    write_vis(vis.filter("scan < 3").repartition("field_id", "ddid", "scan"), f"{path}/early")
    write_vis(vis.filter("scan >= 3").drop("sigma").repartition("field_id", "ddid", "scan"), f"{path}/late")
    measurement.register(spark)
    return path


def pieces(spark, path, *filters, size=measurement.BYTES):
    """The input partitions after filters, and the filters that Spark keeps."""
    source = measurement.MeasurementSets({"path": path})
    reader = source.reader(source.schema())
    reader.size = size
    left = list(reader.pushFilters(list(filters)))
    return reader, reader.partitions(), left


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_of_several_sets(spark, folder):
    """Columns that a set lacks are null; the name of the set comes along; every row once, however small the partitions."""
    want = vis_of(spark, SF).withColumn("ms", F.when(F.col("scan") < 3, "early").otherwise("late")).withColumn("sigma", F.when(F.col("scan") < 3, F.col("sigma")))
    for size in ("1000", "100000000"):
        got = spark.read.format("visibilities").option("bytes", size).load(f"{folder}/*")
        assert ordered(got.select(*want.columns)) == ordered(want)
    assert ordered(measurement.scan_sets(spark, f"{folder}/late", ["scan"]).groupBy("scan").count()) == ordered(want.filter("scan >= 3").groupBy("scan").count())
    assert spark.read.format("visibilities").load(f"{folder}/l*").select("ms").distinct().collect()[0].ms == "late"


def test_filters_on_folders_reach_the_list_of_files(spark, folder):
    _, every, _ = pieces(spark, f"{folder}/*")
    filters = [measurement.In(("field_id",), (1, 3)), measurement.EqualTo(("ddid",), 1), measurement.IsNotNull(("scan",))]
    _, some, left = pieces(spark, f"{folder}/*", *filters)
    keys = {p.keys for x in some for p in x.pieces}
    assert not left and keys == {p.keys for x in every for p in x.pieces if p.keys[0] in (1, 3) and p.keys[1] == 1}
    df = spark.read.format("visibilities").load(f"{folder}/*").filter("field_id in (1, 3) and ddid = 1 and re > 0")
    assert "field_id" not in str(df._jdf.queryExecution().executedPlan()).split("Filter", 1)[1].split("\n", 1)[0]
    assert ordered(df.select("row_id")) == ordered(vis_of(spark, SF).filter("field_id in (1, 3) and ddid = 1 and re > 0").select("row_id"))


def test_row_groups_are_passed_over_by_their_statistics(spark, folder):
    above = measurement.GreaterThan(("chan",), 1000)
    reader, parts, left = pieces(spark, f"{folder}/early", above)
    assert left == [above] and parts and not [b for p in parts for b in reader.read(p)]
    reader, parts, _ = pieces(spark, f"{folder}/early", measurement.LessThan(("freq",), 1e12))
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == vis_of(spark, SF).filter("scan < 3").count()


def test_numbers_that_are_none_stay(spark, tmp_path):
    """NaN is above every number for Spark, and in no statistics."""
    rows = [(i, 0, 0, 0, math.nan if i % 2 else 1.0) for i in range(10)]
    write_vis(spark.createDataFrame(rows, "row_id long, field_id int, ddid int, scan int, re double"), f"{tmp_path}/odd")
    sets = measurement.scan_sets(spark, f"{tmp_path}/odd")
    assert sets.filter("re > 5").count() == 5 and sets.filter("re < 5").count() == 5 and sets.filter("re = double('NaN')").count() == 5


def test_folders_without_a_value(spark, tmp_path):
    rows = [(0, 1, 0, None), (1, None, 0, 2)]
    write_vis(spark.createDataFrame(rows, "row_id long, field_id int, ddid int, scan int"), f"{tmp_path}/nulls")
    sets = measurement.scan_sets(spark, f"{tmp_path}/nulls")
    assert ordered(sets.select("row_id", "field_id", "ddid", "scan")) == sorted(rows, key=repr)
    assert sets.filter("scan is null").count() == 1 and sets.filter("scan < 5").count() == 1


@pytest.mark.parametrize(("options", "reason"), [({"colums": "u"}, "no such options: colums"), ({"columns": "u,none"}, "no columns none"), ({"bytes": "-1"}, "no positive number")])
def test_options_are_checked(spark, folder, options, reason):
    with pytest.raises(Exception, match=reason):
        spark.read.format("visibilities").options(**options).load(f"{folder}/early").count()


def test_writing_over_a_set_is_refused(spark, folder):
    vis = vis_of(spark, SF).filter("scan < 3")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_vis(vis, f"{folder}/early")
    with pytest.raises(Exception, match="no measurement set"):
        spark.read.format("visibilities").load(f"{folder}/none*").count()
