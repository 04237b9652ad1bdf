import gzip
from datetime import date

import pytest

from retentia.sources.tables import materialize, read_parts, read_table, register, scratch_path, write_table

DDL = "k bigint, d date, x double"


def frame(spark):
    return spark.createDataFrame([(i, date(2017, 1, 1 + i), i / 2) for i in range(9)], DDL)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    path = write_table(frame(spark), str(tmp_path / "t"), fmt=fmt)
    assert rows(read_table(spark, path, schema=DDL, fmt=fmt)) == rows(frame(spark))
    write_table(frame(spark).limit(2), path, fmt=fmt)
    assert read_table(spark, path, schema=DDL, fmt=fmt).count() == 2


def test_csv_inference_and_dates(spark, tmp_path):
    path = write_table(frame(spark), str(tmp_path / "t"), fmt="csv")
    assert dict(read_table(spark, path, fmt="csv").dtypes) == {"k": "int", "d": "date", "x": "double"}
    typed = read_table(spark, path, schema="k bigint, d string, x double", fmt="csv", dates=["d"])
    assert dict(typed.dtypes)["d"] == "date" and rows(typed) == rows(frame(spark))


def test_part_files_skip_markers(spark, tmp_path):
    path = write_table(frame(spark).repartition(3), str(tmp_path / "t"), fmt="csv")
    (tmp_path / "t" / "_NOTE").write_text("not,data\n1,2\n")
    (tmp_path / "t" / ".DS_Store").write_text("junk")
    assert read_table(spark, path, schema=DDL, fmt="csv").count() == 9


def test_several_paths(spark, tmp_path):
    a = write_table(frame(spark), str(tmp_path / "a"))
    b = write_table(frame(spark), str(tmp_path / "b"))
    assert read_table(spark, [a, b]).count() == 18


def test_limit_needs_an_order(spark, tmp_path):
    path = write_table(frame(spark), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        read_table(spark, path, limit=3)
    assert [r["k"] for r in read_table(spark, path, limit=3, order_by="k").collect()] == [0, 1, 2]


def test_register(spark):
    register(frame(spark), "frame_view")
    assert spark.sql("SELECT count(*) FROM frame_view").first()[0] == 9


def test_materialized_tables_go_to_the_shared_folder(spark):
    table = materialize(frame(spark))
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark).startswith(named)
    folder = named.split(":", 1)[-1].lstrip("/")
    assert folder in table.inputFiles()[0]
    assert rows(table) == rows(frame(spark))
    assert scratch_path(spark) != scratch_path(spark)


def test_parts_are_read_by_their_headers(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0.csv").write_text('k,d,x\n1,2017-01-01,0.5\n')
    (folder / "part-1.csv").write_text('x,k,d\n1.5,2,2017-01-02\nNaN,3,\n')
    (folder / "part-2.csv").write_text('d,"extra, quoted",k\n2017-01-04,"a,b",4\n')
    (folder / "part-3.csv").write_text("k,d,x\n")
    (folder / "part-4.csv").write_text("")
    (folder / "_SUCCESS").write_text("")
    (folder / ".DS_Store").write_text("not, a, table")
    with gzip.open(folder / "part-5.csv.gz", "wt") as packed:
        packed.write("k,x\n5,2.5\n")
    want = [(1, date(2017, 1, 1), 0.5), (2, date(2017, 1, 2), 1.5), (3, None, None), (4, date(2017, 1, 4), None), (5, None, 2.5)]
    got = read_parts(spark, str(folder), schema=DDL)
    assert got.columns == ["k", "d", "x"] and sorted(map(tuple, got.collect())) == want
    text = read_parts(spark, str(folder), schema="k bigint, d string, x double", dates=["d"])
    assert sorted(map(tuple, text.collect())) == want and dict(text.dtypes)["d"] == "date"
    inferred = read_parts(spark, [str(folder / "part-1.csv"), str(folder / "part-2.csv")])
    assert inferred.columns == ["x", "k", "d", "extra, quoted"] and inferred.count() == 3
    wider = read_parts(spark, str(folder / "part-0.csv"), schema=DDL + ", new int")
    assert [tuple(r) for r in wider.collect()] == [(1, date(2017, 1, 1), 0.5, None)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert read_parts(spark, str(empty), schema=DDL).count() == 0


def test_nan_in_text_becomes_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,x\n1,NaN\n2,0.5\n")
    assert rows(read_table(spark, str(tmp_path / "t.csv"), schema="k int, x double", fmt="csv").where("x IS NULL").select("k")) == [(1,)]
    path = write_table(spark.createDataFrame([(1, float("nan"))], "k int, x double"), str(tmp_path / "p"))
    assert read_table(spark, path).where("isnan(x)").count() == 1
    assert read_table(spark, path, nan_as_null=True).where("x IS NULL").count() == 1
