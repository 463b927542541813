import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from filmcrate.functions import labels, paths


def test_sizes_round_halves_to_even(spark):
    sizes = [1002.5, 1001.5, 0.5, 900.5, 1023.5, 1.25 * 1024, 1.35 * 1024, 1.25 * 1024**2, -1002.5]
    rows = spark.createDataFrame([(float(x),) for x in sizes], "n double").select(paths.human_size(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1002 B", "1002 B", "0 B", "900 B", "1024 B", "1.2 KB", "1.4 KB", "1.2 MB", "-1002 B"]


def test_special_folders_of_rows(spark):
    cases = [("/d", "/d/in"), ("/d/", ""), ("/d", None), ("/D", "/d/In/"), ("/d", "/dx"), ("/", "/in"), ("/", ""), ("/d", "/"), ("/d", "/e//"), ("/d", "/D"), ("/d", "/d/")]
    rows = spark.createDataFrame(cases, "root string, dest string").select("root", "dest", labels.special_folders_of(F.col("root"), F.col("dest")).alias("f")).collect()
    for r in rows:
        assert r["f"] == labels.special_folders(r["root"], r["dest"]), (r["root"], r["dest"])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_special_folders_come_from_a_table(spark, sf):
    found = entry.queries()["special_folders"](spark, f"/root/testdata/{sf}")
    assert any("customer.parquet" in f for f in found.inputFiles())
    assert found.select("id").distinct().count() == spark.read.parquet(f"/root/testdata/{sf}/customer.parquet").count()
