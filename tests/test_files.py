import time

import pytest
from pyspark.sql import functions as F

from stratalens.sources import files


def held(folder):
    return {p.name: p.read_text(encoding="utf-8") for p in folder.iterdir()} if folder.exists() else {}


def test_files_have_their_names(spark, tmp_path):
    rows = spark.createDataFrame([("a b=c%.json", "1"), ("é.json", "ü\n"), ("empty.json", "")], "n string, v string").repartition(2)
    out = files.write_files(rows, str(tmp_path / "new" / "out"), "n", "v")
    assert held(tmp_path / "new" / "out") == {"a b=c%.json": "1", "é.json": "ü\n", "empty.json": ""}
    assert len(out) == 3 and out[0].endswith("out/a b=c%.json") and [p.rsplit("/", 1)[1] for p in out] == ["a b=c%.json", "empty.json", "é.json"]
    files.write_files(rows.withColumn("v", F.lit("2")), str(tmp_path / "new" / "out"), "n", "v")
    assert set(held(tmp_path / "new" / "out").values()) == {"2"}
    assert len(files.write_files(rows.limit(0), str(tmp_path / "none"), "n", "v")) == 0


def test_abort_leaves_no_new_file(spark, tmp_path):
    (tmp_path / "f5").write_text("before")
    value = F.when(F.col("id") == 950, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("x"))
    rows = spark.range(0, 1000, numPartitions=3).select(F.concat(F.lit("f"), "id").alias("n"), value.alias("v"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(rows, str(tmp_path), "n", "v")
    for _ in range(100):  # tasks that were still running when the job failed
        if set(held(tmp_path)) == {"f5"}:
            break
        time.sleep(0.2)
    assert set(held(tmp_path)) == {"f5"}


def test_many_files_leave_nothing_to_the_driver(spark, tmp_path):
    rows = spark.range(0, 3000, numPartitions=4).select(F.concat(F.lit("d"), "id", F.lit(".json")).alias("n"), F.lit("{}").alias("v"))
    assert len(files.write_files(rows, str(tmp_path), "n", "v")) == 3000
    assert len(list(tmp_path.iterdir())) == 3000 and files.Written(3).files == 3
