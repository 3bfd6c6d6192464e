"""The data source of runs: only commits are read, filters open no other run's files, and streams go on where they ended."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from trackmill.sources import runs

SCHEMA = "run_id string, k long, v double, name string, tags array<string>"


@pytest.fixture
def rows(spark):
    own = [(f"r {i % 4}/ä", i, math.nan if i == 3 else i / 7, None if i % 5 == 0 else f"n{i}\n\"é", ["a", None] if i % 2 else None) for i in range(40)]
    return spark.createDataFrame(own, SCHEMA)


def plain(df):
    return sorted((r.run_id, r.k, r.v, r.name, r.tags) for r in df.select("run_id", "k", "v", "name", "tags").collect())


def test_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "runs")
    runs.write_runs(rows.where("k < 20"), path)
    runs.write_runs(rows.where("k >= 20").repartition(3), path)
    back = spark.read.format(runs.NAME).schema(SCHEMA).load(path)
    want = rows.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    assert plain(back) == plain(want)
    narrow = spark.read.format(runs.NAME).schema("k long, more string").load(path)
    assert sorted(r.k for r in narrow.collect()) == list(range(40)) and {r.more for r in narrow.collect()} == {None}
    line = json.loads(open(f"{path}/{runs.commits(path)[0][0]['file']}").readline())
    assert list(line) == ["k", "name", "tags", "v"]
    assert {r.run_id for r in runs.manifest(spark, path).collect()} == {f"r {i}/ä" for i in range(4)} and sum(r.rows for r in runs.manifest(spark, path).collect()) == 40


def test_filters_open_only_their_runs(spark, rows, tmp_path):
    path = str(tmp_path / "runs")
    runs.write_runs(rows, path)
    back = spark.read.format(runs.NAME).schema(SCHEMA).load(path)
    own = back.where("run_id = 'r 1/ä' AND k > 5")
    assert plain(own) == plain(rows.where("run_id = 'r 1/ä' AND k > 5"))
    for f in runs.commits(path)[0]:
        if "1" not in f["run"]:
            os.remove(f"{path}/{f['file']}")
    assert own.count() == len(plain(rows.where("run_id = 'r 1/ä' AND k > 5")))  # the others are not even there
    reader = runs.RunReader(path, back.schema)
    assert list(reader.pushFilters([runs.EqualTo(("run_id",), "r 1/ä"), runs.EqualTo(("k",), 3)])) == [runs.EqualTo(("k",), 3)]
    assert {p.run for p in reader.partitions()} == {"r%201%2F%C3%A4"}


def test_what_no_commit_lists_is_not_read(spark, rows, tmp_path):
    path = str(tmp_path / "runs")
    runs.write_runs(rows.where("k < 10"), path)
    broken = rows.where("k >= 10").repartition(4).withColumn("name", F.when(F.col("k") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        runs.write_runs(broken, path)
    writer = runs.RunWriter(path)
    import pyarrow as pa

    stored = writer.write(iter([pa.RecordBatch.from_pydict({"run_id": ["x"], "line": ['{"k": 99}']})]))
    back = spark.read.format(runs.NAME).schema(SCHEMA).load(path)
    assert sorted(r.k for r in back.collect()) == list(range(10))
    writer.abort([stored, None])
    assert os.listdir(f"{path}/x") == []


def test_a_stream_goes_on_after_its_last_commit(spark, rows, tmp_path):
    path, seen = str(tmp_path / "runs"), []
    for low in (0, 10, 20, 30):
        runs.write_runs(rows.where(F.col("k").between(low, low + 9)), path)
        if low in (10, 30):
            source = spark.readStream.format(runs.NAME).schema("k long, run_id string").load(path)
            source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
            seen.append(sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen == [list(range(20)), list(range(40))]


def test_folders_of_others_are_read_by_their_files(spark, tmp_path):
    for run, text in (("a", '{"k": 1, "other": 2}\n\n{"k": 2, "v": 0.5}\n'), ("b", '{"k": 3}'), ("c", "")):
        os.makedirs(tmp_path / "in" / run)
        (tmp_path / "in" / run / "rows.jsonl").write_text(text)
    runs.register(spark)
    back = spark.read.format(runs.NAME).schema("run_id string, k long, v double").load(str(tmp_path / "in"))
    assert sorted(map(tuple, back.collect())) == [("a", 1, None), ("a", 2, 0.5), ("b", 3, None)]
    with pytest.raises(Exception, match="append"):
        back.selectExpr("run_id", "'' AS line").write.format(runs.NAME).mode("overwrite").save(str(tmp_path / "in"))
