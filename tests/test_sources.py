import pathlib

import pytest
from pyspark.sql import functions as F

from choicelab.sources import readers, writers
from choicelab.staging import scratch_path, stage


@pytest.fixture()
def folder(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    put("sub-001/beh.tsv", "participant\tmoneystim\tchoice_resp.rt\nsub-001\tm1\t0.5\nsub-001\tm2\t\n")
    put("sub-002/beh.tsv", "choice_resp.rt\textra\tparticipant\tmoneystim\n0.7\tq\tsub-002\tm3\n")
    put("sub-004/beh.tsv", "participant\tmoneystim\nsub-004\tm5\n")
    put("r0/diagnostics/DIC.txt", "DIC: 120.5\n")
    put("r1/diagnostics/DIC.txt", "DIC: 99.25\nDIC: 1.0\n")
    put("r2/diagnostics/DIC.txt", "DIC: none\n")
    put("r3/diagnostics/other.txt", "DIC: 1.0\n")
    put("channels.tsv", "recording\tname\tstatus\na\tFz\tgood\na\tCz\tbad\na\tAz\tbad\nb\tFz\tgood\n")
    return tmp_path


def test_subject_tables_match_columns_by_name(spark, folder):
    cols = ["participant", "moneystim", "choice_resp.rt"]
    df = readers.read_subject_tables(spark, f"{folder}/sub-*/beh.tsv", cols, subject_in_path=r"(sub-\d+)/", subject="id")
    assert df.columns == [*cols, "id"]
    assert sorted(map(tuple, df.collect())) == [
        ("sub-001", "m1", "0.5", "sub-001"), ("sub-001", "m2", None, "sub-001"),
        ("sub-002", "m3", "0.7", "sub-002"), ("sub-004", "m5", None, "sub-004")]


def test_missing_subject(spark, folder):
    args = (spark, f"{folder}/sub-*/beh.tsv", ["moneystim"])
    kw = {"subject_in_path": r"(sub-\d+)/", "expected": ["sub-001", "sub-003"]}
    assert readers.read_subject_tables(*args, **kw).count() == 4
    with pytest.raises(FileNotFoundError, match="sub-003"):
        readers.read_subject_tables(*args, **kw, missing="stop")


def test_kv_text(spark, folder):
    got = readers.scan_kv_text(spark, f"{folder}/r*/diagnostics/DIC.txt", "DIC", r"/(r\d+)/diagnostics")
    assert {r["model"]: r["value"] for r in got.collect()} == {"r0": 120.5, "r1": 99.25, "r2": None}


def test_channel_table(spark, folder):
    got = readers.channel_table(readers.read_delimited(spark, f"{folder}/channels.tsv", sep="\t"))
    assert {r["recording"]: (list(r["bads"]), r["n_bad"]) for r in got.collect()} == {"a": (["Az", "Cz"], 2), "b": ([], 0)}


def test_kv_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a:C(f)[x]", 1.25), ("b", -3.0)], "name string, value double")
    writers.write_kv_text(df, f"{tmp_path}/kv", "name", "value")
    assert sorted(map(tuple, readers.read_kv_lines(spark, f"{tmp_path}/kv").collect())) == [("a:C(f)[x]", 1.25), ("b", -3.0)]


def test_partitioned_write(spark, tmp_path):
    df = spark.range(1000).withColumn("p", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7))
    writers.write_table(df, f"{tmp_path}/t", partition_by=["p"])
    assert spark.read.parquet(f"{tmp_path}/t").groupBy("p").count().count() == 7
    assert len(list(pathlib.Path(f"{tmp_path}/t/p=3").glob("*.parquet"))) == 1


def test_stage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, `a.b` string")
    kept = stage(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and sorted(kept.collect()) == sorted(df.collect())
    assert stage(df.limit(0)).count() == 0
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_one_header_is_read_by_pattern(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / "t.csv").write_text(f"a;b\n{i};x\n")
    df = readers.read_subject_tables(spark, f"{tmp_path}/s*/t.csv", ["b", "a", "c"], ";", r"/s(\d)/")
    assert sorted(map(tuple, df.collect())) == [("x", str(i), None, str(i)) for i in range(3)]


def test_row_operators_on_a_stream(spark, tmp_path):
    """Condition codes and parsing need no state, so they run on a stream unchanged."""
    from choicelab.functions.columns import to_number
    from choicelab.operators import shaping

    spark.createDataFrame([("3", 2), ("x", 1)], "moneylevel string, painlevel int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("moneylevel string, painlevel int").parquet(f"{tmp_path}/in")
    coded = shaping.add_conditions(stream.withColumn("moneylevel", to_number(F.col("moneylevel"))))
    run = coded.writeStream.format("memory").queryName("coded_trials").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert sorted((r["painlevel"], r["acceptance_pair"]) for r in spark.table("coded_trials").collect()) == [(1, None), (2, "M")]


def test_quoted_header_and_several_headers(spark, tmp_path):
    for name, text in (("1", 'a,"b,x",c\n1,2,3\n'), ("2", "c,a\n6,4\n"), ("3", 'a,"b,x",c\n7,8,9\n')):
        (tmp_path / f"sub-{name}.csv").write_text(text)
    got = readers.read_subject_tables(spark, str(tmp_path / "sub-*.csv"), ["a", "b,x", "c"], sep=",")
    assert sorted(map(tuple, got.collect())) == [("1", "2", "3"), ("4", None, "6"), ("7", "8", "9")]


def test_many_small_groups_are_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    df = spark.range(0, 640, numPartitions=4).withColumn("p", F.col("id") % 64)
    writers.write_table(df, f"{tmp_path}/t", "csv", partition_by=["p"])
    files = list(pathlib.Path(f"{tmp_path}/t").glob("p=*/*.csv"))
    assert len(files) == 64
    assert len({f.name.split("-")[1] for f in files}) > 4
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == before


def test_files_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / "t.csv").write_text(f"n\n{i}\n")
    context, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    context.setJobGroup("listing", "listing")
    try:
        lists = readers.events_for_subject(spark, f"{tmp_path}/s*/t.csv", r"/s(\d+)/", "n bigint")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 8
    assert lists.filter("n = participant").count() == 60 and spark.conf.get(name) == before
