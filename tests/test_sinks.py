import glob

from pyspark.sql import functions as F

from shelfwise.operators import dims
from shelfwise.sinks import tables
from shelfwise.sinks.tables import KeyedTable, append, dimension, export_csv, insert_ignore, publish_dim, read_dim
from shelfwise.sources.tables import read_lookback, read_table

DDL = "k string;v bigint;at bigint"


def current(table, spark):
    return sorted(map(tuple, table.read(spark).select("k", "v").collect()))


def test_upsert_is_order_independent_and_repeatable(spark, frame, folder):
    one = frame([("a", 1, 1), ("b", 1, 5), ("a", 2, 2)], DDL)
    two = frame([("a", 9, 1), ("b", 3, 6), ("c", 4, 1)], DDL)
    want = [("a", 2), ("b", 3), ("c", 4)]
    left, right = (KeyedTable(f"{folder}/{n}", ["k"], ["at", "v"]) for n in ("l", "r"))
    assert not left.exists(spark)
    for table, batches in ((left, (one, two)), (right, (two, one))):
        for i, b in enumerate(batches):
            table.upsert(b, i)
            table.upsert(b, i)
    assert current(left, spark) == want == current(right, spark)
    left.compact(spark, upto=1)
    assert current(left, spark) == want
    left.upsert(frame([("c", 8, 2)], DDL), 2)
    assert current(left, spark) == [("a", 2), ("b", 3), ("c", 8)]
    left.compact(spark, upto=2)
    assert current(left, spark) == [("a", 2), ("b", 3), ("c", 8)]


def test_two_writers_with_equal_batch_ids(spark, frame, folder):
    table = KeyedTable(f"{folder}/t", ["k"], ["at", "v"])
    table.upsert(frame([("a", 1, 1)], DDL), 0, writer="trends")
    table.upsert(frame([("b", 2, 1)], DDL), 0, writer="signals")
    assert current(table, spark) == [("a", 1), ("b", 2)]


def test_compaction_keeps_to_its_bound(spark, frame, folder):
    table = KeyedTable(f"{folder}/t", ["k"], ["at", "v"])
    for i, rows in enumerate(([("a", 1, 1)], [("b", 2, 1)], [("c", 3, 1)])):
        table.upsert(frame(rows, DDL), i)
    table.compact(spark, upto=1)
    table.upsert(frame([("d", 4, 1)], DDL), 2)  # batch 2 runs again with other rows
    assert current(table, spark) == [("a", 1), ("b", 2), ("d", 4)]
    table.upsert(frame([("e", 9, 9)], DDL), 1)  # a replay of what the base holds
    assert current(table, spark) == [("a", 1), ("b", 2), ("d", 4)]


def test_slower_writer_is_read_after_a_compaction(spark, frame, folder):
    table = KeyedTable(f"{folder}/t", ["k"], ["at", "v"])
    table.upsert(frame([("a", 1, 1)], DDL), 500, writer="fast")
    table.upsert(frame([("b", 2, 1)], DDL), 3, writer="slow")
    table.compact(spark, upto=500)
    table.upsert(frame([("c", 3, 1)], DDL), 4, writer="slow")
    table.upsert(frame([("d", 4, 1)], DDL), 2, writer="slow")  # committed after batch 3, which the base holds
    table.upsert(frame([("e", 5, 1)], DDL), 500, writer="late")
    want = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]
    assert current(table, spark) == want
    table.compact(spark, upto=4)  # a lower bound than before
    assert current(table, spark) == want
    table.compact(spark, upto=500)
    table.upsert(frame([("z", 9, 9)], DDL), 3, writer="slow")  # a replay of what the base holds
    assert current(table, spark) == want


def test_unfinished_batch_is_not_read(spark, frame, folder):
    table = KeyedTable(f"{folder}/t", ["k"], ["at", "v"])
    table.upsert(frame([("a", 1, 1)], DDL), 0)
    frame([("b", 2, 1)], DDL).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/t/log/writer=main/batch=1")
    assert current(table, spark) == [("a", 1)]


def test_insert_ignore_and_append(spark, frame, folder):
    path = f"{folder}/t"
    insert_ignore(frame([("a", 1, 1), ("b", 1, 1)], DDL), path, ["k"])
    insert_ignore(frame([("a", 2, 1), ("c", 2, 1)], DDL), path, ["k"])
    assert sorted(map(tuple, read_table(spark, path).select("k", "v").collect())) == [("a", 1), ("b", 1), ("c", 2)]
    log = f"{folder}/log"
    for _ in range(2):
        append(frame([("a", 1, 1)], DDL), log, batch_id=0)
    append(frame([("a", 1, 1)], DDL), log, batch_id=1)
    assert spark.read.parquet(log).count() == 2


def test_dimension_honours_deletes(spark, frame, folder):
    rows = frame([("r", "2024-01-01 00:00:00", "a", 1), ("r", "2024-01-01 00:00:00", "b", 1)], "op string;op_ts timestamp;k string;v bigint")
    shape = lambda df: df.select("op", "op_ts", F.struct("k", "v").alias("before"), F.when(F.col("op") != "d", F.struct("k", "v")).alias("after"))
    table = dimension(f"{folder}/dim", ["k"])
    publish_dim(dims.latest_changes(shape(rows), ["k"]), table, 0)
    later = frame([("d", "2024-01-02 00:00:00", "a", 1), ("u", "2023-12-01 00:00:00", "b", 9)], "op string;op_ts timestamp;k string;v bigint")
    publish_dim(dims.latest_changes(shape(later), ["k"]), table, 1)
    assert [(r["k"], r["v"]) for r in read_dim(spark, table).collect()] == [("b", 1)]


def test_csv_export(spark, frame, folder):
    export_csv(frame([("a", 1, 1)], DDL), f"{folder}/csv")
    texts = [open(f).read().splitlines() for f in glob.glob(f"{folder}/csv/*.csv")]
    assert all(t[0] == "k,v,at" for t in texts if t)
    assert [line for t in texts for line in t[1:]] == ["a,1,1"]


def test_range_reaches_the_scan(spark, frame, folder):
    df = frame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-03 00:00:00")], "k string;at timestamp")
    df.write.parquet(f"{folder}/p")
    got = read_table(spark, f"{folder}/p", time_column="at", since="2024-01-02 00:00:00", until="2024-01-03 00:00:00")
    assert [r["k"] for r in got.collect()] == ["b"]
    assert "GreaterThan(at" in got._jdf.queryExecution().toString()


def test_first_row_of_a_key_stays(spark, folder):
    """Two writers and a replay, before and after a compaction: each key once, the first by order."""
    from shelfwise.sinks.tables import insert_table

    table = insert_table(f"{folder}/once", ["k"], ["at", "v"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at bigint, v string")
    table.upsert(rows(("a", 5, "x"), ("b", 1, "y"), ("a", 7, "z")), 0, "one")
    table.upsert(rows(("a", 3, "other"), ("c", 9, "w")), 0, "two")
    want = {"a": "other", "b": "y", "c": "w"}
    assert {r["k"]: r["v"] for r in table.read(spark).collect()} == want and table.read(spark).count() == 3
    table.compact(spark, upto=0)
    table.upsert(rows(("a", 5, "x"), ("b", 1, "y"), ("a", 7, "z")), 0, "one")
    table.upsert(rows(("b", 2, "late")), 1, "two")
    assert {r["k"]: r["v"] for r in table.read(spark).collect()} == want


def test_two_day_report_opens_two_of_thirty_days(spark, folder):
    hours = spark.range(30 * 24).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("at"),
        F.col("id").alias("n"), F.lit(9).alias("stored"),
    )
    path = f"{folder}/t"
    tables.append_by_day(hours.filter("n < 500"), path, "at", 0)
    tables.append_by_day(hours.filter("n >= 500"), path, "at", 1)
    tables.append_by_day(hours.filter("n >= 500"), path, "at", 1)  # a replay
    recent = read_lookback(spark, path, "at", "2024-01-30 12:00:00", days=2)
    assert sorted(r["n"] for r in recent.collect()) == list(range(27 * 24 + 12, 720))
    assert recent.columns == ["at", "n", "stored"]
    scan = recent._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 3  # one file for each of the 28th, 29th and 30th
    assert spark.read.parquet(path).count() == 720


def test_lookback_of_rows_without_time(spark, folder):
    rows = spark.createDataFrame([(1, None), (2, "2024-01-02 00:00:00")], "n int, at string").withColumn("at", F.col("at").cast("timestamp"))
    tables.append_by_day(rows, folder + "/t", "at", 0)
    assert [r["n"] for r in read_lookback(spark, folder + "/t", "at", "2024-01-03 00:00:00", days=5).collect()] == [2]
