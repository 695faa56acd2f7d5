"""Streams with timers, and late data, over several micro-batches and a restart."""


from pyspark.sql import functions as F

from driftline.streaming import stateful, timers

SAYS = "session_id long, at long, place long, says string"


def feed(spark, folder, n, rows):
    """Write one file of rows, the ``n``-th."""
    spark.createDataFrame(rows, SAYS).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, transform):
    stream = spark.readStream.schema(SAYS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with timers.timers_allowed(spark):
        return sorted(map(tuple, stateful.drained(transform(stream), folder).collect()))


def test_alarms_without_a_row(spark, tmp_path):
    folder = str(tmp_path)
    alarms = lambda s: timers.quiet_alarms(s, 100)
    feed(spark, f"{folder}/in", 0, [(1, 1000, 0, "START"), (2, 1000, 0, "START"), (3, 1010, 0, "RESET"), (4, 1000, 0, "START"), (4, 1049, 0, "RESET")])
    assert drain(spark, folder, alarms) == []
    # time passes by another session's rows alone; a stop and a reset before the time hold the alarm back
    feed(spark, f"{folder}/in", 1, [(2, 1060, 0, "STOP"), (4, 1100, 0, "RESET"), (9, 1150, 0, "NONE")])
    assert drain(spark, folder, alarms) == [(1, 1000, 1100)]
    # a second run begins where the first one ended; an alarm comes once for each reset
    feed(spark, f"{folder}/in", 2, [(1, 1160, 0, "RESET"), (4, 1199, 0, "RESET"), (4, 1299, 1, "STOP"), (9, 2000, 0, "NONE")])
    assert drain(spark, folder, alarms) == [(1, 1000, 1100), (1, 1160, 1260), (4, 1199, 1299)]
    feed(spark, f"{folder}/in", 3, [(9, 9000, 0, "NONE")])
    assert len(drain(spark, folder, alarms)) == 3


def test_heartbeats_go_on(spark, tmp_path):
    folder = str(tmp_path)
    beats = lambda s: timers.heartbeats(s, 60)
    feed(spark, f"{folder}/in", 0, [(1, 1000, 0, "START"), (2, 1000, 0, "NONE")])
    feed(spark, f"{folder}/in", 1, [(2, 1185, 0, "NONE"), (1, 1010, 0, "RESET")])
    assert drain(spark, folder, beats) == [(1, 1000, 1060), (1, 1000, 1120), (1, 1000, 1180)]
    feed(spark, f"{folder}/in", 2, [(1, 1245, 0, "STOP"), (2, 5000, 0, "NONE")])
    assert drain(spark, folder, beats)[3:] == [(1, 1000, 1240)]


def test_late_rows_touch_their_keys_alone(spark, tmp_path):
    rows, results = str(tmp_path / "rows"), str(tmp_path / "results")
    write = timers.recomputed(results, rows, ["session_id"], lambda df: df.groupBy("session_id").agg(F.sum("at").alias("total")))
    batch = lambda *them: spark.createDataFrame(them, "session_id long, at long")
    write(batch((1, 10), (2, 20)), 0)
    write(batch((1, 5)), 1)
    write(batch((1, 5)), 1)  # a repeated batch
    assert sorted(map(tuple, timers.latest_results(spark, results, ["session_id"]).select("session_id", "total").collect())) == [(1, 15), (2, 20)]
    assert spark.read.parquet(f"{results}/version=1").count() == 1
