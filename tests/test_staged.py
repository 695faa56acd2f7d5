"""Staged jobs stop anywhere and go on; counters come from the pass that writes."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import staged


def job(spark, folder, calls, version="v1", fails=None):
    def stage(name):
        def run(made):
            calls.append(name)
            if name == fails:
                raise RuntimeError(name)
            return spark.range(4) if not made else list(made.values())[-1].withColumn("id", F.col("id") + 1)

        return run

    return staged.StagedJob(spark, folder, version, [(n, stage(n)) for n in "ABCD"], {"B": {"odd": F.count(F.when(F.col("id") % 2 == 1, 1))}})


@pytest.mark.parametrize("stop", "ABCD")
def test_stopped_jobs_go_on(spark, tmp_path, stop):
    folder, calls = str(tmp_path), []
    job(spark, folder, calls).run(until=stop)
    assert staged.published(spark, folder, "D") is None
    made = job(spark, folder, calls).run()
    assert calls == list("ABCD") and sorted(r["id"] for r in made["D"].collect()) == [3, 4, 5, 6]
    assert sorted(r["id"] for r in staged.published(spark, folder, "D").collect()) == [3, 4, 5, 6]
    assert job(spark, folder, calls).records() == {n: {"rows": 4} | ({"odd": 2} if n == "B" else {}) for n in "ABCD"}


def test_failed_stage_is_made_again_and_versions_are_apart(spark, tmp_path):
    folder, calls = str(tmp_path), []
    with pytest.raises(RuntimeError):
        job(spark, folder, calls, fails="C").run()
    (tmp_path / "v1" / "C").mkdir()
    (tmp_path / "v1" / "C" / "part-left.parquet").write_bytes(b"half a file")
    job(spark, folder, calls).run()
    assert calls == list("ABC") + list("CD")
    with pytest.raises(RuntimeError):
        job(spark, folder, [], version="v2", fails="D").run()
    assert (tmp_path / "PUBLISHED").read_text() == "v1"
    job(spark, folder, [], version="v2").run()
    assert (tmp_path / "PUBLISHED").read_text() == "v2"


def test_counters_scan_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(seen, "id long")
    assert staged.counted(df, str(tmp_path / "out"), {"n": F.count("*"), "top": F.max("id")}) == {"n": 1000, "top": 999}
    assert reads.value == 1000
