"""Runs are told once: when all their cases are there, or when no line came for a while."""

import json

from flipline.sources import readers as rd
from flipline.streaming import monitors as mo


def test_runs_end_by_total_or_pause(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def write(name, lines):
        (src / name).write_text("\n".join(json.dumps({"case_id": c, "timed_out": t, "progress_total": n}) for c, t, n in lines))

    def batch(idle_ms):
        stream = mo.finished_runs(mo.status_stream(spark, str(src)), idle_ms=idle_ms)
        sink = stream.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")))
        sink.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.run, r.completed, r.timed_out, r.progress_total, r.finished) for r in rows)

    write("whole.json", [("a", False, 3), ("b", True, 3), ("b", False, 3), (" ", True, 3), ("c", None, 3), ("a", True, 3)])
    write("broken.json", [("a", True, 5), ("b", False, None), (None, True, 5)])
    whole, broken = ("whole.json", 3, 1, 3, True), ("broken.json", 2, 1, 5, False)
    assert batch(1) == [whole]
    write("other.json", [("x", False, 1)])
    assert batch(3_600_000) == sorted([whole, broken, ("other.json", 1, 0, 1, True)])
    write("late.json", [("x", False, 2)])
    assert batch(3_600_000) == sorted([whole, broken, ("other.json", 1, 0, 1, True)])


def test_snapshot_folders(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "a"))
    spark.range(20).repartition(4).write.parquet(str(tmp_path / "b"))
    newest = rd.latest_snapshot(spark, f"{tmp_path}/*/*.parquet", folders=True)
    assert newest.endswith("/b") and spark.read.parquet(newest).count() == 20
