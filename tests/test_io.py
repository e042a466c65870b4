"""Scans, sinks and streams on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flipline.functions import failures as fl
from flipline.operators import cases as cs
from flipline.operators import judge as jg
from flipline.sources import readers as rd
from flipline.sources import writers as wr
from flipline.streaming import monitors as mo


def test_headers_and_missing_columns(spark, tmp_path):
    assert rd.resolve_header(["A", "Execution Result"], "contains", "execution") == "Execution Result"
    p = str(tmp_path / "r")
    spark.createDataFrame([(1, "C", "v", None, "x")], "row_pos int, cve_id string, version string, library string, poc string").write.parquet(p)
    with pytest.raises(ValueError, match="Execution Result"):
        rd.read_results(spark, p)


def test_whole_json_documents(spark, tmp_path):
    cat = tmp_path / "c.json"
    cat.write_text(json.dumps({"CVE-1": {"REPO": "r", "cwe": ["A"], "version_pair": [{"appears": "1", "not appears": "2", "seek_patch": False}, {"appears": "3"}]}, "CVE-2": {"version_pair": []}}, indent=1))
    rows = rd.read_catalog(spark, str(cat)).orderBy("pair_index").collect()
    assert [(r["cve"], r["pair_index"], r["appears"], r["not appears"], r["seek_patch"]) for r in rows] == [("CVE-1", 0, "1", "2", False), ("CVE-1", 1, "3", None, None)]
    hist = tmp_path / "h.json"
    hist.write_text(json.dumps({"g:a": [{"version": "1", "release_date": "2020-01-02T03:04:05"}, {"version": "", "release_date": "2020-01-01"}, {"version": "2", "release_date": "soon"}], "g:b": 3}))
    assert [tuple(r)[:2] for r in rd.read_release_history(spark, str(hist)).collect()] == [("g:a", "1")]


def test_pieces_of_json_objects_are_not_shuffled(spark, tmp_path):
    """A task walks the pieces of its split; only entries of files of many splits meet again."""
    (tmp_path / "a.json").write_text(json.dumps({f"k{i}": {"v": [i, 'a, "{', "\\\\"]} for i in range(50)}, indent=1))
    df = rd._entries_of_objects(spark, str(tmp_path))
    found = [json.loads(r["value"]) for r in df.collect()]
    assert sorted(k for f in found for k in f) == sorted(f"k{i}" for i in range(50)) and all(len(f) == 1 for f in found)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "monotonically_increasing_id" not in plan


NASTY = ["plain", "a, b", 'say "x", {y}', "back\\\\slash\\\\", "}],[{", "[,]", "\\u00e9, \\n", "", "tab\\t, end\\\""]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", ["397", "1m"])
def test_objects_are_cut_at_their_entries(spark, tmp_path, indent, split):
    rng = random.Random(3)
    value = lambda: rng.choice([1, None, True, rng.choice(NASTY), [rng.choice(NASTY), {"k,": rng.choice(NASTY)}], {}, []])
    objects = [{f"{rng.choice(NASTY)}{i}": value() for i in range(rng.choice([0, 1, 2, 150]))} for _ in range(8)]
    for i, o in enumerate(objects):
        (tmp_path / f"{i}.json").write_text((" \n" if i % 2 else "") + json.dumps(o, indent=indent, ensure_ascii=i % 3 > 0) + "\n" * (i % 2))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, split)
    try:
        got = [(r.key, r.value) for r in rd._keyed(spark, str(tmp_path)).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    text = lambda v: v if isinstance(v, str) else None if v is None else json.loads(json.dumps(v))
    back = lambda v: v if v is None else json.loads(v) if v[:1] in "[{1t" and v not in NASTY else v
    want = [(k, text(v)) for o in objects for k, v in o.items()]
    key = lambda x: (x[0], json.dumps(x[1]))
    assert sorted(((k, back(v)) for k, v in got), key=key) == sorted(want, key=key)


def test_trace_lines_keep_file_order_across_splits(spark, tmp_path):
    lines = [f"{i} ENTER [main] depth={i % 4} com.x.C{i}#m" if i % 5 else f"{i} META [main] k{i % 2}=v{i}=z" for i in range(400)]
    (tmp_path / "t.log").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        calls, meta = rd.read_traces(spark, str(tmp_path / "*.log"))
        got = [(r["pos"], r["symbol"]) for r in calls.orderBy("pos").collect()]
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert parts > 3
        assert got == [(n, f"com.x.C{i}#m") for n, i in enumerate(i for i in range(400) if i % 5)]
        assert meta.where("key = 'k1'").orderBy(F.desc("pos")).first()["value"] == "v395=z"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_log_reports_equal_those_of_whole_logs(spark, tmp_path):
    rng = random.Random(4)
    bits = ["plain line", "", "  ", "[ERROR] broke", "x COMPILATION ERROR : y", "BUILD FAILURE", "Status:", "Status: trace_diff ", "Status:no_diff", "Result:", "Result: /x", "it timed", "out of time", "timedout", "Exploit demo not found"]
    logs = [[rng.choice(bits[:3] + rng.sample(bits, 3)) for _ in range(rng.choice([1, 3, 40, 300]))] for _ in range(25)] + [["", ""], ["only"]]
    for i, log in enumerate(logs):
        (tmp_path / f"case-{i}.x.log").write_text("\n".join(log) + "\n" * (i % 2))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "997")
    try:
        got = {r.case_id: (r.kind, r.excerpt) for r in rd.read_log_reports(spark, str(tmp_path), 7).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = spark.createDataFrame([(f"case-{i}.x", "\n".join(log) + "\n" * (i % 2)) for i, log in enumerate(logs)], "id string, log string")
    want = {r.id: (r.kind, r.excerpt) for r in whole.select("id", fl.classify_log("log").alias("kind"), fl.error_excerpt("log", 7).alias("excerpt")).collect()}
    empty = {f"case-{i}.x" for i, log in enumerate(logs) if not "\n".join(log) + "\n" * (i % 2)}
    assert got == {k: v for k, v in want.items() if k not in empty}


def test_overlay_write_switches_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        wr.read_current(spark, root)
    wr.overlay_write(spark.range(3), root)
    wr.overlay_write(wr.read_current(spark, root).where("id > 0"), root)
    (tmp_path / "table" / "v000009").mkdir()
    assert wr.read_current(spark, root).count() == 2


def test_latest_snapshot(spark, tmp_path):
    import os

    for i, name in enumerate(["new", "old"]):
        d = tmp_path / name
        d.mkdir()
        (d / "eval.json").write_text("{}")
        os.utime(d / "eval.json", (10_000 - i, 10_000 - i))
    assert rd.latest_snapshot(spark, str(tmp_path / "*" / "eval.json")).endswith("new/eval.json")
    assert rd.latest_snapshot(spark, "x", explicit="y") == "y"
    latest = rd.read_logs(spark, str(tmp_path / "*" / "*.json"))
    assert {r["case_id"] for r in latest.collect()} == {"eval"}


def test_case_ids_and_status(spark):
    d = spark.createDataFrame([("CVE-1", 3, "1.0 beta/2", None, "", "T 1")], "c string, i int, a string, n string, b string, h string")
    assert d.select(cs.case_id("c", "i", "a", "n", "b", "h")).first()[0] == "CVE-1__03__1.0_beta_2__T_1"


def test_streams_equal_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = rd.STATUS_LOG + ", run STRING"
    for f in range(3):
        rows = [{"case_id": f"c{i % 7}", "timed_out": i % 7 == 0, "progress_total": 9, "run": f"r{f % 2}"} for i in range(20)]
        (src / f"{f}.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = mo.stream_status(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(str(out / "d"))).option("checkpointLocation", str(out / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["run"]: (r["completed"], r["timed_out"]) for r in spark.read.parquet(str(out / "d")).collect()}
    assert got == {"r0": (7, 1), "r1": (7, 1)}


def test_evidence_expansion(spark):
    cases = spark.createDataFrame(
        [("a", None, True, None, None, None)], "case_id string, trace_invalid_reasons array<string>, trace_has_difference boolean, trace_has_effective_difference boolean, failure_excerpt_file string, dependency_tree_diff string"
    )
    hunks = spark.createDataFrame([("a", 1, "api-diffs/p/A.diff", "why", "+ int x;")], "case_id string, hunk_pos int, path string, details string, inline string")
    files = spark.createDataFrame([("a", "version-diff/diffs/p/A.diff", "+ 1: return\n- invoke java/util/Map")], "case_id string, path string, text string")
    raw = spark.createDataFrame([("a", "api-raw/p/A", "class A\nint y;", "class A\nint x;")], "case_id string, stem string, baseline string, target string")
    r = jg.evidence_for_judgment(cases, hunks, files, raw).collect()
    assert len(r) == 1 and r[0]["paired_bytecode_path"] == "version-diff/diffs/p/A.diff" and r[0]["is_concrete"]
    assert "Related bytecode diff context (auto-expanded from version-diff/diffs/p/A.diff):\n+ 1: return" in r[0]["diff_excerpt"]
    assert "Aligned raw context preview:" in r[0]["diff_excerpt"] and "target_context (anchor line 2):\n00001: class A\n00002: int x;" in r[0]["diff_excerpt"]
    assert r[0]["details"].endswith("aligned raw baseline/target context.")


def test_write_folders_round_trip(spark, tmp_path):
    from flipline.sources import readers, writers

    rows = [(k, i, f"line {i}" if i % 3 else None) for k in (None, *range(40)) for i in range(3, -1, -1)]
    path = str(tmp_path / "out")
    writers.write_folders(spark.createDataFrame(rows, "k long, i int, v string"), path, "k", "v", order="i", rows=10)
    assert len(list((tmp_path / "out").glob("folder=*/*.txt"))) == 41
    for at, nested in ((path, True), (f"{path}/*/*.txt", False)):
        found = {(r.file_name, r.text) for r in readers.read_logs(spark, at, nested).collect()}
        assert found == {("part-0.txt", "\nline 1\nline 2\n\n")}
        assert readers.read_logs(spark, at, nested).count() == 41
        lines = readers.read_numbered(spark, at, lambda v: v != "", nested).collect()
        assert len(lines) == 82 and {(r.pos, r.line) for r in lines} == {(0, "line 1"), (1, "line 2")}
    assert {r.case_id for r in readers.read_case_results(spark, path, True).collect()} == {"folder=__HIVE_DEFAULT_PARTITION__", *(f"folder={k}" for k in range(40))}
