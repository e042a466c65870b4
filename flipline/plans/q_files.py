"""Queries over files: tables are written in the input formats, read back through the scans, and streamed.

Every run writes under a folder of its own in the checkpoint folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipline.operators import verdicts as vd
from flipline.plans import bindings as b
from flipline.plans.q_text import phrase_sql
from flipline.plans.registry import query
from flipline.session import checkpoint_root
from flipline.sources import readers as rd
from flipline.sources import writers as wr
from flipline.streaming import monitors as mo


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


@query(
    "sc1_read_results",
    b.with_sql("chain") + "SELECT row_pos, CVE_ID, Library, Version, outcome, verdict, truth, 'No_Data' AS aligned FROM chain WHERE row_pos % 5 > 0",
)
def sc1(spark, sf):
    path = scratch(spark, "results")
    d = b.chain(spark, sf)
    d.select(
        F.col("row_pos").cast("string").alias("row_pos"), F.when(F.col("row_pos") % 5 > 0, F.col("CVE_ID")).alias("cve_id"), F.col("Library").alias("LIBRARY"), F.col("PoC").alias("poc"),
        F.col("Version").alias("version"), F.col("outcome").alias("Execution Result (run)"), F.col("truth").alias("True Affected Version"), F.col("verdict").alias("llm_verdict"),
    ).write.option("header", True).csv(path)
    r = rd.read_results(spark, path, "csv")
    return r.select(
        "row_pos", "CVE_ID", "Library", "Version", F.col("Execution Result").alias("outcome"), F.col("LLM_Verdict").alias("verdict"), F.col("True Affected Version").alias("truth"), F.col("Aligned_llm").alias("aligned")
    )


@query(
    "sc2_read_catalog",
    """SELECT 'CVE-' || o_orderkey AS cve, i - 1 AS pair_index, '1.' || (o_orderkey % 9) AS appears, '2.' || i AS not_appears, CASE WHEN i % 2 = 0 THEN o_orderkey % 3 = 0 END AS seek_patch, 'repo' || (o_orderkey % 7) AS repo
    FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= 1 + o_orderkey % 3""",
)
def sc2(spark, sf):
    k = F.col("o_orderkey")
    pair = lambda i: F.struct(
        F.concat(F.lit("1."), k % 9).alias("appears"), F.lit(f"2.{i}").alias("not appears"), (k % 3 == 0 if i % 2 == 0 else F.lit(None).cast("boolean")).alias("seek_patch")
    )
    entry = F.struct(F.concat(F.lit("repo"), k % 7).alias("REPO"), F.slice(F.array(pair(1), pair(2), pair(3)), F.lit(1), (k % 3).cast("int") + 1).alias("version_pair"))
    doc = F.to_json(F.create_map(F.concat(F.lit("CVE-"), k), entry))
    path = _text(b.table(spark, sf, "orders").select(doc.alias("value")), scratch(spark, "catalog"))
    c = rd.read_catalog(spark, path, by_line=True)
    return c.select("cve", "pair_index", "appears", F.col("not appears").alias("not_appears"), "seek_patch", F.col("REPO").alias("repo"))


def _objects(df: DataFrame, path: str) -> str:
    """Write rows (bucket, pos, key, value) as files of one JSON object each, a bucket per file, over many lines."""
    in_file = Window.partitionBy("bucket").orderBy("pos")
    head = F.when(F.row_number().over(in_file) == 1, "{").otherwise("")
    tail = F.when(F.lead("pos").over(in_file).isNull(), "}").otherwise(",")
    line = F.concat(head, F.lit('"'), "key", F.lit('" : '), "value", tail)
    rows = df.select("bucket", "pos", line.alias("value")).repartition("bucket").sortWithinPartitions("bucket", "pos")
    rows.drop("pos").write.partitionBy("bucket").text(path)
    return f"{path}/*/*.txt"


@query(
    "sc2_catalog_objects",
    """SELECT 'CVE-' || o_orderkey AS cve, i - 1 AS pair_index, '1.' || (o_orderkey % 9) AS appears, 'a, "{b' || i AS not_appears, 'repo' || (o_orderkey % 7) AS repo, o_orderpriority || ' }],' AS description
    FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= 1 + o_orderkey % 3""",
)
def sc2_objects(spark, sf):
    k = F.col("o_orderkey")
    pair = lambda i: F.struct(F.concat(F.lit("1."), k % 9).alias("appears"), F.lit(f'a, "{{b{i}').alias("not appears"))
    entry = F.struct(F.concat(F.lit("repo"), k % 7).alias("REPO"), F.concat("o_orderpriority", F.lit(" }],")).alias("description"), F.slice(F.array(pair(1), pair(2), pair(3)), F.lit(1), (k % 3).cast("int") + 1).alias("version_pair"))
    rows = b.table(spark, sf, "orders").select(F.expr("o_orderkey div 5000").alias("bucket"), k.alias("pos"), F.concat(F.lit("CVE-"), k).alias("key"), F.to_json(entry).alias("value"))
    c = rd.read_catalog(spark, _objects(rows, scratch(spark, "catalog-objects")))
    return c.select("cve", "pair_index", "appears", F.col("not appears").alias("not_appears"), F.col("REPO").alias("repo"), "description")


@query("sc2_catalog_issues", "SELECT 'CVE-' || c_custkey AS cve, c_mktsegment AS repo, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS description FROM customer")
def sc2_issues(spark, sf):
    k = F.col("c_custkey")
    entry = F.struct(F.col("c_mktsegment").alias("REPO"), F.when(k % 3 > 0, F.col("c_name")).alias("description"), F.array().cast("array<string>").alias("version_pair"))
    rows = b.table(spark, sf, "customer").select(F.expr("c_custkey div 1000").alias("bucket"), k.alias("pos"), F.concat(F.lit("CVE-"), k).alias("key"), F.to_json(entry).alias("value"))
    c = rd.read_catalog_issues(spark, _objects(rows, scratch(spark, "catalog-issues")))
    return c.select("cve", F.col("REPO").alias("repo"), "description")


@query(
    "sc3_read_repo_metadata",
    """SELECT 'CVE-' || c_custkey AS cve, CASE WHEN c_custkey % 3 = 0 THEN 'own' || (c_custkey % 5) ELSE 'unknown' END AS owner, 'unknown' AS repo_name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS description, c_mktsegment AS cwes
    FROM customer WHERE c_custkey % 7 > 0""",
)
def sc3(spark, sf):
    k = F.col("c_custkey")
    info = F.to_json(
        F.struct(
            F.when(k % 3 == 0, F.concat(F.lit(" own"), k % 5)).when(k % 3 == 1, " ").alias("owner"), F.when(k % 2 == 0, F.col("c_name")).alias("description"), F.array("c_mktsegment").alias("cwe")
        )
    )
    line = F.concat(F.lit('{"CVE-'), k, F.lit('": '), F.when(k % 7 == 0, '"gone"').otherwise(info), F.lit("}"))
    path = _text(b.table(spark, sf, "customer").select(line.alias("value")), scratch(spark, "repos"))
    r = rd.read_repo_metadata(spark, path, by_line=True)
    return r.select("cve", "owner", "repo_name", "description", F.array_join("cwe", ",").alias("cwes"))


@query(
    "sc4_read_release_history",
    """SELECT 'g:a' || o_custkey AS artifact, '1.' || o_orderkey AS version, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders WHERE o_orderkey % 4 > 1""",
)
def sc4(spark, sf):
    k = F.col("o_orderkey")
    good = F.struct(F.concat(F.lit(" 1."), k).alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("release_date"))
    bad = F.struct(F.when(k % 4 == 0, "").otherwise("2").alias("version"), F.lit("not a date").alias("release_date"))
    doc = F.to_json(F.create_map(F.concat(F.lit("g:a"), "o_custkey"), F.array(F.when(k % 4 > 1, good).otherwise(bad))))
    path = _text(b.table(spark, sf, "orders").select(doc.alias("value")), scratch(spark, "history"))
    return rd.read_release_history(spark, path, by_line=True).select("artifact", "version", F.date_format("release_date", "yyyy-MM-dd HH:mm:ss").alias("day"))


@query(
    "sc5_read_disclosed",
    "SELECT 'org.g:lib' || (l_partkey % 9) AS gav, 'CVE-' || l_orderkey AS cve, CASE WHEN l_linenumber % 2 = 0 THEN 'v' || l_linenumber ELSE '' END AS version, count(*) AS n FROM lineitem WHERE l_linenumber % 7 IN (1, 2, 4) GROUP BY 1, 2, 3",
)
def sc5(spark, sf):
    n = F.col("l_linenumber")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    full = j(" org.g:lib", F.col("l_partkey") % 9, "\t CVE-", F.col("l_orderkey"), F.when(n % 2 == 0, j("\tv", n)).otherwise("\t"))
    line = F.when(n % 7 == 3, j("# ", full)).when(n % 7 == 5, "alone").when(n % 7 == 6, "no-colon\tCVE-1\t2").when(n % 7 == 0, "a:b\tXYZ-1").otherwise(full)
    path = _text(b.table(spark, sf, "lineitem").select(line.alias("value")), scratch(spark, "disclosed"))
    return rd.read_disclosed(spark, path).groupBy("gav", "cve", "version").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sc6_read_analysis",
    """SELECT 'CVE-' || user_id AS cve, i - 1 AS entry_pos, 'V' || (event_id % 3) AS base_tag, event_id, CASE WHEN i = 2 THEN value / 250 END AS margin FROM events, (SELECT unnest([1, 2]) AS i) WHERE event_id % 6 > 0""",
)
def sc6(spark, sf):
    e = F.col("event_id")
    entry = lambda m: F.struct(F.concat(F.lit("V"), e % 3).alias("base_tag"), e.alias("head_tag"), F.struct(m.alias("deep")).alias("analysis"))
    both = F.array(
        entry(F.array(F.struct(F.lit(None).cast("double").alias("margin"), F.lit("x").alias("n")))),
        entry(F.array(F.struct((F.col("value") / 250).alias("margin"), F.lit('say "margin": 9').alias("n")))),
    )
    line = F.concat(F.lit('{"cve-'), "user_id", F.lit('": '), F.when(e % 6 == 0, "5").otherwise(F.to_json(both)), F.lit("}"))
    path = _text(b.table(spark, sf, "events").select(line.alias("value")), scratch(spark, "analysis"))
    a = rd.read_analysis(spark, path, by_line=True)
    return a.select("cve", "entry_pos", "base_tag", F.col("head_tag").cast("bigint").alias("event_id"), vd.max_margin("analysis").alias("margin"))


def _documents_by_folder(df: DataFrame, path: str, folder: str, body: str) -> str:
    """Write one text file per folder name."""
    wr.write_folders(df, path, folder, body)
    return path


@query(
    "sc7_read_case_results",
    """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'trace_diff' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'missing_class' ELSE 'none' END AS failure_subtype, true AS is_valid FROM supplier WHERE s_suppkey % 4 > 0
    UNION ALL SELECT s_suppkey, 'unknown', 'none', false FROM supplier WHERE s_suppkey % 4 = 0""",
)
def sc7(spark, sf):
    k = F.col("s_suppkey")
    doc = F.to_json(F.struct(F.when(k % 5 > 0, "trace_diff").otherwise(" ").alias("status"), F.when(k % 2 == 0, "missing_class").alias("failure_subtype"), k.alias("pair_index")))
    d = b.table(spark, sf, "supplier").select(k.alias("f"), F.when(k % 4 == 0, F.concat(F.lit("{broken "), doc)).otherwise(doc).alias("v"))
    path = _documents_by_folder(d, scratch(spark, "case-results"), "f", "v")
    r = rd.read_case_results(spark, path, nested=True)
    return r.select(F.regexp_extract("case_id", r"(\d+)$", 1).cast("bigint").alias("k"), "status", "failure_subtype", "is_valid")


@query("sc8_read_logs", "SELECT s_suppkey AS k, 'line 1' || chr(10) || s_name || chr(10) AS text FROM supplier")
def sc8(spark, sf):
    d = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("f"), F.concat(F.lit("line 1\n"), "s_name").alias("v"))
    path = _documents_by_folder(d, scratch(spark, "logs"), "f", "v")
    out = rd.read_logs(spark, path, nested=True)
    return out.select(F.regexp_extract("text", r"#(\d+)", 1).cast("bigint").alias("k"), "text")


@query(
    "sc8_log_reports",
    f"""SELECT 'log-' || k AS case_id, len(ls) AS n_lines, CASE WHEN contains(log, 'Status: trace_diff') THEN 'trace_diff' WHEN log = '' THEN 'empty_log' WHEN contains(log, 'Exploit demo not found') THEN 'exploit_demo_not_found'
      WHEN contains(log, 'timed out') THEN 'timeout_hint' WHEN contains(log, 'Result: ') THEN 'result_path_only' ELSE 'unknown' END AS kind,
      array_to_string(CASE WHEN p > 0 THEN ls[greatest(p - 3, 1):greatest(p - 3, 1) + 3] ELSE ls[greatest(len(ls) - 3, 1):] END, chr(10)) AS excerpt FROM (
    SELECT *, coalesce(list_position(list_transform(ls, lambda x: contains(x, 'COMPILATION ERROR') OR starts_with(x, '[ERROR]') OR contains(x, 'BUILD FAILURE')), true), 0) AS p
    FROM (SELECT k, log, string_split(log, chr(10)) AS ls FROM (SELECT k, {phrase_sql('k', b.LOG_PHRASES)} AS log FROM (SELECT s_suppkey AS k FROM supplier))))""",
)
def sc8_reports(spark, sf):
    text, _ = b.phrases("k", b.LOG_PHRASES)
    d = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).select(F.concat(F.lit("log-"), "k").alias("f"), text.alias("v"))
    path = _documents_by_folder(d, scratch(spark, "log-reports"), "f", "v")
    # The folder names the log here, since Spark names the files.
    named = rd.read_log_reports(spark, path, 4, nested=True)
    return named.select(F.regexp_extract("path", r"folder=(log-\d+)", 1).alias("case_id"), "n_lines", "kind", "excerpt")


@query(
    "sc9_read_traces",
    """SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 'com.lib.' || event_type || '#' || event_id AS symbol FROM events WHERE event_id % 3 < 2""",
)
def sc9_files(spark, sf):
    e = F.col("event_id")
    line = F.concat(e, F.when(e % 3 < 2, " ENTER [main] depth=1 com.lib.").otherwise(" META [main] k="), "event_type", F.lit("#"), e)
    path = scratch(spark, "traces")
    # One ordered file per trace, a user's.
    d = b.table(spark, sf, "events").select(F.col("user_id").alias("trace"), "event_id", line.alias("value"))
    wr.write_folders(d, path, "trace", "value", order="event_id", rows=100_000)
    lines = rd.read_numbered(spark, path, lambda v: v.rlike(rd.TRACE_ENTER), nested=True)
    return lines.select(
        F.regexp_extract("path", r"folder=(\d+)", 1).cast("bigint").alias("trace"), "pos", F.regexp_extract("line", rd.TRACE_ENTER, 1).alias("symbol")
    )


@query(
    "sc10_read_archives",
    """SELECT 'archive-' || k || '.jar' AS archive, 'com/lib/C' || i || '.class' AS entry, sha256('C' || i || '-' || k) AS sha
    FROM (SELECT s_suppkey AS k, unnest(generate_series(0, s_suppkey % 4)) AS i FROM supplier)""",
)
def sc10(spark, sf):
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for batch in batches:
            rows = []
            for key, names in zip(batch["k"], batch["names"]):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w") as z:
                    for name in names:
                        z.writestr(f"com/lib/{name}.class", f"{name}-{key}")
                    z.writestr("README.txt", "no class")
                rows.append((f"archive-{key}.jar", buf.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    from flipline.operators.diffs import archive_entries

    k = F.col("s_suppkey")
    d = b.table(spark, sf, "supplier").select(k.alias("k"), F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("C"), i)).alias("names"))
    return archive_entries(d.mapInPandas(pack, "path string, content binary"))


@query("sc11_read_jsonl", b.with_sql("runlog") + "SELECT case_id, timed_out, progress_index, count(*) AS n FROM runlog WHERE pos % 9 > 0 GROUP BY 1, 2, 3")
def sc11(spark, sf):
    d = b.runlog(spark, sf)
    doc = F.to_json(F.struct("case_id", "timed_out", "progress_index", "progress_total"))
    path = _text(d.select(F.when(F.col("pos") % 9 == 0, F.concat(F.lit("{broken"), doc)).otherwise(doc).alias("value")), scratch(spark, "status"))
    r = rd.read_jsonl(spark, path, rd.STATUS_LOG)
    return r.groupBy("case_id", "timed_out", "progress_index").agg(F.count(F.lit(1)).alias("n"))


@query("sc12_latest_snapshot", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders")
def sc12(spark, sf):
    root = scratch(spark, "snapshots")
    o = b.table(spark, sf, "orders").select("o_orderkey")
    # A snapshot is a folder of as many files as there were tasks.
    o.where("o_orderkey < 10").write.parquet(f"{root}/a")
    o.write.parquet(f"{root}/b")
    newest = rd.latest_snapshot(spark, f"{root}/*/*.parquet", folders=True)
    return spark.read.parquet(newest).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query(
    "sk1_write_csv",
    """SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority || ' ; "x", y' AS items, NULL AS absent FROM orders""",
)
def sk1(spark, sf):
    path = scratch(spark, "csv")
    d = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.array("o_orderpriority", F.lit('"x", y')).alias("items"))
    wr.write_csv(d, path, ["k", "items", "absent"])
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query(
    "sk2_write_summary_json",
    b.with_sql("cases") + "SELECT count(*) AS total_cases, 'all' AS mode, sum(k)::BIGINT AS key_sum FROM cases",
)
def sk2(spark, sf):
    path = scratch(spark, "summary")
    c = b.cases(spark, sf).select("case_id", "k", "status")
    wr.write_summary_json(c, c.agg(F.count(F.lit(1)).alias("total_cases")), path, {"mode": "all"})
    head = spark.read.schema("total_cases LONG, mode STRING").json(f"{path}/header")
    total = spark.read.schema("k LONG").json(f"{path}/entries").agg(F.sum("k"))
    return head.withColumn("key_sum", total.scalar())


@query("sk3_overlay_write", b.with_sql("chain") + "SELECT row_pos, 'No_Data' AS verdict, truth FROM chain")
def sk3(spark, sf):
    root = scratch(spark, "table")
    wr.overlay_write(b.chain(spark, sf), root)
    wr.overlay_write(vd.reset_verdicts(wr.read_current(spark, root), "verdict"), root)
    return wr.read_current(spark, root).select("row_pos", "verdict", "truth")


# --- streams ----------------------------------------------------------------------------------------------


def drain(df: DataFrame, target: str, mode: str, once: bool = False) -> DataFrame:
    """Run a stream over what is there now; every batch replaces the result in complete mode.

    ``once`` runs a single batch: a stream with timers in processing time would go on for ever to wait for them.
    """
    spark = df.sparkSession
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{target}/data")
    out = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{target}/state")
    q = (out.trigger(once=True) if once else out.trigger(availableNow=True)).start()
    q.awaitTermination()
    return spark.read.parquet(f"{target}/data")


@query(
    "st1_stream_status",
    b.with_sql("runlog") + """SELECT run, count(*) AS completed, max(progress_total) AS progress_total FROM (SELECT run, case_id, max(progress_total) AS progress_total FROM runlog GROUP BY 1, 2) GROUP BY 1""",
)
def st1(spark, sf):
    path, target = scratch(spark, "status-stream"), scratch(spark, "status-counts")
    d = b.runlog(spark, sf).join(b.table(spark, sf, "events").select(F.col("event_id").alias("pos"), "ts"), "pos")
    lines = d.select("case_id", "timed_out", "progress_index", "progress_total", "run", F.col("ts").cast("timestamp").alias("ts"))
    stream = lambda: mo.stream_status(spark.readStream.schema(rd.STATUS_LOG + ", run LONG, ts TIMESTAMP").json(path), event_time="ts")
    lines.write.json(path)
    drain(stream(), target, "complete")
    # A second case of the first run comes too late to count.
    late = lines.groupBy().agg(F.min(F.struct("ts", "run", "progress_total")).alias("r")).select("r.*", F.lit("late").alias("case_id"))
    late.write.mode("append").json(path)
    return drain(stream(), target, "complete").select("run", "completed", "progress_total")


@query(
    "st1_finished_runs",
    b.with_sql("runlog")
    + """SELECT run, count(*) AS completed, count(*) FILTER (timed_out) AS timed_out, 37 AS progress_total, count(*) >= 37 AS finished
    FROM (SELECT run, case_id, timed_out FROM runlog QUALIFY row_number() OVER (PARTITION BY run, case_id ORDER BY pos) = 1) GROUP BY run""",
)
def st1_runs(spark, sf):
    path, target = scratch(spark, "run-stream"), scratch(spark, "run-ends")
    d = b.runlog(spark, sf).withColumn("progress_total", F.lit(37))
    lines = d.select("case_id", "timed_out", "progress_index", "progress_total", F.col("run").alias("folder"), "pos")
    # A folder per run, whose lines are brought together in order; the last run breaks off and ends by its pause.
    run = F.regexp_extract("_metadata.file_path", r"folder=(-?\d+)", 1).cast("long")
    stream = lambda: mo.finished_runs(mo.status_stream(spark, f"{path}/*/*.json", run), idle_ms=1)
    lines.repartition("folder").sortWithinPartitions("folder", "pos").drop("pos").write.partitionBy("folder").json(path)
    drain(stream(), target, "append", once=True)
    more = lines.limit(1).drop("pos").withColumns({"folder": F.lit(-1), "progress_total": F.lit(1)})
    more.write.mode("append").partitionBy("folder").json(path)
    return drain(stream(), target, "append", once=True).where("run >= 0")


@query(
    "st2_stream_usage",
    b.with_sql("usage_rows")
    + """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, method, model, count(*) AS calls, sum(nullif(prompt_tokens, 0))::BIGINT AS prompt_tokens,
    sum(nullif(completion_tokens, 0))::BIGINT AS completion_tokens, sum(nullif(prompt_tokens, 0) + nullif(completion_tokens, 0))::BIGINT AS total_tokens FROM usage_rows GROUP BY 1, 2, 3""",
)
def st2(spark, sf):
    path, target = scratch(spark, "usage-stream"), scratch(spark, "usage-counts")
    names = ["ts", "method", "model", "prompt_tokens", "completion_tokens"]
    lines = b.usage_rows(spark, sf).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).select(*names)
    stream = lambda: mo.stream_usage(mo.usage_stream(spark, path))
    lines.write.json(path)
    drain(stream(), target, "append")
    # The first line comes once more, too late to count; the last one comes again two days later and closes all windows.
    ends = lambda pick: lines.groupBy().agg(pick(F.struct(*names)).alias("r")).select("r.*")
    late, after = ends(F.min), ends(F.max).withColumn("ts", F.col("ts") + 2 * 86400)
    late.unionByName(after).write.mode("append").json(path)
    out = drain(stream(), target, "append")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
