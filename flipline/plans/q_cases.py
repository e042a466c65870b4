"""Queries: case ids and selection, log classification, status, repair, summaries, resume, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipline.functions import failures as fl
from flipline.operators import cases as cs
from flipline.plans import bindings as b
from flipline.plans.registry import query

# Composed logs hold one phrase per rule that applies; `low` is the lower-cased text the rules read.
def _log_sql(key="k"):
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {key} % {m} = {r} THEN {quoted(p)} END" for m, r, p in b.LOG_PHRASES) + ")"


LOGS = f"SELECT o_orderkey AS k, {_log_sql('o_orderkey')} AS log, lower({_log_sql('o_orderkey')}) AS low FROM orders"


def logs(spark, sf):
    text, _ = b.phrases("o_orderkey", b.LOG_PHRASES)
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.alias("log"))


def has(words, c="low"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_SLUG = "trim(regexp_replace({c}, '[^A-Za-z0-9._-]+', '_', 'g'), '_')"


@query(
    "pr11_case_id",
    f"""SELECT k, 'CVE-' || c || '__' || lpad(CAST(k % 13 AS VARCHAR), 2, '0') || '__' || {_SLUG.format(c='l')} || '__' || {_SLUG.format(c='r')} AS case_id FROM (
    SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 3 WHEN 0 THEN '1.' || o_orderpriority WHEN 1 THEN 'tag/' || (o_orderkey % 9) ELSE 'pair' || (o_orderkey % 13) END AS l,
      CASE o_orderkey % 2 WHEN 0 THEN ' v2 ' || (o_orderkey % 5) || '!' ELSE 'pair' || (o_orderkey % 13) END AS r FROM orders)""",
)
def pr11(spark, sf):
    k = F.col("o_orderkey")
    d = b.table(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.lit("CVE-"), "o_custkey").alias("cve"), (k % 13).alias("i"),
        F.when(k % 3 == 0, F.concat(F.lit("1."), "o_orderpriority")).when(k % 3 == 1, "").alias("appears"),
        F.when(k % 3 == 1, F.concat(F.lit("tag/"), k % 9)).otherwise("").alias("base"),
        F.when(k % 2 == 0, F.concat(F.lit(" v2 "), k % 5, F.lit("!"))).alias("head"),
    )
    return d.select("k", cs.case_id("cve", "i", "appears", F.lit(None).cast("string"), "base", "head").alias("case_id"))


for _mode, _cond in {"compile-false": "compile = false", "seek-patch-false": "NOT seek_patch", "seek-patch-true": "seek_patch"}.items():

    def _select(spark, sf, mode=_mode):
        return cs.select_cases(b.cases(spark, sf), mode, cve="cve_id").select("case_id", "cve_id", "pair_index")

    query(f"pr12_select_{_mode.replace('-', '_')}", b.with_sql("cases") + f"SELECT case_id, cve_id, pair_index FROM cases WHERE {_cond}")(_select)


@query(
    "pr13_select_for_judgment",
    b.with_sql("cases") + "SELECT case_id, status FROM cases WHERE status IN ('trace_diff', 'execution_failure') OR (status = 'no_diff' AND NOT seek_patch)",
)
def pr13(spark, sf):
    return cs.select_for_judgment(b.cases(spark, sf), ["trace_diff", "execution_failure"]).select("case_id", "status")


@query("pr14_seeded_sample", b.with_sql("cases") + "SELECT case_id, status FROM cases ORDER BY md5(case_id || '|7'), case_id LIMIT 25")
def pr14(spark, sf):
    return cs.seeded_sample(b.cases(spark, sf), "case_id", 7, 25).select("case_id", "status")


_DEP = ["could not resolve dependencies", "failed to collect dependencies", "could not transfer artifact"]


@query(
    "pr31_classify_failure",
    f"""SELECT k, CASE WHEN contains(low, 'compilation error') THEN 'compile_failure' WHEN contains(low, 'failed to execute goal') AND contains(low, ':compile') THEN 'compile_failure'
    WHEN {has(_DEP)} THEN 'dependency_resolution_failure' WHEN contains(low, 'there are test failures.') THEN 'test_failure' WHEN contains(low, 'caused by:') THEN 'runtime_failure'
    WHEN contains(low, 'build failure') THEN 'build_failure' END AS kind FROM ({LOGS})""",
)
def pr31(spark, sf):
    return logs(spark, sf).select("k", fl.classify_failure("log").alias("kind"))


_SUBTYPE = f"""CASE WHEN {has(_DEP, '{c}')} THEN 'dependency_resolution_failure' WHEN contains({{c}}, 'invalid target release') THEN 'toolchain_incompatibility'
  WHEN contains({{c}}, 'agent library failed to init') THEN 'trace_agent_initialization_failure'
  WHEN contains({{c}}, 'arrayindexoutofboundsexception') AND {has(['org.objectweb.asm', ' asm', 'classreader', 'methodwriter', 'frame', 'generator'], '{c}')} THEN 'asm_instrumentation_failure'
  WHEN contains({{c}}, 'nosuchmethoderror') OR (contains({{c}}, 'cannot find symbol') AND contains({{c}}, 'method')) THEN 'missing_method'
  WHEN contains({{c}}, 'noclassdeffounderror') OR (contains({{c}}, 'cannot find symbol') AND contains({{c}}, 'class')) OR (contains({{c}}, 'package ') AND contains({{c}}, ' does not exist')) THEN 'missing_class'
  WHEN contains({{c}}, 'verifyerror') THEN 'binary_incompatibility' WHEN contains({{c}}, 'no suitable constructor found') THEN 'constructor_signature_change'
  WHEN contains({{c}}, 'there are test failures') THEN 'test_failure' WHEN {{r}} THEN 'api_breaking_change' WHEN {{b}} THEN 'signature_change' ELSE 'unknown_failure' END"""


@query("pr32_failure_subtype", f"SELECT k, {_SUBTYPE.format(c='low', r='k % 4 = 0', b='k % 4 = 1')} AS subtype FROM ({LOGS})")
def pr32(spark, sf):
    k = F.col("k")
    return logs(spark, sf).select("k", fl.failure_subtype("log", k % 4 == 0, k % 4 == 1).alias("subtype"))


_FROM_TEXT = f"""struct_pack(missing := contains({{c}}, 'artifact file does not exist:') OR {has(_DEP, '{c}')}, runtime := {has(['there are test failures', 'agent library failed to init'], '{c}')},
  compile := {has(['compilation error', 'cannot find symbol', 'package ', ' does not exist', 'invalid target release'], '{c}')}, sub := {_SUBTYPE.format(c='{c}', r='rem', b='brk')})"""
_REPAIR = f"""
WITH l AS (SELECT k, log AS run_log, k % 4 = 0 AS rem, k % 4 = 1 AS brk, CASE WHEN k % 3 = 0 THEN 'cause ' || k END AS cause,
    CASE WHEN k % 5 = 0 THEN 'error: cannot find symbol method x' END AS be, CASE WHEN k % 7 = 0 THEN 'Tests: java.lang.VerifyError' END AS te, CASE WHEN k % 6 < 4 THEN 'runner_error' ELSE 'no_diff' END AS st FROM ({LOGS})),
m AS (SELECT *, CASE WHEN contains(run_log, 'Baseline version 1.0 did not') THEN 'baseline' WHEN contains(run_log, 'Target version 2.0 did not') THEN 'target'
    WHEN be IS NOT NULL AND te IS NULL THEN 'baseline' WHEN te IS NOT NULL THEN 'target' END AS stage,
  lower(concat_ws(chr(10), nullif(cause, ''), nullif(run_log, ''), be, te)) AS alltext, lower(concat_ws(chr(10), cause, nullif(run_log, ''), be)) AS bt, lower(concat_ws(chr(10), cause, nullif(run_log, ''), te)) AS tt FROM l),
r AS (SELECT *, CASE WHEN st <> 'runner_error' THEN NULL WHEN stage = 'baseline' AND be IS NOT NULL THEN 'baseline' WHEN stage = 'target' AND te IS NOT NULL THEN 'target'
    WHEN contains(alltext, 'artifact file does not exist:') OR contains(alltext, 'could not resolve dependencies') THEN 'artifact' END AS route FROM m),
f AS (SELECT *, CASE route WHEN 'baseline' THEN {_FROM_TEXT.format(c='bt')} WHEN 'target' THEN {_FROM_TEXT.format(c='tt')} END AS x FROM r),
g AS (SELECT *, CASE WHEN route = 'artifact' THEN 'execution_failure' WHEN x.missing OR x.runtime OR NOT x.compile THEN 'execution_failure' ELSE 'compile_failure' END AS ns,
    CASE WHEN route = 'artifact' OR x.missing THEN 'dependency_resolution_failure' ELSE x.sub END AS nsub FROM f),
h AS (SELECT *, CASE WHEN route = 'artifact' OR x.missing THEN 'dependency_resolution_failure' ELSE ns END AS nk FROM g)
SELECT k, CASE WHEN route IS NULL THEN st ELSE ns END AS status, CASE WHEN route IS NULL THEN 'none' ELSE nk END AS failure_kind, CASE WHEN route IS NULL THEN 'none' ELSE nsub END AS failure_subtype,
  route IS NOT NULL AS normalized_from_runner_error,
  CASE WHEN route = 'baseline' THEN CASE WHEN ns = 'compile_failure' THEN ns WHEN nk = 'dependency_resolution_failure' THEN nk ELSE 'execution_failure' END END AS base_obs,
  CASE WHEN route IN ('target', 'artifact') THEN CASE WHEN ns = 'compile_failure' THEN ns WHEN nk = 'dependency_resolution_failure' THEN nk ELSE 'execution_failure' END END AS target_obs,
  CASE WHEN route IS NULL THEN 'runner_error' ELSE ns END AS test_status FROM h
"""


@query("pr33_normalize_runner_error", _REPAIR)
def pr33(spark, sf):
    k = F.col("k")
    none = F.lit(None).cast("string")
    test = F.struct(
        F.lit("runner_error").alias("status"), F.lit("none").alias("failure_kind"), F.lit("none").alias("failure_subtype"),
        none.alias("baseline_execution_observation"), none.alias("target_execution_observation"),
    )
    d = logs(spark, sf).select(
        "k", F.when(k % 6 < 4, "runner_error").otherwise("no_diff").alias("status"), F.lit("none").alias("failure_kind"), F.lit("none").alias("failure_subtype"),
        F.col("log").alias("run_log"), F.when(k % 3 == 0, F.concat(F.lit("cause "), k)).alias("dataset_cause"),
        F.when(k % 5 == 0, "error: cannot find symbol method x").alias("baseline_excerpt"), F.when(k % 7 == 0, "Tests: java.lang.VerifyError").alias("target_excerpt"),
        none.alias("baseline_log"), none.alias("target_log"), (k % 4 == 0).alias("has_removed_classes"), (k % 4 == 1).alias("has_breaking"),
        none.alias("baseline_execution_observation"), none.alias("target_execution_observation"), F.array(test).alias("test_results"),
    )
    out = cs.normalize_runner_error(d)
    return out.select(
        "k", "status", "failure_kind", "failure_subtype", "normalized_from_runner_error", F.col("baseline_execution_observation").alias("base_obs"),
        F.col("target_execution_observation").alias("target_obs"), F.col("test_results")[0]["status"].alias("test_status"),
    )


@query(
    "pr34_classify_log",
    f"""SELECT k, CASE WHEN contains(log, 'Status: trace_diff') THEN 'trace_diff' WHEN log = '' THEN 'empty_log' WHEN contains(log, 'Exploit demo not found') THEN 'exploit_demo_not_found'
    WHEN contains(log, 'timed out') THEN 'timeout_hint' WHEN contains(log, 'Result: ') THEN 'result_path_only' ELSE 'unknown' END AS kind FROM ({LOGS})""",
)
def pr34(spark, sf):
    return logs(spark, sf).select("k", fl.classify_log("log").alias("kind"))


_MARK = "list_position(list_transform(ls, lambda x: contains(x, 'COMPILATION ERROR') OR starts_with(x, '[ERROR]') OR contains(x, 'BUILD FAILURE')), true)"


@query(
    "pr35_error_excerpt",
    f"""SELECT k, array_to_string(CASE WHEN p > 0 THEN ls[greatest(p - 3, 1):greatest(p - 3, 1) + 3] ELSE ls[greatest(len(ls) - 3, 1):] END, chr(10)) AS excerpt FROM (
    SELECT k, ls, coalesce({_MARK}, 0) AS p FROM (SELECT k, CASE WHEN log = '' THEN [] ELSE string_split(log, chr(10)) END AS ls FROM ({LOGS})))""",
)
def pr35(spark, sf):
    return logs(spark, sf).select("k", fl.error_excerpt("log", 4).alias("excerpt"))


# --- status -----------------------------------------------------------------------------------------------


@query(
    "pr48_case_status",
    f"""SELECT k, CASE WHEN rc <> 0 THEN 'runner_error' WHEN ex AND ob = 'compile_failure' THEN 'compile_failure' WHEN ex THEN 'execution_failure' WHEN eff THEN 'trace_diff' ELSE 'no_diff' END AS status,
    CASE WHEN rc <> 0 THEN 'runner_error' WHEN ex AND ob = 'compile_failure' THEN coalesce(sc, 'compile_failure') WHEN ex THEN coalesce(ob, sc, 'execution_failure') END AS failure_kind,
    CASE WHEN rc <> 0 THEN 'runner_error' WHEN ex THEN {_SUBTYPE.format(c='low', r='false', b='k % 4 = 1')} WHEN eff THEN 'trace_difference' WHEN diff THEN 'invalid_trace_difference' END AS failure_subtype FROM (
    SELECT k, low, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS rc, k % 2 = 0 AS ex, CASE k % 3 WHEN 0 THEN 'compile_failure' WHEN 1 THEN 'test_failure' END AS ob, CASE WHEN k % 5 = 0 THEN 'process_failure' END AS sc,
      k % 7 < 4 AS diff, CASE WHEN k % 4 = 3 THEN k % 7 < 4 ELSE k % 7 < 2 END AS eff FROM ({LOGS}))""",
)
def pr48(spark, sf):
    k = F.col("k")
    d = logs(spark, sf).select(
        "k", F.when(k % 9 == 0, 1).otherwise(0).alias("driver_exit_code"), F.when(k % 2 == 0, "failed").alias("failure_excerpt"),
        F.when(k % 3 == 0, "compile_failure").when(k % 3 == 1, "test_failure").alias("target_observation"),
        F.when(k % 5 == 0, "process_failure").alias("scenario_type"), F.col("log").alias("error_text"), (k % 7 < 4).alias("trace_has_difference"),
        F.when(k % 4 != 3, k % 7 < 2).alias("trace_has_effective_difference"), F.lit(False).alias("has_removed_classes"), (k % 4 == 1).alias("has_breaking"),
    )
    return cs.case_status(d).select("k", "status", "failure_kind", "failure_subtype")


_BATCH = """SELECT case_id, k, status, k % 4 = 0 AS timed_out, k % 3 < 2 AS diff, CASE WHEN k % 5 > 0 THEN k % 3 = 0 END AS eff FROM cases WHERE k % 10 < 8"""


@query(
    "ag12_batch_summary",
    b.with_sql("cases")
    + f"""SELECT (SELECT count(*) FROM cases) AS total_cases, count(*) AS completed_cases, count(*) FILTER (timed_out) AS timed_out_cases, count(*) FILTER (diff) AS trace_diff_cases,
    count(*) FILTER (diff AND coalesce(eff, diff)) AS effective_trace_diff_cases, count(*) FILTER (diff AND NOT coalesce(eff, diff)) AS invalid_trace_diff_cases FROM ({_BATCH})""",
)
def ag12(spark, sf):
    c = b.cases(spark, sf)
    k = F.col("k")
    results = c.where("k % 10 < 8").select(
        "case_id", "status", (k % 4 == 0).alias("timed_out"), (k % 3 < 2).alias("trace_has_difference"),
        F.when(k % 5 > 0, k % 3 == 0).alias("trace_has_effective_difference"),
    )
    return cs.batch_summary(c, results)


_DONE = "SELECT coalesce(nullif(status, ''), 'unknown') AS status, CASE k % 4 WHEN 0 THEN 'dependency' WHEN 1 THEN 'symbol' ELSE 'unknown' END AS subtype FROM cases WHERE k % 10 < 8"


@query(
    "ag12_batch_counts",
    b.with_sql("cases")
    + f"""SELECT 'status' AS field, status AS value, count(*) AS cases FROM ({_DONE}) GROUP BY 2
    UNION ALL SELECT 'subtype', subtype, count(*) FROM ({_DONE}) GROUP BY 2""",
)
def ag12_counts(spark, sf):
    c = b.cases(spark, sf)
    k = F.col("k")
    # As in the summary, some scheduled cases have no result yet.
    subtype = F.when(k % 4 == 0, "dependency").when(k % 4 == 1, "symbol").when(k % 4 == 2, "")
    results = c.where("k % 10 < 8").select("case_id", "status", subtype.alias("subtype"))
    return cs.batch_counts(c, results, ["status", "subtype"])


_PRIORITY = "CASE s WHEN 'trace_diff' THEN 5 WHEN 'execution_failure' THEN 3 WHEN 'no_diff' THEN 0 ELSE -1 END"


@query(
    "ag13_best_test",
    f"""SELECT case_id, arg_max(s, ({_PRIORITY}, -p)) AS status, arg_max(p, ({_PRIORITY}, -p)) AS test_pos, count(*) AS test_result_count, count(*) FILTER (s = 'no_diff') AS no_diffs,
    count(*) FILTER (s = 'other') AS others FROM (SELECT 'case-' || l_orderkey AS case_id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS p,
    CASE l_returnflag WHEN 'R' THEN 'execution_failure' WHEN 'A' THEN 'no_diff' ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'trace_diff' ELSE 'other' END END AS s FROM lineitem) GROUP BY 1""",
)
def ag13(spark, sf):
    f = F.col("l_returnflag")
    d = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("case-"), "l_orderkey").alias("case_id"),
        (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("test_pos"),
        F.when(f == "R", "execution_failure").when(f == "A", "no_diff").when(F.col("l_linenumber") % 3 == 0, "trace_diff").otherwise("other").alias("status"),
    )
    t = cs.best_test(d)
    n = lambda s: F.coalesce(F.try_element_at("status_counts", F.lit(s)), F.lit(0))
    return t.select("case_id", "status", "test_pos", "test_result_count", n("no_diff").alias("no_diffs"), n("other").alias("others"))


@query("jn14_resume", b.with_sql("cases") + "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT 'case-' || l_orderkey FROM lineitem WHERE l_quantity > 30)")
def jn14(spark, sf):
    done = b.table(spark, sf, "lineitem").where("l_quantity > 30").select(F.concat(F.lit("case-"), "l_orderkey").alias("case_id"))
    return cs.resume(b.cases(spark, sf).select("case_id"), done)


@query(
    "jn15_backfill_description",
    b.with_sql("cases")
    + """SELECT case_id, coalesce(n.d, 'old ' || (k % 4)) AS description, n.d IS NOT NULL AND 'old ' || (k % 4) <> n.d AS is_changed, n.d IS NULL AS is_missing FROM cases c
    LEFT JOIN (SELECT 'CVE-' || c_custkey AS cve, 'old ' || (c_custkey % 4) AS d FROM customer WHERE c_custkey % 3 > 0) n ON n.cve = c.cve_id""",
)
def jn15(spark, sf):
    cat = b.table(spark, sf, "customer").select(
        F.concat(F.lit("CVE-"), "c_custkey").alias("cve"),
        F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" old "), F.col("c_custkey") % 4)).otherwise(" ").alias("description"),
    )
    c = b.cases(spark, sf).select("case_id", "cve_id", F.concat(F.lit("old "), F.col("k") % 4).alias("description"))
    return cs.backfill_description(c, cat).select("case_id", "description", "is_changed", "is_missing")


@query(
    "so1_merge_batches",
    b.with_sql("cases")
    + """SELECT cve_id, pair_index, arg_min(case_id, (src, k)) AS case_id, min(src) AS src FROM (SELECT cve_id, pair_index, case_id, k, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS src FROM (
    SELECT cve_id, pair_index, min(k) AS k, arg_min(case_id, k) AS case_id FROM cases GROUP BY cve_id, pair_index, k % 2)) GROUP BY 1, 2""",
)
def so1(spark, sf):
    c = b.cases(spark, sf)
    half = lambda r: c.where(F.col("k") % 2 == r).groupBy("cve_id", "pair_index").agg(F.min_by("case_id", "k").alias("case_id")).withColumn("src", F.lit(r))
    return cs.merge_batches(half(0), half(1))


@query(
    "sc7_complete_results",
    b.with_sql("cases")
    + """SELECT case_id, CASE WHEN k % 10 = 9 THEN 'missing_case_result' WHEN k % 10 = 8 THEN 'invalid_case_result_json' WHEN k % 10 = 7 THEN 'unknown' ELSE status END AS status,
    CASE WHEN k % 10 = 9 THEN 'missing_case_result' WHEN k % 10 = 8 THEN 'invalid_case_result_json' ELSE coalesce(failure_subtype, 'none') END AS failure_subtype FROM cases""",
)
def sc7_complete(spark, sf):
    c = b.cases(spark, sf)
    k = F.col("k")
    r = c.where("k % 10 < 9").select(
        "case_id", F.when(k % 10 == 7, " ").otherwise(F.col("status")).alias("status"), "failure_subtype", (k % 10 < 8).alias("is_valid")
    )
    return cs.complete_results(c.select("case_id"), r)
