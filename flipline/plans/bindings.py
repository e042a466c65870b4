"""Roles the test tables play. Each view exists twice, as a DataFrame and as a SQL expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_sql(*views: str) -> str:
    """WITH clause of the named views, in the given order."""
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views) + "\n"


SQL: dict[str, str] = {}

# --- chain: events as a result table ----------------------------------------------------------------------
# event_id grows with ts, so it is the row position; the issues, one per user, interleave. chain_sorted has the same rows
# sorted by issue.
SQL["chain"] = """
SELECT event_id AS row_pos, 'CVE-' || user_id AS CVE_ID, 'lib' || (event_id % 3) AS Library,
  'poc' || (user_id // 50) AS PoC, '1.' || k AS Version,
  CASE event_type WHEN 'error' THEN 'APPEARS' WHEN 'signup' THEN 'BUILD_FAILURE_OTHER' ELSE 'BUILD_SUCCESS' END AS outcome,
  CASE k % 8 WHEN 0 THEN 'not affected_patch' WHEN 1 THEN 'not affected_intro' WHEN 2 THEN 'affected_patch'
    WHEN 3 THEN 'affected_intro' ELSE 'No_Data' END AS verdict,
  CASE WHEN value >= 50 THEN 'affected' ELSE 'not affected' END AS truth
FROM (SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS k FROM events)
"""


def key_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def chain(spark: SparkSession, sf: str) -> DataFrame:
    k = key_k()
    m = k % 8
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_pos"),
        F.concat(F.lit("CVE-"), F.col("user_id")).alias("CVE_ID"),
        F.concat(F.lit("lib"), F.col("event_id") % 3).alias("Library"),
        F.concat(F.lit("poc"), F.expr("user_id div 50")).alias("PoC"),
        F.concat(F.lit("1."), k).alias("Version"),
        F.when(F.col("event_type") == "error", "APPEARS")
        .when(F.col("event_type") == "signup", "BUILD_FAILURE_OTHER")
        .otherwise("BUILD_SUCCESS")
        .alias("outcome"),
        F.when(m == 0, "not affected_patch")
        .when(m == 1, "not affected_intro")
        .when(m == 2, "affected_patch")
        .when(m == 3, "affected_intro")
        .otherwise("No_Data")
        .alias("verdict"),
        F.when(F.col("value") >= 50, "affected").otherwise("not affected").alias("truth"),
    )


#: Rows of one issue are apart by event_id, rows of different issues by at least this much.
SPREAD = 10**12
SQL["chain_sorted"] = f"SELECT * REPLACE (CAST(substr(CVE_ID, 5) AS BIGINT) * {SPREAD} + row_pos AS row_pos) FROM ({SQL['chain']})"


def chain_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The chain with positions that put all rows of an issue together."""
    issue = F.substring("CVE_ID", 5, 20).cast("long")
    return chain(spark, sf).withColumn("row_pos", issue * F.lit(SPREAD) + F.col("row_pos"))


CHAIN = {"outcome": "outcome", "verdict": "verdict"}

# --- scored: labelled documents as judged rows ------------------------------------------------------------
SQL["scored"] = """
SELECT d.doc_id AS row_pos, 'D-' || (d.doc_id % 97) AS cve, d.source AS Library, d.lang AS PoC,
  CASE WHEN l.quality = 1 THEN 'affected' ELSE 'not affected' END AS truth,
  CASE WHEN d.n_chars >= 2000 THEN 'affected_patch' WHEN d.n_chars >= 60 THEN 'not affected_intro' ELSE 'No_Data' END AS verdict
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    n = F.col("n_chars")
    return d.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_pos"),
        F.concat(F.lit("D-"), F.col("doc_id") % 97).alias("cve"),
        F.col("source").alias("Library"),
        F.col("lang").alias("PoC"),
        F.when(F.col("quality") == 1, "affected").otherwise("not affected").alias("truth"),
        F.when(n >= 2000, "affected_patch").when(n >= 60, "not affected_intro").otherwise("No_Data").alias("verdict"),
    )


# --- margins: events as margins of analysis entries -------------------------------------------------------
SQL["margins"] = """
SELECT 'CVE-' || user_id AS cve, '1.' || (user_id % 7) AS version, CAST(ts AS DATE) AS entry_pos,
  (value - 100) / 250 AS margin, event_id FROM events
"""


def margins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("CVE-"), F.col("user_id")).alias("cve"),
        F.concat(F.lit("1."), F.col("user_id") % 7).alias("version"),
        F.to_date("ts").alias("entry_pos"),
        ((F.col("value") - 100) / 250).alias("margin"),
        "event_id",
    )


# --- releases: orders as release histories ----------------------------------------------------------------
SQL["release_rows"] = """
SELECT 'art-' || o_custkey AS artifact, o_orderdate AS release_date, o_orderkey AS pos,
  (o_orderkey % 3) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 7) ||
  CASE o_orderpriority WHEN '5-LOW' THEN '-rc1' WHEN '4-NOT SPECIFIED' THEN '-jdk8' ELSE '' END AS version FROM orders
"""
SQL["releases"] = """
SELECT artifact, version, arg_min(release_date, (release_date, pos)) AS release_date,
  regexp_extract(version, '^[0-9.]+') AS core,
  CASE WHEN version LIKE '%-rc1' THEN 'pre-release' WHEN version LIKE '%-jdk8' THEN 'runtime-fork' ELSE 'stable' END AS kind,
  list_transform(string_split(regexp_extract(version, '^[0-9.]+'), '.'), lambda p: CAST(p AS BIGINT)) AS semver,
  regexp_extract(version, '^\\d+\\.\\d+') AS line_key,
  CASE WHEN version LIKE '%-rc1' THEN 0 WHEN version LIKE '%-jdk8' THEN 2 ELSE 1 END AS stage
FROM release_rows GROUP BY artifact, version
"""


def release_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    suffix = F.when(F.col("o_orderpriority") == "5-LOW", "-rc1").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "-jdk8").otherwise("")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("art-"), F.col("o_custkey")).alias("artifact"),
        F.col("o_orderdate").alias("release_date"),
        k.alias("pos"),
        F.concat(k % 3, F.lit("."), k % 5, F.lit("."), k % 7, suffix).alias("version"),
    )


def releases(spark: SparkSession, sf: str) -> DataFrame:
    from flipline.operators.lineage import release_history

    return release_history(release_rows(spark, sf))


# --- tested: orders as tested versions of the artifacts ----------------------------------------------------
SQL["tested"] = """
SELECT 'art-' || o_custkey AS artifact, o_orderkey AS row_pos,
  CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 3) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 7)
    WHEN 1 THEN 'v' || (o_orderkey % 3) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 7)
    WHEN 2 THEN (o_orderkey % 3) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 7) || '-rc1' ELSE 'x' || (o_orderkey % 11) END AS version,
  CASE WHEN o_orderkey % 2 = 0 THEN 'APPEARS' WHEN o_orderkey % 3 = 0 THEN 'BUILD_FAILURE_OTHER' ELSE 'BUILD_SUCCESS' END AS outcome,
  'cause ' || (o_orderkey % 6) AS cause FROM orders
"""


def tested(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    core = F.concat(k % 3, F.lit("."), k % 5, F.lit("."), k % 7)
    m = k % 4
    return table(spark, sf, "orders").select(
        F.concat(F.lit("art-"), F.col("o_custkey")).alias("artifact"),
        k.alias("row_pos"),
        F.when(m == 0, core)
        .when(m == 1, F.concat(F.lit("v"), core))
        .when(m == 2, F.concat(core, F.lit("-rc1")))
        .otherwise(F.concat(F.lit("x"), k % 11))
        .alias("version"),
        F.when(k % 2 == 0, "APPEARS").when(k % 3 == 0, "BUILD_FAILURE_OTHER").otherwise("BUILD_SUCCESS").alias("outcome"),
        F.concat(F.lit("cause "), k % 6).alias("cause"),
    )


# --- calls: events as call traces, a user against the next one ---------------------------------------------
# Positions are ranks inside a user's trace, computed across blocks.
SQL["trace_rows"] = """
SELECT user_id, event_type AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events
"""
SQL["calls"] = """
SELECT 'case-' || user_id AS case_id, 'baseline' AS side, pos, symbol FROM trace_rows
UNION ALL SELECT 'case-' || (user_id - 1), 'target', pos, symbol FROM trace_rows WHERE user_id > 0
"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    from flipline.operators.scans import positions

    e = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("symbol"))
    t = positions(e, "user_id", "event_id", "pos", start=0)
    side = F.explode(
        F.filter(
            F.array(
                F.struct(F.col("user_id").alias("u"), F.lit("baseline").alias("side")),
                F.struct((F.col("user_id") - 1).alias("u"), F.lit("target").alias("side")),
            ),
            lambda s: s["u"] >= 0,
        )
    )
    return t.select(side.alias("s"), "pos", "symbol").select(
        F.concat(F.lit("case-"), F.col("s.u")).alias("case_id"), "s.side", "pos", "symbol"
    )


# --- members: line items as class members of two sides ------------------------------------------------------
SQL["members"] = """
SELECT 'case-' || l_suppkey AS case_id, CASE l_linestatus WHEN 'F' THEN 'baseline' ELSE 'target' END AS side,
  'com.lib.C' || (l_partkey % 50) AS class_name,
  CASE l_returnflag WHEN 'A' THEN 'constructors' WHEN 'N' THEN 'methods' ELSE 'fields' END AS kind,
  'm' || l_linenumber || '(' || (l_partkey % 4) || ')' AS symbol,
  'sha-' || (l_quantity % 3) AS sha FROM lineitem
"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("case-"), F.col("l_suppkey")).alias("case_id"),
        F.when(F.col("l_linestatus") == "F", "baseline").otherwise("target").alias("side"),
        F.concat(F.lit("com.lib.C"), F.col("l_partkey") % 50).alias("class_name"),
        F.when(flag == "A", "constructors").when(flag == "N", "methods").otherwise("fields").alias("kind"),
        F.concat(F.lit("m"), F.col("l_linenumber"), F.lit("("), F.col("l_partkey") % 4, F.lit(")")).alias("symbol"),
        F.concat(F.lit("sha-"), F.col("l_quantity") % 3).alias("sha"),
    )


# --- cases: orders as batch cases ---------------------------------------------------------------------------
SQL["cases"] = """
SELECT 'case-' || o_orderkey AS case_id, o_orderkey AS k, 'CVE-' || o_custkey AS cve_id, CAST(o_orderkey % 13 AS INT) AS pair_index,
  CASE o_orderstatus WHEN 'F' THEN 'trace_diff' WHEN 'O' THEN 'execution_failure' ELSE 'no_diff' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'missing_class' WHEN '2-HIGH' THEN 'trace_difference' WHEN '3-MEDIUM' THEN 'invalid_trace_difference'
    WHEN '4-NOT SPECIFIED' THEN 'toolchain_incompatibility' ELSE NULL END AS failure_subtype,
  o_orderkey % 2 = 0 AS seek_patch, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS compile,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) AS score,
  (o_orderkey % 3) || '.' || (o_orderkey % 5) AS baseline_version, (o_orderkey % 3) || '.' || (o_orderkey % 7) AS target_version
FROM orders
"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("case-"), k).alias("case_id"),
        k.alias("k"),
        F.concat(F.lit("CVE-"), F.col("o_custkey")).alias("cve_id"),
        (k % 13).cast("int").alias("pair_index"),
        F.when(s == "F", "trace_diff").when(s == "O", "execution_failure").otherwise("no_diff").alias("status"),
        F.when(p == "1-URGENT", "missing_class")
        .when(p == "2-HIGH", "trace_difference")
        .when(p == "3-MEDIUM", "invalid_trace_difference")
        .when(p == "4-NOT SPECIFIED", "toolchain_incompatibility")
        .alias("failure_subtype"),
        (k % 2 == 0).alias("seek_patch"),
        F.when(k % 5 != 0, k % 3 == 0).alias("compile"),
        (F.floor("o_totalprice") % 101).cast("int").alias("score"),
        F.concat(k % 3, F.lit("."), k % 5).alias("baseline_version"),
        F.concat(k % 3, F.lit("."), k % 7).alias("target_version"),
    )


# --- runlog, usage: events as append-only logs --------------------------------------------------------------
SQL["runlog"] = """
SELECT event_id AS pos, 'case-' || (event_id % 37) AS case_id, event_type = 'error' AS timed_out,
  CASE WHEN event_id % 997 = 0 THEN 1 ELSE 2 + event_id % 50 END AS progress_index, 60 AS progress_total,
  event_id // 997 AS run FROM events
"""


def runlog(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("pos"),
        F.concat(F.lit("case-"), e % 37).alias("case_id"),
        (F.col("event_type") == "error").alias("timed_out"),
        F.when(e % 997 == 0, F.lit(1)).otherwise(2 + e % 50).cast("int").alias("progress_index"),
        F.lit(60).alias("progress_total"),
        F.expr("event_id div 997").alias("run"),
    )


SQL["usage_rows"] = """
SELECT ts, event_type AS method, 'model-' || (user_id % 4) AS model, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS prompt_tokens,
  CAST(floor(value) AS BIGINT) AS completion_tokens FROM events
"""


def usage_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "ts",
        F.col("event_type").alias("method"),
        F.concat(F.lit("model-"), F.col("user_id") % 4).alias("model"),
        key_k().cast("bigint").alias("prompt_tokens"),
        F.floor("value").cast("bigint").alias("completion_tokens"),
    )


# --- categories: customers as issues with categories --------------------------------------------------------
SQL["catalog_cats"] = """
SELECT 'CVE-' || c.c_custkey AS cve, CASE WHEN c.c_custkey % 5 = 0 THEN [r.r_name, 'NAT-' || n.n_nationkey] ELSE [r.r_name] END AS cwe
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def catalog_cats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    two = F.array("r_name", F.concat(F.lit("NAT-"), F.col("n_nationkey")))
    return d.select(
        F.concat(F.lit("CVE-"), F.col("c_custkey")).alias("cve"),
        F.when(F.col("c_custkey") % 5 == 0, two).otherwise(F.array("r_name")).alias("cwe"),
    )


# --- phrases: log and evidence texts composed from key arithmetic -------------------------------------------
def phrases(key: str, table_: list[tuple[int, int, str]]) -> tuple[Column, str]:
    """Text of all phrases whose ``key % modulus = rest`` holds, as a Column and as SQL."""
    parts = [F.when(F.col(key) % m == r, F.lit(p)) for m, r, p in table_]
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    sql = [f"CASE WHEN {key} % {m} = {r} THEN {quoted(p)} END" for m, r, p in table_]
    return F.concat_ws("\n", *parts), "concat_ws(chr(10), " + ", ".join(sql) + ")"


LOG_PHRASES = [
    (5, 0, "[INFO] Scanning for projects"),
    (7, 1, "COMPILATION ERROR : "),
    (11, 2, "Failed to execute goal org:plugin:compile (default)"),
    (13, 3, "Could not resolve dependencies for project"),
    (6, 4, "There are test failures."),
    (9, 5, "java.lang.NoSuchMethodError: a.b.C.d()"),
    (10, 6, "error: cannot find symbol class Foo"),
    (14, 7, "Caused by: java.lang.VerifyError"),
    (15, 8, "BUILD FAILURE"),
    (17, 9, "invalid target release: 17"),
    (19, 10, "error: package org.foo does not exist"),
    (21, 11, "no suitable constructor found for Foo"),
    (22, 12, "java.lang.ArrayIndexOutOfBoundsException at org.objectweb.asm.ClassReader"),
    (23, 13, "Agent library failed to init: instrument"),
    (8, 7, "Status: trace_diff  "),
    (26, 14, "Exploit demo not found under root"),
    (27, 15, "command timed out after 3600 s"),
    (28, 16, "Result: /tmp/out.json"),
    (29, 17, "Baseline version 1.0 did not complete successfully"),
    (16, 3, "Target version 2.0 did not complete successfully"),
    (31, 5, "Artifact file does not exist: /m2/x.jar"),
    (33, 6, "java.lang.NoClassDefFoundError: a/B"),
]
EVIDENCE_PHRASES = [
    (5, 0, "The target added a new validation guard for type names."),
    (7, 1, "SubTypeValidator rejects the payload."),
    (11, 2, "Method was removed from target, cannot find symbol."),
    (13, 3, "java.lang.NoSuchMethodError at replay"),
    (6, 4, "The constructor signature changed after refactoring."),
    (9, 5, "This is most likely a behavior change on the fallback path."),
    (10, 6, "A different factory on the classpath may be used."),
    (17, 9, "Security hardening blocks external entities; entity resolution is disabled."),
    (19, 10, "More logs would confirm it."),
    (23, 13, "Extra runtime checks with an allowlist were introduced."),
    (29, 17, "VerifyError from a mixed legacy classpath"),
]
