"""Queries: verdicts along chains, run logs, roll-ups, the threshold sweep, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipline.operators import chains as ch
from flipline.operators import verdicts as vd
from flipline.plans import bindings as b
from flipline.plans.registry import query

NAMES = dict(outcome="outcome", verdict="verdict")

# Runs are of adjacent rows: {p}run counts the rows whose key differs from that of the row just before them.
_RUN = """SELECT *, sum({p}chg) OVER (ORDER BY row_pos) AS {p}run FROM (
  SELECT *, CASE WHEN {key} = lag({key}) OVER (ORDER BY row_pos) THEN 0 ELSE 1 END AS {p}chg FROM ({src}))"""
# Label before and after each row inside a run: the last and next value that is not No_Data.
_KNOWN = """
SELECT *, last_value(CASE WHEN v <> 'No_Data' THEN v END IGNORE NULLS) OVER (PARTITION BY {p}run ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {p}b,
  first_value(CASE WHEN v <> 'No_Data' THEN v END IGNORE NULLS) OVER (PARTITION BY {p}run ORDER BY row_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {p}a FROM ({src})
"""
_STEP1 = "SELECT *, CASE WHEN verdict = 'No_Data' AND outcome = 'APPEARS' THEN 'affected' ELSE verdict END AS v FROM {table}"


def _known(key: str, p: str, src: str) -> str:
    return _KNOWN.format(p=p, src=_RUN.format(p=p, key=key, src=src))


def _an1(table: str) -> str:
    both = _known("(CVE_ID, Library)", "b", _known("CVE_ID", "f", _STEP1.format(table=table)))
    return f"""SELECT row_pos, CASE WHEN v <> 'No_Data' THEN v WHEN fb = 'not affected_patch' THEN fb WHEN ba = 'not affected_intro' THEN ba ELSE v END AS verdict FROM ({both})"""


@query("an1_propagate_default", b.with_sql("chain") + _an1("chain"))
def an1(spark, sf):
    return ch.propagate_default(b.chain(spark, sf), **NAMES).select("row_pos", "verdict")


@query("an1_propagate_sorted", b.with_sql("chain_sorted") + _an1("chain_sorted"))
def an1_sorted(spark, sf):
    return ch.propagate_default(b.chain_sorted(spark, sf), contiguous=True, **NAMES).select("row_pos", "verdict")


def _an2(table: str) -> str:
    runs = _known("(CVE_ID, Library, outcome = 'APPEARS', PoC)", "r", _STEP1.format(table=table))
    return f"""SELECT row_pos, CASE WHEN v <> 'No_Data' THEN v WHEN rb = 'not affected_patch' THEN rb WHEN ra = 'not affected_intro' THEN ra
  WHEN rb = 'affected_patch' THEN rb WHEN ra = 'affected_patch' THEN ra WHEN ra = 'affected_intro' THEN ra WHEN rb = 'affected_intro' THEN rb ELSE v END AS verdict,
  CVE_ID, Library, PoC, outcome, outcome = 'APPEARS' AS bucket FROM ({runs})"""


_AN2 = _an2("chain")


@query("an2_propagate_full", b.with_sql("chain") + f"SELECT row_pos, verdict FROM ({_AN2})")
def an2(spark, sf):
    return ch.propagate_full(b.chain(spark, sf), **NAMES).select("row_pos", "verdict")


@query("an2_propagate_sorted", b.with_sql("chain_sorted") + f"SELECT row_pos, verdict FROM ({_an2('chain_sorted')})")
def an2_sorted(spark, sf):
    return ch.propagate_full(b.chain_sorted(spark, sf), contiguous=True, **NAMES).select("row_pos", "verdict")


_NEAR = " OR ".join(
    f"""coalesce({fn}(CVE_ID) OVER w = CVE_ID AND {fn}(Library) OVER w = Library AND {fn}(PoC) OVER w = PoC AND {fn}(bucket) OVER w <> bucket
    AND (verdict IN ('affected_intro', 'affected_patch') OR {fn}(verdict) OVER w IN ('affected_intro', 'affected_patch')), false)"""
    for fn in ("lag", "lead")
)


def _an3(table: str) -> str:
    return f"""SELECT row_pos, z AS in_conflict_zone, CASE WHEN z THEN 0.5 ELSE 0.0 END AS refinement_score,
    CASE WHEN z THEN 'abstain_low_confidence' ELSE 'skipped_no_conflict' END AS refinement_decision FROM (
    SELECT row_pos, {_NEAR} AS z FROM ({_an2(table)}) WINDOW w AS (ORDER BY row_pos))"""


_AN3_COLUMNS = ["row_pos", "in_conflict_zone", "refinement_score", "refinement_decision"]


@query("an3_conflict_zone", b.with_sql("chain") + _an3("chain"))
def an3(spark, sf):
    return ch.conflict_zone(ch.propagate_full(b.chain(spark, sf), **NAMES), **NAMES).select(_AN3_COLUMNS)


@query("an3_conflict_zone_sorted", b.with_sql("chain_sorted") + _an3("chain_sorted"))
def an3_sorted(spark, sf):
    full = ch.propagate_full(b.chain_sorted(spark, sf), contiguous=True, **NAMES)
    return ch.conflict_zone(full, contiguous=True, **NAMES).select(_AN3_COLUMNS)


_AN4 = """
SELECT row_pos, CASE WHEN i THEN 'not affected_intro' WHEN p THEN 'not affected_patch' ELSE verdict END AS verdict,
  CASE WHEN i THEN 'introduction' WHEN p THEN 'patch' END AS boundary_mode, CAST(i AS INT) + CAST(p AS INT) AS boundary_hits,
  CASE WHEN NOT (i OR p) THEN 'No_Data' WHEN truth = 'not affected' THEN 'T' ELSE 'FN' END AS Aligned_llm FROM (
SELECT *, o AND coalesce(lead(outcome) OVER w = 'APPEARS', false) AS i, o AND coalesce(lag(outcome) OVER w = 'APPEARS', false) AS p FROM (
SELECT *, outcome <> 'APPEARS' AND verdict = 'No_Data' AS o FROM chain) WINDOW w AS (PARTITION BY CVE_ID ORDER BY row_pos))
"""


def _inferred(spark, sf):
    return ch.infer_boundaries(b.chain(spark, sf), truth="truth", **NAMES)


@query("an4_infer_boundaries", b.with_sql("chain") + _AN4)
def an4(spark, sf):
    return _inferred(spark, sf).select("row_pos", "verdict", "boundary_mode", "boundary_hits", "Aligned_llm")


@query(
    "an4_boundary_summary",
    b.with_sql("chain")
    + f"""SELECT sum(boundary_hits)::BIGINT AS total_boundary_hits, count(boundary_mode) AS written_rows, count(*) FILTER (boundary_mode = 'introduction') AS written_introduction,
    count(*) FILTER (boundary_mode = 'patch') AS written_patch, count(*) FILTER (boundary_hits > 1) AS multi_mode_rows, 0 AS tp,
    count(*) FILTER (Aligned_llm = 'T') AS tn, 0 AS fp, count(*) FILTER (Aligned_llm = 'FN') AS fn FROM ({_AN4})""",
)
def an4_summary(spark, sf):
    return ch.boundary_summary(_inferred(spark, sf), verdict="verdict")


_LAST = "SELECT * FROM runlog WHERE pos >= (SELECT max(pos) FROM runlog WHERE progress_index = 1)"


@query("an10_latest_run", b.with_sql("runlog") + f"SELECT pos, case_id, progress_index FROM ({_LAST})")
def an10(spark, sf):
    return ch.latest_run(b.runlog(spark, sf), "pos").select("pos", "case_id", "progress_index")


@query(
    "an10_latest_run_state",
    b.with_sql("runlog") + f"SELECT count(DISTINCT case_id) AS completed_count, max(progress_total)::BIGINT AS progress_total FROM ({_LAST})",
)
def an10_state(spark, sf):
    return ch.latest_run_state(b.runlog(spark, sf), "pos")


@query(
    "an11_dedupe_first",
    b.with_sql("tested") + "SELECT artifact, version, min(row_pos) AS row_pos, arg_min(outcome, row_pos) AS outcome FROM tested GROUP BY 1, 2",
)
def an11(spark, sf):
    return ch.dedupe_first(b.tested(spark, sf).drop("cause"), ["artifact", "version"], "row_pos")


# --- roll-ups ---------------------------------------------------------------------------------------------

_PAYLOAD = """SELECT 'CVE-' || (l_orderkey % 500) AS cve, '2.' || (l_orderkey % 9) AS version, l_orderkey,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 4 END AS score, l_tax * 4 AS msg_score FROM lineitem"""


def _payload(spark, sf):
    """One analysis entry per order: a map of commits to files to scores, built from its lines."""
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    info = F.struct(
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 4).alias("score"), (F.col("l_tax") * 4).alias("msg_score")
    )
    one = F.create_map(F.concat(F.lit("commit"), F.col("l_linenumber")), F.create_map(F.concat(F.lit("f"), F.col("l_partkey")), info))
    return li.select(
        F.concat(F.lit("CVE-"), F.col("l_orderkey") % 500).alias("cve"),
        F.concat(F.lit("2."), F.col("l_orderkey") % 9).alias("version"),
        vd.best_score(one).alias("score"),
    )


@query(
    "ag7_patch_rollup",
    f"SELECT cve, version, max(coalesce(score, msg_score)) >= 0.3 AS is_passed FROM ({_PAYLOAD}) GROUP BY 1, 2",
)
def ag7(spark, sf):
    return vd.patch_rollup(_payload(spark, sf))


_AG8 = """SELECT cve, version, min(m) AS weakest_margin FROM (SELECT cve, version, entry_pos, max(margin) AS m FROM margins GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("ag8_margin_rollup", b.with_sql("margins") + f"SELECT *, weakest_margin < -0.05 AS is_affected FROM ({_AG8})")
def ag8(spark, sf):
    # Margins enter as nested JSON, the form analysis files have.
    js = F.to_json(F.struct(F.array(F.struct(F.struct("margin").alias("hunk"))).alias("commits")))
    d = b.margins(spark, sf).withColumn("margin", vd.max_margin(js))
    return vd.margin_verdict(vd.margin_rollup(d))


_SWEEP_ROWS = f"""SELECT c.truth, w.weakest_margin FROM chain c JOIN ({_AG8}) w ON c.CVE_ID = w.cve"""
_GRID = ", ".join(str(t) for t in vd.SWEEP_GRID)


@query(
    "ag9_threshold_sweep",
    b.with_sql("chain", "margins")
    + f"""SELECT threshold, count(*) AS total, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn,
    count(*) FILTER (NOT t AND NOT p) AS tn, (count(*) FILTER (t = p)) / count(*) AS accuracy FROM (
    SELECT threshold, truth = 'affected' AS t, weakest_margin < threshold AS p FROM ({_SWEEP_ROWS}), (SELECT unnest([{_GRID}])::DOUBLE AS threshold)) GROUP BY 1""",
)
def ag9(spark, sf):
    w = vd.margin_rollup(b.margins(spark, sf)).select(F.col("cve").alias("CVE_ID"), "weakest_margin")
    rows = b.chain(spark, sf).select("CVE_ID", "truth").join(w, "CVE_ID")
    return vd.threshold_sweep(rows)


@query(
    "ag10_commit_rollup",
    "SELECT 'CVE-' || (o_custkey % 300) AS cve, '3.' || (o_custkey % 4) AS version, bool_or(o_orderkey % 6 = 0) AS is_affected FROM orders GROUP BY 1, 2",
)
def ag10(spark, sf):
    k = F.col("o_orderkey")
    commits = F.slice(F.array(*[F.concat(F.lit(f"c{i}-"), k) for i in range(5)]), F.lit(1), (k % 6).cast("int"))
    d = b.table(spark, sf, "orders").select(
        F.concat(F.lit("CVE-"), F.col("o_custkey") % 300).alias("cve"),
        F.concat(F.lit("3."), F.col("o_custkey") % 4).alias("version"),
        commits.alias("intro_commits"),
    )
    return vd.commit_rollup(d)


_PRED = """SELECT case_id, cve_id, target_version, CASE WHEN k % 11 < 4 THEN 'affected' WHEN k % 11 < 9 THEN 'not affected' ELSE 'maybe' END AS l FROM cases"""
_RESOLVED = f"""SELECT cve_id AS cve, target_version AS version, count(*) FILTER (l = 'affected') AS affected_count, count(*) FILTER (l = 'not affected') AS not_affected_count,
  count(*) FILTER (l = 'maybe') AS unknown_count, CASE WHEN bool_or(l = 'affected') THEN 'affected' WHEN bool_or(l = 'not affected') THEN 'not affected' ELSE 'unknown' END AS resolved,
  bool_or(l = 'affected') AND bool_or(l = 'not affected') AS is_conflict FROM ({_PRED}) GROUP BY 1, 2"""


def _predicted(spark, sf):
    m = F.col("k") % 11
    label = F.when(m < 4, "affected").when(m < 9, "Not affected ").otherwise("maybe")
    return b.cases(spark, sf).select("case_id", "cve_id", "target_version", label.alias("predicted_label"))


@query("ag11_resolve_conflicts", b.with_sql("cases") + _RESOLVED)
def ag11(spark, sf):
    return vd.resolve_conflicts(_predicted(spark, sf))


@query(
    "ag11_conflict_cases",
    b.with_sql("cases")
    + f"SELECT p.case_id, p.cve_id AS cve, p.target_version AS version, replace(p.l, 'maybe', 'unknown') AS label FROM ({_PRED}) p JOIN ({_RESOLVED}) r ON p.cve_id = r.cve AND p.target_version = r.version WHERE r.is_conflict",
)
def ag11_cases(spark, sf):
    d = _predicted(spark, sf)
    return vd.conflict_cases(d, vd.resolve_conflicts(d)).select("case_id", "cve", "version", "label")


# --- pair truth and overlays ------------------------------------------------------------------------------

_PAIRS = """SELECT 'CVE-' || o_custkey AS cve, o_orderkey AS pair_index, 'V' || (o_orderkey % 3) AS BASE_TAG, 'v' || (o_orderkey % 4) AS HEAD_TAG,
  '1.' || (o_orderkey % 100) AS ver FROM orders"""
_ENTRIES = """SELECT 'CVE-' || user_id AS cve, event_id AS entry_pos, 'v' || (event_id % 3) AS base_tag, 'V' || (event_id % 4) AS head_tag FROM events"""


def _pairs(spark, sf):
    k = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(
        F.concat(F.lit("CVE-"), F.col("o_custkey")).alias("cve"),
        k.alias("pair_index"),
        F.concat(F.lit("V"), k % 3).alias("BASE_TAG"),
        F.concat(F.lit("v"), k % 4).alias("HEAD_TAG"),
        F.concat(F.lit("1."), k % 100).alias("not appears"),
    )


def _entries(spark, sf):
    e = F.col("event_id")
    return b.table(spark, sf, "events").select(
        F.concat(F.lit("cve-"), F.col("user_id")).alias("cve"),
        e.alias("entry_pos"),
        F.concat(F.lit("v"), e % 3).alias("base_tag"),
        F.concat(F.lit(" V"), e % 4).alias("head_tag"),
        ((F.col("value") - 100) / 250).alias("margin"),
    )


def _pair_sql(keys, extra=""):
    on = " AND ".join(f"lower(e.{k.lower()}) = p.{k}" for k in keys)
    group = ", ".join(f"lower({k}) AS {k}" for k in keys)
    return f"""SELECT e.cve, e.entry_pos, p.ver AS version{extra} FROM ({_ENTRIES}) e JOIN (
      SELECT cve, {group}, arg_max(ver, pair_index) AS ver FROM ({_PAIRS}) GROUP BY ALL) p ON e.cve = p.cve AND {on}"""


@query("jn2_pair_truth_two_keys", _pair_sql(["BASE_TAG"]))
def jn2_two(spark, sf):
    return vd.join_pair_truth(_entries(spark, sf), _pairs(spark, sf), False).select("cve", "entry_pos", "version")


@query("jn2_pair_truth_three_keys", _pair_sql(["BASE_TAG", "HEAD_TAG"]))
def jn2_three(spark, sf):
    return vd.join_pair_truth(_entries(spark, sf), _pairs(spark, sf), True).select("cve", "entry_pos", "version")


_PASS = "SELECT CVE_ID AS cve, Version AS version, max(row_pos) % 3 = 0 AS f FROM chain WHERE row_pos % 2 = 0 GROUP BY 1, 2"


def _flags(spark, sf, name):
    d = b.chain(spark, sf).where("row_pos % 2 = 0").groupBy(F.col("CVE_ID").alias("cve"), F.col("Version").alias("version"))
    return d.agg((F.max("row_pos") % 3 == 0).alias(name))


@query(
    "jn3_overlay_patch",
    b.with_sql("chain")
    + f"""SELECT c.row_pos, CASE WHEN h THEN CASE WHEN f THEN 'not affected_patch' ELSE 'affected_patch' END ELSE verdict END AS verdict,
    CASE WHEN NOT h THEN 'No_Data' WHEN f THEN CASE truth WHEN 'not affected' THEN 'T' ELSE 'FN' END ELSE CASE truth WHEN 'affected' THEN 'T' ELSE 'FP' END END AS Aligned_llm
    FROM (SELECT c.*, p.f, p.f IS NOT NULL AND c.outcome <> 'APPEARS' AS h FROM chain c LEFT JOIN ({_PASS}) p ON c.CVE_ID = p.cve AND c.Version = p.version) c""",
)
def jn3_patch(spark, sf):
    out = vd.overlay_patch(b.chain(spark, sf), _flags(spark, sf, "is_passed"), truth="truth", **NAMES)
    return out.select("row_pos", "verdict", "Aligned_llm")


@query(
    "jn3_overlay_intro",
    b.with_sql("chain")
    + f"""SELECT c.row_pos, CASE WHEN f IS NULL THEN 'No_Data' WHEN f THEN 'affected_intro' ELSE 'not affected_intro' END AS verdict,
    CASE WHEN f IS NULL THEN 'No_Data' WHEN f = (truth = 'affected') THEN 'T' WHEN f THEN 'FP' ELSE 'FN' END AS Aligned_llm
    FROM chain c LEFT JOIN ({_PASS}) p ON c.CVE_ID = p.cve AND c.Version = p.version""",
)
def jn3_intro(spark, sf):
    out = vd.overlay_intro(b.chain(spark, sf), _flags(spark, sf, "is_affected"), truth="truth", verdict="verdict")
    return out.select("row_pos", "verdict", "Aligned_llm")


_EVALUATED = """SELECT 'CVE-' || (k % 400) AS cve, '1.' || (k % 100) AS version, CASE WHEN bool_or(k % 400 % 11 < 4) THEN 'affected'
  WHEN bool_or(k % 400 % 11 < 9) THEN 'not affected' END AS l FROM cases GROUP BY 1, 2"""


@query(
    "jn3_overlay_resolved",
    b.with_sql("chain", "cases")
    + f"""SELECT c.row_pos, coalesce(r.l || '_intro', verdict) AS verdict,
    CASE WHEN r.l IS NULL THEN 'No_Data' WHEN r.l = truth THEN 'T' WHEN r.l = 'affected' THEN 'FP' ELSE 'FN' END AS Aligned_llm
    FROM chain c LEFT JOIN ({_EVALUATED}) r ON c.CVE_ID = r.cve AND c.Version = r.version""",
)
def jn3_resolved(spark, sf):
    k, m = F.col("k"), F.col("k") % 400 % 11
    evaluated = b.cases(spark, sf).select(
        F.concat(F.lit("CVE-"), k % 400).alias("cve_id"),
        F.concat(F.lit("1."), k % 100).alias("target_version"),
        F.when(m < 4, "affected").when(m < 9, "not affected").otherwise("maybe").alias("predicted_label"),
    )
    out = vd.overlay_resolved(b.chain(spark, sf), vd.resolve_conflicts(evaluated), truth="truth", verdict="verdict")
    return out.select("row_pos", "verdict", "Aligned_llm")


@query(
    "verdicts_per_issue",
    b.with_sql("chain")
    + f"""SELECT CVE_ID, count(*) AS n, count(*) FILTER (verdict = 'No_Data') AS undecided, count(*) FILTER (starts_with(verdict, 'affected')) AS affected FROM ({_AN2}) GROUP BY 1""",
)
def verdicts_per_issue(spark, sf):
    """Spread verdicts along the chains and count the outcome per issue."""
    d = ch.propagate_full(b.chain(spark, sf), **NAMES)
    return d.groupBy("CVE_ID").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "No_Data").alias("undecided"),
        F.count_if(F.col("verdict").startswith("affected")).alias("affected"),
    )
