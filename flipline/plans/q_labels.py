"""Queries: label scalars, alignment, confusion metrics, rankings, category reports, truth joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipline.functions import labels as lb
from flipline.functions.text import clean_text, raw_text
from flipline.operators import evaluate as ev
from flipline.plans import bindings as b
from flipline.plans.registry import query

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


@query(
    "pr1_clean_text",
    f"""SELECT doc_id, length(t) AS n, md5(t) AS h FROM
    (SELECT doc_id, trim(CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(9) || ' ' || text || chr(10) || chr(160) END, {_WS}) AS t FROM documents)""",
)
def pr1(spark, sf):
    padded = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("\t "), F.col("text"), F.lit("\n\xa0")))
    d = b.table(spark, sf, "documents").select("doc_id", clean_text(padded).alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("h"))


@query(
    "pr2_raw_text",
    b.with_sql("chain") + "SELECT coalesce(CASE WHEN verdict <> 'No_Data' THEN trim(verdict) END, 'nan') AS v, count(*) AS n FROM chain GROUP BY 1",
)
def pr2(spark, sf):
    v = F.when(F.col("verdict") != "No_Data", F.concat(F.lit(" "), "verdict", F.lit("\n")))
    return b.chain(spark, sf).groupBy(raw_text(v).alias("v")).agg(F.count(F.lit(1)).alias("n"))


_LABEL_SQL = """SELECT verdict, truth, outcome, Library, {expr}, count(*) AS n FROM chain GROUP BY ALL"""


def _label_query(name, sql_expr, **makers):
    @query(name, b.with_sql("chain") + _LABEL_SQL.format(expr=sql_expr))
    def run(spark, sf):
        keys = ["verdict", "truth", "outcome", "Library"]
        return b.chain(spark, sf).groupBy(*keys, *[c().alias(n) for n, c in makers.items()]).agg(F.count(F.lit(1)).alias("n"))

    return run


_label_query(
    "pr3_polarity",
    "CASE WHEN contains(lower(verdict), 'affected') AND NOT starts_with(lower(verdict), 'not') THEN 'POS' ELSE 'NEG' END AS p",
    p=lambda: lb.polarity("verdict"),
)
_label_query(
    "pr4_truth01",
    "CASE lower(trim(truth)) WHEN 'affected' THEN 1 WHEN 'not affected' THEN 0 END AS t, CASE lower(verdict) WHEN 'affected' THEN 1 WHEN 'not affected' THEN 0 END AS v",
    t=lambda: lb.truth01("truth"),
    v=lambda: lb.truth01("verdict"),
)
_label_query(
    "pr5_verdict01",
    "CASE WHEN starts_with(lower(verdict), 'affected') THEN 1 ELSE 0 END AS v",
    v=lambda: lb.verdict01("verdict"),
)
_label_query("pr6_outcome01", "CASE WHEN upper(trim(outcome)) = 'APPEARS' THEN 1 ELSE 0 END AS o", o=lambda: lb.outcome01("outcome"))
_label_query(
    "pr7_pred_state",
    "CASE WHEN contains(verdict, 'affected') AND NOT starts_with(verdict, 'not ') THEN 'affected' WHEN starts_with(verdict, 'not affected') THEN 'not affected' ELSE '' END AS p",
    p=lambda: lb.pred_state("verdict"),
)
_label_query(
    "pr8_outcome_flags",
    "outcome = 'APPEARS' AS ok, outcome <> 'APPEARS' AS failed, outcome <> 'BUILD_FAILURE_OTHER' AS compiled, CASE WHEN outcome = 'APPEARS' THEN 'APPEARS' ELSE 'OTHER' END AS bucket",
    ok=lambda: lb.outcome_success("outcome"),
    failed=lambda: lb.outcome_failure("outcome"),
    compiled=lambda: lb.outcome_compiled("outcome"),
    bucket=lambda: lb.outcome_bucket("outcome"),
)


@query(
    "pr9_map_status",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'APPEARS' WHEN 'O' THEN 'BUILD_FAILURE_OTHER' ELSE o_orderpriority END AS s, count(*) AS n FROM orders GROUP BY 1""",
)
def pr9(spark, sf):
    s = F.col("o_orderstatus")
    word = F.when(s == "F", " Appears").when(s == "O", "NOT appears").otherwise(F.col("o_orderpriority"))
    return b.table(spark, sf, "orders").groupBy(lb.map_status(word).alias("s")).agg(F.count(F.lit(1)).alias("n"))


_label_query("pr10_buildable", "outcome <> 'APPEARS' AS ok", ok=lambda: lb.buildable("outcome"))

_ALIGN = {
    "polarity": """CASE WHEN (truth = 'affected') = (starts_with(verdict, 'affected')) THEN 'T' WHEN starts_with(verdict, 'affected') THEN 'FP' ELSE 'FN' END""",
    "three_state": """CASE WHEN verdict = 'No_Data' THEN 'No_Data' WHEN (truth = 'affected') = (starts_with(verdict, 'affected')) THEN 'T' WHEN truth = 'affected' THEN 'FN' ELSE 'FP' END""",
    "prediction": """CASE WHEN verdict <> 'No_Data' AND (truth = 'affected') = (starts_with(verdict, 'affected')) THEN 'T' WHEN starts_with(verdict, 'affected') THEN 'FP' ELSE 'FN' END""",
}


@query(
    "ag2_align",
    b.with_sql("chain")
    + "SELECT verdict, truth, "
    + ", ".join(f"{e} AS {n}" for n, e in _ALIGN.items())
    + """, CASE WHEN verdict = 'No_Data' THEN 'ABSTAIN' WHEN starts_with(verdict, 'affected') THEN CASE truth WHEN 'affected' THEN 'TP' ELSE 'FP' END
      ELSE CASE truth WHEN 'affected' THEN 'FN' ELSE 'TN' END END AS outcome, count(*) AS n FROM chain GROUP BY ALL""",
)
def ag2(spark, sf):
    d = b.chain(spark, sf)
    simple = F.coalesce(F.nullif(lb.pred_state("verdict"), F.lit("")), F.lit("unknown"))
    return d.groupBy(
        "verdict",
        "truth",
        *[lb.ALIGN_STYLES[n]("truth", "verdict").alias(n) for n in _ALIGN],
        lb.align_outcome("truth", simple).alias("outcome"),
    ).agg(F.count(F.lit(1)).alias("n"))


_SUMMARY_SQL = """
SELECT Library, total_rows, fn_count, fp_count, error_count, fn_count / total_rows AS fn_ratio, fp_count / total_rows AS fp_ratio,
  error_count / total_rows AS error_ratio FROM (
  SELECT coalesce(nullif(trim(Library), ''), '(EMPTY_LIBRARY)') AS Library, count(*) AS total_rows, count(*) FILTER (a = 'FN') AS fn_count,
    count(*) FILTER (a = 'FP') AS fp_count, count(*) FILTER (a IN ('FN', 'FP')) AS error_count FROM (
    SELECT CASE WHEN row_pos % 11 = 0 THEN ' ' ELSE Library END AS Library,
      CASE WHEN (truth = 'affected') = (verdict = 'affected_patch') THEN 'T' WHEN verdict = 'affected_patch' THEN 'FP' ELSE 'FN' END AS a FROM scored)
  GROUP BY 1)
"""


def error_rows(spark, sf):
    d = b.scored(spark, sf)
    lib = F.when(F.col("row_pos") % 11 == 0, " ").otherwise(F.col("Library"))
    return d.withColumns({"Library": lib, "Aligned_llm": lb.align_polarity("truth", "verdict")})


@query("ag1_error_summary", b.with_sql("scored") + _SUMMARY_SQL)
def ag1(spark, sf):
    return ev.error_summary(error_rows(spark, sf))


def _rank_sql(cols):
    order = ", ".join(f"{c} DESC" for c in cols)
    return b.with_sql("scored") + f"SELECT * FROM ({_SUMMARY_SQL}) ORDER BY {order}, Library LIMIT 7"


for _by, _cols in ev.RANKINGS.items():

    def _ranking(spark, sf, by=_by):
        return ev.ranking(ev.error_summary(error_rows(spark, sf)), by, top=7)

    query(f"tk1_ranking_{_by}", _rank_sql(_cols))(_ranking)


_METRICS = """
, CASE WHEN {total} > 0 THEN (tp + tn) / {total} ELSE 0 END AS accuracy
, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision
, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
"""


def metrics_sql(inner, total="total"):
    m = f"SELECT *{_METRICS.format(total=total)} FROM ({inner})"
    return f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ({m})"


_CONF = """count(*) AS total, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp,
  count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn"""
_TP = """SELECT *, CASE truth WHEN 'affected' THEN 1 ELSE 0 END AS t,
  CASE WHEN starts_with(verdict, 'affected') THEN 1 WHEN starts_with(verdict, 'not affected') THEN 0 END AS p FROM chain"""


def _pred():
    s = lb.pred_state("verdict")
    return F.when(s == "affected", 1).when(s == "not affected", 0)


@query("ag3_confusion", b.with_sql("chain") + metrics_sql(f"SELECT outcome, {_CONF} FROM ({_TP}) GROUP BY outcome"))
def ag3(spark, sf):
    return ev.confusion(b.chain(spark, sf), lb.truth01("truth"), _pred(), ["outcome"])


@query("ag3_confusion_decided", b.with_sql("chain") + metrics_sql(f"SELECT {_CONF} FROM ({_TP})", "(tp + fp + fn + tn)"))
def ag3_decided(spark, sf):
    return ev.confusion(b.chain(spark, sf), lb.truth01("truth"), _pred(), denominator="decided")


@query(
    "ag4_two_sided_metrics",
    b.with_sql("chain")
    + f"""SELECT *, total_with_truth - evaluated_predictions AS abstained_predictions, evaluated_predictions / total_with_truth AS coverage FROM ("""
    + metrics_sql(
        f"""SELECT * EXCLUDE (skipped) REPLACE (total - skipped AS total) FROM (
        SELECT 'affected' AS positive_label, count(*) AS total_with_truth, count(p) AS evaluated_predictions, count(*) FILTER (p IS NULL) AS skipped, {_CONF} FROM ({_TP})
        UNION ALL SELECT 'not affected', count(*), count(p), count(*) FILTER (p IS NULL), {_CONF} FROM (SELECT * REPLACE (1 - t AS t, 1 - p AS p) FROM ({_TP})))"""
    )
    + ")",
)
def ag4(spark, sf):
    simple = F.coalesce(F.nullif(lb.pred_state("verdict"), F.lit("")), F.lit("unknown"))
    d = b.chain(spark, sf).select(F.col("truth").alias("actual_label"), simple.alias("predicted_label"))
    return ev.two_sided_metrics(d)


@query(
    "ag4_evaluation_details",
    b.with_sql("chain")
    + f"""SELECT row_pos, CASE WHEN p IS NULL THEN 'ABSTAIN' WHEN p = 1 THEN CASE WHEN t = 1 THEN 'TP' ELSE 'FP' END WHEN t = 1 THEN 'FN' ELSE 'TN' END AS outcome, coalesce(p = t, false) AS prediction_correct
    FROM ({_TP.replace("SELECT ", "SELECT row_pos, ", 1)}) WHERE row_pos % 3 > 0""",
)
def ag4_details(spark, sf):
    simple = F.coalesce(F.nullif(lb.pred_state("verdict"), F.lit("")), F.lit("unknown"))
    # Predictions of every third row have no truth.
    known = F.when(F.col("row_pos") % 3 > 0, F.col("truth"))
    d = b.chain(spark, sf).select("row_pos", known.alias("actual_label"), simple.alias("predicted_label"))
    return ev.evaluation_details(d).select("row_pos", "outcome", "prediction_correct")


@query(
    "ag5_value_counts",
    b.with_sql("cases")
    + """SELECT field, value, count(*) AS n FROM (
      SELECT 'status' AS field, status AS value FROM cases UNION ALL SELECT 'failure_subtype', failure_subtype FROM cases
      UNION ALL SELECT 'seek_patch', CAST(seek_patch AS VARCHAR) FROM cases) GROUP BY 1, 2""",
)
def ag5(spark, sf):
    return ev.value_counts(b.cases(spark, sf), ["status", "failure_subtype", "seek_patch"])


@query("ag6_files_by_kind", b.with_sql("cases") + "SELECT status AS kind, case_id || '.log' AS file_name FROM cases")
def ag6(spark, sf):
    d = b.cases(spark, sf).select("status", F.concat("case_id", F.lit(".log")).alias("f"))
    return ev.files_by_kind(d, "status", "f")


# --- categories -------------------------------------------------------------------------------------------

_STATS = """SELECT cat AS CWE_ID, round(100.0 * count(*) / (SELECT count(*) FROM customer), 1) || '%' AS Percentage
  FROM (SELECT unnest(cwe) AS cat FROM catalog_cats) GROUP BY 1"""


def category_stats(spark, sf):
    """Share of issues per category, as the text a statistics file holds."""
    cats = b.catalog_cats(spark, sf).select(F.explode("cwe").alias("CWE_ID"))
    total = b.table(spark, sf, "customer").agg(F.count(F.lit(1)))
    share = F.round(100.0 * F.col("n") / total.scalar(), 1)
    return cats.groupBy("CWE_ID").agg(F.count(F.lit(1)).alias("n")).select("CWE_ID", F.concat(share.cast("string"), F.lit("%")).alias("Percentage"))


_TOP = f"SELECT CWE_ID, CAST(rtrim(Percentage, '%') AS DOUBLE) AS pct_val FROM ({_STATS}) ORDER BY pct_val DESC, CWE_ID LIMIT 3"


@query("tk7_top_categories", b.with_sql("catalog_cats") + _TOP)
def tk7(spark, sf):
    return ev.top_categories(category_stats(spark, sf), 3)


_PLACED = f"""SELECT r.row_pos, coalesce(w.CWE_ID, 'others') AS CWE_ID FROM (SELECT row_pos, CVE_ID AS cve FROM chain) r LEFT JOIN
  (SELECT DISTINCT cve, cat AS CWE_ID FROM (SELECT cve, unnest(cwe) AS cat FROM catalog_cats) WHERE cat IN (SELECT CWE_ID FROM ({_TOP}))) w ON r.cve = w.cve"""


@query("jn16_explode_categories", b.with_sql("chain", "catalog_cats") + f"SELECT CWE_ID, count(*) AS n, sum(row_pos)::BIGINT AS s FROM ({_PLACED}) GROUP BY 1")
def jn16(spark, sf):
    top = ev.top_categories(category_stats(spark, sf), 3)
    rows = b.chain(spark, sf).select("row_pos", F.col("CVE_ID").alias("cve"))
    out = ev.explode_categories(rows, b.catalog_cats(spark, sf), top)
    return out.groupBy("CWE_ID").agg(F.count(F.lit(1)).alias("n"), F.sum("row_pos").alias("s"))


_METHODS = {
    "tool": ("CASE WHEN starts_with(verdict, 'affected') THEN 1 ELSE 0 END", lambda: lb.verdict01("verdict")),
    "poc": ("CASE WHEN outcome = 'APPEARS' THEN 1 ELSE 0 END", lambda: lb.outcome01("outcome")),
}
_CAT_SQL = b.with_sql("chain", "catalog_cats") + "SELECT CWE_ID, method, \"count\", {r} FROM (".format(
    r=", ".join(f"round({m}, 4) AS {m}" for m in ("precision", "recall", "f1"))
) + """
SELECT *, CASE WHEN precision + recall > 0 AND NOT isnan(precision) AND NOT isnan(recall) THEN 2 * precision * recall / (precision + recall) ELSE 'nan'::DOUBLE END AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 'nan'::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 'nan'::DOUBLE END AS recall FROM (""" + " UNION ALL ".join(
    f"""SELECT p.CWE_ID, '{m}' AS method, count(*) AS "count", count(*) FILTER (truth = 'affected' AND {e} = 1) AS tp, count(*) FILTER (truth <> 'affected' AND {e} = 1) AS fp,
      count(*) FILTER (truth = 'affected' AND {e} = 0) AS fn FROM ({_PLACED}) p JOIN chain c ON c.row_pos = p.row_pos GROUP BY 1"""
    for m, (e, _) in _METHODS.items()
) + ")))"


def _category_metrics(spark, sf):
    top = ev.top_categories(category_stats(spark, sf), 3)
    rows = b.chain(spark, sf).withColumn("cve", F.col("CVE_ID"))
    methods = {m: f() for m, (_, f) in _METHODS.items()}
    return ev.category_metrics(rows, b.catalog_cats(spark, sf), top, lb.truth01("truth"), methods)


@query("ag14_category_report", _CAT_SQL)
def ag14(spark, sf):
    return _category_metrics(spark, sf)


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "others"]


@query(
    "ag14_category_columns",
    """SELECT method || '_' || m AS "Metric", """
    + ", ".join(f"""max(v) FILTER (CWE_ID = '{c}') AS "{c}\"""" for c in _REGIONS)
    + f" FROM (UNPIVOT (SELECT CWE_ID, method, precision, recall, f1 FROM ({_CAT_SQL})) ON precision, recall, f1 INTO NAME m VALUE v) GROUP BY 1",
)
def ag14_columns(spark, sf):
    return ev.category_report(_category_metrics(spark, sf), _REGIONS)


# --- truth join -------------------------------------------------------------------------------------------

_JN1 = """
SELECT c.case_id, c.cve_id, c.target_version, t.truth AS actual_label, t.outcome AS true_execution_result FROM
  (SELECT case_id, 'CVE-' || (k % 400) AS cve_id, '1.' || (k % 100) AS target_version FROM cases) c LEFT JOIN
  (SELECT upper(CVE_ID) AS cve, Version AS version, arg_max(truth, row_pos) AS truth, arg_max(outcome, row_pos) AS outcome FROM chain GROUP BY 1, 2) t
  ON c.cve_id = t.cve AND c.target_version = t.version
"""


def truth_joined(spark, sf):
    k = F.col("k")
    pred = b.cases(spark, sf).select(
        "case_id", F.concat(F.lit("CVE-"), k % 400).alias("cve_id"), F.concat(F.lit("1."), k % 100).alias("target_version")
    )
    return ev.join_truth(pred, b.chain(spark, sf), label="truth", extra={"true_execution_result": "outcome"})


@query("jn1_join_truth", b.with_sql("chain", "cases") + _JN1)
def jn1(spark, sf):
    return truth_joined(spark, sf)


@query("jn1_missing_truth", b.with_sql("chain", "cases") + f"SELECT case_id, cve_id, target_version FROM ({_JN1}) WHERE actual_label IS NULL")
def jn1_missing(spark, sf):
    return ev.missing_truth(truth_joined(spark, sf))


@query(
    "error_ranking_per_source",
    b.with_sql("scored")
    + f"SELECT s.*, round(s.error_ratio * 100, 2) AS error_percent FROM ({_SUMMARY_SQL}) s ORDER BY error_count DESC, fn_count DESC, fp_count DESC, Library LIMIT 20",
)
def flagship(spark, sf):
    """Errors of the length rule against the quality labels, per document source, worst first."""
    out = ev.ranking(ev.error_summary(error_rows(spark, sf)), "error", top=20)
    return out.withColumn("error_percent", F.round(F.col("error_ratio") * 100, 2))
