"""Queries: scores, normalised judgments, evidence items, rule and primary judgments, entries, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipline.functions import evidence as ev
from flipline.functions import scoring as sc
from flipline.functions import signals as sg
from flipline.operators import judge as jg
from flipline.plans import bindings as b
from flipline.plans.q_text import NL, PATHS, WS_CHARS, bonus_sql, paths, phrase_sql, signals_sql
from flipline.plans.registry import query
from flipline.streaming.monitors import usage_tokens


def pick_sql(key, *words):
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {i} THEN {w if w == 'NULL' else repr(w)}" for i, w in enumerate(words)) + " END"


def pick(key, *words):
    k = F.col(key) if isinstance(key, str) else key
    out = None
    for i, w in enumerate(words):
        v = F.lit(None).cast("string") if w == "NULL" else F.lit(w)
        out = F.when(k % len(words) == i, v) if out is None else out.when(k % len(words) == i, v)
    return out


# --- scores -----------------------------------------------------------------------------------------------

_RAWS = ("abc", "2.5", "nan", "-7", "120.5", "3.5", " 41 ", "NULL", "inf")


def clamp_sql(v, default="50"):
    return f"CAST(CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN {default} ELSE least(100, greatest(0, round_even({v}, 0))) END AS INT)"


@query(
    "pr17_clamp_score",
    f"SELECT o_orderkey AS k, {clamp_sql('TRY_CAST(trim(r) AS DOUBLE)')} AS score FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice / 3000 AS VARCHAR) ELSE {pick_sql('(o_orderkey // 2)', *_RAWS)} END AS r FROM orders)",
)
def pr17(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 2 == 0, (F.col("o_totalprice") / 3000).cast("string")).otherwise(pick(F.expr("o_orderkey div 2"), *_RAWS))
    return b.table(spark, sf, "orders").select(k.alias("k"), sc.clamp_score(raw).alias("score"))


def points_sql(c, table):
    return f"CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


_STRENGTHS = ("strong", " Medium", "weak", "none", "odd", "NULL")
_LEVELS = ("HIGH", "medium", "low", "odd", "NULL")


@query(
    "pr18_points",
    f"""SELECT k, {points_sql('s', sc.FIX_POINTS)} AS fix, {points_sql('s', sc.BREAKAGE_POINTS)} AS breakage, {points_sql('c', sc.CONFIDENCE_POINTS)} AS conf FROM (
    SELECT o_orderkey AS k, {pick_sql('o_orderkey', *_STRENGTHS)} AS s, {pick_sql('o_orderkey', *_LEVELS)} AS c FROM orders)""",
)
def pr18(spark, sf):
    s, c = pick("o_orderkey", *_STRENGTHS), pick("o_orderkey", *_LEVELS)
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), sc.fix_points(s).alias("fix"), sc.breakage_points(s).alias("breakage"), sc.confidence_points(c).alias("conf")
    )


def derived_sql(reason, verdict, conf, fix, brk, text):
    base = f"""(CASE {verdict} WHEN 'no' THEN 32 WHEN 'possibly_yes' THEN 68 ELSE 50 END + CASE {reason} WHEN '{sc.ABSENT}' THEN -12 WHEN '{sc.BROKEN}' THEN 8 ELSE 0 END
      + {points_sql(brk, sc.BREAKAGE_POINTS)} - {points_sql(fix, sc.FIX_POINTS)} + {bonus_sql(text, sg.BREAKAGE_BONUS)} - ({bonus_sql(text, sg.FIX_BONUS)}))"""
    c = points_sql(conf, sc.CONFIDENCE_POINTS)
    return f"CAST(least(100, greatest(0, {base} + CASE WHEN {base} > 50 THEN {c} WHEN {base} < 50 THEN -({c}) ELSE 0 END)) AS INT)"


_REASONS = (sc.ABSENT, sc.BROKEN, sc.UNDETERMINED, "weird", "NULL")
_VERDICTS = ("no", "possibly_yes", "unknown", "YES", "NULL", "No ", "possibly_yes")
_JUDGED = f"""SELECT case_id, k, status, failure_subtype, seek_patch, score, {pick_sql('k', *_REASONS)} AS r0, {pick_sql('k', *_VERDICTS)} AS v0, {pick_sql('k', *_LEVELS)} AS c0,
  {pick_sql('k // 3', *_STRENGTHS)} AS f0, {pick_sql('k // 5', *_STRENGTHS)} AS b0, CASE WHEN k % 4 = 0 THEN NULL ELSE CASE WHEN k % 4 = 1 THEN '' ELSE CAST(score AS VARCHAR) END END AS s0,
  CASE WHEN k % 6 = 0 THEN '' ELSE {phrase_sql('k')} END AS rat, CASE WHEN k % 9 = 0 THEN NULL ELSE 'ev ' || (k % 11) END AS e1 FROM cases"""
_ENUM = f"""SELECT *, CASE WHEN lower(trim(r0)) IN ('{sc.ABSENT}', '{sc.BROKEN}', '{sc.UNDETERMINED}') THEN lower(trim(r0)) ELSE '{sc.UNDETERMINED}' END AS r1,
  CASE WHEN lower(trim(v0)) IN ('no', 'possibly_yes', 'unknown') THEN lower(trim(v0)) ELSE 'unknown' END AS v1, CASE WHEN lower(trim(c0)) IN ('high', 'medium', 'low') THEN lower(trim(c0)) ELSE 'low' END AS c1,
  CASE WHEN lower(trim(f0)) IN ('strong', 'medium', 'weak', 'none') THEN lower(trim(f0)) ELSE 'none' END AS f1, CASE WHEN lower(trim(b0)) IN ('strong', 'medium', 'weak', 'none') THEN lower(trim(b0)) ELSE 'none' END AS b1,
  coalesce(nullif(rat, ''), '{sc.DEFAULT_RATIONALE}') AS rat1, coalesce(e1, '') AS ev1 FROM ({_JUDGED})"""
_DERIVED = derived_sql("r1", "v1", "c1", "f1", "b1", "(ev1 || chr(10) || rat1)")
_SCORE = f"SELECT *, CASE WHEN s0 IS NULL OR s0 = '' THEN {_DERIVED} ELSE {clamp_sql('CAST(s0 AS DOUBLE)')} END AS s1, coalesce(s0, '') = '' AS lost FROM ({_ENUM})".replace("CAST(s0 AS DOUBLE)", "TRY_CAST(s0 AS DOUBLE)")
_NORM = f"""SELECT *, CASE WHEN NOT lost THEN r1 WHEN s1 <= 45 THEN '{sc.ABSENT}' WHEN s1 >= 80 THEN '{sc.BROKEN}' ELSE '{sc.UNDETERMINED}' END AS r2,
  CASE WHEN NOT lost THEN v1 WHEN s1 <= 45 THEN 'no' WHEN s1 >= 80 THEN 'possibly_yes' ELSE 'unknown' END AS v2 FROM ({_SCORE})"""


def raw_judgments(spark, sf):
    k = F.col("k")
    text, _ = b.phrases("k", b.EVIDENCE_PHRASES)
    return b.cases(spark, sf).select(
        "case_id", "k", "status", "failure_subtype", "seek_patch",
        pick("k", *_REASONS).alias("final_failure_reason"), pick("k", *_VERDICTS).alias("vulnerability_presence_verdict"), pick("k", *_LEVELS).alias("judgment_confidence"),
        pick(F.expr("k div 3"), *_STRENGTHS).alias("fix_evidence_strength"), pick(F.expr("k div 5"), *_STRENGTHS).alias("exploit_breakage_evidence_strength"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").otherwise(F.col("score").cast("string")).alias("vulnerability_presence_score"),
        F.when(k % 6 == 0, "").otherwise(text).alias("judgment_rationale"),
        F.when(k % 9 != 0, F.array(F.concat(F.lit(" ev "), k % 11), F.lit(" "))).alias("key_evidence"),
    )


@query(
    "pr15_normalize_judgment",
    b.with_sql("cases") + f"SELECT case_id, s1 AS score, r2 AS reason, v2 AS verdict, c1 AS conf, f1 AS fix, b1 AS brk, rat1 AS rationale, ev1 AS evidence FROM ({_NORM})",
)
def pr15(spark, sf):
    d = sc.normalize_judgment(raw_judgments(spark, sf))
    return d.select(
        "case_id", F.col("vulnerability_presence_score").alias("score"), F.col("final_failure_reason").alias("reason"), F.col("vulnerability_presence_verdict").alias("verdict"),
        F.col("judgment_confidence").alias("conf"), F.col("fix_evidence_strength").alias("fix"), F.col("exploit_breakage_evidence_strength").alias("brk"),
        F.col("judgment_rationale").alias("rationale"), F.array_join("key_evidence", ",").alias("evidence"),
    )


@query("pr20_derived_presence_score", b.with_sql("cases") + f"SELECT case_id, {_DERIVED} AS score FROM ({_ENUM})")
def pr20(spark, sf):
    d = raw_judgments(spark, sf).withColumns(
        {
            "r": sc.enum("final_failure_reason", sc.REASONS, sc.UNDETERMINED), "v": sc.enum("vulnerability_presence_verdict", sc.PRESENCE, "unknown"),
            "t": F.concat_ws("\n", F.array_join(sc.key_evidence("key_evidence"), ""), F.coalesce(F.nullif("judgment_rationale", F.lit("")), F.lit(sc.DEFAULT_RATIONALE))),
        }
    )
    return d.select(
        "case_id", sc.derived_presence_score(F.col("r"), F.col("v"), F.col("judgment_confidence"), F.col("fix_evidence_strength"), F.col("exploit_breakage_evidence_strength"), F.col("t")).alias("score")
    )


@query(
    "pr16_normalize_hunk_judgment",
    b.with_sql("cases") + f"""SELECT case_id, 'version-diff/diffs/p/C' || (k % 5) || '.diff' AS hunk_path, CASE WHEN k % 4 < 3 THEN lower(trim({pick_sql('k', 'fix_evidence', ' Neutral', 'exploit_breakage_evidence', 'zzz')})) ELSE 'neutral' END AS judgment,
    CASE WHEN lower(c0) IN ('high', 'medium', 'low') THEN lower(c0) ELSE 'low' END AS confidence, CASE WHEN rat = '' THEN '{sc.DEFAULT_HUNK_REASONING}' ELSE rat END AS reasoning FROM ({_JUDGED})""",
)
def pr16(spark, sf):
    d = raw_judgments(spark, sf).select(
        "case_id", F.concat(F.lit("diffs/p/C"), F.col("k") % 5, F.lit(".diff")).alias("hunk_path"),
        pick("k", "fix_evidence", " Neutral", "exploit_breakage_evidence", "zzz").alias("judgment"), F.col("judgment_confidence").alias("confidence"), "key_evidence",
        F.col("judgment_rationale").alias("reasoning"),
    )
    return sc.normalize_hunk_judgment(d).select("case_id", "hunk_path", "judgment", "confidence", "reasoning")


def rule_score_sql(e, v, u):
    raw = f"(50.0::DOUBLE + 5.0::DOUBLE * ({e} - {v}))"
    return f"CAST(least(100, greatest(0, round_even(CASE WHEN {u} > 0 THEN 50.0::DOUBLE + ({raw} - 50.0::DOUBLE) * greatest(0.35::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * {u}) ELSE {raw} END, 0))) AS INT)"


@query(
    "pr21_rule_presence_score",
    f"SELECT o_orderkey AS k, {rule_score_sql('((o_orderkey % 29) / 4.0::DOUBLE)', '((o_orderkey % 37) / 4.0::DOUBLE)', '(o_orderkey % 5)')} AS score FROM orders",
)
def pr21(spark, sf):
    k = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(k.alias("k"), sc.rule_presence_score((k % 37) / 4.0, (k % 29) / 4.0, k % 5).alias("score"))


# --- prediction -------------------------------------------------------------------------------------------

_P49 = f"""SELECT *, {pick_sql('k // 7', 'trace_diff', 'execution_failure', 'no_diff', 'compile_failure', 'process_failure')} AS sc, k % 3 = 0 AS eff, CASE WHEN k % 2 = 0 THEN k % 6 = 0 END AS ok0,
  CASE WHEN k % 5 = 0 THEN 'test_failure' ELSE 'success' END AS bo, CASE WHEN k % 3 < 2 THEN 'success' ELSE 'x' END AS tob FROM ({_NORM})"""
_LABEL = f"""CASE WHEN bo = 'test_failure' AND tob = 'success' AND tr THEN 'not affected' WHEN NOT seek_patch AND (status = 'no_diff' OR failure_subtype = 'invalid_trace_difference') THEN 'affected'
  WHEN r2 = '{sc.ABSENT}' AND tr AND status = 'trace_diff' AND failure_subtype = 'trace_difference' AND f1 = 'strong' AND ((b1 = 'none' AND s1 >= 10 AND s1 < 15) OR b1 = 'weak') THEN 'affected'
  WHEN r2 = '{sc.ABSENT}' AND tr THEN 'unknown' WHEN r2 = '{sc.ABSENT}' THEN 'not affected' WHEN r2 = '{sc.BROKEN}' AND sc IN ('process_failure', 'compile_failure', 'execution_failure') THEN 'affected'
  WHEN sc = 'execution_failure' AND NOT seek_patch THEN 'affected' WHEN s1 <= 45 THEN 'not affected' WHEN s1 >= 80 THEN 'affected' WHEN v2 IN ('yes', 'possibly_yes') THEN 'affected' WHEN v2 = 'no' THEN 'not affected' ELSE 'unknown' END"""


def entries(spark, sf):
    k = F.col("k")
    d = sc.normalize_judgment(raw_judgments(spark, sf))
    return d.withColumns(
        {
            "scenario_type": pick(F.expr("k div 7"), "trace_diff", "execution_failure", "no_diff", "compile_failure", "process_failure"),
            "trace_has_effective_difference": k % 3 == 0,
            "trace_evidence_valid": F.when(k % 2 == 0, k % 6 == 0),
            "baseline_execution_observation": F.when(k % 5 == 0, "test_failure").otherwise("success"),
            "target_execution_observation": F.when(k % 3 < 2, "success").otherwise("x"),
        }
    )


@query("pr49_predict_label", b.with_sql("cases") + f"SELECT case_id, {_LABEL} AS predicted_label FROM (SELECT *, sc = 'trace_diff' AND eff AND coalesce(ok0, eff) AS tr FROM ({_P49}))")
def pr49(spark, sf):
    return entries(spark, sf).select("case_id", sc.predict_label().alias("predicted_label"))


@query(
    "pr38_usage_tokens",
    b.with_sql("usage_rows")
    + """SELECT method, model, count(*) AS calls, count(nullif(prompt_tokens, 0)) AS with_prompt, sum(nullif(prompt_tokens, 0))::BIGINT AS prompt, sum(nullif(completion_tokens, 0))::BIGINT AS completion,
    sum(nullif(prompt_tokens, 0) + nullif(completion_tokens, 0))::BIGINT AS total FROM usage_rows GROUP BY 1, 2""",
)
def pr38(spark, sf):
    u = b.usage_rows(spark, sf)
    odd = F.col("prompt_tokens") % 2 == 1
    d = u.withColumns(
        {"input_tokens": F.when(odd, F.col("prompt_tokens")), "prompt_tokens": F.when(~odd, F.col("prompt_tokens")), "output_tokens": F.col("completion_tokens")}
    ).drop("completion_tokens").withColumn("total_tokens", F.lit(None).cast("bigint"))
    return usage_tokens(d).groupBy("method", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.count("prompt_tokens").alias("with_prompt"), F.sum("prompt_tokens").alias("prompt"),
        F.sum("completion_tokens").alias("completion"), F.sum("total_tokens").alias("total"),
    )


# --- answers ----------------------------------------------------------------------------------------------

_BODY = f"trim(regexp_replace(text, '{NL}', chr(10), 'g'), {WS_CHARS})"
_AGAIN = f"trim({_BODY} || chr(10) || 'again ' || turn, {WS_CHARS})"


@query(
    "pr39_parse_sections",
    f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN {_AGAIN} ELSE '' END AS diagnosis, CASE role WHEN 'assistant' THEN {_AGAIN} ELSE '' END AS selected,
    'turn ' || turn AS evidence, CASE role WHEN 'system' THEN {_AGAIN} ELSE '' END AS questions FROM conversations""",
)
def pr39(spark, sf):
    head = F.when(F.col("role") == "user", "## Diagnosis").when(F.col("role") == "assistant", "1. **Selected Hunks**").otherwise("Open  Questions:")
    body = F.regexp_replace("text", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    md = F.concat_ws(
        "\n", F.lit("draft Final response: old\nFinal response:"), head, F.lit("```"), body, F.lit("- **Supporting Evidence：**"), F.concat(F.lit("  turn "), "turn"), head, F.concat(F.lit("again "), "turn")
    )
    d = b.table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("case_id"), md.alias("markdown"))
    a = jg.parsed_answers(d)
    return a.select(
        "case_id.conv_id", "case_id.turn", "diagnosis", F.col("selected_hunks_text").alias("selected"), F.col("supporting_evidence").alias("evidence"), F.col("open_questions").alias("questions")
    )


_NPATH = "CASE WHEN page_id % 10 IN (0, 2) THEN 'version-diff/' || path ELSE path END"


@query(
    "pr40_parse_hunks",
    f"""SELECT page_id, 1 AS hunk_pos, {_NPATH} AS path, CASE WHEN page_id % 3 < 2 THEN 'adds a guard' || chr(10) || '  + line ' || page_id || chr(10) || 'plain' ELSE '' END AS details,
    CASE WHEN page_id % 3 < 2 THEN '  + line ' || page_id ELSE '' END AS inline FROM ({PATHS})
    UNION ALL SELECT page_id, 2, 'version-diff/pom.diff', CASE WHEN page_id % 3 < 2 THEN 'see ' || path ELSE '' END, '' FROM ({PATHS}) WHERE page_id % 3 < 2 OR page_id % 10 <> 4""",
)
def pr40(spark, sf):
    p = F.col("page_id")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    listed = j("intro dependency line\n- ", F.col("path"), ": adds a guard\n  + line ", p, "\nplain\n2) version-diff/pom.diff - see ", F.col("path"))
    loose = j("Both ", F.col("path"), " and version-diff/pom.diff and again ", F.col("path"), " matter")
    d = paths(spark, sf).select(p.alias("case_id"), F.when(p % 3 < 2, listed).otherwise(loose).alias("selected_hunks_text"))
    return jg.selected_hunks(d).withColumnRenamed("case_id", "page_id")


_WEAK = f"""SELECT page_id, path, concat_ws(',', CASE WHEN NOT (path LIKE 'version-diff/diffs/%' OR path LIKE 'version-diff/api-diffs/%') THEN 'fallback_evidence' END, CASE WHEN regexp_matches(path, '\\$\\d+\\.diff$') THEN 'synthetic_inner_class' END,
  CASE WHEN page_id % 4 = 1 OR page_id % 6 = 1 THEN 'switch_map_or_enum_reorder' END, CASE WHEN page_id % 5 = 2 AND page_id % 3 > 0 THEN 'logger_only_change' END, CASE WHEN path = 'trace-diff-summary.txt' AND page_id % 2 = 1 THEN 'invalid_trace_summary' END) AS reasons
  FROM (SELECT page_id, {_NPATH} AS path FROM ({PATHS}))"""
_WEIGHT = "CASE WHEN contains(reasons, 'invalid_trace') THEN 0.0 WHEN contains(reasons, 'synthetic') OR contains(reasons, 'switch') OR contains(reasons, 'logger') THEN 0.25 WHEN contains(reasons, 'fallback') THEN 0.35 ELSE 1.0 END"


def weighed(spark, sf):
    p = F.col("page_id")
    details = F.concat_ws("\n", F.when(p % 4 == 1, "uses $SwitchMap here"), F.when(p % 6 == 1, "enum Foo\nvalues()  ordinal"), F.when(p % 3 == 0, "adds Validation"))
    excerpt = F.concat_ws("\n", F.when(p % 5 == 2, "import LoggerFactory;"), F.when(p % 3 == 1, "Code: invoke x"))
    d = paths(spark, sf).select("page_id", "path", details.alias("details"), excerpt.alias("diff_excerpt"), (p % 2 == 1).alias("trace_invalid"), F.lit(None).cast("string").alias("paired_bytecode_path"))
    return jg.weigh(d)


@query("pr41_weak_reasons", f"SELECT page_id, reasons, {_WEIGHT} AS weight FROM ({_WEAK})")
def pr41(spark, sf):
    return weighed(spark, sf).select("page_id", F.array_join("weak_signal_reasons", ",").alias("reasons"), F.col("signal_weight").alias("weight"))


@query(
    "pr42_concrete_context",
    f"""SELECT page_id, path LIKE 'version-diff/api-diffs/%' AND page_id % 7 < 5 AS shallow,
    (path LIKE 'version-diff/diffs/%' OR (path LIKE 'version-diff/api-diffs/%' AND page_id % 7 >= 5)) AND weight >= 0.75 AND NOT regexp_matches(path, '\\$\\d+\\.diff$') AS concrete FROM (SELECT *, {_WEIGHT} AS weight FROM ({_WEAK}))""",
)
def pr42(spark, sf):
    p = F.col("page_id")
    d = weighed(spark, sf)
    # Declarations only, or long enough to show a body.
    short = F.lit("--- a\n+++ b\n@@ 1 @@\n- public int size();\n+ int count;\n  context")
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("+ x = "), i, F.lit(" + y"))), "\n")
    text = F.when(p % 7 < 5, short).otherwise(long)
    return d.select(
        "page_id", ev.is_shallow_api(F.col("path"), text).alias("shallow"), ev.has_concrete_context(F.col("path"), text, F.col("signal_weight"), F.lit("")).alias("concrete")
    )


@query(
    "pr44_evidence_text",
    b.with_sql("cases")
    + """SELECT case_id, concat_ws(chr(10), status, failure_subtype, CASE WHEN seek_patch THEN 'True' END, CASE WHEN score <> 0 THEN CAST(score AS VARCHAR) END, '{"target":"' || target_version || '"}', 'a', CAST(k % 3 AS VARCHAR)) AS t FROM cases""",
)
def pr44(spark, sf):
    d = b.cases(spark, sf).select(
        "case_id", "status", "failure_subtype", "seek_patch", "score", F.struct(F.col("target_version").alias("target")).alias("div"), F.array(F.lit("a"), (F.col("k") % 3).cast("string")).alias("ev"), F.lit("").alias("empty")
    )
    return d.select("case_id", jg.case_text(d, ["status", "failure_subtype", "seek_patch", "empty", "score", "div", "ev"]).alias("t"))


# --- evidence items ---------------------------------------------------------------------------------------

_JN21_HUNKS = """SELECT k, i, CASE (k + i) % 4 WHEN 0 THEN 'diffs/p/C' || (k % 5) || '$In' || i || '.diff' WHEN 1 THEN 'version-diff/api-diffs/p/D' || i || '.diff' WHEN 2 THEN 'dependency-tree.diff' ELSE 'trace-diff-summary.txt' END AS path
  FROM (SELECT o_orderkey AS k, unnest(generate_series(1, o_orderkey % 7)) AS i FROM orders)"""


def jn21_inputs(spark, sf):
    k, i = F.col("k"), F.col("i")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    name = j("case-", k).alias("case_id")
    cases = o.select(
        name, "k", F.when(k % 3 == 1, F.array(F.lit("noise"))).alias("trace_invalid_reasons"), (k % 2 == 0).alias("trace_has_difference"), F.lit(None).cast("boolean").alias("trace_has_effective_difference"),
        F.when(k % 8 == 3, "baseline-observation-excerpt.txt").alias("failure_excerpt_file"), F.lit("dependency-tree.diff").alias("dependency_tree_diff"),
    )
    form = (
        F.when((k + i) % 4 == 0, j("diffs/p/C", k % 5, "$In", i, ".diff")).when((k + i) % 4 == 1, j("version-diff/api-diffs/p/D", i, ".diff"))
        .when((k + i) % 4 == 2, "dependency-tree.diff").otherwise("trace-diff-summary.txt")
    )
    hunks = o.where("k % 7 > 0").select("k", F.explode(F.sequence(F.lit(1), (k % 7).cast("int"))).alias("i")).select(
        name, F.col("i").alias("hunk_pos"), form.alias("path"), F.lit("note").alias("details"), F.lit("").alias("inline")
    )
    file = lambda cond, path, text: F.when(cond, F.struct(path.alias("path"), text.alias("text")))
    listed = F.array_compact(
        F.array(
            file(k % 3 == 0, j("version-diff/diffs/p/C", k % 5, ".diff"), F.lit("plain")),
            file(k % 2 == 0, j("version-diff/api-diffs/p/C", k % 5, ".diff"), F.lit("+ int a;")),
            file(k % 4 == 0, F.lit("target-observation-excerpt.txt"), F.lit("obs")),
            file(k % 8 == 3, F.lit("baseline-observation-excerpt.txt"), F.lit("base obs")),
            file(F.lit(True), F.lit("dependency-tree.diff"), F.when(k % 5 == 0, "(no dependency tree diff)\n").otherwise("tree diff")),
            file(F.lit(True), F.lit("execution-observations.json"), F.when(k % 6 == 0, " \n").otherwise("{}")),
            file(k % 2 == 1, F.lit("trace-diff-summary.txt"), F.lit("summary")),
            file(F.lit(True), F.lit("version-diff/summary.json"), F.lit('{"changed_class_count": 3, "changed_classes_preview": ["a", "b"]}')),
        )
    )
    files = o.select(name, F.explode(listed).alias("f")).select("case_id", "f.path", "f.text")
    return cases, hunks, files


_SUPP = """SELECT k, unnest(['trace-diff-summary.txt', 'baseline-observation-excerpt.txt', 'dependency-tree.diff', 'trace-diff-summary.txt', 'target-observation-excerpt.txt', 'baseline-observation-excerpt.txt', 'dependency-tree.diff', 'execution-observations.json', 'version-diff/summary.json']) AS path,
  unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS o, unnest([k % 2 = 0 AND k % 3 <> 1, k % 8 = 3, true, true, true, true, true, true, true]) AS listed FROM (SELECT o_orderkey AS k FROM orders)"""
_JN21 = f"""
WITH h AS ({_JN21_HUNKS}), own AS (SELECT k, i AS ord, CASE WHEN path LIKE 'diffs/%' THEN 'version-diff/' || path ELSE path END AS path FROM h WHERE i <= 5),
sib AS (SELECT k, path, min(ord * 10 + j) AS ord FROM (SELECT k, ord, 0 AS j, 'version-diff/diffs/p/C' || (k % 5) || '.diff' AS path FROM own WHERE path LIKE '%$In%' AND k % 3 = 0
  UNION ALL SELECT k, ord, 1, 'version-diff/api-diffs/p/C' || (k % 5) || '.diff' FROM own WHERE path LIKE '%$In%' AND k % 2 = 0) GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, ord) AS item FROM (SELECT k, 0 AS part, ord, path FROM own UNION ALL SELECT k, 1, ord, path FROM sib)),
st AS (SELECT o_orderkey AS k, coalesce(u, 0) AS u, coalesce(c, false) AS c FROM orders LEFT JOIN (SELECT k, max(item) AS u, bool_or(contains(path, 'diffs/')) AS c FROM l WHERE item <= 9 GROUP BY 1) x ON x.k = o_orderkey),
s AS (SELECT st.k, st.u, p.path, min(p.o) AS o FROM st JOIN ({_SUPP}) p ON p.k = st.k WHERE NOT st.c AND p.listed AND NOT (path = 'trace-diff-summary.txt' AND (st.k % 3 = 1 OR st.k % 2 = 0))
  AND NOT (path = 'baseline-observation-excerpt.txt' AND st.k % 8 <> 3) AND NOT (path = 'target-observation-excerpt.txt' AND st.k % 4 <> 0) AND NOT (path = 'dependency-tree.diff' AND st.k % 5 = 0) AND NOT (path = 'execution-observations.json' AND st.k % 6 = 0)
  AND NOT EXISTS (SELECT 1 FROM l WHERE l.k = st.k AND l.item <= 9 AND l.path = p.path) GROUP BY 1, 2, 3),
s2 AS (SELECT k, 2 AS part, path, u + row_number() OVER (PARTITION BY k ORDER BY o) AS item FROM s),
allr AS (SELECT k, part, path, item FROM l WHERE item <= 9 UNION ALL SELECT k, part, path, item FROM s2 WHERE item <= 9)
SELECT 'case-' || k AS case_id, part, item, path, CASE WHEN contains(path, '/diffs/') THEN 'bytecode_diff' WHEN contains(path, 'api-diffs/') THEN 'api_diff' WHEN path = 'version-diff/summary.json' THEN 'version_diff_summary' WHEN path = 'dependency-tree.diff' THEN 'dependency_tree_diff'
  WHEN path = 'trace-diff-summary.txt' THEN 'trace_summary' WHEN path LIKE '%excerpt.txt' THEN 'observation_excerpt' ELSE 'execution_observations' END AS evidence_kind, contains(path, 'diffs/') AS is_concrete,
  CASE WHEN path LIKE 'version-diff/api-diffs/%' THEN replace(path, 'api-diffs', 'diffs') ELSE '' END AS paired FROM allr
"""


@query("jn21_evidence_for_judgment", _JN21)
def jn21(spark, sf):
    d = jg.evidence_for_judgment(*jn21_inputs(spark, sf))
    return d.select("case_id", "part", "item", "path", "evidence_kind", "is_concrete", F.coalesce("paired_bytecode_path", F.lit("")).alias("paired"))


_DUMP = "list_transform(generate_series(1, {n}), lambda i: 'int val' || (({k} + i) % 5) || ';')"
_AROUND = "list_transform(generate_series(greatest(1, {a} - 8), least(len({l}), {a} + 8)), lambda i: lpad(CAST(i AS VARCHAR), 5, '0') || ': ' || {l}[i])"


@query(
    "jn21_raw_context",
    f"""WITH d AS (SELECT o_orderkey AS k, 'val' || (o_orderkey % 3) AS v, CASE WHEN o_orderkey % 7 > 0 THEN {_DUMP.format(n=30, k='o_orderkey')} END AS b, {_DUMP.format(n='10 + o_orderkey % 25', k='2 * o_orderkey')} AS t FROM orders),
    a AS (SELECT *, list_position(b, 'int ' || v || ';') AS ba, list_position(t, 'int ' || v || ';') AS ta FROM d),
    c AS (SELECT *, ['{ev.RAW_CONTEXT_MARK}', 'matched_anchor_terms: + int ' || v || ';, int, ' || v] || CASE WHEN b IS NULL THEN [] ELSE ['baseline_context (anchor line ' || ba || '):'] || {_AROUND.format(a='ba', l='b')} END
      || ['target_context (anchor line ' || ta || '):'] || {_AROUND.format(a='ta', l='t')} AS ls FROM a)
    SELECT 'case-' || k AS case_id, item, CASE WHEN item = 2 THEN 'note' WHEN k % 11 = 0 THEN 'why' ELSE 'why' || chr(10) || '{jg.RAW_NOTE}' END AS details, CASE WHEN item = 2 THEN '+ gone' ELSE '+ int ' || v || ';' || CASE WHEN k % 11 = 0 THEN '' ELSE
      chr(10) || chr(10) || array_to_string(ls[1:36], chr(10)) || CASE WHEN len(ls) > 36 THEN chr(10) || '...(truncated)' ELSE '' END END END AS diff_excerpt FROM c, (SELECT unnest([1, 2]) AS item)""",
)
def jn21_raw(spark, sf):
    k = F.col("k")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).withColumn("case_id", j("case-", k))
    none = F.lit(None).cast("string")
    cases = o.select("case_id", F.lit(None).cast("array<string>").alias("trace_invalid_reasons"), F.lit(False).alias("trace_has_difference"), F.lit(False).alias("trace_has_effective_difference"), none.alias("failure_excerpt_file"), none.alias("dependency_tree_diff"))
    own = F.struct(F.lit(1).alias("hunk_pos"), j("diffs/p/C", k % 5, ".diff").alias("path"), F.lit("why").alias("details"), j("+ int val", k % 3, ";").alias("inline"))
    other = F.struct(F.lit(2).alias("hunk_pos"), F.lit("diffs/p/Other.diff").alias("path"), F.lit("note").alias("details"), F.lit("+ gone").alias("inline"))
    # Of three hunks two are within the budget.
    hunks = o.select("case_id", F.inline(F.array(own, other, F.struct(F.lit(3).alias("hunk_pos"), *[other[c].alias(c) for c in ("path", "details", "inline")]))))
    dump = lambda n, s: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n) if isinstance(n, int) else n), lambda i: j("int val", (s + i) % 5, ";")), "\n")
    raw = o.where("k % 11 > 0").select("case_id", j("raw/p/C", k % 5).alias("stem"), F.when(k % 7 > 0, dump(30, k)).alias("baseline"), dump((10 + k % 25).cast("int"), 2 * k).alias("target"))
    files = o.select("case_id", F.lit("none").alias("path"), F.lit("").alias("text"))
    d = jg.evidence_for_judgment(cases, hunks, files, raw, max_hunks=2, max_items=None)
    return d.select("case_id", "item", "details", "diff_excerpt")


# --- rule and primary judgment ----------------------------------------------------------------------------

_ITEMS = """SELECT k, i, (k + i) % 5 AS m, CASE WHEN (k + i) % 5 = 0 THEN 'trace-diff-summary.txt' WHEN (k + i) % 3 = 0 THEN 'version-diff/diffs/p/C' || i || '$1.diff' ELSE 'version-diff/diffs/p/C' || i || '.diff' END AS path,
  CASE WHEN (k + i) % 5 = 0 THEN CASE WHEN k % 6 = 1 THEN 0.0 ELSE 0.35 END WHEN (k + i) % 3 = 0 THEN 0.25 ELSE 1.0 END AS w, (k * i) % 7 = 0 AS direct, (k + i) % 3 AS j, (k * i) % 3 AS c FROM (
  SELECT o_orderkey AS k, unnest(generate_series(1, o_orderkey % 4)) AS i FROM orders)"""
_OBS = """SELECT *, CASE k % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'test_failure' ELSE 'execution_failure' END AS tob, CASE k % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'test_failure' ELSE '' END AS bo, k % 2 = 0 AS diff,
  k % 6 = 1 AS inv, CASE k % 5 WHEN 0 THEN 'execution_failure' WHEN 1 THEN 'trace_diff' ELSE 'no_diff' END AS sc, k % 7 = 0 AS ended, CAST(k % 11 AS INT) AS bn, CAST(k % 3 AS INT) AS tn, k % 8 = 0 AS oq FROM cases"""


def rule_inputs(spark, sf):
    k, i = F.col("k"), F.col("i")
    c = b.cases(spark, sf)
    text, _ = b.phrases("k", b.EVIDENCE_PHRASES)
    cases = c.select(
        "case_id", "k", "status", "failure_subtype", "seek_patch", text.alias("verdict_text"),
        F.when(k % 3 == 0, "success").when(k % 3 == 1, "test_failure").otherwise("execution_failure").alias("target_execution_observation"),
        F.when(k % 4 == 0, "success").when(k % 4 == 1, "test_failure").otherwise("").alias("baseline_execution_observation"),
        (k % 2 == 0).alias("trace_has_difference"), F.when(k % 6 == 1, F.array(F.lit("noise"))).alias("trace_invalid_reasons"),
        F.when(k % 5 == 0, "execution_failure").when(k % 5 == 1, "trace_diff").otherwise("no_diff").alias("scenario_type"),
        F.when(k % 7 == 0, "<trace ended>").otherwise("x").alias("first_divergence_target"), (k % 11).cast("int").alias("baseline_enter_count"), (k % 3).cast("int").alias("target_enter_count"),
        F.when(k % 8 == 0, "why?").otherwise("").alias("open_questions"),
    )
    items = c.where("k % 4 > 0").select("case_id", "k", F.explode(F.sequence(F.lit(1), (k % 4).cast("int"))).alias("i"))
    path = F.when((k + i) % 5 == 0, "trace-diff-summary.txt").otherwise(F.concat(F.lit("version-diff/diffs/p/C"), i, F.when((k + i) % 3 == 0, "$1").otherwise(""), F.lit(".diff")))
    evidence = jg.weigh(
        items.select(
            "case_id", F.col("i").alias("item"), path.alias("path"), F.lit("").alias("details"), F.when((k * i) % 7 == 0, "Here Removed  recursive call; removed recursive").otherwise("plain").alias("diff_excerpt"),
            F.lit(None).cast("string").alias("paired_bytecode_path"), (k % 6 == 1).alias("trace_invalid"),
        )
    )
    hunks = items.select(
        "case_id", F.regexp_replace(path, "^version-diff/", "").alias("hunk_path"), pick(k + i, "fix_evidence", "exploit_breakage_evidence", "neutral").alias("judgment"), pick(k * i, "high", "medium", "low").alias("confidence")
    )
    return cases, evidence, hunks


_SIGS = {"sa": sg.STRONG_ABSENT, "wa": sg.WEAK_ABSENT, "sch": sg.STRONG_CHANGE, "wc": sg.WEAK_CHANGE, "us": sg.UNCERTAINTY}
_CNT = "(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ',')) END)"
_COMPAT_ONLY = ", ".join(f"'{x}'" for x in jg.COMPATIBILITY_ONLY)
_RULE = f"""
, it AS ({_ITEMS}), ag AS (SELECT k, count(*) FILTER (direct AND w >= 0.75) AS dn, count(DISTINCT CASE WHEN m = 0 THEN 'f' END) + count(DISTINCT CASE WHEN m = 0 AND k % 6 = 1 THEN 'i' END) + count(DISTINCT CASE WHEN m <> 0 AND (k + i) % 3 = 0 THEN 's' END) AS wr,
  coalesce(sum(CASE WHEN j = 0 THEN ([5, 3, 1])[c + 1] * wj END), 0) AS fp, coalesce(sum(CASE WHEN j = 1 THEN ([5, 3, 1])[c + 1] * wj END), 0) AS bp, coalesce(bool_or(j = 0 AND wj >= 0.75 AND c < 2), false) AS sh,
  coalesce(sum(CASE WHEN j = 0 THEN ([4, 2, 0])[c + 1] END), 0) AS fc, count(DISTINCT CASE WHEN j = 0 THEN c END) AS fl, count(DISTINCT CASE WHEN j = 1 THEN c END) AS bl FROM (
  SELECT *, first_value(w) OVER (PARTITION BY k, path ORDER BY i) AS wj FROM it) GROUP BY 1),
o AS (SELECT o.*, coalesce(dn, 0) AS dn, coalesce(wr, 0) AS wr, coalesce(fp, 0)::DOUBLE AS fp, coalesce(bp, 0)::DOUBLE AS bp, coalesce(sh, false) AS sh, coalesce(fc, 0) AS fc, coalesce(fl, 0) AS fl, coalesce(bl, 0) AS bl, diff AND NOT inv AS eff,
  {', '.join(f"{signals_sql('t', p)} AS {n}" for n, p in _SIGS.items())} FROM (SELECT *, {phrase_sql('k')} AS t FROM ({_OBS})) o LEFT JOIN ag ON ag.k = o.k),
p AS (SELECT *, dn > 0 OR sh OR fp >= 2.5 AS strong, status = 'execution_failure' AND tob <> 'success' AS b1, coalesce(failure_subtype IN ({_COMPAT_ONLY}), false) AND tob <> 'success' AS b2, sc = 'execution_failure' AND tob <> 'success' AS b3,
  CASE WHEN contains(sch, 'removed_or_missing_api') THEN 1 ELSE 0 END AS hard, {_CNT.format(c='sch')} - CASE WHEN contains(sch, 'removed_or_missing_api') THEN 1 ELSE 0 END AS soft,
  tob = 'success' AND bo NOT IN ('', 'success') AS suc, eff AND ended AS en, eff AND bn > greatest(4, tn * 4) AND tn <= 1 AS rec FROM o),
q AS (SELECT *, {_CNT.format(c='sa')} * 3.0::DOUBLE + {_CNT.format(c='wa')} + dn * 4 + fp + CASE WHEN suc THEN 2 ELSE 0 END + CASE WHEN eff AND suc THEN 2 ELSE 0 END + CASE WHEN en THEN 2 ELSE 0 END + CASE WHEN rec THEN 2 ELSE 0 END AS v,
  hard * 3.0::DOUBLE + soft * 1.25::DOUBLE + {_CNT.format(c='wc')} * 0.35::DOUBLE + bp + CASE WHEN b1 AND NOT strong THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN b2 AND NOT strong THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN b3 AND NOT strong THEN 0.5::DOUBLE ELSE 0 END AS e,
  {_CNT.format(c='us')} + soft + {_CNT.format(c='wc')} + CASE WHEN inv THEN 1 ELSE 0 END + wr + CASE WHEN b1 THEN 1 ELSE 0 END + CASE WHEN b2 THEN 1 ELSE 0 END + CASE WHEN b3 THEN 1 ELSE 0 END + CASE WHEN diff AND NOT eff THEN 1 ELSE 0 END + CASE WHEN oq THEN 1 ELSE 0 END AS u,
  {_CNT.format(c='sa')} + {_CNT.format(c='wa')} + CASE WHEN dn > 0 THEN 1 ELSE 0 END + fl + CASE WHEN suc THEN 1 ELSE 0 END + CASE WHEN eff AND suc THEN 1 ELSE 0 END + CASE WHEN en THEN 1 ELSE 0 END + CASE WHEN rec THEN 1 ELSE 0 END AS vn,
  hard + bl + CASE WHEN strong THEN 0 ELSE CASE WHEN b1 THEN 1 ELSE 0 END + CASE WHEN b2 THEN 1 ELSE 0 END + CASE WHEN b3 THEN 1 ELSE 0 END END AS en2 FROM p),
r AS (SELECT *, {rule_score_sql('e', 'v', 'u')} AS rs FROM q),
ru AS (SELECT *, CASE WHEN rs <= 45 THEN '{sc.ABSENT}' WHEN rs >= 80 THEN '{sc.BROKEN}' ELSE '{sc.UNDETERMINED}' END AS rr, CASE WHEN rs <= 45 THEN 'no' WHEN rs >= 80 THEN 'possibly_yes' ELSE 'unknown' END AS rv,
  CASE WHEN rs > 45 AND rs < 80 THEN 'low' WHEN cp >= 4 THEN 'high' WHEN cp >= 2 THEN 'medium' ELSE 'low' END AS rc FROM (
  SELECT *, abs(rs - 50) // 10 + CASE WHEN (CASE WHEN rs <= 45 THEN vn ELSE en2 END) >= 2 THEN 1 ELSE 0 END - least(2, u) AS cp FROM r))
"""


@query(
    "ag15_rule_judgment",
    b.with_sql("cases").rstrip() + _RULE + "SELECT case_id, rs AS rule_score, rr AS rule_reason, rv AS rule_verdict, rc AS rule_confidence, strong, b1 OR b2 OR b3 AS compat, eff, round(v, 2) AS v, round(e, 2) AS e, u FROM ru",
)
def ag15(spark, sf):
    d = jg.rule_judgment(*rule_inputs(spark, sf))
    return d.select(
        "case_id", "rule_score", "rule_reason", "rule_verdict", "rule_confidence", F.col("strong_fix_evidence_present").alias("strong"), F.col("compatibility_breakage_present").alias("compat"),
        F.col("trace_evidence_effective").alias("eff"), F.col("absent_score").alias("v"), F.col("breakage_score").alias("e"), F.size("uncertainty_signals").alias("u"),
    )


_PRIMARY = f""", mo AS (SELECT k AS mk, s1, r2, v2, c1, f1, b1 AS mb FROM ({_NORM}) WHERE k % 10 < 8),
pr AS (SELECT *, CASE WHEN mk IS NULL THEN 'hybrid_fallback_rule' WHEN v2 IN ('no', 'possibly_yes') AND c1 <> 'high' AND sup = 0 AND (CASE WHEN v2 = 'no' THEN NOT strong ELSE NOT eff OR b1 OR b2 OR b3 OR rr = '{sc.UNDETERMINED}' END) THEN 'hybrid_override_rule_unsupported_llm'
  WHEN rr = '{sc.ABSENT}' AND rc IN ('high', 'medium') AND r2 = '{sc.BROKEN}' AND (strong OR fc >= 2) THEN 'hybrid_override_rule_fix'
  WHEN rr = '{sc.UNDETERMINED}' AND r2 = '{sc.BROKEN}' AND (b1 OR b2 OR b3) AND NOT eff AND NOT (strong OR fc >= 2) THEN 'hybrid_override_rule_unknown' ELSE 'llm' END AS src FROM ru LEFT JOIN mo ON mo.mk = ru.k
  LEFT JOIN (SELECT k AS sk, count(*) AS sup0 FROM it WHERE w >= 0.75 GROUP BY 1) s ON s.sk = ru.k CROSS JOIN LATERAL (SELECT coalesce(sup0, 0) AS sup))
"""
_PICKED = """SELECT case_id, k, src AS judgment_source, CASE src WHEN 'llm' THEN s1 ELSE rs END AS score, CASE src WHEN 'llm' THEN r2 ELSE rr END AS reason, CASE src WHEN 'llm' THEN v2 ELSE rv END AS verdict, CASE src WHEN 'llm' THEN c1 ELSE rc END AS conf,
  CASE WHEN src IN ('llm', 'hybrid_override_rule_unsupported_llm', 'hybrid_override_rule_unknown') THEN f1 WHEN src = 'hybrid_override_rule_fix' THEN 'strong' ELSE '' END AS fix, failure_subtype, seek_patch FROM pr"""


def primary(spark, sf):
    cases, evidence, hunks = rule_inputs(spark, sf)
    rule = jg.rule_judgment(cases, evidence, hunks)
    model = sc.normalize_judgment(raw_judgments(spark, sf).where("k % 10 < 8"))
    return jg.primary_judgment(rule, model)


@query("ag16_primary_judgment", b.with_sql("cases").rstrip() + _RULE + _PRIMARY + f"SELECT case_id, judgment_source, score, reason, verdict, conf, fix FROM ({_PICKED})")
def ag16(spark, sf):
    return primary(spark, sf).select(
        "case_id", "judgment_source", F.col("vulnerability_presence_score").alias("score"), F.col("final_failure_reason").alias("reason"), F.col("vulnerability_presence_verdict").alias("verdict"),
        F.col("judgment_confidence").alias("conf"), F.col("fix_evidence_strength").alias("fix"),
    )


_ENTRY = f"""SELECT *, CASE WHEN k % 13 = 0 THEN 'missing_scenario' WHEN k % 4 = 1 AND failure_subtype = 'invalid_trace_difference' AND NOT seek_patch THEN 'auto' WHEN k % 4 = 1 THEN 'missing_markdown' ELSE 'entry' END AS entry_state FROM ({_PICKED})"""


def _entry_table(spark, sf):
    k = F.col("k")
    d = primary(spark, sf).withColumns({"has_scenario": k % 13 != 0, "has_markdown": k % 4 != 1, "has_final_response": k % 3 != 0})
    return jg.judged_entries(d)


@query(
    "ag17_judged_entries",
    b.with_sql("cases").rstrip() + _RULE + _PRIMARY
    + f"""SELECT case_id, entry_state, CASE entry_state WHEN 'auto' THEN 90 ELSE score END AS score, CASE entry_state WHEN 'auto' THEN 'invalid_trace_difference' ELSE reason END AS reason,
    CASE entry_state WHEN 'auto' THEN 'invalid_trace_auto_rule' ELSE judgment_source END AS source FROM ({_ENTRY})""",
)
def ag17(spark, sf):
    return _entry_table(spark, sf).select(
        "case_id", "entry_state", F.col("vulnerability_presence_score").alias("score"), F.col("final_failure_reason").alias("reason"), F.col("judgment_source").alias("source")
    )


@query(
    "ag17_entry_counters",
    b.with_sql("cases").rstrip() + _RULE + _PRIMARY
    + f"""SELECT count(*) AS selected_cases, count(*) FILTER (entry_state IN ('entry', 'auto')) AS aggregated_entries, count(*) FILTER (entry_state = 'missing_scenario') AS missing_scenario_count,
    count(*) FILTER (entry_state = 'missing_markdown') AS missing_markdown_count, count(*) FILTER (entry_state = 'entry' AND k % 3 = 0) AS missing_final_response_count, count(*) FILTER (entry_state = 'entry' AND k % 10 < 8) AS llm_judgment_available_count FROM ({_ENTRY})""",
)
def ag17_counters(spark, sf):
    return jg.entry_counters(_entry_table(spark, sf))


# --- scenarios and prompts --------------------------------------------------------------------------------


@query(
    "pr46_scenario",
    b.with_sql("cases")
    + """SELECT case_id, CASE WHEN tr THEN 'trace_diff' WHEN status = 'no_diff' THEN 'no_diff' ELSE coalesce(CASE WHEN k % 3 = 0 THEN 'process_failure' END, 'execution_failure') END AS scenario_type, baseline_version,
    CASE WHEN k % 4 = 0 THEN 'org.a:b' ELSE 'org.r:' || (k % 6) END AS artifact, CASE WHEN tr OR status = 'no_diff' THEN CASE WHEN k % 2 = 0 THEN 'com.lib.Parser, Parser' ELSE '' END END AS trace_keywords,
    CASE WHEN NOT tr AND status <> 'no_diff' THEN CASE WHEN k % 3 = 1 THEN 'a.b.C, NoSuchMethodError' WHEN k % 3 = 2 THEN 'Cause' || (k % 4) ELSE 'Log' || (k % 5) END END AS failure_keywords,
    CASE WHEN k % 6 < 3 THEN 'success' ELSE 'unknown' END AS base_obs, CASE WHEN k % 5 = 0 THEN 'success' WHEN tr OR status = 'no_diff' THEN 'unknown' ELSE 'not_run' END AS target_obs FROM (SELECT *, status = 'trace_diff' OR k % 7 = 0 AS tr FROM cases)""",
)
def pr46(spark, sf):
    k = F.col("k")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    none = F.lit(None).cast("string")
    d = b.cases(spark, sf).select(
        "case_id", "k", "status", "baseline_version", "target_version", F.when(k % 3 == 0, "process_failure").alias("failure_kind"), F.when(k % 4 == 0, "org.a:b").alias("artifact"), j("org.r:", k % 6).alias("r_artifact"),
        none.alias("description"), (k % 7 == 0).alias("trace_has_effective_difference"), F.lit(True).alias("trace_has_difference"), F.when(k % 2 == 0, "enter com.lib.Parser now").alias("trace_summary_text"),
        F.when(k % 6 < 3, "success").alias("baseline_execution_observation"), F.when(k % 5 == 0, "success").alias("target_observed"), none.alias("target_execution_observation"), none.alias("baseline_observed"),
        F.when(k % 3 == 1, "at a.b.C is NoSuchMethodError").alias("failure_excerpt"), F.when(k % 3 == 2, j("Cause", k % 4, " it")).alias("dataset_cause"), j("Log", k % 5, " x").alias("log_text"),
        none.alias("log_command"), none.alias("baseline_command"), none.alias("target_command"),
    )
    s = jg.scenario(d)
    return s.select(
        "case_id", "scenario.scenario_type", "scenario.baseline_version", "scenario.artifact", "scenario.trace_keywords", F.col("scenario.failure_excerpt_keywords").alias("failure_keywords"),
        F.col("scenario.baseline_execution_observation").alias("base_obs"), F.col("scenario.target_execution_observation").alias("target_obs"),
    )


_CTX = """concat_ws(chr(10), '- case_id: ' || case_id, '- cve_id: ' || cve_id, '- baseline_version: ' || baseline_version, '- target_version: ' || target_version, '- status: ' || status, '- failure_subtype: ' || failure_subtype)"""
_DESC = "CASE WHEN k % 3 = 0 THEN 'about ' || cve_id ELSE '(description unavailable)' END"


def _prompt_cases(spark, sf):
    return b.cases(spark, sf).withColumn("description", F.when(F.col("k") % 3 == 0, F.concat(F.lit("about "), "cve_id")))


@query(
    "pr45_hunk_prompts",
    b.with_sql("cases")
    + f"""SELECT case_id, concat_ws(chr(10), 'Task', {_DESC}, chr(10) || 'Case context:', {_CTX}, chr(10) || 'Evidence kind:', 'pom_diff', chr(10) || 'Evidence path:', CASE WHEN k % 2 = 0 THEN 'version-diff/pom.diff' ELSE '(path unavailable)' END,
    chr(10) || 'Evidence excerpt:', CASE WHEN k % 5 = 0 THEN '(evidence unavailable)' ELSE '+ v' || (k % 5) END) AS prompt FROM cases""",
)
def pr45_hunk(spark, sf):
    k = F.col("k")
    d = _prompt_cases(spark, sf).withColumns(
        {"evidence_kind": F.lit("pom_diff"), "path": F.when(k % 2 == 0, "version-diff/pom.diff"), "diff_excerpt": F.when(k % 5 > 0, F.concat(F.lit("+ v"), k % 5, F.lit("\n")))}
    )
    return jg.hunk_prompts(d, "Task").select("case_id", "prompt")


@query(
    "pr45_case_prompts",
    b.with_sql("cases")
    + f"""SELECT case_id, concat_ws(chr(10), 'Task', {_DESC}, chr(10) || 'Case context:', {_CTX}, chr(10) || 'Relevant evidence items:',
    CASE WHEN k % 7 = 0 THEN '(no selected hunk/evidence item was available)' ELSE array_to_string(list_transform(generate_series(1, least(5, k % 7)), lambda i: 'Evidence Item ' || i || ' [kind]: p' || i || chr(10) || 'x' || (k % 4) || chr(10) || 'Notes: n ' || i || chr(10)), chr(10)) END) AS prompt FROM cases""",
)
def pr45_case(spark, sf):
    k, i = F.col("k"), F.col("item")
    c = _prompt_cases(spark, sf)
    items = c.where("k % 7 > 0").select("case_id", "k", F.explode(F.sequence(F.lit(1), (k % 7).cast("int"))).alias("item")).select(
        "case_id", "item", F.concat(F.lit("p"), i).alias("path"), F.lit("kind").alias("evidence_kind"), F.concat(F.lit(" x"), k % 4).alias("diff_excerpt"), F.concat(F.lit("n\n"), i).alias("details")
    )
    return jg.case_prompts(c, items, "Task").select("case_id", "prompt")

