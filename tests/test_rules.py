"""One row per branch of the rule lists, with expectations written out."""

import pytest
from pyspark.sql import functions as F

from flipline.functions import evidence as ev
from flipline.functions import failures as fl
from flipline.functions import labels as lb
from flipline.functions import scoring as sc
from flipline.functions import text as tx
from flipline.functions import versions as vs
from flipline.operators import search as se


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def L(x):
    return F.lit(x)


SUBTYPES = [
    ("Could not transfer artifact x", "dependency_resolution_failure"),
    ("Source option 5 is no longer supported", "toolchain_incompatibility"),
    ("Error opening zip file or JAR manifest missing", "trace_agent_initialization_failure"),
    ("ArrayIndexOutOfBoundsException in Frame", "asm_instrumentation_failure"),
    ("ArrayIndexOutOfBoundsException somewhere", "unknown_failure"),
    ("cannot find symbol: method a()", "missing_method"),
    ("ClassNotFoundException; there are test failures", "missing_class"),
    ("cannot find symbol: class A", "missing_class"),
    ("package a.b does not exist", "missing_class"),
    ("BootstrapMethodError", "binary_incompatibility"),
    ("no suitable constructor found", "constructor_signature_change"),
    ("Test timed out", "test_failure"),
    ("", "unknown_failure"),
]


def test_failure_subtypes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SUBTYPES)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(fl.failure_subtype("t", False, False)).collect()]
    assert got == [w for _, w in SUBTYPES]
    assert one(spark, fl.failure_subtype(L("x"), True, True), fl.failure_subtype(L("x"), False, True)) == ("api_breaking_change", "signature_change")


def test_failure_kind_and_logs(spark):
    assert one(
        spark,
        fl.classify_failure(L('exception in thread "main"')),
        fl.classify_failure(L('Exception in thread "main"')),
        fl.classify_failure(L("Tests run: 3")),
        fl.classify_failure(L("fine")),
        fl.classify_log(L("a\nStatus:   trace_diff  \nb")),
        fl.classify_log(L(" \n")),
        fl.classify_log(L("TimeoutExpired")),
    ) == ("runtime_failure", None, "test_failure", None, "trace_diff", "empty_log", "timeout_hint")
    log = "\n".join(f"l{i}" for i in range(10)) + "\n[ERROR] bad\nrest"
    assert one(spark, fl.error_excerpt(L(log), 5), fl.error_excerpt(L("a\nb\nc"), 2)) == ("l7\nl8\nl9\n[ERROR] bad\nrest", "b\nc")


def test_scores_round_half_even_and_reject_non_numbers(spark):
    vals = ["2.5", "3.5", "nan", "inf", "abc", None, " 41 ", "-3", "1e3"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(sc.clamp_score("v", 7)).collect()] == [2, 4, 7, 7, 7, 7, 41, 0, 100]
    assert one(spark, sc.rule_presence_score(L(0.0), L(0.5), L(0)), sc.rule_presence_score(L(20.0), L(0.0), L(9))) == (52, 15)


BASE = dict(
    scenario_type="no_diff", status="no_diff", failure_subtype=None, fix_evidence_strength="none", exploit_breakage_evidence_strength="none",
    final_failure_reason="undetermined", vulnerability_presence_verdict="unknown", seek_patch=True, trace_has_effective_difference=False,
    trace_evidence_valid=None, baseline_execution_observation="", target_execution_observation="", vulnerability_presence_score="60",
)
TRACE = dict(scenario_type="trace_diff", status="trace_diff", failure_subtype="trace_difference", trace_has_effective_difference=True)
ABSENT = dict(final_failure_reason=sc.ABSENT)
PREDICT = [
    ({**TRACE, "baseline_execution_observation": "test_failure", "target_execution_observation": "success"}, "not affected"),
    ({"seek_patch": False}, "affected"),
    ({"seek_patch": False, "status": "x", "failure_subtype": "invalid_trace_difference"}, "affected"),
    ({**TRACE, **ABSENT, "fix_evidence_strength": "strong", "vulnerability_presence_score": "14"}, "affected"),
    ({**TRACE, **ABSENT, "fix_evidence_strength": "strong", "vulnerability_presence_score": "15"}, "unknown"),
    ({**TRACE, **ABSENT, "fix_evidence_strength": "strong", "exploit_breakage_evidence_strength": "Weak"}, "affected"),
    ({**TRACE, **ABSENT}, "unknown"),
    ({**TRACE, **ABSENT, "trace_evidence_valid": False}, "not affected"),
    (ABSENT, "not affected"),
    ({"final_failure_reason": sc.BROKEN, "scenario_type": "compile_failure"}, "affected"),
    ({"scenario_type": "execution_failure", "status": "x", "seek_patch": False}, "affected"),
    ({"vulnerability_presence_score": "45.4"}, "not affected"),
    ({"vulnerability_presence_score": "80"}, "affected"),
    ({"vulnerability_presence_score": None, "vulnerability_presence_verdict": "YES"}, "affected"),
    ({"vulnerability_presence_score": "x", "vulnerability_presence_verdict": "no"}, "not affected"),
    ({}, "unknown"),
]


def test_predicted_labels(spark):
    schema = "i int, " + ", ".join(
        f"{k} {'boolean' if k in ('seek_patch', 'trace_has_effective_difference', 'trace_evidence_valid') else 'string'}" for k in BASE
    )
    rows = [(i, *{**BASE, **change}.values()) for i, (change, _) in enumerate(PREDICT)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.orderBy("i").select(sc.predict_label()).collect()]
    assert got == [w for _, w in PREDICT]
    strict = [r[0] for r in df.orderBy("i").select(sc.predict_label(strict_compat=True)).collect()]
    assert strict[1] == "unknown" and strict[0] == "not affected"


def test_labels(spark):
    assert one(
        spark, lb.polarity(L("unaffected")), lb.polarity(L("Not affected")), lb.pred_state(L("notaffected")), lb.is_false(L(None).cast("string")), lb.is_false(L(" FALSE ")),
        lb.verdict01(L("affected_patch")), lb.verdict01(L("0")), lb.align_three_state(L("affected"), L("No_Data")), lb.map_status(L(" ")),
    ) == ("POS", "NEG", "affected", False, True, 1, 0, "No_Data", " ")


def test_version_order(spark):
    want = ["foo", "1.0-alpha", "1.0-rc1", "1.0.RC2", "1.0", "1.0-jdk8", "1.0-odd_1", "1.0-x-y", "1.0.1", "1.9.5", "1.10"]
    df = vs.with_version_parts(spark.createDataFrame([(v,) for v in reversed(want)], "version string"))
    assert [r["version"] for r in df.orderBy("order_key").collect()] == want


def test_text_helpers(spark):
    assert one(
        spark, F.size(tx.lines(L(""))), F.size(tx.lines(L("a\r\nb c\n"))), tx.clean_text(L("　 a \x1f")), tx.shorten(L("a  b\nc"), 4), tx.truncate_block(L("ab\ncd\nef"), 5, 5),
        tx.truncate_block(L("a\nb\nc"), 2, 99), F.array_join(tx.identifiers(L("see a.b.C and Foo1 or Éab")), ","), F.array_join(tx.search_terms(L("CVE-1 1.2.3 'alpha', alpha beta_x 12ab the")), ","),
    ) == (0, 3, "a", "a...", "ab\n...(truncated)", "a\nb\n...(truncated)", "a.b.C,Foo1", "alpha,beta_x")


def test_answers_and_evidence(spark):
    md = "x Final response: old\nFinal response:\n# Diagnosis\na\n```\nb\n2) **Selected Hunks:**\n- diffs/a/B$1.diff: why\n+ code\n- no path\n1. version-diff/pom.diff\n"
    d = spark.createDataFrame([(md,)], "md string").select(ev.parse_sections(ev.final_response("md")).alias("s"))
    s = d.first()["s"]
    assert s["Diagnosis"] == "a\nb" and s["Open Questions"] == ""
    h = d.select(ev.parse_hunks(F.col("s")["Selected Hunks"]).alias("h")).first()["h"]
    assert [(x["path"], x["details"]) for x in h] == [("version-diff/diffs/a/B$1.diff", "why\n+ code\n- no path"), ("version-diff/pom.diff", "")]
    assert one(spark, ev.is_shallow_api(L("api-diffs/A.diff"), L("+ int a;\n- foo();\n")), ev.is_shallow_api(L("api-diffs/A.diff"), L("\n".join(f"+ x = {i} + y" for i in range(12)))), ev.is_shallow_api(L("diffs/A.diff"), L("+ int a;"))) == (True, False, False)


def test_anchor_and_terms(spark):
    text = "alpha\nbeta gamma\nvalidateEverything here\nend"
    assert one(spark, se.best_anchor(L(text), F.array(L("GAMMA"), L("validateEverything"))), se.best_anchor(L(text), F.array(L("zz")))) == (3, None)
    win = one(spark, se.context_window(L(text), L(3), 1))[0]
    assert (win["start_line"], win["end_line"], win["preview"]) == (2, 4, "00002: beta gamma\n00003: validateEverything here\n00004: end")
    assert one(spark, F.array_join(se.anchor_terms(L('"foo(bar)", ab\nbaz qux')), "|"))[0] == "foo(bar)|baz qux|baz|qux"
    terms = one(spark, F.array_join(tx.repair_terms(L("Parser.class.diff"), L("x.parser"), F.array(L("org.Foo$Bar")), L("see com.x.Parser")), "|"))[0]
    assert terms == "x.parser|com.x.Parser|Parser|org.Foo$Bar"


@pytest.mark.parametrize("text,want", [("package org.a:b, which", "org.a:b"), ("PACKAGE 'x:y'.", "x:y"), ("no package here", None), ("", None)])
def test_coordinate_from_text(spark, text, want):
    assert one(spark, vs.gav_from_text(L(text)))[0] == want
