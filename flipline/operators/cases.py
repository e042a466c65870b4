"""Cases of a batch: ids, selection, status, repair of runner errors, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.functions.failures import (
    DEPENDENCY_WORDS,
    MISSING_ARTIFACT_FILE,
    TRACE_PACKAGE_ERROR,
    failure_from_text,
    failure_subtype,
    has_any,
    observation_stage,
    status_priority,
)
from flipline.functions.labels import is_false
from flipline.functions.text import clean_text, col, join_present
from flipline.operators.scans import first_of

# Selection modes and reasons recorded for repaired runs.
SELECTIONS = {
    "compile-false": ("compile", False),
    "seek-patch-false": ("seek_patch", False),
    "seek-patch-true": ("seek_patch", True),
}
REPAIR_REASONS = {
    "baseline": "baseline version analysis produced actionable failure logs",
    "target": "target version analysis produced actionable failure logs",
    "artifact": "version diff artifact lookup failed due to missing dependency artifacts",
    "packages": "trace package inference failed before analysis execution",
}


def slug(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(col(c), "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def case_id(
    cve: Column | str, index: Column | str, appears: Column | str, not_appears: Column | str,
    base_tag: Column | str | None = None, head_tag: Column | str | None = None,
) -> Column:
    """``issue__NN__left__right`` with tags and the pair number as fallbacks."""
    empty = F.lit("")

    def side(version, tag) -> Column:
        parts = [F.nullif(col(version), empty)]
        if tag is not None:
            parts.append(F.nullif(col(tag), empty))
        return slug(F.coalesce(*parts, F.concat(F.lit("pair"), col(index).cast("string"))))

    return F.concat_ws(
        "__", col(cve), F.format_string("%02d", col(index).cast("int")), side(appears, base_tag), side(not_appears, head_tag)
    )


def select_cases(df: DataFrame, mode: str, only: list[str] | None = None, limit: int | None = None, cve: str = "cve", index: str = "pair_index") -> DataFrame:
    """Pairs of a selection mode; a missing flag is neither true nor false."""
    flag, wanted = SELECTIONS[mode]
    out = df.where(F.col(flag).eqNullSafe(F.lit(wanted)))
    if only:
        out = out.where(F.col(cve).isin(*only))
    return out.orderBy(cve, index).limit(limit) if limit is not None else out


def select_for_judgment(df: DataFrame, statuses: list[str], keep_no_diff: bool = True) -> DataFrame:
    """Cases whose status is wanted, plus undiffed ones that do not look for a patch."""
    if not statuses:
        return df
    cond = F.col("status").isin(*statuses)
    if keep_no_diff:
        cond = cond | ((F.col("status") == "no_diff") & is_false("seek_patch"))
    return df.where(cond)


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in an order fixed by the seed and the key alone, whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed)))), F.col(key)).limit(n)


def case_status(df: DataFrame) -> DataFrame:
    """Status, kind and subtype of a run from its exit code, failure excerpt, observation and trace summary.

    Reads ``driver_exit_code, failure_excerpt, target_observation, scenario_type, error_text, trace_has_difference,
    trace_has_effective_difference, has_removed_classes, has_breaking``.
    """
    effective = F.coalesce("trace_has_effective_difference", "trace_has_difference", F.lit(False))
    excerpt = F.coalesce("failure_excerpt", F.lit("")) != ""
    failed_to_build = excerpt & F.coalesce(F.col("target_observation") == "compile_failure", F.lit(False))
    broken = F.coalesce(F.col("driver_exit_code") != 0, F.lit(True))
    scenario = F.nullif("scenario_type", F.lit(""))
    observed = F.nullif("target_observation", F.lit(""))
    subtype = failure_subtype("error_text", F.col("has_removed_classes"), F.col("has_breaking"))
    return df.withColumns(
        {
            "status": F.when(broken, "runner_error")
            .when(failed_to_build, "compile_failure")
            .when(excerpt, "execution_failure")
            .when(effective, "trace_diff")
            .otherwise("no_diff"),
            "failure_kind": F.when(broken, "runner_error")
            .when(failed_to_build, F.coalesce(scenario, F.lit("compile_failure")))
            .when(excerpt, F.coalesce(observed, scenario, F.lit("execution_failure"))),
            "failure_subtype": F.when(broken, "runner_error")
            .when(excerpt, subtype)
            .when(effective, "trace_difference")
            .when(F.col("trace_has_difference"), "invalid_trace_difference"),
        }
    )


def normalize_runner_error(df: DataFrame) -> DataFrame:
    """Re-classify runner errors from what the run left behind.

    Reads ``status, failure_kind, failure_subtype, run_log, dataset_cause, baseline_excerpt, target_excerpt,
    baseline_log, target_log`` (a null text is a missing file), ``has_removed_classes, has_breaking`` and the two
    observation columns; an optional ``test_results`` array of structs with the same fields follows its case.
    """
    t = {c: F.coalesce(c, F.lit("")) for c in ("run_log", "dataset_cause", "baseline_excerpt", "target_excerpt", "baseline_log", "target_log")}
    has_base = F.col("baseline_excerpt").isNotNull() | F.col("baseline_log").isNotNull()
    has_target = F.col("target_excerpt").isNotNull() | F.col("target_log").isNotNull()
    stage = observation_stage(F.col("run_log"), has_base, has_target)
    flags = (F.col("has_removed_classes"), F.col("has_breaking"))
    side_text = lambda a, b: join_present(t["dataset_cause"], t["run_log"], t[a], t[b])
    everything = F.lower(join_present(*t.values()))
    missing = has_any(everything, [MISSING_ARTIFACT_FILE, *DEPENDENCY_WORDS[:2]])
    route = (
        F.when(F.col("status") != "runner_error", F.lit(None).cast("string"))
        .when((stage == "baseline") & has_base, "baseline")
        .when((stage == "target") & has_target, "target")
        .when(missing, "artifact")
        .when(everything.contains(TRACE_PACKAGE_ERROR), "packages")
    )
    found = F.when(F.col("__route") == "baseline", failure_from_text(side_text("baseline_excerpt", "baseline_log"), *flags)).when(
        F.col("__route") == "target", failure_from_text(side_text("target_excerpt", "target_log"), *flags)
    )
    d = df.withColumns({"__route": route, "__stage": stage}).withColumn("__f", found)
    fixed = F.col("__route").isNotNull()
    direct = F.col("__route").isin("baseline", "target")
    status = F.when(direct, F.col("__f.status")).otherwise("execution_failure")
    kind = F.when(direct, F.col("__f.kind")).when(F.col("__route") == "artifact", "dependency_resolution_failure").otherwise(
        "trace_package_inference_failure"
    )
    subtype = F.when(direct, F.col("__f.subtype")).when(F.col("__route") == "artifact", "dependency_resolution_failure").otherwise("unknown_failure")
    seen = (
        F.when(status == "compile_failure", "compile_failure")
        .when(kind == "dependency_resolution_failure", "dependency_resolution_failure")
        .otherwise("execution_failure")
    )
    reasons = F.create_map(*[F.lit(x) for pair in REPAIR_REASONS.items() for x in pair])
    watched = F.when(direct, F.col("__route")).when(F.col("__route") == "artifact", "target")
    new = {
        "status": F.when(fixed, status).otherwise(F.col("status")),
        "failure_kind": F.when(fixed, kind).otherwise(F.col("failure_kind")),
        "failure_subtype": F.when(fixed, subtype).otherwise(F.col("failure_subtype")),
        "normalization_reason": F.try_element_at(reasons, F.col("__route")),
        "normalized_from_runner_error": fixed,
    }
    for side in ("baseline", "target"):
        name = f"{side}_execution_observation"
        old = F.nullif(F.col(name), F.lit(""))
        new[name] = F.when(watched == side, F.coalesce(old, seen)).otherwise(F.col(name))
    if "test_results" in df.columns:
        def repair(x: Column) -> Column:
            y = x.withField("status", status).withField("failure_kind", kind).withField("failure_subtype", subtype)
            for side in ("baseline", "target"):
                name = f"{side}_execution_observation"
                y = y.withField(name, F.when(F.col("__stage") == side, F.coalesce(F.nullif(x[name], F.lit("")), seen)).otherwise(x[name]))
            return F.when(fixed & (x["status"] == "runner_error"), y).otherwise(x)

        new["test_results"] = F.transform("test_results", repair)
    return d.withColumns(new).drop("__route", "__stage", "__f")


def best_test(tests: DataFrame, case: str = "case_id", pos: str = "test_pos") -> DataFrame:
    """Test that speaks for a case: highest status priority, earliest on ties, plus status counts.

    Test rows themselves stay in their table, keyed by case; a case may have any number of them.
    """
    order = F.struct(status_priority("status").alias("p"), (-F.col(pos)).alias("i"))
    rest = [c for c in tests.columns if c != case]
    best = tests.groupBy(case).agg(F.max_by(F.struct(*rest), order).alias("b"), F.count(F.lit(1)).alias("test_result_count"))
    counts = tests.groupBy(case, F.coalesce("status", F.lit("unknown")).alias("s")).count()
    by_status = counts.groupBy(case).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "count")))).alias("status_counts"))
    return best.join(by_status, case).select(case, *[F.col(f"b.{c}").alias(c) for c in rest], "test_result_count", "status_counts")


def complete_results(expected: DataFrame, results: DataFrame, case: str = "case_id") -> DataFrame:
    """Expected cases with the status and subtype of their result document, or why there is none.

    ``results`` has ``is_valid`` beside the parsed fields, as :func:`flipline.sources.readers.read_case_results`
    returns it.
    """
    r = results.withColumn("__has", F.lit(True))
    d = expected.join(r, case, "left")
    gone, bad = F.col("__has").isNull(), ~F.coalesce("is_valid", F.lit(False))
    word = lambda c, default: F.coalesce(F.nullif(clean_text(c), F.lit("")), F.lit(default))
    mark = lambda c, default: (
        F.when(gone, "missing_case_result").when(bad, "invalid_case_result_json").otherwise(word(c, default))
    )
    return d.withColumns({"status": mark("status", "unknown"), "failure_subtype": mark("failure_subtype", "none")}).drop("__has", "is_valid")


def resume(cases: DataFrame, done: DataFrame, key: str = "case_id", force: bool = False) -> DataFrame:
    """Cases that still have to run."""
    return cases if force else cases.join(done.select(key).distinct(), key, "left_anti")


def batch_summary(scheduled: DataFrame, results: DataFrame, case: str = "case_id") -> DataFrame:
    """One row of totals over the scheduled cases that have a result."""
    d = scheduled.select(case).join(results.withColumn("__has", F.lit(True)), case, "left")
    has = F.col("__has").isNotNull()
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))
    differs = has & F.coalesce("trace_has_difference", F.lit(False))
    effective = F.coalesce("trace_has_effective_difference", "trace_has_difference", F.lit(False))
    timed_out = has & (F.coalesce("timed_out", F.lit(False)) | (status == "timeout"))
    return d.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(has).alias("completed_cases"),
        F.count_if(timed_out).alias("timed_out_cases"),
        F.count_if(differs).alias("trace_diff_cases"),
        F.count_if(differs & effective).alias("effective_trace_diff_cases"),
        F.count_if(differs & ~effective).alias("invalid_trace_diff_cases"),
    )


def batch_counts(scheduled: DataFrame, results: DataFrame, fields: list[str], case: str = "case_id") -> DataFrame:
    """Scheduled cases with a result per value of each field, as rows (field, value, cases); no value counts as unknown."""
    done = results.join(scheduled.select(case), case, "left_semi")
    named = [
        F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("unknown")).alias("value"))
        for f in fields
    ]
    return done.select(F.inline(F.array(*named))).groupBy("field", "value").agg(F.count(F.lit(1)).alias("cases"))


def backfill_description(cases: DataFrame, catalog: DataFrame, cve: str = "cve_id") -> DataFrame:
    """Take the catalog's description where it differs; mark changed cases and issues the catalog lacks."""
    known = catalog.select(F.col("cve").alias(cve), clean_text("description").alias("__d")).where("__d <> ''")
    d = cases.join(known, cve, "left")
    found = F.col("__d").isNotNull()
    return d.withColumns(
        {
            "is_changed": found & (clean_text("description") != F.col("__d")),
            "is_missing": ~found & (clean_text(cve) != ""),
            "description": F.coalesce("__d", "description"),
        }
    ).drop("__d")


def merge_batches(a: DataFrame, b: DataFrame, keys=("cve_id", "pair_index")) -> DataFrame:
    """Union of two summaries; where both have a case the first one counts."""
    both = a.withColumn("__src", F.lit(0)).unionByName(b.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return first_of(both, list(keys), "__src").drop("__src")
