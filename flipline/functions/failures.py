"""Classification of build, run and driver logs by ordered keyword rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipline.functions.text import clean_text, col, join_lines, let, lines

# Keywords and their classes, in the order in which the rules apply.
DEPENDENCY_WORDS = [
    "could not resolve dependencies",
    "failed to collect dependencies",
    "could not transfer artifact",
]
MISSING_ARTIFACT = "could not find artifact"
MISSING_ARTIFACT_FILE = "artifact file does not exist:"
TOOLCHAIN_WORDS = ["invalid target release", "source option", "target option", "release version"]
AGENT_WORDS = ["agent library failed to init", "error opening zip file or jar manifest missing"]
ASM_WORDS = ["org.objectweb.asm", " asm", "classreader", "methodwriter", "frame", "generator"]
LINKAGE_WORDS = [
    "nosuchfielderror",
    "verifyerror",
    "incompatibleclasschangeerror",
    "bootstrapmethoderror",
    "linkageerror",
]
TEST_WORDS = ["test timed out", "there are test failures", "tests in error:", "tests run:"]
RUNTIME_WORDS = [
    "there are test failures",
    "tests in error:",
    "test timed out",
    "forked vm terminated without saying properly goodbye",
    "agent library failed to init",
    "error opening zip file or jar manifest missing",
    "could not create the java virtual machine",
    "surefirebooterforkexception",
]
COMPILE_WORDS = [
    "compilation error",
    "cannot find symbol",
    "package ",
    " does not exist",
    "fatal error compiling",
    "invalid target release",
    "source option",
    "target option",
    "release version",
    "mojofailureexception",
]
TRACE_PACKAGE_ERROR = "unable to infer trace packages from imports. please pass --trace-packages explicitly."
BASELINE_FAILED = r"(?i)Baseline version .* did not complete successfully"
TARGET_FAILED = r"(?i)Target version .* did not complete successfully"
STATUS_LINE = r"(?mU)^Status:\s*(.+?)\s*$"
LOG_FALLBACKS = [
    ("exploit_demo_not_found", r"(?i)Exploit demo not found"),
    ("timeout_hint", r"(?iU)timed?\s*out|TimeoutExpired"),
    ("result_path_only", r"(?mU)^Result:\s+.+$"),
]
STATUS_PRIORITY = {
    "trace_diff": 5,
    "compile_failure": 4,
    "execution_failure": 3,
    "runner_error": 2,
    "timeout": 1,
    "no_diff": 0,
}


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify_failure(c: Column | str) -> Column:
    """Kind of failure a build log shows, or null."""
    text = F.coalesce(col(c), F.lit(""))
    low = F.lower(text)
    goal = low.contains("failed to execute goal")
    return (
        F.when(low.contains("compilation error"), "compile_failure")
        .when(goal & has_any(low, [":compile", ":testcompile"]), "compile_failure")
        .when(has_any(low, [*DEPENDENCY_WORDS, MISSING_ARTIFACT]), "dependency_resolution_failure")
        .when(has_any(low, ["there are test failures.", "failures!!!", "tests run:"]), "test_failure")
        .when(text.contains('exception in thread "main"') | low.contains("caused by:"), "runtime_failure")
        .when(low.contains("build failure"), "build_failure")
    )


def _flag(value: Column | bool) -> Column:
    return F.coalesce(value if isinstance(value, Column) else F.lit(value), F.lit(False))


def _lowered(c: Column | str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def _subtype(low: Column, removed: Column, breaking: Column) -> Column:
    no_symbol = low.contains("cannot find symbol")
    return (
        F.when(has_any(low, DEPENDENCY_WORDS), "dependency_resolution_failure")
        .when(has_any(low, TOOLCHAIN_WORDS), "toolchain_incompatibility")
        .when(has_any(low, AGENT_WORDS), "trace_agent_initialization_failure")
        .when(low.contains("arrayindexoutofboundsexception") & has_any(low, ASM_WORDS), "asm_instrumentation_failure")
        .when(low.contains("nosuchmethoderror") | (no_symbol & low.contains("method")), "missing_method")
        .when(has_any(low, ["noclassdeffounderror", "classnotfoundexception"]), "missing_class")
        .when(no_symbol & low.contains("class"), "missing_class")
        .when(low.contains("package ") & low.contains(" does not exist"), "missing_class")
        .when(has_any(low, LINKAGE_WORDS), "binary_incompatibility")
        .when(low.contains("no suitable constructor found"), "constructor_signature_change")
        .when(has_any(low, TEST_WORDS), "test_failure")
        .when(removed, "api_breaking_change")
        .when(breaking, "signature_change")
        .otherwise("unknown_failure")
    )


def failure_subtype(c: Column | str, has_removed_classes: Column | bool, has_breaking: Column | bool) -> Column:
    """Finer class of a failure: structural causes first, the API diff as the last resort.

    The text is bound once, so a long rule list does not repeat the expression it is applied to.
    """
    return let(_lowered(c), lambda low: _subtype(low, _flag(has_removed_classes), _flag(has_breaking)))


def failure_from_text(c: Column | str, has_removed_classes: Column | bool, has_breaking: Column | bool) -> Column:
    """STRUCT<status, kind, subtype> of a failed run, from its log text."""

    def judge(low: Column) -> Column:
        missing = has_any(low, [MISSING_ARTIFACT_FILE, *DEPENDENCY_WORDS])
        runtime = has_any(low, RUNTIME_WORDS)
        status = F.when(missing | runtime | ~has_any(low, COMPILE_WORDS), "execution_failure").otherwise("compile_failure")
        subtype = _subtype(low, _flag(has_removed_classes), _flag(has_breaking))
        linked = ~runtime & (subtype == "unknown_failure") & low.contains("linkageerror")
        return F.struct(
            status.alias("status"),
            F.when(missing, "dependency_resolution_failure").otherwise(status).alias("kind"),
            F.when(missing, "dependency_resolution_failure")
            .when(linked, "binary_incompatibility")
            .otherwise(subtype)
            .alias("subtype"),
        )

    return let(_lowered(c), judge)


def classify_log(c: Column | str) -> Column:
    """Status reported by a driver log, or the kind of log it is."""
    text = F.coalesce(col(c), F.lit(""))
    status = F.nullif(F.regexp_extract(text, STATUS_LINE, 1), F.lit(""))
    out = F.when(status.isNotNull(), clean_text(status)).when(clean_text(text) == "", "empty_log")
    for label, pattern in LOG_FALLBACKS:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise("unknown")


def is_error_mark(line: Column) -> Column:
    return line.contains("COMPILATION ERROR") | line.startswith("[ERROR]") | line.contains("BUILD FAILURE")


def classify_lines(line: Column, pos: Column) -> tuple[list[Column], Column]:
    """:func:`classify_log` over the lines of a log as rows: aggregates of a log, and the class that follows from them."""
    text = F.coalesce(line, F.lit(""))
    status = F.nullif(F.regexp_extract(text, STATUS_LINE, 1), F.lit(""))
    sums = [F.min(F.when(status.isNotNull(), F.struct(pos.alias("pos"), status.alias("status")))).alias("__status"), F.bool_or(clean_text(text) != "").alias("__any")]
    sums += [F.bool_or(text.rlike(pattern)).alias(f"__{label}") for label, pattern in LOG_FALLBACKS]
    out = F.when(F.col("__status").isNotNull(), clean_text("__status.status")).when(~F.col("__any"), "empty_log")
    for label, _ in LOG_FALLBACKS:
        out = out.when(F.col(f"__{label}"), label)
    return sums, out.otherwise("unknown")


def error_excerpt(c: Column | str, max_lines: int = 80) -> Column:
    """Lines from just before the first error marker; the tail of the log when there is none."""

    def cut(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, is_error_mark), True).cast("int")
        tail = F.greatest(F.size(rows) - max_lines + 1, F.lit(1))
        start = F.when(first > 0, F.greatest(first - 3, F.lit(1))).otherwise(tail)
        return join_lines(F.slice(rows, start, F.lit(max_lines)))

    return let(lines(c), cut)


def status_priority(c: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in STATUS_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, col(c)), F.lit(-1))


def observation_stage(run_log: Column, has_baseline: Column, has_target: Column) -> Column:
    """Which side of a comparison failed: named by the run log, else by the files it left."""
    text = F.coalesce(run_log, F.lit(""))
    return (
        F.when(text.rlike(BASELINE_FAILED), "baseline")
        .when(text.rlike(TARGET_FAILED), "target")
        .when(has_baseline & ~has_target, "baseline")
        .when(has_target, "target")
    )
