"""Presence scores, their parts, normalised judgments and the predicted label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipline.functions.labels import AFFECTED, NOT_AFFECTED, UNKNOWN, is_false
from flipline.functions.signals import breakage_bonus, fix_bonus
from flipline.functions.text import clean_text, col, join_lines, shorten, strip

# Enumerations, thresholds and points.
ABSENT = "vulnerability_not_present"
BROKEN = "exploit_invalid_due_to_version_change"
UNDETERMINED = "undetermined"
REASONS = [ABSENT, BROKEN, UNDETERMINED]
PRESENCE = ["no", "possibly_yes", "unknown"]
CONFIDENCE = ["high", "medium", "low"]
STRENGTH = ["strong", "medium", "weak", "none"]
HUNK_JUDGMENTS = ["fix_evidence", "exploit_breakage_evidence", "neutral"]
LOW_SCORE = 45
HIGH_SCORE = 80
FIX_POINTS = {"none": 0, "weak": 8, "medium": 18, "strong": 30}
BREAKAGE_POINTS = {"none": 0, "weak": 6, "medium": 14, "strong": 24}
CONFIDENCE_POINTS = {"low": 0, "medium": 2, "high": 4}
PRESENCE_BASE = {"no": 32, "possibly_yes": 68, "unknown": 50}
REASON_OFFSET = {ABSENT: -12, BROKEN: 8, UNDETERMINED: 0}
MAX_KEY_EVIDENCE = 8
DEFAULT_RATIONALE = (
    "The final LLM judgment did not provide a usable rationale, so the result should be treated as low confidence."
)
DEFAULT_HUNK_REASONING = "The per-hunk LLM judgment did not provide a usable rationale."


def lookup(c: Column, table: dict[str, int], default: int = 0) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, F.lower(clean_text(c))), F.lit(default))


def fix_points(c: Column | str) -> Column:
    return lookup(col(c), FIX_POINTS)


def breakage_points(c: Column | str) -> Column:
    return lookup(col(c), BREAKAGE_POINTS)


def confidence_points(c: Column | str) -> Column:
    return lookup(col(c), CONFIDENCE_POINTS)


def numeric(c: Column | str) -> Column:
    """Finite number of a value, or null."""
    number = strip(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def rounded_score(c: Column | str) -> Column:
    """Half-even rounding to an integer; null when the value is no number."""
    return F.rint(numeric(c)).cast("int")


def clamp_score(c: Column | str, default: Column | int = 50) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    number = numeric(c)
    # least and greatest skip nulls, so a missing number is kept apart from them.
    whole = F.when(number.isNotNull(), F.least(F.greatest(F.rint(number), F.lit(0.0)), F.lit(100.0)))
    return F.coalesce(whole.cast("int"), F.least(F.greatest(fallback, F.lit(0)), F.lit(100)).cast("int"))


def derived_presence_score(
    reason: Column, presence: Column, confidence: Column, fix: Column, breakage: Column, evidence: Column
) -> Column:
    """Score of a judgment that came without one."""
    score = (
        lookup(presence, PRESENCE_BASE, 50)
        + lookup(reason, REASON_OFFSET)
        + breakage_points(breakage)
        - fix_points(fix)
        + breakage_bonus(evidence)
        - fix_bonus(evidence)
    )
    away = F.when(score > 50, confidence_points(confidence)).when(score < 50, -confidence_points(confidence)).otherwise(0)
    return F.least(F.greatest(score + away, F.lit(0)), F.lit(100)).cast("int")


def rule_presence_score(absent: Column, breakage: Column, uncertain: Column) -> Column:
    """50 moved by the balance of evidence and pulled back by uncertainty."""
    raw = F.lit(50.0) + F.lit(5.0) * (breakage - absent)
    pull = F.greatest(F.lit(0.35), F.lit(1.0) - F.lit(0.25) * uncertain)
    pulled = F.when(uncertain > 0, F.lit(50.0) + (raw - 50.0) * pull).otherwise(raw)
    return F.least(F.greatest(F.rint(pulled), F.lit(0.0)), F.lit(100.0)).cast("int")


def reason_of_score(score: Column, low: int = LOW_SCORE, high: int = HIGH_SCORE) -> Column:
    return F.when(score <= low, ABSENT).when(score >= high, BROKEN).otherwise(UNDETERMINED)


def presence_of_score(score: Column, low: int = LOW_SCORE, high: int = HIGH_SCORE) -> Column:
    return F.when(score <= low, "no").when(score >= high, "possibly_yes").otherwise("unknown")


def enum(c: Column | str, allowed: list[str], default: str) -> Column:
    value = F.lower(clean_text(c))
    return F.when(value.isin(*allowed), value).otherwise(default)


def key_evidence(c: Column | str, cap: int = MAX_KEY_EVIDENCE) -> Column:
    items = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: clean_text(x))
    return F.slice(F.filter(items, lambda x: x != ""), 1, cap)


def normalize_judgment(df, default_rationale: str = DEFAULT_RATIONALE):
    """Bring a table of model judgments to the fixed enumerations.

    Unknown words fall back to the defaults, evidence is stripped and capped, the score is clamped; a row
    without a score gets a derived one, and its reason and verdict then follow from that score.
    """
    out = df.withColumns(
        {
            "final_failure_reason": enum("final_failure_reason", REASONS, UNDETERMINED),
            "vulnerability_presence_verdict": enum("vulnerability_presence_verdict", PRESENCE, "unknown"),
            "judgment_confidence": enum("judgment_confidence", CONFIDENCE, "low"),
            "fix_evidence_strength": enum("fix_evidence_strength", STRENGTH, "none"),
            "exploit_breakage_evidence_strength": enum("exploit_breakage_evidence_strength", STRENGTH, "none"),
            "key_evidence": key_evidence("key_evidence"),
            "judgment_rationale": F.coalesce(
                F.nullif(clean_text("judgment_rationale"), F.lit("")), F.lit(default_rationale)
            ),
            "_raw": col("vulnerability_presence_score").cast("string"),
        }
    )
    evidence = join_lines(F.concat(F.col("key_evidence"), F.array("judgment_rationale")))
    derived = derived_presence_score(
        F.col("final_failure_reason"),
        F.col("vulnerability_presence_verdict"),
        F.col("judgment_confidence"),
        F.col("fix_evidence_strength"),
        F.col("exploit_breakage_evidence_strength"),
        evidence,
    )
    missing = F.col("_raw").isNull() | (F.col("_raw") == "")
    score = F.col("vulnerability_presence_score")
    return (
        out.withColumn("vulnerability_presence_score", clamp_score("_raw", derived))
        .withColumns(
            {
                "final_failure_reason": F.when(missing, reason_of_score(score)).otherwise(F.col("final_failure_reason")),
                "vulnerability_presence_verdict": F.when(missing, presence_of_score(score)).otherwise(
                    F.col("vulnerability_presence_verdict")
                ),
                "judgment_rationale_short": shorten("judgment_rationale"),
            }
        )
        .drop("_raw")
    )


def normalize_hunk_judgment(df, default_reasoning: str = DEFAULT_HUNK_REASONING):
    """The same for judgments about single pieces of evidence."""
    from flipline.functions.evidence import evidence_path

    return df.withColumns(
        {
            "hunk_path": evidence_path("hunk_path"),
            "judgment": enum("judgment", HUNK_JUDGMENTS, "neutral"),
            "confidence": enum("confidence", CONFIDENCE, "low"),
            "key_evidence": key_evidence("key_evidence"),
            "reasoning": F.coalesce(F.nullif(clean_text("reasoning"), F.lit("")), F.lit(default_reasoning)),
        }
    ).withColumn("reasoning_short", shorten("reasoning"))


def predict_label(low: int = LOW_SCORE, high: int = HIGH_SCORE, strict_compat: bool = False) -> Column:
    """Predicted state of a judged case; the first rule that applies decides.

    ``strict_compat`` ignores the ``seek_patch`` column, which older entry tables do not carry.
    """
    word = lambda name: F.lower(clean_text(name))
    scenario, status, subtype = word("scenario_type"), word("status"), word("failure_subtype")
    fix, breakage = word("fix_evidence_strength"), word("exploit_breakage_evidence_strength")
    reason, verdict = word("final_failure_reason"), word("vulnerability_presence_verdict")
    seek_false = F.lit(False) if strict_compat else is_false("seek_patch")
    effective = F.coalesce(F.col("trace_has_effective_difference"), F.lit(False))
    valid = F.coalesce(F.col("trace_evidence_valid"), effective)
    traced = (scenario == "trace_diff") & effective & valid
    score = rounded_score("vulnerability_presence_score")
    narrow = (
        (status == "trace_diff")
        & (subtype == "trace_difference")
        & (fix == "strong")
        & (F.coalesce((breakage == "none") & (score >= 10) & (score < 15), F.lit(False)) | (breakage == "weak"))
    )
    broken_run = scenario.isin("process_failure", "compile_failure", "execution_failure")
    return (
        F.when(
            (word("baseline_execution_observation") == "test_failure")
            & (word("target_execution_observation") == "success")
            & traced,
            NOT_AFFECTED,
        )
        .when(seek_false & ((status == "no_diff") | (subtype == "invalid_trace_difference")), AFFECTED)
        .when((reason == ABSENT) & traced & narrow, AFFECTED)
        .when((reason == ABSENT) & traced, UNKNOWN)
        .when(reason == ABSENT, NOT_AFFECTED)
        .when((reason == BROKEN) & broken_run, AFFECTED)
        .when((scenario == "execution_failure") & seek_false, AFFECTED)
        .when(score <= low, NOT_AFFECTED)
        .when(score >= high, AFFECTED)
        .when(verdict.isin("yes", "possibly_yes"), AFFECTED)
        .when(verdict == "no", NOT_AFFECTED)
        .otherwise(UNKNOWN)
    )
