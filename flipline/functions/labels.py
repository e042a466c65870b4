"""Label vocabularies: truth, verdict and outcome columns, and the four ways to align a verdict with the truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipline.functions.text import clean_text, col, raw_text

# Label words used by every table.
NO_DATA = "No_Data"
AFFECTED = "affected"
NOT_AFFECTED = "not affected"
UNKNOWN = "unknown"
APPEARS = "APPEARS"
BUILD_SUCCESS = "BUILD_SUCCESS"
BUILD_FAILURE_OTHER = "BUILD_FAILURE_OTHER"


def polarity(c: Column | str) -> Column:
    """POS when the text speaks of ``affected`` and does not begin with ``not``; NEG otherwise."""
    text = F.lower(raw_text(c))
    return F.when(text.contains(AFFECTED) & ~text.startswith("not"), "POS").otherwise("NEG")


def truth01(c: Column | str) -> Column:
    text = F.lower(clean_text(c))
    return F.when(text == AFFECTED, 1).when(text == NOT_AFFECTED, 0)


def verdict01(c: Column | str) -> Column:
    text = F.lower(clean_text(c))
    return F.when(text.isin("1", "true") | text.startswith(AFFECTED), 1).otherwise(0)


def outcome01(c: Column | str) -> Column:
    return F.when(F.upper(clean_text(c)) == APPEARS, 1).otherwise(0)


def truth_state(c: Column | str) -> Column:
    text = F.lower(clean_text(c))
    return F.when(text.isin(AFFECTED, NOT_AFFECTED), text).otherwise("")


def pred_state(c: Column | str) -> Column:
    text = F.lower(clean_text(c))
    return (
        F.when(text.contains(AFFECTED) & ~text.startswith("not "), AFFECTED)
        .when(text.startswith(NOT_AFFECTED), NOT_AFFECTED)
        .otherwise("")
    )


def prediction(c: Column | str) -> Column:
    """One of the three known prediction words; anything else is unknown."""
    text = F.lower(clean_text(c))
    return F.when(text.isin(AFFECTED, NOT_AFFECTED), text).otherwise(UNKNOWN)


def outcome_success(c: Column | str) -> Column:
    return F.upper(clean_text(c)) == APPEARS


def outcome_failure(c: Column | str) -> Column:
    return F.upper(clean_text(c)).isin(BUILD_SUCCESS, BUILD_FAILURE_OTHER)


def outcome_compiled(c: Column | str) -> Column:
    return F.upper(clean_text(c)).isin(BUILD_SUCCESS, APPEARS)


def outcome_bucket(c: Column | str) -> Column:
    return F.when(outcome_success(c), APPEARS).otherwise("OTHER")


def map_status(c: Column | str) -> Column:
    """Two-word outcome spelling -> outcome vocabulary; other values pass through untouched."""
    text = F.lower(clean_text(c))
    return F.when(text == "appears", APPEARS).when(text == "not appears", BUILD_FAILURE_OTHER).otherwise(col(c))


def buildable(c: Column | str) -> Column:
    return F.coalesce(F.upper(col(c)).rlike("BUILD_SUCCESS|BUILD_FAILURE_OTHER"), F.lit(False))


def is_false(c: Column | str) -> Column:
    """Strictly false, as a boolean or as the word; a missing value is not false."""
    return F.coalesce(F.lower(clean_text(c)) == "false", F.lit(False))


# --- alignment --------------------------------------------------------------------------------------------


def align_polarity(truth: Column | str, pred: Column | str) -> Column:
    t, p = polarity(truth), polarity(pred)
    return F.when(t == p, "T").when(p == "POS", "FP").otherwise("FN")


def align_three_state(truth: Column | str, pred: Column | str) -> Column:
    t, p = truth_state(truth), pred_state(pred)
    return (
        F.when((t == "") | (p == ""), NO_DATA)
        .when(t == p, "T")
        .when(t == AFFECTED, "FN")
        .otherwise("FP")
    )


def align_prediction(truth: Column | str, pred: Column | str) -> Column:
    """``pred`` holds a decided state; any truth other than the same word counts as an error."""
    t, p = F.lower(clean_text(truth)), pred_state(pred)
    return F.when(t == p, "T").when(p == AFFECTED, "FP").otherwise("FN")


def align_outcome(truth: Column | str, pred: Column | str) -> Column:
    t, p = truth_state(truth), prediction(pred)
    return (
        F.when(p == UNKNOWN, "ABSTAIN")
        .when((p == AFFECTED) & (t == AFFECTED), "TP")
        .when((p == AFFECTED) & (t == NOT_AFFECTED), "FP")
        .when((p == NOT_AFFECTED) & (t == AFFECTED), "FN")
        .otherwise("TN")
    )


ALIGN_STYLES = {
    "polarity": align_polarity,
    "three_state": align_three_state,
    "prediction": align_prediction,
    "outcome": align_outcome,
}
