"""Analysis payloads rolled up to verdicts per (issue, version), and verdicts laid over the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.functions.labels import (
    AFFECTED,
    NO_DATA,
    NOT_AFFECTED,
    UNKNOWN,
    align_prediction,
    align_three_state,
    buildable,
    prediction,
)
from flipline.functions.text import clean_text, col
from flipline.operators.evaluate import with_metrics
from flipline.operators.scans import last_of

# Thresholds of the roll-ups and the sweep grid.
PATCH_THRESHOLD = 0.3
MARGIN_THRESHOLD = -0.05
SWEEP_GRID = [round(-0.40 + 0.05 * i, 2) for i in range(17)]
# A margin key anywhere in a JSON text; a quote inside a string is escaped and does not match.
MARGIN = r'(?<!\\)"margin"\s*:\s*("[^"]*"|-?[A-Za-z0-9.+-]+)'


def join_pair_truth(
    analysis: DataFrame, pairs: DataFrame, with_head: bool, pos: str = "pair_index", target: str = "not appears"
) -> DataFrame:
    """Attach the target version of a catalog pair to analysis entries by issue and tags; the last pair wins."""
    norm = {"__c": F.upper(clean_text("cve")), "__b": F.lower(clean_text("base_tag"))}
    pair_norm = {"__c": F.upper(clean_text("cve")), "__b": F.lower(clean_text("BASE_TAG"))}
    if with_head:
        norm["__h"] = F.lower(clean_text("head_tag"))
        pair_norm["__h"] = F.lower(clean_text("HEAD_TAG"))
    keys = list(norm)
    rows = pairs.select(*[c.alias(n) for n, c in pair_norm.items()], clean_text(target).alias("version"), F.col(pos).alias("__p"))
    best = last_of(rows, keys, "__p", ["version"])
    return (
        analysis.withColumns(norm).join(best, keys, "inner").withColumn("cve", F.col("__c")).drop(*keys)
    )


def best_score(analysis: Column) -> Column:
    """Highest score of a MAP<commit, MAP<file, STRUCT<score, msg_score>>>; NaN scores never count."""
    files = F.flatten(F.transform(F.map_values(analysis), lambda m: F.map_values(m)))
    score = F.transform(files, lambda f: F.coalesce(f["score"], f["msg_score"], F.lit(0.0)))
    return F.array_max(F.filter(score, lambda s: ~F.isnan(s)))


def max_margin(json_text: Column | str) -> Column:
    """Highest ``margin`` at any depth of a JSON text; values that are no number are skipped."""
    raw = F.regexp_extract_all(F.coalesce(col(json_text), F.lit("")), F.lit(MARGIN), F.lit(1))
    number = F.transform(
        raw,
        lambda x: F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(F.btrim(x, F.lit('"')).try_cast("double")),
    )
    return F.array_max(F.filter(number, lambda x: x.isNotNull() & ~F.isnan(x)))


def patch_rollup(df: DataFrame, score: str = "score", threshold: float = PATCH_THRESHOLD, keys=("cve", "version")) -> DataFrame:
    """A version passes when any entry of it reaches the threshold."""
    s = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    usable = F.when(F.isnan(s), float("-inf")).otherwise(s)
    return df.groupBy(*keys).agg((F.max(usable) >= threshold).alias("is_passed"))


def margin_rollup(df: DataFrame, margin: str = "margin", keys=("cve", "version"), entry: str = "entry_pos") -> DataFrame:
    """Weakest entry of a version: the smallest over entries of the entry's largest margin.

    An entry is introduced at ``t`` when any margin reaches ``t``; a version is affected when some entry is not.
    That is ``weakest < t`` for every threshold, so one pass serves them all.
    """
    m = F.col(margin).cast("double")
    best = df.groupBy(*keys, entry).agg(F.max(F.when(~F.isnan(m), m)).alias("__m"))
    return best.groupBy(*keys).agg(F.min(F.coalesce(F.col("__m"), F.lit(float("-inf")))).alias("weakest_margin"))


def margin_verdict(rollup: DataFrame, threshold: float = MARGIN_THRESHOLD) -> DataFrame:
    return rollup.withColumn("is_affected", F.col("weakest_margin") < threshold)


def threshold_sweep(rows: DataFrame, weakest: str = "weakest_margin", truth: str = "truth", grid: list[float] | None = None) -> DataFrame:
    """Confusion and accuracy per threshold.

    Rows are first counted by how many thresholds they reach, which leaves at most ``2 * (len(grid) + 1)`` rows
    to be spread over the grid.
    """
    grid = grid or SWEEP_GRID
    points = F.array(*[F.lit(t) for t in grid])
    reached = F.size(F.filter(points, lambda t: t <= F.col(weakest)))
    positive = F.lower(clean_text(truth)) == AFFECTED
    small = rows.where(F.col(weakest).isNotNull()).groupBy(reached.alias("reached"), positive.alias("pos")).count()
    per = small.select("reached", "pos", "count", F.posexplode(points).alias("i", "threshold"))
    pred = F.col("i") >= F.col("reached")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("bigint")
    sums = per.groupBy("threshold").agg(
        F.sum("count").cast("bigint").alias("total"),
        n(F.col("pos") & pred).alias("tp"),
        n(~F.col("pos") & pred).alias("fp"),
        n(F.col("pos") & ~pred).alias("fn"),
        n(~F.col("pos") & ~pred).alias("tn"),
    )
    return with_metrics(sums).select("threshold", "total", "tp", "fp", "fn", "tn", "accuracy")


def commit_rollup(df: DataFrame, commits: str = "intro_commits", keys=("cve", "version")) -> DataFrame:
    """A version is affected when any entry names no introducing commit."""
    return df.groupBy(*keys).agg(F.bool_or(F.coalesce(F.size(commits), F.lit(0)) <= 0).alias("is_affected"))


def resolve_conflicts(
    df: DataFrame, cve: str = "cve_id", version: str = "target_version", label: str = "predicted_label"
) -> DataFrame:
    """One label per (issue, version): affected before not affected before unknown; marks contradictions."""
    p = prediction(label)
    rows = df.select(F.upper(clean_text(cve)).alias("cve"), clean_text(version).alias("version"), p.alias("p"))
    return (
        rows.where((F.col("cve") != "") & (F.col("version") != ""))
        .groupBy("cve", "version")
        .agg(
            F.count_if(F.col("p") == AFFECTED).alias("affected_count"),
            F.count_if(F.col("p") == NOT_AFFECTED).alias("not_affected_count"),
            F.count_if(F.col("p") == UNKNOWN).alias("unknown_count"),
        )
        .withColumns(
            {
                "resolved": F.when(F.col("affected_count") > 0, AFFECTED)
                .when(F.col("not_affected_count") > 0, NOT_AFFECTED)
                .otherwise(UNKNOWN),
                "is_conflict": (F.col("affected_count") > 0) & (F.col("not_affected_count") > 0),
            }
        )
    )


def conflict_cases(df: DataFrame, resolved: DataFrame, cve: str = "cve_id", version: str = "target_version", label: str = "predicted_label") -> DataFrame:
    """The cases behind contradictory labels, one row each."""
    keyed = df.withColumns({"cve": F.upper(clean_text(cve)), "version": clean_text(version), "label": prediction(label)})
    bad = resolved.where("is_conflict").select("cve", "version")
    return keyed.join(bad, ["cve", "version"], "left_semi")


def reset_verdicts(df: DataFrame, verdict: str = "LLM_Verdict") -> DataFrame:
    return df.withColumn(verdict, F.lit(NO_DATA))


def overlay(
    results: DataFrame,
    verdicts: DataFrame,
    label: str,
    cve: str = "CVE_ID",
    version: str = "Version",
    verdict: str = "LLM_Verdict",
    aligned: str = "Aligned_llm",
    truth: str = "True Affected Version",
    style: str = "prediction",
    only: Column | None = None,
    otherwise: str | None = None,
) -> DataFrame:
    """Replace the verdict of rows that have one in ``verdicts`` (columns cve, version, ``label``).

    A null label decides nothing. ``only`` limits the rows that may change, ``otherwise`` resets the others.
    """
    align = {"prediction": align_prediction, "three_state": align_three_state}[style]
    v = verdicts.select(F.col("cve").alias("__c"), F.col("version").alias("__v"), F.col(label).alias("__new"))
    keyed = results.withColumns({"__c": F.upper(clean_text(cve)), "__v": clean_text(version)})
    d = keyed.join(v, ["__c", "__v"], "left")
    hit = F.col("__new").isNotNull() & (F.lit(True) if only is None else only)
    old = lambda c: F.lit(otherwise) if otherwise else (F.col(c) if c in results.columns else F.lit(NO_DATA))
    return d.withColumns(
        {
            verdict: F.when(hit, F.col("__new")).otherwise(old(verdict)),
            aligned: F.when(hit, align(truth, "__new")).otherwise(old(aligned)),
        }
    ).drop("__c", "__v", "__new")


def overlay_patch(results: DataFrame, rollup: DataFrame, outcome: str = "Execution Result", **names) -> DataFrame:
    """Lay patch verdicts over rows that could be built."""
    v = rollup.withColumn("label", F.when(F.col("is_passed"), "not affected_patch").otherwise("affected_patch"))
    return overlay(results, v, "label", only=buildable(outcome), **names)


def overlay_intro(results: DataFrame, rollup: DataFrame, suffix: str = "_intro", **names) -> DataFrame:
    """Lay introduction verdicts over the table; rows without one are reset."""
    word = F.when(F.col("is_affected"), AFFECTED).otherwise(NOT_AFFECTED)
    return overlay(results, rollup.withColumn("label", F.concat(word, F.lit(suffix))), "label", otherwise=NO_DATA, **names)


def overlay_resolved(results: DataFrame, resolved: DataFrame, **names) -> DataFrame:
    """Lay resolved evaluation labels over the table; unknown ones leave a row as it is."""
    v = resolved.withColumn(
        "label", F.when(F.col("resolved") != UNKNOWN, F.concat(F.col("resolved"), F.lit("_intro")))
    )
    return overlay(results, v, "label", style="three_state", **names)
