"""Verdicts against ground truth: truth joins, confusion metrics, error rankings, category reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.functions.labels import AFFECTED, NOT_AFFECTED, UNKNOWN, align_outcome, truth_state
from flipline.functions.text import clean_text
from flipline.operators.scans import last_of

# Name given to a blank library, and the name of the rest group.
EMPTY_LIBRARY = "(EMPTY_LIBRARY)"
OTHERS = "others"
RANKINGS = {
    "fn": ("fn_count", "fp_count", "error_count"),
    "fp": ("fp_count", "fn_count", "error_count"),
    "error": ("error_count", "fn_count", "fp_count"),
}


def ratio(num: Column, den: Column, undefined: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(undefined))


def error_summary(
    df: DataFrame, key: str = "Library", aligned: str = "Aligned_llm", blank: str | None = EMPTY_LIBRARY, name: str | None = None
) -> DataFrame:
    """Rows, false negatives and false positives per key. ``blank`` names the group of blank keys."""
    text = clean_text(key)
    group = F.coalesce(F.nullif(text, F.lit("")), F.lit(blank)) if blank else text
    mark = clean_text(aligned)
    counts = df.groupBy(group.alias(name or key)).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(mark == "FN").alias("fn_count"),
        F.count_if(mark == "FP").alias("fp_count"),
        F.count_if(mark.isin("FN", "FP")).alias("error_count"),
    )
    return counts.withColumns(
        {f"{x}_ratio": F.col(f"{x}_count") / F.col("total_rows") for x in ("fn", "fp", "error")}
    )


def ranking(summary: DataFrame, by: str, key: str = "Library", top: int | None = None) -> DataFrame:
    """Keys by error counts, name last; the three orders are total."""
    order = [F.col(c).desc() for c in RANKINGS[by]] + [F.col(key).asc()]
    out = summary.orderBy(*order)
    return out.limit(top) if top is not None else out


def with_confusion(df: DataFrame, truth: Column, pred: Column, by=(), prefix: str = "") -> DataFrame:
    """Counts of the four outcomes of 0/1 columns; rows where either is null count in none of them."""
    hit = lambda t, p: F.count_if((truth == t) & (pred == p))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(f"{prefix}total"),
        hit(1, 1).alias(f"{prefix}tp"),
        hit(0, 1).alias(f"{prefix}fp"),
        hit(1, 0).alias(f"{prefix}fn"),
        hit(0, 0).alias(f"{prefix}tn"),
    )


def with_metrics(df: DataFrame, denominator: str = "all", undefined: float = 0.0) -> DataFrame:
    """Accuracy, precision, recall and F1 from outcome counts.

    ``denominator`` of the accuracy is every row (``all``) or only rows with an outcome (``decided``);
    ``undefined`` is what a ratio without cases yields.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = F.col("total") if denominator == "all" else tp + fp + fn + tn
    out = df.withColumns(
        {
            "accuracy": ratio(tp + tn, total),
            "precision": ratio(tp, tp + fp, undefined),
            "recall": ratio(tp, tp + fn, undefined),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    # NaN compares greater than zero in Spark, so an undefined part is tested for before the sum is.
    usable = ~F.isnan(p) & ~F.isnan(r) & (p + r > 0)
    return out.withColumn("f1", F.when(usable, 2 * p * r / (p + r)).otherwise(F.lit(undefined)))


def confusion(
    df: DataFrame, truth: Column, pred: Column, by=(), denominator: str = "all", undefined: float = 0.0
) -> DataFrame:
    return with_metrics(with_confusion(df, truth, pred, by), denominator, undefined)


def join_truth(
    pred: DataFrame,
    truth: DataFrame,
    pos: str = "row_pos",
    cve: str = "CVE_ID",
    version: str = "Version",
    label: str = "True Affected Version",
    extra: dict[str, str] | None = None,
    pred_cve: str = "cve_id",
    pred_version: str = "target_version",
) -> DataFrame:
    """Attach the truth row of (issue, version) to predictions; of several truth rows the last one counts.

    Predictions without a truth row keep a null ``actual_label``.
    """
    extra = extra or {}
    rows = truth.select(
        F.upper(clean_text(cve)).alias("__c"),
        clean_text(version).alias("__v"),
        F.nullif(truth_state(label), F.lit("")).alias("actual_label"),
        *[clean_text(c).alias(n) for n, c in extra.items()],
        F.col(pos).alias("__p"),
    ).where((F.col("__c") != "") & (F.col("__v") != "") & F.col("actual_label").isNotNull())
    best = last_of(rows, ["__c", "__v"], "__p", ["actual_label", *extra])
    keyed = pred.withColumns({"__c": F.upper(clean_text(pred_cve)), "__v": clean_text(pred_version)})
    return keyed.join(best, ["__c", "__v"], "left").drop("__c", "__v")


def missing_truth(joined: DataFrame, columns=("case_id", "cve_id", "target_version")) -> DataFrame:
    return joined.where(F.col("actual_label").isNull()).select(*columns)


def evaluation_details(joined: DataFrame, pred: str = "predicted_label") -> DataFrame:
    """Outcome of every prediction that has a truth row."""
    d = joined.where(F.col("actual_label").isNotNull())
    return d.withColumns(
        {
            "outcome": align_outcome("actual_label", pred),
            "prediction_correct": (F.col(pred) != UNKNOWN) & (F.col(pred) == F.col("actual_label")),
        }
    )


def two_sided_metrics(details: DataFrame, pred: str = "predicted_label", actual: str = "actual_label") -> DataFrame:
    """Metrics over decided predictions with each label as the positive one, plus coverage: two rows."""
    p, a = F.col(pred), F.col(actual)
    decided = p != UNKNOWN
    sums = details.agg(
        F.count(F.lit(1)).alias("total_with_truth"),
        F.count_if(decided).alias("evaluated_predictions"),
        *[
            F.count_if((p == x) & (a == y)).alias(f"n{i}{j}")
            for i, x in enumerate((AFFECTED, NOT_AFFECTED))
            for j, y in enumerate((AFFECTED, NOT_AFFECTED))
        ],
    )
    side = lambda name, tp, fp, fn, tn: F.struct(
        F.lit(name).alias("positive_label"), *[F.col(c).alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn))]
    )
    rows = sums.withColumn(
        "side",
        F.explode(F.array(side(AFFECTED, "n00", "n01", "n10", "n11"), side(NOT_AFFECTED, "n11", "n10", "n01", "n00"))),
    ).select("total_with_truth", "evaluated_predictions", "side.*")
    rows = rows.withColumn("total", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    n, m = F.col("evaluated_predictions"), F.col("total_with_truth")
    return with_metrics(rows, "all").withColumns({"abstained_predictions": m - n, "coverage": ratio(n, m)})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of several label columns as (field, value, n).

    Label combinations are counted first, so only their number and not the rows is spread over the fields.
    """
    combos = df.groupBy(*[F.col(c).cast("string").alias(c) for c in columns]).count()
    long = combos.unpivot(["count"], columns, "field", "value")
    return long.groupBy("field", "value").agg(F.sum("count").alias("n"))


def files_by_kind(df: DataFrame, kind: str, name: str) -> DataFrame:
    """File names listed under their kind, one row each (a kind may hold any number of files)."""
    return df.select(F.col(kind).alias("kind"), F.col(name).alias("file_name")).distinct()


def top_categories(stats: DataFrame, n: int = 10, category: str = "CWE_ID", share: str = "Percentage") -> DataFrame:
    """Categories with the largest share; equal shares go by name."""
    value = F.rtrim(clean_text(share), F.lit("%")).try_cast("double")
    return (
        stats.select(F.col(category), value.alias("pct_val"))
        .orderBy(F.col("pct_val").desc_nulls_last(), F.col(category))
        .limit(n)
    )


def explode_categories(
    rows: DataFrame, catalog: DataFrame, top: DataFrame, cve: str = "cve", category: str = "CWE_ID", cats: str = "cwe"
) -> DataFrame:
    """Place every row in each top category of its issue, or in ``others`` when it has none."""
    pairs = catalog.select(
        F.col(cve), F.explode(F.array_distinct(F.filter(F.col(cats), lambda x: x.isNotNull() & (x != "")))).alias(category)
    ).distinct()
    wanted = pairs.join(top.select(category), category, "left_semi")
    return rows.join(wanted, cve, "left").withColumn(category, F.coalesce(F.col(category), F.lit(OTHERS)))


def category_metrics(
    df: DataFrame, catalog: DataFrame, top: DataFrame, truth: Column, methods: dict[str, Column], cve: str = "cve", category: str = "CWE_ID"
) -> DataFrame:
    """Precision, recall and F1 per (category, method), rounded to four digits; NaN where undefined.

    Outcomes are counted per issue first, so the category join sees one row per issue and not per result.
    """
    valid = df.withColumn("__t", truth).where(F.col("__t").isNotNull())
    cells = []
    for i, pred in enumerate(methods.values()):
        for name, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)):
            cells.append(F.count_if((F.col("__t") == t) & (pred == p)).alias(f"{name}{i}"))
    per_issue = valid.groupBy(cve).agg(F.count(F.lit(1)).alias("rows"), *cells)
    placed = explode_categories(per_issue, catalog, top, cve, category)
    names = [c for c in per_issue.columns if c != cve]
    sums = placed.groupBy(category).agg(*[F.sum(c).alias(c) for c in names])
    # Every top category is reported, also one without rows.
    listed = top.select(category).unionByName(sums.limit(0).select(category))
    others = sums.where(F.col(category) == OTHERS)
    full = listed.join(sums, category, "left").unionByName(others.select(category, *names)).na.fill(0, names)
    sides = F.array(
        *[
            F.struct(F.lit(m).alias("method"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")])
            for i, m in enumerate(methods)
        ]
    )
    long = full.select(category, F.col("rows").alias("total"), F.explode(sides).alias("s")).select(category, "total", "s.*")
    out = with_metrics(long, "all", float("nan"))
    return out.select(
        category,
        "method",
        F.col("total").alias("count"),
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")],
    )


def category_report(metrics: DataFrame, categories: list[str], category: str = "CWE_ID") -> DataFrame:
    """Metrics as rows, the named categories as columns."""
    long = metrics.unpivot(
        [category, "method"], ["precision", "recall", "f1"], "metric", "value"
    ).withColumn("Metric", F.concat_ws("_", "method", "metric"))
    return long.groupBy("Metric").pivot(category, categories).agg(F.first("value"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
