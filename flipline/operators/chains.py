"""Verdicts along version chains: propagation, conflict zones, boundary inference, latest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.functions.labels import (
    AFFECTED,
    APPEARS,
    NO_DATA,
    align_three_state,
    outcome_success,
    pred_state,
)
from flipline.functions.text import clean_text, raw_text
from flipline.operators.scans import _BLK, BLOCK_ROWS, first_of, nearest, over, with_block

# The four labels that spread, with the codes used while scanning.
NEG_PATCH, NEG_INTRO = "not affected_patch", "not affected_intro"
POS_PATCH, POS_INTRO = "affected_patch", "affected_intro"
CODES = {NEG_PATCH: 1, NEG_INTRO: 2, POS_PATCH: 3, POS_INTRO: 4}
OTHER_CODE = 5
REFINE_THRESHOLD = 0.95
REFINE_DEFAULT = 0.5


def _code(label: Column) -> Column:
    out = F.when(label == NO_DATA, 0)
    for name, code in CODES.items():
        out = out.when(label == name, code)
    return out.otherwise(OTHER_CODE)


def _key(*cols: Column) -> Column:
    return F.concat_ws("\x1f", *cols)


def _known_labels(df: DataFrame, part: list[str], pos: str, code: str, fwd: str, bwd: str, rows: int) -> DataFrame:
    """Add ``__before`` and ``__after``: code of the nearest row that is not No_Data, null past a run's end.

    ``fwd`` and ``bwd`` hold the run keys: a change of ``fwd`` stops a look-behind, of ``bwd`` a look-ahead.
    """

    def scan(d: DataFrame) -> DataFrame:
        p = [*part, _BLK]
        d = d.withColumns({"__pk": over("lag", fwd, p, pos), "__nk": over("lead", bwd, p, pos)})
        known = F.col(code) != 0
        d = d.withColumns(
            {
                "__fe": F.when(known | (F.col("__pk") != F.col(fwd)), F.col(code)),
                "__be": F.when(known | (F.col("__nk") != F.col(bwd)), F.col(code)),
            }
        )
        return d.withColumns(
            {
                "__before": F.coalesce(F.col("__fe"), over("lag", "__fe", p, pos)),
                "__after": F.coalesce(F.col("__be"), over("lead", "__be", p, pos)),
            }
        )

    wide = with_block(df, pos, rows)
    narrow = scan(wide.select(*part, _BLK, pos, code, fwd, bwd))
    tail = F.max(F.when(F.col("__fe").isNotNull(), F.col(pos) * 8 + F.col("__fe")))
    head = F.min(F.when(F.col("__be").isNotNull(), F.col(pos) * 8 + F.col("__be")))
    edge = narrow.groupBy(*part, _BLK).agg(
        F.pmod(tail, F.lit(8)).cast("int").alias("__tail"),
        F.pmod(head, F.lit(8)).cast("int").alias("__head"),
        F.min_by(fwd, pos).alias("__ff"),
        F.max_by(fwd, pos).alias("__lf"),
        F.min_by(bwd, pos).alias("__fb"),
        F.max_by(bwd, pos).alias("__lb"),
    )
    edge = edge.withColumns({"__pl": over("lag", "__lf", part, _BLK), "__nf": over("lead", "__fb", part, _BLK)})
    new_run = F.coalesce(F.col("__pl") != F.col("__ff"), F.lit(False))
    end_run = F.coalesce(F.col("__nf") != F.col("__lb"), F.lit(False))
    edge = edge.withColumns(
        {
            "__new": new_run,
            "__end": end_run,
            "__te": F.coalesce(F.col("__tail"), F.when(new_run, 0)),
            "__he": F.coalesce(F.col("__head"), F.when(end_run, 0)),
        }
    )
    edge = edge.withColumns({"__tb": over("lag", "__te", part, _BLK), "__ha": over("lead", "__he", part, _BLK)})
    carry = edge.select(
        *part,
        _BLK,
        F.when(~F.col("__new"), F.col("__tb")).alias("__cb"),
        F.when(~F.col("__end"), F.col("__ha")).alias("__ca"),
    )
    return (
        scan(wide)
        .join(carry, [*part, _BLK], "left")
        .withColumns(
            {
                "__before": F.coalesce(F.col("__before"), F.col("__cb")),
                "__after": F.coalesce(F.col("__after"), F.col("__ca")),
            }
        )
        .drop(_BLK, "__pk", "__nk", "__fe", "__be", "__cb", "__ca")
    )


def _chain(df: DataFrame, cve: str, contiguous: bool) -> tuple[DataFrame, list[str]]:
    """Partition column of a chain scan: nothing, so that rows are compared with their neighbours in the table, or the
    issue where all its rows follow each other. Either way blocks of positions spread the rows over tasks; only the
    small carry rows, one per block, are ordered together."""
    return df.withColumn("__part", raw_text(cve) if contiguous else F.lit("")), ["__part"]


def propagate_default(
    df: DataFrame,
    pos: str = "row_pos",
    cve: str = "CVE_ID",
    library: str = "Library",
    outcome: str = "Execution Result",
    verdict: str = "LLM_Verdict",
    contiguous: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill undecided rows: reproduced rows are affected, patch negatives spread down an issue's run of rows,
    introduction negatives spread up a run of the same issue and library.

    Runs are of adjacent rows. ``contiguous`` promises that the table is sorted by issue, so that no other issue's row
    interrupts a run; the result is then the same and the carry rows are ordered per issue. On a table where issues
    interleave it would join runs that are not adjacent.
    """
    d, part = _chain(df, cve, contiguous)
    label = F.when(
        (raw_text(verdict) == NO_DATA) & (F.upper(raw_text(outcome)) == APPEARS), F.lit(AFFECTED)
    ).otherwise(F.col(verdict))
    d = d.withColumn(verdict, label).withColumns(
        {"__fwd": raw_text(cve), "__bwd": _key(raw_text(cve), raw_text(library)), "__code": _code(raw_text(verdict))}
    )
    d = _known_labels(d, part, pos, "__code", "__fwd", "__bwd", block_rows)
    return d.withColumn(
        verdict,
        F.when((F.col("__code") == 0) & (F.col("__before") == CODES[NEG_PATCH]), NEG_PATCH)
        .when((F.col("__code") == 0) & (F.col("__after") == CODES[NEG_INTRO]), NEG_INTRO)
        .otherwise(F.col(verdict)),
    ).drop("__part", "__fwd", "__bwd", "__code", "__before", "__after")


def propagate_full(
    df: DataFrame,
    pos: str = "row_pos",
    cve: str = "CVE_ID",
    library: str = "Library",
    poc: str = "PoC",
    outcome: str = "Execution Result",
    verdict: str = "LLM_Verdict",
    contiguous: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill undecided rows inside runs of one (issue, library, outcome bucket, exploit).

    Six ordered spreads of the sequential definition come down to the nearest known label on both sides: rows
    between two known labels share both, so the first spread that applies fills all of them. Runs are of adjacent
    rows; ``contiguous`` is as in :func:`propagate_default`.
    """
    d, part = _chain(df, cve, contiguous)
    bucket = F.when(F.upper(raw_text(outcome)) == APPEARS, APPEARS).otherwise("OTHER")
    label = F.when((raw_text(verdict) == NO_DATA) & (bucket == APPEARS), F.lit(AFFECTED)).otherwise(F.col(verdict))
    d = d.withColumn(verdict, label).withColumns(
        {
            "__run": _key(raw_text(cve), raw_text(library), bucket, raw_text(poc)),
            "__code": _code(raw_text(verdict)),
        }
    )
    d = _known_labels(d, part, pos, "__code", "__run", "__run", block_rows)
    b, a = F.col("__before"), F.col("__after")
    filled = (
        F.when(b == CODES[NEG_PATCH], NEG_PATCH)
        .when(a == CODES[NEG_INTRO], NEG_INTRO)
        .when(b == CODES[POS_PATCH], POS_PATCH)
        .when(a == CODES[POS_PATCH], POS_PATCH)
        .when(a == CODES[POS_INTRO], POS_INTRO)
        .when(b == CODES[POS_INTRO], POS_INTRO)
        .otherwise(F.col(verdict))
    )
    return d.withColumn(verdict, F.when(F.col("__code") == 0, filled).otherwise(F.col(verdict))).drop(
        "__part", "__run", "__code", "__before", "__after"
    )


def conflict_zone(
    df: DataFrame,
    pos: str = "row_pos",
    cve: str = "CVE_ID",
    library: str = "Library",
    poc: str = "PoC",
    outcome: str = "Execution Result",
    verdict: str = "LLM_Verdict",
    score: str | None = None,
    contiguous: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mark rows next to a row of the same (issue, library, exploit) in the other outcome bucket when one of
    the two carries a positive label, and say what a refinement score would have done to them. Rows are compared with
    the rows just before and after them; ``contiguous`` is as in :func:`propagate_default`."""
    d, part = _chain(df, cve, contiguous)
    d = d.withColumn(
        "__me",
        F.struct(
            _key(raw_text(cve), raw_text(library), raw_text(poc)).alias("k"),
            F.when(F.upper(raw_text(outcome)) == APPEARS, APPEARS).otherwise("OTHER").alias("b"),
            raw_text(verdict).isin(POS_INTRO, POS_PATCH).alias("p"),
        ),
    )
    d = nearest(d, part, pos, {"__prev": F.col("__me")}, {"__next": F.col("__me")}, block_rows)

    def clash(n: str) -> Column:
        me, other = F.col("__me"), F.col(n)
        return F.coalesce(
            (me["k"] == other["k"]) & (me["b"] != other["b"]) & (me["p"] | other["p"]), F.lit(False)
        )

    value = F.coalesce(F.col(score), F.lit(REFINE_DEFAULT)) if score else F.lit(REFINE_DEFAULT)
    zone = F.col("in_conflict_zone")
    return (
        d.withColumn("in_conflict_zone", clash("__prev") | clash("__next"))
        .withColumns(
            {
                "refinement_score": F.when(zone, value).otherwise(0.0),
                "refinement_decision": F.when(~zone, "skipped_no_conflict")
                .when(value >= REFINE_THRESHOLD, "would_change_but_disabled")
                .otherwise("abstain_low_confidence"),
            }
        )
        .drop("__part", "__me", "__prev", "__next")
    )


def infer_boundaries(
    df: DataFrame,
    pos: str = "row_pos",
    cve: str = "CVE_ID",
    outcome: str = "Execution Result",
    verdict: str = "LLM_Verdict",
    truth: str = "True Affected Version",
    aligned: str = "Aligned_llm",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Label undecided rows at outcome boundaries of an issue: the row before a reproduced stretch gets the
    introduction negative, the row behind one the patch negative; the introduction wins. Rows without an issue
    id are passed through. Adds ``boundary_mode`` and ``boundary_hits`` for the counters."""
    hit = outcome_success(outcome)
    keyed = df.where(F.col(cve).isNotNull()).withColumn("__hit", hit)
    d = nearest(
        keyed,
        cve,
        pos,
        {"__prev": F.struct(F.col("__hit").alias("hit"))},
        {"__next": F.struct(F.col("__hit").alias("hit"))},
        block_rows,
    )
    open_row = ~F.col("__hit") & (clean_text(verdict) == NO_DATA)
    intro = open_row & F.coalesce(F.col("__next.hit"), F.lit(False))
    patch = open_row & F.coalesce(F.col("__prev.hit"), F.lit(False))
    d = d.withColumns(
        {
            "boundary_mode": F.when(intro, "introduction").when(patch, "patch"),
            "boundary_hits": intro.cast("int") + patch.cast("int"),
        }
    ).drop("__hit", "__prev", "__next")
    rest = df.where(F.col(cve).isNull()).withColumns(
        {"boundary_mode": F.lit(None).cast("string"), "boundary_hits": F.lit(0)}
    )
    d = d.unionByName(rest)
    label = F.when(F.col("boundary_mode") == "introduction", NEG_INTRO).otherwise(NEG_PATCH)
    set_row = F.col("boundary_mode").isNotNull()
    old = F.col(aligned) if aligned in df.columns else F.lit(NO_DATA)
    return d.withColumn(verdict, F.when(set_row, label).otherwise(F.col(verdict))).withColumn(
        aligned, F.when(set_row, align_three_state(truth, verdict)).otherwise(old)
    )


def boundary_summary(df: DataFrame, verdict: str = "LLM_Verdict", aligned: str = "Aligned_llm") -> DataFrame:
    """One row of counters over the output of :func:`infer_boundaries`."""
    row, mode, hits = F.col("boundary_mode").isNotNull(), F.col("boundary_mode"), F.col("boundary_hits")
    state = pred_state(verdict)
    n = lambda cond: F.count_if(row & cond)
    return df.agg(
        F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias("total_boundary_hits"),
        F.count_if(row).alias("written_rows"),
        n(mode == "introduction").alias("written_introduction"),
        n(mode == "patch").alias("written_patch"),
        F.count_if(hits > 1).alias("multi_mode_rows"),
        n((F.col(aligned) == "T") & (state == AFFECTED)).alias("tp"),
        n((F.col(aligned) == "T") & (state != AFFECTED)).alias("tn"),
        n(F.col(aligned) == "FP").alias("fp"),
        n(F.col(aligned) == "FN").alias("fn"),
    )


def latest_run(df: DataFrame, pos: str, index: str = "progress_index") -> DataFrame:
    """Rows of the last run of a status log; a run starts where the progress index is one."""
    start = df.where(F.col(index) == 1).agg(F.max(pos))
    return df.where(F.col(pos) >= start.scalar())


def latest_run_state(df: DataFrame, pos: str, index: str = "progress_index", total: str = "progress_total") -> DataFrame:
    """Completed cases of the last run and the size it announced."""
    run = latest_run(df, pos, index)
    done = F.count_distinct(F.nullif(clean_text("case_id"), F.lit("")))
    return run.agg(done.alias("completed_count"), F.coalesce(F.max(F.col(total)), F.lit(0)).alias("__t")).select(
        "completed_count",
        F.when(F.col("__t") > 0, F.col("__t").cast("bigint")).otherwise(F.col("completed_count")).alias("progress_total"),
    )


def dedupe_first(df: DataFrame, keys, pos: str) -> DataFrame:
    """First row of every key by position."""
    return first_of(df, keys, pos)
