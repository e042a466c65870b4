"""Live views over the status and usage logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flipline.functions.text import clean_text
from flipline.sources.readers import STATUS_LOG, USAGE_LOG


def usage_tokens(df: DataFrame) -> DataFrame:
    """Prompt, completion and total tokens under any of their names; zero counts as missing."""
    cols = set(df.columns)

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n).cast("bigint"), F.lit(0)) for n in names if n in cols], F.lit(None).cast("bigint"))

    p = first("prompt_tokens", "input_tokens", "prompt_tokens_total")
    c = first("completion_tokens", "output_tokens", "completion_tokens_total")
    total = F.col("total_tokens").cast("bigint") if "total_tokens" in cols else F.lit(None).cast("bigint")
    other = [n for n in ("input_tokens", "prompt_tokens_total", "output_tokens", "completion_tokens_total") if n in cols]
    return df.withColumns({"__p": p, "__c": c}).withColumns(
        {"total_tokens": F.coalesce(total, F.col("__p") + F.col("__c")), "prompt_tokens": F.col("__p"), "completion_tokens": F.col("__c")}
    ).drop("__p", "__c", *other)


def status_stream(spark: SparkSession, path: str, run: Column | None = None) -> DataFrame:
    """Status lines of log files. A file is a run and its name the run's, unless ``run`` says otherwise."""
    raw = spark.readStream.schema(STATUS_LOG).json(path)
    return raw.withColumn("run", F.col("_metadata.file_name") if run is None else run)


def stream_status(df: DataFrame, run: str = "run", event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Completed and timed-out cases per run so far; a case counts once.

    With an event time, duplicates are forgotten after ``delay``, which bounds the state. Without one every case is kept
    for as long as the stream runs; :func:`finished_runs` needs no event time and keeps only runs under way.
    """
    d = df.where(clean_text("case_id") != "")
    if event_time:
        d = d.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([run, "case_id"])
    else:
        d = d.dropDuplicates([run, "case_id"])
    return d.groupBy(run).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.coalesce("timed_out", F.lit(False))).alias("timed_out"),
        F.max("progress_total").alias("progress_total"),
    )


def finished_runs(df: DataFrame, run: str = "run", idle_ms: int = 3_600_000) -> DataFrame:
    """One row per run once it has ended: (run, completed, timed_out, progress_total, finished), in append mode.

    A run has ended when as many different cases as its ``progress_total`` are there, or, unfinished, when no line of it
    came for ``idle_ms``. A case counts once, with its first line. State is kept for runs under way only: their case ids, no
    more than ``progress_total``; of a finished run a mark stays as long, so that repeated lines do not open it again.
    A run that goes on after a longer pause is told again with what came since.
    """
    kind = dict(df.dtypes)[run]
    out = f"run {kind}, completed long, timed_out long, progress_total int, finished boolean"

    def follow(key: tuple, lines: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cases, slow, total, done = state.get if state.exists else ([], 0, 0, False)
        told = False
        if state.hasTimedOut:
            state.remove()
            told = not done
        else:
            seen = set(cases)
            for batch in lines if not done else ():
                total = int(max(total, batch["progress_total"].max())) if batch["progress_total"].notna().any() else total
                fresh = batch[~batch["case_id"].isin(seen)].drop_duplicates("case_id")
                slow += int(fresh["timed_out"].fillna(False).astype(bool).sum())
                seen.update(fresh["case_id"])
            told = not done and 0 < total <= len(seen)
            cases = sorted(seen)
            state.update(([], 0, 0, True) if done or told else (cases, slow, total, False))
            state.setTimeoutDuration(idle_ms)
        if told:
            rows = {"run": [key[0]], "completed": [len(cases)], "timed_out": [slow], "progress_total": [total], "finished": [0 < total <= len(cases)]}
            yield pd.DataFrame(rows)

    used = df.where((clean_text("case_id") != "") & F.col(run).isNotNull()).select(run, "case_id", "timed_out", "progress_total")
    state = "cases array<string>, slow long, total int, done boolean"
    return used.groupBy(run).applyInPandasWithState(follow, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def usage_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(USAGE_LOG).json(path)


def stream_usage(df: DataFrame, window: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Tokens per method and model in tumbling windows; later lines than ``delay`` are dropped."""
    d = usage_tokens(df)
    if dict(d.dtypes)[ts] != "timestamp":
        d = d.withColumn(ts, F.timestamp_seconds(ts))
    return (
        d.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"), "method", "model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum("total_tokens").alias("total_tokens"),
        )
        .select(F.col("w.start").alias("window_start"), "method", "model", "calls", "prompt_tokens", "completion_tokens", "total_tokens")
    )
