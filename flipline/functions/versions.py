"""Version parsing and ordering, artifact coordinates, class names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipline.functions.text import clean_text, col, strip

# Suffix spellings, their stage and their rank in the version order.
PRE_RELEASE = r"(?i)^(?:rc|cr|pr|preview|alpha|beta|m|milestone)-?\d*$"
RUNTIME = r"(?i)^(?:java|jdk|jre)-?(\d+)$"
DOT_PRE_RELEASE = r"(?i)^(.*?)[.]((?:rc|cr|pr|preview|alpha|beta|m|milestone)\d+)$"
PHASE_RANK = {
    "alpha": 1,
    "beta": 2,
    "milestone": 3,
    "m": 3,
    "preview": 4,
    "pr": 4,
    "cr": 5,
    "rc": 5,
    "java": 10,
    "jdk": 10,
    "jre": 10,
}
UNKNOWN_PHASE_RANK = 50
UNPARSABLE_RANK = 99


def normalize_version(c: Column | str) -> Column:
    """Leading run of digits and dots, an optional ``v`` before it dropped; empty when there is none.

    The helper the original tool imports for this is not published; this rule is the stated assumption.
    """
    return F.regexp_extract(clean_text(c), r"^v?(\d+(?:\.\d+)*)", 1)


def semver(c: Column | str) -> Column:
    """ARRAY<BIGINT> of the numeric parts; arrays compare like tuples, shorter prefix first."""
    core = normalize_version(c)
    return F.when(core == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(core, r"\."), lambda p: p.cast("bigint"))
    )


def base_version(c: Column | str) -> Column:
    text = clean_text(c)
    return (
        F.when(text.contains("-"), strip(F.substring_index(text, "-", 1)))
        .when(text.rlike(DOT_PRE_RELEASE), strip(F.regexp_extract(text, DOT_PRE_RELEASE, 1)))
        .otherwise(text)
    )


def version_suffix(c: Column | str) -> Column:
    text = clean_text(c)
    return (
        F.when(text.contains("-"), strip(F.regexp_extract(text, r"(?s)^[^-]*-(.*)$", 1)))
        .when(text.rlike(DOT_PRE_RELEASE), strip(F.regexp_extract(text, DOT_PRE_RELEASE, 2)))
        .otherwise("")
    )


def line_key(numbers: Column) -> Column:
    return (
        F.when(F.size(numbers) == 0, "unknown")
        .when(F.size(numbers) == 1, numbers[0].cast("string"))
        .otherwise(F.concat_ws(".", numbers[0].cast("string"), F.get(numbers, F.lit(1)).cast("string")))
    )


def suffix_norm(suffix: Column) -> Column:
    return F.replace(F.lower(clean_text(suffix)), F.lit("_"), F.lit("-"))


def branch_kind(suffix: Column) -> Column:
    s = suffix_norm(suffix)
    return (
        F.when(s == "", "stable")
        .when(s.rlike(PRE_RELEASE), "pre-release")
        .when(s.rlike(RUNTIME), "runtime-fork")
        .otherwise("suffix-fork")
    )


def suffix_family(suffix: Column) -> Column:
    s = suffix_norm(suffix)
    name = F.btrim(F.regexp_replace(s, r"\d+$", ""), F.lit("-"))
    name = F.btrim(F.regexp_replace(name, r"[^a-z0-9]+", "-"), F.lit("-"))
    return (
        F.when(s == "", "stable")
        .when(s.rlike(RUNTIME), F.concat(F.lit("runtime-"), F.regexp_extract(s, RUNTIME, 1)))
        .when(s.rlike(PRE_RELEASE), "pre-release")
        .otherwise(F.concat(F.lit("suffix-"), F.coalesce(F.nullif(name, F.lit("")), s)))
    )


def suffix_order(suffix: Column) -> Column:
    """STRUCT<rank, phase, number, text> that sorts suffixes."""
    s = suffix_norm(suffix)
    pattern = r"^([a-z]+)-?(\d+)?$"
    phase = F.regexp_extract(s, pattern, 1)
    number = F.coalesce(F.regexp_extract(s, pattern, 2).try_cast("bigint"), F.lit(0).cast("bigint"))
    ranks = F.create_map(*[F.lit(x) for pair in PHASE_RANK.items() for x in pair])
    parsed = s.rlike(pattern)
    return F.struct(
        F.when(s == "", 0)
        .when(~parsed, UNPARSABLE_RANK)
        .otherwise(F.coalesce(F.try_element_at(ranks, phase), F.lit(UNKNOWN_PHASE_RANK)))
        .alias("rank"),
        F.when(s == "", "").when(~parsed, s).otherwise(phase).alias("phase"),
        F.when((s == "") | ~parsed, F.lit(0).cast("bigint")).otherwise(number).alias("number"),
        s.alias("text"),
    )


def stage_rank(suffix: Column) -> Column:
    s = suffix_norm(suffix)
    return F.when(s == "", 1).when(s.rlike(PRE_RELEASE), 0).otherwise(2)


def order_key(numbers: Column, suffix: Column, version: Column) -> Column:
    """Total order of versions: numbers, stage, suffix, text."""
    return F.struct(
        numbers.alias("semver"),
        stage_rank(suffix).alias("stage"),
        suffix_order(suffix).alias("suffix"),
        version.alias("version"),
    )


def with_version_parts(df, version: str = "version"):
    """Add every parsed part of a version column."""
    text = clean_text(version)
    return (
        df.withColumn(version, text)
        .withColumns({"base_version": base_version(F.col(version)), "suffix": version_suffix(F.col(version))})
        .withColumns(
            {
                "semver": semver(F.col("base_version")),
                "core": normalize_version(F.col("base_version")),
                "branch_kind": branch_kind(F.col("suffix")),
                "suffix_family": suffix_family(F.col("suffix")),
                "suffix_key": suffix_order(F.col("suffix")),
            }
        )
        .withColumns(
            {
                "line_key": line_key(F.col("semver")),
                "order_key": order_key(F.col("semver"), F.col("suffix"), F.col(version)),
            }
        )
    )


# --- coordinates ------------------------------------------------------------------------------------------


def gav_artifact(c: Column | str) -> Column:
    """Part after the first colon; empty when there is no colon."""
    text = clean_text(c)
    return F.when(text.contains(":"), strip(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1))).otherwise("")


def gav_group(c: Column | str) -> Column:
    text = clean_text(c)
    return F.when(text.contains(":"), strip(F.substring_index(text, ":", 1))).otherwise("")


def library_key(c: Column | str) -> Column:
    return F.lower(clean_text(c))


def gav_from_text(c: Column | str) -> Column:
    """Coordinate named after the word ``package`` in a description."""
    token = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?iU)package \s*(\S+)", 1)
    bare = F.btrim(F.rtrim(token, F.lit(",.;\"'“”")), F.lit("\"'“”"))
    return F.when(bare.contains(":"), bare)


def gav_from_cause(c: Column | str) -> Column:
    """``group:artifact`` of the first full coordinate in a build error."""
    pattern = r"(?U)(?:at|artifact)\s+([A-Za-z0-9_.-]+):([A-Za-z0-9_.-]+):([A-Za-z0-9_.-]+):([^\s]+)"
    text = F.coalesce(col(c), F.lit(""))
    return F.when(
        text.rlike(pattern),
        F.concat_ws(":", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)),
    )


def class_name(entry: Column | str) -> Column:
    """Archive entry of a class file -> dotted class name."""
    e = col(entry)
    return F.translate(F.substring(e, F.lit(1), F.length(e) - 6), "/", ".")


def class_prefix(c: Column | str) -> Column:
    """Package prefix -> slash form ending in a slash; empty stays empty."""
    slashed = F.regexp_replace(F.translate(clean_text(c), ".", "/"), "/+", "/")
    bare = F.ltrim(slashed, F.lit("/"))
    return F.when((bare == "") | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def has_class_prefix(entry: Column | str, prefixes: list[str]) -> Column:
    """Whether an entry lies under any prefix; no usable prefix keeps everything."""
    wanted = F.filter(
        F.array(*[class_prefix(F.lit(p)) for p in prefixes]) if prefixes else F.array().cast("array<string>"),
        lambda p: p != "",
    )
    e = col(entry)
    return (F.size(wanted) == 0) | F.exists(wanted, lambda p: e.startswith(p))
