"""Two sides compared: archives, class members, call traces, text lines."""

from __future__ import annotations

import io
import zipfile
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipline.functions.text import clean_text, error_tokens, lines, strip, symbol_norm
from flipline.operators.scans import in_lists, last_of, top_per_key

# Markers, caps of previews and noise rules.
TRACE_ENDED = "<trace ended>"
PREVIEW = 50
RELATED_CAP = 30
LOGGER_MARK = "internalloggerfactory"
BUFFER_ARTIFACT = "io.netty:netty-codec-http"
BUFFER_PREFIXES = ("io.netty.buffer.", "io.netty.channel.embedded.")
MEMBER_KINDS = ["constructors", "methods", "fields"]
CHANGE_ORDER = [
    "removed_constructors",
    "removed_methods",
    "removed_fields",
    "added_constructors",
    "added_methods",
    "added_fields",
]


def previews(rows: DataFrame, key: str, group: str, item: str, order: list[Column], cap: int = PREVIEW) -> DataFrame:
    """First ``cap`` items per (key, group) as an array; rows are trimmed before they are collected."""
    top = top_per_key(rows, [key, group], order, cap, "__rank")
    return (
        top.groupBy(key, group)
        .agg(F.sort_array(F.collect_list(F.struct("__rank", item))).alias("__l"))
        .select(key, group, F.transform("__l", lambda x: x[item]).alias("preview"))
    )


def both_sides(df: DataFrame, keys: list[str], side: str = "side", value: Column | None = None) -> DataFrame:
    """One row per key with flags for the sides it is on, and each side's value when one is given."""
    base, target = F.col(side) == "baseline", F.col(side) == "target"
    agg = [F.bool_or(base).alias("in_baseline"), F.bool_or(target).alias("in_target")]
    if value is not None:
        agg += [F.max(F.when(base, value)).alias("baseline_value"), F.max(F.when(target, value)).alias("target_value")]
    return df.groupBy(*keys).agg(*agg)


def diff_artifacts(entries: DataFrame, case: str = "case_id", entry: str = "entry", digest: str = "sha") -> DataFrame:
    """Change of every archive entry: added, removed, changed or same.

    ``entries(case, side, entry, sha)``. Content is compared by digest, so no bytes are shuffled.
    """
    d = both_sides(entries, [case, entry], value=F.col(digest))
    change = (
        F.when(~F.col("in_baseline"), "added")
        .when(~F.col("in_target"), "removed")
        .when(F.col("baseline_value") != F.col("target_value"), "changed")
        .otherwise("same")
    )
    return d.select(case, entry, change.alias("change"))


def artifact_summary(changes: DataFrame, case: str = "case_id", entry: str = "entry", cap: int = PREVIEW) -> DataFrame:
    """Counts and previews per case over :func:`diff_artifacts` output."""
    kinds = ["changed", "added", "removed"]
    counts = changes.groupBy(case).agg(*[F.count_if(F.col("change") == k).alias(f"{k}_class_count") for k in kinds])
    lists = previews(changes.where(F.col("change") != "same"), case, "change", entry, [F.col(entry)], cap)
    wide = lists.groupBy(case).pivot("change", kinds).agg(F.first("preview"))
    none = F.array().cast("array<string>")
    return counts.join(wide, case, "left").select(
        case,
        *[f"{k}_class_count" for k in kinds],
        *[F.coalesce(F.col(k), none).alias(f"{k}_classes_preview") for k in kinds],
    )


def parse_members(df: DataFrame, dump: str = "dump", fallback: str = "class_name") -> DataFrame:
    """Members of a class signature dump as rows (kind, symbol); one symbol is name plus descriptor."""
    kept = F.filter(
        F.transform(lines(dump), strip),
        lambda x: ~x.startswith("$") & ~x.startswith("Compiled from") & (x.startswith("descriptor:") | x.endswith(";")),
    )
    declared = F.regexp_extract(F.coalesce(dump, F.lit("")), r"\b(?:class|interface|enum)[ \t]+([A-Za-z0-9_$.]+)", 1)
    d = df.withColumns({"__kept": kept, "dump_class": F.coalesce(F.nullif(declared, F.lit("")), F.col(fallback))})
    # A descriptor line belongs to the declaration right before it.
    pairs = F.filter(
        F.zip_with(
            F.concat(F.array(F.lit(None).cast("string")), "__kept"),
            "__kept",
            lambda a, b: F.when(
                a.isNotNull() & b.startswith("descriptor:") & ~a.startswith("descriptor:"), F.struct(a.alias("d"), b.alias("t"))
            ),
        ),
        lambda p: p.isNotNull(),
    )
    d = d.withColumn("__p", F.explode(pairs)).drop("__kept", dump)
    decl = F.col("__p.d")
    desc = strip(F.regexp_replace(F.col("__p.t"), "^descriptor:", ""))
    simple = F.substring_index(F.substring_index("dump_class", ".", -1), "$", -1)
    callee = F.regexp_extract(decl, r"([A-Za-z0-9_$.<>$]+)\s*\(", 1)
    name = F.substring_index(callee, ".", -1)
    field = F.regexp_extract(decl, r"([A-Za-z0-9_$]+);$", 1)
    is_call = decl.contains("(") & decl.contains(")")
    d = d.withColumns(
        {
            "kind": F.when(is_call, F.when(name == simple, "constructors").otherwise("methods")).otherwise("fields"),
            "symbol": F.when(is_call & (callee != ""), F.concat(name, desc)).when(~is_call & (field != ""), F.concat(field, F.lit(":"), desc)),
        }
    )
    return d.where(F.col("symbol").isNotNull()).drop("__p")


def diff_members(members: DataFrame, case: str = "case_id", cls: str = "class_name") -> DataFrame:
    """Changes of members in classes both sides have: (case, class, change_type, symbol).

    ``members(case, side, class, kind, symbol)``. Use :func:`class_changes` for whole classes.
    """
    shared = both_sides(members, [case, cls]).where("in_baseline and in_target").select(case, cls)
    d = both_sides(members, [case, cls, "kind", "symbol"]).where(F.col("in_baseline") != F.col("in_target"))
    return d.join(shared, [case, cls], "left_semi").select(
        case, cls, F.concat(F.when(F.col("in_baseline"), "removed_").otherwise("added_"), F.col("kind")).alias("change_type"), "symbol"
    )


def class_changes(members: DataFrame, case: str = "case_id", cls: str = "class_name") -> DataFrame:
    """Classes only one side has, as ``removed_class`` and ``added_class`` rows."""
    d = both_sides(members, [case, cls]).where(F.col("in_baseline") != F.col("in_target"))
    return d.select(case, cls, F.when(F.col("in_baseline"), "removed_class").otherwise("added_class").alias("change_type"), F.col(cls).alias("symbol"))


def breaking_changes(changes: DataFrame) -> DataFrame:
    """Removed members of shared classes."""
    return changes.where(F.col("change_type").isin(*CHANGE_ORDER[:3]))


def member_stats(changes: DataFrame, classes: DataFrame, case: str = "case_id", cls: str = "class_name") -> DataFrame:
    """Counts per case: removed, added and changed classes, breaking changes.

    Member changes are reduced to one row per class before classes are counted, so no distinct sets are built.
    """
    per_class = changes.groupBy(case, cls).agg(F.count_if(F.col("change_type").startswith("removed_")).alias("b"))
    a = per_class.select(case, F.lit(0).alias("r"), F.lit(0).alias("a"), F.lit(1).alias("c"), "b")
    kind = F.col("change_type")
    b = classes.select(
        case,
        (kind == "removed_class").cast("int").alias("r"),
        (kind == "added_class").cast("int").alias("a"),
        F.lit(0).alias("c"),
        F.lit(0).cast("bigint").alias("b"),
    )
    return a.unionByName(b).groupBy(case).agg(
        F.sum("r").alias("removed_class_count"),
        F.sum("a").alias("added_class_count"),
        F.sum("c").alias("changed_class_count"),
        F.sum("b").alias("breaking_change_candidate_count"),
    )


def related_changes(
    errors: DataFrame, changes: DataFrame, classes: DataFrame, case: str = "case_id", cls: str = "class_name", text: str = "error_text", cap: int = RELATED_CAP
) -> DataFrame:
    """API changes an error text speaks about: removed classes first, then members of named classes.

    The text of a case meets the classes of that case, each with its changes, as one list and says which it names, so no
    text is copied to a change. Order inside a case is removed classes by name, then classes by name
    with their change types in fixed order, then symbols.
    """
    e = errors.select(case, F.coalesce(F.col(text), F.lit("")).alias("__t")).withColumn("__tok", error_tokens("__t"))
    kinds = F.array(*[F.lit(k) for k in CHANGE_ORDER])
    removed = F.col("change_type") == "removed_class"
    rows = classes.where(removed).select(case, cls, "change_type", "symbol").unionByName(changes.select(case, cls, "change_type", "symbol"))
    of_class = rows.groupBy(case, cls, removed.alias("whole")).agg(F.collect_list(F.struct("change_type", "symbol")).alias("found"))

    def named(row: Column) -> Column:
        last = F.substring_index(row[cls], ".", -1)
        simple = F.substring_index(last, "$", -1)
        tokens = F.array_contains("__tok", row[cls]) | F.array_contains("__tok", simple) | F.col("__t").contains(simple)
        return F.when(row["whole"], tokens).otherwise(F.col("__t").contains(row[cls]) | F.col("__t").contains(last))

    hits = e.join(in_lists(of_class, case, [cls, "whole", "found"], "__names"), case).select(case, F.inline(F.filter("__names", named)))
    d = hits.select(case, cls, F.inline("found"))
    order = [
        F.when(removed, 0).otherwise(1),
        F.col(cls),
        F.array_position(kinds, F.col("change_type")),
        F.col("symbol"),
    ]
    return top_per_key(d, case, order, cap)


# --- traces -----------------------------------------------------------------------------------------------


def diff_traces(calls: DataFrame, case: str = "case_id", cap: int = PREVIEW) -> DataFrame:
    """Compare the call sequences of two runs.

    ``calls(case, side, pos, symbol)`` with positions from 0. The sequences meet on (case, position), so one long
    trace spreads over all tasks; only the first mismatch per case is kept.
    """
    at = both_sides(calls, [case, "pos"], value=F.col("symbol"))
    differs = ~F.col("baseline_value").eqNullSafe(F.col("target_value"))
    seq = at.groupBy(case).agg(
        F.count("baseline_value").alias("baseline_enter_count"),
        F.count("target_value").alias("target_enter_count"),
        F.min(
            F.when(
                differs,
                F.struct(
                    F.col("pos").alias("index"),
                    F.coalesce("baseline_value", F.lit(TRACE_ENDED)).alias("baseline"),
                    F.coalesce("target_value", F.lit(TRACE_ENDED)).alias("target"),
                ),
            )
        ).alias("first_divergence"),
    )
    firsts = calls.groupBy(case, "symbol").agg(
        F.min(F.when(F.col("side") == "baseline", F.col("pos"))).alias("b"),
        F.min(F.when(F.col("side") == "target", F.col("pos"))).alias("t"),
    )
    single = firsts.where(F.col("b").isNull() | F.col("t").isNull()).select(
        case, "symbol", F.when(F.col("t").isNull(), "baseline").otherwise("target").alias("side"), F.coalesce("b", "t").alias("pos")
    )
    lists = previews(single, case, "side", "symbol", [F.col("pos"), F.col("symbol")], cap)
    none = F.array().cast("array<string>")
    wide = lists.groupBy(case).pivot("side", ["baseline", "target"]).agg(F.first("preview"))
    return seq.join(wide, case, "left").select(
        case,
        "baseline_enter_count",
        "target_enter_count",
        "first_divergence",
        (F.col("first_divergence").isNotNull() | F.col("baseline").isNotNull() | F.col("target").isNotNull()).alias("has_difference"),
        F.coalesce("baseline", none).alias("baseline_only_unique"),
        F.coalesce("target", none).alias("target_only_unique"),
    )


def last_meta(meta: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Last value of every metadata key."""
    return last_of(meta, [*keys, "key"], pos, ["value"])


def annotate_trace(df: DataFrame, artifact: str = "artifact") -> DataFrame:
    """Say why a trace difference should not count, and whether it does."""
    base, target = symbol_norm("first_divergence.baseline"), symbol_norm("first_divergence.target")
    noise = base.contains(LOGGER_MARK) | target.contains(LOGGER_MARK)
    buffer = lambda s: (s == "") | s.startswith(BUFFER_PREFIXES[0]) | s.startswith(BUFFER_PREFIXES[1])
    empty = (F.col("baseline_enter_count") == 0) & (F.col("target_enter_count") == 0)
    reasons = F.array_compact(
        F.array(
            F.when(empty, F.lit("empty_baseline_and_target_trace")),
            F.when(noise, F.lit("initialization_noise_internalloggerfactory")),
            F.when(
                (clean_text(artifact) == BUFFER_ARTIFACT) & buffer(base) & buffer(target),
                F.lit("netty_http_header_bytebuf_compat_noise"),
            ),
        )
    )
    valid = F.col("has_difference") & (F.size("trace_invalid_reasons") == 0)
    return df.withColumn("trace_invalid_reasons", reasons).withColumns(
        {"first_divergence_is_noise": noise, "trace_evidence_valid": valid, "has_effective_difference": valid}
    )


# --- archives and documents -------------------------------------------------------------------------------


def archive_entries(files: DataFrame) -> DataFrame:
    """Class entries of zip archives with a digest of their content. ``files(path, content)``.

    Archives are read batch-wise inside tasks; only names and digests leave them.
    """

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.endswith(".class")]
                    data = [(path, n, hashlib.sha256(z.read(n)).hexdigest()) for n in names]
                yield pd.DataFrame(data, columns=["archive", "entry", "sha"])

    return files.select("path", "content").mapInPandas(unzip, "archive string, entry string, sha string")


def line_changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Removed and added line counts per document pair, as multisets.

    Equal documents are dropped by comparison before any line is produced.
    """
    d = pairs.where(~F.col(before).eqNullSafe(F.col(after)))
    side = lambda c, s: d.select(F.col(key), F.explode(lines(c)).alias("line"), F.lit(s).alias("s"))
    net = side(before, -1).unionByName(side(after, 1)).groupBy(key, "line").agg(F.sum("s").alias("n"))
    return net.groupBy(key).agg(
        F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed_lines"),
        F.sum(F.greatest(F.col("n"), F.lit(0))).alias("added_lines"),
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _increasing(values: pd.Series) -> pd.Series:
    """Places of a longest increasing run of distinct numbers, of equally long ones that with the smallest ends."""

    def one(run) -> list[int]:
        ends, at, before = [], [], []
        for k, v in enumerate(run):
            p = bisect_left(ends, v)
            before.append(at[p - 1] if p else -1)
            if p == len(ends):
                ends.append(v)
                at.append(k)
            else:
                ends[p], at[p] = v, k
        found, k = [], at[-1] if at else -1
        while k >= 0:
            found.append(k)
            k = before[k]
        return found[::-1]

    return pd.Series([one(run) for run in values], dtype=object)


def line_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Rows (key, place, sign, before_line, after_line, line) that turn one document of each pair into the other.

    ``key`` is unique in ``pairs``. A row is kept (a blank), removed (-) or added (+); line numbers count from 1, and
    ``place`` orders the rows of a pair: what is not added gives the first document, what is not removed the second.

    Lines that are unique on both sides are anchors if they lie on a longest run that rises on both sides. From each
    anchor on, and back from the next one, lines that are equal step by step are kept too; all others are removed or
    added. Documents that are equal in null or text have no rows and are dropped before any line is made. Lines are
    dealt by ``key`` once, so a task holds the lines of single pairs; only line numbers reach Python.
    """
    d = pairs.where(~F.col(before).eqNullSafe(F.col(after)))
    side = lambda c, s: d.select(key, F.lit(s).alias("__s"), F.posexplode(lines(c)).alias("__p", "line"))
    rows = side(before, 0).unionByName(side(after, 1)).repartition(key)
    on = lambda s, c: F.when(F.col("__s") == s, c)
    alone = (
        rows.groupBy(key, "line")
        .agg(*[F.count(on(s, 1)).alias(f"n{s}") for s in (0, 1)], *[F.min(on(s, F.col("__p"))).alias(f"p{s}") for s in (0, 1)])
        .where("n0 = 1 AND n1 = 1")
    )
    listed = alone.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("p0", "p1"))).alias("a"))
    chain = listed.select(key, "a", F.posexplode(_increasing(F.transform("a", lambda x: x["p1"]))).alias("__g", "k"))
    anchor = F.get("a", F.col("k"))
    ends = F.array(*[F.struct(F.lit(s).alias("__s"), anchor[f"p{s}"].alias("__p")) for s in (0, 1)])
    marks = chain.select(key, (F.col("__g") + 1).alias("__g"), F.inline(ends))
    both = rows.withColumn("__g", F.lit(None).cast("int")).unionByName(marks.withColumn("line", F.lit(None).cast("string")))
    upto = Window.partitionBy(key, "__s").orderBy("__p", F.col("__g").desc_nulls_last())
    d = both.repartition(key).withColumns(
        {
            "__gap": F.coalesce(F.last("__g", True).over(upto), F.lit(0)),
            "__t": F.col("__p") - F.coalesce(F.last(F.when(F.col("__g").isNotNull(), F.col("__p")), True).over(upto), F.lit(-1)),
        }
    ).where(F.col("__g").isNull())
    at = F.col("__p")
    across = lambda step, use: Window.partitionBy(key, "__gap", step, use)
    inside = Window.partitionBy(key, "__s", "__gap")

    def meet(d: DataFrame, step: str, use: Column, name: str) -> DataFrame:
        """Whether a line and the one as many steps along on the other side are equal, with all steps between."""
        w = across(step, "__use")
        d = d.withColumn("__use", use)
        same = F.col("__use") & (F.count("*").over(w) == 2) & (F.min("line").over(w) == F.max("line").over(w))
        d = d.withColumns({"__eq": same, f"{name}_at": F.sum("__p").over(w) - at})
        return d.withColumn(name, F.every("__eq").over(inside.orderBy(step)))

    d = meet(d, "__t", F.lit(True), "__head")
    d = d.withColumn("__u", F.max("__t").over(inside) - F.col("__t"))
    d = meet(d, "__u", ~F.col("__head"), "__tail")
    kept = F.col("__head") | F.col("__tail")
    part = F.when(F.col("__head"), 0).when(F.col("__tail"), 3).otherwise(F.col("__s") + 1)
    order = Window.partitionBy(key).orderBy("__gap", "__part", "__p")
    other = F.when(F.col("__head"), F.col("__head_at")).otherwise(F.col("__tail_at"))
    d = d.withColumns({"__kept": kept, "__part": part, "__other": other}).where(~F.col("__kept") | (F.col("__s") == 0))
    number = lambda s: F.when(F.col("__s") == s, at + 1).when(F.col("__kept"), F.col("__other") + 1).cast("int")
    return d.select(
        key,
        F.row_number().over(order).alias("place"),
        F.when(F.col("__kept"), " ").when(F.col("__s") == 0, "-").otherwise("+").alias("sign"),
        number(0).alias("before_line"),
        number(1).alias("after_line"),
        "line",
    )


def diff_hunks(rows: DataFrame, key: str, context: int = 3) -> DataFrame:
    """(key, hunk, text) of the changes among :func:`line_diff` rows, each with ``context`` kept lines around it."""
    order = Window.partitionBy(key).orderBy("place")
    change = F.col("sign") != " "
    d = rows.withColumns(
        {
            "__near": F.bool_or(change).over(order.rowsBetween(-context, context)),
            "__b": F.count_if(F.col("sign") != "+").over(order),
            "__a": F.count_if(F.col("sign") != "-").over(order),
        }
    ).where("__near")
    opens = F.coalesce(F.col("place") - F.lag("place").over(order) > 1, F.lit(True))
    d = d.withColumn("__o", opens).withColumn("hunk", F.count_if(F.col("__o")).over(order))

    def span(count: Column, last: Column) -> Column:
        """First line and number of lines; the number is left out for 1, and for 0 the line before is named."""
        first = last - count + 1
        return F.when(count == 1, first.cast("string")).otherwise(F.concat_ws(",", F.when(count == 0, first - 1).otherwise(first), count))

    d = d.groupBy(key, "hunk").agg(
        F.count_if(F.col("sign") != "+").alias("__nb"),
        F.count_if(F.col("sign") != "-").alias("__na"),
        F.max("__b").alias("__b"),
        F.max("__a").alias("__a"),
        F.sort_array(F.collect_list(F.struct("place", F.concat("sign", "line").alias("t")))).alias("__l"),
    )
    head = F.concat(F.lit("@@ -"), span(F.col("__nb"), F.col("__b")), F.lit(" +"), span(F.col("__na"), F.col("__a")), F.lit(" @@"))
    return d.select(key, "hunk", F.concat_ws("\n", head, F.transform("__l", lambda x: x["t"])).alias("text"))


def unified_diff(
    pairs: DataFrame,
    key: str,
    before: str,
    after: str,
    from_name: Column,
    to_name: Column,
    out: str = "diff",
    marker: str = "(no textual diff)\n",
) -> DataFrame:
    """Unified text diff of every pair; pairs without a changed line get the marker."""
    hunks = diff_hunks(line_diff(pairs, key, before, after), key)
    body = hunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hunk", "text"))).alias("__h"))
    text = F.concat(F.lit("--- "), from_name, F.lit("\n+++ "), to_name, F.lit("\n"), F.array_join(F.transform("__h", lambda x: x["text"]), "\n"), F.lit("\n"))
    return pairs.join(body, key, "left").withColumn(out, F.coalesce(text, F.lit(marker))).drop("__h")
