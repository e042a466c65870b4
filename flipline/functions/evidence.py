"""Evidence paths, answer parsing, weak-signal weights and the texts built from evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipline.functions.signals import has_fix_word
from flipline.functions.text import (
    clean_text,
    col,
    collapse,
    join_lines,
    join_present,
    let,
    lines,
    rstrip,
    strip,
    truncate_block,
)

# Section names, path classes, patterns and weights.
SECTIONS = ["Diagnosis", "Selected Hunks", "Supporting Evidence", "Open Questions"]
FINAL_MARKER = "Final response:"
EVIDENCE_PATH = (
    r"((?:version-diff/)?(?:api-diffs|diffs)/[^\s)]+?\.diff|version-diff/pom\.diff|version-diff/summary\.json|"
    r"dependency-tree\.diff|trace-diff-summary\.txt|(?:baseline|target)-observation-excerpt\.txt|"
    r"target-prepare-generator-excerpt\.txt|execution-observations\.json)"
)
SUPPLEMENTAL_PATHS = [
    "trace-diff-summary.txt",
    "target-observation-excerpt.txt",
    "baseline-observation-excerpt.txt",
    "target-prepare-generator-excerpt.txt",
    "dependency-tree.diff",
    "execution-observations.json",
    "version-diff/pom.diff",
    "version-diff/summary.json",
]
EMPTY_DEPENDENCY_DIFF = "(no dependency tree diff)"
INLINE_DIFF_LINE = r"(?U)\A\s*(?:--- |\+\+\+ |@@ |diff --git |index |[+-][^+-])"
NUMBERED_ITEM = r"(?U)\A\d+[.)]\s+"
SYNTHETIC_NAME = r"(?iU)\$\d+\.diff$"
LOGGER_NAME = r"(?iU)\b(?:internalloggerfactory|internallogger|loggerfactory)\b"
SWITCH_MAP = r"(?iU)\$switchmap|switch\s*map"
ENUM_REORDER = r"\benum\b.{0,80}\b(?:ordinal|values\(\))\b"
RAW_CONTEXT_MARK = "Aligned raw context preview:"
MAX_HUNKS = 5
MAX_SUPPLEMENTS = 4


def evidence_path(c: Column | str) -> Column:
    """Canonical path of a piece of evidence."""
    return let(
        clean_text(c),
        lambda raw: F.when(
            raw.startswith("api-diffs/") | raw.startswith("diffs/"), F.concat(F.lit("version-diff/"), raw)
        ).otherwise(raw),
    )


def _kind(p: Column) -> Column:
    return (
        F.when(p.startswith("version-diff/api-diffs/"), "api_diff")
        .when(p.startswith("version-diff/diffs/"), "bytecode_diff")
        .when(p == "version-diff/pom.diff", "pom_diff")
        .when(p == "version-diff/summary.json", "version_diff_summary")
        .when(p == "dependency-tree.diff", "dependency_tree_diff")
        .when(p == "trace-diff-summary.txt", "trace_summary")
        .when(p.endswith("-observation-excerpt.txt"), "observation_excerpt")
        .when(p == "execution-observations.json", "execution_observations")
        .otherwise("generic_file")
    )


def _is_api(p: Column) -> Column:
    return p.startswith("version-diff/api-diffs/")


def _is_class(p: Column) -> Column:
    return _is_api(p) | p.startswith("version-diff/diffs/")


def evidence_kind(c: Column | str) -> Column:
    return let(evidence_path(c), _kind)


def is_class_diff(c: Column | str) -> Column:
    return let(evidence_path(c), _is_class)


def basename(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def paired_path(c: Column | str) -> Column:
    """Bytecode diff that belongs to an API diff; empty for other paths."""
    return let(
        evidence_path(c),
        lambda p: F.when(
            _is_api(p), F.regexp_replace(p, "^version-diff/api-diffs/", "version-diff/diffs/")
        ).otherwise(""),
    )


def sibling_paths(c: Column | str) -> Column:
    """Diffs of the top-level class an inner class belongs to."""

    def siblings(p: Column) -> Column:
        name = basename(p)
        folder = F.regexp_replace(p, r"/[^/]*$", "/")
        top = F.concat(F.substring_index(name, "$", 1), F.lit(".diff"))
        other = F.when(
            _is_api(p), F.regexp_replace(folder, "^version-diff/api-diffs/", "version-diff/diffs/")
        ).when(_is_class(p), F.regexp_replace(folder, "^version-diff/diffs/", "version-diff/api-diffs/"))
        found = F.array_compact(F.array(F.concat(folder, top), F.concat(other, top)))
        usable = name.contains("$") & p.startswith("version-diff/")
        none = F.array().cast("array<string>")
        return F.when(usable, F.array_distinct(F.filter(found, lambda x: x != p))).otherwise(none)

    return let(evidence_path(c), siblings)


# --- answers in markdown ----------------------------------------------------------------------------------


def final_response(c: Column | str) -> Column:
    """Text after the last marker, or null."""
    text = col(c)
    return F.when(text.contains(FINAL_MARKER), F.nullif(strip(F.substring_index(text, FINAL_MARKER, -1)), F.lit("")))


def heading(c: Column) -> Column:
    """A line reduced to the words a heading would have."""
    h = strip(c)
    h = F.regexp_replace(h, r"(?U)\A#+\s*", "")
    h = F.regexp_replace(h, r"(?U)\A(?:[-*+]\s+|\d+[.)]\s+)", "")
    h = F.regexp_replace(h, r"\A\*\*(.*?)\*\*$", "$1")
    return collapse(strip(F.btrim(strip(h), F.lit(":："))))


def _spans(tagged: Column, head_type: str) -> Column:
    """Pair every tagged line with the next one: ARRAY<STRUCT<a, b>>, ``b`` null for the last."""
    none = F.array(F.lit(None).cast(head_type))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return let(
        tagged,
        lambda t: F.filter(
            F.zip_with(t, F.concat(F.slice(t, F.lit(2), F.size(t)), none), pair), lambda s: s["a"].isNotNull()
        ),
    )


def parse_sections(c: Column | str) -> Column:
    """MAP<section name, text> of an answer; a heading opens a section, later headings of a name add to it."""
    rows = F.filter(lines(c), lambda x: ~strip(x).startswith("```"))
    head_type = "struct<head:string,pos:int>"

    def sections(rows: Column) -> Column:
        tagged = F.transform(F.transform(rows, heading), lambda h, i: F.struct(h.alias("head"), i.alias("pos")))
        heads = F.filter(tagged, lambda t: t["head"].isin(*SECTIONS))

        def cut(spans: Column) -> Column:
            def body(s: Column) -> Column:
                count = F.coalesce(s["b"]["pos"], F.size(rows)) - s["a"]["pos"] - 1
                return F.slice(rows, s["a"]["pos"] + 2, count)

            def section(name: str) -> Column:
                mine = F.filter(spans, lambda s: s["a"]["head"] == name)
                return strip(join_lines(F.flatten(F.transform(mine, body))))

            return F.create_map(*[x for name in SECTIONS for x in (F.lit(name), section(name))])

        return let(_spans(heads, head_type), cut)

    return let(rows, sections)


def inline_diff(details: Column) -> Column:
    """Diff lines quoted inside the details of a hunk."""
    kept = F.transform(F.filter(lines(details), lambda x: x.rlike(INLINE_DIFF_LINE)), rstrip)
    return truncate_block(join_lines(kept))


def parse_hunks(section: Column | str) -> Column:
    """ARRAY<STRUCT<path, details>> of a list of selected evidence.

    A bullet or numbered line that names an evidence path opens an item, the lines after it are its details.
    When no line opens an item, every distinct path named anywhere counts.
    """
    text = F.coalesce(col(section), F.lit(""))
    item_type = "struct<path:string,pos:int,line:string>"

    def items(rows: Column) -> Column:
        def tag(x: Column, i: Column) -> Column:
            opens = x.startswith("- ") | x.rlike(NUMBERED_ITEM)
            path = F.when(opens, F.nullif(F.regexp_extract(x, EVIDENCE_PATH, 1), F.lit("")))
            return F.struct(path.alias("path"), i.alias("pos"), x.alias("line"))

        def item(s: Column) -> Column:
            path, pos = s["a"]["path"], s["a"]["pos"]
            rest = F.slice(rows, pos + 2, F.coalesce(s["b"]["pos"], F.size(rows)) - pos - 1)
            bare = F.regexp_replace(s["a"]["line"], r"(?U)\A(?:-\s+|\d+[.)]\s+)", "")
            at = F.instr(bare, path)
            before = F.substring(bare, F.lit(1), at - 1)
            behind = F.substring(bare, at + F.length(path), F.length(bare))
            tail = F.btrim(F.concat(before, behind), F.lit(" :-"))
            details = F.when(tail != "", F.concat(F.array(tail), rest)).otherwise(rest)
            return F.struct(evidence_path(path).alias("path"), strip(join_lines(details)).alias("details"))

        opened = F.filter(F.transform(F.transform(rows, strip), tag), lambda t: t["path"].isNotNull())
        return F.transform(_spans(opened, item_type), item)

    named = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EVIDENCE_PATH), F.lit(1)), evidence_path))
    loose = F.transform(named, lambda p: F.struct(p.alias("path"), F.lit("").alias("details")))
    return let(let(lines(text), items), lambda listed: F.when(F.size(listed) > 0, listed).otherwise(loose))


# --- weak signals -----------------------------------------------------------------------------------------


def weak_reasons(path: Column, details: Column, excerpt: Column, trace_invalid: Column) -> Column:
    """Why a piece of evidence should count less."""
    text = F.concat_ws("\n", F.coalesce(details, F.lit("")), F.coalesce(excerpt, F.lit("")))
    first = F.struct(evidence_path(path).alias("p"), text.alias("t"))

    def reasons(x: Column) -> Column:
        p, name, low = x["p"], x["name"], x["low"]
        # Each pattern is read only over texts that hold a word of it; no other letter folds to these.
        logger = (name.contains("logger") | low.contains("logger")) & F.concat(name, F.lit("\n"), low).rlike(LOGGER_NAME)
        logger = logger & ~has_fix_word(x["t"])
        switch = low.contains("tch") & low.rlike(SWITCH_MAP)
        reorder = low.contains("enum") & low.rlike("(?isU)" + ENUM_REORDER)
        return F.array_compact(
            F.array(
                F.when(~_is_class(p), F.lit("fallback_evidence")),
                F.when(name.rlike(SYNTHETIC_NAME), F.lit("synthetic_inner_class")),
                F.when(switch | reorder, F.lit("switch_map_or_enum_reorder")),
                F.when(logger, F.lit("logger_only_change")),
                F.when((p == "trace-diff-summary.txt") & F.coalesce(trace_invalid, F.lit(False)), F.lit("invalid_trace_summary")),
            )
        )

    facts = lambda x: F.struct(x["p"], x["t"], F.lower(basename(x["p"])).alias("name"), F.lower(x["t"]).alias("low"))
    return let(let(first, facts), reasons)


def signal_weight(reasons: Column) -> Column:
    narrow = F.array(*[F.lit(x) for x in ("synthetic_inner_class", "switch_map_or_enum_reorder", "logger_only_change")])
    return (
        F.when(F.array_contains(reasons, "invalid_trace_summary"), 0.0)
        .when(F.arrays_overlap(reasons, narrow), 0.25)
        .when(F.array_contains(reasons, "fallback_evidence"), 0.35)
        .otherwise(1.0)
    )


def is_shallow_api(path: Column, excerpt: Column) -> Column:
    """An API diff that shows declarations only."""
    skip = ["+++", "---", "+$", "-$"]

    def is_signal(x: Column) -> Column:
        plain = x.startswith("+") | x.startswith("-")
        for s in skip:
            plain = plain & ~x.startswith(s)
        return plain

    def declares(x: Column) -> Column:
        body = strip(F.substring(x, F.lit(2), F.length(x)))
        named = body.contains(" class ")
        for mark in (" interface ", " enum ", "descriptor:", "Compiled from", "flags:"):
            named = named | body.contains(mark)
        parens = body.contains("(") & body.contains(")")
        field = ~body.contains("(") & ~body.contains(")") & body.endswith(";")
        return named | field | (parens & ~body.contains("descriptor:") & ~body.contains(" throws "))

    def shallow(rows: Column) -> Column:
        count = F.size(rows)
        plain = F.forall(rows, lambda x: ~x.contains("Code:") & ~x.contains("invoke"))
        return (
            (count == 0)
            | ((count <= 8) & F.forall(rows, declares))
            | ((count <= 10) & ~has_fix_word(join_lines(rows)) & plain)
        )

    rows = F.filter(F.transform(lines(excerpt), strip), is_signal)
    return let(evidence_path(path), _is_api) & let(rows, shallow)


def wants_paired_context(path: Column, excerpt: Column) -> Column:
    """API diffs that are read together with their bytecode diff."""

    def wants(p: Column) -> Column:
        name = F.lower(basename(p))
        inner = has_fix_word(excerpt) & ~name.rlike(SYNTHETIC_NAME)
        return _is_api(p) & ~name.rlike(LOGGER_NAME) & F.when(name.contains("$"), inner).otherwise(True)

    return let(evidence_path(path), wants)


def wants_raw_context(path: Column, excerpt: Column, paired: Column) -> Column:
    """Class diffs that are read together with the lines around them."""

    def wants(p: Column) -> Column:
        name = F.lower(basename(p))
        open_name = ~name.contains("$") | (F.coalesce(paired, F.lit("")) != "") | has_fix_word(excerpt)
        return _is_class(p) & ~name.rlike(LOGGER_NAME) & open_name

    return let(evidence_path(path), wants)


def has_concrete_context(path: Column, excerpt: Column, weight: Column, paired: Column) -> Column:
    """Evidence strong enough to carry a verdict."""
    facts = F.struct(
        evidence_path(path).alias("p"),
        F.coalesce(excerpt, F.lit("")).alias("t"),
        (F.coalesce(paired, F.lit("")) != "").alias("paired"),
        weight.alias("w"),
    )

    def concrete(x: Column) -> Column:
        p, t = x["p"], x["t"]
        supported = (
            t.contains(RAW_CONTEXT_MARK)
            | (_is_api(p) & x["paired"])
            | (~_is_api(p) & (t.contains("invoke") | t.contains("Code:")))
            | has_fix_word(t)
            | ~is_shallow_api(p, t)
        )
        return _is_class(p) & (x["w"] >= 0.75) & ~F.lower(basename(p)).rlike(SYNTHETIC_NAME) & supported

    return let(facts, concrete)


def summary_excerpt(json_text: Column) -> Column:
    """Counts and class preview of a version-diff summary document."""
    part = lambda key: F.get_json_object(json_text, f"$.{key}")
    count = lambda key: F.concat(F.lit(f"{key}="), F.coalesce(part(key), F.lit("?")))
    preview = F.from_json(part("changed_classes_preview"), "array<string>")
    return F.when(
        F.try_parse_json(json_text).isNull(), truncate_block(json_text, 24, 1600)
    ).otherwise(
        F.concat_ws(
            "\n",
            count("changed_class_count"),
            count("added_class_count"),
            count("removed_class_count"),
            F.when(
                F.size(F.coalesce(preview, F.array().cast("array<string>"))) > 0,
                F.concat(F.lit("changed_classes_preview="), F.array_join(F.slice(preview, 1, 5), ", ")),
            ),
        )
    )


def evidence_text(parts: list[Column]) -> Column:
    """One text of all non-empty parts of a case."""
    return strip(join_present(*parts))
