"""Text cleaning, splitting, shortening and tokenising.

Whitespace follows Unicode rules plus the four ASCII separator controls, so that stripping and splitting
behave the same for every input script. All functions are row-local expressions: no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
# The characters that count as whitespace at the ends of a text.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NEWLINE = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Single characters below 256 are one table look-up, a range or a higher one is a test more for each character of a text.
RARE_NEWLINE = r"[\x0B\f\r\x1c\x1d\x1e\x{85}\x{2028}-\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps lambdas from re-evaluating an outer expression."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WS_CHARS))


def clean_text(c: Column | str) -> Column:
    """Missing -> empty string, otherwise the text without surrounding whitespace."""
    return strip(F.coalesce(col(c).cast("string"), F.lit("")))


def raw_text(c: Column | str) -> Column:
    """Like :func:`clean_text`, but a missing value becomes the word ``nan``."""
    return strip(F.coalesce(col(c).cast("string"), F.lit("nan")))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(clean_text(c), F.lit(""))


def collapse(c: Column | str) -> Column:
    """Runs of whitespace become one space; ends are stripped."""
    return F.regexp_replace(clean_text(c), rf"(?U){WS}+", " ")


def shorten(c: Column | str, limit: int = 240) -> Column:
    compact = collapse(c)
    return F.when(F.length(compact) <= limit, compact).otherwise(
        F.concat(F.substring(compact, 1, limit - 3), F.lit("..."))
    )


def lines(c: Column | str) -> Column:
    """Split into lines; a trailing line end opens no extra line and empty text has no lines."""
    text = F.coalesce(col(c), F.lit(""))
    # Nearly all texts use plain line feeds, for which splitting needs no pattern.
    parts = F.when(text.rlike(RARE_NEWLINE), F.split(text, NEWLINE, -1)).otherwise(F.split(text, "\n", -1))
    return let(
        parts, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    )


def join_lines(arr: Column) -> Column:
    return F.array_join(arr, "\n")


def join_present(*parts: Column, sep: str = "\n") -> Column:
    """Join the non-empty parts."""
    return F.concat_ws(sep, *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def truncate_block(
    c: Column | str, max_lines: int = 80, max_chars: int = 5200, marker: str = "\n...(truncated)"
) -> Column:
    """Keep the first lines, then the first characters cut back to a line end; mark what was cut."""
    keep = max(1, max_lines)

    def clip(rows: Column) -> Column:
        def fit(head: Column) -> Column:
            cut = rstrip(F.substring(head, 1, max_chars))
            at_line = F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)\A(.+)\n[^\n]*\z", 1), F.lit("")), cut)
            too_long = F.length(head) > max_chars
            clipped = F.when(too_long, at_line).otherwise(head)
            return F.when(too_long | (F.size(rows) > keep), F.concat(rstrip(clipped), F.lit(marker))).otherwise(clipped)

        return let(join_lines(F.slice(rows, 1, keep)), fit)

    return let(lines(c), clip)


def ordered_distinct(arr: Column | str) -> Column:
    """Strip items, drop blanks and keep the first occurrence of each."""
    return F.array_distinct(F.filter(F.transform(col(arr), strip), lambda x: x.isNotNull() & (x != "")))


# --- identifiers and search terms -------------------------------------------------------------------------

# Token patterns, stop words and limits that decide which terms are kept.
DOTTED_IDENTIFIER = r"(?U)[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)+"
CAPITALISED_IDENTIFIER = r"(?U)\b[A-Z][A-Za-z0-9_$]{2,}\b"
ERROR_TOKEN = r"[A-Za-z_][A-Za-z0-9_$.]+"
JAVA_SYMBOL = r"(?U)\b(?:[A-Za-z_]\w*(?:[./$][A-Za-z_]\w*){1,12})\b"
CAMEL_CASE = r"(?U)\b[A-Z][A-Za-z0-9$]{3,}\b"
VERSION_LIKE = (
    r"(?U)^(?:\d+(?:[._-]\d+){0,5}(?:[A-Za-z]+\d*)?|[A-Za-z]+__\d+|[A-Za-z]*\d+[A-Za-z\d._-]*)$"
)
LOGGER_TERM = r"(?iU)\b(?:internalloggerfactory|internallogger|loggerfactory|slf4jlogger)\b"
SEMANTIC_TERM = (
    r"(?iU)\b(?:header|headers|validator|validation|validate|decoder|parser|token|whitespace|lineparser|"
    r"headerparser|defaulthttpheaders|httpobjectdecoder|httputil|httpheadervalidationutil|ascii|string|"
    r"contentdisposition|security)\b"
)
TERM_SPLIT = r"(?U)[\s\x1c-\x1f,]+"
TERM_EDGE = "`'\"[](){}:;,.!?"
STOP_WORDS = [
    "a", "an", "and", "are", "bad", "baseline", "case", "cases", "cve", "details", "effective", "error", "errors",
    "exception", "fail", "failed", "failure", "failures", "file", "files", "final", "first", "individual", "line",
    "lines", "location", "please", "reason", "refer", "regression", "results", "round", "run", "scenario", "selected",
    "skipped", "target", "test", "tests", "there", "trace", "version", "versions",
]
TERM_FILE_SUFFIXES = r"(?i)(?:\.class\.diff|\.class|\.diff|\.json|\.txt|\.java|\.log)+$"
TERM_IGNORED_TAILS = ["class", "diff", "json", "txt", "java", "log"]


def identifiers(c: Column | str, limit: int = 12) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    found = F.concat(
        F.regexp_extract_all(text, F.lit(DOTTED_IDENTIFIER), F.lit(0)),
        F.regexp_extract_all(text, F.lit(CAPITALISED_IDENTIFIER), F.lit(0)),
    )
    return F.slice(F.array_distinct(found), 1, limit)


def error_tokens(c: Column | str, limit: int = 40) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(ERROR_TOKEN), F.lit(0))
    return F.slice(F.array_distinct(found), 1, limit)


def is_generic_term(term: Column, keep_logger_terms: bool = False) -> Column:
    """Too short, a stop word, an issue id, a version, without letters, or logger noise. Cheap tests come first."""

    def generic(low: Column) -> Column:
        out = (
            (F.length(F.translate(low, "./$", "")) < 4)
            | low.isin(*STOP_WORDS)
            | low.startswith("cve")
            | (low.rlike(r"(?U)\d|__") & low.rlike(VERSION_LIKE))
            | ~low.rlike(r"\p{L}")
        )
        return out if keep_logger_terms else out | (low.contains("logger") & low.rlike(LOGGER_TERM))

    return let(F.lower(strip(term)), generic)


def _sanitise(fragments: Column, limit: int, keep_logger_terms: bool) -> Column:
    # Repeated words are dropped before they are judged.
    trimmed = F.transform(F.array_distinct(fragments), lambda x: F.btrim(x, F.lit(TERM_EDGE)))
    kept = F.filter(F.array_distinct(trimmed), lambda x: (x != "") & ~is_generic_term(x, keep_logger_terms))
    return F.slice(kept, 1, limit)


def search_terms(c: Column | str, limit: int = 24, keep_logger_terms: bool = False) -> Column:
    """Words of a text that carry meaning for a search, in order of first use."""
    return _sanitise(F.split(F.coalesce(col(c), F.lit("")), TERM_SPLIT, -1), limit, keep_logger_terms)


def search_terms_of_list(items: Column, limit: int, keep_logger_terms: bool = False) -> Column:
    parts = F.flatten(F.transform(items, lambda x: F.split(x, TERM_SPLIT, -1)))
    return _sanitise(parts, limit, keep_logger_terms)


def symbol_norm(c: Column | str) -> Column:
    """Lower-case dotted form of a class or method symbol."""
    return F.lower(F.translate(clean_text(c), "/$", ".."))


def alnum_token(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]", "")


def dotted_token(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "."), F.lit("."))


def _rank_terms(terms: Column, score) -> Column:
    """Terms by score, ties by position."""
    keyed = F.transform(terms, lambda t, i: F.struct((-score(t)).alias("s"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda k: k["t"])


def focus_terms(trace_summary: Column | str, previews: Column | None = None, limit: int = 20) -> Column:
    """Symbols of the call lines of a trace summary plus class previews, best first."""
    called = F.filter(
        F.transform(lines(trace_summary), strip),
        lambda x: x.startswith("baseline:") | x.startswith("target:") | x.startswith("- "),
    )
    symbols = F.flatten(
        F.transform(
            called,
            lambda x: F.concat(
                F.regexp_extract_all(x, F.lit(JAVA_SYMBOL), F.lit(0)),
                F.regexp_extract_all(x, F.lit(CAMEL_CASE), F.lit(0)),
            ),
        )
    )
    raw = symbols if previews is None else F.concat(symbols, F.coalesce(previews, F.array().cast("array<string>")))
    terms = search_terms_of_list(raw, limit * 2)

    def score(t: Column) -> Column:
        return (
            F.when(F.lower(t).rlike(SEMANTIC_TERM), 8).otherwise(0)
            + F.when(t.contains(".") | t.contains("/"), 3).otherwise(0)
            + F.when(t.contains("$"), 0).otherwise(2)
        )

    return F.slice(_rank_terms(terms, score), 1, limit)


def repair_terms(
    failure_keywords: Column, trace_keywords: Column, focus: Column, markdown: Column, limit: int = 48
) -> Column:
    """Terms used to look for replacement evidence: keywords, trace symbols and symbols named in an answer."""
    md = F.coalesce(markdown, F.lit(""))
    raw = F.concat(
        search_terms(failure_keywords, 16),
        search_terms(trace_keywords, 24),
        focus,
        F.regexp_extract_all(md, F.lit(JAVA_SYMBOL), F.lit(0)),
        F.regexp_extract_all(md, F.lit(CAMEL_CASE), F.lit(0)),
    )
    bare = F.transform(raw, lambda t: F.regexp_replace(strip(t), TERM_FILE_SUFFIXES, ""))
    keyed = F.transform(bare, lambda t, i: F.struct(dotted_token(t).alias("n"), i.alias("i"), t.alias("t")))
    usable = F.filter(
        keyed,
        lambda k: ~is_generic_term(k["t"])
        & (F.length(F.translate(k["n"], ".", "")) >= 4)
        & ~F.substring_index(k["n"], ".", -1).isin(*TERM_IGNORED_TAILS),
    )
    # First term per normalised form: sort by (form, position) and keep the head of each run.
    none = F.array(F.lit(None).cast("struct<n:string,i:int,t:string>"))

    def run_heads(ordered: Column) -> Column:
        first = lambda a, b: F.when(a.isNotNull() & (b.isNull() | (a["n"] != b["n"])), a)
        return F.filter(F.zip_with(ordered, F.concat(none, ordered), first), lambda a: a.isNotNull())

    heads = let(F.array_sort(usable), run_heads)

    def score(k: Column) -> Column:
        t = k["t"]
        return (
            F.when(F.lower(t).rlike(SEMANTIC_TERM), 8).otherwise(0)
            + F.when(t.contains(".") | t.contains("/"), 4).otherwise(0)
            + F.when(t.contains("$"), 0).otherwise(2)
            - F.when(F.lower(t).rlike(LOGGER_TERM), 20).otherwise(0)
        )

    best = F.array_sort(F.transform(heads, lambda k: F.struct((-score(k)).alias("s"), k["i"].alias("i"), k["t"].alias("t"))))
    return F.slice(F.transform(best, lambda k: k["t"]), 1, limit)
