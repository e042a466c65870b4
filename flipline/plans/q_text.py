"""Queries: shortening, paths, tokens, signals, keyword search, path ranking, anchor lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipline.functions import evidence as ev
from flipline.functions import signals as sg
from flipline.functions import text as tx
from flipline.operators import search as se
from flipline.plans import bindings as b
from flipline.plans.registry import query

WS_CHARS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
WS = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}]"
NL = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines_sql(c):
    return f"CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace({c}, '({NL})$', ''), '{NL}') END"


def shorten_sql(c, n=240):
    compact = f"regexp_replace(trim({c}, {WS_CHARS}), '{WS}+', ' ', 'g')"
    return f"CASE WHEN length({compact}) <= {n} THEN {compact} ELSE left({compact}, {n - 3}) || '...' END"


def first_n(expr, n, order="i"):
    """Distinct items of a list in order of first use."""
    return f"(SELECT coalesce(string_agg(t, ',' ORDER BY i), '') FROM (SELECT t, min(i) AS i FROM (SELECT unnest({expr}) AS t, generate_subscripts({expr}, 1) AS i) GROUP BY t ORDER BY min(i) LIMIT {n}))"


def ascii_words(c, mark):
    """Non-ASCII letters become a marker of word characters, other non-ASCII characters a space.

    The SQL side knows ASCII word boundaries only; this keeps its boundaries where the Unicode ones are.
    """
    return f"regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F\\pL\\pN\\pM]', ' ', 'g'), '[^\\x00-\\x7F]', '{mark}', 'g')"


@query("pr22_shorten", f"SELECT doc_id, {shorten_sql('text')} AS s FROM documents")
def pr22(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.shorten("text").alias("s"))


_CUT = f"rtrim(left(h, 300), {WS_CHARS})"
_AT = f"coalesce(nullif(regexp_extract({_CUT}, '(?s)^(.+)\\n[^\\n]*$', 1), ''), {_CUT})"
_CLIP = f"CASE WHEN length(h) > 300 THEN {_AT} ELSE h END"


@query(
    "pr23_truncate_block",
    f"""SELECT doc_id, CASE WHEN length(h) > 300 OR n > 3 THEN rtrim({_CLIP}, {WS_CHARS}) || chr(10) || '...(truncated)' ELSE {_CLIP} END AS s FROM (
    SELECT doc_id, array_to_string(ls[1:3], chr(10)) AS h, len(ls) AS n FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents))""",
)
def pr23(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.truncate_block("text", 3, 300).alias("s"))


# --- paths ------------------------------------------------------------------------------------------------

PATHS = """SELECT page_id, 'case-' || (page_id % 50) AS case_id, CASE page_id % 10 WHEN 0 THEN 'api-diffs/' || base || '.diff' WHEN 1 THEN 'version-diff/diffs/' || base || '.diff'
  WHEN 2 THEN 'diffs/' || base || '$' || (page_id % 3) || '.diff' WHEN 3 THEN 'version-diff/api-diffs/' || base || '$Inner.diff' WHEN 4 THEN 'version-diff/pom.diff' WHEN 5 THEN 'version-diff/summary.json'
  WHEN 6 THEN 'dependency-tree.diff' WHEN 7 THEN 'trace-diff-summary.txt' WHEN 8 THEN 'target-observation-excerpt.txt' ELSE 'execution-observations.json' END AS path, base FROM (
  SELECT page_id, replace(regexp_extract(url, '//([^/]+)/', 1), '.', '/') || '/C' || (page_id % 20) || CASE WHEN page_id % 7 = 0 THEN '/Header' ELSE '' END AS base FROM pages)"""


def paths(spark, sf):
    p = F.col("page_id")
    base = F.concat(
        F.replace(F.regexp_extract("url", "//([^/]+)/", 1), F.lit("."), F.lit("/")), F.lit("/C"), p % 20, F.when(p % 7 == 0, "/Header").otherwise("")
    )
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    forms = [
        j("api-diffs/", base, ".diff"), j("version-diff/diffs/", base, ".diff"), j("diffs/", base, "$", p % 3, ".diff"),
        j("version-diff/api-diffs/", base, "$Inner.diff"), F.lit("version-diff/pom.diff"), F.lit("version-diff/summary.json"), F.lit("dependency-tree.diff"),
        F.lit("trace-diff-summary.txt"), F.lit("target-observation-excerpt.txt"), F.lit("execution-observations.json"),
    ]
    return b.table(spark, sf, "pages").select(
        "page_id", j("case-", p % 50).alias("case_id"), F.element_at(F.array(*forms), (p % 10).cast("int") + 1).alias("path"), base.alias("base")
    )


_KINDS = ["api_diff", "bytecode_diff", "bytecode_diff", "api_diff", "pom_diff", "version_diff_summary", "dependency_tree_diff", "trace_summary", "observation_excerpt", "execution_observations"]
_NORM = "CASE WHEN page_id % 10 IN (0, 2) THEN 'version-diff/' || path ELSE path END"


@query(
    "pr24_evidence_path",
    f"SELECT page_id, {_NORM} AS path, (" + str(_KINDS) + ")[page_id % 10 + 1] AS kind FROM (" + PATHS + ")",
)
def pr24(spark, sf):
    return paths(spark, sf).select("page_id", ev.evidence_path("path").alias("path"), ev.evidence_kind("path").alias("kind"))


@query(
    "pr25_related_paths",
    f"""SELECT page_id, CASE WHEN page_id % 10 IN (0, 3) THEN replace({_NORM}, '/api-diffs/', '/diffs/') ELSE '' END AS paired,
    CASE page_id % 10 WHEN 2 THEN 'version-diff/diffs/' || base || '.diff,version-diff/api-diffs/' || base || '.diff' WHEN 3 THEN 'version-diff/api-diffs/' || base || '.diff,version-diff/diffs/' || base || '.diff' ELSE '' END AS siblings FROM ({PATHS})""",
)
def pr25(spark, sf):
    return paths(spark, sf).select("page_id", ev.paired_path("path").alias("paired"), F.array_join(ev.sibling_paths("path"), ",").alias("siblings"))


# --- tokens -----------------------------------------------------------------------------------------------

_CAP = f"list_filter(regexp_extract_all({ascii_words('text', '_9Z9_')}, '\\b[A-Z][A-Za-z0-9_$]{{2,}}\\b'), lambda x: NOT contains(x, '_9Z9_'))"
_DOTS = """list_transform(regexp_extract_all(text, '[\\pL\\pN_$]+(?:\\.[\\pL\\pN_$]+)*'), lambda x: x)"""


@query("pr27_identifiers", f"SELECT doc_id, {first_n('c', 12)} AS ids FROM (SELECT doc_id, {_CAP} AS c FROM (SELECT doc_id, replace(text, '.', ' . ') AS text FROM documents))")
def pr27(spark, sf):
    spaced = F.replace(F.col("text"), F.lit("."), F.lit(" . "))
    return b.table(spark, sf, "documents").select("doc_id", F.array_join(tx.identifiers(spaced), ",").alias("ids"))


@query(
    "pr27_error_tokens",
    f"SELECT doc_id, {first_n('c', 40)} AS ids FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_$.]+') AS c FROM documents)",
)
def pr27_tokens(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.array_join(tx.error_tokens("text"), ",").alias("ids"))


_EDGE = "'" + tx.TERM_EDGE.replace("'", "''") + "'"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TERMS = f"""list_filter(list_transform(string_split_regex(text, '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\x{{a0}},]+'), lambda x: trim(x, {_EDGE})), lambda x: x <> '' AND
  length(replace(replace(replace(lower(x), '.', ''), '/', ''), '$', '')) >= 4 AND lower(x) NOT IN ({_STOP}) AND NOT starts_with(lower(x), 'cve') AND
  NOT regexp_matches(lower(x), '^(?:\\d+(?:[._-]\\d+){{0,5}}(?:[A-Za-z]+\\d*)?|[A-Za-z]+__\\d+|[A-Za-z]*\\d+[A-Za-z\\d._-]*)$') AND regexp_matches(x, '\\pL') AND NOT contains(lower(x), 'loggerfactory'))"""


@query("pr28_search_terms", f"SELECT doc_id, {first_n('c', 24)} AS terms FROM (SELECT doc_id, {_TERMS} AS c FROM documents)")
def pr28(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.array_join(tx.search_terms("text", 24), ",").alias("terms"))


@query(
    "pr29_symbol_norm",
    """SELECT url, lower(replace(replace(url, '/', '.'), '$', '.')) AS symbol, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS bare,
    trim(regexp_replace(lower(url), '[^a-z0-9]+', '.', 'g'), '.') AS dotted FROM pages""",
)
def pr29(spark, sf):
    return b.table(spark, sf, "pages").select(
        "url", tx.symbol_norm("url").alias("symbol"), tx.alnum_token("url").alias("bare"), tx.dotted_token("url").alias("dotted")
    )


@query(
    "so3_ordered_distinct",
    f"SELECT doc_id, {first_n('c', 1000000)} AS words FROM (SELECT doc_id, list_filter(string_split(replace(text, ',', ' '), ' '), lambda x: trim(x, {WS_CHARS}) <> '') AS w, list_transform(w, lambda x: trim(x, {WS_CHARS})) AS c FROM documents)",
)
def so3(spark, sf):
    words = F.split(F.replace(F.col("text"), F.lit(","), F.lit(" ")), " ")
    return b.table(spark, sf, "documents").select("doc_id", F.array_join(tx.ordered_distinct(words), ",").alias("words"))


# --- signals ----------------------------------------------------------------------------------------------


def phrase_sql(key, table=None):
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {key} % {m} = {r} THEN {quoted(p)} END" for m, r, p in (table or b.EVIDENCE_PHRASES)) + ")"


def signals_sql(c, patterns):
    found = ", ".join(f"CASE WHEN regexp_matches({c}, '(?ims){p}') THEN '{n}' END" for n, p in patterns)
    return f"concat_ws(',', {found})"


_LISTS = {"strong_absent": sg.STRONG_ABSENT, "weak_absent": sg.WEAK_ABSENT, "strong_change": sg.STRONG_CHANGE, "weak_change": sg.WEAK_CHANGE, "uncertainty": sg.UNCERTAINTY}


@query(
    "pr43_signals",
    "SELECT doc_id, " + ", ".join(f"{signals_sql('t', p)} AS {n}" for n, p in _LISTS.items())
    + f" FROM (SELECT doc_id, {ascii_words('text', 'z')} || chr(10) || {phrase_sql('doc_id')} AS t FROM documents)",
)
def pr43(spark, sf):
    text, _ = b.phrases("doc_id", b.EVIDENCE_PHRASES)
    d = b.table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", "text", text).alias("t"))
    return d.select("doc_id", *[F.array_join(sg.signals("t", p), ",").alias(n) for n, p in _LISTS.items()])


def bonus_sql(c, bonuses):
    return " + ".join(f"CASE WHEN regexp_matches({c}, '(?ims){p}') THEN {n} ELSE 0 END" for n, p in bonuses)


@query(
    "pr19_text_bonus",
    f"SELECT doc_id, {bonus_sql('t', sg.FIX_BONUS)} AS fix, {bonus_sql('t', sg.BREAKAGE_BONUS)} AS breakage FROM (SELECT doc_id, {ascii_words('text', 'z')} || chr(10) || {phrase_sql('doc_id')} AS t FROM documents)",
)
def pr19(spark, sf):
    text, _ = b.phrases("doc_id", b.EVIDENCE_PHRASES)
    d = b.table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", "text", text).alias("t"))
    return d.select("doc_id", sg.fix_bonus("t").alias("fix"), sg.breakage_bonus("t").alias("breakage"))


# --- search -----------------------------------------------------------------------------------------------

DOC_LINES = f"SELECT 'docs/' || doc_id || '.txt' AS path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents)"


def doc_lines(spark, sf):
    d = b.table(spark, sf, "documents").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    return se.to_lines(d)


def score_sql(terms, hay="lower(path || ' ' || line)"):
    return " + ".join(f"CASE WHEN contains({hay}, '{t}') THEN 1 ELSE 0 END" for t in terms)


@query(
    "tk2_keyword_search",
    f"SELECT score, path, line_no, {shorten_sql('line', 180)} AS line FROM (SELECT {score_sql(['licens', 'released', 'under', 'apache', 'that'])} AS score, * FROM ({DOC_LINES})) WHERE score > 0 ORDER BY score DESC, path, line_no LIMIT 8",
)
def tk2(spark, sf):
    return se.keyword_search(doc_lines(spark, sf), "Licens, (released) 'under' the version Apache that!")


@query(
    "tk2_keyword_search_20",
    f"SELECT score, path, line_no, {shorten_sql('line', 180)} AS line FROM (SELECT {score_sql(['licens', 'released', 'under', 'apache', 'that'])} AS score, * FROM ({DOC_LINES})) WHERE score > 0 ORDER BY score DESC, path, line_no LIMIT 20",
)
def tk2_20(spark, sf):
    return se.keyword_search(doc_lines(spark, sf), "Licens, (released) 'under' the version Apache that!", k=20)


@query(
    "tk2_keyword_search_glob",
    f"SELECT score, path, line_no, {shorten_sql('line', 180)} AS line FROM (SELECT {score_sql(['thin', 'docs'])} AS score, * FROM ({DOC_LINES}) WHERE path LIKE 'docs/%7.txt') WHERE score > 0 ORDER BY score DESC, path, line_no LIMIT 5",
)
def tk2_glob(spark, sf):
    return se.keyword_search(doc_lines(spark, sf), "thin docs", k=5, glob="docs/*7.txt")


_MANY = {"a": ["the", "of "], "b": ["ment", "ouai", "leau"], "c": ["license", "mit"]}


@query(
    "tk2_search_many",
    "SELECT query, score, path, line_no, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path, line_no) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT '{q}' AS query, {score_sql(ts)} AS score, * FROM ({DOC_LINES})" for q, ts in _MANY.items())
    + ") WHERE score > 0) WHERE rank <= 8",
)
def tk2_many(spark, sf):
    return se.search_many(doc_lines(spark, sf), _MANY)


_SCOPED = f"SELECT CASE WHEN line_no % 2 = 0 THEN 'raw' ELSE 'api-raw' END AS scope, CASE WHEN line_no % 3 = 0 THEN 'baseline' ELSE 'target' END AS variant, * FROM ({DOC_LINES})"


@query(
    "tk2_scoped_search",
    f"SELECT score, path, line_no, scope, variant, trim(line, {WS_CHARS}) AS line FROM (SELECT {score_sql(['the and', 'the', 'and', 'hand'], 'lower(line)')} AS score, * FROM ({_SCOPED}) WHERE scope = 'raw') WHERE score > 0 ORDER BY score DESC, path, line_no LIMIT 10",
)
def tk2_scoped(spark, sf):
    n = F.col("line_no")
    d = doc_lines(spark, sf).withColumns(
        {"scope": F.when(n % 2 == 0, "raw").otherwise("api-raw"), "variant": F.when(n % 3 == 0, "baseline").otherwise("target")}
    )
    return se.scoped_search(d, "the and, hand", scope="bytecode")


_T = ["'com.x.C' || (g % 20)", "'example.Net'", "'Header'", "'and'", "'hththre'", "'org.blog'"]
_DOTTED = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', '.', 'g'), '.')"
_TAIL = f"list_extract(string_split({_DOTTED.format(c='t')}, '.'), -1)"
_ONE = f"""CASE WHEN length({_TAIL}) < 4 THEN 0 WHEN {_TAIL} = name THEN 40 WHEN contains({_DOTTED.format(c='path')}, {_DOTTED.format(c='t')}) THEN least(28, 10 + length({_TAIL}))
  WHEN contains(name, {_TAIL}) THEN least(24, 8 + length({_TAIL})) WHEN contains({_DOTTED.format(c='path')}, {_TAIL}) THEN least(16, 4 + length({_TAIL}) // 2) ELSE 0 END"""
_SEM = tx.SEMANTIC_TERM.replace("(?iU)", "(?i)")
_SCORED = f"""SELECT case_id, path, name, sc + CASE WHEN starts_with(path, 'version-diff/api-diffs/') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(path, '{_SEM}') THEN 8 ELSE 0 END
  + CASE WHEN path LIKE '%.diff' AND NOT contains(list_extract(string_split(path, '/'), -1), '$') THEN 6 ELSE 0 END - CASE WHEN regexp_matches(path, '\\$\\d+\\.diff$') THEN 8 ELSE 0 END AS score FROM (
  SELECT case_id, path, name, sum({_ONE}) AS sc FROM (SELECT *, regexp_replace(lower(list_extract(string_split(path, '/'), -1)), '\\.[^.]*$', '') AS name, page_id % 50 AS g,
    unnest([{', '.join(x.replace('g %', '(page_id % 50) %') for x in _T)}]) AS t FROM (SELECT page_id, case_id, {_NORM} AS path FROM ({PATHS}))) GROUP BY case_id, path, name, page_id)"""


@query(
    "tk3_rank_diff_paths",
    f"""SELECT case_id, path, CAST(score AS INT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, path) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, name ORDER BY score DESC, path) AS r1 FROM ({_SCORED}) WHERE score > 0) WHERE r1 = 1) WHERE rank <= 5""",
)
def tk3(spark, sf):
    d = paths(spark, sf).select("case_id", ev.evidence_path("path").alias("path"))
    g = F.regexp_extract("case_id", r"\d+$", 0).cast("int")
    terms = F.array(F.concat(F.lit("com.x.C"), g % 20), F.lit("example.Net"), F.lit("Header"), F.lit("and"), F.lit("hththre"), F.lit("org.blog"))
    t = d.select("case_id").distinct().withColumn("terms", terms)
    return se.rank_diff_paths(d, t).select("case_id", "path", "score", "rank")


@query(
    "tk4_focus_terms",
    """SELECT k, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'org.x.Header.parse' END, 'com.lib.Reader' || (k % 5), CASE WHEN k % 3 > 0 THEN 'org.x.Value.parse' END, 'pkg.Extra', CASE WHEN k % 3 = 0 THEN NULL END, 'Value', 'Inner$Cls') AS terms
    FROM (SELECT o_orderkey AS k FROM orders)""".replace("CASE WHEN k % 3 = 0 THEN NULL END, 'Value'", "CASE WHEN k % 3 > 0 THEN 'Value' END").replace(
        "SELECT k, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'org.x.Header.parse' END,", "SELECT k, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'org.x.Header.parse,Header' END,"
    ),
)
def tk4(spark, sf):
    k = F.col("o_orderkey")
    mid = F.when(k % 3 == 0, "Header").otherwise("Value")
    text = F.concat(
        F.lit("index: 3\n  baseline: com.lib.Reader"), k % 5, F.lit("#run\nother: org.no.Thing\ntarget: org.x."), mid, F.lit(".parse\n- io.z.InternalLogger\n")
    )
    previews = F.array(F.lit("pkg.Extra"), F.lit("Inner$Cls"))
    d = b.table(spark, sf, "orders")
    return d.select(k.alias("k"), F.array_join(tx.focus_terms(text, previews), ",").alias("terms"))


_ANCHORS = ["the", "released under", "mit license", "eaux", "tion and the"]
_W = " + ".join(f"CASE WHEN contains(lower(line), '{t}') THEN {max(1, min(4, len(t) // 10 + 1))} ELSE 0 END" for t in _ANCHORS)


@query(
    "tk5_best_anchor",
    f"""SELECT d.doc_id, d.a AS anchor_line, CASE WHEN n = 0 THEN 0 ELSE greatest(1, coalesce(a, 1) - 2) END AS start_line, CASE WHEN n = 0 THEN 0 ELSE least(n, coalesce(a, 1) + 2) END AS end_line,
    (SELECT coalesce(string_agg(lpad(CAST(i AS VARCHAR), 5, '0') || ': ' || x, chr(10) ORDER BY i), '') FROM (SELECT unnest(ls) AS x, generate_subscripts(ls, 1) AS i) WHERE i BETWEEN greatest(1, coalesce(a, 1) - 2) AND coalesce(a, 1) + 2) AS preview FROM (
    SELECT doc_id, ls, len(ls) AS n, (SELECT arg_max(i, (s, -i)) FROM (SELECT i, {_W} AS s FROM (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i)) WHERE s > 0) AS a FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents)) d""",
)
def tk5(spark, sf):
    terms = F.array(*[F.lit(t.upper()) for t in _ANCHORS])
    d = b.table(spark, sf, "documents").select("doc_id", "text").withColumn("a", se.best_anchor("text", terms))
    return d.select("doc_id", se.context_window("text", F.col("a"), 2).alias("w")).select("doc_id", "w.*")


# Terms come from the hint first, then from changed lines; a part is followed by the tokens in it, two letters are too few.
_HINTS = {0: ('com.lib.Reader, "MIT License"\nab', ["com.lib.Reader", "MIT License", "MIT", "License"]), 1: ("ability,\n tion", ["ability", "tion"])}
_CHANGED = "--- a/x\n+++ b/x\n+ released under\n- eaux x\n kept words"
_CHANGED_TERMS = ["released under", "released", "under", "eaux x", "eaux"]
_WEIGHT = lambda terms: " + ".join(f"CASE WHEN contains(lower(line), '{t.lower()}') THEN {max(1, min(4, len(t) // 10 + 1))} ELSE 0 END" for t in terms)
_BOTH = f"CASE WHEN doc_id % 2 = 0 THEN {_WEIGHT(_HINTS[0][1] + _CHANGED_TERMS)} ELSE {_WEIGHT(_HINTS[1][1] + _CHANGED_TERMS)} END"


def _side_sql(side: str, text: str) -> str:
    return f"""SELECT doc_id, a AS {side}_anchor, CASE WHEN n = 0 THEN 0 ELSE greatest(1, coalesce(a, 1) - 3) END AS {side}_start, CASE WHEN n = 0 THEN 0 ELSE least(n, coalesce(a, 1) + 3) END AS {side}_end,
    (SELECT coalesce(string_agg(lpad(CAST(i AS VARCHAR), 5, '0') || ': ' || x, chr(10) ORDER BY i), '') FROM (SELECT unnest(ls) AS x, generate_subscripts(ls, 1) AS i) WHERE i BETWEEN greatest(1, coalesce(a, 1) - 3) AND coalesce(a, 1) + 3) AS {side}_preview
    FROM (SELECT doc_id, ls, len(ls) AS n, (SELECT arg_max(i, (s, -i)) FROM (SELECT i, {_BOTH} AS s FROM (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i)) WHERE s > 0) AS a
      FROM (SELECT a.doc_id, {lines_sql(text)} AS ls FROM documents a JOIN documents z ON z.doc_id = a.doc_id + 1))"""


@query(
    "tk5_diff_context",
    f"""SELECT *, CASE WHEN doc_id % 2 = 0 THEN '{"|".join(_HINTS[0][1] + _CHANGED_TERMS)}' ELSE '{"|".join(_HINTS[1][1] + _CHANGED_TERMS)}' END AS terms
    FROM ({_side_sql("baseline", "a.text")}) JOIN ({_side_sql("target", "z.text")}) USING (doc_id)""",
)
def tk5_context(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "text")
    pairs = d.select("doc_id", F.col("text").alias("x")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y")), "doc_id")
    hint = F.when(F.col("doc_id") % 2 == 0, _HINTS[0][0]).otherwise(_HINTS[1][0])
    c = se.diff_context(pairs.withColumns({"hint": hint, "diff": F.lit(_CHANGED)}), "hint", "diff", "x", "y", 3)
    side = lambda s: [F.col(f"{s}_context.{f}").alias(f"{s}_{n}") for f, n in (("anchor_line", "anchor"), ("start_line", "start"), ("end_line", "end"), ("preview", "preview"))]
    return c.select("doc_id", F.array_join("matched_anchor_terms", "|").alias("terms"), *side("baseline"), *side("target"))
