"""Queries: artifacts, members, traces, documents compared; trace and dump parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipline.functions import versions as vs
from flipline.operators import diffs as df_
from flipline.plans import bindings as b
from flipline.plans.registry import query
from flipline.sources.readers import parse_trace_text

_ENTRY = "replace(class_name, '.', '/') || '/' || symbol || '.class'"
_CHANGES = f"""SELECT case_id, entry, CASE WHEN b IS NULL THEN 'added' WHEN t IS NULL THEN 'removed' WHEN b <> t THEN 'changed' ELSE 'same' END AS change FROM (
  SELECT case_id, {_ENTRY} AS entry, max(CASE side WHEN 'baseline' THEN sha END) AS b, max(CASE side WHEN 'target' THEN sha END) AS t FROM members GROUP BY 1, 2)"""


def _entries(spark, sf):
    e = F.concat(F.translate("class_name", ".", "/"), F.lit("/"), "symbol", F.lit(".class"))
    return b.members(spark, sf).select("case_id", "side", e.alias("entry"), "sha")


@query("jn9_diff_artifacts", b.with_sql("members") + _CHANGES)
def jn9(spark, sf):
    return df_.diff_artifacts(_entries(spark, sf))


_PREVIEW = "coalesce(array_to_string(list_sort(list(entry) FILTER (change = '{k}'))[1:50], ','), '') AS {k}_preview"


@query(
    "jn9_artifact_summary",
    b.with_sql("members")
    + "SELECT case_id, "
    + ", ".join(f"count(*) FILTER (change = '{k}') AS {k}_class_count, " + _PREVIEW.format(k=k) for k in ("changed", "added", "removed"))
    + f" FROM ({_CHANGES}) GROUP BY 1",
)
def jn9_summary(spark, sf):
    s = df_.artifact_summary(df_.diff_artifacts(_entries(spark, sf)))
    kinds = ("changed", "added", "removed")
    return s.select(
        "case_id", *[f"{k}_class_count" for k in kinds], *[F.array_join(f"{k}_classes_preview", ",").alias(f"{k}_preview") for k in kinds]
    )


# A class only one side has exists when the key picks it; classes are thinned per side for that.
_MEMBERS = "SELECT * FROM members WHERE NOT (side = 'target' AND class_name LIKE '%7') AND NOT (side = 'baseline' AND class_name LIKE '%8')"
_SHARED = f"SELECT case_id, class_name FROM ({_MEMBERS}) GROUP BY 1, 2 HAVING count(DISTINCT side) = 2"
_MCHANGE = f"""SELECT m.case_id, m.class_name, CASE side WHEN 'baseline' THEN 'removed_' ELSE 'added_' END || kind AS change_type, symbol FROM (
  SELECT case_id, class_name, kind, symbol, min(side) AS side FROM ({_MEMBERS}) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT side) = 1) m JOIN ({_SHARED}) s ON s.case_id = m.case_id AND s.class_name = m.class_name"""
_CCHANGE = f"""SELECT case_id, class_name, CASE min(side) WHEN 'baseline' THEN 'removed_class' ELSE 'added_class' END AS change_type, class_name AS symbol FROM ({_MEMBERS}) GROUP BY 1, 2 HAVING count(DISTINCT side) = 1"""


def _members(spark, sf):
    c, s = F.col("class_name"), F.col("side")
    return b.members(spark, sf).where(~((s == "target") & c.endswith("7")) & ~((s == "baseline") & c.endswith("8")))


@query("jn10_diff_members", b.with_sql("members") + _MCHANGE)
def jn10(spark, sf):
    return df_.diff_members(_members(spark, sf))


@query("jn10_class_changes", b.with_sql("members") + _CCHANGE)
def jn10_classes(spark, sf):
    return df_.class_changes(_members(spark, sf))


@query("jn10_breaking_changes", b.with_sql("members") + f"SELECT * FROM ({_MCHANGE}) WHERE change_type LIKE 'removed%'")
def jn10_breaking(spark, sf):
    return df_.breaking_changes(df_.diff_members(_members(spark, sf)))


@query(
    "jn10_member_stats",
    b.with_sql("members")
    + f"""SELECT case_id, sum(r)::BIGINT AS removed_class_count, sum(a)::BIGINT AS added_class_count, sum(c)::BIGINT AS changed_class_count, sum(bb)::BIGINT AS breaking_change_candidate_count FROM (
    SELECT case_id, 0 AS r, 0 AS a, 1 AS c, count(*) FILTER (change_type LIKE 'removed%') AS bb FROM ({_MCHANGE}) GROUP BY case_id, class_name
    UNION ALL SELECT case_id, CASE change_type WHEN 'removed_class' THEN 1 ELSE 0 END, CASE change_type WHEN 'added_class' THEN 1 ELSE 0 END, 0, 0 FROM ({_CCHANGE})) GROUP BY 1""",
)
def jn10_stats(spark, sf):
    m = _members(spark, sf)
    return df_.member_stats(df_.diff_members(m), df_.class_changes(m))


_ERRORS = """SELECT 'case-' || s_suppkey AS case_id, 'Error in com.lib.C' || (s_suppkey % 50) || ' near C' || (s_suppkey % 7) || '7.run and C' || (s_suppkey % 45) || ';' AS t FROM supplier"""
_ORDER = "list_position(['removed_constructors','removed_methods','removed_fields','added_constructors','added_methods','added_fields'], change_type)"


@query(
    "jn8_related_changes",
    b.with_sql("members")
    + f"""SELECT case_id, class_name, change_type, symbol, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE change_type WHEN 'removed_class' THEN 0 ELSE 1 END, class_name, {_ORDER}, symbol) AS rank FROM (
    SELECT c.* FROM (SELECT * FROM ({_CCHANGE}) WHERE change_type = 'removed_class' UNION ALL SELECT * FROM ({_MCHANGE})) c JOIN ({_ERRORS}) e ON e.case_id = c.case_id
    WHERE contains(e.t, split_part(c.class_name, '.', 3)))) WHERE rank <= 30""",
)
def jn8(spark, sf):
    s = F.col("s_suppkey")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    errors = b.table(spark, sf, "supplier").select(
        j("case-", s).alias("case_id"), j("Error in com.lib.C", s % 50, " near C", s % 7, "7.run and C", s % 45, ";").alias("error_text")
    )
    m = _members(spark, sf)
    return df_.related_changes(errors, df_.diff_members(m), df_.class_changes(m))


# --- traces -----------------------------------------------------------------------------------------------

TRACE = ("trace_rows", "calls")
_SEQ = """SELECT case_id, count(b) AS baseline_enter_count, count(t) AS target_enter_count, min(CASE WHEN b IS DISTINCT FROM t THEN pos END) AS div_index,
  arg_min(coalesce(b, '<trace ended>'), pos) FILTER (b IS DISTINCT FROM t) AS div_baseline, arg_min(coalesce(t, '<trace ended>'), pos) FILTER (b IS DISTINCT FROM t) AS div_target FROM (
  SELECT case_id, pos, max(CASE side WHEN 'baseline' THEN symbol END) AS b, max(CASE side WHEN 'target' THEN symbol END) AS t FROM calls GROUP BY 1, 2) GROUP BY 1"""
# Symbols of the busiest event types are told apart by position, so that one-sided symbols exist.
_CALLS2 = "SELECT case_id, side, pos, CASE WHEN pos % 17 = 3 THEN symbol || '#' || side || pos % 5 ELSE symbol END AS symbol FROM calls"
_ONE = """coalesce((SELECT string_agg(symbol, ',' ORDER BY pos, symbol) FROM (SELECT symbol, min(pos) AS pos FROM c2 x WHERE x.case_id = s.case_id GROUP BY symbol HAVING min(side) = '{s}' AND max(side) = '{s}')), '') AS {s}_only"""


def _calls2(spark, sf):
    p = F.col("pos")
    return b.calls(spark, sf).withColumn(
        "symbol", F.when(p % 17 == 3, F.concat("symbol", F.lit("#"), "side", p % 5)).otherwise(F.col("symbol"))
    )


@query(
    "jn11_diff_traces",
    b.with_sql(*TRACE).rstrip()
    + f", c2 AS ({_CALLS2})\n"
    + f"SELECT s.*, {_ONE.format(s='baseline')}, {_ONE.format(s='target')} FROM ({_SEQ.replace('FROM calls', 'FROM c2')}) s",
)
def jn11(spark, sf):
    d = df_.diff_traces(_calls2(spark, sf))
    return d.select(
        "case_id", "baseline_enter_count", "target_enter_count",
        F.col("first_divergence.index").alias("div_index"), F.col("first_divergence.baseline").alias("div_baseline"), F.col("first_divergence.target").alias("div_target"),
        F.array_join("baseline_only_unique", ",").alias("baseline_only"), F.array_join("target_only_unique", ",").alias("target_only"),
    )


_NAMES = {"click": "io.netty.buffer.ByteBuf", "error": "org.x.InternalLoggerFactory$1", "purchase": "io/netty/channel/embedded/EmbeddedChannel", "signup": "org.x.Parser", "view": "org.x.Header"}
_NAME_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " ELSE {c} END"


@query(
    "jn13_annotate_trace",
    b.with_sql(*TRACE)
    + f"""SELECT case_id, concat_ws(',', CASE WHEN noise THEN 'initialization_noise_internalloggerfactory' END, CASE WHEN net AND buf THEN 'netty_http_header_bytebuf_compat_noise' END) AS reasons,
    noise AS first_divergence_is_noise, d AND NOT noise AND NOT (net AND buf) AS trace_evidence_valid FROM (
    SELECT case_id, div_index IS NOT NULL AS d, CAST(regexp_extract(case_id, '\\d+$') AS INT) % 2 = 0 AS net, coalesce(div_baseline = 'error' OR div_target = 'error', false) AS noise,
      coalesce(div_baseline IN ('click', 'purchase') AND div_target IN ('click', 'purchase'), true) AS buf FROM ({_SEQ}))""",
)
def jn13(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    c = b.calls(spark, sf).withColumn("symbol", F.coalesce(F.try_element_at(names, F.col("symbol")), "symbol"))
    even = F.regexp_extract("case_id", r"\d+$", 0).cast("int") % 2 == 0
    d = df_.diff_traces(c).withColumn("artifact", F.when(even, df_.BUFFER_ARTIFACT).otherwise("org.x:y"))
    d = df_.annotate_trace(d)
    return d.select("case_id", F.array_join("trace_invalid_reasons", ",").alias("reasons"), "first_divergence_is_noise", "trace_evidence_valid")


_LINES = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no, event_id, event_type FROM events WHERE event_id % 4 < 3"""


@query(
    "sc9_parse_traces",
    """SELECT event_id % 3 AS m, user_id, CASE WHEN event_id % 3 = 0 THEN 'ENTER' ELSE 'META' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'com.lib.' || event_type || '#run' END AS symbol,
    CASE WHEN event_id % 3 = 1 THEN event_type END AS meta_key, CASE WHEN event_id % 3 = 1 THEN 'v=' || event_id ELSE '' END AS value, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY ALL""",
)
def sc9(spark, sf):
    e, t = F.col("event_id"), F.col("event_type")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    line = (
        F.when(e % 3 == 0, j(e, " ENTER [main] depth=3 com.lib.", t, "#run"))
        .when(e % 3 == 1, j(e, " META [main] ", t, "=v=", e))
        .otherwise(j("noise ENTER ", t))
    )
    d = b.table(spark, sf, "events").select("user_id", "event_id", j(line, "\nother text\n").alias("text"))
    out = parse_trace_text(d.withColumn("id", F.struct("user_id", "event_id")).select("id", "text"), "id", "text")
    return out.groupBy(
        (F.col("id.event_id") % 3).alias("m"), F.col("id.user_id").alias("user_id"), "kind", "symbol", "meta_key", "value"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sc9_last_meta",
    "SELECT user_id, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
)
def sc9_meta(spark, sf):
    d = b.table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), "event_id", "value")
    return df_.last_meta(d, ["user_id"], "event_id")


# --- names and dumps --------------------------------------------------------------------------------------


@query(
    "pr26_class_names",
    b.with_sql("members")
    + f"""SELECT case_id, replace(left(e, length(e) - 6), '/', '.') AS class_name, count(*) AS n FROM (SELECT case_id, {_ENTRY} AS e FROM members)
    WHERE starts_with(e, 'com/lib/C1/') OR starts_with(e, 'com/lib/C2/') OR starts_with(e, 'com/lib/C33/') GROUP BY 1, 2""",
)
def pr26(spark, sf):
    d = _entries(spark, sf).where(vs.has_class_prefix("entry", ["com.lib.C1", "/com//lib/C2/", " com.lib.C33 ", ""]))
    return d.groupBy("case_id", vs.class_name("entry").alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pr47_parse_members",
    """SELECT k, 'com.lib.K' || (k % 9) AS dump_class, kind, symbol FROM (SELECT o_orderkey AS k, unnest(['constructors', 'methods', 'fields']) AS kind,
    unnest(['K' || (o_orderkey % 9) || '(I)V', 'run' || (o_orderkey % 4) || '()Z', 'f' || (o_orderkey % 6) || ':J']) AS symbol FROM orders)""",
)
def pr47(spark, sf):
    k = F.col("o_orderkey")
    dump = F.format_string(
        "$ javap x\nCompiled from \"K.java\"\npublic class com.lib.K%d {\n  public com.lib.K%d(int);\n    descriptor: (I)V\n\n  dangling;\n"
        "  boolean run%d();\n    descriptor: ()Z\n    descriptor: ()X\n  private long f%d;\n    descriptor: J\n}\n",
        k % 9, k % 9, k % 4, k % 6,
    )
    d = b.table(spark, sf, "orders").select(k.alias("k"), dump.alias("dump"), F.lit("fallback.Name").alias("class_name"))
    return df_.parse_members(d).select("k", "dump_class", "kind", "symbol")


# --- documents --------------------------------------------------------------------------------------------

_DOC_PAIRS = """SELECT a.doc_id, a.text AS x, z.text AS y FROM documents a JOIN documents z ON z.doc_id = a.doc_id + 1"""


def _doc_pairs(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.col("text").alias("x")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y")), "doc_id")


_SPLIT = "unnest(string_split_regex(regexp_replace({c}, '(\\r\\n|[\\n\\x0B\\f\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}])$', ''), '\\r\\n|[\\n\\x0B\\f\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'))"


@query(
    "so4_line_changes",
    f"""SELECT doc_id, sum(greatest(-n, 0))::BIGINT AS removed_lines, sum(greatest(n, 0))::BIGINT AS added_lines FROM (SELECT doc_id, line, sum(s) AS n FROM (
    SELECT doc_id, {_SPLIT.format(c='x')} AS line, -1 AS s FROM ({_DOC_PAIRS}) WHERE x <> y AND x <> '' UNION ALL SELECT doc_id, {_SPLIT.format(c='y')}, 1 FROM ({_DOC_PAIRS}) WHERE x <> y AND y <> '') GROUP BY 1, 2) GROUP BY 1""",
)
def so4(spark, sf):
    return df_.line_changes(_doc_pairs(spark, sf), "doc_id", "x", "y")


_LINES_OF = _SPLIT.removeprefix("unnest(").removesuffix(")")
_LINE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {s} AS s, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS p FROM (SELECT doc_id, {_LINES_OF.format(c=c)} AS a FROM ({_DOC_PAIRS}) WHERE x <> y AND {c} <> '')"
    for s, c in enumerate("xy")
)
# Anchors one by one: the least end of a rising run of every length, and for each anchor the one before it on its run.
_LINE_DIFF = f"""WITH RECURSIVE sides AS ({_LINE_ROWS}),
  alone AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, i, j FROM (SELECT doc_id, line, min(p) FILTER (s = 0) AS i, min(p) FILTER (s = 1) AS j
    FROM sides GROUP BY 1, 2 HAVING count(*) FILTER (s = 0) = 1 AND count(*) FILTER (s = 1) = 1)),
  runs AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(j BIGINT, k BIGINT)[]) AS ends, CAST([] AS BIGINT[]) AS prior FROM alone
    UNION ALL SELECT doc_id, k, ends[:n] || [struct_pack(j := j, k := k)] || ends[n + 2:], list_append(prior, CASE WHEN n > 0 THEN ends[n].k END)
    FROM (SELECT a.doc_id, a.k, a.j, r.ends, r.prior, len([e FOR e IN r.ends IF e.j < a.j]) AS n FROM runs r JOIN alone a ON a.doc_id = r.doc_id AND a.k = r.k + 1)),
  chain AS (SELECT doc_id, ends[-1].k AS k, prior FROM (SELECT doc_id, arg_max(ends, k) AS ends, arg_max(prior, k) AS prior FROM runs GROUP BY 1)
    UNION ALL SELECT doc_id, prior[k], prior FROM chain WHERE prior[k] IS NOT NULL),
  marks AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM chain JOIN alone USING (doc_id, k)),
  placed AS (SELECT *, p - coalesce(max(CASE WHEN g IS NOT NULL THEN p END) OVER w, -1) AS t, coalesce(max(g) OVER w, 0) AS gap
    FROM (SELECT l.*, m.g FROM sides l LEFT JOIN marks m ON m.doc_id = l.doc_id AND l.p = CASE l.s WHEN 0 THEN m.i ELSE m.j END) WINDOW w AS (PARTITION BY doc_id, s ORDER BY p)),
  stepped AS (SELECT *, max(t) OVER (PARTITION BY doc_id, s, gap) - t AS u FROM placed),
  headed AS (SELECT a.*, z.p AS hp, bool_and(coalesce(a.line = z.line, false)) OVER (PARTITION BY a.doc_id, a.s, a.gap ORDER BY a.t) AS head
    FROM stepped a LEFT JOIN stepped z ON z.doc_id = a.doc_id AND z.gap = a.gap AND z.t = a.t AND z.s <> a.s),
  tailed AS (SELECT a.*, z.p AS tp, bool_and(NOT a.head AND coalesce(a.line = z.line AND NOT z.head, false)) OVER (PARTITION BY a.doc_id, a.s, a.gap ORDER BY a.u) AS tail
    FROM headed a LEFT JOIN headed z ON z.doc_id = a.doc_id AND z.gap = a.gap AND z.u = a.u AND z.s <> a.s),
  diffs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gap, CASE WHEN head THEN 0 WHEN tail THEN 3 ELSE s + 1 END, p) AS place, CASE WHEN head OR tail THEN ' ' WHEN s = 0 THEN '-' ELSE '+' END AS sign,
    CASE WHEN s = 0 THEN p + 1 END AS before_line, CASE WHEN s = 1 THEN p + 1 WHEN head THEN hp + 1 WHEN tail THEN tp + 1 END AS after_line, line FROM tailed WHERE s = 0 OR NOT (head OR tail))
"""


@query("so4_line_diff", _LINE_DIFF + "SELECT * FROM diffs")
def so4_rows(spark, sf):
    return df_.line_diff(_doc_pairs(spark, sf), "doc_id", "x", "y")


_RANGE = "CASE WHEN {n} = 1 THEN {last}::VARCHAR ELSE (CASE WHEN {n} = 0 THEN {last} ELSE {last} - {n} + 1 END) || ',' || {n} END"


@query(
    "so4_unified_diff",
    _LINE_DIFF
    + f"""SELECT doc_id, length(d) AS n, md5(d) AS h FROM (
  SELECT p.doc_id, CASE WHEN t IS NULL THEN '(no textual diff)' || chr(10) ELSE '--- doc-' || p.doc_id || chr(10) || '+++ doc-' || (p.doc_id + 1) || chr(10) || t || chr(10) END AS d FROM ({_DOC_PAIRS}) p
  LEFT JOIN (SELECT doc_id, string_agg('@@ -' || {_RANGE.format(n="nb", last="lb")} || ' +' || {_RANGE.format(n="na", last="la")} || ' @@' || chr(10) || body, chr(10) ORDER BY hunk) AS t FROM (
    SELECT doc_id, hunk, count(*) FILTER (sign <> '+') AS nb, count(*) FILTER (sign <> '-') AS na, max(b) AS lb, max(a) AS la, string_agg(sign || line, chr(10) ORDER BY place) AS body FROM (
      SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY place) AS hunk FROM (
        SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) = 1 THEN 0 ELSE 1 END AS o FROM (
          SELECT *, max(CASE WHEN sign <> ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near,
            count(*) FILTER (sign <> '+') OVER (PARTITION BY doc_id ORDER BY place) AS b, count(*) FILTER (sign <> '-') OVER (PARTITION BY doc_id ORDER BY place) AS a FROM diffs) WHERE near = 1)) GROUP BY 1, 2) GROUP BY 1) t ON t.doc_id = p.doc_id)""",
)
def so4_unified(spark, sf):
    d = df_.unified_diff(_doc_pairs(spark, sf), "doc_id", "x", "y", F.concat(F.lit("doc-"), "doc_id"), F.concat(F.lit("doc-"), F.col("doc_id") + 1))
    return d.select("doc_id", F.length("diff").alias("n"), F.md5("diff").alias("h"))
