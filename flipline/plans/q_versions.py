"""Queries: version parsing, release branches, boundary pairs, artifacts, tags, prefixes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flipline.functions import versions as vs
from flipline.operators import artifacts as ar
from flipline.operators import lineage as ln
from flipline.operators.scans import tasks_for
from flipline.plans import bindings as b
from flipline.plans.registry import query

REL = ("release_rows", "releases")
# DuckDB compares lists and structs field by field, as Spark does.
_KEY = "(semver, stage, version)"

_VERSION_FORMS = """SELECT o_orderkey AS k, CASE o_orderkey % 8
  WHEN 0 THEN a || '.' || b WHEN 1 THEN a || '.' || b || '-RC' || c WHEN 2 THEN 'v' || a || '.' || b || '.' || c || '-jdk8' WHEN 3 THEN a || '.' || b || '.M' || c
  WHEN 4 THEN a || '.' || b || '-SNAPSHOT_' || c WHEN 5 THEN ' ' || a WHEN 6 THEN 'release' || c ELSE a || '.' || b || '.' || c || '-beta-' || c END AS version
  FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 11 AS b, o_orderkey % 7 AS c FROM orders)"""


def _version_forms(spark, sf):
    k = F.col("o_orderkey")
    a, bb, c = (k % 3).cast("string"), (k % 11).cast("string"), (k % 7).cast("string")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    forms = [
        j(a, ".", bb), j(a, ".", bb, "-RC", c), j("v", a, ".", bb, ".", c, "-jdk8"), j(a, ".", bb, ".M", c),
        j(a, ".", bb, "-SNAPSHOT_", c), j(" ", a), j("release", c), j(a, ".", bb, ".", c, "-beta-", c),
    ]
    return b.table(spark, sf, "orders").select(k.alias("k"), F.element_at(F.array(*forms), (k % 8).cast("int") + 1).alias("version"))


@query(
    "pr36_parse_version",
    f"""SELECT k, version, base_version, suffix, array_to_string(semver, '.') AS numbers, branch_kind, suffix_family, line_key, rank, phase, number,
    CASE WHEN suffix = '' THEN 1 WHEN branch_kind = 'pre-release' THEN 0 ELSE 2 END AS stage FROM (
    SELECT *, CASE WHEN len(semver) = 0 THEN 'unknown' WHEN len(semver) = 1 THEN semver[1] ELSE semver[1] || '.' || semver[2] END AS line_key,
      CASE WHEN s = '' THEN 0 WHEN phase = 'rc' THEN 5 WHEN phase = 'beta' THEN 2 WHEN phase = 'm' THEN 3 WHEN phase = 'jdk' THEN 10 WHEN phase = 'snapshot' THEN 50 END AS rank,
      CASE WHEN phase IN ('rc', 'beta', 'm') THEN 'pre-release' WHEN phase = 'jdk' THEN 'runtime-fork' WHEN s = '' THEN 'stable' ELSE 'suffix-fork' END AS branch_kind,
      CASE WHEN phase IN ('rc', 'beta', 'm') THEN 'pre-release' WHEN phase = 'jdk' THEN 'runtime-8' WHEN s = '' THEN 'stable' ELSE 'suffix-snapshot' END AS suffix_family,
      coalesce(TRY_CAST(regexp_extract(s, '(\\d+)$', 1) AS BIGINT), 0) AS number FROM (
    SELECT *, replace(lower(suffix), '_', '-') AS s, regexp_extract(replace(lower(suffix), '_', '-'), '^([a-z]*)', 1) AS phase,
      string_split(nullif(regexp_extract(base_version, '^v?(\\d+(\\.\\d+)*)', 1), ''), '.') AS sv, coalesce(sv, []) AS semver FROM (
    SELECT k, trim(version) AS version, CASE WHEN version LIKE '%-%' THEN split_part(version, '-', 1) WHEN version LIKE '%.M%' THEN split_part(version, '.M', 1) ELSE trim(version) END AS base_version,
      CASE WHEN version LIKE '%-beta-%' THEN 'beta-' || split_part(version, '-', 3) WHEN version LIKE '%-%' THEN split_part(version, '-', 2) WHEN version LIKE '%.M%' THEN 'M' || split_part(version, '.M', 2) ELSE '' END AS suffix
    FROM ({_VERSION_FORMS}))))""",
)
def pr36(spark, sf):
    d = vs.with_version_parts(_version_forms(spark, sf))
    return d.select(
        "k", "version", "base_version", "suffix", F.array_join(F.col("semver").cast("array<string>"), ".").alias("numbers"),
        "branch_kind", "suffix_family", "line_key", "suffix_key.rank", "suffix_key.phase", "suffix_key.number", F.col("order_key.stage").alias("stage"),
    )


@query(
    "pr36_version_order",
    b.with_sql(*REL) + f"SELECT artifact, version, row_number() OVER (PARTITION BY artifact ORDER BY semver, stage, version) AS rank FROM releases",
)
def pr36_order(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("artifact").orderBy("order_key")
    return b.releases(spark, sf).select("artifact", "version", F.row_number().over(w).alias("rank"))


_GAVS = "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'org.g' || o_custkey || ':lib-' || (o_orderkey % 17) WHEN 1 THEN 'plain' || o_custkey ELSE ' a.b : c:d ' END AS gav FROM orders"


@query(
    "pr37_gav_parts",
    f"""SELECT k, CASE WHEN gav LIKE '%:%' THEN trim(regexp_extract(gav, '^[^:]*:(.*)$', 1)) ELSE '' END AS artifact, CASE WHEN gav LIKE '%:%' THEN trim(split_part(gav, ':', 1)) ELSE '' END AS grp,
    CASE WHEN gav LIKE '%:%' AND k % 3 = 0 THEN gav END AS named, CASE WHEN k % 3 = 0 THEN gav END AS cause FROM ({_GAVS})""",
)
def pr37(spark, sf):
    k = F.col("o_orderkey")
    gav = (
        F.when(k % 3 == 0, F.concat(F.lit("org.g"), "o_custkey", F.lit(":lib-"), k % 17))
        .when(k % 3 == 1, F.concat(F.lit("plain"), "o_custkey"))
        .otherwise(" a.b : c:d ")
    )
    d = b.table(spark, sf, "orders").select(k.alias("k"), gav.alias("gav"))
    text = F.concat(F.lit("Found in Package \""), "gav", F.lit("\", fixed later"))
    error = F.concat(F.lit("Failure to find artifact "), "gav", F.lit(":jar:1.0 in central"))
    return d.select(
        "k", vs.gav_artifact("gav").alias("artifact"), vs.gav_group("gav").alias("grp"),
        vs.gav_from_text(text).alias("named"), vs.gav_from_cause(error).alias("cause"),
    )


_RESOLVED = """SELECT t.artifact, t.row_pos, trim(t.version) AS version, t.outcome, t.cause,
  coalesce(e.version, u.version) AS release_version, coalesce(e.release_date, u.release_date) AS release_date,
  CASE WHEN e.version IS NOT NULL THEN 'exact' WHEN u.version IS NOT NULL THEN 'normalized' ELSE 'unresolved' END AS resolution FROM {src} t
  LEFT JOIN releases e ON e.artifact = t.artifact AND e.version = t.version
  LEFT JOIN (SELECT artifact, core, min(version) AS version, min(release_date) AS release_date FROM releases GROUP BY 1, 2 HAVING count(*) = 1) u
    ON u.artifact = t.artifact AND u.core = regexp_extract(t.version, '^v?(\\d+(\\.\\d+)*)', 1)"""
TESTED = REL + ("tested",)


@query("jn4_resolve_version", b.with_sql(*TESTED) + f"SELECT artifact, row_pos, release_version, resolution FROM ({_RESOLVED.format(src='tested')})")
def jn4(spark, sf):
    return ln.resolve_version(b.tested(spark, sf), b.releases(spark, sf)).select("artifact", "row_pos", "release_version", "resolution")


@query(
    "jn18_hotfix_candidates",
    b.with_sql(*REL)
    + f"""SELECT e.artifact, e.version, arg_max(c.version, (c.release_date, c.semver, c.stage, c.version)) AS anchor_version, max(c.release_date)::DATE::VARCHAR AS anchor_date
    FROM releases e JOIN releases c ON e.artifact = c.artifact AND e.core = c.core AND c.release_date <= e.release_date
    AND e.release_date - c.release_date <= INTERVAL 400 DAY AND (c.semver, c.stage, c.version) < (e.semver, e.stage, e.version) GROUP BY 1, 2""",
)
def jn18(spark, sf):
    d = ln.hotfix_candidates(b.releases(spark, sf), 400.0)
    return d.withColumn("anchor_date", F.to_date("anchor_date").cast("string"))


# --- main line, forks -------------------------------------------------------------------------------------

_MAIN = """SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY release_date, semver, version) - 1 AS row FROM (
  SELECT *, coalesce(semver >= max(semver) OVER (PARTITION BY artifact ORDER BY release_date, semver, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_main
  FROM releases WHERE kind = 'stable') WHERE is_main"""
_FORK_HEADS = """SELECT *, CASE kind WHEN 'pre-release' THEN 'fork@' || core || '#pre' ELSE 'fork@' || line_key || '#runtime-8' END AS fork_key FROM releases WHERE kind <> 'stable'"""
_HEADS = f"SELECT artifact, fork_key, arg_min(struct_pack(release_date, semver, version, core, line_key), (release_date, semver, version)) AS h FROM ({_FORK_HEADS}) GROUP BY 1, 2"
_ASOF = f"""SELECT artifact, fork_key, coalesce(lb, ab, ll, sc, al, core_any).version AS anchor_version FROM (
  SELECT h.artifact, h.fork_key,
    max(struct_pack(d := m.release_date, s := m.semver, version := m.version)) FILTER (m.line_key = h.h.line_key AND m.release_date <= h.h.release_date) AS lb,
    max(struct_pack(d := m.release_date, s := m.semver, version := m.version)) FILTER (m.release_date <= h.h.release_date) AS ab,
    arg_min(struct_pack(d := m.release_date, s := m.semver, version := m.version), (m.release_date, m.version)) FILTER (m.line_key = h.h.line_key AND m.release_date > h.h.release_date AND m.release_date - h.h.release_date <= INTERVAL 300 DAY) AS ll,
    max(struct_pack(d := m.release_date, s := m.semver, version := m.version)) FILTER (m.core = h.h.core AND abs(epoch(m.release_date) - epoch(h.h.release_date)) <= 300 * 86400) AS sc,
    arg_min(struct_pack(d := m.release_date, s := m.semver, version := m.version), (m.release_date, m.version)) FILTER (m.release_date > h.h.release_date AND m.release_date - h.h.release_date <= INTERVAL 300 DAY) AS al,
    max(struct_pack(d := m.release_date, s := m.semver, version := m.version)) FILTER (m.core = h.h.core) AS core_any
  FROM ({_HEADS}) h LEFT JOIN ({_MAIN}) m ON m.artifact = h.artifact GROUP BY 1, 2)"""


@query("jn17_fork_anchor_asof", b.with_sql(*REL) + _ASOF)
def jn17(spark, sf):
    from pyspark.sql import Window

    h = b.releases(spark, sf)
    w = Window.partitionBy("artifact").orderBy("release_date", "semver", "version").rowsBetween(Window.unboundedPreceding, -1)
    stable = h.where("branch_kind = 'stable'").withColumn("__top", F.max("semver").over(w))
    main = stable.where(F.coalesce(F.col("semver") >= F.col("__top"), F.lit(True)))
    pre = F.col("branch_kind") == "pre-release"
    key = F.when(pre, F.concat(F.lit("fork@"), "core", F.lit("#pre"))).otherwise(F.concat(F.lit("fork@"), "line_key", F.lit("#"), "suffix_family"))
    fields = ["line_key", "release_date", "semver", "version", "core", "base_version"]
    forks = h.where("branch_kind <> 'stable'").withColumn("fork_key", key)
    heads = forks.groupBy("artifact", "fork_key").agg(F.min_by(F.struct(*fields), F.struct("release_date", "semver", "version")).alias("h"))
    out = ln.fork_anchor_asof(heads.select("artifact", "fork_key", "h.*"), main, 300.0)
    return out.select("artifact", "fork_key", "anchor_version")


_STABLE = """SELECT *, coalesce(semver >= max(semver) OVER (PARTITION BY artifact ORDER BY release_date, semver, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_main
  FROM releases WHERE kind = 'stable'"""
_PORTS = f"""SELECT artifact, version, release_date, semver, 'stable@' || line_key AS branch_key, 'stable-backport' AS branch_kind, 'stable-line' AS branch_family,
  last_value(CASE WHEN is_main THEN version END IGNORE NULLS) OVER (PARTITION BY artifact, line_key ORDER BY release_date, semver, version) AS before, core, line_key, is_main FROM ({_STABLE})"""
_PORT_ANCHOR = f"""SELECT p.artifact, p.branch_key, coalesce(p.b[1], m.last) AS av, p.b[2] AS base FROM (
    SELECT artifact, branch_key, line_key, arg_min([before, core], (release_date, semver, version)) AS b FROM ({_PORTS}) WHERE NOT is_main GROUP BY 1, 2, 3) p
  LEFT JOIN (SELECT artifact, line_key, arg_max(version, (release_date, semver, version)) AS last FROM ({_MAIN}) GROUP BY 1, 2) m ON p.artifact = m.artifact AND p.line_key = m.line_key"""
_SIDE = f"""SELECT artifact, version, release_date, semver, branch_key, branch_kind, branch_family FROM ({_PORTS}) WHERE NOT is_main
  UNION ALL SELECT artifact, version, release_date, semver, fork_key, kind, CASE kind WHEN 'pre-release' THEN 'pre-release' ELSE 'runtime-8' END FROM ({_FORK_HEADS})"""
_ANCHORS = f"SELECT * FROM ({_PORT_ANCHOR}) UNION ALL SELECT a.artifact, a.fork_key, a.anchor_version, h.h.core FROM ({_ASOF}) a JOIN ({_HEADS}) h USING (artifact, fork_key)"
_BRANCH = f"""SELECT *, row_number() OVER g AS fork_order, 1 + coalesce(sum(size) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_col FROM (
  SELECT s.*, coalesce(a.av, a.base) AS fork_anchor_version, coalesce(m.row, coalesce(c.n, 0) + row_number() OVER (PARTITION BY s.artifact, m.row IS NULL ORDER BY s.first, s.branch_key) - 1) AS row FROM (
    SELECT artifact, branch_key, any_value(branch_kind) AS bk, count(*) AS size, min(release_date) AS first FROM ({_SIDE}) GROUP BY 1, 2) s
  JOIN ({_ANCHORS}) a ON a.artifact = s.artifact AND a.branch_key = s.branch_key
  LEFT JOIN ({_MAIN}) m ON m.artifact = s.artifact AND m.version = a.av
  LEFT JOIN (SELECT artifact, count(*) AS n FROM ({_MAIN}) GROUP BY 1) c ON c.artifact = s.artifact)
  WINDOW g AS (PARTITION BY artifact, row ORDER BY CASE bk WHEN 'stable-backport' THEN 0 ELSE 1 END, first, branch_key)"""
_GRID = f"""SELECT artifact, row AS matrix_row, 0 AS matrix_col, 'main' AS branch_key, 'stable' AS branch_kind, 'main' AS branch_family, version, NULL AS fork_anchor_version, NULL AS fork_order FROM ({_MAIN})
  UNION ALL SELECT s.artifact, b.row, b.start_col + row_number() OVER (PARTITION BY s.artifact, s.branch_key ORDER BY s.release_date, s.semver, s.version) - 1,
    s.branch_key, s.branch_kind, s.branch_family, s.version, b.fork_anchor_version, b.fork_order FROM ({_SIDE}) s JOIN ({_BRANCH}) b ON s.artifact = b.artifact AND s.branch_key = b.branch_key"""


@query("an7_main_line", (b.with_sql(*REL) + _GRID).replace("INTERVAL 300 DAY", "INTERVAL 1 DAY").replace("300 * 86400", "86400"))
def an7(spark, sf):
    return ln.main_line(b.releases(spark, sf)).drop("release_date")


@query(
    "an7_branch_summary",
    (b.with_sql(*REL) + f"""SELECT artifact, branch_key, any_value(branch_family) AS branch_family, any_value(branch_kind) AS branch_kind, branch_key <> 'main' AS is_fork_branch,
    min(fork_anchor_version) AS fork_anchor_version, min(matrix_row) AS first_row, min(matrix_col) AS start_col, max(matrix_col) AS end_col, count(*) AS versions FROM ({_GRID}) GROUP BY artifact, branch_key""")
    .replace("INTERVAL 300 DAY", "INTERVAL 1 DAY").replace("300 * 86400", "86400"),
)
def an7_summary(spark, sf):
    return ln.branch_summary(ln.main_line(b.releases(spark, sf)))


# One step of the recursion places the next release of every artifact; it carries the releases and branches so far. Both lists
# are in time order, so the last match is the latest.
_DONE = "STRUCT(t BIGINT, version VARCHAR, d DATE, core VARCHAR, kind VARCHAR, line VARCHAR, major BIGINT, rank BIGINT, row BIGINT)[]"
_OPEN = """STRUCT(row BIGINT, key VARCHAR, family VARCHAR, type VARCHAR, line VARCHAR, core VARCHAR, depth BIGINT, parent BIGINT,
  anchor BIGINT, tail BIGINT, n BIGINT)[]"""
_NEAREST = """list_sort([{{'g': CASE WHEN r.major >= x.major THEN x.major - r.major ELSE -1000000000 END, 't': x.t}}
  FOR x IN f.done IF x.rank < r.rank{also}])[-1].t"""
_FOLD = f"""ranked AS (SELECT artifact, version, CAST(release_date AS DATE) AS d, core, kind, line_key AS line, semver[1] AS major,
    row_number() OVER (PARTITION BY artifact ORDER BY semver, stage, version) AS rank,
    row_number() OVER (PARTITION BY artifact ORDER BY release_date, semver, stage, version) AS t FROM releases),
  fold AS (
    SELECT DISTINCT artifact, CAST(0 AS BIGINT) AS t, CAST([] AS {_DONE}) AS done, CAST([] AS {_OPEN}) AS open FROM ranked
    UNION ALL
    SELECT artifact, t, list_append(done, struct_pack(t := t, version := version, d := d, core := core, kind := CASE WHEN type = 'hotfix' THEN type ELSE kind END,
        line := line, major := major, rank := rank, row := coalesce(joined, len(open)))),
      CASE WHEN joined IS NOT NULL THEN [struct_pack(row := b.row, key := b.key, family := b.family, type := b.type, line := b.line, core := b.core, depth := b.depth,
          parent := b.parent, anchor := b.anchor, tail := CASE WHEN b.row = joined THEN t ELSE b.tail END, n := b.n + CASE WHEN b.row = joined THEN 1 ELSE 0 END) FOR b IN open]
        ELSE list_append(open, struct_pack(row := len(open), key := CASE WHEN type = 'main' THEN type ELSE type || '@' || name || '#' || len(open) END,
          family := CASE type WHEN 'main' THEN type WHEN 'hotfix' THEN 'hotfix-' || line WHEN 'line' THEN 'line-' || line ELSE 'core-' || core END, type := type, line := line, core := core,
          depth := coalesce(open[done[anchor].row + 1].depth + 1, 0), parent := done[anchor].row, anchor := anchor, tail := t, n := 1)) END
    FROM (
      SELECT *, CASE WHEN len(open) = 0 OR fix IS NOT NULL THEN NULL WHEN own IS NOT NULL THEN own WHEN kind = 'stable' AND prior IS NOT NULL THEN NULL
          WHEN kind = 'runtime-fork' AND base IS NOT NULL THEN CASE WHEN done[shared.tail].rank <= rank THEN shared.row END END AS joined,
        CASE WHEN len(open) = 0 THEN 'main' WHEN fix IS NOT NULL THEN 'hotfix' WHEN kind = 'stable' AND prior IS NOT NULL THEN 'line'
          WHEN kind = 'runtime-fork' AND base IS NOT NULL THEN 'same-core' ELSE 'line' END AS type,
        CASE WHEN len(open) = 0 THEN NULL WHEN fix IS NOT NULL THEN fix WHEN kind = 'stable' AND prior IS NOT NULL THEN prior
          WHEN kind = 'runtime-fork' AND base IS NOT NULL THEN base ELSE lower END AS anchor,
        CASE WHEN fix IS NOT NULL OR kind = 'runtime-fork' AND base IS NOT NULL THEN core ELSE line END AS name
      FROM (
        SELECT r.*, f.done, f.open,
          [x.t FOR x IN f.done IF x.core = r.core AND x.rank < r.rank AND r.d - x.d <= 1 AND x.kind <> 'hotfix'][-1] AS fix,
          [x.t FOR x IN f.done IF x.core = r.core AND x.rank < r.rank AND r.d - x.d <= 30][-1] AS base,
          list_sort([{{'tail': b.tail, 'row': b.row}} FOR b IN f.open IF b.type IN ('main', 'line') AND b.line = r.line AND f.done[b.tail].rank <= r.rank])[-1].row AS own,
          [b FOR b IN f.open IF b.type = 'same-core' AND b.core = r.core][-1] AS shared,
          {_NEAREST.format(also=" AND x.kind = 'stable' AND x.line <> r.line")} AS prior,
          {_NEAREST.format(also="")} AS lower
        FROM fold f JOIN ranked r ON r.artifact = f.artifact AND r.t = f.t + 1))),
  lineage AS (SELECT f.artifact, x.version, x.d AS release_date, x.core, x.row AS matrix_row,
      row_number() OVER (PARTITION BY f.artifact, x.row ORDER BY x.t) - 1 AS matrix_col, b.key AS branch_key, x.kind AS branch_kind, b.family AS branch_family, b.type AS branch_type,
      b.depth AS branch_depth, b.line AS line_key, f.open[b.parent + 1].key AS parent_branch_key, b.parent AS parent_branch_row,
      f.done[b.anchor].version AS fork_anchor_version, f.done[b.anchor].d AS fork_anchor_release_date
    FROM (SELECT artifact, done, open, unnest(done) AS x FROM (SELECT artifact, arg_max(done, t) AS done, arg_max(open, t) AS open FROM fold GROUP BY artifact)) f,
      LATERAL (SELECT f.open[f.x.row + 1] AS b))"""


def _recursive(*views: str) -> str:
    return b.with_sql(*views).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _FOLD + "\n"


def _dates(d):
    return d.withColumns({c: F.to_date(c).cast("string") for c in ("release_date", "fork_anchor_release_date")})


@query(
    "an8_lineage",
    _recursive(*REL) + "SELECT * REPLACE (CAST(release_date AS VARCHAR) AS release_date, CAST(fork_anchor_release_date AS VARCHAR) AS fork_anchor_release_date) FROM lineage",
)
def an8(spark, sf):
    return _dates(ln.lineage(b.releases(spark, sf), 30.0))


@query(
    "an8_version_tree",
    _recursive(*REL)
    + """SELECT artifact, matrix_row, branch_key, branch_family, branch_type, branch_depth, line_key, parent_branch_key, parent_branch_row, fork_anchor_version,
    CAST(fork_anchor_release_date AS VARCHAR) AS fork_anchor_release_date, string_agg(version, ' ' ORDER BY matrix_col) AS versions FROM lineage GROUP BY ALL""",
)
def an8_tree(spark, sf):
    t = ln.version_tree(ln.lineage(b.releases(spark, sf), 30.0))
    versions = F.array_join(F.transform("versions", lambda v: v["version"]), " ")
    return t.withColumns({"versions": versions, "fork_anchor_release_date": F.to_date("fork_anchor_release_date").cast("string")})


def _lines_of(history, tasks):
    """Branches of a plain kind: one per line, ordered by release; a stand-in grid that SQL can state."""
    from pyspark.sql import Window

    order = F.struct("release_date", "semver", "version")
    line = Window.partitionBy("artifact", "line_key")
    d = history.repartition(tasks, "artifact").withColumns({"__o": order, "__head": F.min(order).over(line)})
    d = d.withColumn("matrix_row", F.dense_rank().over(Window.partitionBy("artifact").orderBy("__head")) - 1)
    before = Window.partitionBy("artifact").orderBy("matrix_row").rangeBetween(-1, -1)
    return d.select(
        "artifact", "version", "release_date", "core", "branch_kind", "matrix_row",
        (F.row_number().over(line.orderBy("__o")) - 1).alias("matrix_col"),
        F.concat(F.lit("line@"), "line_key").alias("branch_key"), F.concat(F.lit("line-"), "line_key").alias("branch_family"),
        F.lit("line").alias("branch_type"), F.first("__head.version").over(before).alias("fork_anchor_version"),
    )


_LINES = """SELECT r.artifact, r.version, r.release_date, r.core, r.kind AS branch_kind, l.matrix_row, row_number() OVER (PARTITION BY r.artifact, r.line_key ORDER BY r.release_date, r.semver, r.version) - 1 AS matrix_col,
  l.fork_anchor_version FROM releases r JOIN (SELECT *, lag(head) OVER (PARTITION BY artifact ORDER BY matrix_row) AS fork_anchor_version FROM (
    SELECT artifact, line_key, o.v AS head, row_number() OVER (PARTITION BY artifact ORDER BY o) - 1 AS matrix_row FROM (
      SELECT artifact, line_key, min(struct_pack(d := release_date, s := semver, v := version)) AS o FROM releases GROUP BY 1, 2))) l ON r.artifact = l.artifact AND r.line_key = l.line_key"""
_ONCE = "SELECT artifact, version, min(row_pos) AS row_pos, arg_min(outcome, row_pos) AS outcome, arg_min(cause, row_pos) AS cause FROM tested GROUP BY 1, 2"
_NEAR = f"""SELECT *, last_value(CASE WHEN r IS NOT NULL THEN struct_pack(r, c, v := version, d := release_date) END IGNORE NULLS) OVER w AS lb,
  first_value(CASE WHEN r IS NOT NULL THEN struct_pack(r, c, v := version, d := release_date) END IGNORE NULLS) OVER (PARTITION BY artifact ORDER BY row_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fa FROM (
  SELECT t.*, l.matrix_row AS r, l.matrix_col AS c, l.core AS lc, l.branch_kind, l.fork_anchor_version FROM ({_RESOLVED.format(src='(' + _ONCE + ')')}) t
  LEFT JOIN ({_LINES}) l ON l.artifact = t.artifact AND l.version = t.release_version) WINDOW w AS (PARTITION BY artifact ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_PLACED = f"""SELECT *, CASE WHEN ok THEN dense_rank() OVER (PARTITION BY artifact, ok ORDER BY gr) - 1 END AS matrix_row,
  CASE WHEN ok THEN row_number() OVER (PARTITION BY artifact, ok, gr ORDER BY gc, side, row_pos) - 1 END AS matrix_col FROM (
  SELECT artifact, row_pos, version, outcome, cause, resolution, coalesce(lc, regexp_extract(version, '^v?(\\d+(\\.\\d+)*)', 1)) AS core, coalesce(branch_kind, 'excel-unresolved') AS branch_kind, fork_anchor_version,
    coalesce(r, lb.r, fa.r) AS gr, coalesce(c, lb.c, fa.c) AS gc, CASE WHEN r IS NOT NULL THEN 0 WHEN lb IS NOT NULL THEN 1 ELSE -1 END AS side,
    coalesce(release_date, lb.d, fa.d) AS release_date, coalesce(r, lb.r, fa.r) IS NOT NULL AND resolution <> 'normalized' AS ok FROM ({_NEAR}))"""


def _tasks(spark, sf):
    return tasks_for(b.release_rows(spark, sf))


def _placed(spark, sf):
    h = b.releases(spark, sf)
    return ln.place_untested(b.tested(spark, sf), _lines_of(h, _tasks(spark, sf)))


@query("an9_place_untested", b.with_sql(*TESTED) + f"SELECT artifact, version, row_pos, matrix_row, matrix_col, branch_kind, core, resolution FROM ({_PLACED})")
def an9(spark, sf):
    return _placed(spark, sf).select("artifact", "version", "row_pos", "matrix_row", "matrix_col", "branch_kind", "core", "resolution")


# Some artifacts have no history here, so none of their versions finds a place.
_LISTED = "artifact NOT LIKE '%7'"


@query(
    "an9_still_unresolved",
    b.with_sql(*TESTED).rstrip() + f", listed AS (SELECT * FROM releases WHERE {_LISTED})\nSELECT artifact, version FROM ("
    + re.sub(r"\breleases\b", "listed", _PLACED) + ") WHERE resolution = 'unresolved' AND matrix_row IS NULL",
)
def an9_unresolved(spark, sf):
    h = b.releases(spark, sf).where(_LISTED)
    return ln.still_unresolved(ln.place_untested(b.tested(spark, sf), _lines_of(h, _tasks(spark, sf))))


_CELL = "struct_pack(version, outcome, cause, core, branch_kind, matrix_row, matrix_col)"
_FLIP = """SELECT artifact, comparison_axis, release_lineage, skip AS is_skipped, l.version AS left_version, r.version AS right_version,
  CASE WHEN NOT skip THEN CASE WHEN gone THEN l.version ELSE r.version END END AS appears, CASE WHEN NOT skip THEN o.version END AS not_appears, CASE WHEN NOT skip THEN gone END AS seek_patch,
  CASE WHEN NOT skip THEN o.outcome <> 'BUILD_FAILURE_OTHER' END AS compile, CASE WHEN NOT skip THEN CASE WHEN o.outcome = 'BUILD_FAILURE_OTHER' THEN o.cause ELSE '' END END AS cause,
  l.matrix_row AS left_row, l.matrix_col AS left_col, r.matrix_row AS right_row, r.matrix_col AS right_col FROM (
  SELECT *, l.core = r.core AND l.version <> r.version AND l.branch_kind NOT IN ({exempt}) AND r.branch_kind NOT IN ({exempt}) AS skip,
    l.outcome = 'APPEARS' AND r.outcome <> 'APPEARS' AS gone, l.outcome <> 'APPEARS' AND r.outcome = 'APPEARS' AS came, CASE WHEN l.outcome = 'APPEARS' AND r.outcome <> 'APPEARS' THEN r ELSE l END AS o FROM ({src})) WHERE skip OR gone OR came"""
_AN5 = f"""SELECT artifact, l, r, 'branch' AS comparison_axis, 'branch[' || l.matrix_row || ']' AS release_lineage FROM (
    SELECT artifact, {_CELL} AS l, lead({_CELL}) OVER (PARTITION BY artifact, matrix_row ORDER BY matrix_col) AS r FROM cells) WHERE r IS NOT NULL
  UNION ALL SELECT h.artifact, a.c, h.c, 'fork', 'fork[' || h.fork_anchor_version || '->' || h.c.version || ']' FROM
    (SELECT artifact, fork_anchor_version, {_CELL} AS c FROM cells WHERE matrix_col = 0 AND fork_anchor_version IS NOT NULL) h
    JOIN (SELECT artifact, version, {_CELL} AS c FROM cells) a ON a.artifact = h.artifact AND a.version = h.fork_anchor_version"""
# A row of hotfixes is not compared along itself; its type is that of its first cell.
_AN5_TYPED = _AN5.replace("lead({c}) OVER".format(c=_CELL), "CASE WHEN coalesce(first_value(branch_type) OVER (PARTITION BY artifact, matrix_row ORDER BY matrix_col) <> 'hotfix', true) THEN lead({c}) OVER".format(c=_CELL)).replace(
    "ORDER BY matrix_col) AS r FROM cells)", "ORDER BY matrix_col) END AS r FROM cells)"
)
_PAIR_COLS = ["artifact", "comparison_axis", "release_lineage", "is_skipped", "left_version", "right_version", "appears", "not_appears", "seek_patch", "compile", "cause",
              "left_row", "left_col", "right_row", "right_col"]


@query(
    "an5_boundary_pairs",
    b.with_sql(*TESTED).rstrip() + f", cells AS (SELECT * FROM ({_PLACED}) WHERE matrix_row IS NOT NULL)\n" + _FLIP.format(src=_AN5, exempt="'pre-release', 'hotfix'"),
)
def an5(spark, sf):
    return ln.boundary_pairs(_placed(spark, sf)).select(*_PAIR_COLS)


@query(
    "an5_boundary_pairs_of_lineage",
    _recursive(*TESTED).rstrip()
    + ", cells AS (SELECT * FROM (" + _PLACED.replace(_LINES, "SELECT * FROM lineage").replace("l.fork_anchor_version", "l.fork_anchor_version, l.branch_type").replace("AS branch_kind, fork_anchor_version", "AS branch_kind, branch_type, fork_anchor_version") + ") WHERE matrix_row IS NOT NULL)\n"
    + _FLIP.format(src=_AN5_TYPED, exempt="'pre-release', 'hotfix'"),
)
def an5_lineage(spark, sf):
    h = b.releases(spark, sf)
    return ln.boundary_pairs(ln.place_untested(b.tested(spark, sf), ln.lineage(h, 30.0, _tasks(spark, sf)))).select(*_PAIR_COLS)


_AN6 = f"""SELECT a.artifact, a.c AS l, z.c AS r, 'row' AS comparison_axis, 'row[' || a.c.matrix_row || ']' AS release_lineage FROM (SELECT artifact, {_CELL} AS c FROM cells) a
  JOIN (SELECT artifact, {_CELL} AS c FROM cells) z ON a.artifact = z.artifact AND z.c.matrix_row = a.c.matrix_row AND z.c.matrix_col = a.c.matrix_col + 1
  UNION ALL SELECT a.artifact, a.c, z.c, 'column', 'col[' || a.c.matrix_col || ']' FROM (SELECT artifact, {_CELL} AS c FROM cells) a
  JOIN (SELECT artifact, {_CELL} AS c FROM cells) z ON a.artifact = z.artifact AND z.c.matrix_row = a.c.matrix_row + 1 AND z.c.matrix_col = a.c.matrix_col"""


@query(
    "an6_grid_pairs",
    b.with_sql(*TESTED).rstrip() + f", cells AS (SELECT * FROM ({_PLACED}) WHERE matrix_row IS NOT NULL)\n" + _FLIP.format(src=_AN6, exempt="'pre-release'"),
)
def an6(spark, sf):
    return ln.grid_pairs(_placed(spark, sf)).select(*_PAIR_COLS)


# --- artifacts --------------------------------------------------------------------------------------------


@query(
    "so2_candidate_union",
    """SELECT DISTINCT 'lib-' || (p_partkey % 40) AS library, 'org.g' || (p_partkey % 3) || ':Lib-' || (p_partkey % 40) AS gav FROM part
    UNION SELECT DISTINCT 'lib-' || (s_suppkey % 60), 'org.h:Lib-' || (s_suppkey % 60) FROM supplier""",
)
def so2(spark, sf):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    a = b.table(spark, sf, "part").select(F.concat(F.lit("org.g"), p % 3, F.lit(":Lib-"), p % 40).alias("gav"))
    c = b.table(spark, sf, "supplier").select(F.concat(F.lit(" org.h:Lib-"), s % 60).alias("gav"))
    bad = b.table(spark, sf, "supplier").select(F.col("s_name").alias("gav"))
    return ar.candidate_union(a, c, bad)


@query(
    "ag18_modal_values",
    b.with_sql("chain")
    + """SELECT CVE_ID, Library AS value, count(*) AS n, min(row_pos) AS first_pos, row_number() OVER (PARTITION BY CVE_ID ORDER BY count(*) DESC, min(row_pos)) AS rank FROM chain GROUP BY 1, 2""",
)
def ag18(spark, sf):
    return ar.modal_values(b.chain(spark, sf), "CVE_ID", "Library", "row_pos")


def _artifact_inputs(spark, sf):
    """Customers as issues; suppliers, parts and orders as candidate lists, libraries and histories."""
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    cve = F.concat(F.lit("CVE-"), k).alias("cve")
    g = lambda i, n: F.concat(F.lit(f"org.g{i}:lib-"), k % n)
    row = lambda cond, gav, src, r: c.where(cond).select(cve, gav.alias("gav"), F.lit(src).alias("source"), F.lit(r).alias("source_rank"), F.lit(r).alias("pos"))
    direct = row("k % 2 = 0", g(0, 30), "mvn_test", 0).unionByName(row("k % 3 = 0", g(0, 30), "disclosed", 1)).unionByName(
        row("k % 5 = 0", g(1, 20), "disclosed", 2)
    ).unionByName(row("k % 7 = 0", g(2, 25), "description", 3))
    libs = c.where("k % 4 < 3").select(cve, F.concat(F.lit("lib-"), k % 30).alias("library"), F.lit(0).alias("pos"))
    dis = c.where("k % 5 = 0").select(cve, F.concat(F.lit("Lib-"), k % 20).alias("library"), F.lit(0).alias("pos"))
    p = F.col("p_partkey")
    local = b.table(spark, sf, "part").select(
        F.concat(F.lit("lib-"), p % 40).alias("library"), F.concat(F.lit("org.g"), p % 3, F.lit(":lib-"), p % 40).alias("gav"), F.lit("library_local").alias("source")
    ).distinct()
    o = b.table(spark, sf, "orders")
    ver = F.concat(F.col("o_orderkey") % 3, F.lit("."), F.col("o_orderkey") % 9)
    observed = o.select(F.concat(F.lit("CVE-"), "o_custkey").alias("cve"), ver.alias("version"))
    history = o.select(F.concat(F.lit("org.g"), F.col("o_orderkey") % 3, F.lit(":lib-"), F.col("o_custkey") % 40).alias("gav"), F.concat(F.lit("v"), ver).alias("version")).distinct()
    return c.select(cve), direct, libs, dis, local, observed, history


_JN5 = """
WITH direct AS (SELECT 'CVE-' || c_custkey AS cve, gav, min(r) AS r, arg_min(src, r) AS src FROM (
    SELECT c_custkey, 'org.g0:lib-' || (c_custkey % 30) AS gav, 'mvn_test' AS src, 0 AS r FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'org.g0:lib-' || (c_custkey % 30), 'disclosed', 1 FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'org.g1:lib-' || (c_custkey % 20), 'disclosed', 2 FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'org.g2:lib-' || (c_custkey % 25), 'description', 3 FROM customer WHERE c_custkey % 7 = 0) GROUP BY 1, 2),
own AS (SELECT 'CVE-' || c_custkey AS cve, 'lib-' || (c_custkey % 30) AS lib FROM customer WHERE c_custkey % 4 < 3),
dis AS (SELECT 'CVE-' || c_custkey AS cve, 'lib-' || (c_custkey % 20) AS lib FROM customer WHERE c_custkey % 5 = 0),
facts AS (SELECT c.cve, coalesce(d.n, 0) AS n, coalesce(d.libs, 0) AS libs, d.fg, d.fs, o.lib AS ol, s.lib AS sl,
    CASE WHEN c.k % 3 = 0 AND c.k % 5 = 0 THEN 2 ELSE 1 END AS dn, (o.lib IS NOT NULL AND EXISTS (SELECT 1 FROM direct x WHERE x.cve = c.cve AND split_part(x.gav, ':', 2) <> o.lib)) AS far
  FROM (SELECT 'CVE-' || c_custkey AS cve, c_custkey AS k FROM customer) c
  LEFT JOIN (SELECT cve, count(*) AS n, count(DISTINCT split_part(gav, ':', 2)) AS libs, arg_min(gav, r) AS fg, arg_min(src, r) AS fs FROM direct GROUP BY 1) d ON d.cve = c.cve
  LEFT JOIN own o ON o.cve = c.cve LEFT JOIN dis s ON s.cve = c.cve),
f2 AS (SELECT *, dn > 1 OR libs > 1 OR far AS val, n > 0 AND NOT (dn > 1 OR libs > 1 OR far) AS settled FROM facts),
local AS (SELECT DISTINCT 'lib-' || (p_partkey % 40) AS lib, 'org.g' || (p_partkey % 3) || ':lib-' || (p_partkey % 40) AS gav FROM part),
pool AS (SELECT cve, gav, min(sk) AS sk, arg_min(src, sk) AS src FROM (
    SELECT d.cve, d.gav, struct_pack(a := d.r, z := '') AS sk, d.src FROM direct d JOIN f2 ON f2.cve = d.cve AND NOT f2.settled
    UNION ALL SELECT f2.cve, l.gav, struct_pack(a := 100, z := l.gav), 'library_local' FROM f2 JOIN local l ON l.lib = f2.ol WHERE NOT settled
    UNION ALL SELECT f2.cve, l.gav, struct_pack(a := 101, z := l.gav), 'library_local' FROM f2 JOIN local l ON l.lib = f2.sl WHERE NOT settled) GROUP BY 1, 2),
p2 AS (SELECT p.*, coalesce(split_part(p.gav, ':', 2) = f2.ol, false) AS io, coalesce(split_part(p.gav, ':', 2) IN (f2.ol, f2.sl), false) AS il FROM pool p JOIN f2 ON f2.cve = p.cve),
p3 AS (SELECT *, io OR NOT bool_or(io) OVER (PARTITION BY cve) AS comp, il OR NOT bool_or(il) OVER (PARTITION BY cve) AS fbk FROM p2),
seen AS (SELECT DISTINCT 'CVE-' || o_custkey AS cve, (o_orderkey % 3) || '.' || (o_orderkey % 9) AS v FROM orders),
hist AS (SELECT DISTINCT 'org.g' || (o_orderkey % 3) || ':lib-' || (o_custkey % 40) AS gav, (o_orderkey % 3) || '.' || (o_orderkey % 9) AS v FROM orders),
sc AS (SELECT p3.*, coalesce(h.n, 0) AS hn, coalesce(x.n, 0) AS nn FROM p3 LEFT JOIN (SELECT gav, count(*) AS n FROM hist GROUP BY 1) h ON h.gav = p3.gav
  LEFT JOIN (SELECT s.cve, hist.gav, count(*) AS n FROM seen s JOIN hist ON hist.v = s.v GROUP BY 1, 2) x ON x.cve = p3.cve AND x.gav = p3.gav),
best AS (SELECT cve, count(*) FILTER (comp) AS rivals, arg_max(gav, (nn, hn, gav)) FILTER (comp) AS tg, arg_max(src, (nn, hn, gav)) FILTER (comp) AS ts, max(nn) FILTER (comp) AS tn,
  arg_min(gav, sk) FILTER (fbk) AS fg2, arg_min(src, sk) FILTER (fbk) AS fs2 FROM sc GROUP BY 1),
fin AS (SELECT f2.*, CASE WHEN settled THEN fg WHEN rivals = 1 OR tn > 0 THEN tg ELSE fg2 END AS artifact, CASE WHEN settled THEN fs WHEN rivals = 1 OR tn > 0 THEN ts ELSE fs2 END AS src FROM f2 LEFT JOIN best ON best.cve = f2.cve)
SELECT cve, artifact, coalesce(split_part(artifact, ':', 2), ol, replace(sl, 'lib', 'Lib'), '') AS library,
  CASE WHEN artifact IS NOT NULL THEN src || CASE WHEN val AND NOT settled THEN '_excel_validated' ELSE '' END WHEN coalesce(ol, sl) IS NULL THEN 'missing_library' ELSE 'unresolved' END AS artifact_resolution FROM fin
"""


@query("jn5_resolve_artifact", _JN5)
def jn5(spark, sf):
    return ar.resolve_artifact(*_artifact_inputs(spark, sf))


_HINT_CASES = """SELECT 'case-' || o_orderkey AS case_id, o_orderkey AS k, 'CVE-' || (o_custkey % 200) AS cve, 'V' || (o_orderkey % 4) AS bv, 'V' || (o_orderkey % 5) AS tv, 'lib' || (o_orderkey % 6) AS repo,
  CASE WHEN o_orderkey % 9 = 0 THEN 'org.s:stated' END AS artifact, CASE WHEN o_orderkey % 4 = 0 THEN 'org.c:cause-' || (o_orderkey % 3) END AS cause,
  CASE WHEN o_orderkey % 3 = 0 THEN 'import org.x.lib' || (o_orderkey % 5) || ';' ELSE '' END AS st FROM orders"""
_HINT_DEPS = """SELECT 'case-' || l_orderkey AS case_id, 'org.x:lib' || (l_partkey % 7) AS gav, 'V' || (l_partkey % 6) AS version FROM lineitem WHERE l_returnflag <> 'R'"""
_HINT_LISTED = "SELECT DISTINCT 'CVE-' || (l_suppkey % 150) AS cve, 'org.d:art' || (l_suppkey % 90) AS gav, 'V' || (l_suppkey % 3) AS version FROM lineitem"


@query(
    "jn6_artifact_hints",
    f"""WITH c AS ({_HINT_CASES}), d AS ({_HINT_DEPS}), l AS ({_HINT_LISTED}),
    one AS (SELECT case_id, min(gav) AS v FROM d GROUP BY 1 HAVING count(*) = 1),
    ver AS (SELECT d.case_id, min(gav) AS v FROM d JOIN c ON c.case_id = d.case_id AND d.version IN (c.bv, c.tv) GROUP BY 1 HAVING count(*) = 1),
    s AS (SELECT d.case_id, d.gav, CASE WHEN contains(regexp_replace(lower(st), '[^a-z0-9]', '', 'g'), split_part(gav, ':', 2)) THEN 7 ELSE 0 END AS s FROM d JOIN c ON c.case_id = d.case_id),
    sig AS (SELECT s.case_id, min(gav) AS v FROM s JOIN (SELECT case_id, max(s) AS m FROM s WHERE s > 0 GROUP BY 1) m ON m.case_id = s.case_id AND m.m = s.s GROUP BY 1 HAVING count(*) = 1),
    lv AS (SELECT c.case_id, min(l.gav) AS v FROM c JOIN l ON l.cve = c.cve AND l.version IN (c.bv, c.tv) GROUP BY 1 HAVING count(DISTINCT l.gav) = 1),
    lc AS (SELECT cve, min(gav) AS v FROM l GROUP BY 1 HAVING count(DISTINCT gav) = 1),
    re AS (SELECT d.case_id, min(gav) AS v FROM d JOIN c ON c.case_id = d.case_id AND split_part(d.gav, ':', 2) = c.repo GROUP BY 1 HAVING count(*) = 1),
    rp AS (SELECT d.case_id, min(gav) AS v FROM d JOIN c ON c.case_id = d.case_id AND split_part(d.gav, ':', 2) = c.repo GROUP BY 1 HAVING count(DISTINCT gav) = 1),
    h AS (SELECT c.case_id, c.artifact AS stated, coalesce(one.v, ver.v) AS dependency, sig.v AS signal, coalesce(lv.v, lc.v) AS disclosed, c.cause, coalesce(re.v, rp.v) AS repository FROM c
      LEFT JOIN one ON one.case_id = c.case_id LEFT JOIN ver ON ver.case_id = c.case_id LEFT JOIN sig ON sig.case_id = c.case_id LEFT JOIN lv ON lv.case_id = c.case_id
      LEFT JOIN lc ON lc.cve = c.cve LEFT JOIN re ON re.case_id = c.case_id LEFT JOIN rp ON rp.case_id = c.case_id)
    SELECT case_id, coalesce(stated, dependency, signal, disclosed, cause, repository) AS artifact, CASE WHEN stated IS NOT NULL THEN 'stated' WHEN dependency IS NOT NULL THEN 'dependency'
      WHEN signal IS NOT NULL THEN 'signal' WHEN disclosed IS NOT NULL THEN 'disclosed' WHEN cause IS NOT NULL THEN 'cause' WHEN repository IS NOT NULL THEN 'repository' ELSE 'none' END AS hint FROM h""",
)
def jn6(spark, sf):
    k = F.col("o_orderkey")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    c = b.table(spark, sf, "orders").select(
        j("case-", k).alias("case_id"), j("CVE-", F.col("o_custkey") % 200).alias("cve"), j("V", k % 4).alias("baseline_version"), j("V", k % 5).alias("target_version"),
        j("LIB", k % 6).alias("repo"), F.when(k % 9 == 0, "org.s:stated").alias("artifact"),
        F.when(k % 4 == 0, j("Failure at org.c:cause-", k % 3, ":jar:1.0 (missing)")).alias("cause"),
        F.when(k % 3 == 0, j("import org.x.lib", k % 5, ";")).otherwise("").alias("signal_text"),
    )
    p = F.col("l_partkey")
    li = b.table(spark, sf, "lineitem")
    d = li.select(
        j("case-", F.col("l_orderkey")).alias("case_id"), j("org.x:lib", p % 7).alias("gav"), j("V", p % 6).alias("version"), F.when(F.col("l_returnflag") == "R", "test").alias("scope")
    )
    s = F.col("l_suppkey")
    listed = li.select(j("CVE-", s % 150).alias("cve"), j("org.d:art", s % 90).alias("gav"), j("V", s % 3).alias("version")).distinct()
    return ar.artifact_hints(c, d, listed)


_TAGS = """SELECT 'repo-' || (p_partkey % 40) AS repo, p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN 'v' || v WHEN 1 THEN 'rel_' || replace(v, '.', '_') WHEN 2 THEN 'XSTREAM_' || replace(v, '.', '_') WHEN 3 THEN 'app-' || v || '-final' ELSE v || '.1' END AS tag
  FROM (SELECT p_partkey, (p_partkey % 3) || '.' || (p_partkey % 11) AS v FROM part)"""
_WANTED = "SELECT DISTINCT 'repo-' || (o_custkey % 40) AS repo, CASE WHEN o_orderkey % 50 = 0 THEN 'Unknown' ELSE (o_orderkey % 3) || '.' || (o_orderkey % 11) END AS version FROM orders"
_FORMS = ", ".join(f"'{p}' || version, '{p}' || replace(version, '.', '_')" for p in ar.TAG_PREFIXES)


_JN7 = f"""WITH t AS ({_TAGS}), w AS ({_WANTED}),
    ex AS (SELECT repo, version, arg_min(form, i) AS tag FROM (SELECT repo, version, unnest([{_FORMS}]) AS form, generate_subscripts([{_FORMS}], 1) AS i FROM w WHERE version <> 'Unknown') f
      WHERE EXISTS (SELECT 1 FROM t WHERE t.repo = f.repo AND t.tag = f.form) GROUP BY 1, 2),
    fu AS (SELECT w.repo, w.version, arg_min(t.tag, t.pos) AS tag FROM w JOIN t ON t.repo = w.repo AND (regexp_matches(t.tag, regexp_escape(w.version) || '([^.0-9_]|$)') OR regexp_matches(t.tag, replace(w.version, '.', '_') || '([^.0-9_]|$)'))
      WHERE w.version <> 'Unknown' GROUP BY 1, 2)
    SELECT w.repo, w.version, coalesce(ex.tag, fu.tag, 'unknown') AS tag FROM w LEFT JOIN ex ON ex.repo = w.repo AND ex.version = w.version LEFT JOIN fu ON fu.repo = w.repo AND fu.version = w.version"""


def _matched_tags(spark, sf):
    p = F.col("p_partkey")
    v = F.concat(p % 3, F.lit("."), p % 11)
    u = F.translate(v, ".", "_")
    tag = (
        F.when(p % 5 == 0, F.concat(F.lit("v"), v)).when(p % 5 == 1, F.concat(F.lit("rel_"), u)).when(p % 5 == 2, F.concat(F.lit("XSTREAM_"), u))
        .when(p % 5 == 3, F.concat(F.lit("app-"), v, F.lit("-final"))).otherwise(F.concat(v, F.lit(".1")))
    )
    tags = b.table(spark, sf, "part").select(F.concat(F.lit("repo-"), p % 40).alias("repo"), tag.alias("tag"), p.alias("pos"))
    o = F.col("o_orderkey")
    w = b.table(spark, sf, "orders").select(
        F.concat(F.lit("repo-"), F.col("o_custkey") % 40).alias("repo"),
        F.when(o % 50 == 0, "Unknown").otherwise(F.concat(o % 3, F.lit("."), o % 11)).alias("version"),
    )
    return ar.match_tag(w, tags)


@query("jn7_match_tag", _JN7)
def jn7(spark, sf):
    return _matched_tags(spark, sf)


@query(
    "jn7_compare_url",
    f"""WITH m AS ({_JN7}), a AS (SELECT *, lag(tag) OVER (PARTITION BY repo ORDER BY version) AS base, CASE WHEN repo = 'repo-7' THEN 'unknown' ELSE 'owner-' || repo END AS owner FROM m)
    SELECT repo, base, tag AS head, CASE WHEN base <> 'unknown' AND tag <> 'unknown' AND owner <> 'unknown' THEN 'https://github.com/' || owner || '/' || repo || '/compare/' || base || '...' || tag
      ELSE 'unknown' END AS url FROM a WHERE base IS NOT NULL""",
)
def jn7_url(spark, sf):
    from pyspark.sql import Window

    base = F.lag("tag").over(Window.partitionBy("repo").orderBy("version"))
    owner = F.when(F.col("repo") == "repo-7", "unknown").otherwise(F.concat(F.lit("owner-"), "repo"))
    d = _matched_tags(spark, sf).withColumn("base", base).where("base IS NOT NULL")
    return d.select("repo", "base", F.col("tag").alias("head"), ar.compare_url(owner, F.col("repo"), F.col("base"), F.col("tag")).alias("url"))


_PACKAGES = """SELECT DISTINCT 'case-' || l_suppkey AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'org.p' || (l_partkey % 9) WHEN 1 THEN 'org.p' || (l_partkey % 9) || '.a' || (l_partkey % 4) ELSE 'org.p' || (l_partkey % 9) || '.a' || (l_partkey % 4) || '.b' END AS package
  FROM lineitem"""


@query(
    "jn19_minimal_prefixes",
    f"""WITH p AS ({_PACKAGES}) SELECT case_id, package, len(string_split(package, '.')) - 1 AS depth, replace(package, '.', '/') || '/' AS slash_form FROM p
    WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.case_id = p.case_id AND starts_with(p.package, q.package || '.'))""",
)
def jn19(spark, sf):
    p = F.col("l_partkey")
    root = F.concat(F.lit("org.p"), p % 9)
    mid = F.concat(root, F.lit(".a"), p % 4)
    m = F.col("l_linenumber") % 3
    # A package comes from the imported name of a class in it.
    name = F.when(m == 0, root).when(m == 1, mid).otherwise(F.concat(mid, F.lit(".b")))
    # A case imports a class in many rows; its package is worked out once.
    imports = b.table(spark, sf, "lineitem").select("l_suppkey", F.concat(name, F.lit(".Type")).alias("name")).distinct()
    d = imports.select(F.concat(F.lit("case-"), "l_suppkey").alias("case_id"), ar.package_of_import(F.col("name")).alias("package"))
    return ar.minimal_prefixes(d)


@query(
    "jn19_packages_of_artifact",
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN 'jodd.http' WHEN p_partkey % 7 = 0 THEN 'org.foo' || (p_partkey % 5)
    ELSE 'org.g' || (p_partkey % 5) || '.my.x' || (p_partkey % 3) END AS packages FROM part""",
)
def jn19_packages(spark, sf):
    k = F.col("p_partkey")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    gav = F.when(k % 13 == 0, "no-colon").when(k % 11 == 0, " org.jodd:jodd-http").when(k % 7 == 0, j("org.foo", k % 5, ":foo-", k % 5)).otherwise(j("org.g", k % 5, ":my-lib_x", k % 3, ".core"))
    return b.table(spark, sf, "part").select(k.alias("k"), F.array_join(ar.packages_of_artifact(gav), ",").alias("packages"))


@query("so2_description_candidates", "SELECT 'CVE-' || c_custkey AS cve, 'org.x:lib' || (c_custkey % 9) AS gav FROM customer WHERE c_custkey % 3 = 0")
def so2_described(spark, sf):
    k = F.col("c_custkey")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    said = F.when(k % 3 == 0, j("A flaw in Package org.x:lib", k % 9, ", found late")).when(k % 3 == 1, "in package nothing here")
    return ar.description_candidates(b.table(spark, sf, "customer").select(j("CVE-", k).alias("cve"), said.alias("description")))
