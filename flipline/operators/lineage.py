"""Release histories: branches, version placement and the version pairs where an outcome flips.

Groups are artifacts. A history holds each version once (``release_history`` enforces it), so the rows of one
artifact are bounded by its number of published versions, however often a version is tested or mentioned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipline.functions.labels import outcome_compiled, outcome_failure, outcome_success
from flipline.functions.text import clean_text
from flipline.functions.versions import normalize_version, with_version_parts
from flipline.operators.scans import first_of, nearest, over, tasks_for

# Branch labels and windows.
UNPLACED = "excel-unresolved"
HOTFIX_DAYS = 1.0
FORK_WINDOW_DAYS = 1.0
DAY_MICROS = 86400.0 * 1e6


def release_history(df: DataFrame, artifact: str = "artifact", version: str = "version", date: str = "release_date") -> DataFrame:
    """First release of every (artifact, version) with all parsed version parts."""
    rows = df.select(F.col(artifact).alias("artifact"), clean_text(version).alias("version"), F.col(date).cast("timestamp").alias("release_date"))
    rows = rows.where((F.col("version") != "") & F.col("release_date").isNotNull())
    rows = rows.repartition(tasks_for(df), "artifact", "version")
    return with_version_parts(rows.groupBy("artifact", "version").agg(F.min("release_date").alias("release_date")))


def days(c: Column) -> Column:
    """Seconds of a timestamp as fractional days."""
    return F.unix_micros(c) / F.lit(DAY_MICROS)


def resolve_version(tested: DataFrame, history: DataFrame) -> DataFrame:
    """Release a tested version stands for: the same text, else the only release with the same normal form."""
    h = history.select("artifact", F.col("version").alias("release_version"), "release_date")
    exact = h.withColumn("version", F.col("release_version"))
    unique = (
        h.groupBy("artifact", normalize_version("release_version").alias("__norm"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("release_version", "release_date")).alias("__only"))
        .where("__n = 1")
        .select("artifact", "__norm", "__only")
    )
    d = tested.withColumns({"version": clean_text("version"), "__norm": normalize_version("version")})
    d = d.join(exact, ["artifact", "version"], "left").join(unique, ["artifact", "__norm"], "left")
    found = F.col("release_version").isNotNull()
    return d.withColumns(
        {
            "resolution": F.when(found, "exact").when(F.col("__only").isNotNull(), "normalized").otherwise("unresolved"),
            "release_version": F.coalesce("release_version", "__only.release_version"),
            "release_date": F.when(found, F.col("release_date")).otherwise(F.col("__only.release_date")),
        }
    ).drop("__norm", "__only")


def hotfix_candidates(history: DataFrame, window_days: float = HOTFIX_DAYS) -> DataFrame:
    """Latest earlier release of the same core, at most ``window_days`` older and lower in version order.

    The releases of a core pass in time order over a pile of those that may still be the latest lower one of a later
    release: a release first takes away all that are higher than itself. What lies on top then is its candidate, so each
    is laid down and taken away once. Spark ranks, deals by core once, and sorts; tasks stream their rows and hold one pile.
    """
    e = history.where(F.col("core") != "").select(
        "artifact",
        "core",
        "version",
        F.unix_micros("release_date").alias("at"),
        F.row_number().over(Window.partitionBy("artifact", "core").orderBy("order_key")).alias("rank"),
    )

    def pile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, []
        for batch in batches:
            out = []
            for artifact, core, version, at, rank in batch.itertuples(index=False, name=None):
                if group != (artifact, core):
                    group, held = (artifact, core), []
                while held and held[-1][0] > rank:
                    held.pop()
                if held and at / DAY_MICROS - held[-1][1] / DAY_MICROS <= window_days:
                    out.append((artifact, version, held[-1][2], held[-1][1]))
                held.append((rank, at, version))
            yield pd.DataFrame(out, columns=["artifact", "version", "anchor_version", "at"])

    found = e.sortWithinPartitions("artifact", "core", "at", "rank").mapInPandas(pile, "artifact string, version string, anchor_version string, at long")
    return found.withColumn("anchor_date", F.timestamp_micros("at")).drop("at")


# --- branches in release order ----------------------------------------------------------------------------

LINEAGE_SCHEMA = (
    "artifact string, version string, release_date timestamp, core string, matrix_row int, matrix_col int, "
    "branch_key string, branch_kind string, branch_family string, branch_type string, branch_depth int, "
    "line_key string, parent_branch_key string, parent_branch_row int, fork_anchor_version string, "
    "fork_anchor_release_date timestamp"
)


class _Latest:
    """The latest member of a set of releases in a range of ranks: maxima of times over the ranks in order.

    ``ranks`` are all that may ever be put in. A time is the release's place in time order, -1 for none.
    """

    def __init__(self, ranks: list[int]):
        self.ranks = sorted(ranks)
        self.size = 1 << (len(ranks) - 1).bit_length()
        self.most = [-1] * (2 * self.size)

    def put(self, rank: int, time: int) -> None:
        most, i = self.most, bisect_left(self.ranks, rank) + self.size
        most[i] = time
        while i > 1:
            i >>= 1
            most[i] = max(most[2 * i], most[2 * i + 1])

    def between(self, low: int, high: int) -> int:
        """The latest time put in for a rank from ``low`` to below ``high``."""
        most, found = self.most, -1
        a, b = bisect_left(self.ranks, low) + self.size, bisect_left(self.ranks, high) + self.size
        while a < b:
            if a & 1:
                found = max(found, most[a])
                a += 1
            if b & 1:
                b -= 1
                found = max(found, most[b])
            a >>= 1
            b >>= 1
        return found


class _Index:
    """For every key the latest release in a range of ranks; ``keys`` names the key of each rank."""

    def __init__(self, keys: Iterable[tuple[object, int]]):
        self.ranks: dict[object, list[int]] = {}
        for key, rank in keys:
            self.ranks.setdefault(key, []).append(rank)
        self.sets: dict[object, _Latest] = {}

    def put(self, key: object, rank: int, time: int) -> bool:
        """Put a release in; whether it is the first of its key."""
        new = key not in self.sets
        if new:
            self.sets[key] = _Latest(self.ranks[key])
        self.sets[key].put(rank, time)
        return new

    def between(self, key: object, low: int, high: int) -> int:
        return self.sets[key].between(low, high) if key in self.sets else -1


class _Majors:
    """Releases by major number, for the nearest lower one."""

    def __init__(self, majors: list[tuple[int, int]]):
        self.by_major = _Index(majors)
        self.every = _Index((None, rank) for _, rank in majors)
        self.present: list[int] = []

    def put(self, major: int, rank: int, time: int) -> None:
        self.every.put(None, rank, time)
        if self.by_major.put(major, rank, time) and major >= 0:
            insort(self.present, major)

    def nearest(self, major: int, ranges: list[tuple[int, int]]) -> int:
        """The latest release in the ranges with the highest major number up to ``major``, else the latest in them."""
        for m in reversed(self.present[: bisect_right(self.present, major)]):
            found = max(self.by_major.between(m, *r) for r in ranges)
            if found >= 0:
                return found
        return max(self.every.between(None, *r) for r in ranges)


class _History:
    """Assigns the releases of one artifact, in time order, to branches.

    ``rows`` are tuples (artifact, version, release_date, core, branch_kind, line_key, day, major, key_rank) in time
    order. Version order is the integer rank Spark computed, so every comparison here is one of integers. Earlier
    releases are found by core, by line and by major number in trees over their ranks, so that a release costs a few
    searches of logarithmic depth, however many were there before.
    """

    def __init__(self, rows: list[tuple], fork_days: float):
        self.rows = rows
        self.fork_days = fork_days
        self.kind = [r[4] for r in rows]
        self.row_of: list[int] = []
        self.branches: list[dict] = []
        cores = [(r[3], r[8]) for r in rows if r[3]]
        self.of_core, self.no_hotfix = _Index(cores), _Index(cores)
        self.core_branch: dict[str, int] = {}
        self.tails = _Index((r[5], r[8]) for r in rows)
        majors = [(r[7], r[8]) for r in rows]
        self.majors, self.stable_majors = _Majors(majors), _Majors(majors)
        #: Per line the ranges of ranks it fills; one, unless numbers are beyond a long.
        self.runs: dict[str, list[list[int]]] = {}
        for r in sorted(rows, key=lambda r: r[8]):
            runs = self.runs.setdefault(r[5], [])
            if runs and runs[-1][1] == r[8]:
                runs[-1][1] += 1
            else:
                runs.append([r[8], r[8] + 1])

    def latest(self, i: int, max_age: float, index: _Index) -> int | None:
        """Latest lower release of the same core, the higher version on ties, if it is young enough."""
        j = index.between(self.rows[i][3], 0, self.rows[i][8])
        return j if j >= 0 and self.rows[i][6] - self.rows[j][6] <= max_age else None

    def nearest_major(self, i: int, other_stable_line: bool) -> int | None:
        """Lower release with the smallest step in the major number, the latest of these."""
        line, major, rank = self.rows[i][5], self.rows[i][7], self.rows[i][8]
        ranges, low = [], 0
        for start, end in self.runs[line] if other_stable_line else ():
            if start < rank:
                ranges.append((low, start))
                low = end
        if low < rank:
            ranges.append((low, rank))
        majors = self.stable_majors if other_stable_line else self.majors
        j = majors.nearest(major, ranges) if ranges else -1
        return j if j >= 0 else None

    def open(self, i: int, kind: str, family: str, anchor: int | None, label: str) -> int:
        row = len(self.branches)
        parent = None if anchor is None else self.row_of[anchor]
        key = "main" if kind == "main" else f"{kind}@{label or 'unknown'}#{row}"
        depth = 0 if parent is None else self.branches[parent]["depth"] + 1
        self.branches.append(
            {"key": key, "family": family, "type": kind, "line": self.rows[i][5], "parent": parent, "anchor": anchor,
             "depth": depth, "tail": None, "size": 0}
        )
        return row

    def choose(self, i: int) -> int:
        if not self.branches:
            return self.open(i, "main", "main", None, "")
        core, line, rank = self.rows[i][3], self.rows[i][5], self.rows[i][8]
        fix = self.latest(i, HOTFIX_DAYS, self.no_hotfix) if core else None
        if fix is not None:
            self.kind[i] = "hotfix"
            return self.open(i, "hotfix", f"hotfix-{line}", fix, core or line)
        own = self.tails.between(line, 0, rank + 1)
        if own >= 0:
            return self.row_of[own]
        if self.kind[i] == "stable":
            prior = self.nearest_major(i, True)
            if prior is not None:
                return self.open(i, "line", f"line-{line}", prior, line)
        if core and self.kind[i] in ("runtime-fork", "suffix-fork"):
            base = self.latest(i, self.fork_days, self.of_core)
            if base is not None:
                row = self.core_branch.get(core)
                if row is None or self.rows[self.branches[row]["tail"]][8] > rank:
                    row = self.core_branch[core] = self.open(i, "same-core", f"core-{core}", base, core)
                return row
        return self.open(i, "line", f"line-{line}", self.nearest_major(i, False), line)

    def place(self, i: int, row: int) -> None:
        """Make release ``i`` the tail of a branch, and findable for later releases."""
        _, _, _, core, _, line, _, major, rank = self.rows[i]
        b = self.branches[row]
        self.row_of.append(row)
        if b["type"] in ("main", "line"):
            if b["tail"] is not None:
                self.tails.put(line, self.rows[b["tail"]][8], -1)
            self.tails.put(line, rank, i)
        if core:
            self.of_core.put(core, rank, i)
            if self.kind[i] != "hotfix":
                self.no_hotfix.put(core, rank, i)
        self.majors.put(major, rank, i)
        if self.kind[i] == "stable":
            self.stable_majors.put(major, rank, i)
        b["tail"], b["size"] = i, b["size"] + 1

    def run(self) -> list[tuple]:
        out = []
        for i, (artifact, version, date, core, *_) in enumerate(self.rows):
            row = self.choose(i)
            b = self.branches[row]
            col = b["size"]
            self.place(i, row)
            parent, anchor = b["parent"], b["anchor"]
            fork = (None, None) if anchor is None else self.rows[anchor][1:3]
            up = None if parent is None else self.branches[parent]["key"]
            out.append(
                (artifact, version, date, core, row, col, b["key"], self.kind[i], b["family"], b["type"], b["depth"],
                 b["line"], up, parent, *fork)
            )
        return out


def lineage(history: DataFrame, fork_days: float = FORK_WINDOW_DAYS, tasks: int | None = None) -> DataFrame:
    """Branch, position and fork anchor of every release.

    Each step depends on the branches made by the steps before it, so the versions of an artifact are folded in time
    order. Spark parses, ranks, partitions and sorts; tasks then stream their sorted rows through the fold and hold
    one artifact's distinct versions at a time. With ``tasks`` artifacts are dealt over so many (``scans.tasks_for``).
    """
    if tasks:
        history = history.repartition(tasks, "artifact")
    ranked = history.select(
        "artifact",
        "version",
        "release_date",
        "core",
        "branch_kind",
        "line_key",
        days(F.col("release_date")).alias("day"),
        F.coalesce(F.get("semver", F.lit(0)), F.lit(-1)).alias("major"),
        F.row_number().over(Window.partitionBy("artifact").orderBy("order_key")).cast("bigint").alias("key_rank"),
    )
    # The window has already brought each artifact into one partition; sorting keeps it there.
    names = [f.split()[0] for f in LINEAGE_SCHEMA.split(", ")]
    schema = LINEAGE_SCHEMA

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(rows: list[tuple]) -> pd.DataFrame:
            d = pd.DataFrame(rows, columns=names)
            d["parent_branch_row"] = d["parent_branch_row"].astype("Int32")
            d["fork_anchor_release_date"] = pd.to_datetime(d["fork_anchor_release_date"])
            return d

        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out.extend(_History(held, fork_days).run())
                    held = []
                held.append(row)
            if out:
                yield table(out)
        if held:
            yield table(_History(held, fork_days).run())

    return ranked.sortWithinPartitions("artifact", "day", "key_rank").mapInPandas(fold, schema)


def version_tree(cells: DataFrame) -> DataFrame:
    """One row per branch with its versions in order."""
    order = F.struct("matrix_col", "version", "branch_kind", "release_date")
    keep = ["branch_key", "branch_family", "branch_type", "branch_depth", "line_key", "parent_branch_key",
            "parent_branch_row", "fork_anchor_version", "fork_anchor_release_date"]
    return cells.groupBy("artifact", "matrix_row").agg(
        *[F.min_by(c, "matrix_col").alias(c) for c in keep],
        F.sort_array(F.collect_list(order)).alias("versions"),
    )


# --- main line with backports -----------------------------------------------------------------------------


def _before_and_after(rows: DataFrame) -> DataFrame:
    """Add the main releases around each row in time, on its line and on any line, and the last one of its core.

    ``rows`` hold main releases, with their struct (date, version, row) in ``hit``, and others, where it is null. All
    lookups are windows inside an artifact; of main releases of one date the first by name comes nearest after.
    """
    main = F.col("hit").isNotNull()
    by = lambda *keys: Window.partitionBy("artifact", *keys)
    first = lambda *keys: F.when(main, F.min(F.when(main, F.struct("version", "hit"))).over(by(*keys, "release_date"))["hit"])
    rows = rows.withColumns({"near": first(), "near_line": first("line_key"), "side": (~main).cast("int")})
    order = "release_date, side, semver, version"

    def look(fn: str, arg: str, part: str) -> Column:
        return F.expr(f"{fn}({arg}) IGNORE NULLS OVER (PARTITION BY {part} ORDER BY {order})")

    latest = F.max(F.when(main & (F.col("core") != ""), F.struct("release_date", "semver", "version", "hit"))).over(by("core"))
    return rows.withColumns(
        {
            "line_before": look("lag", "hit", "artifact, line_key"),
            "line_after": look("lead", "near_line", "artifact, line_key"),
            "any_before": look("lag", "hit", "artifact"),
            "any_after": look("lead", "near", "artifact"),
            "same_core": F.when(F.col("core") != "", latest["hit"]),
        }
    ).drop("near", "near_line", "side")


def _anchor(window_days: float) -> Column:
    """The choice among the main releases around a fork."""
    near = lambda c: F.abs(days(F.col(f"{c}.date")) - days(F.col("release_date"))) <= window_days
    return F.coalesce(
        F.col("line_before"),
        F.col("any_before"),
        F.when(near("line_after"), F.col("line_after")),
        F.when(near("same_core"), F.col("same_core")),
        F.when(near("any_after"), F.col("any_after")),
        F.col("same_core"),
    )


def fork_anchor_asof(forks: DataFrame, main: DataFrame, window_days: float = FORK_WINDOW_DAYS) -> DataFrame:
    """Main release a fork grew from.

    In this order: latest main release on the same line up to the fork's date, latest on any line, nearest later
    one on the same line inside the window, the same core inside the window, nearest later one on any line inside
    the window, the same core at any time. As-of lookups are windows over the union of both sides, dealt by artifact once.
    """
    fields = ["artifact", "line_key", "release_date", "semver", "version", "core"]
    none = F.lit(None).cast("string")
    hit = F.struct(F.col("release_date").alias("date"), "version", F.lit(None).cast("int").alias("row"))
    left = main.select(*fields, hit.alias("hit"), none.alias("fork_key"), none.alias("base_version"))
    right = forks.select(*fields, F.lit(None).cast("struct<date:timestamp,version:string,row:int>").alias("hit"), "fork_key", "base_version")
    both = _before_and_after(left.unionByName(right).repartition("artifact"))
    return both.where(F.col("hit").isNull()).withColumn("__a", _anchor(window_days)).select(
        "artifact", "fork_key", F.col("__a.version").alias("anchor_version"), F.col("__a.date").alias("anchor_date"), "base_version"
    )


def main_line(history: DataFrame, window_days: float = FORK_WINDOW_DAYS) -> DataFrame:
    """Ragged grid of releases: the main line runs down column 0, branches run right from their anchor row.

    A stable release is on the main line when no earlier stable release has higher numbers; other stable ones
    are backports of their line; suffixed ones form forks. Branches without an anchor get rows at the end.
    The history is dealt by artifact once; all else are windows inside an artifact, so it is read once.
    """
    kind, port = F.col("branch_kind"), F.col("branch_kind") == "stable"
    by = lambda *keys: Window.partitionBy("artifact", *keys)
    in_time = ["release_date", "semver", "version"]
    by_time = by().orderBy(*in_time)
    top = F.max(F.when(port, F.col("semver"))).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    d = history.repartition("artifact").withColumn("__top", top)
    d = d.withColumn("is_main", port & F.coalesce(F.col("semver") >= F.col("__top"), F.lit(True)))
    d = d.withColumn("__row", (F.count_if("is_main").over(by_time) - 1).cast("int"))
    d = d.withColumn("hit", F.when(F.col("is_main"), F.struct(F.col("release_date").alias("date"), "version", F.col("__row").alias("row"))))
    d = _before_and_after(d)

    # Backports: anchor is the last main release of the line before the first backport, else the last of the line.
    line_last = F.max(F.when(F.col("is_main"), F.struct(*in_time, "hit"))).over(by("line_key"))["hit"]
    fork_key = (
        F.when(port, F.concat(F.lit("stable@"), F.col("line_key")))
        .when(kind == "pre-release", F.concat(F.lit("fork@"), F.col("base_version"), F.lit("#pre")))
        .when(kind == "runtime-fork", F.concat(F.lit("fork@"), F.col("line_key"), F.lit("#"), F.col("suffix_family")))
        .otherwise(F.concat(F.lit("fork@"), F.col("base_version"), F.lit("#"), F.col("suffix_family")))
    )
    d = d.withColumns(
        {
            "__line_last": line_last,
            "branch_key": F.when(F.col("is_main"), "main").otherwise(fork_key),
            "branch_family": F.when(F.col("is_main"), "main").when(port, "stable-line").when(kind == "pre-release", "pre-release").otherwise(F.col("suffix_family")),
            "branch_kind": F.when(port & ~F.col("is_main"), "stable-backport").otherwise(kind),
        }
    )
    backport = F.col("branch_kind") == "stable-backport"
    d = d.withColumn("__pick", F.when(backport, F.coalesce("line_before", "__line_last")).otherwise(_anchor(window_days)))

    # A branch hangs where its first release does.
    inside = by("branch_key").orderBy("release_date", "semver", "suffix_key", "version")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns(
        {
            "__a": F.first("__pick").over(whole),
            "__base": F.first("base_version").over(whole),
            "__first": F.min("release_date").over(whole),
            "__port": F.first(backport).over(whole),
            "__i": F.row_number().over(inside) - 1,
            "__mains": F.count_if("is_main").over(by()),
        }
    )
    # Releases of a branch are peers here, so ranks count the releases, and dense ranks the branches, before it.
    detached = F.col("__a").isNull()
    tail = by("is_main", detached).orderBy("__first", "branch_key")
    d = d.withColumn("__at", F.when(detached, F.col("__mains") + F.dense_rank().over(tail) - 1).otherwise(F.col("__a.row")))
    grid = by("is_main", "__at").orderBy(F.when(F.col("__port"), 0).otherwise(1), "__first", "branch_key")
    side = lambda c: F.when(~F.col("is_main"), c)
    return d.withColumns({"__order": F.dense_rank().over(grid), "__start": F.rank().over(grid)}).select(
        "artifact",
        F.when(F.col("is_main"), F.col("__row")).otherwise(F.col("__at")).cast("int").alias("matrix_row"),
        F.when(F.col("is_main"), 0).otherwise(F.col("__start") + F.col("__i")).cast("int").alias("matrix_col"),
        "branch_key",
        "branch_kind",
        "branch_family",
        "version",
        "release_date",
        side(F.coalesce("__a.version", "__base")).alias("fork_anchor_version"),
        side(F.col("__order")).cast("int").alias("fork_order"),
    )


def branch_summary(cells: DataFrame) -> DataFrame:
    """Extent and anchor of every branch of a grid."""
    return cells.groupBy("artifact", "branch_key").agg(
        F.first("branch_family").alias("branch_family"),
        F.first("branch_kind").alias("branch_kind"),
        (F.first("branch_key") != "main").alias("is_fork_branch"),
        F.min("fork_anchor_version").alias("fork_anchor_version"),
        F.min("matrix_row").alias("first_row"),
        F.min("matrix_col").alias("start_col"),
        F.max("matrix_col").alias("end_col"),
        F.count(F.lit(1)).alias("versions"),
    )


# --- tested versions on the grid --------------------------------------------------------------------------


def _resolved(once: DataFrame, cells: DataFrame, history: DataFrame | None, tasks: int) -> DataFrame:
    """Tested versions with the release they stand for, as :func:`resolve_version`, and its cell (``__r`` and so on).

    Both sides have a version of an artifact once, so they are dealt by artifact and meet in windows, not in joins.
    """
    cell = ["core", "branch_key", "branch_family", "branch_kind", "branch_type", "fork_anchor_version"]
    spots = cells.select("artifact", "version", "release_date", F.struct(F.col("matrix_row").alias("__r"), F.col("matrix_col").alias("__c"), *cell).alias("cell"))
    if history is not None:
        spots = history.select("artifact", "version", "release_date").join(spots.drop("release_date"), ["artifact", "version"], "left")
    release = F.struct(F.col("version").alias("release_version"), "release_date", "cell").alias("release")
    both = once.unionByName(spots.select("artifact", "version", release), allowMissingColumns=True).repartition(tasks, "artifact")
    both = both.withColumn("__norm", normalize_version("version"))
    by = lambda key: Window.partitionBy("artifact", key)
    both = both.withColumns(
        {
            "__exact": F.first("release", True).over(by("version")),
            "__only": F.when(F.count("release").over(by("__norm")) == 1, F.first("release", True).over(by("__norm"))),
        }
    ).where(F.col("release").isNull())
    return both.withColumns(
        {
            "resolution": F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__only").isNotNull(), "normalized").otherwise("unresolved"),
            "release": F.coalesce("__exact", "__only"),
        }
    ).select(*once.columns, "resolution", "release.release_version", "release.release_date", "release.cell.*")


def place_untested(
    tested: DataFrame, cells: DataFrame, history: DataFrame | None = None, pos: str = "row_pos", block_rows: int | None = None
) -> DataFrame:
    """Put tested versions on the branch grid and keep only tested cells, re-indexed.

    A version without a release goes right behind the tested version before it in table order; those before any
    placed version go in front of the first placed one. Where a version is placed stays a sort key (anchor cell,
    side, table position), so no cell is ever shifted. Versions resolved only by their normal form serve as
    anchors but own no cell. Rows that cannot be placed keep a null ``matrix_row``. ``history`` is needed only if it
    has releases that have no cell. Each version of an artifact counts once, so windows run over artifacts; with
    ``block_rows`` the look around a row runs over blocks of table positions instead. Rows are dealt over tasks by their number.
    """
    tasks = tasks_for(tested)
    dealt = tested.withColumn("version", clean_text("version")).repartition(tasks, "artifact", "version")
    once = first_of(dealt, ["artifact", "version"], pos)
    for c in ("branch_type", "core"):
        if c not in cells.columns:
            cells = cells.withColumn(c, F.lit(None).cast("string"))
    rows = _resolved(once, cells, history, tasks)
    here = F.when(
        F.col("__r").isNotNull(),
        F.struct(
            F.col("__r").alias("r"), F.col("__c").alias("c"), F.col("version").alias("v"),
            F.col("branch_family").alias("f"), F.col("release_date").alias("d"),
        ),
    )
    if block_rows is None:
        rows = rows.withColumns({"__here": here, "__self": F.struct("version")})
        looks = {"__b": over("lag", "__here", ["artifact"], pos), "__prev": over("lag", "__self", ["artifact"], pos)}
        rows = rows.withColumns(looks | {"__a": over("lead", "__here", ["artifact"], pos)}).drop("__here", "__self")
    else:
        rows = nearest(rows, "artifact", pos, {"__b": here, "__prev": F.struct("version")}, {"__a": here}, block_rows)
    placed = F.col("__r").isNotNull()
    anchor = F.coalesce(F.col("__b"), F.col("__a"))
    suffix = F.col("__b").isNotNull()
    name = F.when(suffix, F.concat(F.lit(f"{UNPLACED}@"), F.col("__prev.version"))).otherwise(
        F.concat(F.lit(f"{UNPLACED}@prefix:"), F.col("__a.v"))
    )
    rows = rows.withColumns(
        {
            "__row": F.when(placed, F.col("__r")).otherwise(anchor["r"]),
            "__col": F.when(placed, F.col("__c")).otherwise(anchor["c"]),
            "__side": F.when(placed, 0).when(suffix, 1).otherwise(-1),
            "release_date": F.when(placed, F.col("release_date")).otherwise(anchor["d"]),
            "core": F.coalesce(F.col("core"), normalize_version("version")),
            "branch_key": F.when(placed, F.col("branch_key")).otherwise(F.when(anchor.isNotNull(), name).otherwise(UNPLACED)),
            "branch_family": F.when(placed, F.col("branch_family")).otherwise(F.coalesce(anchor["f"], F.lit(UNPLACED))),
            "branch_kind": F.coalesce(F.col("branch_kind"), F.lit(UNPLACED)),
        }
    )
    on_grid = F.col("__row").isNotNull() & (F.col("resolution") != "normalized")
    by_row = Window.partitionBy("artifact", on_grid).orderBy("__row")
    by_col = Window.partitionBy("artifact", on_grid, "__row").orderBy("__col", "__side", pos)
    rows = rows.withColumns(
        {
            "matrix_row": F.when(on_grid, F.dense_rank().over(by_row) - 1),
            "matrix_col": F.when(on_grid, F.row_number().over(by_col) - 1),
        }
    )
    return rows.drop("__r", "__c", "__b", "__a", "__prev", "__row", "__col", "__side")


def still_unresolved(placed: DataFrame) -> DataFrame:
    return placed.where((F.col("resolution") == "unresolved") & F.col("matrix_row").isNull()).select("artifact", "version")


_SIDE = ["version", "outcome", "cause", "core", "branch_kind", "release_date", "matrix_row", "matrix_col"]


def _pairs(rows: DataFrame, exempt: list[str], keys: list[str], increasing_basis: str) -> DataFrame:
    """Turn neighbour structs ``l`` and ``r`` into version pairs or skipped pairs."""
    l, r = F.col("l"), F.col("r")
    same = (
        (l["version"] != r["version"])
        & l["core"].eqNullSafe(r["core"])
        & ~(l["branch_kind"].isin(*exempt) | r["branch_kind"].isin(*exempt))
    )
    gone = outcome_success(l["outcome"]) & outcome_failure(r["outcome"])
    came = outcome_failure(l["outcome"]) & outcome_success(r["outcome"])
    other = F.when(gone, r).otherwise(l)
    compiled = outcome_compiled(other["outcome"])
    d = rows.withColumns({"is_skipped": F.coalesce(same, F.lit(False)), "__flip": gone | came})
    d = d.where(F.col("is_skipped") | F.col("__flip"))
    val = lambda c: F.when(~F.col("is_skipped"), c)
    return d.select(
        *keys,
        "comparison_axis",
        "release_lineage",
        "is_skipped",
        l["version"].alias("left_version"),
        r["version"].alias("right_version"),
        val(F.when(gone, l["version"]).otherwise(r["version"])).alias("appears"),
        val(other["version"]).alias("not_appears"),
        val(gone).alias("seek_patch"),
        val(compiled).alias("compile"),
        val(F.when(compiled, "").otherwise(F.coalesce(other["cause"], F.lit("")))).alias("cause"),
        val(F.lit(increasing_basis)).alias("ordering_basis"),
        l["release_date"].alias("baseline_release_date"),
        r["release_date"].alias("target_release_date"),
        l["matrix_row"].alias("left_row"),
        l["matrix_col"].alias("left_col"),
        r["matrix_row"].alias("right_row"),
        r["matrix_col"].alias("right_col"),
    )


def boundary_pairs(placed: DataFrame, key: str = "artifact") -> DataFrame:
    """Neighbours along a branch and fork anchors with their branch head, where the outcome flips.

    Expects :func:`place_untested` output with columns ``outcome`` and ``cause``. Neighbours of one core are
    reported as skipped unless one is a pre-release or a hotfix. A version has one cell, so anchors are found in one
    window over (artifact, version), which holds the cell of the version and the heads of the branches that fork there.
    """
    cells = placed.where(F.col("matrix_row").isNotNull())
    me = F.struct(*_SIDE)
    along = Window.partitionBy(key, "matrix_row").orderBy("matrix_col")
    d = cells.withColumns({"l": me, "__next": F.lead(me).over(along), "__type": F.first("branch_type").over(along)})
    is_head = (F.col("matrix_col") == 0) & F.col("fork_anchor_version").isNotNull()
    roles = F.array(
        F.struct(F.col("version").alias("__v"), F.lit(False).alias("__head")),
        F.when(is_head, F.struct(F.col("fork_anchor_version").alias("__v"), F.lit(True).alias("__head"))),
    )
    d = d.select(key, "l", "__next", "__type", F.inline(F.filter(roles, lambda x: x.isNotNull())))
    head, hotfix = F.col("__head"), F.coalesce(F.col("__type") == "hotfix", F.lit(False))
    anchor = F.first(F.when(~head, F.col("l")), True).over(Window.partitionBy(key, "__v"))
    pairs = d.withColumn("__anchor", anchor).select(
        key,
        F.when(head, F.col("__anchor")).otherwise(F.col("l")).alias("l"),
        F.when(head, F.col("l")).when(~hotfix, F.col("__next")).alias("r"),
        F.when(head, "fork").otherwise("branch").alias("comparison_axis"),
        F.when(head, F.format_string("fork[%s->%s]", F.col("__v"), F.col("l.version")))
        .otherwise(F.format_string("branch[%d]", F.col("l.matrix_row")))
        .alias("release_lineage"),
    )
    pairs = pairs.where(F.col("l").isNotNull() & F.col("r").isNotNull())
    return _pairs(pairs, ["pre-release", "hotfix"], [key], "unified_time_scan")


def grid_pairs(cells: DataFrame, key: str = "artifact") -> DataFrame:
    """Neighbours to the right and below on a ragged grid of tested cells, where the outcome flips.

    A place of the grid holds one cell, so neighbours are found by looking one cell ahead in the row and in the column.
    """
    c = cells.where(F.col("matrix_row").isNotNull())
    me = F.struct(*_SIDE)
    row, col = F.col("matrix_row"), F.col("matrix_col")
    ahead = c.select(
        key,
        row,
        col,
        me.alias("l"),
        F.lead(me).over(Window.partitionBy(key, "matrix_row").orderBy("matrix_col")).alias("right"),
        F.lead(me).over(Window.partitionBy(key, "matrix_col").orderBy("matrix_row")).alias("below"),
    )
    side = lambda near, axis, label, r: F.when(
        near, F.struct(F.lit(axis).alias("comparison_axis"), label.alias("release_lineage"), F.col(r).alias("r"))
    )
    right = side(F.col("right.matrix_col") == col + 1, "row", F.format_string("row[%d]", row), "right")
    below = side(F.col("below.matrix_row") == row + 1, "column", F.format_string("col[%d]", col), "below")
    pairs = ahead.select(key, "l", F.inline(F.filter(F.array(right, below), lambda n: n.isNotNull())))
    return _pairs(pairs, ["pre-release"], [key], "branch_aware_release_time")


