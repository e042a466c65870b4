"""Scans: result tables, keyed JSON catalogs, histories, analysis payloads, logs, traces, archives."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipline.functions.failures import classify_lines, is_error_mark
from flipline.functions.text import blank_to_null, clean_text, lines, strip
from flipline.operators.diffs import archive_entries
from flipline.operators.scans import nearest

# Header rules of the result table (rule, keyword) and the line formats of a trace.
RESULT_COLUMNS = {
    "CVE_ID": ("exact", "cve_id"),
    "Library": ("exact", "library"),
    "PoC": ("exact", "poc"),
    "Version": ("exact", "version"),
    "Execution Result": ("contains", "execution"),
    "True Affected Version": ("contains", "true affected version"),
    "LLM_Verdict": ("exact", "llm_verdict"),
    "Aligned_llm": ("exact", "aligned_llm"),
}
NO_DATA = "No_Data"
TRACE_ENTER = r"(?U)^\d+\s+ENTER\s+\[[^\]]+\]\s+depth=\d+\s+(.+)$"
TRACE_META = r"(?U)^\d+\s+META\s+\[[^\]]+\]\s+([^=]+)=(.*)$"

PAIR = (
    "STRUCT<appears:STRING, `not appears`:STRING, BASE_TAG:STRING, HEAD_TAG:STRING, COMPARE_URL:STRING, "
    "seek_patch:BOOLEAN, compile:BOOLEAN, cause:STRING, ordering_basis:STRING, release_lineage:STRING, "
    "comparison_axis:STRING, baseline_release_date:STRING, target_release_date:STRING, baseline_matrix_row:INT, "
    "baseline_matrix_col:INT, target_matrix_row:INT, target_matrix_col:INT>"
)
CATALOG = (
    "STRUCT<OWNER:STRING, REPO:STRING, description:STRING, cwe:ARRAY<STRING>, library:STRING, artifact:STRING, "
    f"artifact_resolution:STRING, version_pair:ARRAY<{PAIR}>>"
)
CASE_RESULT = (
    "case_id STRING, cve_id STRING, pair_index INT, owner STRING, repo STRING, description STRING, artifact STRING, "
    "baseline_version STRING, target_version STRING, appears STRING, not_appears STRING, base_tag STRING, "
    "head_tag STRING, compare_url STRING, compile BOOLEAN, dataset_cause STRING, status STRING, failure_kind STRING, "
    "failure_subtype STRING, baseline_execution_observation STRING, target_execution_observation STRING, "
    "trace_has_difference BOOLEAN, trace_has_effective_difference BOOLEAN, trace_evidence_valid BOOLEAN, "
    "trace_invalid_reasons ARRAY<STRING>, first_divergence_is_noise BOOLEAN, timed_out BOOLEAN, analysis_dir STRING, "
    "driver_exit_code INT, status_counts MAP<STRING, INT>"
)
STATUS_LOG = (
    "case_id STRING, cve_id STRING, pair_index INT, returncode INT, timed_out BOOLEAN, timeout_seconds INT, "
    "duration_seconds DOUBLE, driver_log STRING, progress_index INT, progress_total INT"
)
USAGE_LOG = (
    "ts DOUBLE, method STRING, case_id STRING, model STRING, prompt_tokens LONG, input_tokens LONG, "
    "prompt_tokens_total LONG, completion_tokens LONG, output_tokens LONG, completion_tokens_total LONG, total_tokens LONG"
)


def _texts(spark: SparkSession, pattern: str, nested: bool, **options) -> DataFrame:
    """Text files of a pattern, or with ``nested`` all below one folder, whose folders are listed by tasks."""
    reader = spark.read.option("recursiveFileLookup", True) if nested else spark.read
    return reader.text(pattern, **options)


def resolve_header(columns: list[str], rule: str, keyword: str) -> str | None:
    """First column whose lower-cased name equals, contains or starts with the keyword."""
    test = {
        "exact": lambda c: c == keyword,
        "contains": lambda c: keyword in c,
        "prefix": lambda c: c.startswith(keyword),
    }[rule]
    return next((c for c in columns if test(c.lower().strip())), None)


def read_results(
    spark: SparkSession, path: str, fmt: str = "parquet", pos: str = "row_pos", rules: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """The result table with canonical column names.

    Row order is meaning here, so the export has to carry it in ``pos``: a file scan does not keep file order.
    Rows without an issue or version are dropped, a missing verdict column is created with No_Data.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path)
    rules = rules or RESULT_COLUMNS
    found = {name: resolve_header(raw.columns, *rule) for name, rule in rules.items()}
    created = {"LLM_Verdict", "Aligned_llm"}
    absent = [n for n, c in found.items() if c is None and n not in created]
    if absent or pos not in raw.columns:
        raise ValueError(f"missing columns: {absent + ([] if pos in raw.columns else [pos])}")
    named = [F.col(f"`{c}`").alias(n) if c else F.lit(NO_DATA).alias(n) for n, c in found.items()]
    used = set(found.values()) | {pos}
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in used]
    out = raw.select(F.col(pos).cast("bigint").alias("row_pos"), *named, *rest)
    return out.dropna(subset=["CVE_ID", "Version"])


#: Bytes that tell where the entries of a JSON object part: quotes, brackets that open, brackets that close, backslashes.
_MARKS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b'"', b"{[", b"}]", b"\\"), 1):
    _MARKS[list(_bytes)] = _kind


def _walked(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of binary pieces in order, up to the end of each: quotes, and depth by brackets behind an even and an odd number of quotes."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    ends = offsets[1:] - offsets[0]
    kinds = _MARKS[np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    at = np.flatnonzero(kinds)
    kind = kinds[at]
    slashes = at[kind == 4]
    if len(slashes):
        # A backslash escapes what follows it in its piece, unless it is escaped itself.
        piece = np.searchsorted(ends, slashes, "right")
        place = np.arange(len(slashes))
        begins = np.concatenate([[True], (np.diff(slashes) > 1) | (np.diff(piece) > 0)])
        active = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        escaped = slashes[active] + 1
        escaped = escaped[escaped < ends[piece[active]]]
        kinds[escaped] = 0
        kind = kinds[at]
        at, kind = at[(kind > 0) & (kind < 4)], kind[(kind > 0) & (kind < 4)]
    quotes = np.cumsum(kind == 1)
    change = (kind == 2).astype(np.int64) - (kind == 3)
    until = np.searchsorted(at, ends, "left")
    so_far = lambda x: np.concatenate([[0], x])[until]
    return so_far(quotes), so_far(np.cumsum(np.where(quotes % 2 == 0, change, 0))), so_far(np.cumsum(np.where(quotes % 2 == 1, change, 0)))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Batches cut so that each holds rows of one split of a file, which its columns other than the value name."""
    for batch in batches:
        cuts = {0, batch.num_rows}
        for name in batch.schema.names:
            if name != "value":
                other = pc.not_equal(batch[name][1:], batch[name][:-1]).to_numpy(zero_copy_only=False)
                cuts.update((np.flatnonzero(other) + 1).tolist())
        for a, b in pairwise(sorted(cuts)):
            yield {c: batch[c][a].as_py() for c in batch.schema.names if c != "value"}, batch["value"].slice(a, b - a)


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split its quotes, its depth if it begins outside (0) or inside (1) a string, and how many pieces end at which depth outside one."""
    counts = pa.map_(pa.int64(), pa.int64())

    def told() -> pa.RecordBatch:
        ends = [pa.array([list(c.items())], counts) for c in ended]
        sums = {"start": now["start"], "quotes": quotes, "depth0": depth[0], "depth1": depth[1]}
        columns = {"path": pa.array([now["path"]])} | {c: pa.array([int(v)], pa.int64()) for c, v in sums.items()}
        return pa.RecordBatch.from_pydict(columns | {"ends0": ends[0], "ends1": ends[1]})

    now = None
    for key, pieces in _by_split(batches):
        if key != now:
            if now:
                yield told()
            now, quotes, depth, ended = key, 0, [0, 0], (Counter(), Counter())
        q, *deep = _walked(pieces)
        for case in (0, 1):
            own = depth[case] + deep[(quotes + case) % 2]
            values, sizes = np.unique(own[(quotes + q) % 2 == case], return_counts=True)
            ended[case].update(dict(zip(values.tolist(), sizes.tolist(), strict=True)))
            depth[case] = int(own[-1])
        quotes += int(q[-1])
    if now:
        yield told()


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a split has of each entry: the entry's number in its file, the pieces joined by commas, and whether the object ends there."""

    def out(numbers: np.ndarray, texts: pa.Array, ends: np.ndarray) -> pa.RecordBatch:
        columns = {"number": pa.array(numbers, pa.int64()), "text": texts, "ends": pa.array(ends, pa.bool_())}
        if "path" in now:
            columns |= {"path": pa.array([now["path"]] * len(texts)), "start": pa.array([now["start"]] * len(texts), pa.int64())}
        return pa.RecordBatch.from_pydict(columns)

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield out(np.array([number]), pa.array([b"".join(held)[:-1]], pa.binary()), np.array([over]))

    now, held = None, []
    for key, pieces in _by_split(batches):
        if key != now:
            yield from rest()
            inside, depth, number = (key.get(c, 0) for c in ("inside", "base", "first"))
            now, held, over = key, [], False
        q, *deep = _walked(pieces)
        own = depth + deep[inside]
        free = (inside + q) % 2 == 0
        parts = free & (own == 1)
        closed = np.concatenate([[0], np.cumsum(free & (own <= 0))])
        depth, inside = int(own[-1]), int(inside + q[-1]) % 2
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        # The commas that part entries are left out, all others are put back.
        joined = np.insert(data, ends[~parts], ord(",")).tobytes()
        at = np.flatnonzero(parts)
        if len(at):
            borders = ends[at] + at - np.arange(len(at))
            before = b"".join(held)
            whole = before + joined[: borders[-1]]
            index = np.concatenate([[0], borders + len(before)]).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(index.tobytes()), pa.py_buffer(whole)])
            finished = np.diff(np.concatenate([[0], closed[at + 1]])) > 0
            finished[0] |= over
            yield out(number + np.arange(len(at)), texts, finished)
            number, held, over = number + len(at), [], False
            joined, closed = joined[borders[-1] :], closed[at[-1] + 1 :]
        if joined:
            held.append(joined)
            over = over or bool(closed[-1] > closed[0])
    yield from rest()


def _entries_of_objects(spark: SparkSession, path: str) -> DataFrame:
    """The top-level entries of JSON objects, one object per file, each as a JSON object of its own.

    Files are read in splits and cut at every comma, and a task walks the pieces of a split in order. A comma that leaves
    depth one outside a string parts two entries. A file of one split needs no more. Of others, whether a split begins
    inside a string, how deep, and after how many entries follows from all splits before it: each is summed up for both
    cases, and the table of splits, one row for as many bytes as a split has, settles which one holds. Only what splits have
    of their entries is shuffled. No task holds more than a batch of pieces and an entry.
    """
    raw = spark.read.text(path, lineSep=",").select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("cut"),
    )
    names = "number long, text binary, ends boolean"
    # Few columns, as Arrow takes more time than all else. Files that follow each other in a task are told apart by a hash.
    alone = raw.where(~F.col("cut")).select(F.xxhash64("path").alias("file"), "value").mapInArrow(_fragments, names)
    cut = raw.where("cut").select("path", "start", "value")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    either = lambda c: F.when(F.col("inside") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    counts = "quotes long, depth0 long, depth1 long, ends0 map<long,long>, ends1 map<long,long>"
    splits = cut.mapInArrow(_split_sums, f"path string, start long, {counts}")
    splits = splits.withColumn("inside", (so_far("quotes") % 2).cast("int")).withColumn("base", so_far(either("depth")))
    splits = splits.withColumn("entries", F.coalesce(F.try_element_at(either("ends"), 1 - F.col("base")), F.lit(0)))
    splits = splits.select("path", "start", "inside", "base", so_far("entries").alias("first"))
    # The pieces stay in order beside a broadcast table.
    found = cut.join(F.broadcast(splits), ["path", "start"]).mapInArrow(_fragments, f"{names}, path string, start long")
    found = found.groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"), F.bool_or("ends").alias("ends"))
    joined = F.array_join(F.transform("parts", lambda x: x["text"].cast("string")), ",")
    whole = alone.select("number", F.col("text").cast("string"), "ends").union(found.select("number", joined, "ends")).toDF("number", "text", "ends")
    text = F.when(F.col("number") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    text = F.when(F.col("ends"), F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    return whole.select(F.concat(F.lit("{"), text, F.lit("}")).alias("value"))


def _keyed(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Rows (key, value JSON) of JSON objects: one object per file, however large, or with ``by_line`` one per line.

    Entries that are no JSON are skipped.
    """
    raw = spark.read.text(path) if by_line else _entries_of_objects(spark, path)
    return raw.select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("key", "value"))


def read_catalog(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """One row per version pair: issue fields, ``pair_index`` and the pair's fields."""
    d = _keyed(spark, path, by_line).select(F.col("key").alias("cve"), F.from_json("value", CATALOG).alias("c"))
    fields = ["OWNER", "REPO", "description", "cwe", "library", "artifact"]
    d = d.select("cve", *[f"c.{f}" for f in fields], F.posexplode("c.version_pair").alias("pair_index", "p"))
    return d.select("cve", *fields, "pair_index", "p.*")


def read_catalog_issues(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """One row per issue of a catalog, whether or not it has pairs."""
    d = _keyed(spark, path, by_line).select(F.col("key").alias("cve"), F.from_json("value", CATALOG).alias("c"))
    return d.select("cve", "c.OWNER", "c.REPO", "c.description", "c.cwe", "c.library", "c.artifact")


def read_repo_metadata(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    schema = "STRUCT<owner:STRING, repo:STRING, description:STRING, cwe:ARRAY<STRING>, github_url:STRING>"
    d = _keyed(spark, path, by_line).where(strip("value").startswith("{"))
    d = d.select(strip("key").alias("cve"), F.from_json("value", schema).alias("v"))
    named = lambda c: F.coalesce(blank_to_null(f"v.{c}"), F.lit("unknown"))
    return d.select(
        "cve",
        named("owner").alias("owner"),
        named("repo").alias("repo_name"),
        F.coalesce("v.description", F.lit("")).alias("description"),
        F.coalesce("v.cwe", F.array().cast("array<string>")).alias("cwe"),
        F.coalesce("v.github_url", F.lit("")).alias("github_url"),
    )


def read_release_history(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    d = _keyed(spark, path, by_line).where(strip("value").startswith("["))
    d = d.select(F.col("key").alias("artifact"), F.explode(F.from_json("value", "ARRAY<STRUCT<version:STRING, release_date:STRING>>")).alias("e"))
    d = d.select("artifact", clean_text("e.version").alias("version"), F.try_to_timestamp(clean_text("e.release_date")).alias("release_date"))
    return d.where((F.col("version") != "") & F.col("release_date").isNotNull())


def read_disclosed(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (coordinate, issue, version) lines; comments and malformed lines are skipped."""
    line = strip("value")
    parts = F.filter(F.transform(F.split(line, "\t"), strip), lambda p: p != "")
    d = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(parts.alias("p"))
    d = d.where(F.size("p") >= 2).select(
        F.col("p")[0].alias("gav"), F.col("p")[1].alias("cve"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("version")
    )
    return d.where(F.col("gav").contains(":") & F.upper("cve").startswith("CVE-"))


def read_analysis(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Entries of nested analysis payloads; the analysis itself stays a JSON text of any depth."""
    d = _keyed(spark, path, by_line).where(strip("value").startswith("["))
    d = d.select(F.upper(strip("key")).alias("cve"), F.posexplode(F.from_json("value", "ARRAY<STRING>")).alias("entry_pos", "e"))
    part = lambda c: F.coalesce(F.get_json_object("e", f"$.{c}"), F.lit("")).alias(c)
    return d.select("cve", "entry_pos", part("base_tag"), part("head_tag"), part("analysis"))


SCORED_FILES = "MAP<STRING, MAP<STRING, STRUCT<score:DOUBLE, msg_score:DOUBLE>>>"


def read_case_results(spark: SparkSession, pattern: str, nested: bool = False) -> DataFrame:
    """One row per result document, keyed by its case folder; ``is_valid`` is false for broken JSON."""
    raw = _texts(spark, pattern, nested, wholetext=True).select("value", F.col("_metadata.file_path").alias("result_path"))
    doc = raw.select(
        F.regexp_extract("result_path", r"([^/]+)/[^/]+$", 1).alias("case_id"),
        "result_path",
        F.try_parse_json("value").isNotNull().alias("is_valid"),
        F.from_json("value", CASE_RESULT).alias("r"),
    )
    fields = [f.name for f in doc.schema["r"].dataType.fields if f.name != "case_id"]
    word = lambda c, d: F.coalesce(blank_to_null(f"r.{c}"), F.lit(d)).alias(c)
    keep = [F.col(f"r.{f}") for f in fields if f not in ("status", "failure_subtype")]
    return doc.select("case_id", "result_path", "is_valid", word("status", "unknown"), word("failure_subtype", "none"), *keep)


def read_logs(spark: SparkSession, pattern: str, nested: bool = False) -> DataFrame:
    """Whole logs keyed by file stem; bytes that are no text are replaced."""
    raw = _texts(spark, pattern, nested, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return raw.select(
        F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", "").alias("case_id"), "file_name", F.make_valid_utf8("value").alias("text")
    )


def read_log_reports(spark: SparkSession, pattern: str, max_lines: int = 80, nested: bool = False) -> DataFrame:
    """(path, case_id, file_name, n_lines, kind, excerpt) of log files of any size, as ``classify_log`` and ``error_excerpt`` have them.

    Logs are read by line in splits, so none is ever one value: lines say what they know of their log, one aggregate per log
    decides, and only the ``max_lines`` lines of its excerpt come together. Files without a line are not listed.
    """
    rows = read_numbered(spark, pattern, lambda v: F.lit(True), nested).withColumn("line", F.make_valid_utf8("line"))
    # A pattern may go on behind the end of a line, over blank ones, so a line is read with the next that has text.
    said = F.when(clean_text("line") != "", F.col("line"))
    rows = nearest(rows, "path", "pos", after={"__next": said})
    sums, kind = classify_lines(F.concat_ws("\n", "line", "__next"), F.col("pos"))
    rows = rows.select("path", "pos", "line", "__next")
    mark = F.min(F.when(is_error_mark(F.col("line")), F.col("pos"))).alias("__mark")
    facts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), mark, *sums)
    start = F.greatest(F.coalesce(F.col("__mark") - 3, F.col("n_lines") - max_lines), F.lit(0))
    facts = facts.select("path", "n_lines", kind.alias("kind"), start.alias("__start"))
    # Where the excerpt begins is one number per log, and joined to the lines it drops all others.
    shown = rows.join(facts.select("path", "__start"), "path").where(F.col("pos").between(F.col("__start"), F.col("__start") + max_lines - 1))
    texts = shown.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("__l"))
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    return facts.join(texts, "path").select(
        "path",
        F.regexp_replace(file, r"(?<=.)\.[^.]*$", "").alias("case_id"),
        file.alias("file_name"),
        "n_lines",
        "kind",
        F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("excerpt"),
    )


def read_tagged(spark: SparkSession, pattern: str, kind, nested: bool = False) -> DataFrame:
    """Lines of large text files with their kind and their rank among the lines of that kind in the file, from 0.

    ``kind(value)`` names the kind of a line, null for lines to skip. Files are read in splits. The split offset and
    the reading order inside a split order all lines of a file, so lines are ranked per split and shifted by the
    counts of earlier splits; no task holds a whole file.
    """
    raw = _texts(spark, pattern, nested).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    d = raw.withColumn("kind", kind(F.col("value"))).where("kind is not null")
    part = ["path", "start", "kind"]
    here = d.withColumn("__n", F.row_number().over(Window.partitionBy(*part).orderBy("__id")) - 1)
    earlier = Window.partitionBy("path", "kind").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*part).count().select(*part, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__b"))
    return here.join(base, part).select("path", "kind", (F.col("__n") + F.col("__b")).alias("pos"), F.col("value").alias("line"))


def read_numbered(spark: SparkSession, pattern: str, keep, nested: bool = False) -> DataFrame:
    """Lines of large text files with their rank among the kept lines of the file, from 0."""
    return read_tagged(spark, pattern, lambda v: F.when(keep(v), "line"), nested).drop("kind")


def read_trace_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Calls and metadata of trace files in one table: (trace_id, kind, pos, symbol, key, value), kind call or meta."""
    kind = lambda v: F.when(v.rlike(TRACE_ENTER), "call").when(v.rlike(TRACE_META), "meta")
    get = lambda k, p, i: F.when(F.col("kind") == k, F.regexp_extract("line", p, i))
    return read_tagged(spark, pattern, kind).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("trace_id"),
        "kind",
        "pos",
        get("call", TRACE_ENTER, 1).alias("symbol"),
        get("meta", TRACE_META, 1).alias("key"),
        get("meta", TRACE_META, 2).alias("value"),
    )


def read_traces(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Calls (trace_id, pos, symbol) and metadata (trace_id, pos, key, value) of trace files."""
    found = read_trace_lines(spark, pattern)
    calls = found.where("kind = 'call'").select("trace_id", "pos", "symbol")
    return calls, found.where("kind = 'meta'").select("trace_id", "pos", "key", "value")


def parse_trace_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Events of traces held as text columns: (key, pos, kind, symbol, meta key, value), other lines skipped."""
    d = df.select(key, F.posexplode(lines(text)).alias("line_no", "line"))
    get = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    d = d.select(key, "line_no", get(TRACE_ENTER, 1).alias("symbol"), get(TRACE_META, 1).alias("meta_key"), F.regexp_extract("line", TRACE_META, 2).alias("value"))
    kind = F.when(F.col("symbol").isNotNull(), "ENTER").when(F.col("meta_key").isNotNull(), "META")
    return d.withColumn("kind", kind).where("kind is not null")


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """Class entries of archives with content digests: (archive, entry, sha)."""
    return archive_entries(spark.read.format("binaryFile").load(pattern).select("path", "content"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; broken and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_snapshot(spark: SparkSession, pattern: str | list[str], explicit: str | None = None, folders: bool = False) -> str:
    """Newest of the candidate files by modification time; an explicit path overrides.

    With ``folders`` a snapshot is a folder of files, as old as its newest file.
    """
    if explicit:
        return explicit
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    if folders:
        files = files.withColumn("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    if row is None or row["path"] is None:
        raise FileNotFoundError(f"no candidate matches {pattern}")
    return row["path"]
