"""Work that has to grow no faster than the rows: plans that must not spread, repeat or merge it."""

from pyspark.sql import functions as F

from flipline.functions.text import truncate_block
from flipline.operators import artifacts as ar
from flipline.operators import judge as jg
from flipline.operators.search import best_anchor, context_window


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_package_of_an_import_is_split_once(spark):
    names = [("org.p.a.Type",), ("org.p.A.member",), ("org.p.*",), ("Type",), (" org.p ",), (None,)]
    d = spark.createDataFrame(names, "name string").select("name", ar.package_of_import(F.col("name")).alias("package"))
    assert optimized(d).count("split(") == 1
    assert [r.package for r in d.collect()] == ["org.p.a", "org.p", "org.p", "Type", "org.p", ""]


def judged(spark, copies=1):
    cases = [("c1", None, True, None, "why.txt", "dependency-tree.diff"), ("c2", ["noise"], True, None, None, None)] * copies
    case_schema = "case_id string, trace_invalid_reasons array<string>, trace_has_difference boolean, trace_has_effective_difference boolean, failure_excerpt_file string, dependency_tree_diff string"
    hunks = [("c1", 1, "trace-diff-summary.txt", "note", "")]
    files = [(c, p, "text") for c in ("c1", "c2") for p in ("why.txt", "trace-diff-summary.txt", "dependency-tree.diff", "version-diff/pom.diff")]
    files += [("c1", "execution-observations.json", " "), ("c3", "trace-diff-summary.txt", "text"), (None, "why.txt", "text"), ("c1", None, "text")]
    return jg.evidence_for_judgment(
        spark.createDataFrame(cases, case_schema),
        spark.createDataFrame(hunks, "case_id string, hunk_pos int, path string, details string, inline string"),
        spark.createDataFrame(files, "case_id string, path string, text string"),
        spark.createDataFrame([("c1", "raw/p/C", "a", "b")], "case_id string, stem string, baseline string, target string"),
    )


def test_supplements_are_the_files_of_a_case_in_listed_order(spark):
    rows = judged(spark).select("case_id", "part", "item", "path").orderBy("case_id", "item").collect()
    assert [tuple(r) for r in rows] == [
        ("c1", 0, 1, "trace-diff-summary.txt"),
        ("c1", 2, 2, "why.txt"),
        ("c1", 2, 3, "dependency-tree.diff"),
        ("c1", 2, 4, "version-diff/pom.diff"),
        ("c2", 2, 1, "dependency-tree.diff"),
        ("c2", 2, 2, "version-diff/pom.diff"),
    ]


def test_evidence_is_dealt_by_cases_and_no_supplement_is_made_without_a_file(spark):
    plan = optimized(judged(spark))
    # Texts are read in as many tasks as cases ask for: before the joins with pairs and with dumps, and in a case.
    assert plan.count("RepartitionByExpression") == 3
    # Only the siblings of hunks are spread.
    assert plan.count("Generate ") == 1


def test_evidence_is_not_broadcast_where_few_rows_are_spread_to_many(spark):
    # Spark takes the spread rows for as few as those they are made of, and the driver would hold them all.
    few = spark.range(3).select(F.concat(F.lit("c"), "id").alias("case_id"), F.lit("dependency-tree.diff").alias("named"))
    words = lambda *names: [F.lit("text").alias(n) for n in names]
    invalid, yes = F.lit(None).cast("array<string>").alias("trace_invalid_reasons"), [F.lit(True).alias(f"trace_has_{d}difference") for d in ("", "effective_")]
    cases = few.select("case_id", invalid, *yes, F.col("named").alias("failure_excerpt_file"), F.col("named").alias("dependency_tree_diff"))
    hunks = few.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("hunk_pos"), F.lit("diffs/p/C.diff").alias("path"), *words("details", "inline"))
    paths = [F.lit(p) for p in ("version-diff/diffs/p/C.diff", "dependency-tree.diff", "version-diff/pom.diff")]
    files = few.select("case_id", F.explode(F.array(*paths)).alias("path"), *words("text"))
    raw = few.select("case_id", F.lit("raw/p/C").alias("stem"), *words("baseline", "target"))
    found = jg.evidence_for_judgment(cases, hunks, files, raw)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 5
    assert [tuple(r) for r in found.groupBy("path").count().orderBy("path").collect()] == [("version-diff/diffs/p/C.diff", 6)]


def test_anchor_and_context_give_the_same_lines(spark):
    rows = [("int a;\nint b;\nlongName.call here\nint b;\n", ["int b;", "longName", "absent"]), ("x\r\ny\x85z", ["yyy"]), (None, ["abc"]), ("abc", None)]
    d = spark.createDataFrame(rows, "text string, terms array<string>")
    d = d.withColumn("at", best_anchor("text", F.col("terms"))).withColumn("near", context_window("text", F.col("at"), 1)["preview"])
    got = d.collect()
    assert [r["at"] for r in got] == [2, None, None, None]
    assert [r["near"] for r in got] == ["00001: int a;\n00002: int b;\n00003: longName.call here", "00001: x\n00002: y", "", "00001: abc"]
    many = spark.createDataFrame([("\n".join(map(str, range(1, 100_002))),)], "text string")
    assert many.select(context_window("text", F.lit(100_000), 1)["preview"]).first()[0] == "99999: 99999\n100000: 100000\n100001: 100001"


def test_long_block_is_cut_at_a_line(spark):
    d = spark.createDataFrame([("a\nb\nc",), ("a" * 5 + "\n" + "b" * 9,), ("a b c\x1cd",), (None,)], "t string")
    cut = [r[0] for r in d.select(truncate_block("t", 2, 10)).collect()]
    assert cut == ["a\nb\n...(truncated)", "aaaaa\n...(truncated)", "a\nb\n...(truncated)", ""]
