"""Which artifact a case is about: candidate unions, best candidate, hints, tags, package prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipline.functions.text import alnum_token, blank_to_null, clean_text, let
from flipline.functions.versions import gav_artifact, gav_from_cause, gav_from_text, library_key, normalize_version
from flipline.operators.scans import in_lists, top_per_key

# Tag prefixes in the order they are tried, artifacts and tokens that never identify a case,
# and package roots of artifacts whose coordinates do not tell them.
TAG_PREFIXES = ["", "v", "REL", "release-", "wicket-", "XSTREAM_", "xstream-", "v_", "r"]
SKIP_DEPENDENCIES = [
    "junit:junit",
    "org.ow2.asm:asm",
    "org.ow2.asm:asm-commons",
    "org.ow2.asm:asm-tree",
    "org.slf4j:slf4j-api",
    "org.slf4j:slf4j-simple",
    "javax.servlet:javax.servlet-api",
    "javax.activation:activation",
    "org.springframework:spring-test",
]
SKIP_SIGNAL = [
    "junit:junit",
    "org.assertj:assertj-core",
    "org.junit.jupiter:junit-jupiter",
    "org.mockito:mockito-core",
]
GENERIC_PARTS = ["core", "lib", "library", "plugin", "parent", "java", "sdk", "api", "all"]
SKIP_TOKENS = GENERIC_PARTS + [
    "org",
    "com",
    "net",
    "io",
    "edu",
    "javax",
    "jakarta",
    "spring",
    "apache",
    "framework",
    "project",
    "projects",
    "common",
    "commons",
    "test",
    "tests",
]
HINT_OVERRIDES = {
    "CVE-2018-11039": "org.springframework:spring-web",
    "CVE-2021-40111": "org.apache.james.protocols:protocols-imap",
}
PACKAGE_FALLBACKS = {
    "org.springframework:spring-web": ["org.springframework.web"],
    "net.lingala.zip4j:zip4j": ["net.lingala.zip4j"],
    "com.fasterxml.jackson.datatype:jackson-datatype-jsr310": [
        "com.fasterxml.jackson.databind",
        "com.fasterxml.jackson.datatype.jsr310",
    ],
    "org.xwiki.commons:xwiki-commons-velocity": ["org.xwiki.velocity"],
    "org.jodd:jodd-http": ["jodd.http"],
    "com.nimbusds:nimbus-jose-jwt": ["com.nimbusds.jose"],
}


def candidate_union(*sources: DataFrame) -> DataFrame:
    """Distinct (library key, coordinate) pairs of several coordinate lists (column ``gav``)."""
    rows = [
        s.select(library_key(gav_artifact("gav")).alias("library"), clean_text("gav").alias("gav")) for s in sources
    ]
    both = reduce(lambda a, b: a.unionByName(b), rows)
    return both.where((F.col("library") != "") & F.col("gav").contains(":")).distinct()


def modal_values(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Distinct values per key, most frequent first, earlier first use on ties."""
    v = clean_text(value)
    counts = df.where(F.col(value).isNotNull() & (v != "")).groupBy(key, v.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos")
    )
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "first_pos")
    return counts.withColumn("rank", F.row_number().over(w))


def description_candidates(repos: DataFrame) -> DataFrame:
    return repos.select("cve", gav_from_text("description").alias("gav")).where("gav is not null")


def resolve_artifact(
    cases: DataFrame,
    direct: DataFrame,
    case_libraries: DataFrame,
    disclosed_libraries: DataFrame,
    library_candidates: DataFrame,
    observed: DataFrame,
    history: DataFrame,
) -> DataFrame:
    """Choose the artifact of every issue.

    ``cases(cve)``; ``direct(cve, gav, source, source_rank, pos)`` coordinates named for the issue itself;
    ``case_libraries`` and ``disclosed_libraries(cve, library, pos)``; ``library_candidates(library, gav,
    source)`` with source ``library_local`` or ``library_maven_search``; ``observed(cve, version)``;
    ``history(gav, version)``. One direct coordinate that agrees with the libraries is taken as it is. Otherwise
    all candidates of the libraries compete by version hits, history size and name.

    Coordinates, libraries and issues are rows of one long table, so every input is read once: rows that say the same
    are merged, flags come from one window over (issue, library key), and one aggregate per issue decides.
    """
    pool = _candidate_rows(_named(cases, direct, case_libraries, disclosed_libraries), library_candidates)
    return _choose(_with_hits(pool, observed, history))


def _named(cases: DataFrame, direct: DataFrame, case_libraries: DataFrame, disclosed_libraries: DataFrame) -> DataFrame:
    """(cve, kind, name, o, disclosed): each issue, coordinate and library of an issue once, with its first use."""
    use = lambda rank, source: F.struct(
        rank.cast("int").alias("rank"), F.col("pos").cast("bigint").alias("pos"), source.cast("string").alias("source")
    )
    none = F.lit(None).cast("string")
    listed = lambda df, g: df.select(
        "cve", F.lit("library").alias("kind"), clean_text("library").alias("name"), use(F.lit(g), none).alias("o")
    ).where("name <> ''")
    rows = [
        cases.select("cve", F.lit("case").alias("kind"), none.alias("name"), F.lit(0).cast("bigint").alias("pos")).select(
            "cve", "kind", "name", use(F.lit(0), none).alias("o")
        ),
        direct.select(
            "cve", F.lit("direct").alias("kind"), clean_text("gav").alias("name"), use(F.col("source_rank"), F.col("source")).alias("o")
        ).where(F.col("name").contains(":")),
        listed(case_libraries, 0),
        listed(disclosed_libraries, 1),
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("cve", "kind", "name").agg(
        F.min("o").alias("o"), F.bool_or(F.col("o.source") == "disclosed").alias("disclosed")
    )


def _candidate_rows(named: DataFrame, library_candidates: DataFrame) -> DataFrame:
    """One row per issue, library key and coordinate (null for issues and libraries) with the flags of its library key."""
    is_library, is_direct = F.col("kind") == "library", F.col("kind") == "direct"
    rows = named.withColumn("lib", library_key(F.when(is_direct, gav_artifact("name")).otherwise(F.col("name"))))
    offered = library_candidates.select(
        library_key("library").alias("wanted"), clean_text("gav").alias("offer"), F.col("source").alias("offer_source")
    ).where(F.col("offer").contains(":"))
    rows = rows.join(offered, is_library & (F.col("lib") == F.col("wanted")), "left")
    local_first = F.when(F.col("offer_source") == "library_local", 0).otherwise(1)
    own = F.struct(
        "lib",
        F.when(is_direct, F.col("name")).alias("gav"),
        F.col("o.rank").alias("rank"),
        F.format_string("%012d", "o.pos").alias("sub"),
        F.col("o.source").alias("source"),
        "kind",
    )
    offer = F.struct(
        library_key(gav_artifact("offer")).alias("lib"),
        F.col("offer").alias("gav"),
        (F.lit(100) + F.col("o.rank")).alias("rank"),
        F.format_string("%012d|%d|%s", "o.pos", local_first, "offer").alias("sub"),
        F.col("offer_source").alias("source"),
        F.lit("offer").alias("kind"),
    )
    both = F.filter(F.array(own, F.when(F.col("offer").isNotNull(), offer)), lambda r: r.isNotNull())
    long = rows.select("cve", "name", "disclosed", "o", F.explode(both).alias("r")).select("cve", "name", "disclosed", "o", "r.*")
    merged = long.groupBy("cve", "lib", "gav").agg(
        F.min(F.when(F.col("gav").isNotNull(), F.struct("rank", "sub", "source"))).alias("use"),
        F.min(F.when(F.col("kind") == "direct", F.struct("rank", "sub", "gav", "source"))).alias("first"),
        F.min(F.when(F.col("kind") == "library", F.struct("o.rank", "o.pos", "name"))).alias("library"),
        F.bool_or((F.col("kind") == "library") & (F.col("rank") == 0)).alias("own"),
        F.bool_or(F.col("kind") == "library").alias("listed"),
        F.bool_or((F.col("kind") == "direct") & F.coalesce("disclosed", F.lit(False))).alias("disclosed"),
        F.bool_or(F.col("kind") == "case").alias("is_case"),
    )
    w = Window.partitionBy("cve", "lib")
    return merged.withColumns(
        {
            "is_own": F.max("own").over(w),
            "is_listed": F.max("listed").over(w),
            "lib_direct": F.max(F.col("first").isNotNull()).over(w),
            "lib_row": F.row_number().over(w.orderBy("gav")),
        }
    ).drop("own", "listed")


def _with_hits(pool: DataFrame, observed: DataFrame, history: DataFrame) -> DataFrame:
    """Add the size of each coordinate's history and how many observed versions it has, as written and normalised."""
    sizes = history.groupBy("gav").agg(F.count(F.lit(1)).alias("history_n"))
    v = clean_text("version")
    keys = F.explode(F.array(F.struct(F.lit(True).alias("exact"), v.alias("key")), F.struct(F.lit(False).alias("exact"), normalize_version(v).alias("key"))))
    seen = observed.select("cve", keys.alias("k")).select("cve", "k.*").where("key <> ''").distinct()
    known = history.select("gav", keys.alias("k")).select("gav", "k.*").where("key <> ''").distinct().withColumn("hit", F.lit(True))
    facts = F.struct(*[c for c in pool.columns if c not in ("cve", "gav")]).alias("row")
    tried = pool.select("cve", "gav", facts).join(seen, "cve", "left").join(known, ["gav", "exact", "key"], "left")
    hits = tried.groupBy("cve", "gav", "row").agg(
        F.count_if(F.col("hit") & F.col("exact")).alias("exact_n"), F.count_if(F.col("hit") & ~F.col("exact")).alias("norm_n")
    )
    return hits.join(sizes, "gav", "left").na.fill(0, ["history_n"]).select("cve", "gav", "row.*", "exact_n", "norm_n", "history_n")


def _choose(rows: DataFrame) -> DataFrame:
    """The decision of each issue from its candidate rows."""
    pooled, direct = F.col("use").isNotNull(), F.col("first").isNotNull()
    own, listed = pooled & F.col("is_own"), pooled & F.col("is_listed")
    rival = F.struct("exact_n", "norm_n", "history_n", "gav", F.col("use.source").alias("source"))
    back = F.struct("use.rank", "use.sub", "gav", F.col("use.source").alias("source"))
    found = rows.groupBy("cve").agg(
        F.bool_or("is_case").alias("is_case"),
        F.count_if(direct).alias("direct_n"),
        F.count_if((F.col("lib_row") == 1) & F.col("lib_direct") & (F.col("lib") != "")).alias("direct_libs"),
        F.count_if("disclosed").alias("disclosed_n"),
        F.count_if((F.col("lib_row") == 1) & F.col("is_own")).alias("own_n"),
        F.count_if(direct & (F.col("lib") != "") & ~F.col("is_own")).alias("foreign_n"),
        F.min("first").alias("first"),
        F.min("library").alias("library"),
        F.count_if(own).alias("own_rivals"),
        F.count_if(pooled).alias("all_rivals"),
        F.max(F.when(own, rival)).alias("own_top"),
        F.max(F.when(pooled, rival)).alias("all_top"),
        F.min(F.when(listed, back)).alias("listed_back"),
        F.min(F.when(pooled, back)).alias("all_back"),
    ).where("is_case")
    # Candidates of the issue's own libraries compete when there are any, else all of them.
    top, back = F.coalesce("own_top", "all_top"), F.coalesce("listed_back", "all_back")
    rivals = F.when(F.col("own_rivals") > 0, F.col("own_rivals")).otherwise(F.col("all_rivals"))
    validate = (
        (F.col("disclosed_n") > 1) | (F.col("direct_libs") > 1) | (F.col("own_n") > 1)
        | ((F.col("own_n") > 0) & (F.col("foreign_n") > 0))
    )
    settled = (F.col("direct_n") > 0) & ~validate
    won = (rivals == 1) | (top["exact_n"] > 0) | (top["norm_n"] > 0)
    pick = lambda name: F.when(settled, F.col(f"first.{name}")).when(won, top[name]).otherwise(back[name])
    decided = found.select(
        "cve",
        pick("gav").alias("artifact"),
        F.concat(pick("source"), F.when(validate & ~settled, "_excel_validated").otherwise("")).alias("source"),
        F.col("library.name").alias("first_library"),
    )
    named = F.col("artifact").isNotNull()
    return decided.select(
        "cve",
        "artifact",
        F.when(named, gav_artifact("artifact")).otherwise(F.coalesce("first_library", F.lit(""))).alias("library"),
        F.when(named, F.col("source"))
        .when(F.col("first_library").isNull(), "missing_library")
        .otherwise("unresolved")
        .alias("artifact_resolution"),
    )


# --- hints ------------------------------------------------------------------------------------------------


def _single(value: Column, name: str) -> list[Column]:
    """Aggregates for :func:`_one_of`."""
    return [F.min(value).alias(f"{name}_least"), F.max(value).alias(f"{name}_most")]


def _one_of(name: str) -> Column:
    """The value if all were equal."""
    return F.when(F.col(f"{name}_least") == F.col(f"{name}_most"), F.col(f"{name}_least"))


def signal_tokens(gav: Column) -> Column:
    parts = F.concat(
        F.split(F.lower(F.substring_index(gav, ":", 1)), r"\."),
        F.split(F.lower(F.substring_index(gav, ":", -1)), r"[-_.]+"),
    )
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 3) & ~p.isin(*SKIP_TOKENS)))


def artifact_hints(cases: DataFrame, dependencies: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Artifact of a case from independent hints; the first that settles it counts.

    ``cases(case_id, cve, artifact, baseline_version, target_version, cause, repo, signal_text)``,
    ``dependencies(case_id, gav, version, scope)``, ``disclosed(cve, gav, version)``. Order: a stated artifact,
    the only direct dependency or the only one of a compared version, the dependency the test code names most,
    disclosed lists, the coordinate in the error, the repository name, a table of overrides.
    """
    gav = clean_text("gav")
    deps = dependencies.select("case_id", gav.alias("gav"), F.coalesce(F.col("version"), F.lit("")).alias("version"), F.coalesce(F.col("scope"), F.lit("")).alias("scope"))
    deps = deps.where(F.col("gav").rlike("^[^:]+:.+$") & ~F.col("scope").isin("test", "provided"))
    about = deps.join(cases.select("case_id", "baseline_version", "target_version", F.lower(clean_text("repo")).alias("__r")), "case_id")
    facts = _dependency_facts(about)
    signals = _signal_dependency(deps, cases)

    listed = disclosed.select("cve", gav.alias("gav"), F.coalesce(clean_text("version"), F.lit("")).alias("version")).where("gav <> ''")
    # A case asks for what is listed for its versions and, by a mark in place of a version, for its whole issue.
    asked = lambda *versions: F.explode(F.array_distinct(F.array(*[F.struct(F.lit(own).alias("own"), v.alias("version")) for own, v in versions])))
    every = (False, F.lit(""))
    entries = listed.select("cve", "gav", asked((True, F.col("version")), every).alias("q")).groupBy("cve", "q").agg(*_single(F.col("gav"), "q"))
    wanted = cases.select("case_id", "cve", asked((True, F.col("baseline_version")), (True, F.col("target_version")), every).alias("q"))
    own = F.col("q.own")
    ranges = [F.min(F.when(t, F.col("q_least"))).alias(f"{n}_least") for n, t in (("two", own), ("all", ~own))]
    ranges += [F.max(F.when(t, F.col("q_most"))).alias(f"{n}_most") for n, t in (("two", own), ("all", ~own))]
    by_listed = wanted.join(entries, ["cve", "q"]).groupBy("case_id").agg(*ranges).select(
        "case_id", F.coalesce(_one_of("two"), _one_of("all")).alias("listed")
    )

    overrides = F.create_map(*[F.lit(x) for pair in HINT_OVERRIDES.items() for x in pair])
    d = cases.drop("signal_text")
    for t in (facts, signals, by_listed):
        d = d.join(t, "case_id", "left")
    stated = blank_to_null("artifact")
    hints = {
        "stated": stated,
        "dependency": F.coalesce("only_dependency", "version_dependency"),
        "signal": F.col("signal_dependency"),
        "disclosed": F.col("listed"),
        "cause": gav_from_cause("cause"),
        "repository": F.coalesce("repo_exact", "repo_partial"),
        "override": F.try_element_at(overrides, F.col("cve")),
    }
    source = reduce(lambda acc, kv: acc.when(kv[1].isNotNull(), kv[0]), hints.items(), F.when(F.lit(False), ""))
    return d.select("case_id", F.coalesce(*hints.values()).alias("artifact"), source.otherwise("none").alias("hint"))


def _dependency_facts(about: DataFrame) -> DataFrame:
    """Per case the dependency that is the only direct one, the only one of a compared version, or fits the repository."""
    named = ~F.col("gav").isin(*SKIP_DEPENDENCIES)
    compared = (F.col("version") != "") & ((F.col("version") == F.col("baseline_version")) | (F.col("version") == F.col("target_version")))
    # Direct dependencies are counted as listed, so a repeated one is not a single one.
    name, repo = F.lower(F.regexp_extract("gav", "^[^:]*:(.*)$", 1)), F.col("__r")
    tests = {
        "only_dependency": named,
        "version_dependency": named & compared,
        "repo_exact": (repo != "") & (name == repo),
    }
    partial = (repo != "") & (name.contains(repo) | repo.contains(name))
    counted = about.groupBy("case_id").agg(
        *[F.count_if(t).alias(f"{n}_n") for n, t in tests.items()],
        *[F.min(F.when(t, F.col("gav"))).alias(n) for n, t in tests.items()],
        *_single(F.when(partial, F.col("gav")), "repo_partial"),
    )
    return counted.select("case_id", *[F.when(F.col(f"{n}_n") == 1, F.col(n)).alias(n) for n in tests], _one_of("repo_partial").alias("repo_partial"))


def _signal_dependency(deps: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case the dependency its text names most, if it is the only one that is named so often.

    A text meets the different dependencies of its case as one list, so it is copied to no dependency.
    """
    wanted = deps.where(~F.col("gav").isin(*SKIP_DEPENDENCIES, *SKIP_SIGNAL)).groupBy("case_id", "gav").agg(F.count(F.lit(1)).alias("n"))
    text = F.lower(F.coalesce("signal_text", F.lit("")))
    texts = cases.select("case_id", text.alias("__t")).where(F.regexp_replace("__t", r"\s", "") != "")
    met = texts.withColumn("__bare", alnum_token("__t")).join(in_lists(wanted, "case_id", ["gav", "n"], "__deps"), "case_id")

    def score(gav: Column) -> Column:
        bare = alnum_token(F.substring_index(gav, ":", -1))
        times = lambda acc, t: acc + ((F.length("__t") - F.length(F.replace(F.col("__t"), t, F.lit("")))) / F.length(t)).cast("int")
        hits = F.aggregate(signal_tokens(gav), F.lit(0), times)
        return F.when((bare != "") & F.col("__bare").contains(bare), 6).otherwise(0) + hits

    scored = met.select("case_id", F.inline(F.transform("__deps", lambda d: F.struct(d["gav"].alias("gav"), d["n"].alias("n"), score(d["gav"]).alias("s")))))
    levels = scored.where("s > 0").groupBy("case_id", "s").agg(F.sum("n").alias("n"), F.min("gav").alias("gav"))
    best = top_per_key(levels, "case_id", [F.col("s").desc()], 1).where("n = 1")
    return best.select("case_id", F.col("gav").alias("signal_dependency"))


# --- tags -------------------------------------------------------------------------------------------------


def match_tag(versions: DataFrame, tags: DataFrame) -> DataFrame:
    """Best tag of every (repo, version).

    First the fixed prefixes with the dotted and the underscored spelling, by equi-join. Versions left over look
    for the first tag that contains them without a digit, dot or underscore behind: every piece of a tag that may
    end there and is as long as a wanted form is listed, so this is an equi-join too and versions are never paired
    with all tags of a repository.
    """
    v = versions.select("repo", F.col("version").cast("string").alias("version")).distinct()
    usable = v.where((F.col("version") != "") & (F.lower("version") != "unknown"))
    under = F.translate("version", ".", "_")
    forms = F.flatten(
        F.array(*[F.array(F.concat(F.lit(p), F.col("version")), F.concat(F.lit(p), under)) for p in TAG_PREFIXES])
    )
    t = tags.select("repo", "tag", F.col("pos").cast("bigint").alias("pos"))
    names = t.select("repo", "tag").distinct()
    exact = (
        usable.select("repo", "version", F.posexplode(forms).alias("rank", "tag"))
        .join(names, ["repo", "tag"])
        .groupBy("repo", "version")
        .agg(F.min_by("tag", "rank").alias("exact_tag"))
    )
    rest = usable.join(exact.select("repo", "version"), ["repo", "version"], "left_anti")
    rest_forms = rest.select("repo", "version", F.explode(F.array_distinct(F.array(F.col("version"), under))).alias("piece"))
    # Only pieces as long as a form that is still looked for in the repository.
    lengths = rest_forms.groupBy("repo").agg(F.collect_set(F.length("piece")).alias("sizes"))
    size = F.length("tag")
    ends = F.filter(
        F.sequence(F.lit(1), size), lambda e: ~F.substring(F.col("tag"), e + 1, F.lit(1)).rlike(r"^[.\d_]")
    )
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                ends,
                lambda e: F.transform(
                    F.filter("sizes", lambda n: n <= e), lambda n: F.substring(F.col("tag"), e - n + 1, n)
                ),
            )
        )
    )
    listed = t.where(size > 0).join(lengths, "repo").select("repo", "tag", "pos", F.explode(pieces).alias("piece"))
    found = rest_forms.join(listed, ["repo", "piece"]).groupBy("repo", "version").agg(F.min_by("tag", "pos").alias("found_tag"))
    return (
        v.join(exact, ["repo", "version"], "left")
        .join(found, ["repo", "version"], "left")
        .select("repo", "version", F.coalesce("exact_tag", "found_tag", F.lit("unknown")).alias("tag"))
    )


def compare_url(owner: Column, repo: Column, base: Column, head: Column) -> Column:
    known = (base != "unknown") & (head != "unknown") & (owner != "unknown") & (repo != "unknown")
    return F.when(
        known, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/compare/"), base, F.lit("..."), head)
    ).otherwise("unknown")


# --- package prefixes -------------------------------------------------------------------------------------


def minimal_prefixes(packages: DataFrame, key: str = "case_id", package: str = "package") -> DataFrame:
    """Packages not covered by a shorter package of the same key.

    Every package is joined to its own ancestors (its dotted prefixes), never to the other packages of the key.
    """
    p = packages.select(key, F.col(package).alias("package")).where("package <> ''").distinct()
    parts = F.split("package", r"\.")
    ups = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")),
    ).otherwise(F.array().cast("array<string>"))
    above = p.select(key, "package", F.explode(ups).alias("up"))
    covered = above.join(p.select(key, F.col("package").alias("up")), [key, "up"], "left_semi").select(key, "package").distinct()
    return p.join(covered, [key, "package"], "left_anti").withColumns(
        {
            "depth": F.size(parts) - 1,
            "slash_form": F.concat(F.translate("package", ".", "/"), F.lit("/")),
        }
    )


def package_of_import(c: Column) -> Column:
    """Package of an imported name: class and member parts start with a capital."""
    upper = lambda x: F.coalesce(x, F.lit("")).rlike(r"^\p{Lu}")

    def kept(parts: Column) -> Column:
        n = F.size(parts)
        return (
            F.when((n >= 2) & upper(F.get(parts, n - 1)), F.slice(parts, F.lit(1), n - 1))
            .when((n >= 3) & upper(F.get(parts, n - 2)), F.slice(parts, F.lit(1), n - 2))
            .otherwise(parts)
        )

    return F.array_join(let(F.split(F.regexp_replace(clean_text(c), r"\.\*$", ""), r"\."), kept), ".")


def packages_of_artifact(gav: Column) -> Column:
    """ARRAY of package roots guessed from a coordinate."""
    table = F.create_map(*[x for k, v in PACKAGE_FALLBACKS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    g = clean_text(gav)
    group = F.filter(F.split(F.substring_index(g, ":", 1), r"\."), lambda p: p != "")
    name = F.regexp_extract(g, "(?s)^[^:]*:(.*)$", 1)
    words = F.filter(
        F.split(name, "[-_.]+"), lambda p: (p != "") & (alnum_token(p) != "") & ~alnum_token(p).isin(*GENERIC_PARTS)
    )
    same = alnum_token(name) == alnum_token(F.element_at(group, -1))
    guess = F.array_join(F.when(same, group).otherwise(F.concat(group, words)), ".")
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.try_element_at(table, g),
        F.when(g.contains(":") & (F.size(group) > 0), F.array(guess)).otherwise(none),
    )


