"""URL filter: rules decide where they fit, a character language-model ratio decides the rest.

Two variable-order Markov models are learnt from the URLs that rules accept and reject. A character's probability after
its context of up to ORDER characters is smoothed down to shorter contexts in proportion to how many different characters
followed (Witten and Bell), to a uniform one at the end. The score of a URL is the mean over its characters, end mark included,
of the log ratio of both models. The threshold is calibrated on a fold of the rule-decided URLs that the models have not seen.

Everything is DataFrame work. Each position of a URL is one gram, its character with the full context, so counts of shorter
contexts are sums over different grams. Joins of one level with the next hold at most an alphabet of rows per key. The log
ratios of grams meet the positions in a join whose frequent keys are broadcast within a proven bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.llm.common import crc32_mod, cut, join_counted

ORDER = 4
#: One URL in so many is for calibration and not for counting.
FOLDS = 5
#: Probability of any character without context, before anything is counted.
UNIFORM = 1 / 1024
START, END = "\x02", "\x03"
#: Scores fall into cells this wide when the threshold is chosen; beyond the limit they share the last cell.
CELL, CELL_LIMIT = 1 / 64, 8.0
#: Verdict and rule (host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, null if none does; of rules of one length the first."""
    found = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if found is None else found


def _verdict(rule: Column, rules: tuple) -> Column:
    found = F.lit(None).cast("string")
    for verdict, name in rules:
        found = F.when(rule == name, F.lit(verdict)).otherwise(found)
    return found


def _grams(texts: DataFrame) -> DataFrame:
    """One row per character of ``t`` and one for the end: the character with the ORDER before it."""
    chars = F.split(F.concat(F.lit(START * ORDER), F.col("t"), F.lit(END)), "")
    windows = F.transform(
        F.sequence(F.lit(1), F.char_length("t") + 1), lambda i: F.array_join(F.slice(F.col("chars"), i, ORDER + 1), "")
    )
    return texts.withColumn("chars", chars).withColumn("gram", F.explode_outer(windows)).drop("chars")


def _log_ratios(counted: DataFrame) -> DataFrame:
    """(gram, n, llr) from (gram, n, a, b): counts in all URLs, in accepted and in rejected ones to learn from."""
    levels = [counted.select(F.col("gram").alias("key"), "a", "b")]
    for _ in range(ORDER):
        shorter = levels[0].groupBy(F.expr("substring(key, 2)").alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        levels.insert(0, shorter)
    below = None
    for order, level in enumerate(levels):
        context = level.groupBy(F.expr(f"left(key, {order})").alias("context")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb")
        )
        joined = level.withColumn("context", F.expr(f"left(key, {order})")).join(context, "context")
        if below is None:
            joined = joined.withColumns({"qa": F.lit(UNIFORM), "qb": F.lit(UNIFORM)})
        else:
            lower = below.select(F.col("key").alias("suffix"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            joined = joined.withColumn("suffix", F.expr("substring(key, 2)")).join(lower, "suffix")
        smoothed = {
            f"p{x}": F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}")))
            .otherwise(F.col(f"q{x}"))
            for x in "ab"
        }
        below = joined.withColumns(smoothed).select("key", "pa", "pb")
        if order % 2:
            below = cut(below)
    ratios = below.select(F.col("key").alias("gram"), (F.log("pa") - F.log("pb")).alias("llr"))
    return ratios.join(counted.select("gram", "n"), "gram")


def _threshold(cells: list[tuple[int, int, int]]) -> float:
    """The border of least balanced error between (cell, accepted, rejected) counts; of equal ones that nearest to 0."""
    accepted, rejected = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not accepted or not rejected:
        return 0.0
    below_a = below_r = 0
    best = (1.0, 0.0, 0.0)
    for cell, a, r in sorted(cells):
        at = (cell - 0.5) * CELL
        best = min(best, (below_a / accepted + (rejected - below_r) / rejected, abs(at), at))
        below_a, below_r = below_a + a, below_r + r
    return best[2]


def filter_urls(pages: DataFrame, rules: tuple = RULES, whole: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url).

    With ``whole`` the models learn from and score the whole URL, else host and path; rules see host and path alone.
    An empty text has nothing to score: the score is 0 (as for any URL when no rule fits anywhere), and the verdict
    follows from the threshold. A null URL is empty. Null ids, repeated rows and repeated URLs stay; an empty table gives no rows;
    other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text = F.coalesce("url", F.lit("")) if whole else F.concat(host, path)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), text.alias("t"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    kind = _verdict(F.col("rule"), rules)
    texts = cut(
        rows.withColumn("kind", kind).groupBy("t").agg(
            F.count("*").alias("times"), F.count_if(F.col("kind") == "allow").alias("a"), F.count_if(F.col("kind") == "block").alias("b")
        )
    )
    learnt = crc32_mod(F.col("t"), FOLDS) != 0
    positions = _grams(texts.where(F.col("t") != ""))
    counted = cut(
        positions.groupBy("gram").agg(
            F.count("*").alias("n"),
            F.sum(F.when(learnt, F.col("a")).otherwise(0)).alias("a"),
            F.sum(F.when(learnt, F.col("b")).otherwise(0)).alias("b"),
        )
    )
    ratios = cut(_log_ratios(counted))
    total = ratios.agg(F.sum("n")).first()[0] or 0
    met = join_counted(positions.select("t", "gram"), ratios, "gram", "n", total)
    scored = met.groupBy("t").agg((F.sum("llr") / F.count("*")).alias("score"))
    scores = cut(texts.join(scored, "t", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    cell = F.round(F.greatest(F.lit(-CELL_LIMIT), F.least(F.lit(CELL_LIMIT), F.col("score"))) / CELL).cast("int")
    cells = scores.where(~learnt).groupBy(cell.alias("cell")).agg(F.sum("a"), F.sum("b")).collect()  # one row per cell
    threshold = _threshold([tuple(c) for c in cells])
    texts_total = scores.agg(F.sum("times")).first()[0] or 0
    joined = join_counted(rows, scores.select("t", "score", "times"), "t", "times", texts_total)
    by_method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return joined.select("page_id", "host", "path", "rule", F.coalesce(_verdict(F.col("rule"), rules), by_method).alias("verdict"), "score")


def gram_probability(counts: dict[str, int], gram: str) -> float:
    """Smoothed probability of a gram's last character after the rest, from counts of full grams; for checks."""
    p = UNIFORM
    for order in range(len(gram)):
        context, char = gram[len(gram) - 1 - order : -1], gram[-1]
        seen: dict[str, int] = {}
        for g, n in counts.items():
            if n and g[len(g) - 1 - order : -1] == context:
                seen[g[-1]] = seen.get(g[-1], 0) + n
        if seen:
            p = (seen.get(char, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
    return p


def score_text(accepted: dict[str, int], rejected: dict[str, int], text: str) -> float:
    """The score of one text, stated plainly; for checks on small tables."""
    if not text:
        return 0.0
    padded = START * ORDER + text + END
    grams = [padded[i : i + ORDER + 1] for i in range(len(text) + 1)]
    return math.fsum(math.log(gram_probability(accepted, g) / gram_probability(rejected, g)) for g in grams) / len(grams)
