"""Benchmark decontamination by templates, in DataFrame operations only.

A text becomes a sequence of words in lower case, where numbers, units after a number and names (capitalised words inside a
sentence) become typed placeholders. Windows of WINDOW template words of the documents meet those of the benchmark in a hash
join. Windows of the plain lower-cased words meet as well, so a copy in other case is found, in which names are not recognised.
Matches that lie on one diagonal (same distance between both places) are one alignment. In it each slot value of the
benchmark item is bound to the value that stands at more than half of its places in the document. A window counts if each of its
slots holds the item's own value or the bound one. So an item whose numbers or names were exchanged throughout is caught, one
edited value costs the windows over it alone, and a mere template in which the values vary is not caught. A pair is reported if
its alignments have enough windows that count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.llm.common import once

WINDOW = 8
#: A pair is reported if it shares this many windows of one item, so WINDOW - 1 more words, or this part of its windows.
LEAST_WINDOWS = 6
LEAST_SHARE = 0.5
#: An item of fewer words than a window, but of this many, is found inside a text too; a shorter one only as the whole text.
LEAST_INSIDE = 3
#: Windows of the benchmark that are broadcast at most; more are joined by shuffling both sides.
BROADCAST_WINDOWS = 200_000
#: Words that are units right after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "dl", "l", "liter", "liters", "litre", "litres", "gallon",
    "gallons", "meter", "meters", "metre", "metres", "gram", "grams", "s", "sec", "second", "seconds", "min", "minute",
    "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "w", "kw", "v", "hz", "kb",
    "mb", "gb", "kmh", "mph",
)
NAME, UNIT = "\x02", "\x03"
#: A capital followed by a small letter, not at the start of a word, sentence or text.
INNER_CAPITAL = (
    r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}\p{N}])(?<![.!?:\n\"'(\[][^\p{L}\p{N}]{0,6})(?<!^[^\p{L}\p{N}]{0,6})"
)
AFTER_NUMBER = r"(?i)(?<=\p{N}[ ]?)(?=(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{M}\p{N}]))"
TOKEN = rf"[{NAME}{UNIT}]?[\p{{L}}\p{{M}}]+|\p{{N}}+(?:[.,]\p{{N}}+)*"


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers of a text; names and units carry a mark before them. Null counts as empty."""
    clean = F.translate(F.coalesce(text, F.lit("")), NAME + UNIT, "  ")
    named = F.regexp_replace(clean, INNER_CAPITAL, NAME)
    marked = F.when(clean.rlike(r"\p{N}"), F.regexp_replace(named, AFTER_NUMBER, UNIT)).otherwise(named)
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def _is_slot(token: Column) -> Column:
    return (F.ascii(token) < 4) | F.ascii(token).between(48, 57)


def template(token: Column) -> Column:
    """A token or the placeholder of its type."""
    code = F.ascii(token)
    return F.when(code == 2, "<name>").when(code == 3, "<unit>").when(code.between(48, 57), "<num>").otherwise(token)


def _rolled(t: Column, window: int) -> Column:
    """The hash of each run of ``window`` of the hashes, one of all of them if there are fewer.

    Runs of twice the length come from two neighbouring ones, the later rotated by a turn of its own, so order counts.
    """

    def joining(step: int, turn: int):
        def joined(a: Column) -> Column:
            def pair(x: Column, i: Column) -> Column:
                y = F.get(a, i + step)
                return x.bitwiseXOR(F.shiftleft(y, turn)).bitwiseXOR(F.shiftrightunsigned(y, 64 - turn))

            return F.transform(F.slice(a, 1, F.size(a) - step), pair)

        return joined

    rolled, span, turn = t, 1, 7
    while span < window:
        step = min(span, window - span)
        rolled = once(rolled, joining(step, turn))
        span, turn = span + step, turn * 2 + 5
    return F.when(F.size(t) >= window, rolled).otherwise(F.array(F.when(F.size(t) > 0, F.xxhash64(t))))


def windows(rows: DataFrame, key: str, window: int = WINDOW, inside: tuple[int, ...] = ()) -> DataFrame:
    """(key, pos, h, n_windows, slots) for every window of ``text``; a text of fewer words is one window of all of them.

    ``slots`` holds a hash of the value of each slot in the window and 0 elsewhere; null if the text has no slot. A window with
    slots is listed a second time with its plain words and null slots. A text without words has one window with a null hash, which
    meets nothing. ``inside`` lists shorter lengths of which plain windows are listed too, in texts of more words.
    """
    worked = rows.select(F.col(key), tokens(F.col("text")).alias("w"))
    value = lambda x: F.when(_is_slot(x), F.xxhash64(x)).otherwise(F.lit(0).cast("long"))
    plain = lambda x: F.xxhash64(F.translate(x, NAME + UNIT, ""))
    slotted = F.exists("w", _is_slot)
    hashed = worked.select(
        key,
        F.transform("w", lambda x: F.xxhash64(template(x))).alias("t"),
        F.when(slotted, F.transform("w", value)).alias("s"),
        F.when(slotted, F.transform("w", plain)).alias("p"),
    )
    short = [_runs(F.coalesce("p", "t"), n) for n in sorted(set(inside))]
    rolled = hashed.select(
        key, "s", _rolled(F.col("t"), window).alias("r"), F.when(F.col("p").isNotNull(), _rolled(F.col("p"), window)).alias("q"),
        *[r.alias(f"short{i}") for i, r in enumerate(short)],
    )
    listed = F.transform(
        "r", lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.slice("s", i + 1, window).alias("slots"))
    )
    no_slots = F.lit(None).cast("array<bigint>").alias("slots")
    bare = lambda h, i: F.struct(i.alias("pos"), h.alias("h"), no_slots)
    again = F.filter(F.transform("q", bare), lambda z: z["h"] != F.get("r", z["pos"]))
    none = F.array().cast("array<struct<pos:int,h:bigint,slots:array<bigint>>>")
    every = F.concat(F.when(F.col("q").isNull(), listed).otherwise(F.concat(listed, again)), *[F.coalesce(F.transform(f"short{i}", bare), none) for i in range(len(short))])
    # The outer form lists the same rows, but keeps the optimiser from testing the whole list for emptiness first.
    return rolled.select(key, F.size("r").alias("n_windows"), F.inline_outer(every))


def _runs(t: Column, length: int) -> Column:
    """The hash of each run of ``length`` of the hashes, as that of a text of so many words; null if there are no more words."""
    starts = lambda n: F.sequence(F.lit(1), n - length + 1)
    return F.when(F.size(t) > length, once(t, lambda a: F.transform(starts(F.size(a)), lambda i: F.xxhash64(F.slice(a, i, length)))))


def _slot_pairs() -> Column:
    """The slots of two windows that met: place in the item, and hashes of the item's and the document's value."""
    zipped = F.transform(
        F.arrays_zip("item_slots", "slots"),
        lambda z, i: F.struct((F.col("item_pos") + i).alias("at"), z["item_slots"].alias("item"), z["slots"].alias("doc")),
    )
    return F.coalesce(F.filter(zipped, lambda p: p["item"] != 0), F.array().cast("array<struct<at:int,item:bigint,doc:bigint>>"))


def _bindings(pairs: Column) -> Column:
    """Hashes of (item's value, document's value) for changed values where the latter stands at over half the former's places."""

    def bound(every: Column) -> Column:
        changed = F.array_distinct(F.transform(F.filter(every, lambda p: p["item"] != p["doc"]), lambda p: p["item"]))

        def binding(value: Column) -> Column:
            seen = F.array_sort(F.transform(F.filter(every, lambda p: p["item"] == value), lambda p: p["doc"]))

            def majority(docs: Column) -> Column:
                middle = F.get(docs, F.floor(F.size(docs) / 2).cast("int"))
                times = F.size(F.filter(docs, lambda d: d == middle))
                return F.when(times * 2 > F.size(docs), F.xxhash64(value, middle))

            return once(seen, majority)

        return F.transform(changed, binding)

    return once(pairs, bound)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_windows: int = LEAST_WINDOWS, least_share: float = LEAST_SHARE
) -> DataFrame:
    """doc_id, item_id, n_shared, n_windows, coverage and doc_positions for each document and benchmark item that it contains.

    n_shared counts the item's different windows that occur in the document, with its own or bound slot values, n_windows those of
    the item; coverage is their ratio; doc_positions are the word positions of the windows in the document, in order. An item of
    fewer words than a window is found as a whole document by its template, and inside a longer one by its plain words if it has at least LEAST_INSIDE. Null and empty texts match nothing; rows with a
    null id, and repeated rows, count under their id once. Empty tables give no rows. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    places = windows(items, "item_id", window).select(
        "item_id", F.col("pos").alias("item_pos"), "h", F.col("n_windows"), F.col("slots").alias("item_slots")
    )
    if places.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        places = F.broadcast(places)
    lengths = items.select(F.size(tokens(F.col("text"))).alias("n")).where(F.col("n").between(LEAST_INSIDE, window - 1)).distinct()
    inside = tuple(r.n for r in lengths.collect())  # fewer than ``window``
    found = windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", window, inside).drop("n_windows")
    met = found.join(places, "h").select(
        "doc_id", "item_id", "item_pos", "n_windows", (F.col("pos") - F.col("item_pos")).alias("diagonal"), _slot_pairs().alias("pairs")
    )
    aligned = met.groupBy("doc_id", "item_id", "diagonal").agg(
        F.collect_set(F.struct("item_pos", "pairs")).alias("met"), F.max("n_windows").alias("n_windows")
    )
    bound = aligned.withColumn("bound", _bindings(F.array_distinct(F.flatten(F.col("met.pairs")))))
    fits = lambda p: (p["item"] == p["doc"]) | F.array_contains("bound", F.xxhash64(p["item"], p["doc"]))
    counted = F.transform(F.filter("met", lambda m: F.forall(m["pairs"], fits)), lambda m: m["item_pos"])
    kept = bound.select("doc_id", "item_id", "diagonal", "n_windows", counted.alias("at")).where(F.size("at") > 0)
    kept = kept.withColumn("doc_at", F.transform("at", lambda i: i + F.col("diagonal")))
    pairs = kept.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_shared"),
        F.max("n_windows").alias("n_windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_at")))).alias("doc_positions"),
    )
    coverage = F.col("n_shared") / F.col("n_windows")
    enough = (F.col("n_shared") >= least_windows) | (coverage >= least_share)
    return pairs.where(enough).select("doc_id", "item_id", "n_shared", "n_windows", coverage.alias("coverage"), "doc_positions")
