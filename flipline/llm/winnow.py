"""Document fingerprints by winnowing, in DataFrame operations only.

A text's words (runs of what is not ASCII white space) give k-gram hashes, rolled as sums over a sliding window. Of each WINDOW
neighbouring hashes the least is kept, the rightmost of equal ones, with its position. Two texts that share a run of at
least WINDOW + K - 1 words share a kept hash of it, whatever surrounds the run. A text with fewer words than K has the one
hash of all its words; one with fewer hashes than WINDOW keeps the least of all; one without words keeps none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipline.llm.common import cut, once

K = 3
WINDOW = 6
#: A kept entry is one long: 33 bits of the hash above 30 bits of the position counted from the far end, so that of equal
#: hashes the rightmost is least. A text has fewer than 2^30 words, since a string has fewer than 2^31 bytes.
POSITION_BITS = 30
#: Documents of one span of ids are neighbours in one task.
SPAN = 64


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The kept entries of a text in order of position, as an array of longs; null counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(w) - (k - 1))
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    def packed(h: Column) -> Column:
        far = F.lit((1 << POSITION_BITS) - 1).cast("long")
        return F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 31), POSITION_BITS).bitwiseOR(far - i.cast("long")))

    def least(p: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(p) - (window - 1))
        kept = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(*[F.get(p, i + j) for j in range(window)]))
        return F.when(F.size(p) > 0, F.array_distinct(kept)).otherwise(p)

    return once(once(once(words, grams), packed), least)


def hashes(entries: Column) -> Column:
    """The different hashes of kept entries."""
    return F.array_distinct(F.transform(entries, lambda e: F.shiftright(e, POSITION_BITS)))


def positions(entries: Column) -> Column:
    """The word positions of kept entries."""
    low = (1 << POSITION_BITS) - 1
    return F.transform(entries, lambda e: F.lit(low).cast("long") - e.bitwiseAND(F.lit(low).cast("long")))


def printed(entries: Column) -> Column:
    """Kept entries as text: ``position:hash`` in hexadecimal, joined by blanks."""
    low = (1 << POSITION_BITS) - 1
    one = lambda e: F.concat_ws(":", F.hex(F.lit(low).cast("long") - e.bitwiseAND(F.lit(low).cast("long"))), F.hex(F.shiftright(e, POSITION_BITS)))
    return F.lower(F.array_join(F.transform(entries, one), " "))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared hashes over the hashes of both (0 to 1); 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and the entries of every row of ``docs``: null texts as empty ones, null ids and repeated rows as they come."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), k, window).alias("entries"))


def _next_span(spans: DataFrame) -> DataFrame:
    """For each span number the next lower one in use, for the lowest the highest.

    Spans are sorted by ranges; within a range the next is beside, and over the borders one row per range tells it.
    """
    ranged = cut(spans.repartitionByRange(F.col("span").desc()).withColumn("part", F.spark_partition_id()))
    beside = ranged.withColumn("next", F.lead("span").over(Window.partitionBy("part").orderBy(F.desc("span"))))
    tops = ranged.groupBy("part").agg(F.max("span").alias("top"))
    order = Window.orderBy(F.desc("top"))  # one row per range
    over = tops.select("part", F.coalesce(F.lead("top").over(order), F.first("top").over(order)).alias("over"))
    return beside.join(F.broadcast(over), "part").select("span", F.coalesce("next", "over").alias("next_span"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) with the text of the next one in descending doc_id, the first one's after the last.

    A null text is empty. Rows without id come after all others, in order of a hash of their text. Rows that repeat an id follow
    each other in order of their text. Texts move once, to the documents of their span of SPAN ids; only the first text of
    each span also goes to the span before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Below the spans of all ids.
    nameless = F.shiftrightunsigned(F.xxhash64("text"), 4) - F.lit(1 << 62)
    rows = rows.withColumn("span", F.when(F.col("doc_id").isNull(), nameless).otherwise(F.floor(F.col("doc_id") / SPAN)))
    order = Window.partitionBy("span").orderBy(F.desc("doc_id"), "text")
    dealt = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    spans = rows.select("span").distinct()
    follow = _next_span(spans)
    heads = dealt.where(F.col("place") == 1).select(F.col("span").alias("next_span"), F.col("text").alias("head_text"))
    last = dealt.where(F.col("next_text").isNull()).join(follow, "span").join(heads, "next_span")
    inner = dealt.where(F.col("next_text").isNotNull()).select("doc_id", "text", "next_text")
    return inner.union(last.select("doc_id", "text", F.col("head_text").alias("next_text")))


def compare_edited(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half is replaced by the start of the next text.

    Returns doc_id, n_chars, edited_sha256, entries and edited_entries, near_edited and near_next.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half))
    marked = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(edited, 256).alias("edited_sha256"),
        fingerprint(F.col("text"), k, window).alias("entries"),
        fingerprint(edited, k, window).alias("edited_entries"),
        fingerprint(F.col("next_text"), k, window).alias("next_entries"),
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "entries", "edited_entries",
        likeness(hashes(F.col("entries")), hashes(F.col("edited_entries"))).alias("near_edited"),
        likeness(hashes(F.col("entries")), hashes(F.col("next_entries"))).alias("near_next"),
    )
