"""The registered queries of this folder: each applies one operator to its whole table and derives the stated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipline.llm import (
    bpe,
    decontam,
    hard_negatives,
    langid,
    line_dedup,
    secret_crf,
    simhash,
    sparse_suffix,
    token_store,
    toxicity,
    url_lm,
    whitening,
    winnow,
)
from flipline.llm.common import crc32_mod, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _equals(value: str):
    return lambda x: x == value


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_lm.filter_urls(read_table(spark, sf_dir, "pages"), whole=True)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    shown = crc32_mod(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs.where(shown), labels.where(shown))
    held_out = F.coalesce(~shown, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("doc_positions")


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), ids=False)


@query("op5_token_store")
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.new_folder(spark)
    token_store.write(read_table(spark, sf_dir, "documents"), folder, added=True)
    return token_store.read(spark, folder)


@query("op6_winnowing")
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_edited(read_table(spark, sf_dir, "documents"))
    fingerprint = winnow.printed(F.col("entries")).alias("fingerprint")
    edited = winnow.printed(F.col("edited_entries")).alias("edited_fingerprint")
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint, edited, "near_edited", "near_next")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    shown = crc32_mod(F.col("doc_id"), 4) != 2
    model = langid.fit(docs.where(shown))
    held_out = F.coalesce(~shown, F.lit(False)).alias("held_out")
    return langid.detect(docs, model, spans=False).select("doc_id", held_out, "lang_pred", "score")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secret_crf.scan(docs, secret_crf.fit(docs))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "crf"), one), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in secret_crf.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"))


@query("op10_repeated_passages")
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(read_table(spark, sf_dir, "documents")).drop("row_key")


OP11_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id < s.last AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op11_line_dedup", OP11_SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_shared_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW nearest AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER nearest <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(table, F.col("vec_id") % 100 == 0)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))
