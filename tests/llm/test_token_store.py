"""The store against the library's ids, and its index against a dictionary."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flipline.llm import queries, token_store
from tests.llm.test_bpe import ODD


def library_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_index():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 10, 1000, 20_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n)) if n > 10 else np.arange(n, dtype=np.int64)
        moved, slots = token_store.build(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        assert len(moved) == max(1, -(-len(keys) // token_store.LOAD))


def test_round_trip(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choice(["to", "the", "a,", "b\nc", "é", "x" * 60]) for _ in range(80)) for _ in range(60)] + [None, "same", "same"]
    rows = [(rng.randrange(-5, 500) if i % 9 else i * 10**12, t, "z") for i, t in enumerate(texts)] + [(None, "no key", None), (7, "b", ""), (7, "a", "")]
    folder = token_store.new_folder(spark)
    shards = token_store.write(spark.createDataFrame(rows, "doc_id long, text string, start string"), folder)
    out = token_store.read(spark, folder).collect()
    start, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library_ids(t), 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert shards.agg({"n_ids": "sum"}).first()[0] == start
    asked = spark.createDataFrame([(7,), (123456789,), (None,)], "doc_id long")
    assert sorted(r.ids for r in token_store.lookup(asked, folder).collect()) == sorted(
        [*library_ids(t), 0] for d, t, _ in rows if d == 7
    )


def test_query_gives_the_ids_of_the_default_call(spark, tmp_path):
    texts = ["a<|endoftext|> b", "<|endoftext|>", "a b", None, "<|endoftext|><|endoftext|>\n c  d", "<|endoftext", "é <|ENDOFTEXT|> x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t, start, want = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER)), 0, []
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 275]
    assert sorted(map(tuple, queries.op5_token_store(spark, str(tmp_path)).collect())) == want


def test_empty_table(spark):
    folder = token_store.new_folder(spark)
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert token_store.read(spark, folder).collect() == []
