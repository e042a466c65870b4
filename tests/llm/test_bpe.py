"""The encoder against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from flipline.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "it's  we'LL", "é è ü", "日本語 テキスト", "😀😀 x", "\x1c\x1d a\x85b", "1234567 12a",
       "a" * 3000, "ab" * 1500, "!?" * 900, "\t\tx = 1;\n\n\ny", "<|endoftext|>", "  a", "der Straße\r\n\r\n", "aaa aaaa aaaaa " * 20]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library():
    own, other, rng = bpe.load(PATH), reference(), random.Random(3)
    texts = list(ODD)
    alphabet = "etaoin shrdlu  ABC\n.,'0189éßñ日😀\t"
    for _ in range(3000):
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))))
    for _ in range(3000):
        texts.append(bytes(rng.randrange(256) for _ in range(rng.randrange(40))).decode("latin-1"))
    for text, packed in zip(texts, own.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == other.encode_ordinary(text), text
        assert own.decode(packed) == text.encode()


def test_no_token_is_left_out():
    own = bpe.load(PATH)
    for token, i in own.ranks.items():
        assert own.encode_bytes(token) == [i]


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "y"), (1, "twice", None), (1, "twice", None)]
    out = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in out)
    want = []
    for d, t, _ in rows:
        ids = reference().encode_ordinary(t or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((str(d), len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), packed))
    assert got == sorted(want)
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
