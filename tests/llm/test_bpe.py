import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def samples():
    r = random.Random(5)
    alphabet = list("abcdefghij KLM'stre 0123456789\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  ​.,!?#é ßñ漢字かな🙂́") + ["<|endoftext|>", "'ll", "  ", "²", "Ⅷ", "\x00"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(400)]
    return texts + ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 700 + " x", "Hello world's I'll  go\n\n", "\n" * 900]


def test_ids_and_text_equal_the_library(lib):
    c = bpe.Codec(PATH)
    for t in samples():
        want = lib.encode(t, add_special_tokens=False).ids
        got = c.encode(t)
        assert got == want, repr(t)
        assert c.decode(got) == lib.decode(want, skip_special_tokens=False)
        n, ids, text = c.digest(t)
        assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert text == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_scan_and_heap_agree():
    c, r = bpe.Codec(PATH), random.Random(1)
    for _ in range(200):
        w = "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 60))).encode()
        assert c._scan(w) == c._heap(w)


def test_frames(spark, lib):
    rows = [(1, "Hello <|endoftext|> there", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (4, "long word " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted(map(tuple, bpe.token_digests(df, PATH).collect()))
    assert [x[:2] for x in out] == [(i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    enc = bpe.encode_texts(df, "byte_bpe_50k.json")
    assert {(r.doc_id, r.text) for r in bpe.decode_ids(enc, PATH).collect()} == {(i, t or "") for i, t, _ in rows}
    assert bpe.token_digests(df.limit(0), PATH).count() == 0
