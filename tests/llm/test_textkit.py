import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import textkit as K


def twins(size):
    """Two words of ``size`` letters that polynomials modulo a power of two cannot tell apart: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hashes(texts, table=None):
    data, off = K.text_buffers(pa.array(texts))
    return K.words(data, off - off[0], K.space_split_table() if table is None else table)


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096, 8192])
def test_structured_words_have_their_own_hashes(size):
    a, b = twins(size)
    h, _, _ = hashes([a, b, a + "x", "x" + a, a[1:]])
    assert len(set(h.tolist())) == 5


def test_equal_words_alone_have_equal_hashes():
    r = random.Random(5)
    vocab = ["".join(r.choice("abAB\x00é9") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(400)]
    vocab += ["".join(x) for n in range(1, 5) for x in itertools.product("a\x00b", repeat=n)]
    texts = [r.choice([" ", "\n\n"]).join(r.choice(vocab) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["", None, " ".join(vocab)]
    h, edge, _ = hashes(texts)
    seen, back = {}, {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = h[edge[i] : edge[i + 1]].tolist()
        assert len(words) == len(own)
        for w, x in zip(words, own, strict=True):
            assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w


def test_blocks_of_a_word_do_not_trade_places():
    parts = ["aaaaaaaa", "bbbbbbbb", "cccccccc", "dddddddd"]
    h, _, _ = hashes(["".join(p) for p in itertools.permutations(parts)])
    assert len(set(h.tolist())) == 24


def test_prefixes_are_those_of_the_word():
    texts = ["abcdefghijk ABCDEFG abcd", "abcdefgz"]
    data, off = K.text_buffers(pa.array(texts))
    w = K.Words(data, off, K.alnum_table())
    at, h = w.prefixes(4)
    assert at.tolist() == [0, 1, 3] and len(set(h.tolist())) == 1
    at, h = w.prefixes(7)
    assert at.tolist() == [0, 3] and len(set(h.tolist())) == 1
    assert w.strings().to_pylist() == ["abcdefghijk", "abcdefg", "abcd", "abcdefgz"]
    assert not np.intersect1d(w.prefixes(8)[1], w.prefixes(4)[1]).size
