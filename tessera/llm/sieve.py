"""A bit filter of fixed size: which rows of a large table can have a partner in another one, before the large rows are shuffled.

The bits are set by the partners' hashes and held in at most ``WORDS`` rows, whatever the number of partners, so they
may be broadcast. A row without its bit has no partner; a row with it may have one and goes through the
exact join. Many more partners than bits make the filter let everything through, never the reverse.
Columns of the rows may have any names.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: 1 MB of bits.
WORDS = 1 << 17


def _place(key: Column) -> tuple[Column, Column]:
    at = F.pmod(key, F.lit(64 * WORDS))
    return F.floor(at / 64).cast("int"), (at % 64).cast("int")


def _bits(partners: DataFrame, key: Column) -> DataFrame:
    word, at = _place(key)
    return partners.select(word.alias("word"), at.alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))


def split(rows: DataFrame, key: Column, partners: DataFrame, partner_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a partner with an equal key, the others), both with the columns of rows. Keys are 64-bit hashes, not null."""
    new = uuid.uuid4().hex  # no column of rows has such a name
    names = {c: f"{c}_{new}" for c in ("word", "at", "bits")}
    bits = _bits(partners, partner_key).withColumnsRenamed(names)
    word, at = _place(key)
    d = rows.withColumns({names["word"]: word, names["at"]: at}).join(F.broadcast(bits), names["word"], "left")
    maybe = F.expr(f"coalesce(shiftrightunsigned({names['bits']}, {names['at']}) & 1L, 0L) = 1L")
    return d.where(maybe).drop(*names.values()), d.where(~maybe).drop(*names.values())


def bitmap(partners: DataFrame, key: Column) -> np.ndarray:
    """The bits of the partners' keys on the driver, at most WORDS numbers, for use in tasks."""
    got = _bits(partners, key).toArrow()
    out = np.zeros(WORDS, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys have their bit."""
    # the number of bits is a power of two, so the place of a signed key is that of its last bits
    return ((bits[(keys >> np.uint64(6)) & np.uint64(WORDS - 1)] >> (keys & np.uint64(63))) & np.uint64(1)).astype(bool)
