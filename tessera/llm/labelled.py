"""Training rows for the classifiers: bounded samples, and the split that keeps held-out labels unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Whether labels of this id are never learnt from: crc32 of the id as text is 2 modulo 4. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def sample_ids(ids: DataFrame, id_col: str, bound: int, salt: int) -> DataFrame:
    """At most ``bound`` distinct ids, those with the least hash: the same on every run, and a uniform choice."""
    return ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(salt), id_col), id_col).limit(bound)
