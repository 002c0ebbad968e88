"""Row numbers in a total order without a task that sees all rows, or all rows of a group.

Rows are dealt over range partitions and sorted within each; a row's number is its place in its partition plus the
sizes of the partitions before it. The dealt rows are written once, because the borders of the ranges are sampled and the
sizes have to belong to the same borders. Only one size for each partition is ever gathered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: The lower bits of a monotonically increasing id count the rows of a partition.
_PLACE = (1 << 33) - 1


def _checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)  # sets the folder where it is unset
    return df.checkpoint()


def number_rows(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "row_number", keep: Callable[[DataFrame], DataFrame] = _checkpoint) -> DataFrame:
    """df with ``name``, the number of each row from 1 in the given order, within each group of equal ``keys``.

    Runs at once. ``keep`` writes the dealt rows and returns what was written. Rows that the order leaves tied are numbered in
    any order, so give one that is total; a null key is a group.
    """
    tag = uuid.uuid4().hex[:8]  # no column of df has such a name
    part, place, size, before, first = (f"{n}_{tag}" for n in ("part", "place", "size", "before", "first"))
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
    dealt = keep(dealt)
    sizes = dealt.groupBy(part).agg(F.count("*").alias(size))
    earlier = F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(before))  # one row for each partition
    out = dealt.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(place) + 1).drop(part, place, before)
    if keys:
        starts = out.groupBy(*keys).agg(F.min(name).alias(first)).withColumnsRenamed({k: f"{k}_{tag}" for k in keys})
        same = [out[k].eqNullSafe(starts[f"{k}_{tag}"]) for k in keys]
        out = out.join(starts, same).withColumn(name, F.col(name) - F.col(first) + 1)
    return out.select(*df.columns, name)
