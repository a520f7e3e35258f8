"""Stated sets of any size, joined block by block, so that each broadcast stays bounded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, key: str, size: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of ``run`` over key-ordered blocks of about ``size`` rows. Rows of one key stay
    together; rows with a null key go with the first block."""
    if size < 1:
        raise ValueError("a block holds one row at least")
    done, last = [], None
    while True:
        left = rows if last is None else rows.where(F.col(key) > F.lit(last))
        top, n = left.select(key).orderBy(F.asc_nulls_first(key)).limit(size + 1).agg(F.max(key), F.count(F.lit(1))).first()
        if n <= size or top is None:
            return reduce(DataFrame.unionAll, [*done, run(left)])
        block = left.where(F.col(key) <= F.lit(top))
        done.append(run(block if last is not None else left.where(F.col(key).isNull() | (F.col(key) <= F.lit(top)))))
        last = top
