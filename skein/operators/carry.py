"""Last earlier value per key, in blocks: a key that holds most of the rows is still split over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B, _IN, _OLD = "__carry_block", "__carry_in", "__carry_old"


def carry_last(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: Column) -> DataFrame:
    """Add `out`: the last non-null `value` among the earlier rows of the same `keys` in `order`.

    `block` must not decrease along `order`. Inside a block an ordinary window looks back; between blocks only one
    row per (keys, block) is carried on. Null keys form a key of their own; the first row of a key gets null.
    """
    df = df.withColumn(_B, block)
    inner = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct(*order)
    per_block = df.groupBy(*keys, _B).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), last)).alias(_IN))
    outer = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    old = per_block.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(_B).alias("__kb"), F.last(_IN, ignorenulls=True).over(outer).alias(_OLD))
    old = old.filter(F.col(_OLD).isNotNull())
    on = F.col(_B).eqNullSafe(F.col("__kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    with_inner = df.withColumn(_IN, F.last(value, ignorenulls=True).over(inner))
    return with_inner.join(old, on, "left").withColumn(out, F.coalesce(_IN, _OLD)).drop(_B, _IN, _OLD, "__kb", *[f"__k{i}" for i in range(len(keys))])
