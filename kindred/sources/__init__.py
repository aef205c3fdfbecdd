"""Items of a scan from any DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def items_from(df: DataFrame, name: str, group: str | None = None, silence: str | None = None, tag: str | None = None, order: str | None = None) -> DataFrame:
    """(idx, name, group, silence_lint, tag) of ``df``.

    ``order`` names the column that gives items their place; without it places follow the
    partitions as read. Null groups are the empty group, null flags false.
    """
    idx = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    return df.select(
        idx.alias("idx"),
        F.col(name).cast("string").alias("name"),
        (F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")).alias("group"),
        (F.coalesce(F.col(silence).cast("boolean"), F.lit(False)) if silence else F.lit(False)).alias("silence_lint"),
        (F.col(tag) if tag else F.lit(None).cast("string")).alias("tag"),
    )
