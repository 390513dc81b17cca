"""Ranks within keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task ranks at once, about.
CELL_ROWS = 4096


def spread_rank(df: DataFrame, keys: list[str], salt: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: a gapless rank from 0 within ``keys`` (not null).

    A key's rows are dealt by ``salt`` (a hash, equal on every run) into as many cells as its row
    count asks for; cells are ranked apart, each behind the rows of the cells
    before it, so no task sorts a whole key. ``order`` settles the order
    inside a cell.
    """
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cells = F.ceil(F.col("_n") / CELL_ROWS)
    dealt = df.join(totals, keys).withColumn("_cell", F.pmod(salt, cells)).drop("_n")
    sizes = dealt.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)) - 1
    return (dealt.withColumn("_in", inside).join(before, [*keys, "_cell"])
            .withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("long")).drop("_cell", "_in", "_before"))
