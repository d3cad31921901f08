"""Order inside groups without putting a whole group into one task.

``rank_in_group`` gives the exact zero-based row number.  The group is first
split into cells by leading order columns; cells are counted (map-side partial
aggregation), the counts are prefix-summed over the few cell rows, and the row
number is taken inside a cell and shifted.  A group that holds a third of all
rows is then spread over as many tasks as it has cells.

``first_per_key`` and ``top_per_group`` rely on partial aggregation and on the
partial group limit Spark plans for ``row_number() <= k``: both shrink a hot
group on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def rank_in_group(
    df: DataFrame, group: Sequence[str], coarse: Sequence[str], fine: Sequence[Column], out: str = "position", store: bool = False
) -> DataFrame:
    """store: write what lies ahead of each cell before the rows are ranked, so that the shuffles of both don't add up on disk."""
    cell = [*group, *coarse]
    sizes = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cell)], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    if store:
        offsets = kept(offsets, "offsets").hint("merge")
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*fine)) - 1
    # nulls are cells of their own
    same = [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(cell)]
    ranked = df.withColumn("_in", inside).join(offsets, same)
    return ranked.withColumn(out, (F.col("_ahead") + F.col("_in")).cast("int")).drop("_ahead", "_in", *[f"_c{i}" for i in range(len(cell))])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key: limited per map task before the shuffle."""
    return top_per_group(df, key, order, 1, "_first").drop("_first")
