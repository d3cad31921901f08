"""Helpers that several operators share: work folders, skew-proof lookups, numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than this share of all rows is "heavy"; there are at most 1 / share of them, so they can be broadcast.
HEAVY_SHARE = 0.001
#: The folder of a local session that has none set: made once.
_own_folder: list[str] = []


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where it is unset, a local session gets a temporary folder; any other session is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(f"file://{tempfile.mkdtemp(prefix='inciflow-')}")
    return _own_folder[0]


def packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns in the struct `row`, and those named beside it: no name of a helper column can clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[df[c] for c in columns])


def unpacked(names: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of `row`, but for those that the operator's own replace."""
    return [F.col("row")[n].alias(n) for n in names if n not in without]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, limit: float, spread: list[str]) -> DataFrame:
    """Left join on `keys` that no hot key can skew.

    `right` has unique, non-null keys; `weight` is the number of left rows that each key meets. Keys above
    `limit` are broadcast (the caller sets the limit so that few can exist); left rows that found one are
    dealt by `spread` in the second join. Columns of `right` are null where nothing matched.
    """
    values = [c for c in right.columns if c not in keys]
    heavy = right.filter(F.col(weight) > limit).select(*keys, F.struct(*values).alias("_h"))
    # always 0, but no literal: with one, the optimizer would take the salt out of the join keys
    zero = F.pmod(F.col(weight), F.lit(1)).cast("int")
    light = right.filter(F.col(weight) <= limit).select(*keys, zero.alias("_salt"), F.struct(*values).alias("_l"))
    met = left.join(F.broadcast(heavy), keys, "left")
    met = met.withColumn("_salt", F.when(F.col("_h").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(65536)).cast("int")).otherwise(0))
    out = met.join(light, [*keys, "_salt"], "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_h.{c}"), F.col(f"_l.{c}")).alias(c) for c in values])


def number_rows(df: DataFrame, cell: list[str], order: list[Column], name: str, group: list[str] | None = None, unit: Column | None = None) -> DataFrame:
    """Gapless numbers from 0 (or running sums of `unit` before a row) in `group`, by `cell` and `order`.

    No group goes through one task: rows are numbered inside cells, and a window over the counted cells
    gives each cell its start. `cell` are columns without nulls that order the cells of a group.
    """
    group = group or []
    unit = F.lit(1).cast("long") if unit is None else unit
    marked = df.withColumn("_u", unit)
    starts = marked.groupBy(*group, *cell).agg(F.sum("_u").alias("_cells"))
    over = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, *cell])], F.coalesce(F.sum("_cells").over(over), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, *cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_in", F.coalesce(F.sum("_u").over(inner), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*group, *cell])]
    out = marked.join(starts, same)
    return out.select(*df.columns, (F.col("_start") + F.col("_in")).alias(name))
