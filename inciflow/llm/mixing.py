"""Mix sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the words of its source up to and with it, divided
by the target of the source. Documents are ordered by that time over all sources and taken until the
budget is spent, so each source has come to the same share of its target when the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inciflow.llm.common import WORD, number_rows, packed, stored, unpacked

#: Ranges of virtual time up to 1, about where the budget ends; later ones grow with the time. One task orders the rows of a range.
TIME_RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, source_size) with `rank`, `target`: the budget by weight, none above `repeats` times its source.

    Sources are ranked by code point, null last. The excess of capped sources goes to the rest by weight
    until none is above its cap: one level L with sum(min(cap, L * weight)) = budget. There is one row per
    source here, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    found = ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(every)).withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("rank"), F.col("level")))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return found.select("source", "source_size", "rank", "budget", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of `docs`.

    `share`: the budget as a part of all words. `repeats`: how often a document may be taken at most. The
    shuffle is the order of md5(seed + doc_id), so reruns agree. The last document of the budget is taken
    in part. Null or empty texts have size 0 and are never taken; a null source is a source of its own;
    rows with the same doc_id count each; an empty table gives no rows; other columns are ignored.
    """
    mixed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mixed.alias("r")), "mix-sizes")
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats), "mix-targets")
    # the shuffled order: cells of the hash, so that a hot source is spread over 4,096 tasks
    rows = sized.withColumn("cell", F.conv(F.substring("r", 1, 3), 16, 10).cast("int"))
    order = [F.col("r"), F.col("doc_id"), F.col("size")]
    rows = number_rows(rows, ["cell"], order, "before", ["source"], F.col("size"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "cell").orderBy("before", *order)))
    rows = rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # one row for each time that a document may be taken; texts without words wait in no queue
    turns = rows.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("turn") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    turns = turns.withColumn("finish", finish)
    late = TIME_RANGES + F.floor(F.log2("finish") * TIME_RANGES / 4)
    turns = turns.withColumn("range", F.when(F.col("finish") < 1, F.floor(F.col("finish") * TIME_RANGES)).otherwise(late).cast("int"))
    by_time = [F.col("finish"), F.col("rank"), F.col("turn"), F.col("cell"), F.col("nth")]
    queue = number_rows(turns, ["range"], by_time, "spent", unit=F.col("size"))
    left = F.floor(F.col("budget")) - F.col("spent")
    queue = queue.withColumn("take", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = queue.groupBy("rank", "cell", "nth", "doc_id", "size", "source_size", "target").agg(F.sum("take").cast("long").alias("taken"))
    out = out.select("doc_id", "size", "source_size", "target", "taken")
    return out.unionByName(rows.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is taken (begun repeats count).

    Rows that share a doc_id are taken as often as the one that is taken most.
    """
    taken = mix(docs, **options).filter("taken > 0")
    copies = taken.groupBy("doc_id").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("_n"))
    copies = copies.withColumnRenamed("doc_id", "_d")
    out = packed(docs, ["doc_id"]).join(copies, F.col("doc_id").eqNullSafe(F.col("_d")))
    return out.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*unpacked(docs.columns))


#: The same in DuckDB, over any `documents`.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS r
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, rank, budget,
         least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, ratio * 1e6 + rank) FROM levels WHERE level <= ratio) * weight, CAST(cap AS DOUBLE))) AS target
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.rank, t.budget, t.target,
         row_number() OVER (PARTITION BY s.source ORDER BY r, doc_id, size) AS nth,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY r, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT *, CASE WHEN size = 0 THEN 0.0 ELSE CAST(turn * source_size + before + size AS DOUBLE) / target END AS finish
  FROM placed, (VALUES (0), (1)) AS v(turn)),
queue AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, rank, turn, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM turns)
SELECT doc_id, size, source_size, target,
       CAST(sum(greatest(0, least(size, floor(budget) - spent))) AS BIGINT) AS taken
FROM queue GROUP BY rank, nth, doc_id, size, source_size, target
"""
