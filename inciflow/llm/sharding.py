"""Put documents into shards by balanced label propagation.

Documents with equal texts are linked through a hub. Every document starts in the shard of its hash. In
each round a hub looks at the shards of its documents and calls them to the one that holds most; calls are
accepted with the probability that the free room of that shard allows, so that hardly a quota is passed.
At the end unlinked documents and the overflow fill the vacancies, which makes the counts exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inciflow.llm.common import HEAVY_SHARE, attach, number_rows, stored

#: Cells of hashed ids inside which rows are numbered.
CELLS = 1024


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _lookup(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def propagate(linked: DataFrame, quota: list[int], total: int, rounds: int) -> DataFrame:
    """(id, hub, ..., shard) after `rounds` rounds. `hub_n` is the number of documents of a hub."""
    shards = len(quota)
    state = linked.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), "hub", F.floor(F.xxhash64("id") / F.lit(2**62))), F.lit(shards)).cast("int"))
    for turn in range(rounds):
        votes = state.groupBy("hub", "shard").agg(F.count("*").alias("votes"), F.first("hub_n").alias("hub_n"))
        load = {r["shard"]: r["n"] for r in votes.groupBy("shard").agg(F.sum("votes").alias("n")).collect()}  # a row per shard
        room = [max(0, q - load.get(s, 0)) for s, q in enumerate(quota)]
        # full shards are no targets but for the documents that are there; equal votes fall to the smaller hash
        pull = F.struct(F.col("votes"), F.xxhash64(F.lit(turn), "hub", "shard"))
        best = votes.filter((_lookup(room, F.col("shard")) > 0) | (F.col("votes") * 2 > F.col("hub_n"))).groupBy("hub").agg(F.max_by("shard", pull).alias("goal"), F.max("votes").alias("there"), F.max("hub_n").alias("hub_n"))
        # a hub whose shards are all full is called to any shard, by the free room
        steps = [sum(room[: s + 1]) for s in range(shards)]
        calls = votes.groupBy("hub").agg(F.max("hub_n").alias("n")).join(best, "hub", "left")
        anywhere = sum((F.lit(1) * (F.pmod(F.xxhash64(F.lit("any"), F.lit(turn), "hub"), F.lit(max(1, steps[-1]))) >= x).cast("int") for x in steps[:-1]), F.lit(0))
        calls = calls.select("hub", F.col("n").alias("hub_n"), F.coalesce("goal", anywhere).alias("goal"), F.coalesce("there", F.lit(0)).alias("there"))
        calls = stored(calls, "shard-calls")
        coming = {r["goal"]: r["n"] for r in calls.groupBy("goal").agg(F.sum(F.col("hub_n") - F.col("there")).alias("n")).collect()}
        odds = [1.0 if coming.get(s, 0) <= room[s] else room[s] / coming[s] for s in range(shards)]
        accepted = F.pmod(F.xxhash64(F.lit("odds"), F.lit(turn), "hub"), F.lit(10**6)) < _lookup(odds, F.col("goal")) * 10**6
        calls = calls.filter(accepted).select("hub", "hub_n", "goal").withColumnRenamed("hub_n", "called_n")
        moved = attach(state, calls, ["hub"], "called_n", HEAVY_SHARE * total, ["id"])
        state = stored(moved.withColumn("shard", F.coalesce("goal", "shard")).select(*state.columns), "shard-state")
    return state


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, hub: counts of shards are at most one apart.

    `slot` counts from 0 in each shard. Groups (equal texts; null counts as empty) above half a quota are
    dealt to several hubs by a hash of the id, so that every hub fits a shard. Repeated rows count each; null
    doc_ids are ordinary rows; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("text_md5"))
    # an id per row: repeats of a row get numbers of their own
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_md5").orderBy("size"))
    rows = stored(rows.withColumn("id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_md5", nth.cast("string"))), "shard-rows")
    total = rows.count()
    quota = quotas(total, shards)
    groups = rows.groupBy("text_md5").agg(F.count("*").alias("group_n")).filter("group_n > 1")
    joined = attach(rows, groups, ["text_md5"], "group_n", HEAVY_SHARE * total, ["id"])
    half = max(1, quota[-1] // 2)
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.ceil(F.col("group_n") / half)).cast("long")
    joined = stored(joined.withColumn("hub", F.when(F.col("group_n").isNotNull(), F.concat_ws("/", "text_md5", part.cast("string")))), "shard-linked")
    linked = joined.filter("hub IS NOT NULL")
    sizes = linked.groupBy("hub").agg(F.count("*").alias("hub_n"))
    linked = attach(linked, sizes, ["hub"], "hub_n", HEAVY_SHARE * total, ["id"])
    state = propagate(stored(linked.select("id", "hub", "hub_n", "doc_id", "size", "text_crc32"), "shard-hubs"), quota, total, rounds)
    columns = ["id", "doc_id", "size", "text_crc32", "hub"]
    cell = F.pmod(F.xxhash64(F.lit("cell"), "id"), F.lit(CELLS)).cast("int")
    # whole hubs first, so that the overflow of a shard cuts as few hubs as can be
    placed = number_rows(state.withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "hub"), F.lit(CELLS)).cast("int")).withColumn("sub", cell), ["cell", "sub"], [F.col("hub"), F.col("id")], "slot", ["shard"])
    placed = stored(placed.withColumn("stays", F.col("slot") < _lookup(quota, F.col("shard"))), "shard-placed")
    filled = {r["shard"]: r["n"] for r in placed.filter("stays").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = joined.filter("hub IS NULL").select(*columns).unionByName(placed.filter("NOT stays").select(*columns))
    free = number_rows(free.withColumn("cell", cell), ["cell"], [F.col("id")], "n")
    ends, starts, at = [], [], 0
    for s in range(shards):
        starts.append(at)
        at += quota[s] - filled.get(s, 0)
        ends.append(at)
    shard = sum(((F.col("n") >= F.lit(e)).cast("int") for e in ends[:-1]), F.lit(0))
    free = free.withColumn("shard", shard).withColumn("slot", F.col("n") - _lookup(starts, F.col("shard")) + _lookup([filled.get(s, 0) for s in range(shards)], F.col("shard")))
    out = placed.filter("stays").select(*columns, "shard", "slot").unionByName(free.select(*columns, "shard", "slot"))
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "hub")
