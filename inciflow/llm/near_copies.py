"""Groups of documents by SimHash, and by the Jaccard similarity of their word shingles, verified on the whole sets.

SimHash links texts whose fingerprints are close (`simhash.near_duplicates`); pairs of high similarity that differ in
more bits are found by bands and added.

Texts meet in buckets by bands of minimum hashes; every text of a bucket brings its whole set of shingles there, so a
link is an exact similarity. Two texts at the least similarity miss each other with a chance of (1 - s^ROWS)^BANDS, 4
in ten million at 0.8. A bucket gives the links of a spanning forest; Spark joins then spread the smallest label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inciflow.llm.common import HEAVY_SHARE, attach, packed, small_batches, stored, unpacked
from inciflow.llm.simhash import components, near_duplicates

#: Bands of minimum hashes, and minimum hashes of a band.
BANDS, ROWS = 28, 4
#: Texts and shingles of a bucket that one task compares with one another; larger buckets are dealt as pairs of chunks.
CHUNK, CHUNK_SHINGLES = 2048, 1_000_000

_factors = np.array([xxhash.xxh64_intdigest(f"factor {i}".encode(), 42) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)
_shifts = np.array([xxhash.xxh64_intdigest(f"shift {i}".encode(), 42) for i in range(BANDS * ROWS)], dtype=np.uint64)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, and so is one without words."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed numbers, each a hash of ROWS minimum hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _factors + _shifts).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in least.reshape(BANDS, ROWS)], dtype=np.uint64).view(np.int64)


def similar_links(sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs whose sets have a Jaccard similarity of `least` (a fraction) or more."""
    up, down = least
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(ids), dtype=bool)
    # a walk through each tree: texts that none has reached yet are compared with the next one that was
    left, flat, starts = np.arange(len(sets)), ids, ends[:-1]
    open_, out = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            alive = open_[left]
            if not alive.any():
                break
            if 2 * alive.sum() <= len(left):
                flat = flat[np.repeat(alive, size[left])]
                left = left[alive]
                starts = np.r_[0, np.cumsum(size[left])[:-1]]
            mine = ids[ends[x] : ends[x + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[mine] = False
            found = left[(down * both >= up * (size[x] + size[left] - both)) & open_[left]]
            open_[found] = False
            out += [(x, y) for y in found.tolist()]
            queue += found.tolist()
    return out


def links(texts: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): links between the keys of `texts` (key bigint, t binary; unique keys) with the components of all similar pairs."""
    spark = texts.sparkSession

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingles(t, shingle) for t in b.column(1).to_pylist()]
            signs = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), signs], ["key", "size", "bands"])

    signed = stored(texts.select("key", "t").mapInArrow(sign, "key long, size long, bands array<long>"), "copies-bands")
    dealt = signed.select("key", "size", F.posexplode("bands").alias("k", "v"))
    # buckets of several bands that have the same members are one
    members = [F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "key")).alias("y")]
    buckets = dealt.groupBy("k", "v").agg(*members).filter("n > 1")
    buckets = buckets.groupBy("n", "shingles", "x", "y").agg(F.min(F.struct("k", "v")).alias("b")).select("b.k", "b.v", "n", "shingles")
    buckets = stored(buckets, "copies-buckets")
    limit = HEAVY_SHARE * BANDS * signed.count()
    dealt = attach(dealt, buckets, ["k", "v"], "n", max(limit, 1.0), ["key"]).filter("n IS NOT NULL")
    # a large bucket: every pair of its chunks is a cell of its own, so no task holds more than two chunks
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    dealt = dealt.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("chunks = 1 OR other <> chunk")
    dealt = dealt.select("key", "k", "v", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    dealt = stored(dealt, "copies-cells")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingles(t, shingle).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["key", "s"])

    needed = texts.join(dealt.select("key").distinct(), "key", "left_semi").select("key", "t")
    sets = needed.mapInArrow(gather, "key long, s binary")
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(sets, "key").repartition(cells, "k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, keys, held = None, [], []
        for frame in frames:
            for key, k, v, lo, hi, s in frame[["key", "k", "v", "lo", "hi", "s"]].itertuples(index=False, name=None):
                if (k, v, lo, hi) != cell:
                    yield from solve(keys, held)
                    cell, keys, held = (k, v, lo, hi), [], []
                keys.append(key)
                held.append(np.frombuffer(s, dtype=np.uint64))
        yield from solve(keys, held)

    def solve(keys: list, held: list) -> Iterator[pd.DataFrame]:
        found = similar_links(held, least) if len(keys) > 1 else []
        if found:
            yield pd.DataFrame([(min(keys[a], keys[b]), max(keys[a], keys[b])) for a, b in found], columns=["a", "b"])

    return dealt.mapInPandas(run, "a long, b long").distinct()


def groups(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, component_id: one row per row of `docs`; the component is the smallest doc_id reachable by similar pairs.

    Pairs are similar by SimHash, as `near_duplicates` links them, or by a Jaccard similarity of `least` or more.

    Texts without words (null, empty, white space) are equal; texts shorter than a shingle are one shingle. Null
    doc_ids never name a component unless it has no other. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.cast("binary").alias("t"))
    # copies of a text are one text
    counted = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_doc")), "copies-texts")
    one = rows.dropDuplicates(["key"]).select("key", "t")
    hashed = near_duplicates(one.select(F.col("key").alias("doc_id"), F.col("t").cast("string").alias("text")))
    close = hashed.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    labels = components(close.unionByName(links(one, shingle, least)))
    named = counted.join(labels, counted["key"] == labels["node"], "left").select("key", "n", "least_doc", F.coalesce("label", "key").alias("label"))
    named = stored(named, "copies-named")
    smallest = named.groupBy("label").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("members"))
    limit = HEAVY_SHARE * max(1, docs.count())
    named = attach(named, smallest, ["label"], "members", limit, ["key"])
    return attach(rows.drop("t"), named.select("key", "n", "component_id"), ["key"], "n", limit, ["doc_id"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose doc_id names its component: one document of each group stays.

    Of rows that repeat the doc_id all stay; a component of null doc_ids alone stays whole.
    """
    found = groups(docs, **options)
    first = found.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_d")).distinct()
    return packed(docs, ["doc_id"]).join(first, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").select(*unpacked(docs.columns))
