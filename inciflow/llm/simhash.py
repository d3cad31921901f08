"""SimHash near-duplicates with pivot distance tables.

Fingerprints meet in buckets (blocks of bits that a close pair must share). Every fingerprint carries its
Hamming distances to many reference fingerprints; a pair whose distances to any reference differ by more
than the radius can't be close and is discarded, the rest is verified bit by bit. A bucket gives the links of
a spanning forest and not all pairs; Spark joins then spread the smallest label along the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inciflow.llm.common import HEAVY_SHARE, attach, packed, small_batches, stored, unpacked

#: Members of a bucket that one task compares with one another; larger buckets are dealt as pairs of chunks.
CHUNK = 4096


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the shingles of `text` as a signed 64-bit number; 0 if there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        some = np.array(hashes[at : at + 65536], dtype=">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and all other columns of `docs` but text, with `fp` (bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fp = pa.array([fingerprint(t, shingle) for t in batch.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_text"], fp], [*[n for n in batch.schema.names if n != "_text"], "fp"])

    kept = docs.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.withColumn("_text", F.coalesce("text", F.lit("")).cast("binary")).drop("text").mapInArrow(run, f"{fields}, fp long")


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2 and so on, so every run has the same."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(count)], dtype=np.uint64)


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def close_pairs(left: np.ndarray, right: np.ndarray, table_l: np.ndarray, table_r: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with at most `radius` differing bits; both sides are sorted by their first pivot distance."""
    lo = np.searchsorted(table_r[:, 0], table_l[:, 0].astype(np.int16) - radius, "left")
    hi = np.searchsorted(table_r[:, 0], table_l[:, 0].astype(np.int16) + radius, "right")
    i = np.repeat(np.arange(len(left)), hi - lo)
    j = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    for p in range(1, table_l.shape[1]):  # the maximum coordinate difference, coordinate by coordinate
        near = np.abs(table_l[i, p].astype(np.int16) - table_r[j, p]) <= radius
        i, j = i[near], j[near]
    near = bit_count(left[i] ^ right[j]) <= radius
    return i[near], j[near]


class Forest:
    """Union by smaller position; `link` tells which pairs joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bucket_links(fps: np.ndarray, side: np.ndarray, table: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the close pairs. `side` 0: with all; 1 and 2: a pair of chunks, met across only."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, side, table = fps[order], side[order], table[order]
    l = np.flatnonzero(side <= 1)
    r = np.flatnonzero(side != 1)
    forest, out = Forest(len(fps)), []
    for at in range(0, len(l), rows):
        some = l[at : at + rows]
        i, j = close_pairs(fps[some], fps[r], table[some], table[r], radius)
        for a, b in zip(some[i].tolist(), r[j].tolist(), strict=True):
            if a != b and forest.link(a, b):
                out.append((a, b))
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def links(distinct: DataFrame, radius: int, blocks: int, n_pivots: int) -> DataFrame:
    """(a, b): links between the fingerprints of `distinct` (column fp) that have the components of all close pairs.

    The bits are cut into `blocks`; a pair within `radius` shares at least blocks - radius of them, and each choice
    of so many blocks is a bucket key.
    """
    spark = distinct.sparkSession
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = [sum(masks[b] for b in some) for some in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in keys]
    key = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for n, m in enumerate(signed)]))
    dealt = distinct.select("fp", key.alias("key")).select("fp", "key.k", "key.v")
    sizes = dealt.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1")
    total = stored(sizes, "simhash-buckets")
    limit = HEAVY_SHARE * len(keys) * distinct.count()
    dealt = attach(dealt, total, ["k", "v"], "n", max(limit, 1.0), ["fp"]).filter("n IS NOT NULL")
    # a large bucket: every pair of its chunks is a cell of its own, so no task holds more than two chunks
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), chunks).cast("int")
    dealt = dealt.withColumn("chunks", chunks).withColumn("chunk", chunk)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.withColumn("other", other)
    dealt = dealt.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    dealt = dealt.withColumn("side", F.when(F.col("lo") == F.col("hi"), 0).when(F.col("chunk") == F.col("lo"), 1).otherwise(2))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("k", "v", "lo", "hi", "side", "fp").repartition(cells, "k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi")
    refs = pivots(n_pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            cell = frame[["k", "v", "lo", "hi"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)]) if len(frame) else np.array([], dtype=int)
            if len(starts):
                rest = frame.iloc[starts[-1] :]
                yield from solve(frame.iloc[: starts[-1]], starts)
        if rest is not None and len(rest):
            yield from solve(rest, np.array([0, len(rest)]))

    def solve(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        fps, side = frame["fp"].to_numpy().view(np.uint64), frame["side"].to_numpy()
        if not len(fps):
            return
        table = np.stack([bit_count(fps ^ p) for p in refs], axis=1).astype(np.int8)
        found = [bucket_links(fps[a:b], side[a:b], table[a:b], radius) for a, b in zip(starts, starts[1:], strict=False) if b - a > 1]
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node reachable, by alternating large-star and small-star joins."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "simhash-edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    seen = state(edges)
    for _ in range(rounds):
        # large star: each node hands its larger neighbours to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        large = stored(large, "simhash-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = stored(small, "simhash-small")
        edges, before, seen = small, seen, state(small)
        if before == seen:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5, n_pivots: int = 16) -> DataFrame:
    """doc_id, fp, component_id: one row per row of `docs`; the component is the smallest doc_id reachable.

    Texts without words (null, empty, white space) have fingerprint 0 and are linked like any other; texts shorter
    than a shingle are one shingle. Null doc_ids keep their row and never name a component unless it has no
    other. An empty table gives no rows; other columns are ignored.
    """
    rows = stored(fingerprints(docs.select("doc_id", "text"), shingle), "simhash-fps")
    groups = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_doc")), "simhash-groups")
    labels = components(links(groups.select("fp"), radius, blocks, n_pivots))
    named = groups.join(labels, groups["fp"] == labels["node"], "left").select("fp", "n", "least_doc", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "simhash-named")
    least = named.groupBy("label").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("members"))
    limit = HEAVY_SHARE * max(1, rows.count())
    named = attach(named, least, ["label"], "members", limit, ["fp"])
    return attach(rows, named.select("fp", "n", "component_id"), ["fp"], "n", limit, ["doc_id"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose doc_id names its component: one document of each group stays.

    Of rows that repeat the doc_id all stay; a component of null doc_ids alone stays whole.
    """
    found = near_duplicates(docs, **options)
    first = found.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_d")).distinct()
    return packed(docs, ["doc_id"]).join(first, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").select(*unpacked(docs.columns))
