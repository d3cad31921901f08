"""Line dedup on levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, max_doc) sorted by hash; no two runs hold the same line. Each batch of
documents merge-anti-joins the runs: lines that none holds become a run of level 0, and lines that are held
add their counts beside the runs. `fanout` runs of a level are compacted into one of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inciflow.llm.common import HEAVY_SHARE, attach, packed, stored, unpacked, work_path

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of the lines whose key has `min_chars` code points or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return lines.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """Levelled runs in a shared folder. `levels[i]` lists the paths of the runs of level i, `additions` those of counts."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels, self.root = spark, fanout, [], work_path(spark, "line-runs")
        self.additions, self.written = [], 0

    def _write(self, run: DataFrame, folder: str) -> str:
        path, self.written = f"{self.root}/{folder}/run={self.written}", self.written + 1
        run.sortWithinPartitions(*HASH).write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long, max_doc long").parquet(*paths)

    @property
    def _paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _push(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _compact(self) -> None:
        """Runs hold different lines, so those of a full level become one by sorting alone."""
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(self._write(self._read(full).repartition(*HASH), f"level={level + 1}"), level + 1)
            level += 1

    def add(self, lines: DataFrame) -> None:
        """Count a batch, which shares no document with others: new lines are a run, held lines add their counts."""
        once = lines.groupBy(*HASH, "doc_id").agg(F.lit(1).cast("long").alias("n_docs"))
        counted = once.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("doc_id").cast("long").alias("max_doc"))
        if self._paths:
            batch = self._read([self._write(counted, "batch")])
            fresh = self._write(self.unseen(batch), "level=0")
            self.additions.append(self._write(batch.join(self._read([fresh]).select(*HASH), HASH, "left_anti"), "additions"))
        else:
            fresh = self._write(counted, "level=0")
        self._push(fresh, 0)
        self._compact()

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines of a batch that no run holds: a merge anti join with each run."""
        for path in self._paths:
            lines = lines.join(self._read([path]).select(*HASH).hint("merge"), HASH, "left_anti")
        return lines

    def admit(self, lines: DataFrame) -> DataFrame:
        """The incremental rule: the lines of a batch that are new, after which the batch counts as seen."""
        fresh = stored(self.unseen(lines), "line-fresh")
        self.add(fresh)
        return fresh

    def all(self) -> DataFrame:
        """Each line once, with the documents of all batches; only lines of several batches are added up."""
        runs = self._read(self._paths)
        if not self.additions:
            return runs
        more = self._read(self.additions).groupBy(*HASH).agg(F.sum("n_docs").alias("n_more"), F.max("max_doc").alias("max_more"))
        found = runs.join(more, HASH, "left")
        n_docs = F.col("n_docs") + F.coalesce("n_more", F.lit(0))
        return found.select(*HASH, n_docs.alias("n_docs"), F.greatest("max_doc", "max_more").alias("max_doc"))


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """doc_id, text_hash, drop: the positions of the lines that go."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines = stored(hashed_lines(docs, min_chars).withColumn("batch", batch), "line-hashes")
    runs = LineRuns(docs.sparkSession, fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i))
    frequent = stored(runs.all().filter(F.col("n_docs") >= min_docs), "line-frequent")
    # a key is counted once per document, a document may hold it on many lines: the limit is on documents
    limit = max(1.0, HEAVY_SHARE * lines.select(*HASH, "doc_id").count())
    held = attach(lines, frequent, HASH, "n_docs", limit, ["doc_id", "pos"])
    gone = held.filter(F.col("n_docs").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """`docs` with `kept` (the text without dropped lines), `n_lines`, `n_dropped`; all other columns stay.

    Columns of `docs` with these three names are replaced.

    Keys of `min_chars` code points or more that `min_docs` documents hold lose their lines everywhere but in
    the largest doc_id. A null text is one empty line and is kept as null in `text`. Rows with the same doc_id
    are one document; a null doc_id is below all others. Positions are bound to the text, so repeated
    doc_ids with other texts stay apart. An empty table gives no rows.
    """
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    drops = drops.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("drop").alias("_drop"))
    out = packed(docs, ["doc_id", "text"]).join(drops, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    # one split, bound once: struct(lines, positions)
    parts = F.transform(F.array(F.struct(lines.alias("l"), staying.alias("p"))), lambda x: F.array_join(F.transform(x["p"], lambda i: F.get(x["l"], i)), "\n"))
    kept = F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(parts, F.lit(0)))
    n_lines = 1 + F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))
    n_dropped = F.coalesce(F.size("_drop"), F.lit(0))
    return out.select(*unpacked(docs.columns, ("kept", "n_lines", "n_dropped")), kept.alias("kept"), n_lines.cast("long").alias("n_lines"), F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped"))


LINES_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.max_doc AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
