"""URL filters: host and path rules and listed URLs, met through a blocked Bloom filter and an exact hash join.

Rules and listed URLs are one table of keys: a rule's key is its host and path, a listed URL's key its canonical
form. Each URL asks for its own canonical form and for the host suffixes and path prefixes that have the shape
(labels of the host, length of the path) of some rule. The filter, some bits for each key in blocks of 256 bits,
lets few other keys through; these meet the exact table in a hash join, which removes false positives. URLs of
which no key passes are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inciflow.llm.common import HEAVY_SHARE, attach, stored

#: The contract's rules (fixed values): verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Odd multipliers below 2^31; each sets one bit of one of the block's eight words.
SALTS = [0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31]
#: Bits for each key, and the most blocks of 32 bytes: 16 MB. With more keys more false ones pass, which the join removes.
BITS, MOST_BLOCKS = 16, 1 << 19
#: Shapes of rules above this number are refused: each costs every URL a key.
MOST_SHAPES = 256
#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' for null or no ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without trailing /, other query parameters in order; null without ://.

    Scheme, fragment and the parameters of `TRACKING` don't count.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"(?s)^www\.(?=.)", ""), r"(?s):(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    rest = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise("")))


def rule_key(host: Column, path: Column) -> Column:
    """Keys of rules and of listed URLs never meet: a canonical URL has no line break in front."""
    return F.concat(F.lit("\n"), host, F.lit("\n"), path)


def asked_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys of the rules that may fit: for each shape the suffix of so many labels with the prefix of so many characters."""
    able = [
        F.when((F.size(F.split(host, r"\.")) >= labels) & (F.char_length(path) >= length) & (host != ""), rule_key(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))
        for labels, length in shapes
    ]
    return F.array_compact(F.array(*able)) if able else F.array().cast("array<string>")


class BlockedBloom:
    """Filter of 64-bit hashes: `words` has eight 32-bit words for each block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, keys: DataFrame, bits: int = BITS, most_blocks: int = MOST_BLOCKS) -> BlockedBloom:
        """Of the distinct values of column `key`. Blocks are filled in Spark; the driver gets each block once."""
        number = keys.count()
        blocks = max(1, min(most_blocks, -(-number * bits // 256)))
        parts = keys.select(F.xxhash64("key").alias("h")).select(F.expr("h & 4294967295L").alias("low"), F.shiftrightunsigned("h", 32).alias("high"))
        words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright((low * {salt}L) & 4294967295L, 27) as int))")).alias(f"w{i}") for i, salt in enumerate(SALTS)]
        filled = parts.groupBy(F.expr(f"shiftright(high * {blocks}L, 32)").alias("block")).agg(*words).toArrow()
        table = np.zeros((blocks, 8), dtype=np.uint32)
        if filled.num_rows:
            table[filled["block"].to_numpy()] = np.stack([filled[f"w{i}"].to_numpy() for i in range(8)], axis=1)
        return cls(table)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        block = (high * np.uint64(len(self.words))) >> np.uint64(32)
        found = np.ones(len(h), dtype=bool)
        for i, salt in enumerate(SALTS):
            bit = ((low * np.uint64(salt)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            found &= (self.words[block, i] >> bit.astype(np.uint32)) & 1 == 1
        return found


def passing(spark: SparkSession, rows: DataFrame, bloom: BlockedBloom) -> DataFrame:
    """`rows` with column `keys` (array of strings) cut down to those that the filter lets through."""
    sent = spark.sparkContext.broadcast(bloom.words)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = BlockedBloom(sent.value)
        for batch in batches:
            names = batch.schema.names
            hashes = batch.column(names.index("hashes"))
            starts, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy(zero_copy_only=False)
            found = held.may_hold(flat[starts[0] : starts[-1]])
            ends = np.concatenate([[0], np.cumsum(found)])[starts - starts[0]]
            at = np.flatnonzero(found) + starts[0]
            keys = batch.column(names.index("keys"))
            cut = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.values.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([cut if n == "keys" else c for n, c in zip(names, batch.columns, strict=True) if n != "hashes"], [n for n in names if n != "hashes"])

    hashed = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    return hashed.mapInArrow(probe, rows.schema)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of `pages` (page_id, url).

    `rules` has verdict, host and path, one row per host and path. The longest rule that fits (host and path
    together, then the longer host) decides. Without one, URLs whose canonical form is in `listed` (url, as
    `canonical` writes it) are blocked and all others allowed. A null url, or one without ://, has an empty host
    and path, fits no rule and is allowed. Rows with equal or null page_id are judged each; an empty table gives
    no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    shapes = [tuple(r) for r in rules.select(F.size(F.split("host", r"\.")), F.char_length("path")).distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"rules have more than {MOST_SHAPES} shapes")
    text = F.concat("host", "path")
    known = rules.select(rule_key(F.col("host"), F.col("path")).alias("key"), text.alias("rule"), F.char_length("host").alias("wide"), "verdict")
    own = listed.filter(F.col("url").isNotNull()).select(F.col("url").alias("key")).distinct()
    none = F.lit(None)
    table = stored(known.unionByName(own.select("key", none.cast("string").alias("rule"), F.lit(0).alias("wide"), F.lit("block").alias("verdict"))), "url-keys")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("url"))
    asked = F.array_compact(F.concat(asked_keys(F.col("host"), F.col("path"), sorted(shapes)), F.array("url")))
    rows = rows.select("page_id", "host", "path", asked.alias("keys"))
    rows = stored(passing(spark, rows, BlockedBloom.build(table.select("key"))).withColumn("row", F.monotonically_increasing_id()), "url-hits")
    out = ["page_id", "host", "path", "rule", "verdict"]
    missed = rows.filter(F.size("keys") == 0).select("page_id", "host", "path", none.cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    hits = rows.filter(F.size("keys") > 0).select("row", "page_id", "host", "path", F.explode("keys").alias("key"))
    met = hits.groupBy("key").agg(F.count("*").alias("met"))
    limit = HEAVY_SHARE * (met.agg(F.sum("met")).first()[0] or 0)
    exact = attach(hits, table.join(met, "key"), ["key"], "met", limit, ["row"])
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.coalesce(F.char_length("rule"), F.lit(-1)).alias("length"), "wide", "rule", "verdict"))).alias("best")
    judged = exact.groupBy("row", "page_id", "host", "path").agg(best)
    return missed.select(*out).unionByName(judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))


def unstable_urls(pages: DataFrame) -> DataFrame:
    """url: canonical URLs under which pages hold different html, so that a URL does not say what is read there.

    Pages without html or a canonical URL are not compared.
    """
    rows = pages.select(canonical(F.col("url")).alias("url"), F.sha2("html", 256).alias("digest")).dropna()
    return rows.groupBy("url").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least != most").select("url")


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def _canonical_sql(host: str, path: str, url: str) -> str:
    query = f"list_filter(string_split(regexp_extract({url}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda p: p != '' AND NOT regexp_matches(p, '{TRACKING}'))"
    bare = f"regexp_replace(regexp_replace({host}, '(?s)^www\\.(.)', '\\1'), '(?s):(80|443)$', '')"
    return f"{bare} || regexp_replace({path}, '/+$', '') || coalesce('?' || nullif(array_to_string(list_sort({query}), '&'), ''), '')"


JUDGE_SQL = f"""
WITH cut AS (
  SELECT page_id, url, html, contains(coalesce(url, ''), '://') AS whole,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (SELECT *, CASE WHEN whole THEN {_canonical_sql('host', 'path', 'url')} END AS own FROM cut),
listed AS (SELECT own FROM named WHERE own IS NOT NULL GROUP BY own HAVING count(DISTINCT html) > 1),
rules AS (SELECT * FROM (VALUES {', '.join(str(r) for r in RULES)}) r(verdict, rule_host, rule_path)),
fits AS (
  SELECT n.page_id, n.url, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(verdict, len(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM named) n JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n.page_id, n.url)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, CASE WHEN l.own IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fits f ON n.page_id IS NOT DISTINCT FROM f.page_id AND n.url IS NOT DISTINCT FROM f.url LEFT JOIN listed l ON n.own = l.own
"""
