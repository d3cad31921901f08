"""Audit of text filters in every order: folds of failure masks over all orders, merged by elementwise sums.

A document's mask has a bit for each filter that it fails. Documents of one part and mask behave alike, so they
are one cell with its counts. Each cell folds across the array of all orders (`transform` over the orders,
`aggregate` over an order's steps), which gives one weighted struct for each order and step; the structs of a
part's cells are added element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inciflow.llm.common import HEAVY_SHARE, attach

FILTERS = "ABCDE"
#: What is counted at each step of an order.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_failures(text: Column) -> Column:
    """Mask of the filters A to D, which need the text alone (A is bit 1, B bit 2, C bit 4, D bit 8)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    fails = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic (0 or 1): one row per labelled id; a repeated id is good or toxic if any of its rows is."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters that they fail.

    Filter E fails where a smaller doc_id has the same text. Rows of equal text meet by its SHA-256, first with
    their own counts and their least doc_id, so that a text with very many copies is a few rows by then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text")).alias("own"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("met"))
    marks = rated(labels).join(ids, "doc_id")
    limit = HEAVY_SHARE * docs.count()
    rows = attach(rows, marks, ["doc_id"], "met", limit, ["digest"])
    alike = ["digest", "part", "own", "good", "toxic"]
    rows = rows.select("doc_id", "digest", "part", "own", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    one = rows.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    # the rows of the least doc_id are not copies; null ids are neither smaller nor larger than any
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = one.groupBy(*alike).agg(F.sum("n").alias("n"), first, F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passed = F.col("without") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    halves = F.array(F.struct(F.col("own").alias("mask"), F.col("passed").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    split = groups.withColumn("least", least).withColumn("passed", passed).select("part", "good", "toxic", F.explode(halves).alias("half"))
    weigh = lambda c: F.sum(F.col("half.n") * F.col(c)).alias(c)
    return split.groupBy("part", F.col("half.mask").alias("mask")).agg(F.sum("half.n").alias("n"), weigh("good"), weigh("toxic"))


def orders(filters: str = FILTERS) -> Column:
    """All orders, each as the bits of its filters in turn: an array literal of 120 arrays of five."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return F.array(*[F.array(*[F.lit(bit[f]) for f in order]) for order in permutations(filters)])


def folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """One struct of counts for each order and step, for `n` documents that fail the filters in `mask`."""
    zero = F.lit(0).cast("long")

    def step(seen: Column, bit: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(seen) != 0
        here = fails & ~gone
        return F.struct(
            F.when(fails | gone, zero).otherwise(n).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"), F.when(fails & gone, n).otherwise(zero).alias("redundant"),
            F.when(mask == bit, n).otherwise(zero).alias("unique_fails"), F.when(here, good).otherwise(zero).alias("good_lost"), F.when(here, toxic).otherwise(zero).alias("toxic_lost"),
        )

    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(0).alias("seen"), F.array().cast(kind).alias("steps"))

    def add(state: Column, bit: Column) -> Column:
        seen = state["seen"]
        return F.struct(seen.bitwiseOR(bit).alias("seen"), F.concat(state["steps"], F.array(step(seen, bit))).alias("steps"))

    return F.flatten(F.transform(orders(), lambda order: F.aggregate(order, start, add, lambda state: state["steps"])))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null lang the part ''. Repeated rows count each; rows that share the least doc_id of
    a text are no copies of each other, nor is a row without doc_id a copy. An empty table gives no rows; other
    columns are ignored, as are labels without doc_id. A part has at most 32 cells.
    """
    cells = mask_cells(docs, labels).withColumn("steps", folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")))
    total = lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])
    parts = cells.groupBy("part").agg(F.collect_list("steps").alias("all"))
    parts = parts.select("part", F.aggregate(F.slice("all", 2, 32), F.element_at("all", 1), lambda x, y: F.zip_with(x, y, total)).alias("steps"))
    letters = ["".join(order) for order in permutations(FILTERS)]
    names = F.array(*[F.lit(x) for x in letters])
    rows = parts.select("part", F.posexplode("steps").alias("at", "counts"))
    rows = rows.withColumn("filter_order", F.element_at(names, (F.floor(F.col("at") / 5) + 1).cast("int"))).withColumn("step", (F.col("at") % 5 + 1).cast("int"))
    own = F.col("filter_order").substr(F.col("step"), F.lit(1))
    shapley = F.sum("counts.removed").over(Window.partitionBy("part", own))
    return rows.select("part", "filter_order", "step", *[F.col(f"counts.{c}").alias(c) for c in COUNTS], shapley.alias("shapley"))


#: The same rows, document by document.
AUDIT_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
first_ids AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
rated AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT w.part, coalesce(r.good, false) AS good, coalesce(r.toxic, false) AS toxic,
         (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * list_unique(words) < 80 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 10 * length(w.text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN f.least < w.doc_id THEN 'E' ELSE '' END) AS fails
  FROM worded w JOIN first_ids f ON w.text = f.text LEFT JOIN rated r ON w.doc_id = r.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM judged GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step)),
played AS (
  SELECT c.*, s.*, contains(fails, own) AS failing, len(regexp_replace(fails, '[' || earlier || '-]', '', 'g')) < len(fails) AS gone
  FROM cells c, steps s),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(coalesce(sum(n) FILTER (WHERE NOT failing AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE failing AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n_good) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n_toxic) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM played GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
