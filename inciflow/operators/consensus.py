"""Choose among candidate lists of one product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .ranking import rank_in_group, top_per_group

SCALE = 1_000_000_000


def overlap_scores(items: DataFrame) -> DataFrame:
    """Sum over the other candidates of shared keys / longer list, in 1e-9 units.

    items: group_id, candidate_id, key.  No pair of candidates is formed.  For a
    key held by a candidate of n keys, every other holder of m keys adds
    1 / max(n, m); so per (group, key) it is enough to know how many holders
    have each size: those up to n add 1/n each, longer ones 1/m each.  Both are
    running sums over the sizes.
    """
    held = items.where("key <> ''").select("group_id", "candidate_id", "key").distinct()
    sizes = held.groupBy("group_id", "candidate_id").agg(F.count(F.lit(1)).alias("n"))
    held = held.join(sizes, ["group_id", "candidate_id"])
    share = F.expr(f"{SCALE} div n")
    hist = held.groupBy("group_id", "key", "n").agg(F.count(F.lit(1)).alias("c"))
    by_size = Window.partitionBy("group_id", "key").orderBy("n")
    upto = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    longer = by_size.rowsBetween(1, Window.unboundedFollowing)
    gain = share * (F.sum("c").over(upto) - 1) + F.coalesce(F.sum(F.col("c") * share).over(longer), F.lit(0))
    hist = hist.select("group_id", "key", "n", gain.alias("gain"))
    return held.join(hist, ["group_id", "key", "n"]).groupBy("group_id", "candidate_id").agg(
        F.first("n").alias("n"), F.sum("gain").alias("overlap")
    )


def _micro(c: Column) -> Column:
    return F.floor(F.coalesce(c, F.lit(0.0)) * 1_000_000 + F.lit(0.5)).cast("bigint")


def candidate_totals(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """candidates: group_id, candidate_id, confidence, match_rate, label, raw_text, method, verified."""
    df = candidates.join(overlap_scores(items), ["group_id", "candidate_id"], "left")
    n = F.coalesce("n", F.lit(0))
    low, method = F.lower(T.text(F.col("label"))), T.text(F.col("method"))

    def pts(cond, thousandths):
        return F.when(cond, thousandths * (SCALE // 1000)).otherwise(0)

    prior = (
        F.when(F.startswith(method, F.lit("official-site")), 100)
        .when(F.startswith(method, F.lit("trusted-database")), 70)
        .when(F.startswith(method, F.lit("distributor")), 40)
        .when(method.isin("openai-structured-output", "ai-structured-output"), -50)
        .otherwise(0)
    )
    total = (
        F.coalesce("overlap", F.lit(0))
        + _micro(F.col("confidence")) * 1000
        + _micro(F.col("match_rate")) * 180
        + F.least(n, F.lit(45)) * (SCALE // 100)
        + pts(T.has(low, K.CONSENSUS_FULL), 160)
        - pts(T.has(low, K.CONSENSUS_PARTIAL), 350)
        - pts(T.has(T.text(F.col("raw_text")), K.TRUNCATED), 220)
        + prior * (SCALE // 1000)
        - F.when(F.col("verified"), 0).otherwise(SCALE)
    )
    return df.withColumn("total", total.cast("bigint")).drop("n", "overlap")


def consensus(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Best candidate per group; a lone one as it is, none when all score -1 or less."""
    best = candidate_totals(candidates, items).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.max(F.struct("total", (-F.col("candidate_id")).alias("neg"))).alias("b")
    )
    return best.where((F.col("candidate_count") == 1) | (F.col("b.total") > -SCALE)).select(
        "group_id", (-F.col("b.neg")).alias("candidate_id"), "candidate_count", F.col("b.total").alias("total")
    )


def first_success(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """First stage with a verified candidate wins; its best list by consensus.

    candidates also carry stage (1..4) and official; official sites skip the
    search stages 2 and, apart from model output, 3.
    """
    ai = T.text(F.col("method")).contains("structured-output")
    live = candidates.where(~F.col("official") | ~(F.col("stage").isin(2) | ((F.col("stage") == 3) & ~ai)))
    won = live.where("verified").groupBy("group_id").agg(F.min("stage").alias("stage"))
    pool = live.where("verified").join(won, ["group_id", "stage"])
    kept = items.join(pool.select("group_id", "candidate_id"), ["group_id", "candidate_id"], "left_semi")
    return consensus(pool, kept).join(won, "group_id")


# ------------------------------------------------------------------ attempt reports
def source_report(attempts: DataFrame) -> DataFrame:
    """Per source: pages inspected, matched, with ingredients, verified, last reason.

    attempts: source, ord, matched, has_ingredients, verified, reason.
    """
    def n(c):
        return F.sum(F.when(F.col(c), 1).otherwise(0)).cast("bigint")

    df = attempts.groupBy("source").agg(
        F.count(F.lit(1)).alias("inspected"),
        n("matched").alias("matched_pages"),
        n("has_ingredients").alias("ingredient_hits"),
        n("verified").alias("verified_candidates"),
        F.max_by("reason", "ord").alias("last_reason"),
    )
    part = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    summary = F.concat_ws(
        ". ",
        F.concat(F.col("inspected").cast("string"), F.lit(" pages checked")),
        part("matched_pages", " matched the product"),
        part("ingredient_hits", " ingredient sections found"),
        part("verified_candidates", " verified candidates found"),
    )
    return df.withColumn("summary", F.concat(summary, F.lit(".")))


def top_matches(attempts: DataFrame, k: int = 8) -> DataFrame:
    return top_per_group(attempts, ["source"], [F.col("score").desc(), F.col("ord")], k)


def attempted_sources(attempts: DataFrame) -> DataFrame:
    """fingerprint, pos, label: each `website:method` once, in first-seen order."""
    label = F.concat_ws(":", "website", "method")
    seen = attempts.groupBy("fingerprint", label.alias("label")).agg(F.min("ord").alias("first_ord"))
    return rank_in_group(seen, ["fingerprint"], ["first_ord"], [F.col("label")], "pos").select("fingerprint", "pos", "label")


def failure_summary(attempts: DataFrame) -> DataFrame:
    """Reason of the last attempt; short lists get their own wording."""
    last = attempts.groupBy("fingerprint").agg(F.max(F.struct("ord", "rule", "ingredient_count", "reason")).alias("l"))
    n = F.col("l.ingredient_count")
    short = F.concat(
        F.lit("Found "), n.cast("string"), F.lit(" partial/key ingredient"), F.when(n == 1, "").otherwise("s"),
        F.lit(", but not a complete INCI formula. Continuing to search trusted sources."),
    )
    return last.select("fingerprint", F.when(F.col("l.rule") == "MIN_INGREDIENT_COUNT", short).otherwise(F.col("l.reason")).alias("summary"))
