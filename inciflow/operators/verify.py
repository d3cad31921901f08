"""Is a text a real ingredient list?  Counters, ordered rules and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def looks_like_sentence(token: Column) -> Column:
    return (F.size(F.split(token, T.SPACES + "+")) > 8) | T.has(token, K.SENTENCE_PATTERN, False)


def has_marketing(token: Column) -> Column:
    return T.any_of(F.lower(token), K.MARKETING_WORDS)


def has_emoji(token: Column) -> Column:
    return token.rlike(K.EMOJI_PATTERN)


def percent_only(token: Column) -> Column:
    return T.has(token, K.PERCENT_ONLY_PATTERN, False)


def plausible_inci(name: Column) -> Column:
    v = T.strip(name)
    words = F.filter(F.split(v, T.SPACES + "+"), lambda w: w != "")
    return (
        F.length(v).between(2, 140)
        & ~looks_like_sentence(v)
        & ~has_marketing(v)
        & T.has(v, K.INCI_CHARS_PATTERN)
        & (F.size(words) <= 7)
        & (T.has(v, K.INCI_SUFFIX_PATTERN) | T.has(v, K.INCI_WORDS_PATTERN))
    )


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def token_flags(tokens: DataFrame) -> DataFrame:
    """Per-list counters over raw tokens (list_id, raw_name)."""
    t = F.col("raw_name")
    return tokens.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("raw_count"),
        _count(percent_only(t)).alias("percent_count"),
        _count(looks_like_sentence(t)).alias("sentence_count"),
        _count(has_marketing(t) | has_emoji(t)).alias("marketing_count"),
    )


def support_signal() -> Column:
    """Ingredient rows that a complete formula is expected to have."""
    tags, name = F.col("tags"), F.col("name")
    return (
        F.arrays_overlap(tags, T.str_array(["preservative", "solvent", "surfactant", "emulsifier"]))
        | (name == "water")
        | T.any_of(name, ["alcohol", "extract", "juice"])
    )


def token_facts() -> dict[str, Column]:
    """Facts of one name (raw_name, normalized_input, shown_name, ingredient_id)."""
    raw = F.col("raw_name")
    return {
        "v_key": T.compact_key(F.col("shown_name")),
        "v_plausible": F.col("ingredient_id").isNull() & plausible_inci(F.col("normalized_input")),
        "v_percent": percent_only(raw),
        "v_sentence": looks_like_sentence(raw),
        "v_marketing": has_marketing(raw) | has_emoji(raw),
    }


def counter_aggregates() -> list[Column]:
    """Quality counters over resolved rows; plain sums, combined on the map side."""
    known = F.col("ingredient_id").isNotNull()
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("v_key").alias("ingredient_count"),
        _count(known).alias("matched_count"),
        _count(~known).alias("unknown_count"),
        _count(F.col("v_plausible")).alias("plausible_count"),
        _count(F.col("match_type").isin("alias", "synonym")).alias("alias_count"),
        _count(F.col("v_percent")).alias("percent_count"),
        _count(F.col("v_sentence")).alias("sentence_count"),
        _count(F.col("v_marketing")).alias("marketing_count"),
        F.coalesce(F.bool_or("v_support"), F.lit(False)).alias("has_support"),
    ]


def list_counters(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("list_id").agg(*counter_aggregates())


def _ceil_share(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def verify_lists(counters: DataFrame, min_count: int = K.MIN_LIST_SIZE) -> DataFrame:
    """Ordered rule chain; the first rule that fires decides."""
    raw = F.col("raw_count") if "raw_count" in counters.columns else F.col("row_count")
    rows = F.greatest(F.col("row_count"), F.lit(1))
    effective = (F.col("matched_count") * 10 + F.col("plausible_count") * 7) / (rows * 10)
    n = F.col("ingredient_count")
    rules = [
        ("MIN_INGREDIENT_COUNT", n < min_count, 0.0),
        ("PERCENTAGE_ONLY", F.col("percent_count") >= _ceil_share(raw, 50), 0.08),
        ("SENTENCE_CONTENT", (F.col("sentence_count") >= 2) | (F.col("sentence_count") >= _ceil_share(raw, 30)), 0.1),
        ("MARKETING_COPY", (F.col("marketing_count") >= 2) | (F.col("marketing_count") >= _ceil_share(raw, 25)), 0.1),
        ("LOW_INCI_MATCH", effective < 0.55, 0.2),
        ("MISSING_SUPPORT_SIGNALS", ~F.col("has_support"), 0.22),
    ]
    rule, failed = F.lit("PASSED"), F.lit(None).cast("double")
    for name, cond, conf in reversed(rules):
        rule = F.when(cond, F.lit(name)).otherwise(rule)
        failed = F.when(cond, F.lit(conf)).otherwise(failed)
    rate = F.col("matched_count") / rows
    return (
        counters.withColumn("rule", rule)
        .withColumn("verified", F.col("rule") == "PASSED")
        .withColumn("match_rate", T.two_decimals(rate))
        .withColumn("effective_percent", T.half_up(effective * 100).cast("bigint"))
        .withColumn("match_percent", T.half_up(rate * 100).cast("bigint"))
        .withColumn("failed_confidence", failed)
    )


def reason_text(min_count: int = K.MIN_LIST_SIZE, source: Column | None = None) -> Column:
    n = F.col("ingredient_count").cast("string")
    where = F.coalesce(T.blank(source), F.lit("the source page")) if source is not None else F.lit("the source page")
    return (
        F.when(
            F.col("rule") == "MIN_INGREDIENT_COUNT",
            F.concat(F.lit("Ingredient list is too short to trust. Found "), n, F.lit(f" ingredients, but at least {min_count} are required.")),
        )
        .when(F.col("rule") == "PERCENTAGE_ONLY", "The extracted text looks like percentage claims, not a full ingredient list.")
        .when(F.col("rule") == "SENTENCE_CONTENT", "The extracted text contains sentence-style content instead of INCI entries.")
        .when(F.col("rule") == "MARKETING_COPY", "The extracted section looks like marketing copy, not a verified INCI ingredient list.")
        .when(
            F.col("rule") == "LOW_INCI_MATCH",
            F.concat(F.lit("Only "), F.col("effective_percent").cast("string"), F.lit("% of entries matched known or plausible INCI ingredients.")),
        )
        .when(F.col("rule") == "MISSING_SUPPORT_SIGNALS", "The list lacks the supporting INCI signals expected in a complete cosmetic formula.")
        .otherwise(
            F.concat(F.lit("Verified "), n, F.lit(" ingredients with "), F.col("match_percent").cast("string"), F.lit("% INCI match from "), where, F.lit("."))
        )
    )


def source_points(method: Column, website: Column, brand: Column) -> Column:
    """Confidence hundredths a source earns."""
    brand_hit = (brand != "") & F.lower(website).contains(F.lower(brand))
    return (
        F.when(F.startswith(method, F.lit("official-site")) | brand_hit, 32)
        .when(F.startswith(method, F.lit("trusted-database")), 20)
        .when(F.startswith(method, F.lit("distributor")), 15)
        .when(method.contains("dom") | method.contains("next") | method.contains("json"), 14)
        .when(method.isin("openai-structured-output", "ai-structured-output"), 8)
        .otherwise(0)
    )


def verification_confidence(method: Column, website: Column, brand: Column) -> Column:
    """0.38 plus source and match-rate points minus 0.05 per unknown, in whole hundredths."""
    m, r = F.col("matched_count"), F.greatest(F.col("row_count"), F.lit(1))
    rate = F.when(m * 100 >= r * 90, 18).when(m * 100 >= r * 75, 12).when(m * 100 >= r * 60, 8).otherwise(0)
    points = F.lit(38) + source_points(T.text(method), T.text(website), T.text(brand)) + rate - F.col("unknown_count") * 5
    passed = F.greatest(F.lit(5), F.least(F.lit(99), points)) / 100
    return F.when(F.col("verified"), passed).otherwise(F.col("failed_confidence"))


def analysis_confidence(method: Column, website: Column, brand: Column) -> tuple[Column, Column]:
    """Score 0..100 and its explanation list, from known / unknown row counts."""
    m, r = F.col("matched_count"), F.greatest(F.col("row_count"), F.lit(1))
    site, key = F.lower(T.text(website)), F.trim(F.lower(T.text(brand)))
    method = T.text(method)
    official = F.startswith(method, F.lit("official-site")) | ((key != "") & site.contains(key))
    page = method.isin("html", "playwright")
    points = (
        F.lit(40)
        + F.when(official, 30).when(page, 18).otherwise(0)
        + F.when(m * 10 >= r * 9, 20).when(m * 10 >= r * 7, 12).otherwise(0)
        - F.col("unknown_count") * 5
        - F.when(method == "ocr", 10).otherwise(0)
        - F.when((T.text(website) != "") & ~F.startswith(method, F.lit("official-site")) & (key == ""), 4).otherwise(0)
    )
    percent = T.half_up(m * 100 / r).cast("bigint").cast("string")
    notes = F.array_compact(
        F.array(
            F.when(official, F.lit("Official manufacturer ingredient list found")).when(
                page, F.lit("Ingredient list extracted directly from the product page")
            ),
            F.when(m * 10 >= r * 7, F.concat(percent, F.lit("% ingredient match"))),
            F.lit("Concentration estimated from ingredient order"),
        )
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("bigint"), notes
