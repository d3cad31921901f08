"""Safety and suitability of formula lines for a profile.

Scores are sums of short decimals, so they are kept as whole multiples of
1e-5: exact, independent of row order, and plain bigint sums for Tungsten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..sources.tables import kept
from .ranking import first_per_key, top_per_group

UNIT = 100_000


def _codes(arr: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(arr, T.code_key), lambda c: c != ""))


def _no_null(arr: Column) -> Column:
    return F.coalesce(arr, F.array().cast("array<string>"))


def _one_text(codes: Column) -> Column:
    """Codes (A-Z, 0-9 and _) as one text with blanks around each: a search for ` CODE ` costs less than a walk through an array."""
    return F.concat(F.lit(" "), F.array_join(codes, " "), F.lit(" "))


def expand_codes(codes: Column, mapping: dict[str, list[str]]) -> Column:
    """Each code followed by the dimensions it maps to."""
    if not mapping:
        return codes
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), T.str_array(v))])
    return F.flatten(F.transform(codes, lambda c: F.concat(F.array(c), _no_null(F.try_element_at(table, c)))))


# ------------------------------------------------------------------ lines
def position_tier(position: Column, name: Column) -> tuple[Column, Column]:
    """Range label and influence weight in hundredths."""
    label, weight = F.lit(K.POSITION_TIERS[-1][1]), F.lit(int(round(K.POSITION_TIERS[-1][2] * 100)))
    for last, text, w in reversed(K.POSITION_TIERS[:-1]):
        label = F.when(position <= last, text).otherwise(label)
        weight = F.when(position <= last, int(round(w * 100))).otherwise(weight)
    low = (position >= K.LOW_DOSE_FROM) & F.lower(name).isin(K.LOW_DOSE_NAMES)
    return (
        F.when(low, K.LOW_DOSE[0]).otherwise(label),
        F.when(low, int(round(K.LOW_DOSE[1] * 100))).otherwise(weight),
    )


def position_weights(lines: DataFrame, name: str = "raw_name") -> DataFrame:
    label, weight = position_tier(F.col("position"), F.col(name))
    return lines.withColumn("estimated_range", label).withColumn("w", weight)


# ------------------------------------------------------------------ profiles
def _custom_terms(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.text(c), "[,;]+"), T.lower_text), lambda t: t != "")


def _marks(codes: Column, terms: Column, groups: dict[str, list[str]]) -> Column:
    """What a profile shuns, codes before free terms, with the forms that ingredients are asked for: worked out per profile, not per line."""
    known = T.str_array(list(groups))
    spot = lambda code: F.concat(F.lit(" "), T.blank(code), F.lit(" "))
    mark = lambda shown, code, text, fixed: F.struct(shown.alias("shown"), spot(code).alias("spot"), text.alias("text"), fixed.alias("fixed"))
    return F.concat(
        F.transform(codes, lambda c: mark(c, c, F.lower(c), F.array_contains(known, c))),
        F.transform(terms, lambda t: mark(t, T.code_key(t), t, F.lit(False))),
    )


def profile_context(profiles: DataFrame) -> DataFrame:
    """Scoring view of a profile; profile_id plus c_* columns."""
    none = F.array(F.lit("NONE"), F.lit("OTHER"))
    base = profiles.select(
        "profile_id",
        T.code_key(T.text(F.col("skin_type"))).alias("c_skin"),
        T.code_key(F.coalesce(T.blank(F.col("skin_sensitivity")), F.lit("NOT_SENSITIVE"))).alias("c_sens"),
        _codes(_no_null(F.col("concerns"))).alias("c_concerns"),
        _codes(_no_null(F.col("goals"))).alias("c_goals"),
        F.array_except(_codes(_no_null(F.col("allergies"))), none).alias("c_allergy"),
        F.array_except(_codes(_no_null(F.col("avoid_ingredients"))), none).alias("c_avoid"),
        _custom_terms(F.col("other_allergy")).alias("c_allergy_terms"),
        _custom_terms(F.col("other_avoid")).alias("c_avoid_terms"),
    )
    skin, sens = F.col("c_skin"), F.col("c_sens")
    empty = F.array().cast("array<string>")
    desired = F.array_distinct(
        F.concat(
            expand_codes(F.col("c_concerns"), K.CONCERN_DIMENSIONS),
            expand_codes(F.col("c_goals"), K.GOAL_DIMENSIONS),
            F.when(skin == "DRY", T.str_array(K.DRY_DIMENSIONS)).when(skin == "OILY", T.str_array(K.OILY_DIMENSIONS)).otherwise(empty),
            F.when(sens != "NOT_SENSITIVE", T.str_array(K.SENSITIVE_DIMENSIONS)).otherwise(empty),
        )
    )
    mult = F.lit(100)
    for code, value in K.SENSITIVITY_MULTIPLIERS.items():
        mult = F.when(sens == code, int(round(value * 100))).otherwise(mult)
    return (
        base.withColumn("c_desired", desired)
        .withColumn(
            "c_non_comedogenic",
            (skin == "OILY")
            | F.arrays_overlap("c_concerns", T.str_array(["ACNE", "EXCESS_OIL"]))
            | F.arrays_overlap("c_goals", T.str_array(["ACNE_CONTROL", "OIL_CONTROL"])),
        )
        .withColumn("c_sensitive", (skin == "SENSITIVE") | (sens != "NOT_SENSITIVE") | F.array_contains("c_concerns", "REDNESS"))
        .withColumn("c_mult", mult)
        .withColumn("c_desired_text", _one_text(F.col("c_desired")))
        .withColumn("c_allergy_marks", _marks(F.col("c_allergy"), F.col("c_allergy_terms"), K.ALLERGY_TRIGGERS))
        .withColumn("c_avoid_marks", _marks(F.col("c_avoid"), F.col("c_avoid_terms"), K.AVOID_TRIGGERS))
    )


# ------------------------------------------------------------------ ingredients
def _trigger_hits(codes: Column, corpus: Column, groups: dict[str, list[str]]) -> Column:
    """Codes of the fixed trigger groups that touch an ingredient."""
    marks = []
    for code, triggers in groups.items():
        hit = F.lit(False)
        for t in triggers:
            hit = hit | corpus.contains(t.lower())
            marker = "".join(ch if ch.isalnum() else "_" for ch in t)
            hit = hit | F.array_contains(codes, marker)
        marks.append(F.when(hit, F.lit(code)))
    return F.array_compact(F.array(*marks))


def ingredient_signals(dim: DataFrame) -> DataFrame:
    """Scoring view of the dimension; evaluated once per ingredient, not per line."""
    fields = ["functions", "helps", "tags", "avoid_for", "risk_flags", "suitable_skin_types", "avoid_skin_types"]
    values = F.filter(
        F.concat(
            F.array("name", "inci_name", "scientific_name", "purpose", "display_purpose"),
            *[_no_null(F.col(f)) for f in ("aliases", "tags", "functions", "helps", "avoid_for", "risk_flags")],
        ),
        lambda v: v.isNotNull() & (v != ""),
    )
    level = T.code_key(T.text(F.col("evidence_level")))
    base = dim.withColumns({**{f"s_{f}": _codes(_no_null(F.col(f))) for f in fields}, "_values": values, "s_evidence": level})
    levels = F.create_map(*[x for k, v in K.EVIDENCE_MULTIPLIERS.items() for x in (F.lit(k), F.lit(int(round(v * 100))))])
    base = base.withColumns(
        {
            "s_codes": _codes(F.col("_values")),
            "s_corpus": F.array_join(F.transform("_values", T.lower_text), " "),
            "s_ev": F.coalesce(F.try_element_at(levels, F.col("s_evidence")), F.lit(int(round(K.EVIDENCE_DEFAULT * 100)))),
            "s_benefits": F.array_distinct(
                F.concat(
                    F.col("s_helps"),
                    expand_codes(F.col("s_functions"), K.FUNCTION_DIMENSIONS),
                    expand_codes(F.col("s_tags"), K.TAG_DIMENSIONS),
                )
            ),
        }
    )
    has = F.array_contains
    irritation, comedo = F.col("irritation"), F.col("comedogenic")
    labels = F.create_map(*[F.lit(x) for kv in K.DIMENSION_LABELS.items() for x in kv])
    told = lambda d: F.struct(d.alias("code"), F.concat(F.lit(" "), d, F.lit(" ")).alias("spot"), F.coalesce(F.try_element_at(labels, d), T.lower_text(d)).alias("label"))
    base = base.withColumns(
        {
            "s_soothing": has("s_functions", "SOOTHING")
            | has("s_functions", "ANTI_INFLAMMATORY")
            | has("s_tags", "SOOTHING")
            | has("s_benefits", "REDNESS"),
            "s_fragrance": has("s_tags", "FRAGRANCE") | has("s_avoid_for", "FRAGRANCE_ALLERGY") | has("s_risk_flags", "ALLERGEN"),
            "s_essential": has("s_tags", "ESSENTIAL_OIL") | has("s_tags", "ESSENTIAL_OILS"),
            "s_allergy_hits": _trigger_hits(F.col("s_codes"), F.col("s_corpus"), K.ALLERGY_TRIGGERS),
            "s_avoid_hits": _trigger_hits(F.col("s_codes"), F.col("s_corpus"), K.AVOID_TRIGGERS),
            "s_told": F.transform("s_benefits", told),
            "s_strain": F.when(irritation >= 1, irritation * 15).otherwise(0),
            "s_heavy": F.when(comedo >= 4, 8000).when(comedo.between(2, 3), 3500).otherwise(0),
            "s_proof": F.when(F.col("s_evidence") == "HIGH", 900).when(F.col("s_evidence") == "MODERATE", 350).otherwise(0),
        }
    ).drop("_values")
    return base.withColumns(
        {
            "s_code_text": _one_text(F.col("s_codes")),
            "s_allergy_text": _one_text(F.col("s_allergy_hits")),
            "s_avoid_text": _one_text(F.col("s_avoid_hits")),
            "s_touch": F.when(irritation >= 2, 55).when((irritation < 2) & F.col("s_fragrance"), 35).otherwise(0),
            # points a line costs everybody, before its weight
            "s_cost": F.when(F.col("risk_level") == "HIGH", 4000).when(F.col("risk_level") == "MEDIUM", 2000).otherwise(0)
            + F.when(irritation >= 3, 8000).when(irritation >= 2, 4500).otherwise(0)
            + F.when(comedo >= 4, 6000).when(comedo >= 2, 3000).otherwise(0)
            + F.when(has("s_risk_flags", "ALLERGEN"), 4000).otherwise(0)
            + F.when(has("s_risk_flags", "IRRITANT"), 3000).otherwise(0)
            + F.when(F.col("s_fragrance"), 2000).otherwise(0)
            + F.when(F.col("s_essential"), 3000).otherwise(0),
        }
    )


def _touches(fixed_text: str):
    """Whether an ingredient meets a mark of `_marks`."""
    return lambda m: F.when(m["fixed"], F.col(fixed_text).contains(m["spot"])).otherwise(
        F.col("s_code_text").contains(m["spot"]) | F.col("s_corpus").contains(m["text"])
    )


def profile_hits(marks: str, fixed_text: str) -> Column:
    """Profile codes and free terms that touch an ingredient, in profile order."""
    return F.array_distinct(F.transform(F.filter(marks, _touches(fixed_text)), lambda m: m["shown"]))


# ------------------------------------------------------------------ lines x profile
def score_lines(rows: DataFrame) -> DataFrame:
    """Per-line penalty, contributions, label and reasons.

    Expects line columns (position, display_name, w), signal columns (s_*, NULL
    when the name is unknown) and context columns (c_*).
    """
    known = F.col("ingredient_id").isNotNull()
    out = rows.withColumns(
        {
            "told": F.filter("s_told", lambda b: F.col("c_desired_text").contains(b["spot"])),
            "allergy_hits": profile_hits("c_allergy_marks", "s_allergy_text"),
            "avoid_hits": profile_hits("c_avoid_marks", "s_avoid_text"),
            "allergic": F.coalesce(F.exists("c_allergy_marks", _touches("s_allergy_text")), F.lit(False)),
            "avoided": F.coalesce(F.exists("c_avoid_marks", _touches("s_avoid_text")), F.lit(False)),
            "fits_skin": F.array_contains("s_suitable_skin_types", F.col("c_skin")),
            "hurts_skin": F.array_contains("s_avoid_skin_types", F.col("c_skin")),
        }
    ).withColumn("benefits", F.col("told.code"))
    w, ev, m = F.col("w"), F.col("s_ev"), F.col("c_mult")
    irritation, comedo = F.col("irritation"), F.col("comedogenic")
    sensitive, skin, name = F.col("c_sensitive"), F.col("c_skin"), F.col("display_name")
    hits = F.size("told") > 0
    allergy, avoid = F.col("allergic"), F.col("avoided")

    def add(*pairs) -> Column:
        total = F.lit(0).cast("bigint")
        for cond, value in pairs:
            total = total + F.when(cond, value).otherwise(0)
        return total

    penalty = F.when(known, add((F.col("s_cost").isNotNull(), F.col("s_cost") * w), (sensitive, F.col("s_strain") * m * w), (allergy, 14000 * w))).otherwise(2500 * w)
    positive = F.when(
        known,
        add(
            (hits, F.least(F.lit(4), F.size("told")) * 24 * w * ev + F.col("s_proof") * w),
            (F.col("fits_skin"), 2000 * w),
            (sensitive & F.col("s_soothing"), 25 * w * ev),
            ((skin == "DRY") & F.arrays_overlap("benefits", T.str_array(K.DRY_FOCUS)), 1800 * w),
            ((skin == "OILY") & F.arrays_overlap("benefits", T.str_array(K.OILY_FOCUS)), 1800 * w),
        ),
    ).otherwise(0)
    negative = F.when(
        known,
        add(
            (F.col("hurts_skin"), 8000 * w),
            (F.col("c_non_comedogenic"), F.col("s_heavy") * w),
            (sensitive, F.col("s_touch") * w * m),
            (allergy, 16000 * w),
            (avoid, 10000 * w),
        ),
    ).otherwise(0)

    def said(cond, *parts):
        return F.when(cond, F.concat(name, *parts))

    skin_text = F.replace(F.lower(skin), F.lit("_"), F.lit(" "))
    positive_reasons = F.array_compact(
        F.array(
            said(hits, F.lit(" supports "), F.array_join(F.slice(F.col("told.label"), 1, 2), " and "), F.lit(".")),
            said(F.col("fits_skin"), F.lit(" is generally compatible with "), skin_text, F.lit(" skin.")),
            said(sensitive & F.col("s_soothing"), F.lit(" adds soothing support for reactive skin.")),
        )
    )
    negative_reasons = F.array_compact(
        F.array(
            F.when(~known, F.lit("Knowledge about this ingredient is limited.")),
            said(F.col("hurts_skin"), F.lit(" is not ideal for "), skin_text, F.lit(" skin.")),
            said(F.col("c_non_comedogenic") & (comedo >= 4), F.lit(" may feel too heavy or clog-prone for your profile.")),
            said(sensitive & (irritation >= 2), F.lit(" may irritate sensitive skin.")),
            said(sensitive & (irritation < 2) & F.col("s_fragrance"), F.lit(" can be challenging for sensitive skin.")),
            said(allergy, F.lit(" overlaps with one of your allergy triggers.")),
            said(avoid, F.lit(" matches one of the ingredients you prefer to avoid.")),
        )
    )
    safety_reasons = F.array_compact(
        F.array(
            F.when(~known, F.lit("This ingredient is not mapped in the current knowledge base.")),
            said(irritation >= 3, F.lit(" raises irritation risk.")),
            said(sensitive & (irritation >= 1), F.lit(" may stress a sensitive skin barrier.")),
            said(comedo >= 4, F.lit(" has a higher clogging risk.")),
            said(allergy, F.lit(" overlaps with one of your listed allergy triggers.")),
        )
    )
    out = out.withColumns(
        {
            "penalty": penalty.cast("bigint"),
            "positive": positive.cast("bigint"),
            "negative": negative.cast("bigint"),
            "positive_reasons": positive_reasons,
            "negative_reasons": negative_reasons,
            "safety_reasons": safety_reasons,
        }
    ).withColumn("net", F.floor((F.col("positive") - F.col("negative") + 500) / 1000).cast("bigint"))
    label = (
        F.when(F.col("ingredient_id").isNull(), "Neutral")
        .when((F.col("net") <= -200) | (F.size("negative_reasons") >= 2), "Low Match")
        .when(F.col("net") >= 200, "Good Match")
        .otherwise("Neutral")
    )
    return out.withColumn("fit_label", label)


def asked_contexts(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each request once, with the scoring view of its profile; a profile that isn't stored has no wishes.

    Both joins sort and merge: files of profiles are so much smaller than their rows that a size guessed from them had
    hundreds of MB broadcast.
    """
    asked = requests.distinct()
    known = asked.select("profile_id").distinct().join(profiles.hint("merge"), "profile_id", "left")
    return asked.join(kept(profile_context(known), "contexts").hint("merge"), "profile_id")


def scored_rows(lines: DataFrame, requests: DataFrame, dim: DataFrame, profiles: DataFrame) -> DataFrame:
    """Resolved lines (list_id, position, display_name, ingredient_id) scored for each request.

    The dimension and the profile context join by equality; lines of a hot list
    are split by AQE's skew join, and nothing is collected per list.
    """
    told = {"benefit_texts": "array<string>", "primary_purpose": "string", "how_it_works": "string"}
    extra = [F.col(c) if c in dim.columns else F.lit(None).cast(t).alias(c) for c, t in told.items()]
    sig = ingredient_signals(dim).select(
        "ingredient_id", "risk_level", "irritation", "comedogenic", "display_purpose", "purpose", "simple_explanation",
        "functions", "helps", *extra, *SIGNAL_COLUMNS,
    )
    rows = position_weights(lines, "display_name").join(asked_contexts(requests, profiles), "list_id")
    return score_lines(rows.join(kept(sig, "signals"), "ingredient_id", "left"))


SIGNAL_COLUMNS = [
    "s_functions", "s_helps", "s_tags", "s_avoid_for", "s_risk_flags", "s_suitable_skin_types", "s_avoid_skin_types",
    "s_codes", "s_corpus", "s_benefits", "s_evidence", "s_ev", "s_soothing", "s_fragrance", "s_essential",
    "s_allergy_hits", "s_avoid_hits", "s_code_text", "s_allergy_text", "s_avoid_text", "s_told", "s_strain", "s_heavy", "s_proof", "s_touch", "s_cost",
]
PAIR = ["profile_id", "list_id"]
LINE = ["list_id", "position", "display_name", "ingredient_id"]


def clamp_score(units: Column, unit: int = UNIT) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(units / unit + F.lit(0.5)))).cast("bigint")


def score_aggregates() -> list[Column]:
    unknown = F.sum(F.when(F.col("ingredient_id").isNull(), 1).otherwise(0)).cast("bigint")
    return [
        F.count(F.lit(1)).alias("line_count"),
        unknown.alias("unknown_lines"),
        F.sum("penalty").alias("penalty"),
        F.sum("net").alias("net"),
    ]


def score_columns() -> tuple[Column, Column]:
    """Safety and suitability out of the summed columns."""
    u = F.col("unknown_lines")
    safety = F.lit(100 * UNIT) - F.col("penalty") - F.least(F.lit(10), u * 2) * UNIT
    suit = F.lit(60 * 100) + F.col("net") - F.least(F.lit(600), u * 150)
    return clamp_score(safety), clamp_score(suit, 100)


def pair_scores(scored: DataFrame, *within: str) -> DataFrame:
    """Safety and suitability per request: one map-side combined aggregate. within: columns that a request has one value of."""
    safety, suit = score_columns()
    return scored.groupBy(*PAIR, *within).agg(*score_aggregates()).select(
        *PAIR, "line_count", F.col("unknown_lines").alias("unknown_count"), safety.alias("safety_score"), suit.alias("suitability_score")
    )


def overall(safety: Column, suitability: Column) -> Column:
    return F.floor((safety * 45 + suitability * 55 + 50) / 100).cast("bigint")


def verdict_text(safety: Column, suitability: Column) -> Column:
    return (
        F.when((safety > 85) & (suitability > 85), "Excellent choice for your profile.")
        .when((safety > 85) & (suitability >= 60), "Safe formula but only partially suited to your skin profile.")
        .when(safety < 60, "Contains several ingredients that may increase irritation or clogging risk.")
        .when(suitability < 60, "Reasonably safe overall, but not the best fit for your current skin needs.")
        .otherwise("A generally balanced formula with some tradeoffs depending on your skin profile.")
    )


def _told_at(impact: Column) -> Column:
    """Place of a message in one whole number: impact falling, then list order, then place in the line.

    Aggregates keep the smallest of a number by hash, that of a struct by sort. Room: positions below 2^31, 64 reasons
    in a line, impacts below 2^26 (a line without special traits costs 5 * 10^6 at most).
    """
    return -impact.cast("bigint") * (1 << 37) + F.col("position").cast("bigint") * 64 + F.col("i")


def top_messages(scored: DataFrame, reasons: str, impact: str, k: int = 5) -> DataFrame:
    """First k distinct messages per request by impact, ties in list order.

    Empty lists of reasons go after the explosion: a filter before it would build the reasons twice.
    """
    said = scored.select(*PAIR, F.col(impact).alias("impact"), "position", F.posexplode_outer(reasons).alias("i", "message")).where("i IS NOT NULL")
    best = said.groupBy(*PAIR, "message").agg(F.min(_told_at(F.col("impact"))).alias("o"))
    return top_per_group(best, PAIR, [F.col("o")], k).select(*PAIR, "rank", "message")


def pros_and_cons(scored: DataFrame, k: int = 5) -> DataFrame:
    """Per request the positive messages, and safety notes followed by negative messages: at most k of each.

    scored should be stored: each kind of messages is shuffled and stored before the next, so that the messages of one
    kind are on disk at a time.
    """
    kinds = (("positive_reasons", "positive"), ("safety_reasons", "penalty"), ("negative_reasons", "negative"))
    firsts = [kept(top_messages(scored, reasons, impact, k), reasons.replace("_", "-")) for reasons, impact in kinds]
    top = reduce(DataFrame.unionByName, [f.withColumn("kind", F.lit(i)) for i, f in enumerate(firsts)])
    packed = top.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("kind", "rank", "message"))).alias("m"))  # 3 * k at most

    def text(keep):
        return F.array_join(F.slice(F.transform(F.filter("m", keep), lambda x: x["message"]), 1, k), " | ")

    return packed.select(*PAIR, text(lambda x: x["kind"] == 0).alias("pros"), text(lambda x: x["kind"] > 0).alias("cons"))


def top_ingredients(scored: DataFrame, k: int = 3) -> DataFrame:
    """Strongest and weakest lines of each request, both sides in one window pass.

    The side is a generated column: a filter on a computed one would score each line once more below.
    """
    side = F.when(F.col("net") > 80, "strength").when(F.col("net") < -80, "weakness")
    rows = scored.select(*PAIR, "position", "display_name", "net", F.explode_outer(F.array(side)).alias("side")).where("side IS NOT NULL")
    return top_per_group(rows, [*PAIR, "side"], [F.abs("net").desc(), F.col("position")], k)


def packed_sides(ranked: DataFrame) -> DataFrame:
    """At most k names per side of a request as comma-joined text."""
    def names(side):
        kept = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "display_name"))))
        return F.array_join(F.transform(kept, lambda p: p["display_name"]), ", ")

    return ranked.groupBy(*PAIR).agg(names("strength").alias("strengths"), names("weakness").alias("weaknesses"))


def breakdown(scored: DataFrame) -> DataFrame:
    """Explanation columns of each line with their fallback chains."""
    pos = F.get(F.col("positive_reasons"), F.lit(0))
    neg = F.get(F.col("negative_reasons"), F.lit(0))
    functions = F.slice(_no_null(F.col("functions")), 1, 3)
    helps = F.transform(F.slice(_no_null(F.col("helps")), 1, 3), lambda h: F.replace(F.lower(h), F.lit("_"), F.lit(" ")))
    helpful = F.concat(F.lit("Usually helpful for "), T.or_list(helps, "Not enough profile-specific evidence yet."), F.lit("."))
    simple = T.blank(F.col("simple_explanation"))
    told = F.slice(_no_null(F.col("benefit_texts")), 1, 3)
    purpose, works = T.blank(F.col("primary_purpose")), T.blank(F.col("how_it_works"))
    summary = (
        F.when(F.size(told) > 0, F.array_join(told, " "))
        .when((F.size(functions) > 0) & (F.size(helps) > 0), F.concat(F.array_join(functions, ", "), F.lit(". "), helpful))
        .when(F.size(functions) > 0, F.array_join(functions, ", "))
        .when(F.size(helps) > 0, helpful)
        .otherwise(F.coalesce(works, purpose, simple, F.lit("Benefits unavailable.")))
    )
    lower_first = F.concat(F.lower(F.substr(neg, F.lit(1), F.lit(1))), F.substr(neg, F.lit(2)))
    reason = (
        F.when(pos.isNotNull() & neg.isNotNull(), F.concat(pos, F.lit(" The main tradeoff is that "), lower_first))
        .otherwise(F.coalesce(pos, neg, purpose, works, simple, F.lit("No strong profile-specific match signal was found for this ingredient.")))
    )
    unmapped = "Ingredient role not mapped yet"
    return scored.select(
        *PAIR,
        "position",
        F.col("display_name").alias("name"),
        "estimated_range",
        F.coalesce(T.blank(F.col("display_purpose")), T.blank(F.col("purpose")), F.lit(unmapped)).alias("purpose"),
        F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level"),
        F.col("fit_label").alias("suitability"),
        F.coalesce(pos, neg, simple, F.lit(unmapped)).alias("explanation"),
        F.coalesce(purpose, works, simple, F.lit("Limited evidence: no source-backed explanation for this ingredient yet.")).alias("why_included"),
        summary.alias("benefits"),
        reason.alias("profile_reason"),
        F.coalesce(works, simple, F.lit("Limited evidence: no source-backed mechanism summary for this ingredient yet.")).alias("how_it_works"),
    )


def score_band(c: Column) -> Column:
    return F.when(c >= 75, "Safe").when(c >= 50, "Moderate").otherwise("Risky")


def score_summary(answers: DataFrame) -> DataFrame:
    """The figures of each answer: both scores (0 where there is none) with their states, and the confidence as it is."""
    safety, suit = (F.coalesce(c, F.lit(0)) for c in ("safety_score", "suitability_score"))
    return answers.select(
        *PAIR, safety.alias("safety"), suit.alias("suitability"), F.col("confidence_score").alias("confidence"),
        score_band(safety).alias("safety_status"), score_band(suit).alias("suitability_status"),
    )


def quick_rows(lines: DataFrame, requests: DataFrame, dim: DataFrame, profiles: DataFrame) -> DataFrame:
    """Lines matched by exact lower-case name, with losses and messages per request."""
    first = first_per_key(dim, ["name"], [F.col("ingredient_id")]).select(
        F.col("name").alias("raw_key"), F.col("ingredient_id").alias("q_id"), "risk_level", "irritation", "comedogenic",
        F.col("tags").alias("q_tags"), F.col("suitable_skin_types").alias("q_suit"), F.col("avoid_skin_types").alias("q_avoid"),
    )
    codes = F.filter(_no_null(F.col("allergies")), lambda a: ~a.isin("NONE", "OTHER"))
    prof = profiles.select(
        "profile_id",
        "skin_type",
        F.col("concerns").alias("q_concerns"),
        F.concat(
            F.transform(codes, lambda a: F.replace(F.lower(a), F.lit("_"), F.lit(" "))),
            F.array_compact(F.array(T.blank(F.lower(F.col("other_allergy"))))),
        ).alias("q_allergies"),
    )
    rows = (
        lines.withColumn("raw_key", T.strip(F.lower("raw_name")))
        .where("raw_key <> ''")
        .join(first, "raw_key", "left")
        .join(requests.distinct().join(prof, "profile_id"), "list_id")
    )
    known, skin, tags, name = F.col("q_id").isNotNull(), F.col("skin_type"), F.col("q_tags"), F.col("raw_key")
    allergic = F.exists(
        "q_allergies",
        lambda a: name.contains(a) | name.contains(F.replace(a, F.lit(" "), F.lit(""))) | F.array_contains(tags, a),
    )
    facts = {
        "q_heavy": (skin == "OILY") & (F.col("comedogenic") >= 3),
        "q_reactive": (skin == "SENSITIVE") & ((F.col("irritation") >= 2) | F.array_contains(tags, "fragrance")),
        "q_dry": (skin == "DRY") & F.array_contains(tags, "hydrating"),
        "q_acne": F.array_contains("q_concerns", "ACNE") & F.array_contains(tags, "anti-acne"),
        "q_fits": F.array_contains("q_suit", skin),
        "q_avoided": F.array_contains("q_avoid", skin),
        "q_allergic": allergic,
    }
    rows = rows.withColumns({k: known & F.coalesce(v, F.lit(False)) for k, v in facts.items()})

    def pts(cond, value):
        return F.when(F.col(cond), value).otherwise(0)

    risk = F.lit(0)
    for level, value in K.QUICK_RISK_PENALTY.items():
        risk = F.when(F.col("risk_level") == level, value).otherwise(risk)
    say = lambda cond, *parts: F.when(F.col(cond), F.concat(name, *parts))
    return rows.withColumns(
        {
            "safety_loss": F.when(known, risk + F.col("irritation") * 7 + F.col("comedogenic") * 5 + pts("q_allergic", 8)).otherwise(6),
            "suit_loss": F.when(
                known,
                pts("q_heavy", 18) + pts("q_reactive", 18) - pts("q_dry", 5) - pts("q_acne", 6) - pts("q_fits", 4) + pts("q_avoided", 14) + pts("q_allergic", 22),
            ).otherwise(4),
            "quick_pros": F.array_compact(
                F.array(say("q_dry", F.lit(" boosts hydration for dry skin.")), say("q_acne", F.lit(" supports acne-focused care.")))
            ),
            "quick_cons": F.array_compact(
                F.array(
                    say("q_heavy", F.lit(" may feel too heavy for oily skin.")),
                    say("q_reactive", F.lit(" can trigger sensitivity or redness.")),
                    say("q_avoided", F.lit(" is usually avoided for "), F.lower(skin), F.lit(" skin.")),
                    say("q_allergic", F.lit(" overlaps with your listed allergy trigger.")),
                )
            ),
        }
    )


def quick_scores(rows: DataFrame) -> DataFrame:
    """Light scoring: one aggregate per request."""
    known = F.col("q_id").isNotNull()
    sums = rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(known, 1).otherwise(0)).alias("matched"),
        F.sum("safety_loss").alias("safety_loss"),
        F.sum("suit_loss").alias("suit_loss"),
    )
    safety = F.lit(88) - F.col("safety_loss") - F.when(F.col("n") >= 10, F.least(F.lit(10), F.col("n") - 9)).otherwise(0)
    suit = F.lit(84) - F.col("suit_loss") - F.when(F.col("matched") >= 1, 2).otherwise(0)
    mean = (safety + suit) / 2
    verdict = (
        F.when(mean >= 82, "Good fit overall, with only limited concerns.")
        .when(mean >= 68, "Moderate fit. Check the warnings before regular use.")
        .when(mean >= 50, "Risky fit. This formula has multiple profile conflicts.")
        .otherwise("Poor fit for this profile. This formula is better avoided.")
    )
    return sums.select(
        *PAIR,
        (F.col("n") - F.col("matched")).cast("bigint").alias("unknown_count"),
        F.greatest(F.lit(0), F.least(F.lit(96), safety)).cast("bigint").alias("safety_score"),
        F.greatest(F.lit(0), F.least(F.lit(94), suit)).cast("bigint").alias("suitability_score"),
        verdict.alias("verdict"),
    )


def profile_signature(context: DataFrame) -> DataFrame:
    """profile_id, signature: profiles that score alike share one."""
    cols = [c for c in context.columns if c != "profile_id"]
    return context.withColumn("signature", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def contribution_table(met: DataFrame, contexts: DataFrame, dim: DataFrame) -> DataFrame:
    """penalty and net of each distinct (signature, ingredient_id, w) in `met`: whole numbers, scored once.

    contexts: signature and c_* columns. Names that are unknown need no table: they cost the same for everybody.
    """
    sig = kept(ingredient_signals(dim).select("ingredient_id", "risk_level", "irritation", "comedogenic", *SIGNAL_COLUMNS), "signals")
    rows = met.distinct().join(contexts.hint("merge"), "signature").join(sig, "ingredient_id")
    return score_lines(rows.withColumn("display_name", F.lit(""))).select("signature", "ingredient_id", "w", "penalty", "net")


#: Lines of a packed row, requests of a part and lines of a task: aims, so that no signature, list or task grows with the tables.
PACK, PART, TASK = 64, 50_000, 1_000_000
#: Tables that are dealt by some of their join keys are joined as they lie.
DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def packed_lines(lines: DataFrame) -> DataFrame:
    """Rows (list_id, ids, ws, n): ingredients and weights of the n lines in `PACK` places of a list."""
    each = position_weights(lines, "display_name").select("list_id", F.floor(F.col("position") / PACK).alias("at"), F.struct("ingredient_id", "w").alias("x"))
    packs = each.groupBy("list_id", "at").agg(F.collect_list("x").alias("x"))
    return packs.select("list_id", F.col("x.ingredient_id").alias("ids"), F.col("x.w").alias("ws"), F.size("x").alias("n"))


def contributions(lines: DataFrame, asked: DataFrame, dim: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every line adds for every way of looking at its list, and who looks that way.

    Returns rows (signature, part, list_id, ingredient_id, penalty, net), one for each line of a distinct (signature,
    list), and (profile_id, list_id, signature) for each distinct request. A signature is named by the smallest profile
    that has it. A profile that isn't stored has no wishes. Wide columns of ingredients and profiles meet in the table
    of distinct contributions only.

    Lists are stored and moved with their lines packed and are unpacked where they meet their contributions: one row for
    each line would be by far the most that the job writes to disk. Rows and contributions are dealt alike, by signature
    and part; the lists of a signature with many requests are dealt over several parts, so that none fills one task.
    Rows stay as they are dealt only if they are planned `DEALT`.
    """
    asked = asked.select(*PAIR).distinct()
    wishes = profile_context(asked.select("profile_id").distinct().join(profiles.hint("merge"), "profile_id", "left"))
    whole = F.struct(*[c for c in wishes.columns if c.startswith("c_")])
    # an aggregate keeps the long expressions of a profile out of the joins on its signature
    context = profile_signature(wishes.groupBy("profile_id").agg(F.first(whole).alias("c")))
    context = kept(context.groupBy("profile_id").agg(F.first("signature").alias("hash"), F.first("c").alias("c")), "contexts")
    one = kept(context.groupBy("hash").agg(F.min("profile_id").alias("signature"), F.first("c").alias("c")), "views")
    views = context.select("profile_id", "hash").join(one.select("hash", "signature").hint("merge"), "hash").select("profile_id", "signature")
    asked = kept(asked.join(views.hint("merge"), "profile_id").select(*PAIR, "signature"), "asked")

    parts = F.ceil(F.count(F.lit(1)) / PART).cast("int")
    hot = F.broadcast(kept(asked.groupBy("signature").agg(parts.alias("parts")).where("parts > 1"), "hot-signatures"))  # a row for `PART` requests at most
    met = kept(packed_lines(lines), "packed-lines").hint("merge").join(asked.select("signature", "list_id").distinct(), "list_id").join(hot, "signature", "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("list_id"), "parts")).cast("int")
    packs = kept(met.select("signature", part.alias("part"), "list_id", "ids", "ws", "n"), "asked-lists")

    key = ["signature", "ingredient_id", "w"]
    unpacked = F.inline(F.arrays_zip("ids", "ws")).alias("ingredient_id", "w")
    found = packs.select("signature", unpacked).where("ingredient_id IS NOT NULL")
    table = kept(contribution_table(found, one.select("signature", "c.*"), dim), "contributions")
    every = table.join(hot, "signature", "left").select(*key, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "penalty", "net")

    tasks = max(dim.sparkSession.sparkContext.defaultParallelism, -(-(packs.agg(F.sum("n")).first()[0] or 0) // TASK))
    deal = ["signature", "part"]
    rows = packs.repartition(tasks, *deal).select(*deal, "list_id", unpacked).join(every.repartition(tasks, *deal).hint("merge"), [*deal, "ingredient_id", "w"], "left")
    penalty, net = F.coalesce("penalty", (F.col("w") * 2500).cast("bigint")), F.coalesce("net", F.lit(0).cast("bigint"))
    return rows.select(*deal, "list_id", "ingredient_id", penalty.alias("penalty"), net.alias("net")), asked


def signature_scores(rows: DataFrame) -> DataFrame:
    """Safety and suitability of each (signature, list): summed where the lines lie, as a list is in one part."""
    scores = pair_scores(rows.withColumnRenamed("signature", "profile_id"), "part")
    return scores.withColumnRenamed("profile_id", "signature")


def score_all(lines: DataFrame, requests: DataFrame, dim: DataFrame, profiles: DataFrame) -> DataFrame:
    """Scores of every request of a stored profile, summed once per distinct (signature, list) over `contributions`."""
    asked = requests.join(profiles.select("profile_id").hint("merge"), "profile_id", "left_semi")
    rows, asked = contributions(lines, asked, dim, profiles)
    return asked.join(kept(signature_scores(rows), "scores", DEALT).hint("merge"), ["signature", "list_id"]).drop("signature")


def quick_messages(rows: DataFrame, reasons: str, k: int) -> DataFrame:
    """First k distinct messages of a request in list order; unmatched names are counted in a last one."""
    said = rows.select(*PAIR, "position", F.posexplode(reasons).alias("i", "message"))
    if reasons == "quick_cons":
        n = F.col("n")
        text = F.concat(
            n.cast("string"), F.when(n > 1, " ingredients are").otherwise(" ingredient is"),
            F.lit(" not yet in the ingredient set, so the score is reduced for uncertainty."),
        )
        missing = rows.where("q_id IS NULL").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
        said = said.unionByName(missing.select(*PAIR, F.lit(2147483647).alias("position"), F.lit(0).alias("i"), text.alias("message")))
    first = said.groupBy(*PAIR, "message").agg(F.min(F.struct("position", "i")).alias("o"))
    return top_per_group(first, PAIR, [F.col("o")], k).select(*PAIR, "rank", "message")
