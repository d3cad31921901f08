"""Formula lines: resolution, verification, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import resolve as R
from ..operators import score as S
from ..operators import verify as V
from ..sources import bindings as B
from ..sources.tables import kept
from . import duck as D
from . import sql_resolve as Q
from .registry import ctes, query

# Orders carry few lines, so the size rule runs with a lower bound on them.
ORDER_MIN = 4
SITE = "CASE list_id % 4 WHEN 0 THEN 'Maker Shop' WHEN 1 THEN 'Other Store' WHEN 2 THEN '' ELSE 'maker' END"
METHOD = (
    "CASE list_id % 7 WHEN 0 THEN 'official-site-search' WHEN 1 THEN 'trusted-database' WHEN 2 THEN 'distributor-page' WHEN 3 THEN 'dom-heading' "
    "WHEN 4 THEN 'ai-structured-output' WHEN 5 THEN 'html' ELSE 'ocr' END"
)
BRAND = "CASE list_id % 3 WHEN 0 THEN 'Maker' WHEN 1 THEN '' ELSE 'Nobody' END"

RES = dict(dim=B.DIM_SQL, lines=B.LINES_SQL, **Q.resolution())
CNT = dict(RES, cnt=Q.counters("res"))
LONG = dict(RES, lines=B.LONG_LINES_SQL)
LONG_CNT = dict(LONG, cnt=Q.counters("res"))
SCORED = dict(RES, prof=B.PROFILE_SQL, req=B.REQUESTS_SQL, sig=Q.signals(), ctx=Q.context(), scored=Q.scored())


def resolved_lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_names(B.formula_lines(spark, sf), B.dimension(spark, sf))


def long_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_names(B.long_formula_lines(spark, sf), B.dimension(spark, sf))


def display_lines(resolved: DataFrame) -> DataFrame:
    return resolved.select("list_id", "position", F.col("canonical_name").alias("display_name"), "ingredient_id")


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.scored_rows(display_lines(resolved_lines(spark, sf)), B.requests(spark, sf), B.dimension(spark, sf), B.profiles(spark, sf))


# ------------------------------------------------------------------ names
@query(
    "d1_alias_map",
    ctes(
        "SELECT key, ingredient_id, name, CASE WHEN " + D.compact_key("name") + " = key THEN 'name' ELSE 'alias' END AS kind FROM direct "
        "UNION ALL SELECT s.key, t.ingredient_id, t.name, 'synonym' FROM targets t JOIN (VALUES "
        + ", ".join(f"({D.q(k)}, {D.q(''.join(c for c in v if c.isalnum()))})" for k, v in K.SYNONYMS.items())
        + ") s(key, target) ON s.target = t.key",
        dim=B.DIM_SQL, entries=Q.ENTRIES, direct=Q.DIRECT, targets=Q.TARGETS,
    ),
)
def d1_alias_map(spark, sf):
    return R.alias_map(B.dimension(spark, sf)).withColumn("kind", F.when(F.col("kind") == "name", "name").otherwise(F.col("kind")))


@query("d2_resolve_names", ctes("SELECT list_id, position, raw_name, normalized_input, canonical_name, ingredient_id, match_type FROM res", **RES))
def d2_resolve_names(spark, sf):
    return resolved_lines(spark, sf).select(
        "list_id", "position", "raw_name", "normalized_input", "canonical_name", "ingredient_id", "match_type"
    )


TYPO = "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', 'x') WHEN 1 THEN p_name || 'q' WHEN 2 THEN substr(p_name, 2) ELSE p_name || ' ' || lower(p_type) END"
_UNSEEN = f"SELECT DISTINCT {D.compact_key(TYPO)} AS input_key FROM part WHERE {D.compact_key(TYPO)} NOT IN (SELECT key FROM entries)"


@query(
    "d3_fuzzy_names",
    ctes(
        "SELECT input_key, ingredient_id, name, distance FROM (SELECT u.input_key, e.ingredient_id, e.name, CAST(levenshtein(u.input_key, e.key) AS INT) AS distance, "
        "row_number() OVER (PARTITION BY u.input_key ORDER BY levenshtein(u.input_key, e.key), e.ingredient_id, e.form_pos) AS rn FROM u CROSS JOIN entries e) "
        "WHERE rn = 1 AND distance <= greatest(1, floor(length(input_key) * 18 / 100.0))",
        dim=B.DIM_SQL, entries=Q.ENTRIES, u=_UNSEEN,
    ),
)
def d3_fuzzy_names(spark, sf):
    dim = B.dimension(spark, sf)
    typed = B.table(spark, sf, "part").select(T.compact_key(F.expr(TYPO)).alias("input_key")).distinct()
    misses = typed.join(R.catalogue_entries(dim).select(F.col("key").alias("input_key")), "input_key", "left_anti")
    return R.fuzzy_resolve(misses, dim).withColumn("distance", F.col("distance").cast("int"))


@query(
    "d4_unknown_names",
    ctes("SELECT min(normalized_input) AS name, count(*) AS uses FROM res0 WHERE match_type = 'unknown' GROUP BY " + D.compact_key("normalized_input"), **RES),
)
def d4_unknown_names(spark, sf):
    return R.unknown_names(B.formula_lines(spark, sf), B.dimension(spark, sf))


_STORED = "ingredient_id % 2 = 0"
_MERGE_TXT = lambda f: f"coalesce(nullif(s.{f}, ''), nullif(f.{f}, ''))"
_MERGE_ARR = lambda f: f"array_to_string(coalesce(s.{f}, f.{f}, []), '|')"


@query(
    "d5_overlay_dimension",
    ctes(
        "SELECT coalesce(s.key, f.key) AS key, coalesce(s.ingredient_id, f.ingredient_id) AS ingredient_id, coalesce(s.name, f.name) AS name, "
        "array_to_string(list_concat(coalesce(f.aliases, []), list_filter(coalesce(s.aliases, []), lambda a: NOT list_contains(coalesce(f.aliases, []), a))), '|') AS aliases, "
        f"{_MERGE_TXT('scientific_name')} AS scientific_name, coalesce({_MERGE_TXT('purpose')}, 'Unknown') AS purpose, coalesce({_MERGE_TXT('risk_level')}, 'UNKNOWN') AS risk_level, "
        "coalesce(s.comedogenic, f.comedogenic, 0) AS comedogenic, coalesce(s.irritation, f.irritation, 0) AS irritation, "
        + ", ".join(f"{_MERGE_ARR(f)} AS {f}" for f in ("functions", "helps", "tags"))
        + f", {_MERGE_TXT('evidence_level')} AS evidence_level FROM stored s FULL OUTER JOIN seed f ON s.key = f.key",
        raw=B.DIM_RAW_SQL,
        stored=f"SELECT *, {D.compact_key('name')} AS key FROM raw WHERE {_STORED}",
        seed=f"SELECT * REPLACE ('' AS purpose, 'LOW' AS risk_level, ingredient_id + 1000000 AS ingredient_id, list_value('seed ' || name) AS aliases), {D.compact_key('name')} AS key FROM raw WHERE ingredient_id % 3 <> 0 OR NOT ({_STORED})",
    ),
)
def d5_overlay_dimension(spark, sf):
    raw = B.raw_dim(spark, sf)
    stored = raw.where(_STORED)
    seed = raw.where(f"ingredient_id % 3 <> 0 OR NOT ({_STORED})").withColumns(
        {
            "purpose": F.lit(""),
            "risk_level": F.lit("LOW"),
            "ingredient_id": F.col("ingredient_id") + 1000000,
            "aliases": F.array(F.concat(F.lit("seed "), F.col("name"))),
        }
    )
    out = R.overlay_dim(stored, seed)
    return out.select(
        "key", "ingredient_id", "name", F.array_join("aliases", "|").alias("aliases"), "scientific_name", "purpose", "risk_level",
        "comedogenic", "irritation", *[F.array_join(c, "|").alias(c) for c in ("functions", "helps", "tags")], "evidence_level",
    )


@query(
    "d6_product_ingredients",
    ctes("SELECT list_id, position, d.name, d.ingredient_id, risk_level, purpose FROM lines JOIN dim d ON d.name = raw_name", dim=B.DIM_SQL, lines=B.LINES_SQL),
)
def d6_product_ingredients(spark, sf):
    return R.product_ingredients(B.formula_lines(spark, sf), B.dimension(spark, sf))


# ------------------------------------------------------------------ verification
_CNT_COLS = (
    "list_id, row_count, ingredient_count, matched_count, unknown_count, plausible_count, alias_count, percent_count, sentence_count, marketing_count, has_support"
)


@query("e1_list_counters", ctes(f"SELECT {_CNT_COLS} FROM cnt", **CNT))
def e1_list_counters(spark, sf):
    return V.list_counters(resolved_lines(spark, sf))


_DOC_TOKENS = f"SELECT doc_id AS list_id, unnest({D.raw_tokens('text')}) AS raw_name FROM documents"


@query(
    "e1_text_token_counters",
    ctes(
        f"SELECT list_id, count(*) AS raw_count, {Q.n_if(Q.percent_only('raw_name'))} AS percent_count, {Q.n_if(Q.looks_like_sentence('raw_name'))} AS sentence_count, "
        f"{Q.n_if(Q.has_marketing('raw_name') + ' OR ' + Q.has_emoji('raw_name'))} AS marketing_count FROM tok GROUP BY 1",
        tok=_DOC_TOKENS,
    ),
)
def e1_text_token_counters(spark, sf):
    docs = B.texts(spark, sf, "documents")
    return V.token_flags(docs.select(F.col("doc_id").alias("list_id"), F.explode(T.raw_tokens(F.col("text"))).alias("raw_name")))


@query(
    "e2_verify_lists",
    ctes(
        f"SELECT list_id, rule, verified, match_rate, {Q.reason(ORDER_MIN, 'site')} AS reason FROM (SELECT *, {SITE} AS site FROM ver)",
        **CNT, ver=Q.verified(ORDER_MIN),
    ),
)
def e2_verify_lists(spark, sf):
    counters = V.list_counters(resolved_lines(spark, sf))
    out = V.verify_lists(counters, ORDER_MIN)
    return out.select("list_id", "rule", "verified", "match_rate", V.reason_text(ORDER_MIN, F.expr(SITE)).alias("reason"))


@query(
    "e2_verify_long_lists",
    ctes("SELECT list_id, ingredient_count, rule, verified, match_rate FROM ver", **LONG_CNT, ver=Q.verified(K.MIN_LIST_SIZE)),
)
def e2_verify_long_lists(spark, sf):
    counters = V.list_counters(long_resolved(spark, sf))
    return V.verify_lists(counters).select("list_id", "ingredient_count", "rule", "verified", "match_rate")


@query(
    "e3_verification_confidence",
    ctes(
        f"SELECT list_id, rule, {Q.verification_confidence('method', 'site', 'brand')} AS confidence FROM (SELECT *, {METHOD} AS method, {SITE} AS site, {BRAND} AS brand FROM ver)",
        **CNT, ver=Q.verified(ORDER_MIN),
    ),
)
def e3_verification_confidence(spark, sf):
    out = V.verify_lists(V.list_counters(resolved_lines(spark, sf)), ORDER_MIN)
    conf = V.verification_confidence(F.expr(METHOD), F.expr(SITE), F.expr(BRAND))
    return out.select("list_id", "rule", conf.alias("confidence"))


_AC, _AN = Q.analysis_confidence("method", "site", "brand")


@query(
    "e4_analysis_confidence",
    ctes(
        f"SELECT list_id, {_AC} AS confidence_score, array_to_string({_AN}, ' | ') AS details FROM (SELECT *, {METHOD} AS method, {SITE} AS site, {BRAND} AS brand FROM cnt)",
        **CNT,
    ),
)
def e4_analysis_confidence(spark, sf):
    counters = V.list_counters(resolved_lines(spark, sf))
    score, notes = V.analysis_confidence(F.expr(METHOD), F.expr(SITE), F.expr(BRAND))
    return counters.select("list_id", score.alias("confidence_score"), F.array_join(notes, " | ").alias("details"))


@query(
    "e5_canonical_list",
    ctes(
        f"SELECT list_id, {D.compact_key('shown')} AS key, CAST(min(position) AS INT) AS position, arg_max(shown, position) AS name FROM (SELECT *, {Q.SHOWN} AS shown FROM res) GROUP BY 1, 2",
        **RES,
    ),
)
def e5_canonical_list(spark, sf):
    return R.canonical_list(resolved_lines(spark, sf))


# ------------------------------------------------------------------ scoring
_TL, _TW = Q.tier("position", "raw_name")


@query("f1_position_weights", ctes(f"SELECT list_id, position, raw_name, {_TL} AS estimated_range, {_TW} / 100.0::DOUBLE AS weight FROM lines", lines=B.LINES_SQL))
def f1_position_weights(spark, sf):
    out = S.position_weights(B.formula_lines(spark, sf))
    return out.select("list_id", "position", "raw_name", "estimated_range", (F.col("w") / 100).alias("weight"))


@query(
    "f1_long_list_tiers",
    ctes(
        f"SELECT list_id, range, CAST(count(*) AS BIGINT) AS line_count, CAST(sum(w) AS BIGINT) AS weight_sum FROM (SELECT list_id, {_TL} AS range, {_TW} AS w FROM lines) GROUP BY 1, 2",
        lines=B.LONG_LINES_SQL,
    ),
)
def f1_long_list_tiers(spark, sf):
    out = S.position_weights(B.long_formula_lines(spark, sf))
    return out.groupBy("list_id", F.col("estimated_range").alias("range")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("w").alias("weight_sum")
    )


_CTX_ARR = ["c_concerns", "c_goals", "c_allergy", "c_avoid", "c_allergy_terms", "c_avoid_terms", "c_desired"]


@query(
    "f2_profile_context",
    ctes(
        "SELECT profile_id, c_skin, c_sens, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in _CTX_ARR)
        + ", c_non_comedogenic, c_sensitive, CAST(c_mult AS INT) AS c_mult FROM ctx",
        prof=B.PROFILE_SQL, ctx=Q.context(),
    ),
)
def f2_profile_context(spark, sf):
    c = S.profile_context(B.profiles(spark, sf))
    return c.select("profile_id", "c_skin", "c_sens", *[F.array_join(x, "|").alias(x) for x in _CTX_ARR], "c_non_comedogenic", "c_sensitive", "c_mult")


_SIG_ARR = ["s_benefits", "s_codes", "s_allergy_hits", "s_avoid_hits"]
_SIG_SCALAR = ["ingredient_id", "s_corpus", "s_evidence", "s_ev", "s_soothing", "s_fragrance", "s_essential"]


@query(
    "f3_ingredient_signals",
    ctes("SELECT " + ", ".join(_SIG_SCALAR) + ", " + ", ".join(f"array_to_string({c if c != 's_codes' else Q.ordered_distinct(c)}, '|') AS {c}" for c in _SIG_ARR) + " FROM sig", dim=B.DIM_SQL, sig=Q.signals()),
)
def f3_ingredient_signals(spark, sf):
    return S.ingredient_signals(B.dimension(spark, sf)).select(*_SIG_SCALAR, *[F.array_join(c, "|").alias(c) for c in _SIG_ARR])


def _register_line_queries():
    specs = {
        "f4_matched_benefits": [("benefits", True)],
        "f5_allergy_hits": [("allergy_hits", True)],
        "f6_avoid_hits": [("avoid_hits", True)],
        "f10_fit_label": [("fit_label", False), ("net", False), ("penalty", False)],
    }
    for name, cols in specs.items():
        duck = ", ".join(f"array_to_string({c}, '|') AS {c}" if arr else c for c, arr in cols)

        def run(spark, sf, cols=cols):
            picked = [F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) if arr else F.col(c) for c, arr in cols]
            return scored_lines(spark, sf).select("profile_id", "list_id", "position", *picked)

        query(name, ctes(f"SELECT profile_id, list_id, position, {duck} FROM scored", **SCORED))(run)


_register_line_queries()


def _pairs(spark, sf):
    return S.pair_scores(scored_lines(spark, sf))


@query("f7_safety_score", ctes("SELECT profile_id, list_id, line_count, unknown_count, safety_score FROM ps", **SCORED, ps=Q.PAIR_SCORES))
def f7_safety_score(spark, sf):
    return _pairs(spark, sf).select("profile_id", "list_id", "line_count", "unknown_count", "safety_score")


@query("f8_safety_notes", ctes(Q.top_messages("safety_reasons", "penalty"), **SCORED))
def f8_safety_notes(spark, sf):
    # stored, so that no task holds the sorted lines and profiles of the join beside the messages
    s = kept(scored_lines(spark, sf).select(*S.PAIR, "position", "penalty", "safety_reasons"), "scored")
    return S.top_messages(s, "safety_reasons", "penalty")


@query("f9_suitability_score", ctes("SELECT profile_id, list_id, suitability_score FROM ps", **SCORED, ps=Q.PAIR_SCORES))
def f9_suitability_score(spark, sf):
    return _pairs(spark, sf).select("profile_id", "list_id", "suitability_score")


@query(
    "f11_top_messages",
    ctes(
        "SELECT *, 'positive' AS side FROM (" + Q.top_messages("positive_reasons", "positive") + ") UNION ALL SELECT *, 'negative' FROM ("
        + Q.top_messages("negative_reasons", "negative") + ")",
        **SCORED,
    ),
)
def f11_top_messages(spark, sf):
    # both sides read the lines that are scored once
    s = kept(scored_lines(spark, sf).select(*S.PAIR, "position", "positive", "positive_reasons", "negative", "negative_reasons"), "scored")
    up = S.top_messages(s, "positive_reasons", "positive").withColumn("side", F.lit("positive"))
    return up.unionByName(S.top_messages(s, "negative_reasons", "negative").withColumn("side", F.lit("negative")))


@query("f12_strengths_weaknesses", ctes(Q.top_ingredients(), **SCORED))
def f12_strengths_weaknesses(spark, sf):
    return S.top_ingredients(scored_lines(spark, sf))


@query(
    "f13_verdict",
    ctes(f"SELECT profile_id, list_id, {Q.OVERALL} AS overall_score, {Q.VERDICT} AS verdict FROM ps", **SCORED, ps=Q.PAIR_SCORES),
)
def f13_verdict(spark, sf):
    sa, su = F.col("safety_score"), F.col("suitability_score")
    return _pairs(spark, sf).select("profile_id", "list_id", S.overall(sa, su).alias("overall_score"), S.verdict_text(sa, su).alias("verdict"))


_BENEFIT_SUMMARY = (
    "CASE WHEN len(fn) > 0 AND len(hp) > 0 THEN array_to_string(fn, ', ') || '. ' || hl WHEN len(fn) > 0 THEN array_to_string(fn, ', ') "
    "WHEN len(hp) > 0 THEN hl ELSE coalesce(nullif(simple_explanation, ''), 'Benefits unavailable.') END"
)


@query(
    "f14_breakdown",
    ctes(
        "SELECT profile_id, list_id, position, display_name AS name, estimated_range, coalesce(nullif(display_purpose, ''), nullif(purpose, ''), 'Ingredient role not mapped yet') AS purpose, "
        "coalesce(risk_level, 'UNKNOWN') AS risk_level, fit_label AS suitability, coalesce(pos, neg, simple_explanation, 'Ingredient role not mapped yet') AS explanation, "
        "coalesce(simple_explanation, 'Limited evidence: no source-backed explanation for this ingredient yet.') AS why_included, "
        f"{_BENEFIT_SUMMARY} AS benefits, CASE WHEN pos IS NOT NULL AND neg IS NOT NULL THEN pos || ' The main tradeoff is that ' || lower(left(neg, 1)) || substr(neg, 2) "
        "ELSE coalesce(pos, neg, simple_explanation, 'No strong profile-specific match signal was found for this ingredient.') END AS profile_reason, "
        "coalesce(simple_explanation, 'Limited evidence: no source-backed mechanism summary for this ingredient yet.') AS how_it_works FROM "
        f"(SELECT * EXCLUDE (benefits), positive_reasons[1] AS pos, negative_reasons[1] AS neg, 'Usually helpful for ' || {D.or_list('hp', 'Not enough profile-specific evidence yet.')} || '.' AS hl FROM "
        "(SELECT *, coalesce(functions[1:3], []) AS fn, list_transform(coalesce(helps[1:3], []), lambda h: replace(lower(h), '_', ' ')) AS hp FROM scored))",
        **SCORED,
    ),
)
def f14_breakdown(spark, sf):
    return S.breakdown(scored_lines(spark, sf))


def analyze(
    lines: DataFrame, requests: DataFrame, dim: DataFrame, profiles: DataFrame, min_count: int = K.MIN_LIST_SIZE, fuzzy: bool = True, full: bool = False
) -> DataFrame:
    """One row per distinct request: gate, scores, verdict, confidence, strengths and weaknesses.

    Requests for lists without lines are answered too (not verified). Lists are typed in by hand, so brand and site are both `Manual Input`.
    Lines are scored once and stored; verification counters and score sums come out of the same aggregate. With `full`, requests are those of
    `catalogue_requests`: their origin decides the confidence, and product, confidence notes, pros and cons come along.
    """
    origin = ["product_id", "product_name", "method", "website", "brand"] if full else []
    resolved = R.resolve_names(lines, dim, fuzzy)
    scored = S.scored_rows(resolved.withColumn("display_name", F.col("canonical_name")), requests, dim, profiles)
    told = ["positive", "positive_reasons", "negative", "negative_reasons", "safety_reasons"] if full else []
    facts = ["v_key", "v_plausible", "v_percent", "v_sentence", "v_marketing", "v_support", "match_type"]
    scored = kept(scored.select(*S.PAIR, "position", "display_name", "ingredient_id", "penalty", "net", *facts, *told), "scored")
    sums = scored.groupBy(*S.PAIR).agg(*V.counter_aggregates(), *S.score_aggregates())
    nothing = {n: F.coalesce(F.col(n), F.lit(0).cast(t)) for n, t in sums.dtypes if n not in S.PAIR}
    asked = requests.select(*S.PAIR, *origin).distinct().join(sums, S.PAIR, "left").withColumns(nothing)
    checked = V.verify_lists(asked, min_count)
    manual = F.lit("Manual Input")
    came = (F.col("method"), F.col("website"), F.col("brand")) if full else (F.lit("manual-input"), manual, manual)
    confidence, details = V.analysis_confidence(*came)
    safety, suit = S.score_columns()
    more = [*origin, F.when(F.col("verified"), F.array_join(details, " | ")).otherwise("").alias("confidence_details")] if full else []
    ok = F.col("verified")
    rows = checked.select(
        *S.PAIR,
        "rule",
        ok,
        F.when(ok, safety).alias("safety_score"),
        F.when(ok, suit).alias("suitability_score"),
        F.when(ok, confidence).otherwise(0).cast("bigint").alias("confidence_score"),
        *more,
    )
    tops = S.packed_sides(S.top_ingredients(scored))
    sa, su = F.col("safety_score"), F.col("suitability_score")
    met = rows.join(tops, S.PAIR, "left")
    notes = []
    if full:
        met = met.join(S.pros_and_cons(scored).hint("merge"), S.PAIR, "left")
        said = [F.when(ok, T.text(F.col(c))).otherwise("").alias(c) for c in ("pros", "cons")]
        notes = ["product_id", F.coalesce("product_name", F.lit("Custom Ingredient List")).alias("product_name"), "confidence_details", *said]
    return met.select(
        *S.PAIR,
        F.when(ok, "VERIFIED_INGREDIENTS_FOUND").otherwise("NO_VERIFIED_INGREDIENTS").alias("status"),
        "rule",
        sa,
        su,
        S.overall(sa, su).alias("overall_score"),
        "confidence_score",
        F.when(ok, S.verdict_text(sa, su)).alias("verdict"),
        F.when(ok, T.text(F.col("strengths"))).otherwise("").alias("strengths"),
        F.when(ok, T.text(F.col("weaknesses"))).otherwise("").alias("weaknesses"),
        *notes,
    )


def catalogue_requests(asked: DataFrame, products: DataFrame) -> DataFrame:
    """Requests (profile_id, list_id, product_name) with the list and origin that answers them.

    A product of the catalogue (product_id, name, brand, product_list) whose name is asked for, apart from case and outer
    blanks, brings its own list; of equal names the smallest product_id counts. All others bring the list typed in.
    """
    key = lambda c: F.trim(F.lower(c))
    known = products.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("product_id", "name", "brand", "product_list"), "product_id").alias("p"))
    met = asked.join(known, key(F.col("product_name")) == F.col("key"), "left")
    found = F.col("p").isNotNull()
    site = F.when(found, F.col("p.brand")).otherwise("Manual Input")
    return met.select(
        "profile_id", F.when(found, F.col("p.product_list")).otherwise(F.col("list_id")).alias("list_id"), F.col("p.product_id").alias("product_id"),
        F.when(found, F.col("p.name")).otherwise(F.col("product_name")).alias("product_name"),
        F.when(found, F.lit("catalog-verified")).otherwise("manual-input").alias("method"), site.alias("website"), site.alias("brand"),
    )


def unknown_names(resolved: DataFrame, min_count: int = K.MIN_LIST_SIZE) -> DataFrame:
    """(list_id, position, name): what an answer calls unknown; every name of a list that isn't verified."""
    gate = V.verify_lists(V.list_counters(resolved), min_count).select("list_id", "verified")
    return resolved.join(gate, "list_id").where(F.col("ingredient_id").isNull() | ~F.col("verified")).select("list_id", "position", F.col("canonical_name").alias("name"))


_MC, _MN = Q.analysis_confidence("'manual-input'", "'Manual Input'", "'Manual Input'")
ANALYZE = dict(
    CNT, ver=Q.verified(ORDER_MIN), prof=B.PROFILE_SQL, allreq=B.OPEN_REQUESTS_SQL,
    req="SELECT a.* FROM allreq a JOIN ver v ON v.list_id = a.list_id AND v.verified",
    sig=Q.signals(), ctx=Q.context(), scored=Q.scored(), ps=Q.PAIR_SCORES, tops=Q.top_ingredients(),
    packs="SELECT profile_id, list_id, coalesce(string_agg(display_name, ', ' ORDER BY rank) FILTER (WHERE side = 'strength'), '') AS strengths, "
    "coalesce(string_agg(display_name, ', ' ORDER BY rank) FILTER (WHERE side = 'weakness'), '') AS weaknesses FROM tops GROUP BY 1, 2",
)
ANALYZE_SQL = (
    "SELECT a.profile_id, a.list_id, CASE WHEN v.verified THEN 'VERIFIED_INGREDIENTS_FOUND' ELSE 'NO_VERIFIED_INGREDIENTS' END AS status, coalesce(v.rule, 'MIN_INGREDIENT_COUNT') AS rule, safety_score, suitability_score, "
    f"{Q.OVERALL} AS overall_score, CASE WHEN v.verified THEN conf ELSE 0 END AS confidence_score, CASE WHEN v.verified THEN {Q.VERDICT} END AS verdict, "
    "coalesce(strengths, '') AS strengths, coalesce(weaknesses, '') AS weaknesses FROM allreq a "
    f"LEFT JOIN (SELECT *, {_MC} AS conf FROM ver) v ON v.list_id = a.list_id LEFT JOIN ps ON ps.profile_id = a.profile_id AND ps.list_id = a.list_id "
    "LEFT JOIN packs k ON k.profile_id = a.profile_id AND k.list_id = a.list_id"
)


def order_analysis(spark, sf):
    return analyze(B.formula_lines(spark, sf), B.open_requests(spark, sf), B.dimension(spark, sf), B.profiles(spark, sf), ORDER_MIN)


query("f15_analyze", ctes(ANALYZE_SQL, **ANALYZE))(order_analysis)


# Long lists under the size rule of the domain; each is asked about by one profile.
_LONG_REQUESTS = "SELECT DISTINCT list_id % (SELECT count(*) FROM customer) AS profile_id, list_id FROM lines"


@query("f15_analyze_long", ctes(ANALYZE_SQL, **dict(ANALYZE, lines=B.LONG_LINES_SQL, ver=Q.verified(K.MIN_LIST_SIZE), allreq=_LONG_REQUESTS)))
def f15_analyze_long(spark, sf):
    lines = kept(B.long_formula_lines(spark, sf), "lines")
    customers = F.broadcast(B.table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row
    asked = lines.select("list_id").distinct().join(customers).select((F.col("list_id") % F.col("n")).alias("profile_id"), "list_id")
    return analyze(lines, asked, B.dimension(spark, sf), B.profiles(spark, sf))


# The catalogue: a product per supplier and year, with the list of what the supplier shipped. Every list is asked about by one
# profile, half of them by product name; the others paste a list and give a name that no product has, or none.
_PRODUCT = "s_name || ' ' || CAST(list_id % 10000 AS STRING)"
_ASKED = "CASE list_id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN ' ' || name || ' ' WHEN 2 THEN name || ' refill' END"


def catalogue(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    """A product for each list of `lines`."""
    sold = lines.select("list_id").distinct().join(B.table(spark, sf, "supplier"), F.floor(F.col("list_id") / 10000) == F.col("s_suppkey"))
    return sold.select(F.col("list_id").alias("product_id"), F.expr(_PRODUCT).alias("name"), F.col("s_name").alias("brand"), F.col("list_id").alias("product_list"))


def asked_by_name(spark: SparkSession, sf: str, products: DataFrame) -> DataFrame:
    """The customer next to a list's number asks; one who names a product pastes a list of no lines beside it."""
    customers = F.broadcast(B.table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row
    lists = products.withColumnRenamed("product_list", "list_id").join(customers)
    pasted = F.when(F.col("list_id") % 4 < 2, -F.col("list_id")).otherwise(F.col("list_id"))
    return lists.select((F.col("list_id") % F.col("n")).alias("profile_id"), pasted.alias("list_id"), F.expr(_ASKED).alias("product_name"))


_FULL = dict(
    ANALYZE, lines=B.LONG_LINES_SQL, ver=Q.verified(K.MIN_LIST_SIZE),
    allreq="SELECT list_id % (SELECT count(*) FROM customer) AS profile_id, list_id, CASE WHEN list_id % 4 < 2 THEN list_id END AS product_id, "
    f"CASE WHEN list_id % 4 < 2 THEN name ELSE {_ASKED} END AS product_name, CASE WHEN list_id % 4 < 2 THEN 'catalog-verified' ELSE 'manual-input' END AS method, "
    "CASE WHEN list_id % 4 < 2 THEN s_name ELSE 'Manual Input' END AS site "
    f"FROM (SELECT list_id, {_PRODUCT.replace('STRING', 'VARCHAR')} AS name, s_name FROM (SELECT DISTINCT list_id FROM lines) JOIN supplier ON s_suppkey = list_id // 10000)",
    good=Q.top_messages("positive_reasons", "positive"), bad=Q.top_messages("negative_reasons", "negative"), unsafe=Q.top_messages("safety_reasons", "penalty"),
    pros="SELECT profile_id, list_id, string_agg(message, ' | ' ORDER BY rank) AS pros FROM good GROUP BY 1, 2",
    cons="SELECT profile_id, list_id, string_agg(message, ' | ' ORDER BY part, rank) AS cons FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, list_id ORDER BY part, rank) AS n "
    "FROM (SELECT *, 0 AS part FROM unsafe UNION ALL SELECT *, 1 FROM bad)) WHERE n <= 5 GROUP BY 1, 2",
)
_FC, _FN = Q.analysis_confidence("method", "site", "site")


@query(
    "f15_full_analysis",
    ctes(
        "SELECT a.profile_id, a.list_id, CASE WHEN a.verified THEN 'VERIFIED_INGREDIENTS_FOUND' ELSE 'NO_VERIFIED_INGREDIENTS' END AS status, a.rule, safety_score, suitability_score, "
        f"{Q.OVERALL} AS overall_score, CASE WHEN a.verified THEN conf ELSE 0 END AS confidence_score, CASE WHEN a.verified THEN {Q.VERDICT} END AS verdict, "
        "coalesce(strengths, '') AS strengths, coalesce(weaknesses, '') AS weaknesses, a.product_id, coalesce(a.product_name, 'Custom Ingredient List') AS product_name, "
        "CASE WHEN a.verified THEN array_to_string(notes, ' | ') ELSE '' END AS confidence_details, coalesce(pros, '') AS pros, coalesce(cons, '') AS cons "
        f"FROM (SELECT *, {_FC} AS conf, {_FN} AS notes FROM allreq JOIN ver USING (list_id)) a LEFT JOIN ps USING (profile_id, list_id) "
        "LEFT JOIN packs USING (profile_id, list_id) LEFT JOIN pros USING (profile_id, list_id) LEFT JOIN cons USING (profile_id, list_id)",
        **_FULL,
    ),
)
def f15_full_analysis(spark, sf):
    """The whole answer, from the catalogue where the product is known, else from the list typed in."""
    lines = kept(B.long_formula_lines(spark, sf), "lines")
    products = kept(catalogue(spark, sf, lines), "products")
    asked = kept(catalogue_requests(asked_by_name(spark, sf, products), products), "asked")
    return analyze(lines, asked, B.dimension(spark, sf), B.profiles(spark, sf), full=True)


@query(
    "f15_unknown_names",
    ctes("SELECT r.list_id, r.position, r.canonical_name AS name FROM res r JOIN ver v ON v.list_id = r.list_id WHERE r.ingredient_id IS NULL OR NOT v.verified", **CNT, ver=Q.verified(ORDER_MIN)),
)
def f15_unknown_names(spark, sf):
    return unknown_names(resolved_lines(spark, sf), ORDER_MIN)
