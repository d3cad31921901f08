"""DuckDB text for name resolution, verification and scoring."""

from __future__ import annotations

from ..functions import constants as K
from . import duck as D

_syn = "CASE {x} " + " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in K.SYNONYMS.items()) + " END"


def synonym(x: str) -> str:
    return _syn.replace("{x}", x)


ENTRIES = (
    "SELECT ingredient_id, name, i - 1 AS form_pos, " + D.compact_key("forms[i]") + " AS key FROM "
    "(SELECT ingredient_id, name, list_concat([name], aliases) AS forms, unnest(generate_series(1, 1 + len(aliases))) AS i FROM dim) "
    "WHERE " + D.compact_key("forms[i]") + " <> ''"
)
# last writer per key
DIRECT = (
    "SELECT key, ingredient_id, name FROM entries WHERE key NOT IN " + D.inlist(K.SYNONYMS) + " "
    "QUALIFY row_number() OVER (PARTITION BY key ORDER BY ingredient_id DESC, form_pos DESC) = 1"
)
TARGETS = (
    "SELECT " + D.compact_key("name") + " AS key, min(ingredient_id) AS ingredient_id, arg_min(name, ingredient_id) AS name FROM dim "
    "WHERE " + D.compact_key("name") + " IN " + D.inlist(sorted({"".join(c for c in v if c.isalnum()) for v in K.SYNONYMS.values()})) + " GROUP BY 1"
)


def resolved(lines: str, keep: str = "") -> str:
    """Resolved rows of a lines relation (list_id, position, raw_name)."""
    return (
        f"SELECT e.list_id, e.position, e.raw_name, e.normalized_input, coalesce(d.ingredient_id, t.ingredient_id) AS ingredient_id, "
        f"coalesce(d.name, t.name, e.normalized_input) AS canonical_name, "
        "CASE WHEN d.ingredient_id IS NULL AND t.ingredient_id IS NULL THEN 'unknown' WHEN t.ingredient_id IS NOT NULL THEN 'synonym' "
        f"WHEN {D.compact_key('d.name')} = e.input_key THEN 'exact' ELSE 'alias' END AS match_type{keep} FROM ("
        f"SELECT *, {D.compact_key('normalized_input')} AS input_key FROM (SELECT *, coalesce({synonym(D.compact_key('raw_name'))}, raw_name) "
        f"AS normalized_input FROM {lines})) e "
        f"LEFT JOIN direct d ON {synonym('e.input_key')} IS NULL AND d.key = e.input_key "
        f"LEFT JOIN targets t ON t.key = {D.compact_key(synonym('e.input_key'))}"
    )


# the nearest entry of each name that res0 misses, if it is near enough
NEAR = (
    "SELECT input_key, ingredient_id, name FROM (SELECT u.input_key, e.ingredient_id, e.name, levenshtein(u.input_key, e.key) AS distance, "
    "row_number() OVER (PARTITION BY u.input_key ORDER BY levenshtein(u.input_key, e.key), e.ingredient_id, e.form_pos) AS rn "
    "FROM (SELECT DISTINCT input_key FROM res0 WHERE ingredient_id IS NULL AND input_key <> '') u CROSS JOIN entries e) "
    "WHERE rn = 1 AND distance <= greatest(1, floor(length(input_key) * 18 / 100.0))"
)
WITH_NEAR = (
    "SELECT r.* EXCLUDE (input_key, ingredient_id, canonical_name, match_type), coalesce(r.ingredient_id, n.ingredient_id) AS ingredient_id, "
    "coalesce(n.name, r.canonical_name) AS canonical_name, CASE WHEN n.name IS NULL THEN r.match_type ELSE 'fuzzy' END AS match_type "
    "FROM res0 r LEFT JOIN near n ON r.ingredient_id IS NULL AND n.input_key = r.input_key"
)


def resolution(lines: str = "lines") -> dict[str, str]:
    return dict(entries=ENTRIES, direct=DIRECT, targets=TARGETS, res0=resolved(lines, ", e.input_key"), near=NEAR, res=WITH_NEAR)


SHOWN = "CASE WHEN match_type IN ('fuzzy', 'unknown') THEN normalized_input ELSE canonical_name END"


def looks_like_sentence(x):
    return f"(len(string_split_regex({x}, {D.q(D.SPACES + '+')})) > 8 OR {D.has(x, K.SENTENCE_PATTERN, False)})"


def has_marketing(x):
    return D.any_of(f"lower({x})", K.MARKETING_WORDS)


def has_emoji(x):
    return f"regexp_matches({x}, {D.q(K.EMOJI_PATTERN)})"


def percent_only(x):
    return D.has(x, K.PERCENT_ONLY_PATTERN, False)


def plausible(x):
    v = D.strip(x)
    n = f"len(list_filter(string_split_regex({v}, {D.q(D.SPACES + '+')}), lambda w: w <> ''))"
    return (
        f"(length({v}) BETWEEN 2 AND 140 AND NOT {looks_like_sentence(v)} AND NOT {has_marketing(v)} AND {D.has(v, K.INCI_CHARS_PATTERN)} "
        f"AND {n} <= 7 AND ({D.has(v, K.INCI_SUFFIX_PATTERN)} OR {D.has(v, K.INCI_WORDS_PATTERN)}))"
    )


def n_if(cond):
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def counters(rel: str = "res") -> str:
    support = (
        "r.ingredient_id IS NOT NULL AND (list_has_any(d.tags, ['preservative','solvent','surfactant','emulsifier']) OR d.name = 'water' "
        "OR contains(d.name, 'alcohol') OR contains(d.name, 'extract') OR contains(d.name, 'juice'))"
    )
    return (
        "SELECT list_id, CAST(count(*) AS BIGINT) AS row_count, "
        f"CAST(count(DISTINCT {D.compact_key(SHOWN)}) AS BIGINT) AS ingredient_count, "
        f"{n_if('r.ingredient_id IS NOT NULL')} AS matched_count, {n_if('r.ingredient_id IS NULL')} AS unknown_count, "
        f"{n_if('r.ingredient_id IS NULL AND ' + plausible('normalized_input'))} AS plausible_count, "
        f"{n_if('match_type IN (' + chr(39) + 'alias' + chr(39) + ',' + chr(39) + 'synonym' + chr(39) + ')')} AS alias_count, "
        f"{n_if(percent_only('raw_name'))} AS percent_count, {n_if(looks_like_sentence('raw_name'))} AS sentence_count, "
        f"{n_if(has_marketing('raw_name') + ' OR ' + has_emoji('raw_name'))} AS marketing_count, "
        f"coalesce(bool_or({support}), false) AS has_support FROM {rel} r LEFT JOIN dim d ON d.ingredient_id = r.ingredient_id GROUP BY list_id"
    )


def verified(min_count: int, rel: str = "cnt", raw: str = "row_count") -> str:
    eff = "(matched_count * 10 + plausible_count * 7) / (greatest(row_count, 1) * 10.0)"
    arms = [
        ("MIN_INGREDIENT_COUNT", f"ingredient_count < {min_count}", "0.0"),
        ("PERCENTAGE_ONLY", f"percent_count >= ceil({raw} * 50 / 100.0)", "0.08"),
        ("SENTENCE_CONTENT", f"sentence_count >= 2 OR sentence_count >= ceil({raw} * 30 / 100.0)", "0.1"),
        ("MARKETING_COPY", f"marketing_count >= 2 OR marketing_count >= ceil({raw} * 25 / 100.0)", "0.1"),
        ("LOW_INCI_MATCH", f"{eff} < 0.55", "0.2"),
        ("MISSING_SUPPORT_SIGNALS", "NOT has_support", "0.22"),
    ]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c, _ in arms) + " ELSE 'PASSED' END"
    failed = "CASE " + " ".join(f"WHEN {c} THEN CAST({v} AS DOUBLE)" for _, c, v in arms) + " END"
    rate = "matched_count / CAST(greatest(row_count, 1) AS DOUBLE)"
    return (
        f"SELECT *, rule = 'PASSED' AS verified FROM (SELECT *, {rule} AS rule, {failed} AS failed_confidence, floor({rate} * 100 + 0.5) / 100 AS match_rate, "
        f"CAST(floor({eff} * 100 + 0.5) AS BIGINT) AS effective_percent, CAST(floor({rate} * 100 + 0.5) AS BIGINT) AS match_percent FROM {rel})"
    )


def reason(min_count: int, source: str) -> str:
    return (
        "CASE rule WHEN 'MIN_INGREDIENT_COUNT' THEN 'Ingredient list is too short to trust. Found ' || ingredient_count || "
        f"' ingredients, but at least {min_count} are required.' "
        "WHEN 'PERCENTAGE_ONLY' THEN 'The extracted text looks like percentage claims, not a full ingredient list.' "
        "WHEN 'SENTENCE_CONTENT' THEN 'The extracted text contains sentence-style content instead of INCI entries.' "
        "WHEN 'MARKETING_COPY' THEN 'The extracted section looks like marketing copy, not a verified INCI ingredient list.' "
        "WHEN 'LOW_INCI_MATCH' THEN 'Only ' || effective_percent || '% of entries matched known or plausible INCI ingredients.' "
        "WHEN 'MISSING_SUPPORT_SIGNALS' THEN 'The list lacks the supporting INCI signals expected in a complete cosmetic formula.' "
        f"ELSE 'Verified ' || ingredient_count || ' ingredients with ' || match_percent || '% INCI match from ' || coalesce(nullif({source}, ''), 'the source page') || '.' END"
    )


def source_points(method, website, brand):
    return (
        f"CASE WHEN starts_with({method}, 'official-site') OR ({brand} <> '' AND contains(lower({website}), lower({brand}))) THEN 32 "
        f"WHEN starts_with({method}, 'trusted-database') THEN 20 WHEN starts_with({method}, 'distributor') THEN 15 "
        f"WHEN contains({method}, 'dom') OR contains({method}, 'next') OR contains({method}, 'json') THEN 14 "
        f"WHEN {method} IN ('openai-structured-output', 'ai-structured-output') THEN 8 ELSE 0 END"
    )


def verification_confidence(method, website, brand):
    r = "greatest(row_count, 1)"
    rate = f"CASE WHEN matched_count * 100 >= {r} * 90 THEN 18 WHEN matched_count * 100 >= {r} * 75 THEN 12 WHEN matched_count * 100 >= {r} * 60 THEN 8 ELSE 0 END"
    pts = f"38 + ({source_points(D.text(method), D.text(website), D.text(brand))}) + ({rate}) - unknown_count * 5"
    return f"CASE WHEN verified THEN greatest(5, least(99, {pts})) / 100.0::DOUBLE ELSE failed_confidence END"


def analysis_confidence(method, website, brand):
    r, key = "greatest(row_count, 1)", f"trim(lower({D.text(brand)}))"
    off = f"(starts_with({method}, 'official-site') OR ({key} <> '' AND contains(lower({D.text(website)}), {key})))"
    pts = (
        f"40 + CASE WHEN {off} THEN 30 WHEN {method} IN ('html', 'playwright') THEN 18 ELSE 0 END "
        f"+ CASE WHEN matched_count * 10 >= {r} * 9 THEN 20 WHEN matched_count * 10 >= {r} * 7 THEN 12 ELSE 0 END - unknown_count * 5 "
        f"- CASE WHEN {method} = 'ocr' THEN 10 ELSE 0 END "
        f"- CASE WHEN {D.text(website)} <> '' AND NOT starts_with({method}, 'official-site') AND {key} = '' THEN 4 ELSE 0 END"
    )
    notes = (
        f"list_filter([CASE WHEN {off} THEN 'Official manufacturer ingredient list found' WHEN {method} IN ('html', 'playwright') THEN "
        f"'Ingredient list extracted directly from the product page' END, CASE WHEN matched_count * 10 >= {r} * 7 THEN "
        f"CAST(floor(matched_count * 100 / CAST({r} AS DOUBLE) + 0.5) AS BIGINT) || '% ingredient match' END, "
        "'Concentration estimated from ingredient order'], lambda t: t IS NOT NULL)"
    )
    return f"CAST(greatest(0, least(100, {pts})) AS BIGINT)", notes


# ------------------------------------------------------------------ scoring
def ordered_distinct(x):
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def codes(x):
    return f"list_filter(list_transform({x}, lambda c: {D.code_key('c')}), lambda c: c <> '')"


def mapped(x, mapping):
    arms = " ".join(f"WHEN {D.q(k)} THEN {D.lst([k, *v])}" for k, v in mapping.items())
    return f"flatten(list_transform({x}, lambda c: CASE c {arms} ELSE [c] END))" if mapping else x


def od(rel, col, keep):
    """Column made distinct in order, one SELECT level to keep the text short."""
    return f"SELECT {keep}, list_filter({col}, lambda v, i: list_position({col}, v) = i) AS {col} FROM ({rel})"


def tier(pos, name):
    label = " ".join(f"WHEN {pos} <= {last} THEN '{t}'" for last, t, _ in K.POSITION_TIERS[:-1])
    weight = " ".join(f"WHEN {pos} <= {last} THEN {int(round(w * 100))}" for last, _, w in K.POSITION_TIERS[:-1])
    low = f"{pos} >= {K.LOW_DOSE_FROM} AND lower({name}) IN {D.inlist(K.LOW_DOSE_NAMES)}"
    return (
        f"CASE WHEN {low} THEN '{K.LOW_DOSE[0]}' {label} ELSE '{K.POSITION_TIERS[-1][1]}' END",
        f"CASE WHEN {low} THEN {int(round(K.LOW_DOSE[1] * 100))} {weight} ELSE {int(round(K.POSITION_TIERS[-1][2] * 100))} END",
    )


def context() -> str:
    terms = lambda c: f"list_filter(list_transform(string_split_regex({D.text(c)}, '[,;]+'), lambda t: {D.lower_text('t')}), lambda t: t <> '')"
    drop = lambda x: f"list_filter({x}, lambda c: c NOT IN ('NONE', 'OTHER'))"
    mult = "CASE c_sens " + " ".join(f"WHEN '{k}' THEN {int(round(v * 100))}" for k, v in K.SENSITIVITY_MULTIPLIERS.items()) + " ELSE 100 END"
    desired = (
        f"list_concat(list_concat({mapped('c_concerns', K.CONCERN_DIMENSIONS)}, {mapped('c_goals', K.GOAL_DIMENSIONS)}), "
        f"list_concat(CASE c_skin WHEN 'DRY' THEN {D.lst(K.DRY_DIMENSIONS)} WHEN 'OILY' THEN {D.lst(K.OILY_DIMENSIONS)} ELSE [] END, "
        f"CASE WHEN c_sens <> 'NOT_SENSITIVE' THEN {D.lst(K.SENSITIVE_DIMENSIONS)} ELSE [] END))"
    )
    base = (
        f"SELECT profile_id, {D.code_key('skin_type')} AS c_skin, {D.code_key('skin_sensitivity')} AS c_sens, {codes('concerns')} AS c_concerns, "
        f"{codes('goals')} AS c_goals, {drop(codes('allergies'))} AS c_allergy, {drop(codes('avoid_ingredients'))} AS c_avoid, "
        f"{terms('other_allergy')} AS c_allergy_terms, {terms('other_avoid')} AS c_avoid_terms FROM prof"
    )
    return (
        f"SELECT * EXCLUDE (d), list_filter(d, lambda v, i: list_position(d, v) = i) AS c_desired FROM (SELECT *, {desired} AS d, "
        "c_skin = 'OILY' OR list_has_any(c_concerns, ['ACNE', 'EXCESS_OIL']) OR list_has_any(c_goals, ['ACNE_CONTROL', 'OIL_CONTROL']) AS c_non_comedogenic, "
        f"c_skin = 'SENSITIVE' OR c_sens <> 'NOT_SENSITIVE' OR list_contains(c_concerns, 'REDNESS') AS c_sensitive, {mult} AS c_mult FROM ({base}))"
    )


def trigger_list(groups):
    marks = []
    for code, triggers in groups.items():
        if not triggers:
            continue
        cond = " OR ".join(
            f"contains(s_corpus, {D.q(t.lower())}) OR list_contains(s_codes, {D.q(''.join(c if c.isalnum() else '_' for c in t))})" for t in triggers
        )
        marks.append(f"CASE WHEN {cond} THEN {D.q(code)} END")
    return f"list_filter([{', '.join(marks)}], lambda t: t IS NOT NULL)"


def signals() -> str:
    fields = ["functions", "helps", "tags", "avoid_for", "risk_flags", "suitable_skin_types", "avoid_skin_types"]
    base = "SELECT *, " + ", ".join(f"{codes(f)} AS s_{f}" for f in fields) + ", list_filter(list_concat([name, inci_name, scientific_name, purpose, display_purpose], " \
        "list_concat(list_concat(list_concat(aliases, tags), list_concat(functions, helps)), list_concat(avoid_for, risk_flags))), lambda v: v IS NOT NULL AND v <> '') AS vals FROM dim"
    step2 = (
        f"SELECT *, {codes('vals')} AS s_codes, array_to_string(list_transform(vals, lambda v: {D.lower_text('v')}), ' ') AS s_corpus, "
        f"list_concat(s_helps, list_concat({mapped('s_functions', K.FUNCTION_DIMENSIONS)}, {mapped('s_tags', K.TAG_DIMENSIONS)})) AS b FROM ({base})"
    )
    level = D.code_key(D.text("evidence_level"))
    ev = f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {int(round(v * 100))}" for k, v in K.EVIDENCE_MULTIPLIERS.items()) + f" ELSE {int(round(K.EVIDENCE_DEFAULT * 100))} END"
    step3 = f"SELECT * EXCLUDE (b, vals), list_filter(b, lambda v, i: list_position(b, v) = i) AS s_benefits, {level} AS s_evidence, {ev} AS s_ev FROM ({step2})"
    return (
        "SELECT *, list_contains(s_functions, 'SOOTHING') OR list_contains(s_functions, 'ANTI_INFLAMMATORY') OR list_contains(s_tags, 'SOOTHING') "
        "OR list_contains(s_benefits, 'REDNESS') AS s_soothing, list_contains(s_tags, 'FRAGRANCE') OR list_contains(s_avoid_for, 'FRAGRANCE_ALLERGY') "
        "OR list_contains(s_risk_flags, 'ALLERGEN') AS s_fragrance, list_has_any(s_tags, ['ESSENTIAL_OIL', 'ESSENTIAL_OILS']) AS s_essential, "
        f"{trigger_list(K.ALLERGY_TRIGGERS)} AS s_allergy_hits, {trigger_list(K.AVOID_TRIGGERS)} AS s_avoid_hits FROM ({step3})"
    )


def hits(code_col, term_col, fixed, groups):
    known = D.lst(list(groups))
    return (
        f"list_concat(list_filter({code_col}, lambda c: list_contains({fixed}, c) OR (NOT list_contains({known}, c) AND "
        f"(list_contains(s_codes, c) OR contains(s_corpus, lower(c))))), list_filter({term_col}, lambda t: list_contains(s_codes, {D.code_key('t')}) "
        "OR contains(s_corpus, t)))"
    )


def scored(rel: str = "res", req: str = "req", display: str = "coalesce(s.name, r.canonical_name)") -> str:
    label, weight = tier("r.position", display)
    rows = (
        f"SELECT q.profile_id, q.list_id, r.position, {display} AS display_name, {label} AS estimated_range, {weight} AS w, r.ingredient_id, "
        "s.* EXCLUDE (ingredient_id), c.* EXCLUDE (profile_id), "
        "list_filter(coalesce(s.s_benefits, []), lambda d: list_contains(c.c_desired, d)) AS benefits FROM "
        f"{req} q JOIN {rel} r ON r.list_id = q.list_id JOIN ctx c ON c.profile_id = q.profile_id LEFT JOIN sig s ON s.ingredient_id = r.ingredient_id"
    )
    rows = (
        f"SELECT *, {hits('c_allergy', 'c_allergy_terms', 's_allergy_hits', K.ALLERGY_TRIGGERS)} AS allergy_hits, "
        f"{hits('c_avoid', 'c_avoid_terms', 's_avoid_hits', K.AVOID_TRIGGERS)} AS avoid_hits FROM ({rows})"
    )
    known = "ingredient_id IS NOT NULL"

    def add(*pairs):
        return " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in pairs)

    hit, al, av = "len(benefits) > 0", "len(allergy_hits) > 0", "len(avoid_hits) > 0"
    pen = add(
        ("risk_level = 'HIGH'", "4000 * w"), ("risk_level = 'MEDIUM'", "2000 * w"), ("irritation >= 3", "8000 * w"),
        ("irritation = 2", "4500 * w"), ("c_sensitive AND irritation >= 1", "irritation * 15 * c_mult * w"),
        ("comedogenic >= 4", "6000 * w"), ("comedogenic IN (2, 3)", "3000 * w"), ("list_contains(s_risk_flags, 'ALLERGEN')", "4000 * w"),
        ("list_contains(s_risk_flags, 'IRRITANT')", "3000 * w"), ("s_fragrance", "2000 * w"), ("s_essential", "3000 * w"), (al, "14000 * w"),
    )
    pos = add(
        (hit, "least(4, len(benefits)) * 24 * w * s_ev"), ("list_contains(s_suitable_skin_types, c_skin)", "2000 * w"),
        ("c_sensitive AND s_soothing", "25 * w * s_ev"), (f"c_skin = 'DRY' AND list_has_any(benefits, {D.lst(K.DRY_FOCUS)})", "1800 * w"),
        (f"c_skin = 'OILY' AND list_has_any(benefits, {D.lst(K.OILY_FOCUS)})", "1800 * w"), (f"s_evidence = 'HIGH' AND {hit}", "900 * w"),
        (f"s_evidence = 'MODERATE' AND {hit}", "350 * w"),
    )
    neg = add(
        ("list_contains(s_avoid_skin_types, c_skin)", "8000 * w"), ("c_non_comedogenic AND comedogenic >= 4", "8000 * w"),
        ("c_non_comedogenic AND comedogenic IN (2, 3)", "3500 * w"), ("c_sensitive AND irritation >= 2", "55 * w * c_mult"),
        ("c_sensitive AND irritation < 2 AND s_fragrance", "35 * w * c_mult"), (al, "16000 * w"), (av, "10000 * w"),
    )
    say = lambda cond, txt: f"CASE WHEN {cond} THEN display_name || {txt} END"
    clean = lambda *xs: "list_filter([" + ", ".join(xs) + "], lambda t: t IS NOT NULL)"
    skin = "replace(lower(c_skin), '_', ' ')"
    labels = " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in K.DIMENSION_LABELS.items())
    desc = f"array_to_string(list_transform(benefits[1:2], lambda d: CASE d {labels} ELSE {D.lower_text('d')} END), ' and ')"
    suit = "list_contains(s_suitable_skin_types, c_skin)"
    pr = clean(
        say(hit, f"' supports ' || {desc} || '.'"), say(suit, f"' is generally compatible with ' || {skin} || ' skin.'"),
        say("c_sensitive AND s_soothing", "' adds soothing support for reactive skin.'"),
    )
    nr = clean(
        f"CASE WHEN NOT ({known}) THEN 'Knowledge about this ingredient is limited.' END",
        say("list_contains(s_avoid_skin_types, c_skin)", f"' is not ideal for ' || {skin} || ' skin.'"),
        say("c_non_comedogenic AND comedogenic >= 4", "' may feel too heavy or clog-prone for your profile.'"),
        say("c_sensitive AND irritation >= 2", "' may irritate sensitive skin.'"),
        say("c_sensitive AND irritation < 2 AND s_fragrance", "' can be challenging for sensitive skin.'"),
        say(al, "' overlaps with one of your allergy triggers.'"), say(av, "' matches one of the ingredients you prefer to avoid.'"),
    )
    sr = clean(
        f"CASE WHEN NOT ({known}) THEN 'This ingredient is not mapped in the current knowledge base.' END",
        say("irritation >= 3", "' raises irritation risk.'"), say("c_sensitive AND irritation >= 1", "' may stress a sensitive skin barrier.'"),
        say("comedogenic >= 4", "' has a higher clogging risk.'"), say(al, "' overlaps with one of your listed allergy triggers.'"),
    )
    full = (
        f"SELECT *, CAST(CASE WHEN {known} THEN {pen} ELSE 2500 * w END AS BIGINT) AS penalty, CAST(CASE WHEN {known} THEN {pos} ELSE 0 END AS BIGINT) AS positive, "
        f"CAST(CASE WHEN {known} THEN {neg} ELSE 0 END AS BIGINT) AS negative, {pr} AS positive_reasons, {nr} AS negative_reasons, {sr} AS safety_reasons FROM ({rows})"
    )
    full = f"SELECT *, CAST(floor((positive - negative + 500) / 1000.0) AS BIGINT) AS net FROM ({full})"
    return (
        "SELECT *, CASE WHEN ingredient_id IS NULL THEN 'Neutral' WHEN net <= -200 OR len(negative_reasons) >= 2 THEN 'Low Match' "
        f"WHEN net >= 200 THEN 'Good Match' ELSE 'Neutral' END AS fit_label FROM ({full})"
    )


PAIR_SCORES = (
    "SELECT profile_id, list_id, count(*) AS line_count, count(*) FILTER (WHERE ingredient_id IS NULL) AS unknown_count, "
    "CAST(greatest(0, least(100, floor((10000000 - sum(penalty) - least(10, 2 * count(*) FILTER (WHERE ingredient_id IS NULL)) * 100000) / 100000.0 + 0.5))) AS BIGINT) AS safety_score, "
    "CAST(greatest(0, least(100, floor((6000 + sum(net) - least(600, 150 * count(*) FILTER (WHERE ingredient_id IS NULL))) / 100.0 + 0.5))) AS BIGINT) AS suitability_score "
    "FROM scored GROUP BY profile_id, list_id"
)
OVERALL = "CAST(floor((safety_score * 45 + suitability_score * 55 + 50) / 100.0) AS BIGINT)"
VERDICT = (
    "CASE WHEN safety_score > 85 AND suitability_score > 85 THEN 'Excellent choice for your profile.' "
    "WHEN safety_score > 85 AND suitability_score >= 60 THEN 'Safe formula but only partially suited to your skin profile.' "
    "WHEN safety_score < 60 THEN 'Contains several ingredients that may increase irritation or clogging risk.' "
    "WHEN suitability_score < 60 THEN 'Reasonably safe overall, but not the best fit for your current skin needs.' "
    "ELSE 'A generally balanced formula with some tradeoffs depending on your skin profile.' END"
)


def top_messages(reasons, impact, k=5):
    said = f"SELECT profile_id, list_id, {impact} AS impact, position, i, {reasons}[i] AS message FROM (SELECT *, unnest(generate_series(1, len({reasons}))) AS i FROM scored)"
    best = f"SELECT * FROM ({said}) QUALIFY row_number() OVER (PARTITION BY profile_id, list_id, message ORDER BY impact DESC, position, i) = 1"
    return (
        f"SELECT profile_id, list_id, CAST(row_number() OVER (PARTITION BY profile_id, list_id ORDER BY impact DESC, position, i) AS INT) AS rank, message "
        f"FROM ({best}) QUALIFY rank <= {k}"
    )


def top_ingredients(k=3):
    up = "SELECT profile_id, list_id, position, display_name, net, CAST(row_number() OVER (PARTITION BY profile_id, list_id ORDER BY net DESC, position) AS INT) AS rank, 'strength' AS side FROM scored WHERE net > 80 QUALIFY rank <= " + str(k)
    down = "SELECT profile_id, list_id, position, display_name, net, CAST(row_number() OVER (PARTITION BY profile_id, list_id ORDER BY net, position) AS INT) AS rank, 'weakness' AS side FROM scored WHERE net < -80 QUALIFY rank <= " + str(k)
    return f"{up} UNION ALL {down}"
