"""Standardisation queries over listings, documents, URLs and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import standardise as S
from ..sources import bindings as B
from . import duck as D
from .registry import ctes, query

L = dict(li=B.LISTINGS_SQL)
joined = lambda x: f"array_to_string({x}, '|')"
BRAND = "'Maker' || replace(p_brand, 'Brand#', 'x')"


def unnest_pos(keep: str, arr: str, rel: str, value: str, pos: str = "position") -> str:
    """keep, zero-based position, element."""
    return (
        f"SELECT {keep}, CAST(i - 1 AS INT) AS {pos}, a[i] AS {value} FROM (SELECT {keep}, a, unnest(generate_series(1, len(a))) AS i FROM "
        f"(SELECT *, {arr} AS a FROM {rel}))"
    )


@query("b1_ingredient_tokens", unnest_pos("list_id", D.split_list("sep"), f"(SELECT doc_id AS list_id, {D.list_separators('text')} AS sep FROM documents)", "raw_name"))
def b1_ingredient_tokens(spark, sf):
    return S.explode_ingredients(B.texts(spark, sf, "documents"), "text", "doc_id")


DRESSED = "upper(p_name) || ' (' || lower(p_type) || ') 5%x ™ & Co_' || p_brand || '.0' || CAST(p_size AS STRING)"


@query("b2_lookup_keys", "SELECT p_partkey, " + ", ".join(f"{fn(DRESSED)} AS {k}_key" for k, fn in D.KEYS.items()) + " FROM part")
def b2_lookup_keys(spark, sf):
    df = B.table(spark, sf, "part").withColumn("dressed", F.expr(DRESSED))
    for flavour in T.KEY_FLAVOURS:
        df = S.add_key(df, "dressed", flavour, f"{flavour}_key")
    return df.select("p_partkey", *[f"{k}_key" for k in T.KEY_FLAVOURS])


@query("b2_evidence_keys", f"SELECT doc_id, md5({D.evidence_key('text')}) AS key_hash, CAST(length({D.evidence_key('text')}) AS INT) AS key_length FROM documents")
def b2_evidence_keys(spark, sf):
    df = S.add_key(B.texts(spark, sf, "documents"), "text", "evidence")
    return df.select("doc_id", F.md5("key").alias("key_hash"), F.length("key").alias("key_length"))


_VARIED = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' (' || p_type || ')' ELSE replace(p_name, ' ', '-') END"


@query(
    "b2_key_collisions",
    f"SELECT {D.compact_key('n')} AS key, count(DISTINCT n) AS name_count, min(n) AS first_name, max(n) AS last_name FROM "
    f"(SELECT {_VARIED} AS n FROM part UNION ALL SELECT s_name FROM supplier) GROUP BY 1 HAVING count(DISTINCT n) > 1",
)
def b2_key_collisions(spark, sf):
    names = B.table(spark, sf, "part").select(F.expr(_VARIED).alias("n")).unionAll(B.table(spark, sf, "supplier").select("s_name"))
    return S.key_collisions(names, "n", "compact")


_SECTION = "text || ' Full Ingredients : ' || text || ' ; a, b ,c Directions: rinse ' || text"


@query(
    "b3_trim_sections",
    "SELECT doc_id, " + ", ".join(f"md5({k}) AS {k}_hash, CAST(length({k}) AS INT) AS {k}_length" for k in D.SECTIONS)
    + " FROM (SELECT doc_id, " + ", ".join(f"{fn('s')} AS {k}" for k, fn in D.SECTIONS.items()) + f" FROM (SELECT doc_id, {_SECTION} AS s FROM documents))",
)
def b3_trim_sections(spark, sf):
    df = B.texts(spark, sf, "documents").withColumn("s", F.expr(_SECTION))
    for k in T.SECTION_PROFILES:
        df = S.trim_section(df, "s", k, k)
    cols = [c for k in T.SECTION_PROFILES for c in (F.md5(k).alias(f"{k}_hash"), F.length(k).alias(f"{k}_length"))]
    return df.select("doc_id", *cols)


@query("b4_clean_titles", ctes(f"SELECT p_partkey, {D.clean_title('noisy')} AS clean_title FROM li", **L))
def b4_clean_titles(spark, sf):
    return S.clean_title(B.listings(spark, sf), "noisy").select("p_partkey", "clean_title")


@query("b4_clean_page_titles", f"SELECT page_id, {D.clean_title(D.get('html', '<title[^>]*>([^<]+)</title>'))} AS clean_title FROM pages")
def b4_clean_page_titles(spark, sf):
    df = B.texts(spark, sf, "pages").withColumn("t", T.get(F.col("html"), "<title[^>]*>([^<]+)</title>"))
    return S.clean_title(df, "t").select("page_id", "clean_title")


def identity_ctes(title: str, rel: str, brand: str, category: str, prefix: str = "") -> dict:
    """Steps size -> work -> variant -> core of a title column, as chained CTEs."""
    p = prefix
    return {
        f"{p}s1": f"SELECT *, {D.ws(title)} AS {p}t FROM {rel}",
        f"{p}s2": f"SELECT *, {D.last_size(D.clean_title(p + 't'))} AS {p}size FROM {p}s1",
        f"{p}s3": f"SELECT *, {D.drop_size('(' + D.drop_prefix(p + 't', brand) + ')', p + 'size')} AS {p}w FROM {p}s2",
        f"{p}s4": f"SELECT *, {D.lower_keywords(p + 'w', category)} AS {p}k FROM {p}s3",
        f"{p}s5": f"SELECT *, {D.variant_from(p + 'k')} AS {p}variant FROM {p}s4",
        f"{p}s6": f"SELECT *, {D.drop_first(p + 'w', p + 'variant')} AS {p}c FROM {p}s5",
        f"{p}s7": f"SELECT *, {D.core_tail(p + 'c', p + 't')} AS {p}core FROM {p}s6",
    }


_CAT = D.category_of("title")


@query(
    "b5_parse_identity",
    ctes(
        "SELECT p_partkey, size, variant, core AS core_name FROM s7",
        li=B.LISTINGS_SQL, base=f"SELECT *, {BRAND} AS brand, {_CAT} AS category FROM li", **identity_ctes("noisy", "base", "brand", "category"),
    ),
)
def b5_parse_identity(spark, sf):
    df = B.listings(spark, sf).withColumn("brand", F.expr(BRAND)).withColumn("category", T.category_of(F.col("title")))
    return S.parse_identity(df, "noisy", "brand", "category").select("p_partkey", "size", "variant", "core_name")


_SKU_A = "CASE p_partkey % 3 WHEN 0 THEN 'item  code # ab' || CAST(p_partkey + 1000 AS STRING) WHEN 1 THEN '' ELSE 'n/a' END"
_SKU_B = "CASE p_partkey % 2 WHEN 0 THEN 'model:z9-' || CAST(p_partkey AS STRING) || 'qq' ELSE 'REF-' || CAST(p_partkey AS STRING) END"


@query("b6_extract_sku", f"SELECT p_partkey, {D.sku_of('a', 'b', 'p_name')} AS sku FROM (SELECT *, {_SKU_A} AS a, {_SKU_B} AS b FROM part)")
def b6_extract_sku(spark, sf):
    df = B.table(spark, sf, "part").withColumn("a", F.expr(_SKU_A)).withColumn("b", F.expr(_SKU_B))
    return df.select("p_partkey", T.sku_of(F.col("a"), F.col("b"), F.col("p_name")).alias("sku"))


@query("b7_classify_category", ctes(f"SELECT p_partkey, {D.category_of('noisy', 'p_type')} AS category, {D.product_type_of('p_type', 'noisy')} AS product_type FROM li", **L))
def b7_classify_category(spark, sf):
    df = B.listings(spark, sf)
    return df.select(
        "p_partkey", T.category_of(F.col("noisy"), F.col("p_type")).alias("category"), T.product_type_of(F.col("p_type"), F.col("noisy")).alias("product_type")
    )


_BT = "CASE p_partkey % 5 WHEN 0 THEN 'Lotion by  mad & sons face' WHEN 1 THEN 'brand: x.y-' || p_name || ' serum' WHEN 2 THEN 'buy ' || p_name || ' dr. water' WHEN 3 THEN '' ELSE title END"
_BH = "'https://www.' || replace(p_name, ' ', '-') || '.shop.com/x'"


@query("b8_detect_brand", ctes(f"SELECT p_partkey, {D.detect_brand('a', 'h')} AS brand, {D.detect_brand('h')} AS host_brand FROM (SELECT *, {_BT} AS a, {_BH} AS h FROM li)", **L))
def b8_detect_brand(spark, sf):
    df = B.listings(spark, sf).withColumn("a", F.expr(_BT)).withColumn("h", F.expr(_BH))
    return df.select("p_partkey", T.detect_brand(F.col("a"), F.col("h")).alias("brand"), T.detect_brand(F.col("h")).alias("host_brand"))


def duck_path(url):
    return f"coalesce(nullif(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '')"


_human = "decoded"
for _w in ("percentage", "pct", "percent"):
    _human = D.sub_all(_human, rf"\b{_w}\b", "%")
_SEG_SCORE = (
    f"CASE WHEN decoded = '' OR lower(decoded) IN {D.inlist(K.NON_PRODUCT_SEGMENTS)} THEN -1000 WHEN regexp_full_match(decoded, '[0-9]+') THEN -900 "
    "WHEN regexp_full_match(decoded, '[A-Za-z0-9]{8,14}') AND regexp_matches(decoded, '[0-9]') AND NOT contains(decoded, '-') THEN -750 "
    f"ELSE least(length(title), 120) + CASE WHEN {D.detect_brand('title')} <> '' THEN 45 ELSE 0 END + CASE WHEN {D.category_of('title')} <> 'Product' THEN 35 ELSE 0 END "
    f"+ CASE WHEN {D.has('title', K.SEGMENT_KEYWORDS)} THEN 25 ELSE 0 END - CASE WHEN {D.has('title', K.SEGMENT_CAMPAIGN)} THEN 80 ELSE 0 END END"
)
_URL = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/gentle-face-wash_5pct.html' ELSE 'https://x.example.com/shop/p/' || CAST(page_id AS STRING) || '/new%20oat-serum+x/abc12345' END"


@query(
    "b9_name_from_url",
    ctes(
        f"SELECT page_id, CASE WHEN score >= 0 THEN {D.clean_title('title')} ELSE 'Linked Product' END AS product_name FROM best "
        "UNION ALL SELECT page_id, 'Linked Product' FROM u WHERE page_id NOT IN (SELECT page_id FROM best)",
        u=f"SELECT page_id, {_URL} AS u FROM pages",
        seg="SELECT page_id, pos, " + D.strip("url_decode(raw)") + " AS decoded FROM (" + unnest_pos("page_id", f"list_filter(string_split({duck_path('u')}, '/'), lambda p: p <> '')", "u", "raw", "pos") + ")",
        tit=f"SELECT *, {D.slug_title(_human)} AS title FROM seg",
        best=f"SELECT * FROM (SELECT *, {_SEG_SCORE} AS score FROM tit) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1",
    ),
)
def b9_name_from_url(spark, sf):
    df = B.texts(spark, sf, "pages").withColumn("u", F.expr(_URL))
    return S.name_from_url(df, "u", "page_id")


_PRODUCT_COLS = {
    "name": "noisy", "brand": BRAND, "description": "'sku: zz-' || CAST(p_partkey AS STRING) || '0 with ' || p_name || ' ' || CAST(p_size AS STRING) || ' g'",
    "variant": "CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE '' END", "size": "CASE WHEN p_partkey % 3 = 0 THEN '10 oz' ELSE '' END", "sku": "''", "canonical_name": "''",
}
PRODUCTS_SQL = "SELECT p_partkey, p_type, title, " + ", ".join(f"{v} AS {k}" for k, v in _PRODUCT_COLS.items()) + f", {_CAT} AS category FROM li"


def products(spark, sf):
    df = B.listings(spark, sf)
    return df.select("p_partkey", "p_type", "title", *[F.expr(v).alias(k) for k, v in _PRODUCT_COLS.items()], T.category_of(F.col("title")).alias("category"))


ENRICHED = {
    **L,
    "prod": PRODUCTS_SQL,
    "e1": f"SELECT *, {D.clean_title('name')} AS ttl FROM prod",
    "e2": f"SELECT *, {D.ws('ttl || chr(32) || description')} AS both_text FROM e1",
    **identity_ctes("both_text", "e2", "brand", "category", "b"),
    **identity_ctes("ttl", "bs7", "brand", "category", "t"),
    "enr": (
        f"SELECT p_partkey, p_type, title, brand, category, description, coalesce(nullif({D.clean_title('tcore')}, ''), ttl) AS name, {D.clean_title('tcore')} AS canonical_name, "
        f"coalesce(nullif(variant, ''), bvariant) AS variant, coalesce(nullif(size, ''), bsize) AS size, {D.sku_of('sku', 'description', 'ttl')} AS sku FROM ts7"
    ),
}


@query("b10_enrich_identity", ctes("SELECT p_partkey, name, canonical_name, variant, size, sku FROM enr", **ENRICHED))
def b10_enrich_identity(spark, sf):
    return S.enrich_identity(products(spark, sf)).select("p_partkey", "name", "canonical_name", "variant", "size", "sku")


def enriched(spark, sf):
    return S.enrich_identity(products(spark, sf))


@query(
    "b11_title_tokens",
    ctes(f"SELECT p_partkey, {joined(D.title_tokens(D.clean_title('noisy')))} AS tokens FROM li", **L),
)
def b11_title_tokens(spark, sf):
    return S.title_tokens(B.listings(spark, sf), "noisy").select("p_partkey", F.array_join("tokens", "|").alias("tokens"))


_PAIRED = "SELECT a.p_partkey, a.noisy AS l, b.title AS r FROM li a JOIN li b ON b.p_partkey = a.p_partkey + CASE WHEN a.p_partkey % 2 = 0 THEN 0 ELSE 7 END"


@query(
    "b11_strong_overlap",
    ctes(
        "SELECT p_partkey, CAST(shared AS INT) AS shared, least(2, len(lt), len(rt)) > 0 AND shared >= least(2, len(lt), len(rt)) AS strong FROM "
        "(SELECT *, len(list_filter(lt, lambda t: list_contains(rt, t))) AS shared FROM tok)",
        **L, pairs=_PAIRED, tok=f"SELECT p_partkey, {D.title_tokens(D.clean_title('l'))} AS lt, {D.title_tokens(D.clean_title('r'))} AS rt FROM pairs",
    ),
)
def b11_strong_overlap(spark, sf):
    li = B.listings(spark, sf)
    right = li.select(F.col("p_partkey").alias("k"), F.col("title").alias("r"))
    left = li.select("p_partkey", F.col("noisy").alias("l"), (F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(7)).alias("k"))
    return S.strong_overlap(left.join(right, "k"), "l", "r").select("p_partkey", "shared", "strong")


@query("b12_tag_listings", ctes(
    f"SELECT p_partkey, {joined(D.tags_of('x', K.ACTIVE_RULES))} AS actives, {joined(D.tags_of('x', K.CONCERN_RULES))} AS concerns FROM (SELECT p_partkey, lower({D.match_text('noisy')}) AS x FROM li)", **L))
def b12_tag_listings(spark, sf):
    df = B.listings(spark, sf).withColumn("x", F.lower(T.match_text(F.col("noisy"))))
    return df.select("p_partkey", F.array_join(T.tags_of(F.col("x"), K.ACTIVE_RULES), "|").alias("actives"), F.array_join(T.tags_of(F.col("x"), K.CONCERN_RULES), "|").alias("concerns"))


_WORD_RULES = [("article", [r"\bthe\b", r"\bun[ea]?\b"]), ("link", [r"\band\b", r"\bund\b", r"\bet\b"]), ("mail", [r"[a-z0-9.]+@[a-z0-9.]+"]), ("accent", [r"\bé[a-z]*\b"])]


@query("b12_tag_documents", f"SELECT doc_id, {joined(D.tags_of('lower(text)', _WORD_RULES))} AS tags FROM documents")
def b12_tag_documents(spark, sf):
    return S.tag_text(B.texts(spark, sf, "documents"), "text", _WORD_RULES).select("doc_id", F.array_join("tags", "|").alias("tags"))


IDENT = (
    f"SELECT *, {D.clean_title('brand')} AS i_brand, {D.clean_title('coalesce(nullif(canonical_name, chr(0)), name)')} AS i_canonical, {D.clean_title('name')} AS i_name, "
    + ", ".join(f"{D.clean_title(c)} AS i_{c}" for c in ("variant", "size", "category", "sku")) + " FROM enr"
).replace("chr(0)", "''")
_W = lambda *xs: D.words(*[f"i_{x}" for x in xs])
_VARIANTS = "list_filter([" + ", ".join(
    [_W("brand", "canonical"), _W("brand", "name"), _W("brand", "canonical", "variant"), _W("brand", "name", "variant"), _W("brand", "canonical", "size"),
     _W("brand", "variant", "category"), _W("brand", "canonical", "category"), _W("brand", "sku")]) + "], lambda x: x <> '')"
_od = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_BASE = "flatten(list_transform(v, lambda x: [" + ", ".join(f"x || ' {s}'" for s in K.QUERY_SUFFIXES) + "]))"
_SITE, _LABEL = "example.com", "pharmacy"
_SCOPED = f"list_concat(base, list_concat(flatten(list_transform(v, lambda x: ['site:{_SITE} ' || x || ' ingredients', 'site:{_SITE} ' || x || ' INCI'])), list_transform(v, lambda x: '{_LABEL} ' || x)))"
_PH = {
    **ENRICHED, "ident": IDENT, "p1": f"SELECT p_partkey, {_VARIANTS} AS v FROM ident", "p2": f"SELECT *, {_BASE} AS b0 FROM p1",
    "p3": f"SELECT p_partkey, v, ({_od('b0')})[1:18] AS base FROM p2", "p4": f"SELECT *, {_SCOPED} AS s0 FROM p3", "p5": f"SELECT p_partkey, ({_od('s0')})[1:24] AS a FROM p4",
}


@query("b13_expand_phrases", ctes(unnest_pos("p_partkey", "base", "p3", "phrase", "ord"), **_PH))
def b13_expand_phrases(spark, sf):
    return S.expand_phrases(enriched(spark, sf), "p_partkey")


@query("b13_scoped_phrases", ctes(unnest_pos("p_partkey", "b", "(SELECT p_partkey, a AS b FROM p5)", "phrase", "ord"), **_PH))
def b13_scoped_phrases(spark, sf):
    return S.expand_phrases(enriched(spark, sf), "p_partkey", _SITE, _LABEL)


FP = "sha256(" + " || '|' || ".join(D.alias_key(c) for c in ("brand", "canonical_name", "variant", "category", "size")) + ")"


@query("b14_fingerprint", ctes(f"SELECT p_partkey, {FP} AS fingerprint FROM enr", **ENRICHED))
def b14_fingerprint(spark, sf):
    return S.fingerprint(enriched(spark, sf)).select("p_partkey", "fingerprint")


ALIAS_FORMS = "list_filter([" + ", ".join(
    D.alias_key(x) for x in ["i_name", "i_canonical", _W("brand", "name"), _W("brand", "canonical"), _W("brand", "canonical", "variant"), _W("brand", "canonical", "size"),
                             _W("brand", "variant", "category"), _W("brand", "name", "variant")]) + "], lambda x: x <> '')"


@query("b15_alias_keys", ctes(unnest_pos("p_partkey", _od("k"), f"(SELECT p_partkey, {ALIAS_FORMS} AS k FROM ident)", "alias_key", "ord"), **ENRICHED, ident=IDENT))
def b15_alias_keys(spark, sf):
    return S.alias_keys(enriched(spark, sf), "p_partkey")


_PURPOSE = "CASE p_partkey % 4 WHEN 0 THEN p_type || ' – ' || p_name WHEN 1 THEN p_type || ' / ' || p_name || ' • ' || p_type WHEN 2 THEN ' ' || p_name || ' - x | y ' ELSE p_name || '-' || p_type END"


def split_purpose_sql(x):
    y = f"regexp_replace({D.strip(D.text(x))}, '[\\x{{2013}}\\x{{2014}}\\x{{FFFD}}\\x{{2022}}]', '|', 'g')"
    y = D.sub_all(y, r"\s*/\s*", "|")
    y = D.sub_all(y, r"\s+\|\s+", "|")
    y = D.sub_all(y, r"\s+-\s+", "|")
    return f"list_filter(list_transform(string_split({y}, '|'), lambda p: {D.strip('p')}), lambda p: p <> '')"


@query("b16_split_purpose", f"SELECT p_partkey, array_to_string({_od('a')}, '|') AS functions FROM (SELECT p_partkey, {split_purpose_sql(_PURPOSE)} AS a FROM part)")
def b16_split_purpose(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", F.array_join(S.split_purpose_col(F.expr(_PURPOSE)), "|").alias("functions"))


_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN ' high' WHEN '2-HIGH' THEN 'Moderate' WHEN '3-MEDIUM' THEN 'MIXED' WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'reference' END"
EVIDENCE_SQL = lambda x: f"CASE WHEN upper(trim({x})) IN ('HIGH', 'MODERATE') THEN upper(trim({x})) WHEN upper(trim({x})) IN ('LOW', 'MIXED', 'REFERENCE', 'LIMITED') THEN 'LIMITED' END"


@query("b17_evidence_level", f"SELECT o_orderkey, {EVIDENCE_SQL(_LEVEL)} AS evidence_level FROM orders")
def b17_evidence_level(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", S.norm_evidence_col(F.expr(_LEVEL)).alias("evidence_level"))


# Profiles with faults injected by key, so that every rule fires.
_FAULTS = {
    "skin_type": "CASE WHEN c_custkey % 11 = 0 THEN 'WET' ELSE skin_type END",
    "goals": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE goals END",
    "other_allergy": "CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_custkey % 17 = 0 THEN repeat('x', 130) ELSE other_allergy END",
}


def _issue_sql():
    marks = []
    for col, allowed in S._REQUIRED.items():
        marks.append(f"CASE WHEN {col} IS NULL OR {col} NOT IN {D.inlist(allowed)} THEN '{col}: invalid value' END")
    for col, allowed in S._LISTS.items():
        marks.append(f"CASE WHEN len(coalesce({col}, [])) < 1 THEN '{col}: at least one value' END")
        marks.append(f"CASE WHEN len(list_filter(coalesce({col}, []), lambda v: v NOT IN {D.inlist(allowed)})) > 0 THEN '{col}: invalid value' END")
    for col in S._DETAIL.values():
        marks.append(f"CASE WHEN length({D.strip(col)}) > {K.MAX_FREE_TEXT} THEN '{col}: too long' END")
    for col, detail in S._DETAIL.items():
        marks.append(f"CASE WHEN list_contains({col}, 'NONE') AND len({col}) > 1 THEN '{col}: NONE excludes others' END")
        marks.append(f"CASE WHEN list_contains({col}, 'OTHER') AND {D.strip(D.text(detail))} = '' THEN '{detail}: detail needed' END")
    return "list_filter([" + ", ".join(marks) + "], lambda t: t IS NOT NULL)"


def _mixed_profiles(d):
    lists = ("array_append(allergies, 'NONE')" if d is B.SPARK else "list_append(allergies, 'NONE')")
    return {**_FAULTS, "allergies": f"CASE WHEN c_custkey % 19 = 0 THEN {lists} ELSE allergies END"}


@query(
    "b18_profile_issues",
    ctes(
        "SELECT profile_id, unnest(issues) AS issue FROM (SELECT profile_id, " + _issue_sql() + " AS issues FROM bad)",
        prof=B.PROFILE_SQL.replace("SELECT ", "SELECT c_custkey, ", 1),
        bad="SELECT * REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in _mixed_profiles(B.DUCK).items()) + ") FROM prof",
    ),
)
def b18_profile_issues(spark, sf):
    df = B.table(spark, sf, "customer").selectExpr("c_custkey", *B.profile_columns(B.SPARK))
    df = df.withColumns({k: F.expr(v) for k, v in _mixed_profiles(B.SPARK).items()})
    return S.validate_profiles(df).select("profile_id", F.explode("issues").alias("issue"))


_P = K.PROFILE_EXTENSION_PREFIX
_STORED = (
    "CASE event_id % 4 WHEN 0 THEN '" + _P + "{\"allergyText\":\"' || event_type || '\",\"scalpType\":\"DRY\",\"haircareGoals\":[\"SHINE\",\"u' || CAST(user_id AS STRING) || '\"],\"otherAvoidIngredient\":\"gum\"}' "
    "WHEN 1 THEN '" + _P + "{bad ' || event_type WHEN 2 THEN event_type || ' only' ELSE NULL END"
)


@query(
    "b19_decode_profiles",
    "SELECT event_id, CASE WHEN ok THEN json_extract_string(body, '$.allergyText') ELSE s END AS other_allergy, CASE WHEN ok THEN json_extract_string(body, '$.scalpType') ELSE '' END AS scalp_type, "
    "CASE WHEN ok THEN array_to_string(json_extract_string(body, '$.haircareGoals[*]'), '|') ELSE '' END AS hair_goals, CASE WHEN ok THEN json_extract_string(body, '$.otherAvoidIngredient') ELSE '' END AS other_avoid "
    f"FROM (SELECT event_id, s, CASE WHEN starts_with(s, '{_P}') AND json_valid(substr(s, {len(_P) + 1})) THEN substr(s, {len(_P) + 1}) END AS body, "
    f"coalesce(starts_with(s, '{_P}') AND json_valid(substr(s, {len(_P) + 1})), false) AS ok FROM (SELECT event_id, {_STORED} AS s FROM events))",
)
def b19_decode_profiles(spark, sf):
    df = B.table(spark, sf, "events").select("event_id", F.expr(_STORED).alias("stored_text"))
    out = S.decode_profiles(df)
    return out.select("event_id", "other_allergy", "scalp_type", F.array_join("hair_goals", "|").alias("hair_goals"), "other_avoid")


@query(
    "b19_encode_round_trip",
    ctes(
        "SELECT profile_id, CASE WHEN list_contains(allergies, 'OTHER') THEN other_allergy END AS other_allergy, scalp_type, array_to_string(hair_goals, '|') AS hair_goals, "
        "array_to_string(avoid_ingredients, '|') AS avoid_ingredients, coalesce(CASE WHEN list_contains(avoid_ingredients, 'OTHER') THEN other_avoid END, '') AS other_avoid FROM prof",
        prof=B.PROFILE_SQL,
    ),
)
def b19_encode_round_trip(spark, sf):
    stored = S.encode_profiles(B.profiles(spark, sf)).select("profile_id", "stored_text")
    out = S.decode_profiles(stored)
    return out.select(
        "profile_id", "other_allergy", "scalp_type", F.array_join("hair_goals", "|").alias("hair_goals"), F.array_join("avoid_ingredients", "|").alias("avoid_ingredients"), "other_avoid"
    )


_say = lambda x: f"CASE WHEN {x} = 'ANTI_AGING' THEN 'anti-aging' ELSE replace(lower({x}), '_', ' ') END"
_sayl = lambda a: f"list_transform({a}, lambda c: {_say('c')})"
_kept = lambda a: f"list_filter({a}, lambda c: c NOT IN ('NONE', 'OTHER'))"
_sent = lambda a, b, e: f"CASE WHEN len({a}) > 0 THEN {D.q(b)} || {D.or_list(a, 'your profile')} || {D.q(e)} END"


@query(
    "b20_profile_summary",
    ctes(
        f"SELECT profile_id, concat_ws(' ', 'You have ' || {_say('skin_type')} || ' skin, ' || {_say('skin_sensitivity')} || ' sensitivity, ' || {_say('hair_type')} || ' hair, and a ' || lower(scalp_type) || ' scalp.', "
        + ", ".join([
            _sent("c3", "Your primary concerns are ", "."), _sent("al[1:2]", "Analyses will watch closely for ", " triggers."),
            f"coalesce({_sent('tags', 'Your analyses will prioritize ', ' ingredients.')}, {_sent('g3', 'Your analyses will prioritize formulas aligned with ', ' goals.')})",
            _sent("h2", "For haircare, analyses will prioritize ", " goals."), _sent("av[1:3]", "They will also avoid ", " when possible."),
        ]) + ") AS summary FROM q",
        prof=B.PROFILE_SQL,
        p0=f"SELECT *, {_sayl('concerns')}[1:3] AS c3, {_sayl('goals')}[1:3] AS g3, {_sayl('hair_goals')}[1:2] AS h2, "
        f"list_concat({_sayl(_kept('allergies'))}, list_filter([lower(other_allergy)], lambda x: x IS NOT NULL AND x <> '')) AS al, "
        f"list_concat({_sayl(_kept('avoid_ingredients'))}, list_filter([lower(other_avoid)], lambda x: x IS NOT NULL AND x <> '')) AS av FROM prof",
        p1="SELECT *, skin_type = 'OILY' OR list_contains(concerns, 'ACNE') AS f1, skin_sensitivity <> 'NOT_SENSITIVE' OR len(al) > 0 AS f2, "
        "skin_type = 'DRY' OR list_has_any(goals, ['BARRIER_REPAIR', 'HYDRATION']) AS f3, list_has_any(concerns, ['PIGMENTATION', 'DARK_SPOTS']) OR list_has_any(goals, ['BRIGHTENING', 'EVEN_SKIN_TONE']) AS f4 FROM p0",
        q="SELECT *, list_filter([CASE WHEN f1 THEN 'non-comedogenic' END, CASE WHEN f1 THEN 'acne-safe' END, CASE WHEN f2 THEN 'fragrance-free' END, CASE WHEN f2 THEN 'low-irritation' END, "
        "CASE WHEN f3 THEN 'skin-barrier-friendly' END, CASE WHEN f4 THEN 'tone-evening' END], lambda t: t IS NOT NULL)[1:3] AS tags FROM p1",
    ),
)
def b20_profile_summary(spark, sf):
    return S.profile_summary(B.profiles(spark, sf))


_REF_FIELDS = ["title", "citation", "reference", "url", "source", "evidence_type"]
_REF_ROWS = [
    ("' ' || p_name || ' study '", "''", "''", "'https://x.example/' || CAST(p_partkey AS STRING)", "'lab'", "'review'"),
    ("''", "''", "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END", "''", "'none'", "''"),
    ("''", "p_name", "''", "''", "''", "''"),
]


@query(
    "b21_references",
    "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY ord) - 1 AS INT) AS ord, nullif(trim(title), '') AS title, coalesce(nullif(trim(citation), ''), nullif(trim(title), ''), nullif(trim(reference), ''), nullif(trim(url), '')) AS citation, nullif(trim(url), '') AS url, "
    "nullif(trim(source), '') AS source, nullif(trim(evidence_type), '') AS evidence_type FROM ("
    + " UNION ALL ".join(f"SELECT p_partkey, {i} AS ord, " + ", ".join(f"{v} AS {f}" for f, v in zip(_REF_FIELDS, row)) + " FROM part" for i, row in enumerate(_REF_ROWS))
    + ") WHERE coalesce(nullif(trim(citation), ''), nullif(trim(title), ''), nullif(trim(reference), ''), nullif(trim(url), '')) IS NOT NULL",
)
def b21_references(spark, sf):
    refs = F.array(*[F.struct(F.lit(i).alias("n"), *[F.expr(v).alias(f) for f, v in zip(_REF_FIELDS, row)]) for i, row in enumerate(_REF_ROWS)])
    df = B.table(spark, sf, "part").select("p_partkey", refs.alias("refs"))
    kept = S.normalize_refs_col(F.col("refs"))
    # Row numbers follow the surviving entries.
    return df.select("p_partkey", F.posexplode(kept).alias("ord", "r")).select("p_partkey", "ord", "r.*")
