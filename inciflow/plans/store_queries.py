"""Knowledge base, consensus, reports, batch scoring and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import consensus as C
from ..operators import knowledge as KN
from ..operators import resolve as R
from ..operators import score as S
from ..operators import standardise as ST
from ..operators import store as KB
from ..operators import verify as V
from ..sources import bindings as B
from ..sources import seeds
from ..sources.tables import scan
from ..streaming.jobs import work_dir
from . import duck as D
from . import sql_resolve as Q
from . import text_queries as TQ
from .formula_queries import ANALYZE, ANALYZE_SQL, ORDER_MIN, RES, SCORED, order_analysis, resolved_lines
from .registry import ctes, query

od = Q.ordered_distinct
joined = TQ.joined
day = lambda c: F.date_format(c, "yyyy-MM-dd")
dday = lambda c: f"strftime({c}, '%Y-%m-%d')"

# ------------------------------------------------------------------ A1 / A2
_CUR = {
    "functions": ("CASE WHEN ingredient_id % 2 = 0 THEN {a} END", ("Solvent", "Counter-Irritant")),
    "evidence_level": ("CASE WHEN ingredient_id % 3 = 0 THEN 'REFERENCE' END", None),
}


def _curated(d):
    out = {}
    for k, (txt, arr) in _CUR.items():
        out[k] = txt.replace("{a}", d.arr(*arr)) if arr else txt
    return out


@query(
    "a1_seed_overlay",
    ctes(
        f"SELECT s.ingredient_id, s.name, {joined('coalesce(c.functions, s.functions)')} AS functions, coalesce(c.evidence_level, s.evidence_level) AS evidence_level FROM raw s LEFT JOIN cur c ON c.key = s.name",
        raw=B.DIM_RAW_SQL,
        cur="SELECT name AS key, " + ", ".join(f"{v} AS {k}" for k, v in _curated(B.DUCK).items()) + " FROM raw WHERE ingredient_id % 5 <> 1",
    ),
)
def a1_seed_overlay(spark, sf):
    raw = B.raw_dim(spark, sf)
    cur = raw.where("ingredient_id % 5 <> 1").select(F.upper("name").alias("key"), *[F.expr(v).alias(k) for k, v in _curated(B.SPARK).items()])
    out = KN.overlay_curated(raw, cur)
    return out.select("ingredient_id", "name", F.array_join("functions", "|").alias("functions"), "evidence_level")


def _values(rows, names):
    """Rows of text and lists of text as a VALUES relation."""
    cell = lambda v: "NULL" if v is None else ("[" + ", ".join(map(D.q, v)) + "]::VARCHAR[]" if isinstance(v, list) else D.q(v))
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({', '.join(names)})"


_SEED_COLUMNS = ("name", "aliases", "purpose", "functions", "evidence_level")


@query(
    "a1_seed_load",
    ctes(
        "SELECT coalesce(l.name, s.name) AS name, l.name IS NOT NULL AS is_seed, s.name IS NOT NULL AS is_stored, coalesce(l.purpose, s.purpose) AS purpose, "
        + ", ".join(f"coalesce({joined(f'coalesce(l.{c}, s.{c})')}, '') AS {c}" for c in ("aliases", "functions"))
        + ", coalesce(l.evidence_level, s.evidence_level) AS evidence_level FROM loaded l FULL JOIN raw s ON s.name = l.name",
        raw=B.DIM_RAW_SQL,
        seed=_values([(r[0], r[1], r[2]) for r in seeds.INGREDIENTS], ("name", "aliases", "purpose")),
        cur=_values([(r[0], r[1], r[2], r[5]) for r in seeds.CURATED], ("key", "aliases", "functions", "evidence_level")),
        loaded="SELECT s.name, coalesce(c.aliases, s.aliases) AS aliases, s.purpose, coalesce(c.functions, []::VARCHAR[]) AS functions, c.evidence_level "
        f"FROM seed s LEFT JOIN cur c ON {D.spaced_key('c.key')} = {D.spaced_key('s.name')}",
    ),
)
def a1_seed_load(spark, sf):
    """The stored dimension with the seed rows, curated fields on top, loaded into it; a seed row wins over a stored one."""
    seed, _, curated = seeds.load_seed(spark)
    loaded = KN.overlay_curated(seed, curated).select(*_SEED_COLUMNS, F.lit(True).alias("is_seed"))
    stored = B.raw_dim(spark, sf).select("name", *[F.col(c).alias(f"s_{c}") for c in _SEED_COLUMNS[1:]], F.lit(True).alias("is_stored"))
    both = loaded.join(stored, "name", "full")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_seed", "is_stored")]
    value = {c: F.coalesce(c, f"s_{c}") for c in _SEED_COLUMNS[1:]}
    lists = [F.coalesce(F.array_join(value[c], "|"), F.lit("")).alias(c) for c in ("aliases", "functions")]
    return both.select("name", *flags, value["purpose"].alias("purpose"), *lists, value["evidence_level"].alias("evidence_level"))


@query("a2_filtered_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def a2_filtered_scan(spark, sf):
    return scan(spark, f"{sf}/orders.parquet", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", ["o_orderkey", "o_custkey", "o_totalprice"])


# ------------------------------------------------------------------ A4 - A9
_NEWKEY = "CASE WHEN l_suppkey % 5 = 0 THEN l_partkey + 1000000 ELSE l_partkey END"
_VER = "CAST(l_orderkey * 100 + l_linenumber AS BIGINT) * 100000 + l_suppkey"


@query(
    "a4_upsert_products",
    f"SELECT fingerprint, coalesce(c.product_id, u0.product_id) AS product_id, coalesce(u.name, c.name) AS name, coalesce(u.brand, c.brand) AS brand, coalesce(u.updated_at, 0) AS updated_at FROM "
    "(SELECT p_partkey AS fingerprint, p_partkey AS product_id, p_name AS name, p_brand AS brand FROM part) c FULL OUTER JOIN "
    f"(SELECT {_NEWKEY} AS fingerprint, arg_max('order ' || l_orderkey, {_VER}) AS name, arg_max('s' || l_suppkey, {_VER}) AS brand, max({_VER}) AS updated_at FROM lineitem GROUP BY 1) u USING (fingerprint) "
    f"LEFT JOIN (SELECT {_NEWKEY} AS fingerprint, arg_min(l_orderkey, {_VER}) AS product_id FROM lineitem GROUP BY 1) u0 USING (fingerprint)",
)
def a4_upsert_products(spark, sf):
    cur = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("fingerprint"), F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.lit(0).cast("bigint").alias("updated_at")
    )
    li = B.table(spark, sf, "lineitem")
    upd = li.select(
        F.expr(_NEWKEY).alias("fingerprint"), F.col("l_orderkey").alias("product_id"), F.concat(F.lit("order "), "l_orderkey").alias("name"), F.concat(F.lit("s"), "l_suppkey").alias("brand"), F.expr(_VER).alias("updated_at")
    )
    return KB.upsert_products(cur, upd).select("fingerprint", "product_id", "name", "brand", "updated_at")


_M = "CASE o_custkey % 7 WHEN 0 THEN 'official-site-search' WHEN 1 THEN 'trusted-database' WHEN 2 THEN 'distributor-x' WHEN 3 THEN 'search-engine-result' WHEN 4 THEN 'ai-structured-output' ELSE 'dom-heading' END"
_WT = "CASE WHEN o_custkey % 2 = 0 THEN 'official-brand-website' ELSE 'generic-website' END"
_GK = "CASE WHEN o_custkey % 11 = 0 THEN 'COMMUNITY' ELSE '' END"


def resolutions(spark, sf):
    """Verified and unverified resolutions: one per order."""
    ver = V.verify_lists(V.list_counters(resolved_lines(spark, sf)), ORDER_MIN)
    orders = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("list_id"), F.expr(_M).alias("method"), F.expr(_WT).alias("website_type"), F.expr(_GK).alias("source_kind"), day("o_orderdate").alias("verified_at"), "o_custkey"
    )
    site = F.concat(F.lit("Shop "), F.col("o_custkey") % 20)
    df = ver.join(orders, "list_id")
    conf = V.verification_confidence(F.col("method"), site, F.lit(""))
    return df.select(
        F.concat(F.lit("fp"), F.col("o_custkey")).alias("fingerprint"), F.concat(F.lit("https://s/"), "list_id").alias("source_url"), site.alias("website"), "method", "website_type", "source_kind",
        F.concat(F.lit("list "), "list_id").alias("ingredients_text"), "ingredient_count", "matched_count", "unknown_count", "alias_count", conf.alias("confidence"), V.reason_text(ORDER_MIN, site).alias("reason"), "verified", "verified_at",
    )


_KIND = (
    "CASE WHEN source_kind <> '' THEN source_kind WHEN starts_with(method, 'official-site') THEN 'OFFICIAL_BRAND' WHEN starts_with(method, 'trusted-database') THEN 'TRUSTED_DATABASE' WHEN starts_with(method, 'distributor') THEN 'PHARMACY' "
    "WHEN method = 'search-engine-result' THEN 'SEARCH_ENGINE' WHEN method = 'ai-structured-output' THEN 'AI' WHEN website_type = 'official-brand-website' THEN 'OFFICIAL_BRAND' ELSE 'RETAILER' END"
)
RESO = dict(
    RES, cnt=Q.counters("res"), ver=Q.verified(ORDER_MIN),
    reso=f"SELECT 'fp' || o_custkey AS fingerprint, 'https://s/' || list_id AS source_url, 'Shop ' || (o_custkey % 20) AS website, {_M} AS method, {_WT} AS website_type, {_GK} AS source_kind, 'list ' || list_id AS ingredients_text, "
    f"ingredient_count, matched_count, unknown_count, alias_count, {dday('o_orderdate')} AS verified_at, ver.* EXCLUDE (ingredient_count, matched_count, unknown_count, alias_count) FROM ver JOIN orders ON o_orderkey = list_id",
    facts=f"SELECT *, {Q.verification_confidence('method', 'website', D.q(''))} AS confidence, sha256(fingerprint || '|' || source_url) AS source_id, sha256(fingerprint || '|' || source_url || '|' || verified_at) AS verification_id, "
    "sha256(fingerprint || '|' || ingredients_text || '|' || verified_at) AS formula_id FROM reso WHERE verified",
)


@query("a5_formula_facts", ctes("SELECT formula_id, fingerprint, ingredients_text, ingredient_count, confidence, source_id, verification_id, verified_at FROM facts", **RESO))
def a5_formula_facts(spark, sf):
    return KB.verified_facts(resolutions(spark, sf))[0]


@query("a5_source_facts", ctes(f"SELECT source_id, {_KIND} AS kind, website AS label, {D.alias_key('website')} AS domain, source_url AS url, fingerprint FROM facts", **RESO))
def a5_source_facts(spark, sf):
    return KB.verified_facts(resolutions(spark, sf))[1]


@query(
    "a5_verification_facts",
    ctes(f"SELECT verification_id, 'VERIFIED' AS status, confidence, matched_count, unknown_count, alias_count, ingredient_count, 'PASSED' AS rule, {Q.reason(ORDER_MIN, 'website')} AS reason, source_id FROM facts", **RESO),
)
def a5_verification_facts(spark, sf):
    return KB.verified_facts(resolutions(spark, sf))[2]


def stored_facts(spark, sf):
    """Three batches of resolutions, one of them written twice, and a writer that died before its manifest row."""
    path = work_dir(spark, "facts")
    resolutions(spark, sf).write.parquet(f"{path}/in")
    res = spark.read.parquet(f"{path}/in")
    part = F.pmod(F.xxhash64("fingerprint"), F.lit(3))
    for batch in (0, 1, 1, 2):
        # every batch also brings facts of the one before: these are stored already
        KB.append_verified(res.where((part == batch) | (part == batch - 1)), path, batch)
    lost = KB.verified_facts(res.withColumn("verified_at", F.lit("never")))[0]
    lost.write.parquet(f"{path}/formula/batch=3")
    return path


@query(
    "a5_append_verified",
    ctes(
        "SELECT 'formula' AS kind, formula_id AS id, fingerprint FROM facts UNION ALL SELECT DISTINCT 'source', source_id, fingerprint FROM facts "
        "UNION ALL SELECT DISTINCT 'verification', verification_id, NULL FROM facts",
        **RESO,
    ),
)
def a5_append_verified(spark, sf):
    path = stored_facts(spark, sf)
    kinds = {"formula": F.col("fingerprint"), "source": F.col("fingerprint"), "verification": F.lit(None).cast("string")}
    parts = [KB.committed(spark, path, k).select(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id"), f.alias("fingerprint")) for k, f in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NM = "CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' || p_name ELSE p_name END"


@query(
    "a6_learn_ingredients",
    ctes(f"SELECT DISTINCT {_NM} AS name, 'Unknown' AS purpose, 'LOW' AS risk_level, 'LIMITED' AS evidence_level, 0 AS comedogenic, 0 AS irritation FROM part WHERE {D.compact_key(_NM)} NOT IN (SELECT {D.compact_key('name')} FROM dim)", dim=B.DIM_SQL),
)
def a6_learn_ingredients(spark, sf):
    return KB.learn_ingredients(B.dimension(spark, sf), B.table(spark, sf, "part").select(F.expr(_NM).alias("name")))


@query(
    "a6_upsert_aliases",
    f"SELECT normalized_alias, arg_min(ingredient_id, o) AS ingredient_id, arg_max(alias, o) AS alias, arg_max(ord, o) AS ord FROM (SELECT *, side * 1000000000 + ord AS o FROM (SELECT {D.compact_key('p_name')} AS normalized_alias, 0 AS side, p_partkey AS ord, p_partkey AS ingredient_id, p_name AS alias FROM part WHERE p_partkey % 3 = 0 "
    f"UNION ALL SELECT {D.compact_key('upper(p_name)')}, 1, p_partkey, p_partkey + 5000000, upper(p_name) FROM part WHERE p_partkey % 3 <> 0)) GROUP BY 1",
)
def a6_upsert_aliases(spark, sf):
    p = B.table(spark, sf, "part")
    cur = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ingredient_id"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("ord"))
    new = p.where("p_partkey % 3 <> 0").select((F.col("p_partkey") + 5000000).alias("ingredient_id"), F.upper("p_name").alias("alias"), F.col("p_partkey").alias("ord"))
    return KB.upsert_aliases(cur, new).select("normalized_alias", "ingredient_id", "alias", "ord")


_HK = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


@query(
    "a7_upsert_stores",
    f"SELECT domain, arg_max(name, o) AS name, max(CASE WHEN o = m THEN ord END) AS ord FROM (SELECT *, max(o) OVER (PARTITION BY domain) AS m FROM (SELECT {_HK} AS domain, 'old' AS name, page_id AS ord, page_id AS o FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT {_HK}, 'label ' || page_id, page_id, page_id + 1000000000 FROM pages WHERE page_id % 2 = 1 OR page_id % 3 = 0)) GROUP BY 1",
)
def a7_upsert_stores(spark, sf):
    from ..operators.links import host_key

    p = B.table(spark, sf, "pages").withColumn("domain", host_key(F.col("url")))
    cur = p.where("page_id % 2 = 0").select("domain", F.lit("old").alias("name"), F.col("page_id").alias("ord"))
    new = p.where("page_id % 2 = 1 OR page_id % 3 = 0").select("domain", F.concat(F.lit("label "), "page_id").alias("name"), F.col("page_id").alias("ord"))
    return KB.upsert_stores(cur, new).select("domain", "name", "ord")


@query(
    "a9_upsert_profiles",
    "SELECT user_id, coalesce(c.id, u0.id) AS id, coalesce(c.created_at, u0.created_at) AS created_at, coalesce(u.skin_type, c.skin_type) AS skin_type, coalesce(u.updated_at, 'never') AS updated_at FROM (SELECT c_custkey AS user_id, 'c' || c_custkey AS id, '1990-01-01' AS created_at, c_mktsegment AS skin_type FROM customer WHERE c_custkey % 2 = 0) c "
    f"FULL OUTER JOIN (SELECT o_custkey AS user_id, arg_max(o_orderpriority, v) AS skin_type, arg_max(d, v) AS updated_at FROM (SELECT *, {dday('o_orderdate')} AS d, {dday('o_orderdate')} || o_orderpriority || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS v FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM orders UNION ALL SELECT c_custkey, 0, TIMESTAMP '1991-01-01', c_mktsegment FROM customer WHERE c_custkey % 2 = 1)) GROUP BY 1) u USING (user_id) "
    f"LEFT JOIN (SELECT o_custkey AS user_id, min(id) AS id, min(d) AS created_at FROM (SELECT *, 'o' || o_custkey AS id, {dday('o_orderdate')} AS d FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM orders UNION ALL SELECT c_custkey, 0, TIMESTAMP '1991-01-01', c_mktsegment FROM customer WHERE c_custkey % 2 = 1)) GROUP BY 1) u0 USING (user_id)",
)
def a9_upsert_profiles(spark, sf):
    every = B.table(spark, sf, "customer")
    c = every.where("c_custkey % 2 = 0")
    cur = c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("1990-01-01").alias("created_at"), F.col("c_mktsegment").alias("skin_type"), F.lit("never").alias("updated_at"))
    new = every.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("o_custkey"), F.lit(0).cast("bigint").alias("o_orderkey"), F.expr("timestamp'1991-01-01'").alias("o_orderdate"), F.col("c_mktsegment").alias("o_orderpriority"))
    o = B.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    o = o.unionByName(new.withColumn("o_orderdate", F.col("o_orderdate").cast(o.schema["o_orderdate"].dataType)))
    upd = o.select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("o"), "o_custkey").alias("id"), day("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("skin_type"), day("o_orderdate").alias("updated_at"))
    return KB.upsert_profiles(cur, upd).select("user_id", "id", "created_at", "skin_type", "updated_at")


# ------------------------------------------------------------------ D7 / G
# Stored products carry their identity columns already.
_IDCOLS = {"brand": "p_brand", "name": "p_name || ' ' || lower(p_type)", "canonical_name": "p_name", "variant": "CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE '' END", "size": "CAST(p_size % 3 AS STRING) || ' ml'", "category": "''", "sku": "''"}
_KBPROD = dict(
    enr="SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k, v in _IDCOLS.items()) + " FROM part", ident=TQ.IDENT,
    fp=f"SELECT p_partkey, brand, canonical_name, variant, category, size, name, {TQ.FP} AS fingerprint FROM enr",
    ak=f"SELECT p_partkey, {od('k')} AS keys FROM (SELECT p_partkey, {TQ.ALIAS_FORMS} AS k FROM ident)",
    reqs="SELECT f.p_partkey AS request_id, CASE WHEN f.p_partkey % 4 = 1 THEN 'x' || f.fingerprint ELSE f.fingerprint END AS fingerprint, CASE WHEN f.p_partkey % 8 = 1 THEN '' ELSE brand END AS brand, canonical_name, CASE WHEN f.p_partkey % 16 = 1 THEN list_transform(keys, lambda k: 'no ' || k) ELSE keys END AS keys FROM fp f JOIN ak a USING (p_partkey)",
    stored="SELECT fingerprint, arg_min(brand, p_partkey) AS brand, arg_min(canonical_name, p_partkey) AS canonical_name, max(p_partkey) AS updated_at FROM fp GROUP BY 1",
    forms="SELECT fp.fingerprint, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS formula_id, l_discount AS confidence, strftime(l_shipdate, '%Y-%m-%d') AS verified_at FROM lineitem JOIN fp ON p_partkey = l_partkey",
    bestf="SELECT * FROM forms QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY confidence DESC, verified_at DESC, formula_id DESC) = 1",
    al=f"SELECT alias_key, arg_min(fingerprint, o) AS fingerprint FROM (SELECT unnest(keys) AS alias_key, fp.fingerprint, lpad(CAST(p_partkey AS VARCHAR), 12, '0') || fp.fingerprint AS o FROM fp JOIN ak USING (p_partkey)) GROUP BY 1",
)


def kb_tables(spark, sf):
    base = B.table(spark, sf, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in _IDCOLS.items()])
    keys = ST.alias_keys(base, "p_partkey")
    fp = ST.fingerprint(base).select("p_partkey", "brand", "canonical_name", "fingerprint")
    shown = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("x"), "fingerprint")).otherwise(F.col("fingerprint"))
    asked = keys.groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("ord", "alias_key"))).alias("k"))
    reqs = fp.join(asked.hint("merge"), "p_partkey").select(
        F.col("p_partkey").alias("request_id"), shown.alias("fingerprint"), F.when(F.col("p_partkey") % 8 == 1, "").otherwise(F.col("brand")).alias("brand"), "canonical_name",
        F.transform("k", lambda x: F.when(F.col("p_partkey") % 16 == 1, F.concat(F.lit("no "), x["alias_key"])).otherwise(x["alias_key"])).alias("keys"),
    )
    stored = fp.groupBy("fingerprint").agg(F.min_by("brand", "p_partkey").alias("brand"), F.min_by("canonical_name", "p_partkey").alias("canonical_name"), F.max("p_partkey").alias("updated_at"))
    li = B.table(spark, sf, "lineitem")
    forms = li.join(fp.select(F.col("p_partkey").alias("l_partkey"), "fingerprint").hint("merge"), "l_partkey").select(
        "fingerprint", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("formula_id"), F.col("l_discount").alias("confidence"), day("l_shipdate").alias("verified_at")
    )
    claims = keys.join(fp.select("p_partkey", "fingerprint").hint("merge"), "p_partkey").select("alias_key", "fingerprint", F.col("p_partkey").alias("registered_at"))
    return reqs, stored, forms, claims


_LOOKUP = (
    "SELECT request_id, CASE WHEN st THEN 'database' ELSE 'database-alias' END AS source, fpx AS fingerprint, formula_id, confidence FROM hit WHERE formula_id IS NOT NULL UNION ALL "
    "SELECT m.request_id, 'memory-alias', b.fingerprint, b.formula_id, b.confidence FROM (SELECT request_id, al.fingerprint FROM (SELECT request_id, i, keys[i] AS alias_key FROM (SELECT request_id, keys, unnest(generate_series(1, len(keys))) AS i FROM hit WHERE formula_id IS NULL)) u JOIN al USING (alias_key) "
    "QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY i) = 1) m JOIN stored s ON s.fingerprint = m.fingerprint JOIN bestf b ON b.fingerprint = m.fingerprint"
)
_KB = dict(
    _KBPROD,
    byname="SELECT brand, canonical_name, fingerprint AS named FROM stored WHERE brand <> '' AND canonical_name <> '' QUALIFY row_number() OVER (PARTITION BY brand, canonical_name ORDER BY updated_at DESC, fingerprint DESC) = 1",
    pick="SELECT r.request_id, r.keys, s.fingerprint IS NOT NULL AS st, coalesce(s.fingerprint, n.named) AS fpx FROM reqs r LEFT JOIN stored s ON s.fingerprint = r.fingerprint LEFT JOIN byname n ON n.brand = r.brand AND n.canonical_name = r.canonical_name",
    hit="SELECT p.*, b.formula_id, b.confidence FROM pick p LEFT JOIN bestf b ON b.fingerprint = p.fpx",
    lookup=_LOOKUP,
)


def kb_hits(spark, sf):
    reqs, stored, forms, claims = kb_tables(spark, sf)
    aliases = claims.groupBy("alias_key").agg(F.min(F.struct("registered_at", "fingerprint")).alias("c")).select("alias_key", "c.fingerprint")
    return KB.kb_lookup(reqs, stored, forms, aliases)


@query("d7_kb_lookup", ctes("SELECT * FROM lookup", **_KB))
def d7_kb_lookup(spark, sf):
    return kb_hits(spark, sf)


@query("g3_register_aliases", ctes("SELECT alias_key, fingerprint FROM al", **_KBPROD))
def g3_register_aliases(spark, sf):
    claims = kb_tables(spark, sf)[3]
    return KB.register_aliases(claims.where("registered_at % 2 = 0"), claims.where("registered_at % 2 = 1")).select("alias_key", "fingerprint")


@query(
    "g8_kb_result",
    ctes(
        "SELECT l.request_id, 'VERIFIED_INGREDIENTS_FOUND' AS status, 'https://in/' || l.request_id AS source_url, 'Knowledge Base' AS source_website, s.brand, s.canonical_name, 'knowledge-base' AS extraction_method, l.source AS ingredient_source, l.confidence, CAST(l.formula_id % 30 AS BIGINT) AS ingredient_count, "
        "CAST(l.formula_id % 30 AS BIGINT) AS matched_count, 'Generated fingerprint for ' || s.brand || ' | ' || s.canonical_name || '.' AS step_one, CASE WHEN l.source = 'database' THEN 'Verified formula found in the database knowledge base.' ELSE 'Verified formula found via a learned product alias match.' END AS step_two, 'knowledge-base:' || l.fingerprint AS attempted_source, "
        "CASE WHEN l.source = 'database' THEN 'Using the verified ingredient knowledge base for this product.' ELSE 'Using the verified ingredient knowledge base via a learned product alias match.' END AS message FROM lookup l JOIN stored s ON s.fingerprint = l.fingerprint",
        **_KB,
    ),
)
def g8_kb_result(spark, sf):
    _, stored, _, _ = kb_tables(spark, sf)
    rows = kb_hits(spark, sf).join(stored.hint("merge"), "fingerprint").withColumns(
        {
            "input_url": F.concat(F.lit("https://in/"), "request_id"), "source_url": F.lit(""), "website": F.lit(""), "method": F.lit(""), "ingredient_source": F.lit(""),
            "ingredient_count": F.col("formula_id") % 30, "matched_count": F.lit(None).cast("bigint"), "unknown_count": F.lit(None).cast("bigint"), "match_rate": F.lit(None).cast("double"),
        }
    )
    out = KB.kb_result(rows)
    return out.select(
        "request_id", "status", "source_url", "source_website", "brand", "canonical_name", "extraction_method", "ingredient_source", "confidence", "ingredient_count", "matched_count",
        F.col("trace")[0]["details"].alias("step_one"), F.col("trace")[1]["details"].alias("step_two"), "attempted_source", "message",
    )


@query("g1_search_products", ctes(f"SELECT p_partkey FROM (SELECT *, {TQ._CAT} AS category FROM li) WHERE contains(lower(p_brand || ' ' || title || ' ' || category), 'ring face')", li=B.LISTINGS_SQL))
def g1_search_products(spark, sf):
    df = B.listings(spark, sf).select("p_partkey", F.col("p_brand").alias("brand"), F.col("title").alias("name"), T.category_of(F.col("title")).alias("category"))
    return KB.search_products(df, " Ring FACE ").select("p_partkey")


_ASK = "CASE WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_name) || ' ' ELSE p_type || p_name END"


@query("g2_find_by_name", f"SELECT DISTINCT {_ASK} AS asked, f.product_id FROM part JOIN (SELECT lower(p_name) AS k, min(p_partkey) AS product_id FROM part GROUP BY 1) f ON f.k = trim(lower({_ASK}))")
def g2_find_by_name(spark, sf):
    p = B.table(spark, sf, "part")
    return KB.find_by_name(p.select(F.col("p_partkey").alias("product_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name")), p.select(F.expr(_ASK).alias("asked")))


@query(
    "g4_latest_product",
    "SELECT p_brand AS brand, p_name AS canonical_name, strftime(l_shipdate, '%Y-%m-%d') AS updated_at, p_partkey AS product_id, l_orderkey AS order_id FROM lineitem JOIN part ON p_partkey = l_partkey QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY strftime(l_shipdate, '%Y-%m-%d') DESC, p_partkey DESC, l_orderkey DESC) = 1",
)
def g4_latest_product(spark, sf):
    j = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    df = j.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("canonical_name"), day("l_shipdate").alias("updated_at"), F.col("p_partkey").alias("product_id"), F.col("l_orderkey").alias("order_id"))
    return KB.latest_product(df)


@query(
    "g5_best_formula",
    "SELECT l_partkey AS product_id, l_discount AS confidence, strftime(l_shipdate, '%Y-%m-%d') AS verified_at, l_orderkey AS formula_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, strftime(l_shipdate, '%Y-%m-%d') DESC, l_orderkey DESC) = 1",
)
def g5_best_formula(spark, sf):
    df = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_discount").alias("confidence"), day("l_shipdate").alias("verified_at"), F.col("l_orderkey").alias("formula_id"))
    return KB.best_formula(df)


@query("g7_source_kind", f"SELECT o_orderkey, {_KIND} AS kind FROM (SELECT o_orderkey, {_M} AS method, {_WT} AS website_type, {_GK} AS source_kind FROM orders)")
def g7_source_kind(spark, sf):
    df = B.table(spark, sf, "orders").select("o_orderkey", F.expr(_M).alias("method"), F.expr(_WT).alias("website_type"), F.expr(_GK).alias("source_kind"))
    return df.select("o_orderkey", KB.source_kind().alias("kind"))


# ------------------------------------------------------------------ D8 / G6
_STAGE = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END"
_CM = "CASE o_orderkey % 6 WHEN 0 THEN 'official-site' WHEN 1 THEN 'trusted-database-x' WHEN 2 THEN 'distributor' WHEN 3 THEN 'ai-structured-output' ELSE 'dom' END"
_CL = "CASE o_orderkey % 5 WHEN 0 THEN 'Full Ingredients' WHEN 1 THEN 'hero ingredients' WHEN 2 THEN 'Highlights' ELSE 'list' END"
_CR = "CASE o_orderkey % 7 WHEN 0 THEN 'a, etc.' WHEN 1 THEN 'a...' ELSE 'a, b' END"
_CONF = "CAST(o_orderkey % 97 AS DOUBLE) / 100"
_RATE = "CAST(o_orderkey % 11 AS DOUBLE) / 11"
CAND = dict(
    cand=f"SELECT o_custkey AS group_id, o_orderkey AS candidate_id, {_CONF} AS confidence, {_RATE} AS match_rate, {_CL} AS label, {_CR} AS raw_text, {_CM} AS method, o_orderstatus <> 'P' AS verified, CAST({_STAGE} AS INT) AS stage, o_custkey % 3 = 0 AS official FROM orders",
    items=f"SELECT DISTINCT o_custkey AS group_id, o_orderkey AS candidate_id, {D.compact_key('p_name')} AS key FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey",
)


def consensus_ctes(c, it):
    return dict(
        sizes=f"SELECT group_id, candidate_id, count(*) AS n FROM {it} GROUP BY 1, 2",
        prs=f"SELECT a.group_id, a.candidate_id AS ca, b.candidate_id AS cb, count(*) AS k FROM {it} a JOIN {it} b ON a.group_id = b.group_id AND a.key = b.key AND a.candidate_id <> b.candidate_id GROUP BY 1, 2, 3",
        ovl="SELECT p.group_id, ca AS candidate_id, CAST(sum(k * (1000000000 // greatest(sa.n, sb.n))) AS BIGINT) AS overlap FROM prs p JOIN sizes sa ON sa.group_id = p.group_id AND sa.candidate_id = ca JOIN sizes sb ON sb.group_id = p.group_id AND sb.candidate_id = cb GROUP BY 1, 2",
        tot=f"SELECT c.*, CAST(coalesce(overlap, 0) + CAST(floor(confidence * 1000000 + 0.5) AS BIGINT) * 1000 + CAST(floor(match_rate * 1000000 + 0.5) AS BIGINT) * 180 + least(coalesce(n, 0), 45) * 10000000 "
        f"+ CASE WHEN {D.has('lower(label)', K.CONSENSUS_FULL)} THEN 160000000 ELSE 0 END - CASE WHEN {D.has('lower(label)', K.CONSENSUS_PARTIAL)} THEN 350000000 ELSE 0 END - CASE WHEN {D.has('raw_text', K.TRUNCATED)} THEN 220000000 ELSE 0 END "
        "+ CASE WHEN starts_with(method, 'official-site') THEN 100000000 WHEN starts_with(method, 'trusted-database') THEN 70000000 WHEN starts_with(method, 'distributor') THEN 40000000 WHEN method = 'ai-structured-output' THEN -50000000 ELSE 0 END "
        f"- CASE WHEN verified THEN 0 ELSE 1000000000 END AS BIGINT) AS total FROM {c} c LEFT JOIN ovl o ON o.group_id = c.group_id AND o.candidate_id = c.candidate_id LEFT JOIN sizes s ON s.group_id = c.group_id AND s.candidate_id = c.candidate_id",
        best="SELECT group_id, candidate_id, candidate_count, total FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS candidate_count, row_number() OVER (PARTITION BY group_id ORDER BY total DESC, candidate_id) AS rn FROM tot) WHERE rn = 1 AND (candidate_count = 1 OR total > -1000000000)",
    )


def order_lists(spark, sf):
    o = B.table(spark, sf, "orders")
    cand = o.select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("candidate_id"), F.expr(_CONF).alias("confidence"), F.expr(_RATE).alias("match_rate"), F.expr(_CL).alias("label"), F.expr(_CR).alias("raw_text"),
        F.expr(_CM).alias("method"), (F.col("o_orderstatus") != "P").alias("verified"), F.expr(_STAGE).cast("int").alias("stage"), (F.col("o_custkey") % 3 == 0).alias("official"),
    )
    parts = B.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), T.compact_key(F.col("p_name")).alias("key"))
    items = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), "l_partkey").join(parts, "l_partkey")
    items = items.join(o.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("group_id")), "candidate_id")
    return cand, items.select("group_id", "candidate_id", "key")


@query("d8_consensus", ctes("SELECT group_id, candidate_id, candidate_count, total FROM best", **CAND, **consensus_ctes("cand", "items")))
def d8_consensus(spark, sf):
    return C.consensus(*order_lists(spark, sf))


@query(
    "g6_first_success",
    ctes(
        "SELECT b.group_id, b.candidate_id, b.candidate_count, b.total, w.stage FROM best b JOIN won w USING (group_id)",
        **CAND,
        live="SELECT * FROM cand WHERE NOT official OR NOT (stage = 2 OR (stage = 3 AND NOT contains(method, 'structured-output')))",
        won="SELECT group_id, min(stage) AS stage FROM live WHERE verified GROUP BY 1",
        pool="SELECT l.* FROM live l JOIN won w ON w.group_id = l.group_id AND w.stage = l.stage WHERE verified",
        pit="SELECT i.* FROM items i JOIN pool p ON p.group_id = i.group_id AND p.candidate_id = i.candidate_id",
        **consensus_ctes("pool", "pit"),
    ),
)
def g6_first_success(spark, sf):
    return C.first_success(*order_lists(spark, sf))


# ------------------------------------------------------------------ attempts: E6 - E8, G9, G10, A8
_EV = {
    "source": "event_type", "ord": "event_id", "matched": "value > 30", "has_ingredients": "user_id % 3 = 0", "verified": "value > 60", "score": "CAST(floor(value) AS BIGINT)",
    "reason": "'value ' || CAST(user_id AS STRING)", "fingerprint": "user_id", "website": "'site' || CAST(user_id % 4 AS STRING)", "method": "event_type",
    "rule": "CASE WHEN event_type = 'error' THEN 'MIN_INGREDIENT_COUNT' ELSE 'OTHER' END", "ingredient_count": "CAST(event_id % 9 AS INT)",
}
_EVS = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _EV.items()) + " FROM events"


def attempts(spark, sf):
    return B.table(spark, sf, "events").select(*[F.expr(v).alias(k) for k, v in _EV.items()])


@query(
    "e6_source_report",
    ctes(
        "SELECT *, inspected || ' pages checked' || CASE WHEN matched_pages > 0 THEN '. ' || matched_pages || ' matched the product' ELSE '' END || CASE WHEN ingredient_hits > 0 THEN '. ' || ingredient_hits || ' ingredient sections found' ELSE '' END "
        "|| CASE WHEN verified_candidates > 0 THEN '. ' || verified_candidates || ' verified candidates found' ELSE '' END || '.' AS summary FROM (SELECT source, count(*) AS inspected, count(*) FILTER (WHERE matched) AS matched_pages, count(*) FILTER (WHERE has_ingredients) AS ingredient_hits, "
        "count(*) FILTER (WHERE verified) AS verified_candidates, arg_max(reason, ord) AS last_reason FROM ev GROUP BY 1)",
        ev=_EVS,
    ),
)
def e6_source_report(spark, sf):
    return C.source_report(attempts(spark, sf))


@query("e6_top_matches", ctes("SELECT source, ord, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, ord) AS INT) AS rank FROM ev QUALIFY rank <= 8", ev=_EVS))
def e6_top_matches(spark, sf):
    return C.top_matches(attempts(spark, sf)).select("source", "ord", "score", "rank")


@query(
    "e7_attempted_sources",
    ctes("SELECT fingerprint, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY o) - 1 AS INT) AS pos, label FROM (SELECT fingerprint, website || ':' || method AS label, min(ord) AS o FROM ev GROUP BY 1, 2)", ev=_EVS),
)
def e7_attempted_sources(spark, sf):
    return C.attempted_sources(attempts(spark, sf))


@query(
    "e8_failure_summary",
    ctes(
        "SELECT fingerprint, CASE WHEN rule = 'MIN_INGREDIENT_COUNT' THEN 'Found ' || ingredient_count || ' partial/key ingredient' || CASE WHEN ingredient_count = 1 THEN '' ELSE 's' END || ', but not a complete INCI formula. Continuing to search trusted sources.' ELSE reason END AS summary "
        "FROM ev QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) = 1",
        ev=_EVS,
    ),
)
def e8_failure_summary(spark, sf):
    return C.failure_summary(attempts(spark, sf))


_STEPS = [("'Searching ' || event_type", "CASE user_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END", "''"), ("'Selecting best'", "'completed'", "'x'"), ("'Knowledge base  lookup'", "'completed'", "'hit ' || event_type")]
_TRY = ("CASE WHEN event_type = 'error' THEN '' ELSE event_type END", "''", "'w' || CAST(user_id % 2 AS STRING)", "''", "user_id % 2 = 0", "'r' || event_type")
_LOG = (
    "SELECT fingerprint, stage, url, website, method, status, reason, candidate_count FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint, stage, url, website, method, status, reason ORDER BY ord, kind, i) AS rn FROM ("
    + " UNION ALL ".join(
        f"SELECT user_id AS fingerprint, event_id AS ord, 0 AS kind, {i} AS i, {a} AS stage, 'u' || user_id AS url, 'site' AS website, regexp_replace(lower({a}), {D.q(D.SPACES + '+')}, '-', 'g') AS method, "
        f"CASE {s} WHEN 'completed' THEN 'COMPLETED' WHEN 'failed' THEN 'FAILED' ELSE 'STARTED' END AS status, nullif({d}, '') AS reason, 0 AS candidate_count FROM events WHERE regexp_matches({a}, 'searching|checking|lookup|parsing', 'i')"
        for i, (a, s, d) in enumerate(_STEPS)
    )
    + f" UNION ALL SELECT user_id, event_id, 1, 0, coalesce(nullif({_TRY[0]}, ''), 'discovery'), 'u' || user_id, {_TRY[2]}, 'unknown', CASE WHEN {_TRY[4]} THEN 'VERIFIED' ELSE 'FAILED' END, {_TRY[5]}, CAST(event_id % 5 AS INT) FROM events)) WHERE rn = 1"
)


def attempt_log(spark, sf):
    e = B.table(spark, sf, "events")
    steps = F.array(*[F.struct(F.expr(a).alias("label"), F.expr(s).alias("state"), F.expr(d).alias("details")) for a, s, d in _STEPS])
    tried = F.array(
        F.struct(
            *[F.expr(x).alias(n) for x, n in zip(_TRY, ("stage", "url", "website", "method", "verified", "reason"))],
            (F.col("event_id") % 5).cast("int").alias("ingredient_count"), F.lit(None).cast("int").alias("matched_count"), F.lit(None).cast("double").alias("confidence"),
        )
    )
    res = e.select(F.col("user_id").alias("fingerprint"), F.col("event_id").alias("ord"), F.concat(F.lit("u"), "user_id").alias("url"), F.lit("site").alias("website"), steps.alias("steps"), tried.alias("attempts"))
    return KB.attempt_rows(res)


@query("g9_attempt_rows", _LOG)
def g9_attempt_rows(spark, sf):
    return attempt_log(spark, sf).select("fingerprint", "stage", "url", "website", "method", "status", "reason", "candidate_count")


@query("a8_attempt_log", f"SELECT stage, status, count(*) AS row_count FROM ({_LOG}) GROUP BY 1, 2")
def a8_attempt_log(spark, sf):
    return attempt_log(spark, sf).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("row_count"))


@query("a8_append_attempts", f"SELECT fingerprint, stage, url, website, method, status, reason, candidate_count FROM ({_LOG})")
def a8_append_attempts(spark, sf):
    """The log in four batches, each written twice, and read back."""
    path, log = work_dir(spark, "attempts"), attempt_log(spark, sf)
    for batch in range(4):
        for _ in range(2):
            KB.append_attempts(log.where(F.pmod(F.xxhash64("fingerprint"), F.lit(4)) == batch), path, batch)
    return KB.committed(spark, path, "attempt").select("fingerprint", "stage", "url", "website", "method", "status", "reason", "candidate_count")


@query(
    "g10_attempt_history",
    "SELECT user_id AS fingerprint, event_id AS attempt_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 20)",
)
def g10_attempt_history(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("fingerprint"), F.col("event_id").alias("attempt_id"), "event_type", "ts", "value")
    asked = e.where("event_type = 'purchase' AND value > 20").select("fingerprint")
    return KB.attempts_for(e, asked).select("fingerprint", "attempt_id", "event_type", "seq")


# ------------------------------------------------------------------ E9 - E12
def _stmt_case(x, table):
    key = f"replace(upper({D.spaced_key(x)}), ' ', '_')"
    return f"CASE {key} " + " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in table.items()) + " END"


_tidy = lambda x: f"list_filter(list_transform(coalesce({x}, []), lambda v: {D.strip('v')}), lambda v: v <> '')"
ENR = dict(
    dim=B.DIM_SQL,
    n0=f"SELECT * REPLACE ({', '.join(f'{_tidy(c)} AS {c}' for c in ('aliases', 'functions', 'helps'))}, CASE WHEN ingredient_id % 4 = 2 THEN [] ELSE functions END AS functions) FROM (SELECT * REPLACE (CASE WHEN ingredient_id % 4 = 2 THEN [] ELSE functions END AS functions) FROM dim)".replace(", CASE WHEN ingredient_id % 4 = 2 THEN [] ELSE functions END AS functions) FROM (", ") FROM ("),
    n1=f"SELECT * REPLACE (CASE WHEN len(functions) > 0 THEN functions ELSE {TQ.split_purpose_sql('display_purpose')} END AS functions, {TQ.EVIDENCE_SQL('evidence_level')} AS evidence_level) FROM n0",
    n2=f"SELECT *, list_filter(list_concat(list_transform(helps, lambda h: {_stmt_case('h', K.CONCERN_BENEFITS)}), list_transform(functions, lambda h: {_stmt_case('h', K.FUNCTION_BENEFITS)})), lambda v: v IS NOT NULL) AS der FROM n1",
    n3="SELECT *, CASE WHEN len(der) > 0 THEN der ELSE [upper(left(display_purpose, 1)) || substr(display_purpose, 2) || ' role in the formula.'] END AS b0 FROM n2",
    n4=f"SELECT *, {od('b0')} AS benefit_texts, functions[1] AS category, list_concat(aliases, list_filter([scientific_name], lambda s: s IS NOT NULL)) AS common_names FROM n3",
    enr2="SELECT *, coalesce(simple_explanation, benefit_texts[1], display_purpose) AS primary_purpose FROM n4",
    enrd="SELECT * REPLACE (coalesce(simple_explanation, primary_purpose) AS simple_explanation), coalesce(simple_explanation, primary_purpose) AS how_it_works FROM enr2",
)


def enriched_dim(spark, sf):
    dim = B.dimension(spark, sf)
    none = F.array().cast("array<string>")
    return KN.enrich_dim(dim.withColumn("functions", F.when(F.col("ingredient_id") % 4 == 2, none).otherwise(F.col("functions"))))


@query("e9_derive_benefits", ctes(f"SELECT ingredient_id, {joined('benefit_texts')} AS benefits FROM enrd", **ENR))
def e9_derive_benefits(spark, sf):
    return enriched_dim(spark, sf).select("ingredient_id", F.array_join("benefit_texts", "|").alias("benefits"))


_ECOLS = ["ingredient_id", "inci_name", "category", "primary_purpose", "how_it_works", "simple_explanation", "purpose", "evidence_level", "comedogenic", "irritation"]


@query("e10_enrich_dimension", ctes("SELECT " + ", ".join(_ECOLS) + f", {joined('functions')} AS functions, {joined('common_names')} AS common_names FROM enrd", **ENR))
def e10_enrich_dimension(spark, sf):
    return enriched_dim(spark, sf).select(*_ECOLS, F.array_join("functions", "|").alias("functions"), F.array_join("common_names", "|").alias("common_names"))


_GAPS = "SELECT ingredient_id, risk_level, unnest(list_filter([CASE WHEN evidence_level IS NULL THEN 'evidence_level' END, 'references'], lambda g: g IS NOT NULL)) AS gap FROM enrd"


@query("e11_coverage_gaps", ctes(_GAPS, **ENR))
def e11_coverage_gaps(spark, sf):
    return KN.coverage_gaps(enriched_dim(spark, sf))


@query("e11_coverage_report", ctes('SELECT coalesce(risk_level, \'ALL\') AS risk_level, coalesce(gap, \'ALL\') AS gap, count(*) AS "rows" FROM gaps GROUP BY CUBE (risk_level, gap)', **ENR, gaps=_GAPS))
def e11_coverage_report(spark, sf):
    return KN.coverage_report(enriched_dim(spark, sf))


_band = lambda c: f"CASE WHEN {c} >= 75 THEN 'Safe' WHEN {c} >= 50 THEN 'Moderate' ELSE 'Risky' END"


@query(
    "e12_score_bands",
    ctes(f"SELECT {_band('safety_score')} AS safety_band, {_band('suitability_score')} AS suitability_band, count(*) AS pairs FROM ps GROUP BY 1, 2", **SCORED, ps=Q.PAIR_SCORES),
)
def e12_score_bands(spark, sf):
    from .formula_queries import scored_lines

    p = S.pair_scores(scored_lines(spark, sf))
    return p.groupBy(S.score_band(F.col("safety_score")).alias("safety_band"), S.score_band(F.col("suitability_score")).alias("suitability_band")).agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "e12_score_summary",
    ctes(
        f"SELECT safety_status, suitability_status, confidence, count(*) AS answers FROM (SELECT {_band('coalesce(safety_score, 0)')} AS safety_status, "
        f"{_band('coalesce(suitability_score, 0)')} AS suitability_status, confidence_score AS confidence FROM ({ANALYZE_SQL})) GROUP BY 1, 2, 3",
        **ANALYZE,
    ),
)
def e12_score_summary(spark, sf):
    """Answers by the state of both scores and by confidence; what could not be verified counts as score 0."""
    return S.score_summary(order_analysis(spark, sf)).groupBy("safety_status", "suitability_status", "confidence").agg(F.count(F.lit(1)).alias("answers"))


# ------------------------------------------------------------------ D10 / D11 / F16 - F18
@query(
    "d10_expand_codes",
    ctes(f"SELECT profile_id, unnest({od('d')}) AS dimension FROM (SELECT profile_id, list_concat({Q.mapped('concerns', K.CONCERN_DIMENSIONS)}, {Q.mapped('goals', K.GOAL_DIMENSIONS)}) AS d FROM prof)", prof=B.PROFILE_SQL),
)
def d10_expand_codes(spark, sf):
    both = F.concat(S.expand_codes(F.col("concerns"), K.CONCERN_DIMENSIONS), S.expand_codes(F.col("goals"), K.GOAL_DIMENSIONS))
    return B.profiles(spark, sf).select("profile_id", F.explode(F.array_distinct(both)).alias("dimension"))


# Every order's list is asked about by its customer and by the next four customers there are.
_WIDE = "SELECT o_custkey + d AS profile_id, o_orderkey AS list_id FROM orders, (VALUES (0), (1), (2), (3), (4)) v(d)"


def wide_requests(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.select("o_custkey", F.col("o_orderkey").alias("list_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("d")).select((F.col("o_custkey") + F.col("d")).alias("profile_id"), "list_id")


WIDE = dict(SCORED, req=_WIDE, ps=Q.PAIR_SCORES)


def wide_scores(spark, sf):
    lines = resolved_lines(spark, sf).withColumn("display_name", F.col("canonical_name")).select("list_id", "position", "display_name", "ingredient_id")
    return S.score_all(lines, wide_requests(spark, sf), B.dimension(spark, sf), B.profiles(spark, sf))


@query("d11_score_all", ctes("SELECT profile_id, list_id, line_count, unknown_count, safety_score, suitability_score FROM ps", **WIDE))
def d11_score_all(spark, sf):
    return wide_scores(spark, sf).select("profile_id", "list_id", "line_count", "unknown_count", "safety_score", "suitability_score")


@query(
    "f18_recommend",
    ctes(f"SELECT profile_id, list_id, overall_score, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY overall_score DESC, list_id) AS INT) AS rank FROM (SELECT *, {Q.OVERALL} AS overall_score FROM ps) QUALIFY rank <= 3", **WIDE),
)
def f18_recommend(spark, sf):
    sc = wide_scores(spark, sf).withColumn("overall_score", S.overall(F.col("safety_score"), F.col("suitability_score")))
    return KB.recommend(sc.select("profile_id", "list_id", "overall_score"), 3)


_QF = {
    "q_heavy": "skin_type = 'OILY' AND comedogenic >= 3", "q_reactive": "skin_type = 'SENSITIVE' AND (irritation >= 2 OR list_contains(tags, 'fragrance'))", "q_dry": "skin_type = 'DRY' AND list_contains(tags, 'hydrating')",
    "q_acne": "list_contains(concerns, 'ACNE') AND list_contains(tags, 'anti-acne')", "q_fits": "list_contains(suitable_skin_types, skin_type)", "q_avoided": "list_contains(avoid_skin_types, skin_type)",
    "q_allergic": "len(list_filter(al, lambda a: contains(rk, a) OR contains(rk, replace(a, ' ', '')) OR list_contains(tags, a))) > 0",
}
QUICK = dict(
    dim=B.DIM_SQL, lines=B.LINES_SQL, req=B.REQUESTS_SQL, prof=B.PROFILE_SQL,
    q0="SELECT q.profile_id, q.list_id, l.position, lower(l.raw_name) AS rk, d.*, p.skin_type, p.concerns, list_concat(list_transform(list_filter(p.allergies, lambda a: a NOT IN ('NONE', 'OTHER')), lambda a: replace(lower(a), '_', ' ')), list_filter([lower(p.other_allergy)], lambda x: x IS NOT NULL)) AS al "
    "FROM lines l JOIN req q ON q.list_id = l.list_id JOIN prof p ON p.profile_id = q.profile_id LEFT JOIN dim d ON d.name = lower(l.raw_name)",
    q1="SELECT *, " + ", ".join(f"ingredient_id IS NOT NULL AND coalesce({v}, false) AS {k}" for k, v in _QF.items()) + " FROM q0",
)
_p = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0 END"


@query(
    "f16_quick_score",
    ctes(
        "SELECT profile_id, list_id, n - matched AS unknown_count, CAST(greatest(0, least(96, s)) AS BIGINT) AS safety_score, CAST(greatest(0, least(94, u)) AS BIGINT) AS suitability_score, "
        "CASE WHEN (s + u) / 2.0 >= 82 THEN 'Good fit overall, with only limited concerns.' WHEN (s + u) / 2.0 >= 68 THEN 'Moderate fit. Check the warnings before regular use.' WHEN (s + u) / 2.0 >= 50 THEN 'Risky fit. This formula has multiple profile conflicts.' ELSE 'Poor fit for this profile. This formula is better avoided.' END AS verdict FROM "
        "(SELECT *, 88 - sl - CASE WHEN n >= 10 THEN least(10, n - 9) ELSE 0 END AS s, 84 - ul - CASE WHEN matched >= 1 THEN 2 ELSE 0 END AS u FROM (SELECT profile_id, list_id, count(*) AS n, count(ingredient_id) AS matched, "
        f"sum(CASE WHEN ingredient_id IS NULL THEN 6 ELSE CASE risk_level WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 9 WHEN 'HIGH' THEN 18 ELSE 0 END + irritation * 7 + comedogenic * 5 + {_p('q_allergic', 8)} END) AS sl, "
        f"sum(CASE WHEN ingredient_id IS NULL THEN 4 ELSE {_p('q_heavy', 18)} + {_p('q_reactive', 18)} - {_p('q_dry', 5)} - {_p('q_acne', 6)} - {_p('q_fits', 4)} + {_p('q_avoided', 14)} + {_p('q_allergic', 22)} END) AS ul FROM q1 GROUP BY 1, 2))",
        **QUICK,
    ),
)
def f16_quick_score(spark, sf):
    return S.quick_scores(_quick_rows(spark, sf))


def _quick_rows(spark, sf):
    return S.quick_rows(B.formula_lines(spark, sf), B.requests(spark, sf), B.dimension(spark, sf), B.profiles(spark, sf))


_say = lambda c, t: f"CASE WHEN {c} THEN rk || {t} END"
_MSGS = (
    "SELECT profile_id, list_id, position, 'pro' AS side, i, m[i] AS message FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT *, list_filter([" + _say("q_dry", "' boosts hydration for dry skin.'") + ", " + _say("q_acne", "' supports acne-focused care.'") + "], lambda t: t IS NOT NULL) AS m FROM q1)) UNION ALL "
    "SELECT profile_id, list_id, position, 'con', i, m[i] FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT *, list_filter([" + ", ".join([
        _say("q_heavy", "' may feel too heavy for oily skin.'"), _say("q_reactive", "' can trigger sensitivity or redness.'"), _say("q_avoided", "' is usually avoided for ' || lower(skin_type) || ' skin.'"), _say("q_allergic", "' overlaps with your listed allergy trigger.'")])
    + "], lambda t: t IS NOT NULL) AS m FROM q1)) UNION ALL SELECT profile_id, list_id, 2147483647, 'con', 0, count(*) || CASE WHEN count(*) > 1 THEN ' ingredients are' ELSE ' ingredient is' END || ' not yet in the ingredient set, so the score is reduced for uncertainty.' FROM q1 WHERE ingredient_id IS NULL GROUP BY 1, 2"
)


@query(
    "f16_quick_messages",
    ctes(
        "SELECT profile_id, list_id, side, CAST(row_number() OVER (PARTITION BY profile_id, list_id, side ORDER BY position, i) AS INT) AS rank, message FROM (SELECT * FROM msgs QUALIFY row_number() OVER (PARTITION BY profile_id, list_id, side, message ORDER BY position, i) = 1) QUALIFY rank <= CASE side WHEN 'pro' THEN 3 ELSE 5 END",
        **QUICK, msgs=_MSGS,
    ),
)
def f16_quick_messages(spark, sf):
    rows = _quick_rows(spark, sf)
    pros = S.quick_messages(rows, "quick_pros", 3).withColumn("side", F.lit("pro"))
    return pros.unionByName(S.quick_messages(rows, "quick_cons", 5).withColumn("side", F.lit("con")))


@query(
    "f17_explain",
    ctes(
        "SELECT profile_id, list_id, 'Formula ' || list_id || ' scores ' || overall_score || '/100. ' || verdict || CASE WHEN strengths <> '' THEN ' Strengths: ' || strengths || '.' ELSE '' END || CASE WHEN weaknesses <> '' THEN ' Weaknesses: ' || weaknesses || '.' ELSE '' END AS explanation "
        f"FROM ({ANALYZE_SQL}) WHERE status = 'VERIFIED_INGREDIENTS_FOUND'",
        **ANALYZE,
    ),
)
def f17_explain(spark, sf):
    a = order_analysis(spark, sf).where("status = 'VERIFIED_INGREDIENTS_FOUND'")
    text = KN.explain_text(F.concat(F.lit("Formula "), "list_id"), F.col("overall_score"), F.col("verdict"), F.col("strengths"), F.col("weaknesses"))
    return a.select("profile_id", "list_id", text.alias("explanation"))


# ------------------------------------------------------------------ H
@query(
    "h1_ordered_union",
    "SELECT name, CAST(min(o) // 100000000 AS INT) AS side, CAST(min(o) % 100000000 AS BIGINT) AS ord FROM (SELECT p_name AS name, p_partkey AS o FROM part UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'red ring' END, 100000000 + s_suppkey FROM supplier) GROUP BY 1",
)
def h1_ordered_union(spark, sf):
    a = B.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    b = B.table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("red ring").alias("name"), F.col("s_suppkey").alias("ord"))
    return KB.ordered_union(a, b, "name")


@query(
    "h2_overlap_count",
    "SELECT a, b, count(y.k) AS shared FROM (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders) LEFT JOIN (SELECT DISTINCT l_orderkey AS s, p_name AS k FROM lineitem JOIN part ON p_partkey = l_partkey) x ON x.s = a LEFT JOIN (SELECT DISTINCT l_orderkey AS s, p_name AS k FROM lineitem JOIN part ON p_partkey = l_partkey) y ON y.s = b AND y.k = x.k GROUP BY 1, 2",
)
def h2_overlap_count(spark, sf):
    pairs = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    names = B.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("key"))
    sets = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("set_id"), "l_partkey").join(names, "l_partkey").select("set_id", "key")
    return KB.overlap_count(pairs, sets)


@query("h3_difference", "SELECT DISTINCT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48 AND l_returnflag = 'A')")
def h3_difference(spark, sf):
    a = B.table(spark, sf, "part").select(F.col("p_partkey").alias("part"))
    return KB.difference(a, B.table(spark, sf, "lineitem").where("l_quantity >= 48 AND l_returnflag = 'A'").select(F.col("l_partkey").alias("part")), "part")
