"""Page extraction, links, images and label texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import images as I
from ..operators import links as LK
from ..operators import markup as M
from ..operators import pages as P
from ..sources import bindings as B
from . import duck as D
from .registry import ctes, query
from .text_queries import _CAT, BRAND, duck_path, identity_ctes, joined, unnest_pos

PG = dict(pg=B.PAGES_SQL)


def rx(x, p, g=1, o="is"):
    return f"regexp_extract({x}, {D.q(p)}, {g}, '{o}')"


def rx_all(x, p, g=1, o="is"):
    return f"regexp_extract_all({x}, {D.q(p)}, {g}, '{o}')"


def host(x):
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def host_key(x):
    return f"regexp_replace({host(x)}, '^www\\.', '')"


# ------------------------------------------------------------------ A3 / C1
@query(
    "a3_page_corpus",
    f"SELECT {host_key('url')} AS host, count(*) AS page_count, CAST(sum(length(html)) AS BIGINT) AS html_chars FROM pages GROUP BY 1",
)
def a3_page_corpus(spark, sf):
    from ..sources.tables import pages

    df = pages(spark, sf)
    return df.groupBy(LK.host_key(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.length("html")).alias("html_chars"))


@query("c1_page_text", f"SELECT page_id, md5(t) AS text_hash, CAST(length(t) AS INT) AS text_length FROM (SELECT page_id, {D.visible_text('html')} AS t FROM pages)")
def c1_page_text(spark, sf):
    return P.page_text(B.texts(spark, sf, "pages")).select("page_id", F.md5("page_text").alias("text_hash"), F.length("page_text").alias("text_length"))


# ------------------------------------------------------------------ C2
def _meta_forms():
    out = []
    for rank, (attr, order) in enumerate([("property", 1), ("property", 2), ("name", 1), ("name", 2)]):
        keyed = rf"""{attr}=["']([^"']+)["']"""
        p = rf"""<meta[^>]+{keyed}[^>]+content=["']([^"']+)["']""" if order == 1 else rf"""<meta[^>]+content=["']([^"']+)["'][^>]+{keyed}"""
        k, v = (1, 2) if order == 1 else (2, 1)
        out.append(f"SELECT page_id, pos, {rank} AS rank, lower({rx('tag', p, k, 'i')}) AS key, {D.decode_entities(rx('tag', p, v, 'i'))} AS value FROM tags WHERE {rx('tag', p, k, 'i')} <> ''")
    return " UNION ALL ".join(out)


META = dict(tags=unnest_pos("page_id", rx_all("html", "<meta[^>]*>", 0, "i"), "pg", "tag", "pos"), meta=_meta_forms())


@query("c2_meta_tags", ctes("SELECT page_id, pos, CAST(rank AS INT) AS rank, key, value FROM meta", **PG, **META))
def c2_meta_tags(spark, sf):
    return P.meta_tags(B.product_pages(spark, sf))


# ------------------------------------------------------------------ C5 / C3 / C4
_LD = "regexp_extract(html, '<script[^>]+type=\"application/ld\\+json\"[^>]*>(.*?)</script>', 1, 'is')"
_J = lambda path: f"coalesce(json_extract_string(j, '{path}'), '')"
LD = dict(
    ld0=f"SELECT page_id, {_LD} AS j FROM pg WHERE json_valid({_LD})",
    ld=f"SELECT page_id, {_J('$.\"@graph\"[1].name')} AS raw_name, {D.clean_title(_J('$.\"@graph\"[1].name'))} AS name, {_J('$.\"@graph\"[1].brand.name')} AS brand, "
    f"{_J('$.\"@graph\"[1].image[0]')} AS image, {D.ws(_J('$.\"@graph\"[1].description'))} AS description, {D.label_list(_J('$.\"@graph\"[1].ingredients'))} AS ingredients, "
    f"{D.sku_of(_J('$.\"@graph\"[1].sku'))} AS sku, {D.clean_title(_J('$.\"@graph\"[0].itemListElement[1].name'))} AS breadcrumb FROM ld0",
)


@query("c5_jsonld_products", ctes("SELECT page_id, raw_name, name, brand, image, description, ingredients, sku FROM ld", **PG, **LD))
def c5_jsonld_products(spark, sf):
    return P.jsonld_products(B.product_pages(spark, sf)).select("page_id", "raw_name", "name", "brand", "image", "description", "ingredients", "sku")


_TITLE_RX, _H1_RX = "<title[^>]*>([^<]+)</title>", "<h1[^>]*>(.{2,240}?)</h1>"


def _title_choice():
    cols = {"json_ld": "ld.name", "structured": "''", "heading": "h1", "title": "coalesce(nullif(og, ''), ttl)", "breadcrumb": "breadcrumb", "fallback": "p_name"}
    entries = ", ".join(f"{{'i': {i}, 'w': {w}, 'v': {D.clean_title(D.text(cols[c]))}}}" for i, (c, w) in enumerate(K.TITLE_SOURCE_WEIGHTS))
    low = "lower({}.v)"
    agree = f"len(list_filter(e, lambda o: o.i <> x.i AND (contains({low.format('o')}, {low.format('x')}) OR contains({low.format('x')}, {low.format('o')}))))"
    return (
        f"SELECT page_id, coalesce(list_sort(list_transform(e, lambda x: {{'s': x.w * 10 + {agree} * 120 + least(length(x.v), 90), 'o': -x.i, 'v': x.v}}), 'DESC')[1].v, '') AS chosen_title FROM "
        f"(SELECT page_id, list_filter([{entries}], lambda x: x.v <> '') AS e FROM src)"
    )


@query(
    "c3_choose_title",
    ctes(
        _title_choice(), **PG, **META, **LD,
        og="SELECT page_id, arg_min(value, rank * 100000 + pos) AS og FROM meta WHERE key = 'og:title' GROUP BY 1",
        src=f"SELECT pg.page_id, p_name, ld.name, breadcrumb, og.og, {rx('html', _TITLE_RX, 1, 'i')} AS ttl, {D.visible_text(rx('html', _H1_RX))} AS h1 FROM pg LEFT JOIN ld USING (page_id) LEFT JOIN og USING (page_id)",
    ).replace("ld.name", "name").replace(", name, breadcrumb, og.og", ", ld.name, ld.breadcrumb, og.og"),
)
def c3_choose_title(spark, sf):
    pages = B.product_pages(spark, sf)
    og = P.meta_values(pages).where("key = 'og:title'").select("page_id", F.col("value").alias("og"))
    df = (
        pages.join(P.jsonld_products(pages).select("page_id", F.col("name").alias("json_ld")), "page_id", "left")
        .join(P.breadcrumb_names(pages), "page_id", "left")
        .join(og, "page_id", "left")
    )
    title = F.coalesce(T.blank(F.col("og")), F.regexp_extract("html", "(?i)" + _TITLE_RX, 1))
    df = df.withColumns(
        {"structured": F.lit(""), "heading": T.visible_text(F.regexp_extract("html", "(?is)" + _H1_RX, 1)), "title": title, "fallback": F.col("p_name")}
    )
    return P.choose_title(df).select("page_id", "chosen_title")


def duck_retail_brand(x):
    y = D.visible_text(D.text(x))
    y = D.sub_all(y, r"^(?:visit|shop)\s+(?:the\s+)?", "")
    y = D.sub_all(y, r"^(?:brand|manufacturer)\s*[:\-]\s*", "")
    y = D.strip(D.sub_all(y, r"\s+(?:official\s+)?store$", ""))
    return f"CASE WHEN lower({y}) IN {D.inlist(K.MARKETPLACE_BRANDS)} THEN '' ELSE {y} END"


_LDB = "CASE WHEN page_id % 3 = 0 THEN brand ELSE '' END"


@query(
    "c4_choose_brand",
    ctes(
        f"SELECT page_id, coalesce(nullif({duck_retail_brand('a')}, ''), nullif({duck_retail_brand('b')}, ''), nullif({duck_retail_brand('c')}, ''), {D.detect_brand('p_name')}) AS brand FROM src",
        **PG, **META, **LD,
        mb="SELECT page_id, arg_min(value, rank * 100000 + pos) AS mb FROM meta WHERE key = 'brand' GROUP BY 1",
        src=f"SELECT pg.page_id, p_name, CASE WHEN pg.page_id % 3 = 0 THEN ld.brand ELSE '' END AS a, {D.blank(duck_retail_brand(rx('html', P.BYLINES[0][5:])))} AS b, CASE WHEN pg.page_id % 2 = 0 THEN mb.mb ELSE 'Amazon' END AS c "
        "FROM pg LEFT JOIN ld USING (page_id) LEFT JOIN mb USING (page_id)",
    ),
)
def c4_choose_brand(spark, sf):
    pages = B.product_pages(spark, sf)
    meta = P.meta_values(pages).where("key = 'brand'").select("page_id", F.col("value").alias("mb"))
    ld = P.jsonld_products(pages).select("page_id", F.col("brand").alias("ld_brand"))
    df = pages.join(ld, "page_id", "left").join(meta, "page_id", "left").withColumns(
        {
            "a": F.when(F.col("page_id") % 3 == 0, F.col("ld_brand")).otherwise(""),
            "b": P.retail_brand(F.col("html")),
            "c": F.when(F.col("page_id") % 2 == 0, F.col("mb")).otherwise("Amazon"),
        }
    )
    return P.choose_brand(df, ["a", "b", "c"], ["p_name"]).select("page_id", "brand")


# ------------------------------------------------------------------ C6 / C7 / C8
def markup_to_text(x):
    y = D.sub_all(x, r"<br\s*/?>", ", ")
    y = D.sub_all(y, r"</(?:p|li|div|dd|tr)>", ", ")
    y = D.sub_all(y, "<[^>]+>", " ")
    return D.decode_entities(y)


_NEXT = rx("html", """<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""")
_PROD = "$.props.pageProps.product"
_S = lambda j, p: f"coalesce(json_extract_string({j}, '{_PROD}.{p}'), '')"
_TXT = markup_to_text(_S("j", "description"))
_BODY = f"regexp_extract({_TXT}, {D.q('(?i)' + D.re2(K.JSON_TEXT_HEAD) + '(.{20,900}?)(?:' + D.re2(K.JSON_TEXT_STOP) + '|$)')}, 1)"


def _hits(block, where):
    base = f"props.pageProps.product"
    return (
        f"SELECT page_id, '{block}' AS block, '{base}.full_ingredients' AS path, 'Water, ' || {_S('j', 'full_ingredients[1].name')} || ', Glycerin' AS value FROM {where} "
        f"UNION ALL SELECT page_id, '{block}', '{base}.details.0.value', {markup_to_text(_S('j', 'details[0].value'))} FROM {where} "
        f"UNION ALL SELECT page_id, '{block}', '{base}.description', {D.ws(_BODY)} FROM {where}"
    )


@query(
    "c6_json_ingredient_values",
    ctes(
        _hits("__NEXT_DATA__", "cleaned") + " UNION ALL " + _hits("embedded-json", "plain")
        + " UNION ALL SELECT page_id, 'embedded-json', '@graph.1.ingredients', " + markup_to_text(_J('$."@graph"[1].ingredients')) + " FROM ld0",
        **PG, **LD, cleaned=f"SELECT page_id, {markup_to_text(_NEXT)} AS j FROM pg", plain=f"SELECT page_id, {_NEXT} AS j FROM pg",
    ),
)
def c6_json_ingredient_values(spark, sf):
    paths = M.json_paths(P.state_blocks(B.product_pages(spark, sf)))
    return P.json_ingredient_values(paths).select("page_id", "block", "path", "value")


@query(
    "c7_structured_product",
    ctes(
        f"SELECT page_id, '__NEXT_DATA__' AS block, CAST(40 + 28 + 16 + 8 + 8 AS INT) AS reliability, {markup_to_text(_S('j', 'name'))} AS name, {markup_to_text(_S('j', 'brand'))} AS brand, "
        f"{markup_to_text(_S('j', 'description'))} AS description, '' AS image, {markup_to_text(_S('j', 'sku'))} AS sku FROM cleaned",
        **PG, cleaned=f"SELECT page_id, {markup_to_text(_NEXT)} AS j FROM pg",
    ),
)
def c7_structured_product(spark, sf):
    paths = M.json_paths(P.state_blocks(B.product_pages(spark, sf)))
    return P.structured_product(paths)


_SCOPE = rx("html", P.MICRODATA_SCOPE[5:])


@query(
    "c8_microdata",
    ctes(f"SELECT page_id, CAST(0 AS INT) AS ord, {markup_to_text(rx('scope', P.MICRODATA[0][4:], 1, 'i'))} AS value FROM (SELECT page_id, {_SCOPE} AS scope FROM pg) WHERE {rx('scope', P.MICRODATA[0][4:], 1, 'i')} <> ''", **PG),
)
def c8_microdata(spark, sf):
    return P.microdata(B.product_pages(spark, sf))


# ------------------------------------------------------------------ C9 - C11
_LIST = B._LIST
_DOM = dict(pl=f"SELECT page_id, p_name, p_type, p_brand, {D.dom_section(_LIST)} AS lst FROM pg")


def _dom(method, spark, sf):
    return M.dom_candidates(B.product_pages(spark, sf)).where(F.col("method") == method).select("page_id", "method", "label", "raw_text")


@query("c9_dom_sections", ctes("SELECT page_id, 'dom-heading' AS method, 'Ingredients' AS label, lst AS raw_text FROM pl", **PG, **_DOM))
def c9_dom_sections(spark, sf):
    return _dom("dom-heading", spark, sf)


@query(
    "c10_dom_containers",
    ctes("SELECT page_id, 'dom-container' AS method, 'ingredient-list' AS label, 'Water, ' || p_name || ', Sodium oil, Glycerin' AS raw_text FROM pl", **PG, **_DOM),
)
def c10_dom_containers(spark, sf):
    return _dom("dom-container", spark, sf)


@query(
    "c11_dom_tables",
    ctes("SELECT page_id, 'dom-table' AS method, 'ingredient-table' AS label, 'Water extract, ' || p_name || ' oil, Sodium ' || lower(p_type) AS raw_text FROM pl", **PG, **_DOM),
)
def c11_dom_tables(spark, sf):
    return _dom("dom-table", spark, sf)


@query("c9_page_sections")
def c9_page_sections(spark, sf):
    """The crawled pages themselves, with a heading word their titles share."""
    return M.dom_candidates(B.texts(spark, sf, "pages"), r"\b(?:the|de|la|der|el)\b", r"\bstop\b").select("page_id", "method", "label", F.length("raw_text").alias("text_length"))


# ------------------------------------------------------------------ C12 / C15
_LISTY = "text || ' Full Ingredients: ' || regexp_replace(text, '[.]', ',', 'g') || ' directions'"
_LISTY_SPARK = "concat(text, ' Full Ingredients: ', regexp_replace(text, '[.]', ','), ' directions')"


def duck_plausible_text(x):
    items = f"list_filter(list_transform(string_split({D.page_section(x)}, ','), lambda p: {D.strip('p')}), lambda p: p <> '')"
    shaped = f"len(list_filter({items}, lambda i: {D.has('i', K.ITEM_SHAPE)}))"
    return f"(NOT {D.any_of(f'lower({x})', K.TEXT_MARKETING)} AND len({items}) >= 3 AND {shaped} >= greatest(3, floor(len({items}) * 0.75)))"


def duck_plausible_dom(x):
    y = D.dom_text(x)
    return (
        f"(length({y}) >= 20 AND NOT {D.has(f'left({y}, 100)', K.PARTIAL_PATTERN)} AND (len(regexp_extract_all({y}, '[,;|•·]')) >= 2 OR len({D.get_all(y, K.SIGNAL_WORDS)}) >= 3))"
    )


def _body(head):
    p = D.re2(head) + "(" + D.re2(K.TEXT_SECTION_BODY) + "{" + str(K.TEXT_SECTION_MIN) + "}" + D.re2(K.TEXT_SECTION_BODY) + "*)"
    return f"left(regexp_extract(s, {D.q(p)}, 1, 'i'), {K.TEXT_SECTION_MAX})"


@query(
    "c12_text_section",
    ctes(
        "SELECT doc_id, md5(section) AS section_hash, CAST(length(section) AS INT) AS section_length FROM (SELECT doc_id, coalesce("
        + ", ".join(f"CASE WHEN b{i} <> '' AND {duck_plausible_text(f'b{i}')} THEN {D.page_section(f'b{i}')} END" for i in range(len(K.TEXT_SECTION_HEADS)))
        + ", '') AS section FROM bodies)",
        bodies="SELECT doc_id, " + ", ".join(f"{_body(h)} AS b{i}" for i, h in enumerate(K.TEXT_SECTION_HEADS)) + f" FROM (SELECT doc_id, {_LISTY} AS s FROM documents)",
    ),
)
def c12_text_section(spark, sf):
    df = B.texts(spark, sf, "documents").select("doc_id", F.expr(_LISTY_SPARK).alias("s"))
    return P.text_section(df, "s").select("doc_id", F.md5("section").alias("section_hash"), F.length("section").alias("section_length"))


@query(
    "c15_plausible_lists",
    f"SELECT 'd' || doc_id AS id, {duck_plausible_dom('text')} AS dom_ok, {duck_plausible_text('text')} AS text_ok FROM documents "
    f"UNION ALL SELECT 'c' || conv_id || '-' || turn, {duck_plausible_dom('text')}, {duck_plausible_text('text')} FROM conversations",
)
def c15_plausible_lists(spark, sf):
    docs = B.texts(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    turns = B.texts(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text")
    return docs.unionByName(turns).select("id", P.plausible_dom(F.col("text")).alias("dom_ok"), P.plausible_text(F.col("text")).alias("text_ok"))


# ------------------------------------------------------------------ C13 / C14 / C30
_CAND_SQL = (
    "SELECT page_id, 'dom' AS family, 'dom-heading' AS method, 'Ingredients' AS label, lst AS raw_text FROM pl UNION ALL "
    "SELECT page_id, 'dom', 'dom-container', 'ingredient-list', 'Water, ' || p_name || ', Sodium oil, Glycerin' FROM pl UNION ALL "
    "SELECT page_id, 'dom', 'dom-table', 'ingredient-table', 'Water extract, ' || p_name || ' oil, Sodium ' || lower(p_type) FROM pl UNION ALL "
    "SELECT page_id, 'structured', CASE block WHEN '__NEXT_DATA__' THEN '__next_data__' ELSE 'embedded-product-json' END, block, value FROM jh UNION ALL "
    "SELECT page_id, 'structured', 'microdata', 'microdata', value FROM md UNION ALL "
    "SELECT page_id, 'jsonld', 'json-ld', 'json-ld', ingredients FROM ld WHERE ingredients <> ''"
)


def page_candidates(spark, sf):
    """Union of the extractors of a page, deduplicated inside each family."""
    pages = B.product_pages(spark, sf)
    dom = M.dom_candidates(pages).select("page_id", F.lit("dom").alias("family"), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("ord").cast("long").alias("at")).alias("ord"), "method", "label", "raw_text")
    json = P.json_ingredient_values(M.json_paths(P.state_blocks(pages)))
    method = F.when(F.col("block") == "embedded-json", "embedded-product-json").otherwise(F.lower("block"))
    json = json.select("page_id", F.lit("structured").alias("family"), F.struct(F.lit(0).alias("kind"), F.col("block_ord").cast("long").alias("block"), F.col("ord").cast("long").alias("at")).alias("ord"), method.alias("method"), F.col("block").alias("label"), F.col("value").alias("raw_text"))
    micro = P.microdata(pages).select("page_id", F.lit("structured").alias("family"), F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("ord").cast("long").alias("at")).alias("ord"), F.lit("microdata").alias("method"), F.lit("microdata").alias("label"), F.col("value").alias("raw_text"))
    ld = P.jsonld_products(pages).where("ingredients <> ''").select("page_id", F.lit("jsonld").alias("family"), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("at")).alias("ord"), F.lit("json-ld").alias("method"), F.lit("json-ld").alias("label"), F.col("ingredients").alias("raw_text"))
    return P.dedupe_candidates(dom.unionByName(json).unionByName(micro).unionByName(ld))


_MICRO = f"SELECT page_id, {markup_to_text(rx('scope', P.MICRODATA[0][4:], 1, 'i'))} AS value FROM (SELECT page_id, {_SCOPE} AS scope FROM pg)"


@query(
    "c13_candidates",
    ctes(
        f"SELECT page_id, family, count(*) AS candidate_count, count(DISTINCT {D.dom_key('raw_text')}) AS distinct_texts FROM (SELECT DISTINCT page_id, family, {D.dom_key('raw_text')} AS k, min(raw_text) AS raw_text FROM cand GROUP BY 1, 2, 3) GROUP BY 1, 2",
        **PG, **LD, **_DOM,
        cleaned=f"SELECT page_id, {markup_to_text(_NEXT)} AS j FROM pg", plain=f"SELECT page_id, {_NEXT} AS j FROM pg",
        jh=_hits("__NEXT_DATA__", "cleaned") + " UNION ALL " + _hits("embedded-json", "plain") + " UNION ALL SELECT page_id, 'embedded-json', '@graph.1.ingredients', " + markup_to_text(_J('$."@graph"[1].ingredients')) + " FROM ld0",
        md=_MICRO, cand=_CAND_SQL,
    ),
)
def c13_candidates(spark, sf):
    c = page_candidates(spark, sf)
    return c.groupBy("page_id", "family").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_distinct(T.dom_key(F.col("raw_text"))).alias("distinct_texts"))


# Orders stand for candidates of a customer's page.
_LBL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Full Ingredients' WHEN '2-HIGH' THEN 'key ingredients' WHEN '3-MEDIUM' THEN 'INCI' WHEN '4-NOT SPECIFIED' THEN 'why' ELSE 'Ingredient' END"
_MTH = "CASE o_orderstatus WHEN 'F' THEN 'dom-table' WHEN 'O' THEN 'dom-container' ELSE 'json-ld' END"
_RAW = "CASE o_orderkey % 5 WHEN 0 THEN 'a, b, etc. ' WHEN 1 THEN 'a… b' ELSE 'a, b' END"
_ORDER_CAND = f"SELECT o_custkey AS page_id, o_orderkey AS ord, {_LBL} AS label, {_MTH} AS method, {_RAW} AS raw_text, CAST(count(l_orderkey) AS INT) AS ingredient_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def order_candidates(spark, sf):
    counts = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = B.table(spark, sf, "orders").join(counts, "o_orderkey", "left")
    return o.select(
        F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("ord"), F.expr(_LBL).alias("label"), F.expr(_MTH).alias("method"), F.expr(_RAW).alias("raw_text"),
        F.coalesce("n", F.lit(0)).cast("int").alias("ingredient_count"),
    )


_PTS = (
    f"least(ingredient_count, 60) * 15 + CASE WHEN {D.has('lower(label)', K.FULL_LABEL)} THEN 550 ELSE 0 END + CASE WHEN {D.has('lower(label)', K.ANY_LABEL)} THEN 180 ELSE 0 END "
    f"- CASE WHEN {D.has('lower(label)', K.PARTIAL_LABEL)} THEN 800 ELSE 0 END - CASE WHEN ingredient_count < 8 THEN 450 ELSE 0 END + CASE WHEN method = 'dom-table' THEN 180 ELSE 0 END "
    f"+ CASE WHEN method = 'dom-container' THEN 100 ELSE 0 END - CASE WHEN {D.has('raw_text', K.TRUNCATED)} THEN 350 ELSE 0 END"
)


@query(
    "c14_rank_candidates",
    ctes(f"SELECT page_id, ord, CAST({_PTS} AS INT) AS score_tenths, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {_PTS} DESC, ord) - 1 AS INT) AS rank FROM oc", oc=_ORDER_CAND),
)
def c14_rank_candidates(spark, sf):
    return P.rank_candidates(order_candidates(spark, sf)).select("page_id", "ord", "score_tenths", "rank")


@query(
    "c30_apply_selection",
    ctes(
        "SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sel_pos NULLS LAST, idx) - 1 AS INT) AS new_pos FROM idx LEFT JOIN (SELECT page_id, idx, min(sel_pos) AS sel_pos FROM sel GROUP BY 1, 2) USING (page_id, idx)",
        idx="SELECT o_custkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx FROM orders",
        sel="SELECT c_custkey AS page_id, 0 AS sel_pos, CAST(c_custkey % 5 AS INT) AS idx FROM customer UNION ALL SELECT c_custkey, 1, 0 FROM customer UNION ALL SELECT c_custkey, 2, 99 FROM customer UNION ALL SELECT c_custkey, 3, CAST(c_custkey % 5 AS INT) FROM customer",
    ),
)
def c30_apply_selection(spark, sf):
    from ..operators.ranking import rank_in_group

    o = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), "o_orderkey")
    idx = rank_in_group(o, ["page_id"], ["o_orderkey"], [F.lit(0)], "idx").select("page_id", "idx")
    key = F.col("c_custkey")
    picks = F.array(*[F.struct(F.lit(i).alias("sel_pos"), v.cast("int").alias("idx")) for i, v in enumerate([key % 5, F.lit(0), F.lit(99), key % 5])])
    sel = B.table(spark, sf, "customer").select(key.alias("page_id"), F.explode(picks).alias("p")).select("page_id", "p.*")
    return P.apply_selection(idx, sel).select("page_id", "idx", "new_pos")


# ------------------------------------------------------------------ C16 - C18
_SIG = "ingredients?|inci|composition|product details|description"


@query(
    "c16_classify_pages",
    f"SELECT page_id, contains(lower(html), 'enable javascript') OR contains(lower(html), 'captcha') OR (length(html) < 1200 AND {rx('html', '<script[^>]+src=.[^>]+(?:webpack|runtime|bundle|main)[^>]+', 0, 'i')} <> '') "
    f"OR (NOT regexp_matches(html, '{_SIG}', 'i') AND NOT regexp_matches(html, 'og:title|twitter:title|<title|application/ld\\+json|__next_data__|__initial_state__', 'i') AND length(html) < 2200) AS javascript_driven, "
    f"{D.any_of('lower(url)', K.LISTING_URL_MARKERS)} OR {D.any_of('lower(' + rx('html', _TITLE_RX, 1, 'i') + ')', K.LISTING_TITLE_MARKERS)} AS listing_page, "
    f"{D.has('lower(' + rx('html', _TITLE_RX, 1, 'i') + ') || chr(10) || left(' + D.visible_text('html') + ', 4000)', K.ANTI_BOT_PATTERN)} AS anti_bot FROM "
    "(SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '&q=x' ELSE url END AS url, CASE page_id % 4 WHEN 0 THEN html || ' Security Check' ELSE html END AS html FROM pages)",
)
def c16_classify_pages(spark, sf):
    df = B.texts(spark, sf, "pages").withColumns(
        {
            "url": F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("&q=x"))).otherwise(F.col("url")),
            "html": F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit(" Security Check"))).otherwise(F.col("html")),
        }
    )
    return P.classify_pages(df).select("page_id", "javascript_driven", "listing_page", "anti_bot")


_A = r"""<a[^>]+href=["']([^"']+)["'][^>]*>"""
OUT = dict(
    anc=unnest_pos("page_id", rx_all("html", _A, 1, "i"), "pg", "href", "pos"),
    outl="SELECT page_id, url, CAST(min(pos) AS INT) AS pos FROM (SELECT page_id, pos, CASE WHEN regexp_matches(href, 'uddg=[^&]+', 'i') THEN url_decode(regexp_extract(href, 'uddg=([^&]+)', 1, 'i')) "
    "WHEN starts_with(href, 'http') THEN href ELSE '' END AS url FROM anc) WHERE regexp_matches(url, '^https?://', 'i') GROUP BY 1, 2",
)


@query("c17_outlinks", ctes("SELECT page_id, url, pos FROM outl", **PG, **OUT))
def c17_outlinks(spark, sf):
    return LK.outlinks(B.product_pages(spark, sf))


_AT = r"""<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def duck_resolve(h, b):
    o = f"regexp_extract({b}, '^(https?://[^/?#]+)', 1, 'i')"
    f = f"coalesce(nullif(regexp_extract({b}, '^(https?://[^/?#]+(?:/[^?#]*)?/)', 1, 'i'), ''), {o} || '/')"
    h = D.strip(h)
    return (
        f"CASE WHEN regexp_matches({h}, '^https?://', 'i') THEN {h} WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^(https?:)', 1, 'i') || {h} WHEN starts_with({h}, '/') THEN {o} || {h} "
        f"WHEN regexp_matches({h}, '^[a-z][a-z0-9+.-]*:|^#|^$', 'i') THEN '' ELSE {f} || {h} END"
    )


@query(
    "c17_site_links",
    ctes(
        f"SELECT page_id, pos, u AS url, text FROM (SELECT *, {host_key('u')} AS h, {host_key('page_url')} AS o FROM (SELECT page_id, page_url, pos, {duck_resolve('href', 'page_url')} AS u, {D.ws(D.sub_all('inner_html', '<[^>]+>', ''))} AS text FROM a2)) "
        "WHERE u <> '' AND (h = o OR ends_with(h, '.' || o)) AND regexp_matches(lower(u || ' ' || text), 'product|shop|pdp|item|ingredient|inci|composition')",
        **PG,
        a2=f"SELECT page_id, page_url, CAST(i - 1 AS INT) AS pos, hs[i] AS href, ins[i] AS inner_html FROM (SELECT page_id, url AS page_url, {rx_all('html', _AT, 1)} AS hs, {rx_all('html', _AT, 2)} AS ins, "
        f"unnest(generate_series(1, len({rx_all('html', _AT, 1)}))) AS i FROM pg)",
    ),
)
def c17_site_links(spark, sf):
    return LK.site_links(B.product_pages(spark, sf))


_URLS = "CASE page_id % 5 WHEN 0 THEN 'https://www.google.co.in/search?q=a' WHEN 1 THEN 'https://www.amazon.in/dp/B0' WHEN 2 THEN 'https://my.wordpress.com/x' ELSE url END"


@query(
    "c18_classify_urls",
    ctes(
        f"SELECT page_id, {host_key('u')} AS host_key, coalesce(nullif({host_key('u')}, ''), 'Generic Website') AS host_label, {D.any_of(host('u'), K.SEARCH_ENGINE_HOSTS)} AND (starts_with(lower({duck_path('u')}), '/search') "
        f"OR lower({duck_path('u')}) IN ('/', '') OR regexp_matches(u, '[?&]q=')) AS search_engine, {host('u')} <> '' AND NOT {D.any_of(host_key('u'), K.NON_OFFICIAL_HOSTS)} AS may_be_official, "
        f"NOT {D.any_of('lower(u)', K.NON_RETAIL_HOSTS)} AS may_be_retail, NOT {D.any_of('u', K.BLOCKED_RESULT_HOSTS)} AS may_be_result, regexp_matches({host('u')}, {D.q(K.MARKETPLACE_HOST)}, 'i') AS marketplace FROM us",
        us=f"SELECT page_id, {_URLS} AS u FROM pages",
    ),
)
def c18_classify_urls(spark, sf):
    df = B.texts(spark, sf, "pages").select("page_id", F.expr(_URLS).alias("u"))
    return LK.classify_urls(df, "u").drop("u")


# ------------------------------------------------------------------ C19
_BR = "CASE page_id % 3 WHEN 0 THEN 'Th' || split_part(p_name, ' ', 1) WHEN 1 THEN split_part(split_part(url, '/', 3), '.', 2) ELSE p_name END"


def _stem(h):
    return D.brand_compact(f"regexp_replace(regexp_replace({h}, '^www\\.', ''), '\\.[^.]*$|^[^.]*$', '')")


_tok = f"list_filter(string_split({D.brand_key('brand')}, ' '), lambda t: t <> '')"
_long = f"list_filter(string_split({D.brand_key('brand')}, ' '), lambda t: length(t) > 2)"
_SCORE = (
    f"CASE WHEN stem = '' OR nm = '' THEN 0.0 WHEN stem = nm THEN 100.0 WHEN contains(stem, nm) OR contains(nm, stem) THEN 82.0 "
    "ELSE len(list_filter(toks, lambda t: contains(stem, t))) * 100 / CAST(len(toks) AS DOUBLE) END"
)


@query(
    "c19_official_domain",
    ctes(
        "SELECT brand, arg_min(host, ord) AS official_domain, arg_min(confidence, ord) AS confidence FROM (SELECT *, greatest(68.0, least(96.0, CASE WHEN score > 0 THEN score WHEN mentioned THEN 72 ELSE 0 END))::DOUBLE / 100 AS confidence FROM sc "
        "WHERE score >= 45 OR mentioned) GROUP BY brand",
        **PG,
        h=f"SELECT {_BR} AS brand, page_id AS ord, {host_key('url')} AS host, {D.brand_key(D.plain_text('html'))} AS txt FROM pg",
        h2=f"SELECT *, {_stem('host')} AS stem, {D.brand_compact('brand')} AS nm, {_tok} AS toks, {_long} AS longs, {D.brand_key('brand')} AS bk FROM h WHERE {D.brand_key('brand')} <> '' AND host <> '' AND NOT {D.any_of('host', K.NON_OFFICIAL_HOSTS)}",
        sc=f"SELECT *, CAST({_SCORE} AS DOUBLE) AS score, bk <> '' AND (contains(txt, bk) OR (len(longs) > 0 AND len(list_filter(longs, lambda t: NOT contains(txt, t))) = 0)) AS mentioned FROM h2",
    ),
)
def c19_official_domain(spark, sf):
    hits = B.product_pages(spark, sf).select(F.expr(_BR).alias("brand"), F.col("page_id").alias("ord"), "url", "html")
    return LK.official_domain(hits)


# ------------------------------------------------------------------ D9 / C20 - C22
def profile_ctes(side: str, rel: str) -> dict:
    x = f"x_{side}_"
    c = lambda f: D.text(f"{side}_{f}")
    steps = {
        f"{x}a": f"SELECT *, concat_ws(' ', nullif({c('name')}, ''), nullif({c('description')}, ''), nullif({c('url')}, '')) AS {x}text FROM {rel}",
        f"{x}b": f"SELECT *, coalesce(nullif({c('brand')}, ''), {x}text) AS {x}hint FROM {x}a",
        f"{x}c": f"SELECT *, coalesce(nullif({D.detect_brand(x + 'hint')}, ''), {D.ws(x + 'hint')}) AS {x}brand, {D.product_type_of('coalesce(nullif(' + c('category') + chr(44) + ' ' + chr(39) + chr(39) + '), ' + c('name') + ')', x + 'text')} AS {x}type, lower({D.match_text(x + 'text')}) AS {x}low FROM {x}b",
    }
    steps.update(identity_ctes(f"{x}text", f"{x}c", f"{x}brand", f"{x}type", f"{x}i_"))
    esc = lambda w: f"regexp_replace({w}, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"
    dropw = lambda t, w: f"CASE WHEN {w} <> '' THEN regexp_replace({t}, '\\b' || {esc(w)} || '\\b', ' ', 'gi') ELSE {t} END"
    steps[f"{x}d"] = f"SELECT *, {D.match_text(x + 'i_variant')} AS {x}v0 FROM {x}i_s7"
    steps[f"{x}e"] = f"SELECT *, {dropw(x + 'v0', x + 'brand')} AS {x}v1 FROM {x}d"
    steps[f"{x}f"] = f"SELECT *, CASE WHEN {x}i_variant = '' THEN '' ELSE {D.ws('(' + dropw(x + 'v1', x + 'type') + ')')} END AS {x}variant, {D.tags_of(x + 'low', K.ACTIVE_RULES)} AS {x}actives, {D.tags_of(x + 'low', K.CONCERN_RULES)} AS {x}concerns FROM {x}e"
    return steps


def sim(a, b):
    s = f"(1.0::DOUBLE - levenshtein(lower({a}), lower({b})) / CAST(greatest(length({a}), length({b})) AS DOUBLE))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN lower({a}) = lower({b}) THEN 1.0 WHEN {s} < {K.SIMILARITY_FLOOR} THEN 0.0 ELSE {s} END"


def lsim(e, a):
    best = f"list_transform({e}, lambda x: CASE WHEN list_contains({a}, x) THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform({a}, lambda y: {sim('x', 'y')})), 0.0) END)"
    return f"CASE WHEN len({e}) > 0 THEN list_sum({best}) / len({e}) END"


def match_ctes(rel: str) -> dict:
    out = {**profile_ctes("l", rel), **profile_ctes("r", "x_l_f")}
    s = {
        "brand": f"CASE WHEN x_l_brand <> '' THEN {sim('x_l_brand', 'x_r_brand')} END", "type": f"CASE WHEN x_l_type <> '' THEN {sim('x_l_type', 'x_r_type')} END",
        "actives": lsim("x_l_actives", "x_r_actives"), "concerns": lsim("x_l_concerns", "x_r_concerns"),
        "variant": f"CASE WHEN x_l_variant <> '' THEN {sim('x_l_variant', 'x_r_variant')} END",
    }
    out["sims"] = "SELECT *, " + ", ".join(f"{v} AS m_{k}" for k, v in s.items()) + " FROM x_r_f"
    w = " + ".join(f"CASE WHEN m_{k} IS NOT NULL THEN {v} ELSE 0 END" for k, v in K.MATCH_WEIGHTS.items())
    p = " + ".join(f"coalesce(floor(m_{k} * {v} * 100 + 0.5) / 100, 0.0)" for k, v in K.MATCH_WEIGHTS.items())
    out["pts"] = f"SELECT *, {w} AS wsum, 0.0::DOUBLE + {p} AS psum FROM sims"
    out["fin"] = (
        "SELECT *, CAST(CASE WHEN wsum > 0 THEN floor(psum / wsum * 100 + 0.5) ELSE 0 END AS BIGINT) AS final_score, "
        + ", ".join(f"CAST(floor(m_{k} * 100 + 0.5) AS BIGINT) AS {k}_percent" for k in K.MATCH_WEIGHTS) + " FROM pts"
    )
    return out


_SIDE = {
    "l": {"name": "title", "brand": BRAND, "category": "cat", "description": "''", "url": "''"},
    "r": {"name": "noisy2", "brand": "CASE WHEN p2 % 3 = 0 THEN '' ELSE brand2 END", "category": "''", "description": "'with ' || name2", "url": "'https://www.shop.com/p/' || replace(name2, ' ', '-')"},
}
_SHIFT = "p_partkey + CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 24 WHEN 2 THEN 6 ELSE 1 END"
_PAIRS_SQL = (
    "SELECT a.p_partkey, " + ", ".join(f"{v} AS {s}_{f}" for s, fs in _SIDE.items() for f, v in fs.items())
    + f" FROM (SELECT *, {_CAT} AS cat, {_SHIFT} AS k FROM li) a JOIN (SELECT p_partkey AS p2, noisy AS noisy2, p_name AS name2, {BRAND} AS brand2 FROM li) b ON b.p2 = a.k"
)


def listing_pairs(spark, sf):
    li = B.listings(spark, sf)
    a = li.withColumns({"cat": T.category_of(F.col("title")), "k": F.expr(_SHIFT)})
    b = li.select(F.col("p_partkey").alias("p2"), F.col("noisy").alias("noisy2"), F.col("p_name").alias("name2"), F.expr(BRAND).alias("brand2"))
    j = a.join(b, a.k == b.p2)
    return j.select("p_partkey", *[F.expr(v).alias(f"{s}_{f}") for s, fs in _SIDE.items() for f, v in fs.items()])


_PCT = ", ".join(f"{k}_percent" for k in K.MATCH_WEIGHTS)


@query(
    "d9_match_products",
    ctes(f"SELECT p_partkey, final_score, final_score >= 85 AS accepted, final_score BETWEEN 70 AND 84 AS review, {_PCT} FROM fin", li=B.LISTINGS_SQL, prs=_PAIRS_SQL, **match_ctes("prs")),
)
def d9_match_products(spark, sf):
    out = LK.match_products(listing_pairs(spark, sf))
    return out.select("p_partkey", "final_score", "accepted", "review", *[f"{k}_percent" for k in K.MATCH_WEIGHTS])


_TAIL = "regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)"
_LINKS_SQL = (
    "SELECT o.page_id, o.pos, o.url, 'buy ' || p_name AS text, p_name || ' face wash' AS l_name, 'Maker ' || p_type AS l_brand, 'Face Wash' AS l_category, '' AS l_description, '' AS l_url, "
    f"{D.slug_title(_TAIL.replace('url', 'o.url', 1))} AS r_name, 'Maker ' || p_type AS r_brand, 'Face Wash' AS r_category, 'buy ' || p_name || ' ' || o.url AS r_description, o.url AS r_url FROM outl o JOIN pg USING (page_id)"
)


def _bonus(kind):
    return " + ".join(f"CASE WHEN regexp_matches({'url || chr(32) || text' if w == 'both' else 'url'}, {D.q(p)}, 'i') THEN {v} ELSE 0 END" for p, w, v in LK.LINK_BONUS[kind])


@query(
    "c20_rank_links",
    ctes(
        "SELECT page_id, kind, pos, url, rank_score, CAST(rn AS INT) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT page_id, '{kind}' AS kind, pos, url, rank_score, row_number() OVER (PARTITION BY page_id ORDER BY rank_score DESC, pos) AS rn FROM (SELECT *, CAST(greatest(0, final_score + {_bonus(kind)}) AS BIGINT) AS rank_score FROM fin)"
            for kind in LK.LINK_BONUS
        )
        + ") WHERE rn <= 10",
        **PG, **OUT, lnk=_LINKS_SQL, **match_ctes("lnk"),
    ),
)
def c20_rank_links(spark, sf):
    pages = B.product_pages(spark, sf)
    links = LK.outlinks(pages).join(pages.select("page_id", "p_name", "p_type"), "page_id")
    tail = F.regexp_extract(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", ""), "([^/]*)$", 1)
    maker = F.concat(F.lit("Maker "), F.col("p_type"))
    pairs = links.withColumns(
        {
            "text": F.concat(F.lit("buy "), F.col("p_name")),
            "l_name": F.concat("p_name", F.lit(" face wash")), "l_brand": maker, "l_category": F.lit("Face Wash"), "l_description": F.lit(""), "l_url": F.lit(""),
            "r_name": T.slug_title(tail), "r_brand": maker, "r_category": F.lit("Face Wash"), "r_description": F.concat(F.lit("buy "), "p_name", F.lit(" "), "url"), "r_url": F.col("url"),
        }
    )
    scored = LK.match_products(pairs).select("page_id", "pos", "url", "text", "final_score")
    return LK.rank_links(scored, list(LK.LINK_BONUS), 10).select("page_id", "kind", "pos", "url", "rank_score", "rank")


_HITS = "SELECT page_id % 40 AS request_id, page_id * 100 + pos AS ord, CASE WHEN page_id % 2 = 0 THEN 'shop.example.com' ELSE 'm.example.com' END AS domain, url FROM outl"


@query(
    "c21_cap_hits",
    ctes(
        "SELECT request_id, domain, url, ord, CAST(domain_rank AS INT) AS domain_rank, CAST(row_number() OVER (PARTITION BY request_id ORDER BY ord) AS INT) AS rank FROM "
        "(SELECT *, row_number() OVER (PARTITION BY request_id, domain ORDER BY ord) AS domain_rank FROM (SELECT request_id, domain, url, min(ord) AS ord FROM hits WHERE contains(url, domain) GROUP BY 1, 2, 3)) WHERE domain_rank <= 3 QUALIFY rank <= 12",
        **PG, **OUT, hits=_HITS,
    ),
)
def c21_cap_hits(spark, sf):
    o = LK.outlinks(B.product_pages(spark, sf))
    hits = o.select(
        (F.col("page_id") % 40).alias("request_id"), (F.col("page_id") * 100 + F.col("pos")).alias("ord"),
        F.when(F.col("page_id") % 2 == 0, "shop.example.com").otherwise("m.example.com").alias("domain"), "url",
    )
    return LK.cap_hits(hits, 3, 12).select("request_id", "domain", "url", "ord", "domain_rank", "rank")


def _slug(x):
    y = D.sub_all(f"lower({x})", r"\bfacewash\b", "face wash")
    y = f"replace({y}, '&', ' and ')"
    return f"regexp_replace(regexp_replace({y}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_CMP = D.ws(D.sub_all("name", K.DIRECT_URL_DROP))
_FORMS = ", ".join(_slug(f"brand || ' ' || {f}") for f in ("cmp", D.sub_first("cmp", r"\bcleansing face wash\b", "face wash"), "name"))
_DN = "CASE p_partkey % 3 WHEN 0 THEN title || ' daily cleansing face wash' WHEN 1 THEN title || ' mild facewash soap free' ELSE title END"


@query(
    "c22_direct_urls",
    ctes(
        "SELECT p_partkey, ord, 'https://incidecoder.com/products/' || slug AS url FROM ("
        + unnest_pos("p_partkey", "list_filter(f, lambda v, i: v <> '' AND list_position(f, v) = i)", "forms", "slug", "ord") + ")",
        li=B.LISTINGS_SQL, nm=f"SELECT p_partkey, {BRAND} AS brand, {_DN} AS name FROM li", cp=f"SELECT *, {_CMP} AS cmp FROM nm", forms=f"SELECT p_partkey, [{_FORMS}] AS f FROM cp",
    ),
)
def c22_direct_urls(spark, sf):
    df = B.listings(spark, sf).select("p_partkey", F.expr(BRAND).alias("brand"), F.expr(_DN).alias("name"), F.lit("").alias("canonical_name"))
    return LK.direct_urls(df, "p_partkey")


# ------------------------------------------------------------------ C23 - C26
_REFS = [
    "'{\"hi\":\"https:\\/\\/img.example.com\\/media\\/' || replace(p_name, ' ', '-') || '._AC_SX300_.jpg\",\"b\":\"//cdn.example.net/product/x' || CAST(page_id AS STRING) || '?w=90&h=90\"}'",
    "'https://img.example.com/p' || CAST(page_id AS STRING) || '-600x800?width=160&quality=60&v=2'",
    "'/static/back_label ' || CAST(page_id AS STRING) || '?width=300 1x, thumb?h=64 2x'",
    "'https://img.example.com/logo-' || CAST(page_id AS STRING) || '.png'",
]
_REFS_SQL = " UNION ALL ".join(f"SELECT page_id, url AS base, CAST({i} AS INT) AS ord, {v} AS raw FROM pg" for i, v in enumerate(_REFS))


def duck_safe(x, b):
    y = D.strip(f"replace({x}, '\\/', '/')")
    return f"CASE WHEN starts_with({y}, '//') THEN 'https:' || {y} ELSE {duck_resolve(y, b)} END"


def duck_image(x):
    return f"({x} <> '' AND NOT regexp_matches(lower({x}), '^(?:data|blob):') AND ({D.has(x, K.IMAGE_EXTENSION)} OR regexp_matches(lower({x}), {D.q(K.IMAGE_HINT)})))"


def duck_hires(x):
    g = f"regexp_replace({x}, '([?&](?:width|height|w|h)=)[^&#]*', '\\11600', 'g')"
    g = f"regexp_replace({g}, '([?&](?:quality|q)=)[^&#]*', '\\195', 'g')"
    b = f"regexp_replace(regexp_replace({x}, {D.q(K.IMAGE_DIMENSION_MARKER)}, '.', 'gi'), {D.q(K.IMAGE_LONG_MARKER)}, '.', 'gi')"
    return f"[{x}, {g}, {b}]"


_EMB = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(replace(raw, '\\/', '/'), {D.q(p[4:])}, 0, 'i')" for p in I.EMBEDDED[:2]) + "), " + f"regexp_extract_all(replace(raw, '\\/', '/'), {D.q(I.EMBEDDED[2][4:])}, 0, 'i'))"
IMG = dict(
    PG, refs=_REFS_SQL,
    emb=f"SELECT *, list_filter(list_transform({_EMB}, lambda u: {duck_safe('u', 'base')}), lambda u: {duck_image('u')}) AS e, {duck_safe('raw', 'base')} AS d, "
    f"list_transform(string_split(raw, ','), lambda s: {duck_safe('string_split_regex(' + D.strip('s') + chr(44) + ' ' + D.q(D.SPACES + '+') + ')[1]', 'base')}) AS ss FROM refs",
    allu=f"SELECT page_id, base, ord, CASE WHEN len(e) > 0 THEN flatten(list_transform(e, lambda u: {duck_hires('u')})) ELSE list_concat(list_concat([d], ss), {duck_hires('d')}) END AS u0 FROM emb",
    exp=unnest_pos("page_id, base, ord", "list_filter(u0, lambda v, i: v <> '' AND list_position(u0, v) = i)", "allu", "url", "pos"),
    img="SELECT *, ord * 100 + pos AS n, 'pack ' || ord AS alt, CASE WHEN ord = 2 THEN 'gallery' ELSE '' END AS css, CASE WHEN ord = 0 THEN 'embedded' ELSE 'dom' END AS source, "
    "CAST(CASE ord WHEN 1 THEN 640 WHEN 2 THEN 50 ELSE 0 END AS INT) AS width, CAST(CASE ord WHEN 1 THEN 480 WHEN 2 THEN 50 ELSE 0 END AS INT) AS height FROM exp",
)


def image_rows(spark, sf):
    pages = B.product_pages(spark, sf)
    refs = F.array(*[F.struct(F.lit(i).alias("ord"), F.expr(v).alias("raw")) for i, v in enumerate(s.replace("\\", "\\\\") for s in _REFS)])
    df = pages.select("page_id", F.col("url").alias("base"), F.explode(refs).alias("r")).select("page_id", "base", "r.ord", "r.raw")
    return df


def attributed_images(spark, sf):
    refs = image_rows(spark, sf)
    base = B.product_pages(spark, sf).select("page_id", F.col("url").alias("base"))
    df = I.expand_images(refs).join(base, "page_id")
    o = F.col("ord")
    return df.withColumns(
        {
            "n": o * 100 + F.col("pos"), "alt": F.concat(F.lit("pack "), o), "css": F.when(o == 2, "gallery").otherwise(""), "source": F.when(o == 0, "embedded").otherwise("dom"),
            "width": F.when(o == 1, 640).when(o == 2, 50).otherwise(0), "height": F.when(o == 1, 480).when(o == 2, 50).otherwise(0),
        }
    )


@query("c23_expand_images", ctes("SELECT page_id, ord, pos, url FROM exp", **IMG))
def c23_expand_images(spark, sf):
    return I.expand_images(image_rows(spark, sf))


_words = "lower(url || ' ' || alt || ' ' || css || ' ' || source)"
_OKIMG = (
    f"regexp_matches(lower(url), '^https?://') AND NOT regexp_matches({_words}, {D.q(K.IMAGE_REJECT)}) AND NOT regexp_matches(lower(url), {D.q(K.IMAGE_REJECT_URL)}) AND NOT {D.has('lower(url)', K.IMAGE_REJECT_EXT)} "
    f"AND NOT (width > 0 AND height > 0 AND width < 80 AND height < 80) AND ({duck_image('url')} OR regexp_matches({_words}, {D.q(K.IMAGE_ACCEPT)})) "
    f"AND (NOT regexp_matches({host('base')}, {D.q(K.MARKETPLACE_HOST)}, 'i') OR regexp_matches({host('url')}, {D.q(K.MARKETPLACE_IMAGE_HOST)}))"
)


@query("c24_filter_images", ctes(f"SELECT page_id, ord, pos, url FROM img WHERE {_OKIMG}", **IMG))
def c24_filter_images(spark, sf):
    return I.filter_images(attributed_images(spark, sf)).select("page_id", "ord", "pos", "url")


_RES = "greatest(width, height, coalesce(list_max(list_transform(flatten([" + ", ".join(f"regexp_extract_all(url, {D.q(D.re2(p))}, {g}, 'i')" for p, g in K.IMAGE_SIZE_PATTERNS) + "]), lambda s: CAST(s AS INT))), 0))"
_ipath = f"regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^?#]*)', 1), {D.q(K.IMAGE_ANY_MARKER)}, '.', 'gi')"
_ipath = f"regexp_replace({_ipath}, '([_-])\\d{{2,5}}x\\d{{2,5}}(\\.|_|-|$)', '\\1\\2', 'gi')"
_ipath = f"regexp_replace({_ipath}, '([_-])\\d{{2,5}}(\\.|_|-|$)', '\\1\\2', 'g')"
_kept = f"list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN {D.inlist(K.IMAGE_DROP_PARAMS)})"
_IKEY = f"lower({_ipath} || CASE WHEN len({_kept}) > 0 THEN '?' || array_to_string({_kept}, '&') ELSE '' END)"
DED = dict(IMG, keyed=f"SELECT *, {_IKEY} AS image_key, CAST({_RES} AS INT) AS resolution FROM img WHERE {_OKIMG}", ded="SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY page_id, image_key ORDER BY resolution DESC, n DESC) = 1")


@query("c25_dedupe_images", ctes("SELECT page_id, image_key, resolution, n, url FROM ded", **DED))
def c25_dedupe_images(spark, sf):
    df = I.filter_images(attributed_images(spark, sf)).drop("ord").withColumnRenamed("n", "ord")
    return I.dedupe_images(df).select("page_id", "image_key", "resolution", F.col("ord").alias("n"), "url")


_RANK = " + ".join(f"CASE WHEN regexp_matches({_words}, {D.q(p)}) THEN {v} ELSE 0 END" for p, v in K.IMAGE_RANK_RULES) + " + least(36, floor(resolution / 80.0 + 0.5)) + CASE WHEN width * height > 0 THEN least(20, floor(width * height / 160000.0 + 0.5)) ELSE 0 END"


@query(
    "c26_rank_images",
    ctes(f"SELECT page_id, n, url, CAST({_RANK} AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {_RANK} DESC, n) AS INT) AS rank FROM ded QUALIFY rank <= 12", **DED),
)
def c26_rank_images(spark, sf):
    df = I.filter_images(attributed_images(spark, sf)).drop("ord").withColumnRenamed("n", "ord")
    return I.rank_images(I.dedupe_images(df)).select("page_id", F.col("ord").alias("n"), "url", "score", "rank")


# ------------------------------------------------------------------ C27 - C29
_LT = "CASE turn % 3 WHEN 0 THEN text || ' Ingredients: Aqua, Glycerin, ' || text ELSE text END"


def _label_sql(rel):
    hits = " + ".join([f"CASE WHEN contains(lower(x), '{w}') THEN 1 ELSE 0 END" for w in K.LABEL_KEYWORDS] + [f"CASE WHEN {D.has('x', K.LABEL_COLOUR_INDEX)} THEN 1 ELSE 0 END"])
    return {
        "lt0": f"SELECT conv_id, turn, {D.ws('t')} AS x FROM {rel}",
        "lt1": f"SELECT *, {D.label_section('x')} AS sec, len(regexp_extract_all(x, ',')) AS commas, {hits} AS hits, {D.has('x', K.LABEL_HEADING)} AS head FROM lt0",
        "lt2": f"SELECT *, CAST(len({D.split_label('sec')}) AS INT) AS token_count FROM lt1",
        "lt3": f"SELECT *, token_count >= 8 AND commas >= 6 AS lng FROM lt2",
        "lt4": f"SELECT conv_id, turn, token_count, CAST(hits * 10 + least(token_count, 40) * 4 + least(commas, 30) * 2 + CASE WHEN head THEN 30 ELSE 0 END + CASE WHEN lng THEN 35 ELSE 0 END + CASE WHEN hits >= 3 THEN 20 ELSE 0 END "
        f"- CASE WHEN {D.has('x', K.LABEL_USAGE)} THEN 12 ELSE 0 END AS INT) AS score, head OR hits >= 3 OR lng AS is_ingredient_text FROM lt3",
    }


LT = dict(cv=f"SELECT conv_id, turn, {_LT} AS t FROM conversations", **_label_sql("cv"))


def labelled(spark, sf):
    df = B.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_LT).alias("t"))
    return P.score_label_text(df, "t")


@query("c27_score_label_text", ctes("SELECT * FROM lt4", **LT))
def c27_score_label_text(spark, sf):
    return labelled(spark, sf).select("conv_id", "turn", "token_count", "score", "is_ingredient_text")


@query(
    "c27_best_label_text",
    ctes("SELECT conv_id, turn, token_count, score FROM lt4 WHERE is_ingredient_text QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY token_count DESC, score DESC, turn) = 1", **LT),
)
def c27_best_label_text(spark, sf):
    return P.best_label_text(labelled(spark, sf), "conv_id", "turn")


_EK = D.evidence_key


@query(
    "c28_grounded_terms",
    ctes(
        "SELECT doc_id, CAST(len(terms) AS INT) AS term_count, CAST(len(sup) AS INT) AS supported_count, len(sup) / CAST(greatest(len(terms), 1) AS DOUBLE) AS support_rate, "
        "len(sup) >= least(8, len(terms)) AND len(sup) * 100 >= greatest(len(terms), 1) * 85 AS kept FROM "
        f"(SELECT doc_id, terms, list_filter(terms, lambda t: length({_EK('t')}) >= 3 AND contains(tx, ' ' || {_EK('t')} || ' ')) AS sup FROM src)",
        src=f"SELECT doc_id, ' ' || {_EK('d.text')} || ' ' AS tx, CASE WHEN doc_id % 2 = 0 THEN string_split_regex(d.text, '[.\\n]+') ELSE list_concat(string_split_regex(d.text, '[,]+'), string_split_regex(b.text, '[.]+')) END AS terms "
        "FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)",
    ),
)
def c28_grounded_terms(spark, sf):
    docs, bench = B.texts(spark, sf, "documents"), B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("b"))
    items = F.broadcast(bench.agg(F.count(F.lit(1)).alias("items")))  # one row
    df = docs.join(items).join(bench, F.col("item_id") == F.col("doc_id") % F.col("items")).withColumn(
        "terms", F.when(F.col("doc_id") % 2 == 0, F.split("text", r"[.\n]+")).otherwise(F.concat(F.split("text", "[,]+"), F.split("b", "[.]+")))
    )
    out = P.grounded_terms(df, "text", "terms")
    return out.select("doc_id", F.size("terms").alias("term_count"), F.size("supported").alias("supported_count"), "support_rate", "kept")


_OK = D.ocr_key
_near = "(contains(k, t) OR contains(t, k) OR levenshtein(k, t) <= greatest(1, floor(greatest(length(k), length(t)) * 0.25)))".replace("contains(k, t)", f"contains({_OK('x')}, t)").replace("contains(t, k)", f"contains(t, {_OK('x')})").replace("levenshtein(k, t)", f"levenshtein({_OK('x')}, t)").replace("length(k)", f"length({_OK('x')})")
_TERMS_D = "[replace(p_name, 'o', '0'), p_name || ' 1xtra long', substr(p_type, 2), 'zzzz' || p_name, '', lower(p_brand)]"
_TOKS_D = "[p_name, p_type || ' oil', 'Brand']"


@query(
    "c29_supported_terms",
    f"SELECT p_partkey, {joined(f'list_filter(list_filter(terms, lambda x: x <> {D.q(str())}), lambda x: {_OK(chr(120))} <> {D.q(str())} AND len(list_filter(toks, lambda t: {_near})) > 0)')} AS supported FROM "
    f"(SELECT p_partkey, {_TERMS_D} AS terms, list_transform({_TOKS_D}, lambda t: {_OK('t')}) AS toks FROM part)",
)
def c29_supported_terms(spark, sf):
    df = B.table(spark, sf, "part").select(
        "p_partkey", F.expr(_TERMS_D.replace("[", "array(").replace("]", ")")).alias("terms"), F.expr(_TOKS_D.replace("[", "array(").replace("]", ")")).alias("toks")
    )
    return P.supported_terms(df, "terms", "toks").select("p_partkey", F.array_join("supported", "|").alias("supported"))
