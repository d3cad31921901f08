"""Roles of the given tables: formula lines, ingredient dimension, profiles, products, pages.

The row expressions are written once with two array spellings, because the
same binding has to exist in Spark and in the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_in_group
from .tables import spread


class _Spark:
    @staticmethod
    def arr(*values: str) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")" if values else "cast(array() as array<string>)"

    compact = staticmethod(lambda x: f"filter({x}, v -> v is not null)")
    json_k = "cast(get_json_object(props, '$.k') as bigint)"


class _Duck:
    @staticmethod
    def arr(*values: str) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]" if values else "[]::VARCHAR[]"

    compact = staticmethod(lambda x: f"list_filter({x}, lambda v: v IS NOT NULL)")
    json_k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


SPARK, DUCK = _Spark, _Duck


def _case(expr: str, arms: dict, default: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN {v}" for k, v in arms.items()) + f" ELSE {default} END"


def dim_columns(d) -> list[str]:
    """Ingredient dimension columns over (name, k, p_type, p_size)."""
    a = d.arr
    pair = "array(" if d is SPARK else "list_value("
    swapped = "split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1)"
    functions = {
        "'ECONOMY'": a("Humectant"),
        "'MEDIUM'": a("Barrier Support", "Soothing"),
        "'SMALL'": a("Sebum Control"),
        "'LARGE'": a("Emollient", "Occlusive"),
        "'STANDARD'": a("Antioxidant"),
    }
    return [
        "k AS ingredient_id",
        "name",
        "name AS inci_name",
        "CASE WHEN k % 4 = 1 THEN 'sci ' || name END AS scientific_name",
        "lower(p_type) || ' / ' || split_part(name, ' ', 2) AS purpose",
        "lower(p_type) || ' / ' || split_part(name, ' ', 2) AS display_purpose",
        _case("k % 5", {0: "'HIGH'", 1: "'MEDIUM'"}, "'LOW'") + " AS risk_level",
        "CAST(p_size % 6 AS INT) AS comedogenic",
        "CAST((p_size + k) % 4 AS INT) AS irritation",
        f"CASE WHEN k % 2 = 0 THEN {pair}{swapped}, 'inci ' || name) ELSE {pair}{swapped}) END AS aliases",
        _case("p_type", functions, a("Fragrance", "Exfoliant")) + " AS functions",
        _case("k % 4", {0: a("ACNE"), 1: a("HYDRATION", "DRYNESS"), 3: a("REDNESS")}, a()) + " AS helps",
        _case("p_size % 5", {0: a("hydrating"), 1: a("base", "solvent"), 2: a("preservative"), 3: a("fragrance")}, a("surfactant"))
        + " AS tags",
        _case("k % 6", {0: a("FRAGRANCE_ALLERGY"), 5: a("SENSITIVE", "DRY")}, a()) + " AS avoid_for",
        _case("k % 4", {0: a("irritant"), 1: a("allergen")}, a()) + " AS risk_flags",
        _case("p_size % 3", {0: a("DRY", "NORMAL"), 1: a("OILY", "COMBINATION")}, a("SENSITIVE", "NORMAL", "DRY"))
        + " AS suitable_skin_types",
        _case("k % 5", {0: a("SENSITIVE"), 1: a("OILY", "DRY")}, a()) + " AS avoid_skin_types",
        _case("k % 6", {0: "'HIGH'", 1: "'MODERATE'", 2: "'MODERATE'", 3: "'LIMITED'", 4: "'MIXED'"}, "NULL")
        + " AS evidence_level",
        "CASE WHEN k % 3 <> 0 THEN 'About ' || name || '.' END AS simple_explanation",
    ]


def profile_columns(d) -> list[str]:
    a, pair = d.arr, ("array(" if d is SPARK else "list_value(")
    bits = d.compact(
        f"{pair}CASE WHEN c_custkey % 2 = 1 THEN 'ACNE' END, CASE WHEN c_custkey % 4 >= 2 THEN 'DRYNESS' END, "
        "CASE WHEN c_custkey % 8 >= 4 THEN 'REDNESS' END)"
    )
    return [
        "c_custkey AS profile_id",
        _case(
            "c_mktsegment",
            {"'AUTOMOBILE'": "'DRY'", "'BUILDING'": "'OILY'", "'FURNITURE'": "'COMBINATION'", "'HOUSEHOLD'": "'NORMAL'"},
            "'SENSITIVE'",
        )
        + " AS skin_type",
        _case("c_nationkey % 4", {0: "'NOT_SENSITIVE'", 1: "'SLIGHTLY_SENSITIVE'", 2: "'MODERATELY_SENSITIVE'"}, "'VERY_SENSITIVE'")
        + " AS skin_sensitivity",
        f"CASE WHEN c_custkey % 8 = 0 THEN {a('PIGMENTATION')} ELSE {bits} END AS concerns",
        _case(
            "c_custkey % 7",
            {0: a("HYDRATION"), 1: a("OIL_CONTROL", "BRIGHTENING"), 2: a("ANTI_AGING"), 3: a("BARRIER_REPAIR"), 4: a("EVEN_SKIN_TONE")},
            a("SMOOTH_TEXTURE", "REDUCE_REDNESS"),
        )
        + " AS goals",
        _case(
            "c_custkey % 5",
            {0: a("NONE"), 1: a("FRAGRANCE"), 2: a("ALCOHOL", "FRAGRANCE"), 3: a("OTHER", "LANOLIN")},
            a("PARABENS"),
        )
        + " AS allergies",
        "CASE WHEN c_custkey % 5 = 3 THEN 'Bolt, old  ring;' END AS other_allergy",
        _case("c_custkey % 3", {0: a("NONE"), 1: a("SILICONES", "FRAGRANCE")}, a("OTHER")) + " AS avoid_ingredients",
        "CASE WHEN c_custkey % 3 = 2 THEN 'gear; Humectant' END AS other_avoid",
        _case("c_custkey % 4", {0: "'STRAIGHT'", 1: "'WAVY'", 2: "'CURLY'"}, "'COILY'") + " AS hair_type",
        _case("c_nationkey % 5", {0: "'DRY'", 1: "'OILY'", 2: "'NORMAL'", 3: "'COMBINATION'"}, "'SENSITIVE'") + " AS scalp_type",
        _case("c_custkey % 3", {0: a("SHINE"), 1: a("VOLUME", "SCALP_HEALTH", "FRIZZ_CONTROL")}, a("HAIR_GROWTH")) + " AS hair_goals",
        _case("c_nationkey % 3", {0: a("DANDRUFF")}, a("FRIZZ", "DRY_HAIR")) + " AS hair_concerns",
    ]


# Title of a listing and its noisy copy, over part columns.
LISTING_TITLE = (
    "'Maker' || replace(p_brand, 'Brand#', 'x') || ' ' || p_name || CASE p_partkey % 6 WHEN 0 THEN ' Face Wash' "
    "WHEN 1 THEN ' Night Cream with Zinc' WHEN 2 THEN ' Hydrating Serum 2% Niacinamide + Zinc' "
    "WHEN 3 THEN ' Gentle Lotion for men' WHEN 4 THEN ' Sunscreen (SPF ceramide mix)' ELSE ' Soap Bar fragrance free' END "
    "|| ' ' || CAST(p_size AS STRING) || 'ml'"
)
NOISY_TITLE = (
    "'New  ' || title || CASE p_partkey % 5 WHEN 0 THEN ' | Buy Now' WHEN 1 THEN ' (value pack of 2)' "
    "WHEN 2 THEN ' controls oil' WHEN 3 THEN ' best seller: sale' ELSE ' dermatologically tested' END"
)

_LIST = "'Water, ' || p_name || ', Glycerin, ' || lower(p_type) || ' extract, Niacinamide, Panthenol, ' || p_brand || ' oil, Citric Acid'"


def page_blocks() -> str:
    """Product markup appended to a crawled page, over part columns."""
    name = "p_name || ' face wash ' || CAST(p_size AS STRING) || 'ml'"
    parts = [
        "'<meta property=\"og:title\" content=\"' || " + name + " || ' | Shop\"><meta content=\"A ' || lower(p_type) || "
        "' wash\" name=\"description\"><meta name=\"brand\" content=\"Maker ' || replace(p_brand, 'Brand#', '') || '\">'",
        "'<a id=\"bylineInfo\" href=\"/brand\">Visit the ' || CASE p_partkey % 4 WHEN 0 THEN 'Amazon' ELSE 'Maker ' || p_type END || ' Store</a>'",
        "'<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"BreadcrumbList\",\"itemListElement\":[{\"name\":\"Home\"},"
        "{\"name\":\"' || p_name || '\"}]},{\"@type\":\"Product\",\"name\":\"' || " + name + " || '\",\"brand\":{\"name\":\"Maker ' || "
        "replace(p_brand, 'Brand#', '') || '\"},\"image\":[\"https://img.example.com/p' || CAST(p_partkey AS STRING) || '.jpg\"],"
        "\"description\":\"For daily  use\",\"ingredients\":\"Ingredients: ' || " + _LIST + " || '\",\"sku\":\"SKU-' || CAST(p_partkey AS STRING) || 'X\"}]}</script>'",
        "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"product\":{\"name\":\"' || " + name + " || '\",\"brand\":\"Maker ' || "
        "p_type || '\",\"sku\":\"N' || CAST(p_partkey AS STRING) || '\",\"full_ingredients\":[\"Water\",{\"name\":\"' || p_name || '\"},\"Glycerin\"],"
        "\"details\":[{\"name\":\"Full Ingredients\",\"value\":\"' || " + _LIST + " || '\"}],"
        "\"description\":\"<p>Soft. Ingredients: ' || " + _LIST + " || ' Directions: rinse</p>\"}}}}</script>'",
        "'<div itemscope itemtype=\"http://schema.org/Product\"><span itemprop=\"ingredients\" content=\"' || " + _LIST + " || '\">x</span></div>'",
        "'<section><h2>Ingredients</h2><p>' || " + _LIST + " || '</p></section>'",
        "'<div class=\"ingredient-list\"><ul><li>Water</li><li>' || p_name || '</li><li>Sodium oil</li><li>Glycerin</li></ul></div>'",
        "'<table><tr><th>No</th><th>Ingredient</th></tr><tr><td>1</td><td>Water extract</td></tr><tr><td>2</td><td>' || p_name || "
        "' oil</td></tr><tr><td>3</td><td>Sodium ' || lower(p_type) || '</td></tr></table>'",
        "'<p>Read <a href=\"//duckduckgo.com/l/?uddg=https%3A%2F%2Fshop.example.com%2Fproducts%2F' || replace(p_name, ' ', '-') || "
        "'&rut=1\">buy</a> or <a class=\"x\" href=\"https://m.example.com/shop/' || replace(p_name, ' ', '-') || '?item=' || CAST(p_size AS STRING) || '\">item page</a></p>'",
        "'<p><a href=\"/products/' || replace(p_name, ' ', '-') || '\">see <b>item</b></a></p>'",
    ]
    return " || ".join(parts)


# ------------------------------------------------------------------ Spark side
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "part": ["p_partkey"], "conversations": ["conv_id", "turn"]}


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts on its way to pattern-heavy work."""
    return spread(table(spark, sf, name), *KEYS[name])


def raw_dim(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("k"),
        F.min_by("p_type", "p_partkey").alias("p_type"),
        F.min_by("p_size", "p_partkey").alias("p_size"),
    )
    return first.selectExpr(*dim_columns(SPARK))


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Known ingredients; one name in seven is left unknown."""
    return raw_dim(spark, sf).where("ingredient_id % 7 <> 3")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*profile_columns(SPARK))


def formula_lines(spark: SparkSession, sf: str) -> DataFrame:
    """list_id, position, raw_name: one row per ingredient line of an order (lists are short: one window does)."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("list_id"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    ranked = li.withColumn("position", place)
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("raw_name"))
    return ranked.join(names, "l_partkey").select("list_id", "position", "raw_name")


def long_formula_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Long lists: everything one supplier shipped in a year."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.year("l_shipdate").alias("y"),
        F.to_date("l_shipdate").alias("d"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    ranked = rank_in_group(li, ["l_suppkey", "y"], ["d"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], store=True)
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("raw_name"))
    return ranked.join(names, "l_partkey").select(
        (F.col("l_suppkey") * 10000 + F.col("y")).cast("bigint").alias("list_id"), "position", "raw_name"
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """profile_id, list_id: the customer of an order asks about that order's formula."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("list_id")
    )


def open_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as above; a customer without orders asks about a list that has no lines yet."""
    asked = requests(spark, sf)
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile_id"), (-F.col("c_custkey")).alias("list_id"))
    return asked.unionByName(new.join(asked.select("profile_id"), "profile_id", "left_anti"))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Products with a composed title and a noisy copy of it."""
    part = texts(spark, sf, "part")
    return part.withColumn("title", F.expr(LISTING_TITLE)).withColumn("noisy", F.expr(NOISY_TITLE))


def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every crawled page with the product markup of a part appended, that of the same number while there are so many."""
    pages, part = texts(spark, sf, "pages"), table(spark, sf, "part")
    parts = F.broadcast(part.agg(F.count(F.lit(1)).alias("parts")))  # one row
    return pages.join(parts).join(part, F.pmod("page_id", "parts") == part.p_partkey).select(
        "page_id", "url", F.concat("html", F.expr(page_blocks())).alias("html"), "p_brand", "p_name", "p_type"
    )


# ------------------------------------------------------------------ DuckDB side
DIM_RAW_SQL = (
    "SELECT " + ", ".join(dim_columns(DUCK)) + " FROM (SELECT p_name AS name, min(p_partkey) AS k, arg_min(p_type, p_partkey) AS p_type, "
    "arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY 1)"
)
DIM_SQL = f"SELECT * FROM ({DIM_RAW_SQL}) WHERE ingredient_id % 7 <> 3"
PROFILE_SQL = "SELECT " + ", ".join(profile_columns(DUCK)) + " FROM customer"
LINES_SQL = (
    "SELECT l_orderkey AS list_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 "
    "AS INT) AS position, p_name AS raw_name FROM lineitem JOIN part ON p_partkey = l_partkey"
)
LONG_LINES_SQL = (
    "SELECT CAST(l_suppkey * 10000 + year(l_shipdate) AS BIGINT) AS list_id, CAST(row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) "
    "ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_partkey) - 1 AS INT) AS position, p_name AS raw_name "
    "FROM lineitem JOIN part ON p_partkey = l_partkey"
)
REQUESTS_SQL = "SELECT o_custkey AS profile_id, o_orderkey AS list_id FROM orders"
OPEN_REQUESTS_SQL = REQUESTS_SQL + " UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
LISTINGS_SQL = (
    "SELECT *, " + NOISY_TITLE + " AS noisy FROM (SELECT *, " + LISTING_TITLE + " AS title FROM part)"
)
PAGES_SQL = f"SELECT page_id, url, html || {page_blocks()} AS html, p_brand, p_name, p_type FROM (SELECT *, page_id % (SELECT count(*) FROM part) AS part_key FROM pages) JOIN part ON p_partkey = part_key"
