"""Example cases with known outcomes."""

import pytest
from pyspark.sql import functions as F

from inciflow.functions import text as T
from inciflow.operators import images as I
from inciflow.operators import knowledge as KN
from inciflow.operators import links as LK
from inciflow.operators import markup as M
from inciflow.operators import pages as P
from inciflow.operators import resolve as R
from inciflow.operators import score as S
from inciflow.operators import standardise as ST
from inciflow.operators import verify as V
from inciflow.plans.formula_queries import analyze
from inciflow.sources import seeds

PROFILE = (
    "profile_id long, skin_type string, skin_sensitivity string, concerns array<string>, goals array<string>, allergies array<string>, other_allergy string, "
    "avoid_ingredients array<string>, other_avoid string"
)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


def tokens(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    return ST.explode_ingredients(df, "t", "id")


def test_full_analysis(spark, starter):
    profiles = spark.createDataFrame(
        [
            (0, "OILY", "SLIGHTLY_SENSITIVE", ["ACNE", "PIGMENTATION"], ["OIL_CONTROL", "BRIGHTENING"], ["NONE"], None, ["NONE"], None),
            (1, "SENSITIVE", "VERY_SENSITIVE", ["REDNESS"], ["BARRIER_REPAIR"], ["FRAGRANCE"], None, ["FRAGRANCE"], None),
        ],
        PROFILE,
    )
    lines = tokens(
        spark,
        "Water, Niacinamide, Salicylic Acid, Zinc PCA, Glycerin, Panthenol, Sodium Benzoate, Citric Acid",
        "Water, Glycerin, Fragrance, Alcohol Denat, Menthol, Cocamidopropyl Betaine, Sodium Benzoate, Citric Acid",
        "Niacinamide, Panthenol, Glycerin",
    )
    asked = spark.createDataFrame([(0, 0), (1, 1), (0, 2)], "profile_id long, list_id long")
    rows = {r["list_id"]: r for r in analyze(lines, asked, starter, profiles).collect()}
    assert rows[0]["status"] == "VERIFIED_INGREDIENTS_FOUND"
    assert rows[0]["suitability_score"] >= 70 and rows[0]["overall_score"] >= 70
    assert rows[1]["suitability_score"] < 60 and rows[1]["safety_score"] < 85
    assert "fragrance" in rows[1]["weaknesses"]
    assert rows[2]["status"] == "NO_VERIFIED_INGREDIENTS" and rows[2]["rule"] == "MIN_INGREDIENT_COUNT"
    assert rows[2]["safety_score"] is None
    resolved = R.resolve_names(lines, starter).withColumn("display_name", F.col("canonical_name"))
    fit = {(r["list_id"], r["display_name"]): r["fit_label"] for r in S.scored_rows(resolved, asked, starter, profiles).collect()}
    assert fit[(0, "niacinamide")] == "Good Match"
    assert fit[(1, "fragrance")] == "Low Match"


def test_short_list_reason(spark, starter):
    counted = V.verify_lists(V.list_counters(R.resolve_names(tokens(spark, "Niacinamide, Panthenol, Glycerin"), starter)))
    row = counted.select("rule", "verified", V.reason_text().alias("reason")).first()
    assert row["rule"] == "MIN_INGREDIENT_COUNT" and not row["verified"] and "too short to trust" in row["reason"]


def test_synonyms(spark, starter):
    rows = {r["raw_name"]: r for r in R.resolve_names(tokens(spark, "Aqua, cica, Hyaluronic Acid, HA, unobtainium"), starter).collect()}
    assert rows["Aqua"]["match_type"] == "alias"
    assert rows["cica"]["match_type"] == "exact" and rows["cica"]["canonical_name"] == "centella asiatica extract"
    assert rows["Hyaluronic Acid"]["match_type"] == "synonym"
    assert rows["unobtainium"]["match_type"] == "unknown"


def test_fuzzy_never_renames(spark, starter):
    lines = tokens(spark, "Water, Niacinamidee, Glycerin")
    row = R.resolve_names(lines, starter, fuzzy=True).where("raw_name = 'Niacinamidee'").first()
    assert row["match_type"] == "fuzzy" and row["canonical_name"] == "niacinamide" and row["shown_name"] == "Niacinamidee"


def test_separators(spark):
    blend = "Water, Glycerin, Panthenol, Phenoxyethanol (and) Ethylhexylglycerin, Triethylene Glycol & Disodium EDTA, Citric Acid, Tocopherol"
    bullets = "Water • Glycerin • Niacinamide • Panthenol • Xanthan Gum • Trehalose • Menthol • Citric Acid • Petrolatum • Tocopherol."
    counts = {r["list_id"]: r["n"] for r in tokens(spark, blend, bullets, "Caprylic / Capric Triglyceride").groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 9, 1: 10, 2: 1}


def test_titles(spark):
    title = "Example Botanics Gentle Skin Cleanser | Buy Now | Free Shipping | 125ml"
    assert one(spark, title, T.clean_title) == "Example Botanics Gentle Skin Cleanser Buy Now Free Shipping"
    assert one(spark, "SKU: ABC1234", T.sku_of) == "ABC1234"
    assert one(spark, "Example Botanics Oat & Ceramide Gentle Face Wash", T.detect_brand) == "Example Botanics"


def test_name_from_url(spark):
    url = "https://shop.example.com/example-botanics-oat-gentle-face-wash-100ml/p/12020770"
    df = spark.createDataFrame([(1, url), (2, "https://x.example.com/")], "id long, url string")
    names = {r["id"]: r["product_name"] for r in ST.name_from_url(df, "url", "id").collect()}
    assert "Example Botanics" in names[1] and "Face Wash" in names[1]
    assert names[2] == "Linked Product"


def test_direct_urls(spark):
    df = spark.createDataFrame([(1, "Pears", "Pure and Gentle Daily Cleansing Facewash Mild Cleanser", "")], "id long, brand string, name string, canonical_name string")
    urls = [r["url"] for r in LK.direct_urls(df, "id").collect()]
    assert any(u.endswith("pears-pure-and-gentle-cleansing-face-wash") for u in urls)


LIST = "Water, Glycerin, Niacinamide, Panthenol, Xanthan Gum, Trehalose, Menthol, Citric Acid, Petrolatum, Tocopherol"


@pytest.mark.parametrize(
    "html,method",
    [
        (f"<h2>Ingredients</h2><p>{LIST}</p>", "dom-heading"),
        (f'<button aria-controls="x">Full Ingredients</button><div><p>a</p></div><div id="x" hidden>{LIST}</div>', "dom-heading"),
        (f'<div data-inci="{LIST}">n</div>', "dom-dataset"),
        (f'<meta name="ingredients" content="{LIST}">', "dom-meta"),
        ("<table><tr><th>Ingredient</th><th>Use</th></tr>" + "".join(f"<tr><td>{n}</td><td>x</td></tr>" for n in LIST.split(", ")) + "</table>", "dom-table"),
    ],
)
def test_dom_candidates(spark, html, method):
    df = spark.createDataFrame([(1, f"<html><body>{html}</body></html>")], "page_id long, html string")
    rows = M.dom_candidates(df).orderBy("ord").collect()
    found = [r for r in rows if r["method"] == method]
    assert found and found[0]["raw_text"] == LIST


def test_partial_heading_is_skipped(spark):
    df = spark.createDataFrame([(1, f"<h2>Key Ingredients</h2><p>{LIST}</p>")], "page_id long, html string")
    assert M.dom_candidates(df).count() == 0


def test_disclaimer_is_cut(spark):
    assert one(spark, f"Ingredients: {LIST}. Please be aware that lists change", T.dom_section).startswith(LIST)


def test_embedded_state(spark):
    html = (
        '<script id="__NEXT_DATA__">{"props":{"pageProps":{"product":{"name":"Face Wash","brand":{"name":"Maker"},"sku":"ABC1234","key_ingredients":"a, b, c, d, e, f",'
        f'"ingredients":"{LIST}"}}}}}}}}</script>'
    )
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    paths = M.json_paths(P.state_blocks(df))
    hits = P.json_ingredient_values(paths).collect()
    assert {h["path"] for h in hits} == {"props.pageProps.product.ingredients"}
    best = P.structured_product(paths).first()
    assert best["brand"] == "Maker" and best["sku"] == "ABC1234" and best["block"] == "__NEXT_DATA__"


def test_marketplace_byline(spark):
    html = '<a id="bylineInfo" href="/x">Visit the Pears Store</a>'
    df = spark.createDataFrame([("Amazon", html, "Gel")], "meta string, html string, t string").withColumn("shop", P.retail_brand(F.col("html")))
    assert P.choose_brand(df, ["shop", "meta"], ["t"]).first()["brand"] == "Pears"


def test_grounding(spark):
    df = spark.createDataFrame([("Contains Water and Glycérin.", ["water", "glycerin"]), ("nothing here", ["water", "glycerin"])], "t string, terms array<string>")
    assert [r["kept"] for r in P.grounded_terms(df, "t", "terms").collect()] == [True, False]


def test_supported_terms(spark):
    df = spark.createDataFrame([(["Glycerin", "Niacinamide", "Retinol"], ["G1ycerin", "Niacinamde"])], "a array<string>, b array<string>")
    assert P.supported_terms(df, "a", "b").first()["supported"] == ["Glycerin", "Niacinamide"]


def test_label_text(spark):
    df = spark.createDataFrame([(f"Ingredients: {LIST}",), ("Glow like never before this summer",)], "t string")
    good, bad = P.score_label_text(df, "t").collect()
    assert good["is_ingredient_text"] and good["token_count"] >= 8 and good["score"] > bad["score"] and not bad["is_ingredient_text"]


def test_images(spark):
    base = "https://shop.example.com/p"
    refs = spark.createDataFrame([(1, 0, "https://cdn.example.com/pack-back.jpg?width=160&quality=60", base)], "page_id long, ord int, raw string, base string")
    urls = [r["url"] for r in I.expand_images(refs).collect()]
    assert any("width=1600" in u and "quality=95" in u for u in urls)
    df = spark.createDataFrame(
        [(1, 0, "https://c.x/front.jpg"), (1, 1, "https://c.x/back-label.jpg"), (1, 2, "https://c.x/logo.png")], "page_id long, ord int, url string"
    ).withColumns({"alt": F.lit(""), "css": F.lit(""), "source": F.lit(""), "width": F.lit(0), "height": F.lit(0), "base": F.lit(base)})
    ranked = I.rank_images(I.filter_images(df)).orderBy("rank").collect()
    assert [r["ord"] for r in ranked] == [1, 0]


def test_official_domain(spark):
    hits = spark.createDataFrame(
        [("Example Botanics", 0, "https://www.google.com/x", ""), ("Example Botanics", 1, "https://examplebotanics.com/", "<p>hi</p>")], "brand string, ord int, url string, html string"
    )
    row = LK.official_domain(hits).first()
    assert row["official_domain"] == "examplebotanics.com" and row["confidence"] > 0.65


def test_product_match(spark):
    cols = [f"{s}_{f}" for s in "lr" for f in ("name", "brand", "category", "description", "url")]
    rows = [
        ("Salicylic Acid Face Wash", "Maker", "Face Wash", "", "", "Maker 2% Salicylic Acid Facial Cleanser", "Maker", "", "", ""),
        ("Salicylic Acid Face Wash", "Maker", "Face Wash", "", "", "Hydrating Shampoo", "Other Brand", "", "", ""),
    ]
    same, other = LK.match_products(spark.createDataFrame(rows, cols)).select("final_score", "accepted").collect()
    assert same["accepted"] and same["final_score"] >= 85
    assert not other["accepted"]


def test_seed_knowledge(spark, starter):
    row = starter.where("name = 'niacinamide'").first()
    assert "Vitamin B3" in row["aliases"] and row["evidence_level"] == "HIGH" and "Sebum Control" in row["functions"]
    assert starter.count() == 30
    assert KN.coverage_gaps(starter).where("gap <> 'references'").count() == 0
    _, products, _ = seeds.load_seed(spark)
    assert products.count() == 6


def test_fingerprint_is_stable(spark):
    cols = "name string, brand string, category string, description string, variant string, size string, sku string, canonical_name string"
    rows = [
        ("Maker Gentle Face Wash 100ml best seller", "Maker", "Face Wash", "", "", "", "", ""),
        ("Maker Gentle Face Wash 100ml | Buy Now", "Maker", "Face Wash", "", "", "", "", ""),
    ]
    out = ST.fingerprint(ST.enrich_identity(spark.createDataFrame(rows, cols))).collect()
    assert len({(r["brand"], r["category"], r["size"], r["variant"]) for r in out}) == 1
    assert out[0]["size"] == "100ml" and all(len(r["fingerprint"]) == 64 for r in out)


def test_every_request_is_answered_once(spark, starter):
    """Doubled requests count once; empty lists and unknown profiles are answered."""
    from inciflow.plans.formula_queries import analyze

    names = ["water", "glycerin", "niacinamide", "panthenol", "xanthan gum", "citric acid", "sodium benzoate", "zinc pca"]
    lines = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "list_id long, position int, raw_name string")
    requests = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (9, 1)], "profile_id long, list_id long")
    profiles = spark.createDataFrame(
        [(1, "OILY", None, ["ACNE"], None, None, None, None, None)],
        "profile_id long, skin_type string, skin_sensitivity string, concerns array<string>, goals array<string>, allergies array<string>, avoid_ingredients array<string>, other_allergy string, other_avoid string",
    )
    rows = {(r["profile_id"], r["list_id"]): r for r in analyze(lines, requests, starter, profiles).collect()}
    assert set(rows) == {(1, 1), (1, 2), (9, 1)}
    once = analyze(lines, requests.distinct(), starter, profiles).collect()
    assert {(r["profile_id"], r["list_id"]): r for r in once} == rows
    assert rows[1, 1]["status"] == rows[9, 1]["status"] == "VERIFIED_INGREDIENTS_FOUND"
    assert rows[1, 2]["status"] == "NO_VERIFIED_INGREDIENTS" and rows[1, 2]["rule"] == "MIN_INGREDIENT_COUNT" and rows[1, 2]["confidence_score"] == 0


def test_json_ld_at_any_depth(spark):
    from inciflow.operators import pages as P

    node = '{"@type": "Product", "name": "Deep"}'
    body = "[" * 7 + node + "]" * 7
    html = f'<script type="application/ld+json">{{"@graph": [{{"@graph": {body}}}]}}</script>'
    rows = P.jsonld_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).selectExpr("variant_get(n, '$.name', 'string') AS name").collect()
    assert [r["name"] for r in rows] == ["Deep"]


def test_ranks_and_cache_reads_keep_null_rows(spark):
    from inciflow.operators.ranking import rank_in_group
    from inciflow.streaming.jobs import ttl_hits

    df = spark.createDataFrame([(1, None, 5), (1, 2, 6), (None, None, 7)], "g int, c int, v int")
    assert sorted((r["v"], r["position"]) for r in rank_in_group(df, ["g"], ["c"], [F.col("v")]).collect()) == [(5, 0), (6, 1), (7, 0)]
    events = spark.sql("SELECT CAST(NULL AS BIGINT) AS key, 1L AS ord, CAST(NULL AS TIMESTAMP) AS ts, 'read' AS kind")
    assert [r["hit"] for r in ttl_hits(events).collect()] == [False]


def test_object_literals_of_page_state(spark):
    """Bare keys, single quotes and trailing commas; script code is left alone."""
    html = """<script>window.__NUXT__ = { product: { name: "Gel", 'ingredients': 'Water, Glycerin, Niacinamide, D\\'or', list: [1, 2,], gone: undefined, } };</script><script>{ run(); }</script>"""
    paths = M.json_paths(P.state_blocks(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()
    got = {r["path"]: r["items"] for r in paths}
    assert got["product.ingredients"] == ["Water, Glycerin, Niacinamide, D'or"] and got["product.name"] == ["Gel"]
