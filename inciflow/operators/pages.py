"""Crawled pages to product facts and candidate lists (regular expressions and VARIANT, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .ranking import first_per_key, rank_in_group

SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
LD_SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
BYLINES = [
    r"""(?is)<(?:a|span)[^>]+id=["']bylineInfo["'][^>]*>(.{1,180}?)</(?:a|span)>""",
    r"""(?is)<(?:a|span)[^>]+class=["'][^"']*(?:brand|manufacturer)[^"']*["'][^>]*>(.{1,180}?)</(?:a|span)>""",
    r"""(?is)data-brand-name=["']([^"']{1,120})["']""",
]
MICRODATA_SCOPE = r"""(?is)<[^>]+itemscope[^>]+itemtype=["'][^"']*Product[^"']*["'][^>]*>(.*?)</[^>]+>"""
MICRODATA = [
    r"""(?i)itemprop=["']ingredients?["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)itemprop=["']ingredients?["'][^>]*>([^<]{20,2000})</[^>]+>""",
    r"""(?i)itemprop=["']material["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)itemprop=["']material["'][^>]*>([^<]{20,2000})</[^>]+>""",
]
NAMED_BLOCKS = [
    ("__NEXT_DATA__", r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""),
    ("__INITIAL_STATE__", r"""(?is)__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?"""),
    ("__NUXT__", r"""(?is)window\.__NUXT__\s*=\s*(.*?)</script>"""),
    ("__NUXT_DATA__", r"""(?is)<script[^>]+id=["']__NUXT_DATA__["'][^>]*>(.*?)</script>"""),
    ("__PRELOADED_STATE__", r"""(?is)__PRELOADED_STATE__\s*=\s*(.*?)(?:</script>|;)"""),
]


def page_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_text", T.visible_text(F.col("html")))


# ------------------------------------------------------------------ meta
def meta_tags(pages: DataFrame) -> DataFrame:
    """page_id, pos, rank, key, value: property before name, key before content."""
    tag = F.col("tag")
    df = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<meta[^>]*>"), F.lit(0))).alias("pos", "tag"))
    forms = []
    for rank, (attr, order) in enumerate([("property", 1), ("property", 2), ("name", 1), ("name", 2)]):
        keyed = rf"""{attr}=["']([^"']+)["']"""
        if order == 1:
            pattern, k, v = rf"""(?i)<meta[^>]+{keyed}[^>]+content=["']([^"']+)["']""", 1, 2
        else:
            pattern, k, v = rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+{keyed}""", 2, 1
        key = F.regexp_extract(tag, pattern, k)
        forms.append(
            F.when(key != "", F.struct(F.lit(rank).alias("rank"), F.lower(key).alias("key"), T.decode_entities(F.regexp_extract(tag, pattern, v)).alias("value")))
        )
    return df.select("page_id", "pos", F.explode(F.array_compact(F.array(*forms))).alias("m")).select("page_id", "pos", "m.rank", "m.key", "m.value")


def meta_values(pages: DataFrame) -> DataFrame:
    """One value per page and key, by form then by place on the page."""
    return meta_tags(pages).groupBy("page_id", "key").agg(F.min_by("value", F.struct("rank", "pos")).alias("value"))


# ------------------------------------------------------------------ titles and brands
def choose_title(df: DataFrame, out: str = "chosen_title") -> DataFrame:
    """Best of the title columns json_ld, structured, heading, title, breadcrumb, fallback.

    A page has six titles at most, so agreement is counted inside the row.
    """
    entries = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), T.clean_title(T.text(F.col(c))).alias("v")) for i, (c, w) in enumerate(K.TITLE_SOURCE_WEIGHTS)]
    )
    df = df.withColumn("_e", entries).withColumn("_e", F.filter("_e", lambda e: e["v"] != ""))
    low = lambda e: F.lower(e["v"])

    def agreement(e):
        return F.size(
            F.filter("_e", lambda o: (o["i"] != e["i"]) & (low(o).contains(low(e)) | low(e).contains(low(o))))
        )

    ranked = F.transform(
        "_e", lambda e: F.struct((e["w"] * 10 + agreement(e) * 120 + F.least(F.length(e["v"]), F.lit(90))).alias("s"), (-e["i"]).alias("o"), e["v"].alias("v"))
    )
    return df.withColumn(out, T.text(F.array_max(ranked)["v"])).drop("_e")


def clean_retail_brand(c: Column) -> Column:
    x = T.visible_text(T.text(c))
    x = T.sub_all(x, r"^(?:visit|shop)\s+(?:the\s+)?", "")
    x = T.sub_all(x, r"^(?:brand|manufacturer)\s*[:\-]\s*", "")
    x = T.strip(T.sub_all(x, r"\s+(?:official\s+)?store$", ""))
    return F.when(F.lower(x).isin(K.MARKETPLACE_BRANDS), F.lit("")).otherwise(x)


def retail_brand(html: Column) -> Column:
    return F.coalesce(*[T.blank(clean_retail_brand(F.regexp_extract(html, p, 1))) for p in BYLINES], F.lit(""))


def choose_brand(df: DataFrame, sources: list[str], fallback: list[str], out: str = "brand") -> DataFrame:
    """First source column that cleans to a brand, else brand detection over texts."""
    found = [T.blank(clean_retail_brand(F.col(c))) for c in sources]
    return df.withColumn(out, F.coalesce(*found, T.detect_brand(*[F.col(c) for c in fallback])))


# ------------------------------------------------------------------ JSON-LD
def _nodes(v: Column, depth: Column) -> Column:
    """Arrays and @graph unrolled, `depth` times at most: the document's number of brackets bounds its nesting."""

    def unrolled(nodes: Column, _: Column) -> Column:
        out = F.flatten(F.transform(nodes, lambda n: F.coalesce(F.try_variant_get(n, "$", "array<variant>"), F.array(n))))
        return F.flatten(F.transform(out, lambda n: F.coalesce(F.try_variant_get(n, "$['@graph']", "array<variant>"), F.array(n))))

    def step(nodes: Column, i: Column) -> Column:
        more = F.exists(nodes, lambda n: F.coalesce(F.try_variant_get(n, "$", "array<variant>"), F.try_variant_get(n, "$['@graph']", "array<variant>")).isNotNull())
        return F.when(more, unrolled(nodes, i)).otherwise(nodes)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), depth)), F.array(v), step)


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    df = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LD_SCRIPT), F.lit(1))).alias("script", "body"))
    brackets = F.char_length("body") - F.char_length(F.replace("body", F.lit("["), F.lit("")))
    df = df.select("page_id", "script", brackets.alias("depth"), F.try_parse_json("body").alias("v")).where("v IS NOT NULL")
    return df.select("page_id", "script", F.posexplode(_nodes(F.col("v"), F.col("depth"))).alias("node", "n"))


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("n"), f"$.{name}", "string")


def _plain(name: str) -> Column:
    value = _field(name)
    return F.when(~value.rlike(r"\A[\[{]"), value)


def jsonld_products(pages: DataFrame) -> DataFrame:
    """First product node of every page."""
    kind = F.try_variant_get(F.col("n"), "$['@type']", "string")
    rows = jsonld_nodes(pages).where(kind.rlike("(?i)product")).select(
        "page_id",
        F.struct("script", "node").alias("o"),
        T.text(_field("name")).alias("raw_name"),
        F.coalesce(F.try_variant_get(F.col("n"), "$.brand.name", "string"), _plain("brand"), F.lit("")).alias("brand"),
        F.coalesce(F.try_variant_get(F.col("n"), "$.image[0]", "string"), _plain("image"), F.lit("")).alias("image"),
        T.ws(T.text(_field("description"))).alias("description"),
        T.label_list(F.coalesce(T.blank(_field("ingredients")), _field("material"), F.lit(""))).alias("ingredients"),
        T.sku_of(_field("sku"), _field("mpn"), _field("productID")).alias("sku"),
    )
    first = rows.groupBy("page_id").agg(F.min(F.struct("o", "raw_name", "brand", "image", "description", "ingredients", "sku")).alias("p"))
    return first.select("page_id", "p.raw_name", "p.brand", "p.image", "p.description", "p.ingredients", "p.sku").withColumn(
        "name", T.clean_title(F.col("raw_name"))
    )


def breadcrumb_names(pages: DataFrame) -> DataFrame:
    """Last crumb of the first breadcrumb list."""
    kind = F.try_variant_get(F.col("n"), "$['@type']", "string")
    items = F.try_variant_get(F.col("n"), "$.itemListElement", "array<variant>")
    rows = jsonld_nodes(pages).where(kind.rlike("(?i)breadcrumb")).withColumn("last", F.try_element_at(items, F.lit(-1)))
    name = F.coalesce(F.try_variant_get("last", "$.name", "string"), F.try_variant_get("last", "$.item.name", "string"), F.lit(""))
    rows = rows.select("page_id", F.struct("script", "node").alias("o"), T.clean_title(name).alias("breadcrumb")).where("breadcrumb <> ''")
    return rows.groupBy("page_id").agg(F.min_by("breadcrumb", "o").alias("breadcrumb"))


# ------------------------------------------------------------------ embedded state
def markup_to_text(c: Column) -> Column:
    x = T.sub_all(c, r"<br\s*/?>", ", ")
    x = T.sub_all(x, r"</(?:p|li|div|dd|tr)>", ", ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    return T.decode_entities(x)


def state_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_ord, block, body: the named state blocks, then every script."""
    named = [
        F.when(F.regexp_extract("html", p, 1) != "", F.struct(F.lit(name).alias("block"), F.trim(F.regexp_replace(markup_to_text(F.regexp_extract("html", p, 1)), r";\s*\z", "")).alias("body")))
        for name, p in NAMED_BLOCKS
    ]
    scripts = F.transform(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1)), lambda s: F.struct(F.lit("embedded-json").alias("block"), s.alias("body")))
    blocks = F.concat(F.array_compact(F.array(*named)), scripts)
    return pages.select("page_id", F.posexplode(blocks).alias("block_ord", "b")).select("page_id", "block_ord", "b.block", "b.body").where(
        F.ltrim(F.col("body")).rlike(r"\A[\[{]")
    )


def json_ingredient_values(paths: DataFrame) -> DataFrame:
    """Ingredient texts among flattened JSON paths (see markup.json_paths)."""
    df = paths.withColumn("value", F.array_join(F.filter(F.transform("items", markup_to_text), lambda v: v != ""), ", "))
    df = df.withColumn("text", F.when(F.col("scalar"), F.col("value")).otherwise(F.lit("")))
    cols = ["page_id", "block_ord", "block", "ord", "path", "value"]
    keyed = df.where(T.has(F.col("key"), K.JSON_INGREDIENT_KEY) & ~T.has(F.col("key"), K.JSON_PARTIAL_KEY) & (F.length("value") >= 12)).select(
        *cols, F.lit(0).alias("way")
    )
    # A name/value pair: the label row finds the first value-like key below its parent.
    labels = df.where(T.has(F.col("key"), K.JSON_NAME_KEY) & T.has(F.col("text"), K.JSON_NAME_VALUE)).where("parent <> ''").select(
        "page_id", "block_ord", "parent", F.col("ord").alias("label_ord")
    )
    values = df.where(T.has(F.col("key"), K.JSON_VALUE_KEY)).withColumn("up", F.explode("ancestors"))
    pairs = (
        labels.join(values.withColumnRenamed("parent", "own_parent").withColumnRenamed("up", "parent"), ["page_id", "block_ord", "parent"])
        .groupBy("page_id", "block_ord", "block", "parent", "label_ord")
        .agg(F.min(F.struct("ord", "path", "value")).alias("v"))
        .where(F.length("v.value") >= 12)
        .select("page_id", "block_ord", "block", F.col("label_ord").alias("ord"), "v.path", "v.value", F.lit(1).alias("way"))
    )
    body = F.regexp_extract("text", r"(?is)" + T.java(K.JSON_TEXT_HEAD, False) + r"(.{20,4000}?)(?=" + T.java(K.JSON_TEXT_STOP, False) + r"|\z)", 1)
    inside = df.where(T.has(F.col("key"), K.JSON_TEXT_KEY)).withColumn("value", T.ws(body)).where("value <> ''").select(*cols, F.lit(2).alias("way"))
    hits = keyed.unionByName(pairs).unionByName(inside)
    return first_per_key(hits, ["page_id", "block", "path", "value"], [F.col("block_ord"), F.col("ord"), F.col("way")])


PRODUCT_PATHS = {
    "name": [r"name$", r"product\.name$", r"pageProps\.product\.name$"],
    "brand": [r"brand$", r"product\.brand$", r"pageProps\.product\.brand$"],
    "description": [r"description$"],
    "image": [r"image$", r"images\.0$"],
    "sku": [r"sku$", r"itemCode$", r"model$", r"hsn$"],
}
RELIABILITY = {"name": 40, "brand": 28, "description": 16, "image": 8, "sku": 8}


def structured_product(paths: DataFrame) -> DataFrame:
    """Best block of a page: attributes by first matching path, weighted by what is there."""
    value = F.when(F.col("scalar"), markup_to_text(F.get("items", F.lit(0)))).otherwise(T.text(markup_to_text(F.col("inner_name"))))
    df = paths.withColumn("value", T.text(value))
    aggs = []
    for field, patterns in PRODUCT_PATHS.items():
        hit = T.has(F.col("path"), "|".join(patterns)) | T.has(F.col("key"), "|".join(patterns))
        aggs.append(F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col("ord"))).alias(field))
    blocks = df.groupBy("page_id", "block_ord", "block").agg(*aggs)
    score = F.lit(0)
    for field, points in RELIABILITY.items():
        score = score + F.when(T.text(F.col(field)) != "", points).otherwise(0)
    blocks = blocks.withColumns({f: T.text(F.col(f)) for f in PRODUCT_PATHS}).withColumn("points", score).where("points > 0")
    blocks = blocks.withColumn("reliability", F.col("points") + F.when(F.col("block") != "embedded-json", 8).otherwise(0))
    return first_per_key(blocks, ["page_id"], [F.col("reliability").desc(), F.col("block_ord")]).select(
        "page_id", "block", "reliability", *PRODUCT_PATHS
    )


def microdata(pages: DataFrame) -> DataFrame:
    scope = F.regexp_extract("html", MICRODATA_SCOPE, 1)
    df = pages.withColumn("_s", scope)
    values = F.array(*[markup_to_text(F.regexp_extract("_s", p, 1)) for p in MICRODATA])
    return df.select("page_id", F.posexplode(values).alias("ord", "value")).where("value <> ''")


# ------------------------------------------------------------------ text sections
def plausible_dom(c: Column) -> Column:
    return T.bound(T.dom_text(c), plausible_dom_text)


def plausible_dom_text(x: Column) -> Column:
    """The test of what `dom_text` returned; its signals are counted where separators do not decide."""
    separators = F.regexp_count(x, F.lit("[,;|•·]"))
    signals = F.regexp_count(x, F.lit(T.java(K.SIGNAL_WORDS)))
    return (F.length(x) >= 20) & ~T.has(F.substr(x, F.lit(1), F.lit(100)), K.PARTIAL_PATTERN) & ((separators >= 2) | (signals >= 3))


def plausible_text(c: Column) -> Column:
    items = F.filter(F.transform(F.split(T.page_section(c), ","), T.strip), lambda i: i != "")

    def shaped(items: Column) -> Column:
        n = F.size(items)
        return (n >= 3) & (F.size(F.filter(items, lambda i: T.has(i, K.ITEM_SHAPE))) >= F.greatest(F.lit(3), F.floor(n * 0.75)))

    return ~T.any_of(F.lower(c), K.TEXT_MARKETING) & T.bound(items, shaped)


def text_section(df: DataFrame, text: str, out: str = "section") -> DataFrame:
    """First section pattern of a visible text whose body looks like a list."""
    body = f"({K.TEXT_SECTION_BODY}{{{K.TEXT_SECTION_MIN},{K.TEXT_SECTION_MAX}}})"
    names = []
    for i, head in enumerate(K.TEXT_SECTION_HEADS):
        df = df.withColumn(f"_b{i}", T.get(F.col(text), head + body, 1))
        names.append(f"_b{i}")
    found = [F.when((F.col(n) != "") & plausible_text(F.col(n)), T.page_section(F.col(n))) for n in names]
    return df.withColumn(out, F.coalesce(*found, F.lit(""))).drop(*names)


# ------------------------------------------------------------------ candidates
def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Inside a page and extractor family, the first candidate of each text key stays."""
    df = candidates.withColumn("_key", T.dom_key(F.col("raw_text"))).where("_key <> ''")
    return first_per_key(df, ["page_id", "family", "_key"], [F.col("ord")]).drop("_key")


def candidate_score(label: Column, count: Column, raw: Column, method: Column) -> Column:
    """Ten times the ranking score, so that it stays whole."""
    low = F.lower(T.text(label))

    def pts(cond, value):
        return F.when(cond, value * 10).otherwise(0)

    return (
        F.least(count, F.lit(60)) * 15
        + pts(T.has(low, K.FULL_LABEL), 55)
        + pts(T.has(low, K.ANY_LABEL), 18)
        - pts(T.has(low, K.PARTIAL_LABEL), 80)
        - pts(count < K.MIN_LIST_SIZE, 45)
        + pts(method == "dom-table", 18)
        + pts(method == "dom-container", 10)
        - pts(T.has(T.text(raw), K.TRUNCATED), 35)
    ).cast("int")


def rank_candidates(candidates: DataFrame, group: str = "page_id") -> DataFrame:
    """Rank 0 is the best candidate; equal scores keep their order."""
    df = candidates.withColumn(
        "_neg", -candidate_score(F.col("label"), F.col("ingredient_count"), F.col("raw_text"), F.col("method"))
    )
    return rank_in_group(df, [group], ["_neg"], [F.col("ord")], "rank").withColumn("score_tenths", -F.col("_neg")).drop("_neg")


def apply_selection(candidates: DataFrame, selections: DataFrame, group: str = "page_id") -> DataFrame:
    """Selected indexes first, in the order given; the rest keep their order.

    candidates: group, idx; selections: group, sel_pos, idx.  Indexes that do not
    exist drop out in the join, repeated ones keep their first place.
    """
    picked = selections.groupBy(group, "idx").agg(F.min("sel_pos").alias("sel_pos"))
    df = candidates.join(picked, [group, "idx"], "left").withColumn("_unpicked", F.col("sel_pos").isNull().cast("int"))
    df = df.withColumn("_place", F.coalesce("sel_pos", "idx"))
    return rank_in_group(df, [group], ["_unpicked", "_place"], [F.col("idx")], "new_pos").drop("_unpicked", "_place", "sel_pos")


# ------------------------------------------------------------------ page types
def classify_pages(pages: DataFrame) -> DataFrame:
    """javascript_driven, listing_page and anti_bot flags."""
    html, url = F.col("html"), F.lower("url")
    low = F.lower(html)
    signals = html.rlike(r"(?i)ingredients?|inci|composition|product details|description")
    product = html.rlike(r"(?i)og:title|twitter:title|<title|application/ld\+json|__next_data__|__initial_state__")
    bundle = html.rlike(r"""(?i)<script[^>]+src=["'][^"']+(?:webpack|runtime|bundle|main)[^"']+["']""")
    driven = (
        low.contains("enable javascript")
        | low.contains("captcha")
        | ((F.length(html) < 1200) & bundle)
        | (~signals & ~product & (F.length(html) < 2200))
    )
    title = F.lower(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    listing = T.any_of(url, K.LISTING_URL_MARKERS) | T.any_of(title, K.LISTING_TITLE_MARKERS)
    sample = F.concat_ws("\n", title, F.substr(F.col("_text"), F.lit(1), F.lit(4000)))
    df = pages.withColumn("_text", T.visible_text(html))
    return df.withColumns({"javascript_driven": driven, "listing_page": listing, "anti_bot": T.has(sample, K.ANTI_BOT_PATTERN)}).drop("_text")


# ------------------------------------------------------------------ grounding
def grounded_terms(df: DataFrame, text: str, terms: str) -> DataFrame:
    """Terms of a row that occur in its text as whole words; kept when well supported."""
    df = df.withColumn("_t", F.concat(F.lit(" "), T.evidence_key(F.col(text)), F.lit(" ")))
    df = df.withColumn("_k", F.transform(terms, T.evidence_key))
    ok = F.filter(F.arrays_zip(F.col(terms).alias("term"), F.col("_k").alias("key")), lambda z: (F.length(z["key"]) >= 3) & F.col("_t").contains(F.concat(F.lit(" "), z["key"], F.lit(" "))))
    df = df.withColumn("supported", F.transform(ok, lambda z: z["term"])).drop("_t", "_k")
    n, hits = F.size(terms), F.size("supported")
    return df.withColumn("support_rate", hits / F.greatest(n, F.lit(1))).withColumn(
        "kept", (hits >= F.least(F.lit(8), n)) & (hits * 100 >= F.greatest(n, F.lit(1)) * 85)
    )


def supported_terms(df: DataFrame, terms: str, tokens: str, out: str = "supported") -> DataFrame:
    """Terms equal to, containing, contained in or within a quarter of edits of a token.

    Both arrays belong to one label, so the test runs inside the row and no pair
    of terms and tokens is ever shuffled.
    """
    df = df.withColumn("_src", F.filter(F.transform(tokens, T.ocr_key), lambda t: t != ""))
    near = lambda k, t: (
        k.contains(t)
        | t.contains(k)
        | (F.levenshtein(k, t) <= F.greatest(F.lit(1), F.floor(F.greatest(F.length(k), F.length(t)) * 0.25)))
    )
    kept = F.filter(
        F.filter(F.transform(terms, T.strip), lambda x: x != ""),
        lambda x: (T.ocr_key(x) != "") & F.exists("_src", lambda t: near(T.ocr_key(x), t)),
    )
    return df.withColumn(out, kept).drop("_src")


def score_label_text(df: DataFrame, text: str) -> DataFrame:
    """score, token_count and is_ingredient_text of a label text."""
    df = df.withColumn("_x", T.ws(F.col(text)))
    df = df.withColumns({"_low": F.lower("_x"), "token_count": F.size(T.split_label(F.col("_x"))), "_commas": F.regexp_count("_x", F.lit(","))})
    words = [F.when(F.col("_low").contains(w), 1).otherwise(0) for w in K.LABEL_KEYWORDS]
    words.append(F.when(T.has(F.col("_x"), K.LABEL_COLOUR_INDEX), 1).otherwise(0))
    df = df.withColumns(
        {"_hits": sum(words, F.lit(0)), "_head": T.has(F.col("_x"), K.LABEL_HEADING), "_long": (F.col("token_count") >= 8) & (F.col("_commas") >= 6)}
    )
    hits, n = F.col("_hits"), F.col("token_count")
    score = (
        hits * 10 + F.least(n, F.lit(40)) * 4 + F.least(F.col("_commas"), F.lit(30)) * 2
        + F.when(F.col("_head"), 30).otherwise(0) + F.when(F.col("_long"), 35).otherwise(0) + F.when(hits >= 3, 20).otherwise(0)
        - F.when(T.has(F.col("_x"), K.LABEL_USAGE), 12).otherwise(0)
    )
    return df.withColumns({"score": score.cast("int"), "is_ingredient_text": F.col("_head") | (hits >= 3) | F.col("_long")}).drop(
        "_x", "_low", "_commas", "_hits", "_head", "_long"
    )


def best_label_text(scored: DataFrame, group: str, order: str) -> DataFrame:
    """Best ingredient text per group: most tokens, then score, then first."""
    best = scored.where("is_ingredient_text").groupBy(group).agg(
        F.max(F.struct("token_count", "score", (-F.col(order)).alias("neg"))).alias("b")
    )
    return best.select(group, (-F.col("b.neg")).alias(order), "b.token_count", "b.score")
