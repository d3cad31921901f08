"""Links, hosts and product-to-product matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from . import standardise as S
from .ranking import first_per_key, top_per_group

ANCHOR = r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>"""
ANCHOR_WITH_TEXT = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""


# ------------------------------------------------------------------ URLs
def url_host(c: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")))
    return host


def host_key(c: Column) -> Column:
    return F.regexp_replace(url_host(c), r"\Awww\.", "")


def resolve_url(href: Column, base: Column) -> Column:
    """Link target against its page: absolute, scheme-relative, rooted or relative."""
    origin = F.regexp_extract(base, r"(?i)\A(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"(?i)\A(https?://[^/?#]+(?:/[^?#]*)?/)", 1)
    folder = F.coalesce(T.blank(folder), F.concat(origin, F.lit("/")))
    h = T.strip(href)
    return (
        F.when(h.rlike(r"(?i)\Ahttps?://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"(?i)\A(https?:)", 1), h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when(h.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:|\A#|\A\z"), F.lit(""))
        .otherwise(F.concat(folder, h))
    )


def outlinks(pages: DataFrame) -> DataFrame:
    """page_id, pos, url: absolute links in order, redirect targets decoded, each once."""
    df = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "href"))
    target = F.regexp_extract("href", "(?i)uddg=([^&]+)", 1)
    url = F.when(target != "", T.percent_decode(target)).when(F.startswith("href", F.lit("http")), F.col("href")).otherwise("")
    df = df.select("page_id", "pos", url.alias("url")).where(F.col("url").rlike(r"(?i)\Ahttps?://"))
    return df.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def site_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, text: product-like links that stay on the page's host."""
    found = F.transform(
        F.arrays_zip(
            F.regexp_extract_all("html", F.lit(ANCHOR_WITH_TEXT), F.lit(1)).alias("href"),
            F.regexp_extract_all("html", F.lit(ANCHOR_WITH_TEXT), F.lit(2)).alias("inner"),
        ),
        lambda z: z,
    )
    df = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "a"))
    df = df.select(
        "page_id",
        "page_url",
        "pos",
        resolve_url(F.col("a.href"), F.col("page_url")).alias("url"),
        T.ws(F.regexp_replace("a.inner", "<[^>]+>", "")).alias("text"),
    )
    own, host = host_key(F.col("page_url")), host_key(F.col("url"))
    same = (host == own) | F.endswith(host, F.concat(F.lit("."), own))
    like = F.lower(F.concat_ws(" ", "url", "text")).rlike("product|shop|pdp|item|ingredient|inci|composition")
    return df.where((F.col("url") != "") & same & like).drop("page_url")


def related_hosts(a: Column, b: Column) -> Column:
    x, y = host_key(a), host_key(b)
    return (x != "") & (y != "") & ((x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x)))


def classify_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Host key and label with the block-list verdicts of a URL."""
    df = df.withColumns({"_h": url_host(F.col(url)), "host_key": host_key(F.col(url))})
    host, low = F.col("_h"), F.lower(url)
    path = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")))
    query = F.coalesce(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit("q")))
    return df.withColumns(
        {
            "host_label": F.coalesce(T.blank(F.col("host_key")), F.lit("Generic Website")),
            "search_engine": T.any_of(host, K.SEARCH_ENGINE_HOSTS) & (F.startswith(path, F.lit("/search")) | path.isin("/", "") | query.isNotNull()),
            "may_be_official": (host != "") & ~T.any_of(F.col("host_key"), K.NON_OFFICIAL_HOSTS),
            "may_be_retail": ~T.any_of(low, K.NON_RETAIL_HOSTS),
            "may_be_result": ~T.any_of(F.col(url), K.BLOCKED_RESULT_HOSTS),
            "marketplace": host.rlike("(?i)" + K.MARKETPLACE_HOST),
        }
    ).drop("_h")


# ------------------------------------------------------------------ official sites
def host_brand_percent(host: Column, brand: Column) -> Column:
    """How well a host name spells a brand, in hundredths."""
    stem = T.brand_compact(F.regexp_replace(F.regexp_replace(host, r"\Awww\.", ""), r"\.[^.]*\z|\A[^.]*\z", ""))
    name = T.brand_compact(brand)
    tokens = F.filter(F.split(T.brand_key(brand), " "), lambda t: t != "")
    share = F.size(F.filter(tokens, lambda t: stem.contains(t))) * 100 / F.size(tokens)
    return (
        F.when((stem == "") | (name == ""), 0.0)
        .when(stem == name, 100.0)
        .when(stem.contains(name) | name.contains(stem), 82.0)
        .otherwise(share)
    )


def brand_mentioned(text: Column, brand: Column) -> Column:
    t, b = T.brand_key(text), T.brand_key(brand)
    tokens = F.filter(F.split(b, " "), lambda x: F.length(x) > 2)
    return (b != "") & (t.contains(b) | ((F.size(tokens) > 0) & F.forall(tokens, lambda x: t.contains(x))))


def official_domain(hits: DataFrame) -> DataFrame:
    """First search hit of each brand whose host or text speaks for it.

    hits: brand, ord, url, html.
    """
    df = hits.withColumns({"host": host_key(F.col("url")), "_b": T.brand_key(F.col("brand"))}).where("_b <> ''")
    df = df.where((F.col("host") != "") & ~T.any_of(F.col("host"), K.NON_OFFICIAL_HOSTS))
    df = df.withColumns({"score": host_brand_percent(F.col("host"), F.col("brand")), "mentioned": brand_mentioned(T.plain_text(F.col("html")), F.col("brand"))})
    df = df.where((F.col("score") >= 45) | F.col("mentioned"))
    base = F.when(F.col("score") > 0, F.col("score")).when(F.col("mentioned"), 72).otherwise(0)
    conf = F.greatest(F.lit(68.0), F.least(F.lit(96.0), base)) / 100
    return df.groupBy("brand").agg(F.min(F.struct("ord", F.col("host").alias("official_domain"), conf.alias("confidence"))).alias("m")).select(
        "brand", "m.official_domain", "m.confidence"
    )


# ------------------------------------------------------------------ product matching
def _drop_words(c: Column, words: Column) -> Column:
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    quoted = F.regexp_replace(words, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.when(words != "", F.regexp_replace(c, F.concat(F.lit("(?i)" + edge), quoted, F.lit(edge)), F.lit(" "))).otherwise(c)


def product_profile(df: DataFrame, side: str) -> DataFrame:
    """Comparable view of a product: {side}_name, _brand, _category, _description, _url in, x_{side}_* out."""
    c = lambda f: T.text(F.col(f"{side}_{f}"))
    x = f"x_{side}_"
    df = df.withColumn(x + "text", T.join_words(c("name"), c("description"), c("url")))
    hint = F.coalesce(T.blank(c("brand")), F.col(x + "text"))
    df = df.withColumns(
        {
            x + "brand": F.coalesce(T.blank(T.detect_brand(hint)), T.ws(hint)),
            x + "type": T.product_type_of(F.coalesce(T.blank(c("category")), c("name")), F.col(x + "text")),
            x + "low": F.lower(T.match_text(F.col(x + "text"))),
        }
    )
    df = S._identity(df, F.col(x + "text"), F.col(x + "brand"), F.col(x + "type"), x + "i_")
    variant = T.match_text(F.col(x + "i_variant"))
    variant = T.ws(_drop_words(_drop_words(variant, F.col(x + "brand")), F.col(x + "type")))
    return df.withColumns(
        {
            x + "variant": F.when(F.col(x + "i_variant") == "", "").otherwise(variant),
            x + "actives": T.tags_of(F.col(x + "low"), K.ACTIVE_RULES),
            x + "concerns": T.tags_of(F.col(x + "low"), K.CONCERN_RULES),
        }
    ).drop(x + "text", x + "low", x + "i_size", x + "i_variant", x + "i_core_name")


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, zero below the floor."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    s = F.lit(1.0) - F.levenshtein(x, y) / longest
    return F.when((a == "") | (b == ""), 0.0).when(x == y, 1.0).when(s < K.SIMILARITY_FLOOR, 0.0).otherwise(s)


def list_similarity(expected: Column, actual: Column) -> Column:
    best = F.transform(
        expected,
        lambda e: F.when(F.array_contains(actual, e), 1.0).otherwise(
            F.coalesce(F.array_max(F.transform(actual, lambda a: similarity(e, a))), F.lit(0.0))
        ),
    )
    total = F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(expected) > 0, total / F.size(expected))


def match_products(pairs: DataFrame) -> DataFrame:
    """Score of given pairs (l_* expected, r_* candidate): final score, decision and parts."""
    df = product_profile(product_profile(pairs, "l"), "r")
    sims = {
        "brand": F.when(F.col("x_l_brand") != "", similarity(F.col("x_l_brand"), F.col("x_r_brand"))),
        "type": F.when(F.col("x_l_type") != "", similarity(F.col("x_l_type"), F.col("x_r_type"))),
        "actives": list_similarity(F.col("x_l_actives"), F.col("x_r_actives")),
        "concerns": list_similarity(F.col("x_l_concerns"), F.col("x_r_concerns")),
        "variant": F.when(F.col("x_l_variant") != "", similarity(F.col("x_l_variant"), F.col("x_r_variant"))),
    }
    df = df.withColumns({f"m_{k}": v for k, v in sims.items()})
    weight, points = F.lit(0), F.lit(0.0)
    for k, w in K.MATCH_WEIGHTS.items():
        weight = weight + F.when(F.col(f"m_{k}").isNotNull(), w).otherwise(0)
        points = points + F.coalesce(T.two_decimals(F.col(f"m_{k}") * w), F.lit(0.0))
    df = df.withColumns({"_w": weight, "_p": points})
    final = F.when(F.col("_w") > 0, T.half_up(F.col("_p") / F.col("_w") * 100)).otherwise(0).cast("bigint")
    df = df.withColumn("final_score", final)
    percents = {f"{k}_percent": T.half_up(F.col(f"m_{k}") * 100).cast("bigint") for k in K.MATCH_WEIGHTS}
    df = df.withColumns(
        {**percents, "accepted": F.col("final_score") >= K.MATCH_ACCEPT, "review": F.col("final_score").between(K.MATCH_REVIEW, K.MATCH_ACCEPT - 1)}
    )
    drop = [c for c in df.columns if c.startswith(("x_l_", "x_r_", "m_"))]
    return df.drop("_w", "_p", *drop)


# ------------------------------------------------------------------ ranking of links
LINK_BONUS = {
    "official": [(r"/products?/", "url", 12), (r"ingredient|inci|composition", "both", 8), (r"search|collection|collections|tagged|category", "url", -14)],
    "distributor": [
        (r"ingredient|inci|composition|product|pdp|item|buy|shop", "both", 14), (r"search|collection|collections|catalog|tagged|category", "url", -14),
    ],
    "web": [
        (r"ingredients|inci|composition", "both", 12), (r"product|products|pdp|item", "url", 8), (r"search|collection|collections|tagged|category|catalog", "url", -12),
    ],
}


def rank_links(links: DataFrame, kinds: list[str], k: int, group: str = "page_id") -> DataFrame:
    """Top k distinct links of each group and search kind by match score and path bonuses.

    links: group, pos, url, text, final_score.  The match score is worked out
    once and shared by the kinds.
    """
    both = F.concat_ws(" ", "url", "text")

    def ranked(kind):
        score = F.col("final_score")
        for pattern, where, points in LINK_BONUS[kind]:
            score = score + F.when((both if where == "both" else F.col("url")).rlike("(?i)" + pattern), points).otherwise(0)
        return F.struct(F.lit(kind).alias("kind"), F.greatest(F.lit(0), score).cast("bigint").alias("rank_score"))

    df = links.withColumn("_r", F.explode(F.array(*[ranked(kind) for kind in kinds]))).select("*", "_r.kind", "_r.rank_score").drop("_r")
    order = [F.col("rank_score").desc(), F.col("pos")]
    return top_per_group(first_per_key(df, [group, "kind", "url"], order), [group, "kind"], order, k)


def cap_hits(hits: DataFrame, per_domain: int, total: int, group: str = "request_id") -> DataFrame:
    """First `per_domain` distinct URLs of each domain, then the first `total` of the request.

    hits: group, ord, domain, url.  The caps are the report's own sizes.
    """
    own = hits.where(F.col("url").contains(F.col("domain")))
    distinct = own.groupBy(group, "domain", "url").agg(F.min("ord").alias("ord"))
    capped = top_per_group(distinct, [group, "domain"], [F.col("ord")], per_domain, "domain_rank")
    return top_per_group(capped, [group], [F.col("ord")], total, "rank")


def direct_urls(products: DataFrame, key: str) -> DataFrame:
    """Product addresses of the ingredient database that uses readable slugs."""
    name = F.coalesce(T.blank(F.col("canonical_name")), T.text(F.col("name")))
    compact = T.ws(T.sub_all(name, K.DIRECT_URL_DROP))

    def slug(c):
        x = T.sub_all(F.lower(c), r"\bfacewash\b", "face wash")
        x = F.replace(x, F.lit("&"), F.lit(" and "))
        return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")

    brand = T.text(F.col("brand"))
    forms = [compact, T.sub_first(compact, r"\bcleansing face wash\b", "face wash"), name]
    slugs = F.array_distinct(F.filter(F.array(*[slug(F.concat(brand, F.lit(" "), f)) for f in forms]), lambda s: s != ""))
    host = K.TRUSTED_DATABASES[0][1]
    return products.select(key, F.posexplode(slugs).alias("ord", "slug")).select(
        key, "ord", F.concat(F.lit(f"https://{host}/products/"), F.col("slug")).alias("url")
    )
