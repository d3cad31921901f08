"""Product image references: expansion, filter, best version, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .links import resolve_url, url_host
from .ranking import top_per_group

_HEAD = r"[^\"'\s)<>]+?"
EMBEDDED = [f"(?i)https?://{_HEAD}{K.IMAGE_URL_TAIL}", f"(?i)//{_HEAD}{K.IMAGE_URL_TAIL}", f"(?i)/{_HEAD}{K.IMAGE_URL_TAIL}"]


def safe_url(c: Column, base: Column) -> Column:
    x = T.strip(F.replace(c, F.lit("\\/"), F.lit("/")))
    return F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("https:"), x)).otherwise(resolve_url(x, base))


def looks_like_image(c: Column) -> Column:
    u = F.lower(c)
    return (u != "") & ~u.rlike(r"\A(?:data|blob):") & (T.has(u, K.IMAGE_EXTENSION) | u.rlike(K.IMAGE_HINT))


def high_resolution(url: Column) -> Column:
    """The URL, its copy with large size parameters, its copy without size markers."""
    grown = F.regexp_replace(url, r"([?&](?:width|height|w|h)=)[^&#]*", "$11600")
    grown = F.regexp_replace(grown, r"([?&](?:quality|q)=)[^&#]*", "$195")
    bare = F.regexp_replace(F.regexp_replace(url, "(?i)" + K.IMAGE_DIMENSION_MARKER, "."), "(?i)" + K.IMAGE_LONG_MARKER, ".")
    return F.array(url, grown, bare)


def expand_images(refs: DataFrame) -> DataFrame:
    """refs(page_id, ord, raw, base) -> page_id, ord, pos, url."""
    base = F.col("base")
    text = F.replace("raw", F.lit("\\/"), F.lit("/"))
    hits = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in EMBEDDED]))
    df = refs.withColumn("_e", F.filter(F.transform(hits, lambda u: safe_url(u, base)), looks_like_image))
    df = df.withColumn("_d", safe_url(F.col("raw"), base))
    srcset = F.transform(F.split("raw", ","), lambda e: safe_url(F.split(T.strip(e), T.SPACES + "+").getItem(0), base))
    direct = F.concat(F.array("_d"), srcset, high_resolution(F.col("_d")))
    urls = F.when(F.size("_e") > 0, F.flatten(F.transform("_e", high_resolution))).otherwise(direct)
    urls = F.array_distinct(F.filter(urls, lambda u: u != ""))
    return df.select("page_id", "ord", F.posexplode(urls).alias("pos", "url"))


def is_product_image(url: Column, alt: Column, css: Column, source: Column, width: Column, height: Column) -> Column:
    u = F.lower(url)
    words = F.lower(F.concat_ws(" ", url, alt, css, source))
    tiny = (width > 0) & (height > 0) & (width < 80) & (height < 80)
    return (
        u.rlike(r"\Ahttps?://")
        & ~words.rlike(K.IMAGE_REJECT)
        & ~u.rlike(K.IMAGE_REJECT_URL)
        & ~T.has(u, K.IMAGE_REJECT_EXT)
        & ~tiny
        & (looks_like_image(url) | words.rlike(K.IMAGE_ACCEPT))
    )


def filter_images(df: DataFrame) -> DataFrame:
    """Likely product images; on a marketplace page only its own image hosts pass.

    df: url, alt, css, source, width, height, base.
    """
    market = url_host(F.col("base")).rlike("(?i)" + K.MARKETPLACE_HOST)
    own = url_host(F.col("url")).rlike(K.MARKETPLACE_IMAGE_HOST)
    keep = is_product_image(*[F.col(c) for c in ("url", "alt", "css", "source", "width", "height")])
    return df.where(keep & (~market | own))


def resolution_of(url: Column, width: Column, height: Column) -> Column:
    found = [F.regexp_extract_all(url, F.lit(T.java(p)), F.lit(g)) for p, g in K.IMAGE_SIZE_PATTERNS]
    sizes = F.transform(F.flatten(F.array(*found)), lambda s: s.cast("int"))
    return F.greatest(F.coalesce(F.array_max(sizes), F.lit(0)), width, height)


def image_key(url: Column) -> Column:
    """Same picture in any size: host, path and query without size parts."""
    path = F.regexp_extract(url, r"\A[a-zA-Z]+://([^?#]*)", 1)
    path = F.regexp_replace(path, "(?i)" + K.IMAGE_ANY_MARKER, ".")
    path = F.regexp_replace(path, r"(?i)([_-])\d{2,5}x\d{2,5}(?=\.|_|-|\z)", "$1")
    path = F.regexp_replace(path, r"([_-])\d{2,5}(?=\.|_|-|\z)", "$1")
    params = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.filter(params, lambda p: (p != "") & ~F.split(p, "=").getItem(0).isin(K.IMAGE_DROP_PARAMS))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.lower(F.concat(path, query))


def dedupe_images(df: DataFrame, group: str = "page_id") -> DataFrame:
    """Best resolution of every picture; of equals the later one."""
    cols = [c for c in df.columns if c not in (group, "ord")]
    df = df.withColumns({"image_key": image_key(F.col("url")), "resolution": resolution_of(F.col("url"), F.col("width"), F.col("height"))})
    best = df.groupBy(group, "image_key").agg(F.max(F.struct("resolution", "ord", *cols)).alias("b"))
    return best.select(group, "image_key", "b.*")


def rank_images(df: DataFrame, k: int = K.IMAGE_MAX, group: str = "page_id") -> DataFrame:
    words = F.lower(F.concat_ws(" ", "url", "alt", "css", "source"))
    score = F.lit(0)
    for pattern, points in K.IMAGE_RANK_RULES:
        score = score + F.when(words.rlike(pattern), points).otherwise(0)
    res = resolution_of(F.col("url"), F.col("width"), F.col("height"))
    df = df.withColumn("resolution", res)
    score = score + F.least(F.lit(36), T.half_up(F.col("resolution") / 80))
    area = F.col("width").cast("bigint") * F.col("height")
    score = score + F.when(area > 0, F.least(F.lit(20), T.half_up(area / 160000))).otherwise(0)
    return top_per_group(df.withColumn("score", score.cast("bigint")), [group], [F.col("score").desc(), F.col("ord")], k)
