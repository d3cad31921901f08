"""Standardisation jobs over whole tables: lists, keys, titles, identities, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import constants as K
from ..functions import text as T

# ------------------------------------------------------------------ lists and keys


def explode_ingredients(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, position, raw_name: one row per ingredient of a list text."""
    parts = T.split_list(T.list_separators(F.col(text_col)))
    return df.select(F.col(id_col).alias("list_id"), F.posexplode(parts).alias("position", "raw_name"))


def add_key(df: DataFrame, col: str, flavour: str, out: str = "key") -> DataFrame:
    return df.withColumn(out, T.KEY_FLAVOURS[flavour](F.col(col)))


def key_collisions(df: DataFrame, col: str, flavour: str) -> DataFrame:
    """Keys that stand for several different names."""
    keyed = add_key(df.select(col).distinct(), col, flavour)
    return (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("name_count"), F.min(col).alias("first_name"), F.max(col).alias("last_name"))
        .where("name_count > 1")
    )


def trim_section(df: DataFrame, col: str, profile: str, out: str = "section") -> DataFrame:
    return df.withColumn(out, T.SECTION_PROFILES[profile](F.col(col)))


# ------------------------------------------------------------------ titles and identity
def clean_title(df: DataFrame, col: str, out: str = "clean_title") -> DataFrame:
    return df.withColumn(out, T.clean_title(F.col(col)))


def _identity(df: DataFrame, title: Column, brand: Column, category: Column, p: str) -> DataFrame:
    """Columns {p}size, {p}variant and {p}core_name.

    Every step is a column of its own: a step that is read several times is
    computed once and the generated code stays small.
    """
    return (
        df.withColumn(f"{p}t", T.ws(title))
        .withColumn(f"{p}size", T.last_size(T.clean_title(F.col(f"{p}t"))))
        .withColumn(f"{p}w", T.drop_size(T.drop_prefix(F.col(f"{p}t"), brand), F.col(f"{p}size")))
        .withColumn(f"{p}k", T.lower_keywords(F.col(f"{p}w"), category))
        .withColumn(f"{p}variant", T.variant_in(F.col(f"{p}k")))
        .withColumn(f"{p}core_name", T.core_name_in(F.col(f"{p}w"), F.col(f"{p}variant"), F.col(f"{p}t")))
        .drop(f"{p}w", f"{p}k", f"{p}t")
    )


def parse_identity(df: DataFrame, title: str, brand: str, category: str) -> DataFrame:
    """size, variant and core_name of a title."""
    out = _identity(df, F.col(title), F.col(brand), F.col(category), "_i")
    return out.withColumnsRenamed({"_isize": "size", "_ivariant": "variant", "_icore_name": "core_name"})


def enrich_identity(products: DataFrame) -> DataFrame:
    """Missing variant, size, sku and canonical name derived from title and description.

    Expects string columns name, brand, category, description, variant, size, sku, canonical_name.
    """
    given = {c: T.text(F.col(c)) for c in ("name", "brand", "description", "variant", "size", "sku", "canonical_name")}
    df = products.withColumns(given).withColumn("category", F.coalesce(T.blank(F.col("category")), F.lit(K.DEFAULT_CATEGORY)))
    df = df.withColumn("_title", T.clean_title(F.col("name")))
    brand, category = F.col("brand"), F.col("category")
    df = _identity(df, F.concat_ws(" ", "_title", "description"), brand, category, "_b")
    df = _identity(df, F.col("_title"), brand, category, "_t")
    df = df.withColumn("_canon", T.clean_title(F.coalesce(T.blank(F.col("canonical_name")), F.col("_tcore_name"))))
    return df.withColumns(
        {
            "name": F.coalesce(T.blank(F.col("_canon")), F.col("_title")),
            "canonical_name": F.col("_canon"),
            "variant": F.coalesce(T.blank(F.col("variant")), F.col("_bvariant")),
            "size": F.coalesce(T.blank(F.col("size")), F.col("_bsize")),
            "sku": F.coalesce(T.blank(F.col("sku")), T.sku_of(F.col("sku"), F.col("description"), F.col("_title"))),
        }
    ).drop("_title", "_canon", "_bsize", "_bvariant", "_bcore_name", "_tsize", "_tvariant", "_tcore_name")


def name_from_url(df: DataFrame, url: str, key: str) -> DataFrame:
    """Best path segment of every URL as a product name."""
    path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    seg = df.select(key, F.posexplode(parts).alias("pos", "raw"))
    seg = seg.withColumn("decoded", T.strip(T.percent_decode(F.col("raw"))))
    human = F.col("decoded")
    for word in ("percentage", "pct", "percent"):
        human = T.sub_all(human, rf"\b{word}\b", "%")
    seg = seg.withColumn("title", T.slug_title(human))
    d, t = F.col("decoded"), F.col("title")
    positive = (
        F.least(F.length(t), F.lit(120))
        + F.when(T.detect_brand(t) != "", 45).otherwise(0)
        + F.when(T.category_of(t) != K.DEFAULT_CATEGORY, 35).otherwise(0)
        + F.when(T.has(t, K.SEGMENT_KEYWORDS), 25).otherwise(0)
        - F.when(T.has(t, K.SEGMENT_CAMPAIGN), 80).otherwise(0)
    )
    score = (
        F.when((d == "") | F.lower(d).isin(K.NON_PRODUCT_SEGMENTS), -1000)
        .when(d.rlike(r"\A\d+\z"), -900)
        .when(d.rlike(r"\A[A-Za-z0-9]{8,14}\z") & d.rlike(r"\d") & ~d.contains("-"), -750)
        .otherwise(positive)
    )
    best = seg.withColumn("score", score).groupBy(key).agg(
        F.max(F.struct("score", (-F.col("pos")).alias("np"), "title")).alias("b")
    )
    name = F.when(F.col("b.score") >= 0, T.clean_title(F.col("b.title"))).otherwise(F.lit("Linked Product"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce(name, F.lit("Linked Product")).alias("product_name"))


def title_tokens(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("tokens", T.title_token_array(T.clean_title(F.col(title))))


def strong_overlap(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Given pairs of titles: do they share min(2, |L|, |R|) tokens?"""
    df = pairs.withColumn("_l", T.title_token_array(T.clean_title(F.col(left)))).withColumn(
        "_r", T.title_token_array(T.clean_title(F.col(right)))
    )
    shared = F.size(F.filter("_l", lambda t: F.array_contains(F.col("_r"), t)))
    need = F.least(F.lit(2), F.size("_l"), F.size("_r"))
    return df.withColumn("shared", shared).withColumn("strong", (need > 0) & (shared >= need)).drop("_l", "_r")


def tag_text(df: DataFrame, col: str, rules, out: str = "tags") -> DataFrame:
    """Canonical tags of the rules that hit a text."""
    return df.withColumn(out, T.tags_of(F.lower(F.col(col)), rules))


def identity_variants() -> Column:
    b, c, n = F.col("i_brand"), F.col("i_canonical"), F.col("i_name")
    v, s, k, u = F.col("i_variant"), F.col("i_size"), F.col("i_category"), F.col("i_sku")
    forms = [(b, c), (b, n), (b, c, v), (b, n, v), (b, c, s), (b, v, k), (b, c, k), (b, u)]
    return F.filter(F.array(*[T.join_words(*f) for f in forms]), lambda x: x != "")


def clean_identity(products: DataFrame) -> DataFrame:
    """Every identity field cleaned once, as i_* columns."""
    canonical = F.coalesce(T.blank(F.col("canonical_name")), F.col("name"))
    cols = {"i_brand": F.col("brand"), "i_canonical": canonical, "i_name": F.coalesce(T.blank(F.col("name")), canonical)}
    cols.update({f"i_{c}": F.col(c) for c in ("variant", "size", "category", "sku")})
    return products.withColumns({k: T.clean_title(T.text(v)) for k, v in cols.items()})


def expand_phrases(products: DataFrame, key: str, site: str = "", label: str = "") -> DataFrame:
    """Ordered distinct query phrases: 18 plain, 24 with a site or source label."""
    df = clean_identity(products).withColumn("_v", identity_variants())
    base = F.slice(
        F.array_distinct(F.flatten(F.transform("_v", lambda v: F.array(*[F.concat(v, F.lit(" " + s)) for s in K.QUERY_SUFFIXES])))), 1, 18
    )
    phrases = base
    if site:
        scoped = F.flatten(
            F.transform(
                "_v", lambda v: F.array(F.concat(F.lit(f"site:{site} "), v, F.lit(" ingredients")), F.concat(F.lit(f"site:{site} "), v, F.lit(" INCI")))
            )
        )
        phrases = F.concat(phrases, scoped)
    if label:
        phrases = F.concat(phrases, F.transform("_v", lambda v: F.concat(F.lit(label + " "), v)))
    if site or label:
        phrases = F.slice(F.array_distinct(phrases), 1, 24)
    return df.select(key, F.posexplode(phrases).alias("ord", "phrase"))


def fingerprint(products: DataFrame) -> DataFrame:
    """Stable product id over brand, canonical name, variant, category and size keys."""
    fields = ["brand", "canonical_name", "variant", "category", "size"]
    keyed = F.concat_ws("|", *[T.alias_key(T.text(F.col(c))) for c in fields])
    return products.withColumn("fingerprint", F.sha2(keyed, 256))


def alias_keys(products: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Ordered distinct normalised name combinations of a product."""
    df = clean_identity(products)
    b, c, n, v, s, k = (F.col(f"i_{x}") for x in ("brand", "canonical", "name", "variant", "size", "category"))
    forms = [(n,), (c,), (b, n), (b, c), (b, c, v), (b, c, s), (b, v, k), (b, n, v)]
    keys = F.array_distinct(F.filter(F.array(*[T.alias_key(T.join_words(*f)) for f in forms]), lambda x: x != ""))
    return df.select(key, F.posexplode(keys).alias("ord", "alias_key"))


# ------------------------------------------------------------------ knowledge fields
def split_purpose_col(c: Column) -> Column:
    x = F.regexp_replace(T.strip(T.text(c)), r"[\x{2013}\x{2014}\x{FFFD}\x{2022}]", "|")
    x = T.sub_all(x, r"\s*/\s*", "|")
    x = T.sub_all(x, r"\s+\|\s+", "|")
    x = T.sub_all(x, r"\s+-\s+", "|")
    return F.array_distinct(F.filter(F.transform(F.split(x, r"\|"), T.strip), lambda p: p != ""))


def norm_evidence_col(c: Column) -> Column:
    level = F.upper(T.strip(T.text(c)))
    return F.when(level.isin("HIGH", "MODERATE"), level).when(level.isin("LOW", "MIXED", "REFERENCE", "LIMITED"), "LIMITED")


def normalize_refs_col(refs: Column) -> Column:
    """array<struct<citation,title,reference,url,source,evidence_type>>: citation chain filled, empty rows dropped."""
    def tidy(r):
        def value(f):
            return T.blank(T.strip(T.text(r[f])))

        return F.struct(
            value("title").alias("title"),
            F.coalesce(value("citation"), value("title"), value("reference"), value("url")).alias("citation"),
            value("url").alias("url"),
            value("source").alias("source"),
            value("evidence_type").alias("evidence_type"),
        )

    return F.filter(F.transform(refs, tidy), lambda r: r["citation"].isNotNull() | r["url"].isNotNull())


# ------------------------------------------------------------------ profiles
_REQUIRED = {
    "skin_type": K.SKIN_TYPES, "hair_type": K.HAIR_TYPES, "scalp_type": K.SCALP_TYPES, "skin_sensitivity": K.SENSITIVITIES,
}
_LISTS = {
    "concerns": K.SKIN_CONCERNS, "hair_concerns": K.HAIR_CONCERNS, "allergies": K.ALLERGIES, "goals": K.SKIN_GOALS,
    "hair_goals": K.HAIR_GOALS, "avoid_ingredients": K.AVOID_CODES,
}
_OPTIONAL = {"hair_density": K.HAIR_DENSITIES, "makeup_usage": K.MAKEUP_USAGE, "age_group": K.AGE_GROUPS, "gender": K.GENDERS}
_DETAIL = {"allergies": "other_allergy", "avoid_ingredients": "other_avoid"}


def profile_issues() -> Column:
    """Array of `path: reason` for one profile row."""
    checks = []
    for col, allowed in _REQUIRED.items():
        checks.append(F.when(F.col(col).isNull() | ~F.col(col).isin(allowed), F.lit(f"{col}: invalid value")))
    for col, allowed in _LISTS.items():
        values = F.coalesce(F.col(col), F.array().cast("array<string>"))
        checks.append(F.when(F.size(values) < 1, F.lit(f"{col}: at least one value")))
        checks.append(F.when(F.size(F.array_except(values, T.str_array(allowed))) > 0, F.lit(f"{col}: invalid value")))
    for col, allowed in _OPTIONAL.items():
        checks.append(F.when(~F.col(col).isin(allowed), F.lit(f"{col}: invalid value")))
    for col in _DETAIL.values():
        checks.append(F.when(F.length(T.strip(F.col(col))) > K.MAX_FREE_TEXT, F.lit(f"{col}: too long")))
    for col, detail in _DETAIL.items():
        checks.append(F.when(F.array_contains(col, "NONE") & (F.size(col) > 1), F.lit(f"{col}: NONE excludes others")))
        checks.append(F.when(F.array_contains(col, "OTHER") & (T.strip(T.text(F.col(detail))) == ""), F.lit(f"{detail}: detail needed")))
    return F.array_compact(F.array(*checks))


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Profile rows with an `issues` array; valid rows have none."""
    df = profiles
    for col in _OPTIONAL:
        if col not in df.columns:
            df = df.withColumn(col, F.lit(None).cast("string"))
    df = df.withColumn("issues", profile_issues())
    return df.withColumns(
        {
            "hair_density": F.coalesce("hair_density", F.lit("MEDIUM")),
            "makeup_usage": F.coalesce("makeup_usage", F.lit("OCCASIONALLY")),
        }
    )


EXTENSION_SCHEMA = ST.StructType(
    [
        ST.StructField("allergyText", ST.StringType()),
        ST.StructField("scalpType", ST.StringType()),
        ST.StructField("haircareGoals", ST.ArrayType(ST.StringType())),
        ST.StructField("avoidIngredients", ST.ArrayType(ST.StringType())),
        ST.StructField("otherAvoidIngredient", ST.StringType()),
    ]
)


def decode_profiles(df: DataFrame, col: str = "stored_text", prefix: str = K.PROFILE_EXTENSION_PREFIX) -> DataFrame:
    """Free text or prefix + JSON -> allergy text and the extended profile fields."""
    raw = F.col(col)
    marked = F.startswith(raw, F.lit(prefix))
    body = F.substr(raw, F.lit(len(prefix) + 1))
    well_formed = F.try_parse_json(body).isNotNull()
    doc = F.from_json(body, EXTENSION_SCHEMA)
    good = F.coalesce(marked & well_formed, F.lit(False))
    empty = F.array().cast("array<string>")
    df = df.withColumn("_good", good).withColumn("_doc", doc)
    ok, d = F.col("_good"), F.col("_doc")
    return df.withColumns(
        {
            "other_allergy": F.when(ok, T.blank(d["allergyText"])).otherwise(T.blank(raw)),
            "scalp_type": F.when(ok, T.text(d["scalpType"])).otherwise(""),
            "hair_goals": F.when(ok, F.coalesce(d["haircareGoals"], empty)).otherwise(empty),
            "avoid_ingredients": F.when(ok, F.coalesce(d["avoidIngredients"], empty)).otherwise(empty),
            "other_avoid": F.when(ok, T.text(d["otherAvoidIngredient"])).otherwise(""),
        }
    ).drop("_good", "_doc")


def encode_profiles(df: DataFrame, out: str = "stored_text", prefix: str = K.PROFILE_EXTENSION_PREFIX) -> DataFrame:
    empty = F.array().cast("array<string>")
    body = F.to_json(
        F.struct(
            F.when(F.array_contains("allergies", "OTHER"), T.blank(F.col("other_allergy"))).alias("allergyText"),
            T.blank(F.col("scalp_type")).alias("scalpType"),
            F.coalesce("hair_goals", empty).alias("haircareGoals"),
            F.coalesce("avoid_ingredients", empty).alias("avoidIngredients"),
            F.when(F.array_contains("avoid_ingredients", "OTHER"), T.blank(F.col("other_avoid"))).alias("otherAvoidIngredient"),
        ),
        {"ignoreNullFields": "false"},
    )
    return df.withColumn(out, F.concat(F.lit(prefix), body))


def _spoken(c: Column) -> Column:
    """Code as words; `anti-aging` is the one label with a hyphen."""
    return F.when(c == "ANTI_AGING", "anti-aging").otherwise(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def profile_summary(profiles: DataFrame) -> DataFrame:
    """profile_id, summary: a few sentences about a profile."""
    none = F.array(F.lit("NONE"), F.lit("OTHER"))
    concerns, goals = F.col("concerns"), F.col("goals")
    allergies = F.concat(
        F.transform(F.filter("allergies", lambda a: ~a.isin("NONE", "OTHER")), _spoken),
        F.array_compact(F.array(T.blank(F.lower(F.col("other_allergy"))))),
    )
    avoids = F.concat(
        F.transform(F.filter("avoid_ingredients", lambda a: ~a.isin("NONE", "OTHER")), _spoken),
        F.array_compact(F.array(T.blank(F.lower(F.col("other_avoid"))))),
    )
    df = profiles.withColumn("_all", allergies).withColumn("_avoid", avoids)
    acne = (F.col("skin_type") == "OILY") | F.array_contains(concerns, "ACNE")
    gentle = (F.col("skin_sensitivity") != "NOT_SENSITIVE") | (F.size("_all") > 0)
    barrier = (F.col("skin_type") == "DRY") | F.arrays_overlap(goals, T.str_array(["BARRIER_REPAIR", "HYDRATION"]))
    tone = F.arrays_overlap(concerns, T.str_array(["PIGMENTATION", "DARK_SPOTS"])) | F.arrays_overlap(
        goals, T.str_array(["BRIGHTENING", "EVEN_SKIN_TONE"])
    )
    tags = F.array_compact(
        F.array(
            F.when(acne, "non-comedogenic"), F.when(acne, "acne-safe"), F.when(gentle, "fragrance-free"),
            F.when(gentle, "low-irritation"), F.when(barrier, "skin-barrier-friendly"), F.when(tone, "tone-evening"),
        )
    )
    df = df.withColumn("_tags", F.slice(tags, 1, 3))
    df = df.withColumns(
        {
            "_c": F.slice(F.transform(concerns, _spoken), 1, 3),
            "_g": F.slice(F.transform(goals, _spoken), 1, 3),
            "_h": F.slice(F.transform(F.coalesce("hair_goals", F.array().cast("array<string>")), _spoken), 1, 2),
            "_all": F.slice("_all", 1, 2),
            "_avoid": F.slice("_avoid", 1, 3),
        }
    )

    def sentence(arr, before, after):
        return F.when(F.size(arr) > 0, F.concat(F.lit(before), T.or_list(F.col(arr), "your profile"), F.lit(after)))

    scalp = F.replace(F.lower(F.coalesce(T.blank(F.col("scalp_type")), F.lit("normal"))), F.lit("_"), F.lit(" "))
    first = F.concat(
        F.lit("You have "), _spoken(F.col("skin_type")), F.lit(" skin, "), _spoken(F.col("skin_sensitivity")), F.lit(" sensitivity, "),
        _spoken(F.col("hair_type")), F.lit(" hair, and a "), scalp, F.lit(" scalp."),
    )
    text = F.concat_ws(
        " ",
        first,
        sentence("_c", "Your primary concerns are ", "."),
        sentence("_all", "Analyses will watch closely for ", " triggers."),
        F.coalesce(
            sentence("_tags", "Your analyses will prioritize ", " ingredients."),
            sentence("_g", "Your analyses will prioritize formulas aligned with ", " goals."),
        ),
        sentence("_h", "For haircare, analyses will prioritize ", " goals."),
        sentence("_avoid", "They will also avoid ", " when possible."),
    )
    return df.select("profile_id", text.alias("summary"))
