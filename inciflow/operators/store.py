"""Knowledge-base tables: upserts, append-only facts, lookups.

Tables are merged by key with aggregates (``max_by`` over a version), which
combine on the map side, so a key with very many versions costs one row per
map task after the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import first_per_key, rank_in_group, top_per_group


# ------------------------------------------------------------------ upserts
def upsert(current: DataFrame, updates: DataFrame, key: str, version: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Latest version of every key; `keep` columns stay as first stored."""
    cols = [c for c in current.columns if c not in (key, *version)]
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    v = F.struct("_new", *version)
    latest = F.max(F.struct(v.alias("v"), *[c for c in cols if c not in keep])).alias("l")
    first = [F.min(F.struct(v.alias("v"), F.col(c))).alias(f"f_{c}") for c in keep]
    out = both.groupBy(key).agg(latest, *first)
    return out.select(
        key,
        *[(F.col(f"f_{c}")[c] if c in keep else F.col("l")[c]).alias(c) for c in cols],
        *[F.col("l.v")[x].alias(x) for x in version],
    )


def upsert_products(current: DataFrame, updates: DataFrame, key: str = "fingerprint", version: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Insert by fingerprint or overwrite; id and creation time stay."""
    return upsert(current, updates, key, version, [c for c in ("product_id", "created_at") if c in current.columns])


def upsert_stores(stores: DataFrame, seen: DataFrame) -> DataFrame:
    return upsert(stores, seen, "domain", ["ord"])


def upsert_profiles(current: DataFrame, updates: DataFrame, key: str = "user_id") -> DataFrame:
    return upsert(current, updates, key, ["updated_at"], [c for c in ("id", "created_at") if c in current.columns])


def learn_ingredients(dim: DataFrame, names: DataFrame) -> DataFrame:
    """Rows for names whose lookup key the dimension lacks, with defaults; stored rows stay untouched."""
    known = dim.select(T.compact_key(F.col("name")).alias("_key")).distinct()
    new = names.select("name").distinct().withColumn("_key", T.compact_key(F.col("name"))).join(known, "_key", "left_anti")
    return new.select(
        "name",
        F.lit("Unknown").alias("purpose"),
        F.lit("LOW").alias("risk_level"),
        F.lit("LIMITED").alias("evidence_level"),
        F.lit(0).alias("comedogenic"),
        F.lit(0).alias("irritation"),
    )


def upsert_aliases(current: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per normalised alias; the owner stays, the spelling is refreshed."""
    def keyed(df):
        return df.withColumn("normalized_alias", T.compact_key(F.col("alias"))).where("normalized_alias <> ''")

    return upsert(keyed(current), keyed(updates), "normalized_alias", ["ord"], ["ingredient_id"])


# ------------------------------------------------------------------ facts
def natural_id(*cols: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def source_kind() -> Column:
    """Kind of a source: given, else by extraction method, else by website type."""
    method = T.text(F.col("method"))
    return (
        F.when(T.text(F.col("source_kind")) != "", F.col("source_kind"))
        .when(F.startswith(method, F.lit("official-site")), "OFFICIAL_BRAND")
        .when(F.startswith(method, F.lit("trusted-database")), "TRUSTED_DATABASE")
        .when(F.startswith(method, F.lit("distributor")), "PHARMACY")
        .when(method == "search-engine-result", "SEARCH_ENGINE")
        .when(method.isin("openai-structured-output", "ai-structured-output"), "AI")
        .when(F.col("website_type") == "official-brand-website", "OFFICIAL_BRAND")
        .otherwise("RETAILER")
    )


def verified_facts(resolutions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Formula, source and verification rows of verified resolutions.

    resolutions: fingerprint, source_url, website, method, source_kind,
    website_type, ingredients_text, ingredient_count, matched_count,
    unknown_count, alias_count, confidence, reason, verified, verified_at.
    Ids are hashes of natural keys: a retried write repeats the same ids.
    """
    df = resolutions.where("verified").withColumns(
        {
            "source_id": natural_id("fingerprint", "source_url"),
            "verification_id": natural_id("fingerprint", "source_url", "verified_at"),
            "formula_id": natural_id("fingerprint", "ingredients_text", "verified_at"),
        }
    )
    formula = df.select("formula_id", "fingerprint", "ingredients_text", "ingredient_count", "confidence", "source_id", "verification_id", "verified_at")
    source = df.select(
        "source_id", source_kind().alias("kind"), F.col("website").alias("label"), T.alias_key(F.col("website")).alias("domain"), F.col("source_url").alias("url"), "fingerprint"
    )
    verification = df.select(
        "verification_id", F.lit("VERIFIED").alias("status"), "confidence", "matched_count", "unknown_count", "alias_count", "ingredient_count",
        F.lit("PASSED").alias("rule"), "reason", "source_id",
    )
    return formula, source, verification


# ------------------------------------------------------------------ batches that appear at once
def commit_batch(path: str, batch: int, tables: dict[str, DataFrame], partition_by: Sequence[str] = ()) -> None:
    """Write the tables of a batch, then one manifest row that makes all of them visible.

    Each table goes to a folder named by the batch, written over, so a batch that is repeated replaces itself. What
    a writer that died left behind has no manifest row and is never read by `committed`.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{name}/batch={batch}")
    spark = next(iter(tables.values())).sparkSession
    done = spark.range(1).select(F.lit(sorted(tables)).alias("tables"))
    done.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def committed(spark: SparkSession, path: str, name: str, without: int | None = None) -> DataFrame | None:
    """Rows of all committed batches (or all but one); None before the first. Batches are pruned by their folders."""
    try:
        done = spark.read.parquet(f"{path}/manifest").where(F.array_contains("tables", name)).select("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    batches = sorted(r["batch"] for r in done.collect() if r["batch"] != without)  # one short row for each batch
    if not batches:
        return None
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/batch={b}" for b in batches])


def append_verified(resolutions: DataFrame, path: str, batch: int) -> None:
    """Commit the facts of a batch that no other batch holds, by id; its three tables appear together."""
    spark, tables = resolutions.sparkSession, {}
    for name, df in zip(("formula", "source", "verification"), verified_facts(resolutions)):
        key = f"{name}_id"
        df = first_per_key(df, [key], [F.col(c) for c in df.columns])
        stored = committed(spark, path, name, without=batch)
        tables[name] = df if stored is None else df.join(stored.select(key), key, "left_anti")
    commit_batch(path, batch, tables)


def attempt_rows(resolutions: DataFrame) -> DataFrame:
    """Trace steps and candidate attempts of a resolution as one deduplicated log.

    resolutions: fingerprint, ord, url, website, steps array<struct<label,state,details>>,
    attempts array<struct<stage,url,website,method,verified,ingredient_count,matched_count,confidence,reason>>.
    """
    steps = resolutions.select("fingerprint", "ord", "url", "website", F.posexplode("steps").alias("i", "s")).where(
        F.col("s.label").rlike("(?i)searching|checking|lookup|parsing")
    )
    steps = steps.select(
        "fingerprint",
        F.struct("ord", F.lit(0).alias("kind"), "i").alias("o"),
        F.col("s.label").alias("stage"),
        "url",
        "website",
        F.regexp_replace(F.lower("s.label"), T.SPACES + "+", "-").alias("method"),
        F.when(F.col("s.state") == "completed", "COMPLETED").when(F.col("s.state") == "failed", "FAILED").otherwise("STARTED").alias("status"),
        F.lit(0).alias("candidate_count"),
        F.lit(0).alias("matched_count"),
        F.lit(0.0).alias("confidence"),
        T.blank(F.col("s.details")).alias("reason"),
    )
    tried = resolutions.select("fingerprint", "ord", "url", "website", F.posexplode("attempts").alias("i", "a")).select(
        "fingerprint",
        F.struct("ord", F.lit(1).alias("kind"), "i").alias("o"),
        F.coalesce(T.blank(F.col("a.stage")), F.lit("discovery")).alias("stage"),
        F.coalesce(T.blank(F.col("a.url")), "url").alias("url"),
        F.coalesce(T.blank(F.col("a.website")), "website").alias("website"),
        F.coalesce(T.blank(F.col("a.method")), F.lit("unknown")).alias("method"),
        F.when(F.col("a.verified"), "VERIFIED").otherwise("FAILED").alias("status"),
        F.coalesce("a.ingredient_count", F.lit(0)).alias("candidate_count"),
        F.coalesce("a.matched_count", F.lit(0)).alias("matched_count"),
        F.coalesce("a.confidence", F.lit(0.0)).alias("confidence"),
        T.blank(F.col("a.reason")).alias("reason"),
    )
    key = ["fingerprint", "stage", "url", "website", "method", "status", "reason"]
    return first_per_key(steps.unionByName(tried), key, [F.col("o")])


def append_attempts(rows: DataFrame, path: str, batch: int) -> None:
    """Commit the attempt log of a batch; a repeated batch replaces its rows."""
    commit_batch(path, batch, {"attempt": rows.drop("o")}, ["stage"])


def attempts_for(attempts: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """History of the asked fingerprints in time order.

    Ranked by (hour, time), so a fingerprint with very many attempts is spread
    over its hours.
    """
    own = attempts.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi")
    own = own.withColumn("_hour", F.date_trunc("hour", "ts"))
    return rank_in_group(own, ["fingerprint"], ["_hour"], [F.col("ts"), F.col("attempt_id")], "seq").drop("_hour")


# ------------------------------------------------------------------ lookups
def search_products(products: DataFrame, query: str) -> DataFrame:
    """Products whose brand, name and category contain the query."""
    q = query.strip().lower()
    return products if not q else products.where(F.lower(F.concat_ws(" ", "brand", "name", "category")).contains(q))


def find_by_name(products: DataFrame, names: DataFrame) -> DataFrame:
    """First product of each asked name, upper and lower case alike."""
    first = products.groupBy(F.lower("name").alias("key")).agg(F.min_by("product_id", "ord").alias("product_id"))
    asked = names.select("asked").distinct().withColumn("key", T.strip(F.lower("asked")))
    return asked.join(first, "key").select("asked", "product_id")


def register_aliases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """alias_key, fingerprint, registered_at: the first claim of a key stays."""
    claims = existing.unionByName(new)
    return claims.groupBy("alias_key").agg(F.min(F.struct("registered_at", "fingerprint")).alias("c")).select(
        "alias_key", F.col("c.fingerprint").alias("fingerprint"), F.col("c.registered_at").alias("registered_at")
    )


def latest_product(products: DataFrame, key: Sequence[str] = ("brand", "canonical_name")) -> DataFrame:
    cols = [c for c in products.columns if c not in (*key, "updated_at")]
    best = products.groupBy(*key).agg(F.max(F.struct("updated_at", *cols)).alias("m"))
    return best.select(*key, "m.*")


def best_formula(formulas: DataFrame, key: str = "product_id") -> DataFrame:
    """Highest confidence, then newest, of each product."""
    cols = [c for c in formulas.columns if c not in (key, "confidence", "verified_at")]
    best = formulas.groupBy(key).agg(F.max(F.struct("confidence", "verified_at", *cols)).alias("m"))
    return best.select(key, "m.*")


def kb_lookup(requests: DataFrame, products: DataFrame, formulas: DataFrame, aliases: DataFrame) -> DataFrame:
    """Verified formula for each request, and the way it was found.

    requests: request_id, fingerprint, brand, canonical_name, keys array<string>;
    products: fingerprint, brand, canonical_name, updated_at; formulas:
    fingerprint, ...; aliases: alias_key, fingerprint.

    All sides grow with the products, and sizes guessed from files are far below those in memory: joins sort and
    merge, so that no table goes through the driver.
    """
    formula = best_formula(formulas, "fingerprint").select("fingerprint", "formula_id", "confidence")
    by_print = products.select("fingerprint", F.lit(True).alias("_stored"))
    named = products.where("brand <> '' AND canonical_name <> ''").select("brand", "canonical_name", "updated_at", F.col("fingerprint").alias("_named"))
    by_name = latest_product(named).select("brand", "canonical_name", "_named")
    found = requests.join(by_print.hint("merge"), "fingerprint", "left").join(by_name.hint("merge"), ["brand", "canonical_name"], "left")
    pick = F.when(F.col("_stored"), F.col("fingerprint")).otherwise(F.col("_named"))
    found = found.select("request_id", F.coalesce("_stored", F.lit(False)).alias("_stored"), pick.alias("_fp"), "keys")
    direct = found.join(formula.withColumnRenamed("fingerprint", "_fp").hint("merge"), "_fp", "left")
    hit = direct.where("formula_id IS NOT NULL").select(
        "request_id", F.when(F.col("_stored"), "database").otherwise("database-alias").alias("source"), F.col("_fp").alias("fingerprint"), "formula_id", "confidence"
    )
    missed = direct.where("formula_id IS NULL").select("request_id", F.posexplode("keys").alias("pos", "alias_key"))
    claimed = missed.join(aliases.select("alias_key", "fingerprint").hint("merge"), "alias_key").groupBy("request_id").agg(
        F.min(F.struct("pos", "fingerprint")).alias("m")
    )
    learned = (
        claimed.select("request_id", F.col("m.fingerprint").alias("fingerprint"))
        .join(products.select("fingerprint").hint("merge"), "fingerprint", "left_semi")
        .join(formula.hint("merge"), "fingerprint")
        .select("request_id", F.lit("memory-alias").alias("source"), "fingerprint", "formula_id", "confidence")
    )
    return hit.unionByName(learned)


def kb_result(rows: DataFrame) -> DataFrame:
    """Response row of a knowledge-base hit with its defaults and trace.

    rows: source, fingerprint, brand, canonical_name, name, source_url, website,
    method, ingredient_source, confidence, ingredients_text, ingredient_count,
    matched_count, unknown_count, match_rate, input_url.
    """
    alias = F.col("source").isin("database-alias", "memory-alias")
    base = "Using the verified ingredient knowledge base"
    detail = (
        F.when(alias, "Verified formula found via a learned product alias match.")
        .when(F.col("source") == "database", "Verified formula found in the database knowledge base.")
        .when(F.col("source") == "memory", "Verified formula found in the in-memory knowledge base.")
        .otherwise(F.concat(F.lit("Verified formula found in the knowledge base ("), F.col("source"), F.lit(").")))
    )
    step = lambda label, text: F.struct(F.lit(label).alias("label"), F.lit("completed").alias("state"), text.alias("details"))
    count = F.coalesce("ingredient_count", F.lit(0))
    return rows.select(
        "request_id",
        F.lit("VERIFIED_INGREDIENTS_FOUND").alias("status"),
        F.coalesce(T.blank(F.col("source_url")), "input_url").alias("source_url"),
        F.coalesce(T.blank(F.col("website")), F.lit("Knowledge Base")).alias("source_website"),
        "brand",
        "canonical_name",
        F.coalesce(T.blank(F.col("method")), F.lit("knowledge-base")).alias("extraction_method"),
        F.coalesce(T.blank(F.col("ingredient_source")), "source").alias("ingredient_source"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        count.alias("ingredient_count"),
        F.coalesce("matched_count", count).alias("matched_count"),
        F.coalesce("unknown_count", F.lit(0)).alias("unknown_count"),
        F.coalesce("match_rate", F.lit(1.0)).alias("match_rate"),
        F.array(
            step("Product fingerprint", F.concat(F.lit("Generated fingerprint for "), F.col("brand"), F.lit(" | "), F.col("canonical_name"), F.lit("."))),
            step("Knowledge base lookup", detail),
        ).alias("trace"),
        F.concat(F.lit("knowledge-base:"), F.col("fingerprint")).alias("attempted_source"),
        F.when(alias, base + " via a learned product alias match.").otherwise(base + " for this product.").alias("message"),
    )


def recommend(scores: DataFrame, k: int) -> DataFrame:
    """Top k formulas of each profile."""
    return top_per_group(scores, ["profile_id"], [F.col("overall_score").desc(), F.col("list_id")], k)


# ------------------------------------------------------------------ sets
def ordered_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct values of a then b at the place they first appear (col, ord in both)."""
    both = a.select(col, F.struct(F.lit(0).alias("side"), "ord").alias("o")).unionByName(b.select(col, F.struct(F.lit(1).alias("side"), "ord").alias("o")))
    return both.groupBy(col).agg(F.min("o").alias("o")).select(col, F.col("o.side").alias("side"), F.col("o.ord").alias("ord"))


def overlap_count(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Shared keys of given pairs of sets (pairs: a, b; sets: set_id, key)."""
    keys = sets.select("set_id", "key").distinct()
    left = pairs.join(keys.withColumnRenamed("set_id", "a"), "a")
    both = left.join(keys.withColumnRenamed("set_id", "b"), ["b", "key"], "left_semi")
    counts = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def difference(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).distinct().join(b.select(col).distinct(), col, "left_anti")
