"""Pages to verified formulas in stages; each stage takes only what the one before left.

cache -> metadata and fingerprint -> knowledge base -> extraction -> attempt log -> store.  What a batch learns is
committed at once, and the next batch meets it: the second page of a learned product is a hit without an attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import pages as P
from ..operators import resolve as R
from ..operators import standardise as S
from ..operators import store as KB
from ..operators import verify as V
from ..operators.links import host_key
from .jobs import run_to_end

#: What a knowledge base holds; `known` and `learn_batch` take and leave tables of these columns.
TABLES = {
    "cache": "url string",
    "product": "fingerprint string, brand string, canonical_name string, updated_at bigint",
    "formula": "fingerprint string, formula_id string, confidence double, verified_at bigint, ingredients_text string, ingredient_count bigint",
    "alias": "alias_key string, fingerprint string, registered_at bigint",
}
OUTCOME = ["request_id", "source", "fingerprint", "method", "confidence", "ingredient_count", "attempts", "verified"]


def try_candidates(asked: DataFrame, candidates: DataFrame, dim: DataFrame, min_count: int = K.MIN_LIST_SIZE) -> DataFrame:
    """Candidates of each request, best first, up to the first that is verified (all of them where none is).

    asked: request_id, brand, website; candidates: request_id, method, label, raw_text.  Each different text is
    resolved and verified once, however many pages show it.  The candidates of a request come from one page, so the
    window over them is bounded by a page.  Adds try (from 1), verified, ingredient_count, matched_count, confidence,
    reason.
    """
    mine = candidates.join(asked.select("request_id", "brand", "website"), "request_id").withColumn("text_id", F.sha2("raw_text", 256))
    texts = mine.where("raw_text IS NOT NULL").select("text_id", "raw_text").distinct()
    tokens = texts.select(F.col("text_id").alias("list_id"), F.posexplode(T.split_list(F.col("raw_text"))).alias("position", "raw_name"))
    checked = V.verify_lists(V.list_counters(R.resolve_names(tokens, dim)), min_count).withColumnRenamed("list_id", "text_id")
    zero = F.lit(0).cast("bigint")
    df = mine.join(checked, "text_id", "left").withColumns(
        {
            "confidence": F.coalesce(V.verification_confidence(F.col("method"), F.col("website"), F.col("brand")), F.lit(0.0)),
            "reason": F.coalesce(V.reason_text(min_count, F.col("website")), F.lit("Ingredient list is too short to trust.")),
        }
    ).withColumns(
        {"verified": F.coalesce("verified", F.lit(False)), "ingredient_count": F.coalesce("ingredient_count", zero), "matched_count": F.coalesce("matched_count", zero)}
    )
    score = P.candidate_score(F.col("label"), F.col("ingredient_count"), F.col("raw_text"), F.col("method"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(score.desc(), "method", "label", "raw_text"))
    first = F.min(F.when(F.col("verified"), F.col("try"))).over(Window.partitionBy("request_id"))
    tried = df.withColumn("try", place).withColumn("_first", first).where("_first IS NULL OR try <= _first")
    return tried.select("request_id", "try", "method", "label", "raw_text", "verified", "ingredient_count", "matched_count", "confidence", "reason")


def known(seed: dict[str, DataFrame], path: str, without: int | None = None) -> dict[str, DataFrame]:
    """Seed tables and what committed batches learned: one row a product and alias key, the first claim of a key stays."""
    found = {}
    for name, schema in TABLES.items():
        cols = [c.split()[0] for c in schema.split(", ")]
        learned = KB.committed(seed[name].sparkSession, path, name, without)
        found[name] = seed[name].select(*cols) if learned is None else seed[name].select(*cols).unionByName(learned.select(*cols))
    newest = found["product"].groupBy("fingerprint").agg(F.max(F.struct("updated_at", "brand", "canonical_name")).alias("m"))
    found["product"] = newest.select("fingerprint", "m.*")
    first = found["alias"].groupBy("alias_key").agg(F.min(F.struct("registered_at", "fingerprint")).alias("m"))
    found["alias"] = first.select("alias_key", "m.*")
    return found


def learn_batch(
    pages: DataFrame, describe: Callable, extract: Callable, dim: DataFrame, kb: dict[str, DataFrame], path: str, batch: int, min_count: int = K.MIN_LIST_SIZE
) -> None:
    """Resolve the pages of a batch against what is known, and commit outcomes, attempts and new knowledge.

    pages: request_id (unique), ord, url and what `describe` and `extract` read; describe(pages) gives request_id,
    brand, name, canonical_name, variant, size, category, sku; extract(pages) gives the candidates of
    `try_candidates`; kb: the tables of `known`, cache with the urls whose results are still alive.  Pages are
    described only if the cache does not answer, and read for candidates only if the knowledge base does not either.
    Of the pages of a new product in a batch, those after the first verified one (by ord, request_id) are answered
    from memory; what the batch learns about aliases and urls counts from the next batch on.  Only verified results
    are cached.  Every stage is written under `path`, over what a failed run of the same batch left.
    """
    spark = pages.sparkSession

    def stage(name: str, df: DataFrame) -> DataFrame:
        out = f"{path}/work/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(out)
        return spark.read.schema(df.schema).parquet(out)

    urls = kb["cache"].select("url").distinct()
    cached = pages.select("request_id", "url").join(urls, "url", "left_semi")
    left = pages.join(urls, "url", "left_anti")
    products = S.fingerprint(describe(left))
    keys = S.alias_keys(products, "request_id").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("ord", "alias_key"))).alias("k"))
    products = products.select("request_id", "fingerprint", T.text(F.col("brand")).alias("brand"), "canonical_name")
    asked = left.select("request_id", "ord", "url", host_key(F.col("url")).alias("website")).join(products, "request_id").join(keys, "request_id", "left")
    empty = F.array().cast("array<string>")
    asked = stage("asked", asked.withColumn("keys", F.coalesce(F.transform("k", lambda x: x["alias_key"]), empty)).drop("k"))

    hits = KB.kb_lookup(asked, kb["product"], kb["formula"].select("fingerprint", "formula_id", "confidence", "verified_at"), kb["alias"])
    hits = stage("hits", hits)
    missed = stage("missed", asked.join(hits.select("request_id"), "request_id", "left_anti"))
    unread = pages.join(missed.select("request_id"), "request_id", "left_semi")
    tried = stage("tried", try_candidates(missed, extract(unread), dim, min_count))

    best = tried.where("verified").select("request_id", "method", "confidence", "ingredient_count", F.col("raw_text").alias("ingredients_text"))
    verified = missed.join(best, "request_id")
    teacher = verified.groupBy("fingerprint").agg(F.min(F.struct("ord", "request_id")).alias("_teacher"))
    mine = F.struct("ord", "request_id")
    taught = missed.join(teacher, "fingerprint", "left").withColumn("_later", F.coalesce(mine > F.col("_teacher"), F.lit(False)))
    late = taught.where("_later").select("request_id", "fingerprint")
    attempts = tried.join(late.select("request_id"), "request_id", "left_anti")
    counted = attempts.groupBy("request_id").agg(F.count(F.lit(1)).alias("attempts"))
    read = taught.where("NOT _later").join(counted, "request_id", "left").join(best, "request_id", "left")

    null, no = F.lit(None), F.lit(0).cast("bigint")
    answered = [null.cast("string").alias("method"), null.cast("double").alias("confidence"), null.cast("bigint").alias("ingredient_count"), no.alias("attempts"), F.lit(True).alias("verified")]
    found = F.col("method").isNotNull()
    outcome = stage(
        "outcome",
        cached.select("request_id", F.lit("cache").alias("source"), null.cast("string").alias("fingerprint"), *answered)
        .unionByName(hits.select("request_id", "source", "fingerprint", *answered))
        .unionByName(late.select("request_id", F.lit("memory").alias("source"), "fingerprint", *answered))
        .unionByName(
            read.select(
                "request_id", F.when(found, "extraction").otherwise("none").alias("source"), F.when(found, F.col("fingerprint")).alias("fingerprint"),
                "method", "confidence", "ingredient_count", F.coalesce("attempts", no).alias("attempts"), found.alias("verified"),
            )
        ),
    )
    new = read.where(found & (F.col("_teacher.request_id") == F.col("request_id")))
    new = new.withColumn("formula_id", F.sha2(F.concat_ws("|", "fingerprint", "ingredients_text"), 256))
    KB.commit_batch(
        path,
        batch,
        {
            "outcome": outcome.select(*OUTCOME),
            "attempt": attempts.join(missed.select("request_id", "fingerprint", "url", "website"), "request_id"),
            "cache": pages.select("request_id", "url").join(outcome.where("verified").select("request_id"), "request_id").select("url").distinct(),
            "product": new.select("fingerprint", "brand", "canonical_name", F.col("ord").alias("updated_at")),
            "formula": new.select("fingerprint", "formula_id", "confidence", F.col("ord").alias("verified_at"), "ingredients_text", "ingredient_count"),
            "alias": new.select(F.explode("keys").alias("alias_key"), "fingerprint", F.col("ord").alias("registered_at")),
        },
    )


def learning_stream(
    source: DataFrame, describe: Callable, extract: Callable, dim: DataFrame, seed: dict[str, DataFrame], base: str, min_count: int = K.MIN_LIST_SIZE
) -> None:
    """Micro-batches of pages against a knowledge base that grows under `base`; a repeated batch replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        learn_batch(batch, describe, extract, dim, known(seed, base, batch_id), base, batch_id, min_count)

    run_to_end(source, f"{base}/checkpoint", each=each)
