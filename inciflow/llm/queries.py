"""Registered queries of the operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inciflow.llm import alignment, ann, filter_audit, fingerprint, line_dedup, lm_scoring, mixing, packing, quality, sharding, simhash, url_filter, warc


#: Vocabulary that op2_pack and the pipeline use.
PACK_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = PACK_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents with their grades; `quality.grade_documents` has those of all."""
    out = quality.select_good(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "expected_grade", "tail_probability")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the contract's rules; URLs that serve different pages are the list."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.contract_rules(spark), url_filter.unstable_urls(pages))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_pack, op3_shard, op4_mix, op5_warc, op6_ann, op7_fingerprint, op8_line_dedup, op9_simhash, op10_quality, op11_url_filter, op12_filter_audit, op13_align)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix": mixing.MIX_SQL, "op5_warc": warc.PAGES_SQL, "op8_line_dedup": line_dedup.LINES_SQL, "op11_url_filter": url_filter.JUDGE_SQL, "op12_filter_audit": filter_audit.AUDIT_SQL}
