"""Ingredient knowledge: overlay of curated values, benefits, enrichment, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .standardise import norm_evidence_col, split_purpose_col

_EMPTY = "array<string>"
NO_PURPOSE = "Limited evidence: no source-backed purpose summary for this ingredient yet."


def _arr(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(_EMPTY))


def tidy_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_arr(c), lambda v: T.strip(T.text(v))), lambda v: v != ""))


def overlay_curated(seed: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated fields replace seed fields where given; both sides have a name."""
    c = curated.select(T.spaced_key(F.col("key")).alias("_key"), *[F.col(x).alias(f"_{x}") for x in curated.columns if x != "key"])
    df = seed.withColumn("_key", T.spaced_key(F.col("name"))).join(c, "_key", "left")
    fields = [x for x in curated.columns if x != "key"]
    out = {x: (F.coalesce(F.col(f"_{x}"), F.col(x)) if x in seed.columns else F.col(f"_{x}")) for x in fields}
    return df.withColumns(out).drop("_key", *[f"_{x}" for x in fields])


def _upper_key(c: Column) -> Column:
    return F.replace(F.upper(T.spaced_key(c)), F.lit(" "), F.lit("_"))


def _statements(codes: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_compact(F.transform(codes, lambda c: F.try_element_at(m, _upper_key(c))))


def _sentence_case(c: Column) -> Column:
    x = T.strip(c)
    return F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))


def _statement(c: Column) -> Column:
    x = _sentence_case(c)
    return F.when(x.rlike(r"[.!?]\z"), x).otherwise(F.concat(x, F.lit(".")))


def derive_benefits(explicit: Column, functions: Column, helps: Column, display: Column) -> Column:
    """Given benefits, else statements of the concerns and functions, else the role."""
    told = F.array_distinct(F.transform(tidy_list(explicit), _statement))
    derived = F.concat(_statements(helps, K.CONCERN_BENEFITS), _statements(functions, K.FUNCTION_BENEFITS))
    role = F.when(display != "", F.array(F.concat(_sentence_case(display), F.lit(" role in the formula.")))).otherwise(F.array().cast(_EMPTY))
    return F.when(F.size(told) > 0, F.transform(tidy_list(explicit), _statement)).otherwise(
        F.array_distinct(F.when(F.size(derived) > 0, derived).otherwise(role))
    )


OPTIONAL = {
    "category": "string", "common_names": _EMPTY, "benefits": _EMPTY, "primary_purpose": "string", "how_it_works": "string",
    "best_skin_types": _EMPTY, "side_effects": _EMPTY, "cas_number": "string",
}


def enrich_dim(dim: DataFrame) -> DataFrame:
    """Fallback chains of an ingredient record; every text column ends up filled."""
    df = dim
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in dim.columns}
    df = df.withColumns(missing) if missing else df
    val = lambda c: T.blank(T.strip(T.text(F.col(c))))
    lists = ["aliases", "functions", "helps", "avoid_for", "tags", "risk_flags", "suitable_skin_types", "avoid_skin_types", "side_effects"]
    df = df.withColumns(
        {
            **{c: tidy_list(F.col(c)) for c in lists},
            "purpose": F.coalesce(val("purpose"), val("display_purpose"), F.lit("Unknown")),
            "display_purpose": F.coalesce(val("display_purpose"), val("purpose"), F.lit("Unknown")),
            "scientific_name": val("scientific_name"),
            "inci_name": F.coalesce(val("inci_name"), val("name")),
            "evidence_level": norm_evidence_col(F.col("evidence_level")),
        }
    )
    parts = split_purpose_col(F.col("display_purpose"))
    df = df.withColumn("functions", F.when(F.size("functions") > 0, F.col("functions")).otherwise(parts))
    given = tidy_list(F.col("common_names"))
    df = df.withColumns(
        {
            "common_names": F.when(F.size(given) > 0, given).otherwise(
                F.array_distinct(F.concat("aliases", F.array_compact(F.array("scientific_name"))))
            ),
            "category": F.coalesce(val("category"), F.get("functions", F.lit(0)), F.col("display_purpose")),
            "benefit_texts": derive_benefits(F.col("benefits"), F.col("functions"), F.col("helps"), F.col("display_purpose")),
            "best_skin_types": F.coalesce(tidy_list(F.col("best_skin_types")), F.col("suitable_skin_types")),
            "comedogenic": F.coalesce("comedogenic", F.lit(0)),
            "irritation": F.coalesce("irritation", F.lit(0)),
        }
    )
    df = df.withColumn(
        "primary_purpose",
        F.coalesce(val("primary_purpose"), val("simple_explanation"), F.get("benefit_texts", F.lit(0)), F.col("display_purpose"), F.lit(NO_PURPOSE)),
    )
    df = df.withColumn("how_it_works", F.coalesce(val("how_it_works"), val("simple_explanation"), F.col("primary_purpose")))
    return df.withColumn("simple_explanation", F.coalesce(val("simple_explanation"), F.col("how_it_works"))).drop("benefits")


GAP_CHECKS = {
    "category": "coalesce(category, '') = ''",
    "primary_purpose": "coalesce(primary_purpose, '') = ''",
    "how_it_works": "coalesce(how_it_works, '') = ''",
    "benefit_texts": "size(benefit_texts) = 0",
    "functions": "size(functions) = 0",
    "evidence_level": "evidence_level IS NULL",
    "references": "references IS NULL OR size(references) = 0",
}


def coverage_gaps(dim: DataFrame) -> DataFrame:
    """ingredient_id, gap: one row per missing piece of knowledge."""
    if "references" not in dim.columns:
        dim = dim.withColumn("references", F.lit(None).cast(_EMPTY))
    marks = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in GAP_CHECKS.items()]))
    return dim.select("ingredient_id", "risk_level", F.explode(marks).alias("gap"))


def coverage_report(dim: DataFrame) -> DataFrame:
    """Gap counts per risk level and gap, with subtotals."""
    rolled = coverage_gaps(dim).cube("risk_level", "gap").agg(F.count(F.lit(1)).alias("rows"))
    return rolled.select(F.coalesce("risk_level", F.lit("ALL")).alias("risk_level"), F.coalesce("gap", F.lit("ALL")).alias("gap"), "rows")


def explain_text(product: Column, overall: Column, verdict: Column, strengths: Column, weaknesses: Column) -> Column:
    """Plain wording of a score: figure out of 100, verdict, what helps, what hurts."""
    return F.concat_ws(
        " ",
        F.concat(product, F.lit(" scores "), overall.cast("string"), F.lit("/100.")),
        verdict,
        F.when(strengths != "", F.concat(F.lit("Strengths: "), strengths, F.lit("."))),
        F.when(weaknesses != "", F.concat(F.lit("Weaknesses: "), weaknesses, F.lit("."))),
    )
