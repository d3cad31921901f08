"""Names to ingredients: alias map, equi-join resolution, blocked fuzzy join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..sources.tables import kept
from . import verify as V
from .ranking import first_per_key


def synonym_of(key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.SYNONYMS.items() for x in pair])
    return F.try_element_at(table, key)


def catalogue_entries(dim: DataFrame) -> DataFrame:
    """One row per name and alias with its place in the catalogue."""
    forms = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        dim.select("ingredient_id", "name", F.posexplode(forms).alias("form_pos", "form"))
        .withColumn("key", T.compact_key(F.col("form")))
        .where("key <> ''")
        .withColumn("ord", F.struct("ingredient_id", "form_pos"))
    )


def alias_map(dim: DataFrame) -> DataFrame:
    """key -> ingredient; of several writers of a key the last one stays."""
    last = catalogue_entries(dim).groupBy("key").agg(F.max(F.struct("ord", "name")).alias("m"))
    direct = last.select(
        "key",
        F.col("m.ord.ingredient_id").alias("ingredient_id"),
        F.col("m.name").alias("name"),
        F.when(T.compact_key(F.col("m.name")) == F.col("key"), "name").otherwise("alias").alias("kind"),
    )
    words = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("target")) for k, v in K.SYNONYMS.items()]))
    return direct.where(~F.col("key").isin(list(K.SYNONYMS))).unionByName(
        dim.select(words.alias("s"), "ingredient_id", "name")
        .where(T.compact_key(F.col("name")) == T.compact_key(F.col("s.target")))
        .groupBy(F.col("s.key").alias("key"))
        .agg(F.min(F.struct("ingredient_id", "name")).alias("m"))
        .select("key", "m.ingredient_id", "m.name", F.lit("synonym").alias("kind"))
    )


def lookup_table(dim: DataFrame) -> DataFrame:
    """Join side of name resolution: direct keys, and name-only keys for synonym targets."""
    targets = sorted({literal_key(v) for v in K.SYNONYMS.values()})
    names = (
        dim.select("ingredient_id", "name", T.compact_key(F.col("name")).alias("key"))
        .where(F.col("key").isin(targets))
        .groupBy("key")
        .agg(F.min(F.struct("ingredient_id", "name")).alias("m"))
    )
    last = catalogue_entries(dim).groupBy("key").agg(F.max(F.struct("ord", "name")).alias("m"))
    direct = last.where(~F.col("key").isin(list(K.SYNONYMS))).select(
        "key", F.lit("direct").alias("via"), F.col("m.ord.ingredient_id").alias("ingredient_id"), F.col("m.name").alias("name")
    )
    return direct.unionByName(names.select("key", F.lit("target").alias("via"), "m.ingredient_id", "m.name"))


def literal_key(value: str) -> str:
    """Compact key of a literal with neither brackets nor percentages."""
    return "".join(ch for ch in value.lower() if ch.isascii() and ch.isalnum())


def expand_synonyms(names: DataFrame) -> DataFrame:
    """raw_name -> normalized_input, its key, and the key the catalogue is asked for."""
    out = names.withColumn("_target", synonym_of(T.compact_key(F.col("raw_name"))))
    out = out.withColumn("normalized_input", F.coalesce("_target", "raw_name"))
    out = out.withColumn("input_key", T.compact_key(F.col("normalized_input"))).withColumn("_again", synonym_of(F.col("input_key")))
    return out.withColumns(
        {
            "key": F.coalesce(T.compact_key(F.col("_again")), F.col("input_key")),
            "via": F.when(F.col("_again").isNotNull(), "target").otherwise("direct"),
        }
    ).drop("_target", "_again")


def name_dictionary(tokens: DataFrame, dim: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Each different raw name once: what it resolves to and how it looks as a token.

    Names repeat across lists, so keys, patterns and lookups are evaluated per
    name and joined back, not per line. The names are stored before, as conditions
    on their keys would else be moved down to the lines.
    """
    asked = expand_synonyms(kept(tokens.select("raw_name").distinct(), "raw-names"))
    support = dim.select("ingredient_id", V.support_signal().alias("v_support"))
    found = asked.join(lookup_table(dim).withColumnRenamed("name", "canonical"), ["key", "via"], "left")
    if fuzzy:
        misses = found.where("ingredient_id IS NULL AND input_key <> ''").select("input_key").distinct()
        near = fuzzy_resolve(misses, dim).select("input_key", F.col("ingredient_id").alias("f_id"), F.col("name").alias("f_name"))
        found = found.join(near, "input_key", "left")
    else:
        found = found.withColumns({"f_id": F.lit(None).cast("bigint"), "f_name": F.lit(None).cast("string")})
    kind = (
        F.when(F.col("ingredient_id").isNull() & F.col("f_id").isNull(), "unknown")
        .when(F.col("ingredient_id").isNull(), "fuzzy")
        .when(F.col("via") == "target", "synonym")
        .when(T.compact_key(F.col("canonical")) == F.col("input_key"), "exact")
        .otherwise("alias")
    )
    found = found.select(
        "raw_name",
        "normalized_input",
        F.coalesce("canonical", "f_name", "normalized_input").alias("canonical_name"),
        F.coalesce("ingredient_id", "f_id").alias("ingredient_id"),
        kind.alias("match_type"),
    )
    shown = F.when(F.col("match_type").isin("fuzzy", "unknown"), F.col("normalized_input")).otherwise(F.col("canonical_name"))
    found = found.withColumn("shown_name", shown).withColumns(V.token_facts())
    return found.join(support, "ingredient_id", "left")


def resolve_names(tokens: DataFrame, dim: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Token rows with normalized_input, canonical_name, ingredient_id, match_type and token facts.

    The dictionary has one row per name, so no row multiplies.  It is stored, so
    that no branch of a query builds it again.  Whether it is broadcast is left
    to its measured size; beyond that a hot name is split by the skew join.
    """
    return tokens.join(kept(name_dictionary(tokens, dim, fuzzy), "names"), "raw_name")


def fuzzy_resolve(misses: DataFrame, dim: DataFrame) -> DataFrame:
    """Nearest catalogue entry of each missed key, if near enough.

    A key of length n may differ by k = max(1, floor(0.18 n)) edits.  An entry
    cut into k + 1 pieces shares one piece with such a key.  If the piece moved by
    s places and the lengths differ by d, the parts before and after it need
    |s| + |d - s| edits, which bounds s.  An equi-join on (k, entry length, piece
    number, piece) loses no pair and needs no cartesian product; keys are cut
    for lengths that entries have only.
    """
    keys = misses.select("input_key").distinct().withColumn("n", F.length("input_key")).withColumn(
        "k", F.greatest(F.lit(1), F.floor(F.col("n") * 18 / 100)).cast("int")
    )
    entries = (
        catalogue_entries(dim)
        .withColumn("m", F.length("key"))
        .withColumn("k", F.explode(F.expr("sequence(1, greatest(1, cast(floor((m / 0.82 + 2) * 0.18) as int)))")))
        .withColumn("piece_no", F.explode(F.expr("sequence(0, k)")))
        .withColumn("a", F.expr("cast(floor(piece_no * m / (k + 1)) as int)"))
        .withColumn("b", F.expr("cast(floor((piece_no + 1) * m / (k + 1)) as int)"))
        .select("ingredient_id", "name", "ord", "key", "m", "k", "piece_no", F.expr("substr(key, a + 1, b - a)").alias("piece"))
    )
    lengths = entries.select("k", "m").distinct()
    probes = (
        keys.withColumn("m", F.explode(F.expr("sequence(greatest(n - k, 1), n + k)")))
        .join(lengths, ["k", "m"])
        .withColumn("piece_no", F.explode(F.expr("sequence(0, k)")))
        .withColumn("a", F.expr("cast(floor(piece_no * m / (k + 1)) as int)"))
        .withColumn("w", F.expr("cast(floor((piece_no + 1) * m / (k + 1)) as int) - a"))
        .withColumn("at", F.explode(F.expr("sequence(a + cast(ceil((n - m - k) / 2) as int), a + cast(floor((n - m + k) / 2) as int))")))
        .where("at >= 0 AND at + w <= n")
        .select("input_key", "n", "m", "k", "piece_no", F.expr("substr(input_key, at + 1, w)").alias("piece"))
        .distinct()
    )
    pairs = probes.join(entries, ["k", "m", "piece_no", "piece"]).withColumn(
        "distance", F.expr("levenshtein(input_key, key, k)")
    )
    return (
        pairs.where("distance >= 0")
        .groupBy("input_key")
        .agg(F.min(F.struct("distance", "ord", "name")).alias("best"))
        .select("input_key", F.col("best.ord.ingredient_id").alias("ingredient_id"), "best.name", "best.distance")
    )


def unknown_names(tokens: DataFrame, dim: DataFrame) -> DataFrame:
    """Distinct names with no catalogue row and how often they occur."""
    counted = tokens.groupBy("raw_name").agg(F.count(F.lit(1)).alias("uses"))
    keyed = expand_synonyms(counted).groupBy("key", "via").agg(F.sum("uses").alias("uses"), F.min("normalized_input").alias("name"))
    return keyed.join(lookup_table(dim).select("key", "via"), ["key", "via"], "left_anti").select("name", "uses")


def canonical_list(resolved: DataFrame) -> DataFrame:
    """Distinct output names per list: place of the first, spelling of the last."""
    return resolved.groupBy("list_id", F.col("v_key").alias("key")).agg(
        F.min("position").alias("position"), F.max_by("shown_name", "position").alias("name")
    )


def overlay_dim(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Stored values win over seed values, field by field; aliases are united seed first.

    Each side is reduced to one row per key, so the full outer join cannot fan out.
    """
    def one(df, side):
        keyed = df.withColumn("key", T.compact_key(F.col("name")))
        kept = first_per_key(keyed, ["key"], [F.col("ingredient_id").desc()])
        return kept.select("key", F.struct(*[c for c in kept.columns if c != "key"]).alias(side))

    s, f = F.col("s"), F.col("f")

    def words(field):
        return F.coalesce(T.blank(s[field]), T.blank(f[field]))

    def values(field):
        return F.coalesce(s[field], f[field], F.array().cast("array<string>"))

    empty = F.array().cast("array<string>")
    return one(stored, "s").join(one(seed, "f"), "key", "full_outer").select(
        "key",
        F.coalesce(s["ingredient_id"], f["ingredient_id"]).alias("ingredient_id"),
        F.coalesce(s["name"], f["name"]).alias("name"),
        F.array_union(F.coalesce(f["aliases"], empty), F.coalesce(s["aliases"], empty)).alias("aliases"),
        words("scientific_name").alias("scientific_name"),
        F.coalesce(words("purpose"), F.lit("Unknown")).alias("purpose"),
        F.coalesce(T.blank(s["display_purpose"]), T.blank(s["purpose"]), T.blank(f["display_purpose"]), T.blank(f["purpose"]), F.lit("Unknown")).alias(
            "display_purpose"
        ),
        F.coalesce(words("risk_level"), F.lit("UNKNOWN")).alias("risk_level"),
        F.coalesce(s["comedogenic"], f["comedogenic"], F.lit(0)).alias("comedogenic"),
        F.coalesce(s["irritation"], f["irritation"], F.lit(0)).alias("irritation"),
        values("functions").alias("functions"),
        values("helps").alias("helps"),
        values("tags").alias("tags"),
        values("avoid_for").alias("avoid_for"),
        values("risk_flags").alias("risk_flags"),
        values("suitable_skin_types").alias("suitable_skin_types"),
        values("avoid_skin_types").alias("avoid_skin_types"),
        words("evidence_level").alias("evidence_level"),
        words("simple_explanation").alias("simple_explanation"),
    )


def product_ingredients(products: DataFrame, dim: DataFrame) -> DataFrame:
    """Ordered ingredient names of a product (list_id, position, raw_name) with their dimension rows."""
    first = dim.groupBy("name").agg(F.min_by(F.struct(*[c for c in dim.columns if c != "name"]), "ingredient_id").alias("d"))
    return products.join(first, products.raw_name == first.name).select(
        "list_id", "position", "name", F.col("d.ingredient_id"), F.col("d.risk_level"), F.col("d.purpose")
    )
