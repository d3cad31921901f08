"""What a line costs when it is scored: nothing that depends on its name, its ingredient or its profile alone."""

import __spark_entry__ as entry
from inciflow.operators import resolve as R
from inciflow.operators import score as S
from inciflow.plans import formula_queries as Q
from inciflow.sources import bindings as B
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_worked_out_per_name(spark):
    """A condition on the key of a name moved below the distinct and ran its patterns on every line."""
    dim = spark.createDataFrame([(1, "red ring", [], ["solvent"])], "ingredient_id long, name string, aliases array<string>, tags array<string>")
    tokens = spark.range(100).selectExpr("if(id % 2 = 0, 'red ring', 'rex ring') AS raw_name")
    found = R.name_dictionary(tokens, dim)
    assert "Range" not in plan(found)
    assert {r["raw_name"]: (r["ingredient_id"], r["match_type"]) for r in found.collect()} == {"red ring": (1, "exact"), "rex ring": (1, "fuzzy")}


def test_patterns_do_not_run_on_scored_lines(spark):
    """The code of a profile's free term was worked out once per line."""
    lines = spark.createDataFrame([(1, 0, "red ring", 1)], "list_id long, position int, display_name string, ingredient_id long")
    asked = spark.createDataFrame([(7, 1)], "profile_id long, list_id long")
    assert "regexp" not in plan(S.scored_rows(lines, asked, B.dimension(spark, SF), B.profiles(spark, SF)))


def test_marks_of_a_profile(spark):
    """Fixed codes count by their triggers, others by code or text; a term without letters has no code and still is a text."""
    blank = {"skin_type": None, "skin_sensitivity": None, "concerns": [], "goals": [], "allergies": ["FRAGRANCE", "ring"], "avoid_ingredients": ["SILICONES"]}
    types = "profile_id long, skin_type string, skin_sensitivity string, concerns array<string>, goals array<string>, allergies array<string>, avoid_ingredients array<string>, other_allergy string, other_avoid string"
    profiles = spark.createDataFrame([(7, *blank.values(), "Gold; %%", "red ring"), (8, *blank.values(), None, "%%, blue")], types)
    dim = B.raw_dim(spark, SF).limit(1).selectExpr("* EXCEPT (ingredient_id, name, inci_name, tags, aliases)", "1L AS ingredient_id", "'Red Ring 5%%' AS name", "'Red Ring 5%%' AS inci_name", "array('fragrance') AS tags", "array('x') AS aliases")
    lines = spark.createDataFrame([(1, 0, "Red Ring", 1), (1, 1, "what", None)], "list_id long, position int, display_name string, ingredient_id long")
    asked = spark.createDataFrame([(7, 1), (8, 1), (9, 1)], "profile_id long, list_id long")
    rows = S.scored_rows(lines, asked, dim, profiles).select("profile_id", "position", "allergy_hits", "avoid_hits").collect()
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    assert got[7, 0] == (["FRAGRANCE", "RING", "%%"], ["red ring"]) and got[8, 0] == (["FRAGRANCE", "RING"], ["%%"])
    assert got[9, 0] == ([], []) and all(got[p, 1] == ([], []) for p in (7, 8, 9))


def test_messages_are_kept_by_hash_in_order(spark):
    rows = [(7, 1, 3, 10, ["b", "a"]), (7, 1, 1, 10, ["c", "a"]), (7, 1, 9, 5_000_000, ["z"]), (7, 1, 0, 0, ["y", "z"]), (7, 2**40, 2**31 - 1, 0, ["q", "p"])]
    said = spark.createDataFrame(rows, "profile_id long, list_id long, position int, penalty long, safety_reasons array<string>")
    top = S.top_messages(said, "safety_reasons", "penalty", 4)
    assert "SortAggregate" not in plan(top)
    got = {(r["list_id"], r["rank"]): r["message"] for r in top.collect()}
    assert got == {(1, 1): "z", (1, 2): "c", (1, 3): "a", (1, 4): "b", (2**40, 1): "q", (2**40, 2): "p"}


def test_safety_notes_read_lines_scored_before(spark):
    """One task held the sorted lines and profiles of the join and the messages at once."""
    assert "lineitem" not in plan(entry.queries()["f8_safety_notes"](spark, SF))


def test_catalogue_reads_stored_lines(spark):
    """The whole answer derived the lists from the line items three times."""
    lines = spark.createDataFrame([(11992,), (11992,)], "list_id long")
    assert "lineitem" not in plan(Q.catalogue(spark, SF, lines))


def test_profiles_are_not_broadcast(spark):
    """Sizes guessed from the files of profiles sent 544 MB through the driver."""
    asked = spark.createDataFrame([(1, 1), (1, 2), (-5, 3)], "profile_id long, list_id long")
    met = S.asked_contexts(asked, B.profiles(spark, SF))
    assert "Broadcast" not in plan(met) and {(r["profile_id"], r["list_id"]) for r in met.collect()} == {(1, 1), (1, 2), (-5, 3)}


def test_lists_are_dealt_packed(spark, monkeypatch):
    """One row for each line of each way of looking at a list was stored, and dealt twice."""
    rows, stored = {}, S.kept

    def noted(df, name, *settings):
        rows[name] = stored(df, name, *settings)
        return rows[name]

    monkeypatch.setattr(S, "kept", noted)
    for k, v in (("PACK", 4), ("PART", 3), ("TASK", 5)):
        monkeypatch.setattr(S, k, v)
    dim, profiles = B.dimension(spark, SF), B.profiles(spark, SF).where("profile_id < 40")
    twins = profiles.unionByName(profiles.selectExpr("profile_id + 1000 AS profile_id", "* EXCEPT (profile_id)"))
    known = [r["ingredient_id"] for r in dim.select("ingredient_id").orderBy("ingredient_id").limit(5).collect()]
    lines = [(i, p, "x", [*known, None][(i * p + p) % 6]) for i in range(12) for p in range(11)] + [(None, 0, "x", known[0])]
    lines = spark.createDataFrame(lines, "list_id long, position int, display_name string, ingredient_id long")
    asked = [(p + t, i) for p in (1, 2, 3) for t in (0, 1000) for i in range(13)] + [(1, 0), (None, 1), (7777, 1), (2, None)]
    asked = spark.createDataFrame(asked, "profile_id long, list_id long")
    want = S.pair_scores(S.scored_rows(lines, asked, dim, twins)).where("profile_id <> 7777")
    got = S.score_all(lines, asked, dim, twins)
    columns = ["profile_id", "list_id", "line_count", "unknown_count", "safety_score", "suitability_score"]
    found = sorted(tuple(r) for r in got.select(*columns).collect())
    assert found == sorted(tuple(r) for r in want.select(*columns).collect()) and len(found) == 6 * 12
    # 26 requests of a signature, at most 3 to a part
    assert rows["asked-lists"].count() == 3 * 12 * 3 and 1 < len({r["part"] for r in rows["asked-lists"].collect()}) <= 9
    assert rows["asked"].select("signature").distinct().count() == 3 and "asked-lines" not in rows


def test_unpacked_lines_are_not_dealt(spark):
    lines = spark.createDataFrame([(1, 0, "x", None)], "list_id long, position int, display_name string, ingredient_id long")
    rows, _ = S.contributions(lines, spark.createDataFrame([(1, 1)], "profile_id long, list_id long"), B.dimension(spark, SF), B.profiles(spark, SF))
    [spark.conf.set(k, v) for k, v in S.DEALT.items()]
    try:
        text = plan(S.signature_scores(rows))
    finally:
        [spark.conf.unset(k) for k in S.DEALT]
    assert text.count("Exchange hashpartitioning") == 2 == text.count("REPARTITION_BY_NUM")


def test_kinds_of_messages_are_shuffled_apart(spark):
    """All messages of all kinds lay on disk at once, each dealt twice; the packed answers read the few that were stored."""
    rows = [
        (7, 1, 0, 5, ["a", "b"], 9, ["s1", "s2"], 3, ["n1"]), (7, 1, 1, 8, ["c", "a"], 9, ["s3", "s1"], 4, ["n2", "n3"]),
        (7, 1, 2, 1, ["d", "e", "f"], 0, [], 9, ["n4"]), (7, 2, 0, 0, [], 0, [], 0, []), (8, 1, 4, 2, ["a"], 0, None, 1, ["n1"]),
    ]
    types = "profile_id long, list_id long, position int, positive long, positive_reasons array<string>, penalty long, safety_reasons array<string>, negative long, negative_reasons array<string>"
    packed = S.pros_and_cons(spark.createDataFrame(rows, types))
    assert plan(packed).count("Exchange hashpartitioning") == 1
    got = {(r["profile_id"], r["list_id"]): (r["pros"], r["cons"]) for r in packed.collect()}
    assert got == {(7, 1): ("c | a | b | d | e", "s1 | s2 | s3 | n4 | n2"), (8, 1): ("a", "n1")}
