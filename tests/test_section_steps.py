"""Section trimming: literal steps in place of patterns that are tried at every character."""

import re

from pyspark.sql import functions as F

from inciflow.functions import text as T


def test_sections_of_odd_white_space_and_commas(spark):
    rows = [
        ("　 a  ,\t b ,, c ﻿", "a, b, , c"),
        (" ,a, ", ", a,"),
        ("Full Ingredients : Aqua ,Glycerin Directions: rinse", "Full Aqua, Glycerin"),
        ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(rows)], "i int, t string, want string")
    assert {r.i: r.got for r in df.select("i", T.page_section(F.col("t")).alias("got")).collect()} == {i: w for i, (_, w) in enumerate(rows)}


def test_ends_and_commas_need_no_pattern(spark):
    """Patterns for white space at the ends and around commas cost more than all others together."""
    df = spark.createDataFrame([("a",)], "t string")
    for step in (T.strip, T.label_section, T.page_section, T.dom_section):
        plan = df.select(step(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert "\\z, " not in plan and not re.search(r"\]\*,\[", plan), plan
