"""Requests that name a product of the catalogue, and the messages of an answer."""

from inciflow.operators.score import pros_and_cons
from inciflow.plans.formula_queries import catalogue_requests


def test_products_bring_their_own_list(spark):
    products = spark.createDataFrame(
        [(7, "Calm Serum", "Maker", 70), (3, "calm serum", "Older", 30), (9, None, "Nobody", 90), (4, "Day Cream", None, 40)],
        "product_id long, name string, brand string, product_list long",
    )
    asked = spark.createDataFrame(
        [(1, 100, " CALM SERUM "), (2, 200, None), (3, 300, "Calm Serum refill"), (4, 400, "day cream"), (4, 400, "day cream"), (5, None, "")],
        "profile_id long, list_id long, product_name string",
    )
    rows = [tuple(r) for r in catalogue_requests(asked, products).collect()]
    manual = ("manual-input", "Manual Input", "Manual Input")
    want = [
        (1, 30, 3, "calm serum", "catalog-verified", "Older", "Older"),
        (2, 200, None, None, *manual),
        (3, 300, None, "Calm Serum refill", *manual),
        (4, 40, 4, "day cream".title(), "catalog-verified", None, None),
        (4, 40, 4, "Day Cream", "catalog-verified", None, None),
        (5, None, None, "", *manual),
    ]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert catalogue_requests(asked, products.limit(0)).where("product_id IS NOT NULL").count() == 0


def test_cons_are_safety_notes_first(spark):
    rows = [
        (1, 1, 0, 10, ["a", "b"], 5, ["s0"], 1, ["n0"]),
        (1, 1, 1, 90, ["c", "a"], 9, ["s1", "s0"], 2, ["n1", "n2", "n3", "n4"]),
        (1, 2, 0, 1, [], 0, [], 0, []),
        (2, 1, 0, 1, None, 0, None, 3, ["n"]),
    ]
    scored = spark.createDataFrame(
        rows,
        "profile_id long, list_id long, position int, positive long, positive_reasons array<string>, penalty long, safety_reasons array<string>, "
        "negative long, negative_reasons array<string>",
    )
    got = {(r["profile_id"], r["list_id"]): (r["pros"], r["cons"]) for r in pros_and_cons(scored).collect()}
    assert got == {(1, 1): ("c | a | b", "s1 | s0 | n1 | n2 | n3"), (2, 1): ("", "n")}
