"""The learning loop in stages: a product that was learned is answered without an attempt."""

from pyspark.sql import functions as F

from inciflow.operators import store as KB
from inciflow.streaming import learning as LE

LIST = "Water, Glycerin, Niacinamide, Panthenol, Xanthan Gum, Trehalose, Menthol, Citric Acid"
BAD = "Buy now, Free shipping"


def _describe(pages):
    empty = F.lit("")
    kind = F.coalesce(F.element_at(F.split("name", " "), -1), empty)  # without variant and category the brand alone is an alias key
    return pages.select("request_id", "brand", "name", F.col("name").alias("canonical_name"), empty.alias("variant"), empty.alias("size"), kind.alias("category"), empty.alias("sku"))


def _extract(pages):
    return pages.select("request_id", F.posexplode("lists").alias("i", "raw_text")).select(
        "request_id", F.lit("dom-container").alias("method"), F.concat(F.lit("list "), F.col("i")).alias("label"), "raw_text"
    )


def test_learned_products_are_hits_and_a_repeated_batch_replaces_itself(spark, starter, tmp_path):
    schema = "request_id long, ord long, url string, brand string, name string, lists array<string>"
    pages = [
        (1, 1, "https://a.example/1", "Acme", "Gel Wash", [BAD, LIST]),
        (2, 2, "https://b.example/1", "Acme", "Gel Wash", [LIST]),  # the same product, later in the batch
        (3, 3, "https://a.example/2", "Acme", "Other Balm", [BAD]),
        (4, 4, None, None, None, []),
        (5, 5, "https://a.example/old", "Acme", "Old", [LIST]),  # in the cache
    ]
    again = [
        (11, 11, "https://a.example/1", "Acme", "Gel Wash", [LIST]),  # cached by then
        (12, 12, "https://c.example/9", "ACME", "gel wash", [LIST]),  # another address of the learned product
        (13, 13, "https://c.example/2", "Acme", "Other Balm", [BAD, LIST]),  # failed before, so it is tried again
    ]
    seed = {name: spark.createDataFrame([], schema) for name, schema in LE.TABLES.items()}
    seed["cache"] = spark.createDataFrame([("https://a.example/old",)], "url string")
    base = str(tmp_path / "kb")
    for batch, rows in ((0, pages), (1, again), (1, again)):
        LE.learn_batch(spark.createDataFrame(rows, schema), _describe, _extract, starter, LE.known(seed, base, batch), base, batch)
    rows = {r["request_id"]: (r["source"], r["attempts"], r["verified"]) for r in KB.committed(spark, base, "outcome").collect()}
    assert rows == {
        1: (rows[1][0], rows[1][1], True), 2: ("memory", 0, True), 3: ("none", 1, False), 4: ("none", 0, False), 5: ("cache", 0, True),
        11: ("cache", 0, True), 12: ("database", 0, True), 13: rows[13],
    }
    assert rows[1][0] == rows[13][0] == "extraction" and rows[1][1] in (1, 2) and rows[13][2]
    log = KB.committed(spark, base, "attempt")
    assert {r["request_id"] for r in log.select("request_id").distinct().collect()} == {1, 3, 13}
    assert log.where("verified").count() == 2 and log.where("request_id = 3 AND verified").count() == 0
    assert KB.committed(spark, base, "formula").count() == 2
    assert KB.committed(spark, base, "outcome").count() == len(pages) + len(again)
