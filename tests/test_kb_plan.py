"""The knowledge base lookup sends no table through the driver."""

from inciflow.operators import store as KB


def test_lookup_broadcasts_nothing(spark):
    requests = spark.createDataFrame([(1, "f", "b", "n", ["k"]), (2, "x", "b", "n", ["k"]), (3, "x", "", "", ["k", "l"])], "request_id long, fingerprint string, brand string, canonical_name string, keys array<string>")
    products = spark.createDataFrame([("f", "b", "n", 1)], "fingerprint string, brand string, canonical_name string, updated_at int")
    formulas = spark.createDataFrame([("f", 7, 0.5, "d")], "fingerprint string, formula_id long, confidence double, verified_at string")
    aliases = spark.createDataFrame([("l", "f")], "alias_key string, fingerprint string")
    found = KB.kb_lookup(requests, products, formulas, aliases)
    assert sorted((r.request_id, r.source, r.formula_id) for r in found.collect()) == [(1, "database", 7), (2, "database-alias", 7), (3, "memory-alias", 7)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
