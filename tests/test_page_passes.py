"""Passes over many pages: small batches, nothing evaluated twice, tasks by rows."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from inciflow.functions import text as T
from inciflow.operators import markup as M
from inciflow.operators import pages as P
from inciflow.sources import tables


def test_json_goes_back_in_small_batches():
    body = json.dumps({f"k{j}": "x" for j in range(10)})
    blocks = pa.RecordBatch.from_pylist([{"page_id": i, "block_ord": 0, "block": "b", "body": body} for i in range(500)])
    asked = []

    def batches():
        for _ in range(3):
            asked.append(blocks)
            yield blocks

    out = M._json_batches(batches())
    assert next(out).num_rows <= M.OUT_ROWS and len(asked) == 1
    assert sum(b.num_rows for b in out) + M.OUT_ROWS == 15000


def test_trees_leave_no_circles():
    tree = M._Tree()
    tree.feed("<div><nav><p>a</p></nav><section><h2>Ingredients</h2><p>b</p></section></div>")
    inner = list(tree.root.walk())
    M._prune(tree.root)
    M._loosen(tree.root)
    assert len(inner) > 5 and all(n.parent is None for n in inner)


def test_conditions_evaluate_their_text_once(spark):
    df = spark.createDataFrame([("Water, Glycerin, Panthenol oil",), ("short",), (None,)], "t string")
    for test, step in ((P.plausible_dom, r"\x{2022}\x{B7}])"), (P.plausible_text, "about this item")):
        plan = df.select(test(F.col("t")).alias("ok"))._jdf.queryExecution().analyzed().toString()
        assert plan.count(step) == 1, plan
    assert [r[0] for r in df.select(P.plausible_dom(F.col("t"))).collect()] == [True, False, None]
    assert [r[0] for r in df.select(T.bound(F.col("t"), lambda x: F.concat(x, x))).collect()] == ["Water, Glycerin, Panthenol oil" * 2, "short" * 2, None]


def test_tasks_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_TEXTS", 50)
    df = spark.range(0, 5000, 1, 2).select(F.col("id").alias("page_id"))
    assert tables.spread(df, "page_id").rdd.getNumPartitions() == 100
    assert tables.spread(df.repartition(200), "page_id").rdd.getNumPartitions() == 200


def test_dom_text_as_in_four_steps(spark):
    texts = ["a ,\t\t b", " , ;x|  y•\n\nz·", "no\t   sep", ",", "  ", "", "a ,,  ;b ,", "a　• ;", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    x = F.regexp_replace(F.regexp_replace("t", "\xa0", " "), "[ \t]+", " ")
    old = T.ws(T.sub_all(x, r"\s*([,;|\x{2022}\x{B7}])\s*", "$1 "))
    assert all(a == b for a, b in df.select(T.dom_text(F.col("t")), old).collect())
