"""The audit against a plain replay of every order, document by document."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from inciflow.llm import filter_audit
from tests.llm.fixtures import NASTY, nasty

LABELS = [(3, 1, 0), (4, 0, 1), (4, 1, 0), (5, 0, 1), (6, 1, 1), (20, 1, 0), (24, None, 1), (None, 1, 1), (99, 1, 1), (21, 1, None)]


def fails(doc_id, text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    return out + "D" * bool(re.search("[#$%&*|]", text)) + "E" * (doc_id is not None and least.get(text, doc_id) < doc_id)


def replay(docs, labels):
    least, out = {}, {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    judged = [(d, lang or "", fails(d, t or "", least)) for d, t, lang in docs]
    for part in {p for _, p, _ in judged}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for d, p, f in judged if p == part]
            for step, own in enumerate(order, 1):
                gone = [(d, f) for d, f in left if own in f]
                left = [(d, f) for d, f in left if own not in f]
                failing = [f for _, p, f in judged if p == part and own in f]
                shapley[own] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(f == own for f in failing), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return Counter((*k, *v) for k, v in out.items())


def test_same_as_a_replay_of_every_order(spark):
    langs = ["en", None, "", "de"]
    docs = [(d, t, langs[i % 4]) for i, (d, t) in enumerate(NASTY)] + [(30, "A #", "fr"), (31, "A #", "fr"), (None, "A #", "fr"), (30, "A #", "fr"), (32, "aB " * 200, "fr"), (33, "w | x", "en")]
    extra = "lang string, mask int, n long, good int, toxic int, digest string, own int, met long, part string, first int"
    table = spark.createDataFrame([(d, t, lang, 1, 2, 3, 4, "x", 5, 6, "y", 7) for d, t, lang in docs], f"doc_id long, text string, {extra}")
    labels = spark.createDataFrame([(*r, "z", 1) for r in LABELS], "doc_id long, quality int, toxic int, part string, good int")
    got = filter_audit.audit(table, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == replay(docs, LABELS) and len(rows) == 600 * 4


def test_nasty_rows_and_empty_tables(spark):
    docs, labels = nasty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Counter(tuple(r) for r in filter_audit.audit(docs, labels).collect()) == replay([(d, t, "en") for d, t in NASTY], [])
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def test_a_part_has_at_most_32_cells_however_many_copies(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    cells = filter_audit.mask_cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("n > 0").collect()
    assert {(r["mask"], r["n"]) for r in cells} == {(1, 2001), (17, 1999)}
