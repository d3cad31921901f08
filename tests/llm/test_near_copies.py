"""The near-copy stage of the pipeline against brute-force Jaccard."""

import random

import corpus_pipeline
from inciflow.llm import near_copies, simhash
from tests.conftest import SF
from tests.llm.fixtures import nasty


def brute_kept(rows, shingle=5):
    """Smallest ids of the components of pairs with a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for x, (d, _) in zip(label, rows, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(least.values())


def edited(spark):
    """A text with edits, a chain that only its neighbours hold together, and texts of their own."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        for e in range(5):
            new = list(base)
            for _ in range(e * g // 4):
                new[rng.randrange(len(new))] = word()
            rows.append((100 * g + e, " ".join(new)))
    chain = [word() for _ in range(200)]
    for i in range(30):
        chain[(7 * i) % 200] = word()
        rows.append((5000 + i, " ".join(chain)))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_stage_keeps_one_of_texts_at_0_8(spark):
    docs, rows = edited(spark)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    want = brute_kept(rows)
    assert len(want) < len(rows) and sorted(r["doc_id"] for r in kept.collect()) == want


def test_stage_finds_the_pairs_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == want


def test_large_buckets_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 3)
    docs, rows = edited(spark)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)


def test_odd_rows(spark):
    rows = near_copies.groups(nasty(spark)).collect()
    assert len(rows) == nasty(spark).count() and near_copies.groups(nasty(spark).limit(0)).count() == 0
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[0] == found[1] == found[2] == found[23] == 0 and found[20] == found[21] == found[24] == 20 and found[4] == 3


def test_stage_takes_the_links_of_simhash(spark):
    """Two texts at a similarity of 0.7 whose fingerprints differ by at most 3 bits: SimHash links them, the bands don't."""
    docs, rows = edited(spark)
    two = [r for r in rows if r[0] in (5005, 5012)]
    assert brute_kept(two) == [5005, 5012]
    fps = [simhash.fingerprint(t.encode(), 3) % 2**64 for _, t in two]
    assert (fps[0] ^ fps[1]).bit_count() <= 3
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.filter("doc_id IN (5005, 5012)"), SF)
    assert [r["doc_id"] for r in kept.collect()] == [5005]
