"""Operators on DataFrame functions alone: brute force on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from inciflow.llm import fingerprint, line_dedup, mixing, sharding
from inciflow.llm.common import attach
from tests.llm.fixtures import LINE, NASTY, nasty

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_attach_finds_hot_and_cold_keys(spark):
    left = spark.range(2000).selectExpr("id", "if(id < 700, 1, id) AS k").unionByName(spark.sql("SELECT 5000L AS id, CAST(NULL AS BIGINT) AS k"))
    right = left.groupBy("k").count().filter("k IS NOT NULL AND k % 2 = 1").selectExpr("k", "count AS n", "k * 10 AS v")
    rows = {r["id"]: r["v"] for r in attach(left, right, ["k"], "n", 10, ["id"]).collect()}
    assert len(rows) == 2001 and rows[5000] is None
    assert all(v == (10 if i < 700 else i * 10 if i % 2 else None) for i, v in rows.items() if i < 2000)


@pytest.mark.parametrize("min_docs", [5, 2])
def test_lines(spark, min_docs):
    rows = line_dedup.dedup_lines(nasty(spark), 40, min_docs).select("doc_id", "text", "kept", "n_lines", "n_dropped").collect()
    holders = defaultdict(set)
    for d, t in NASTY:
        for line in (t or "").split("\n"):
            if len(k := lower(line.strip(BLANK))) >= 40:
                holders[k].add(-1 if d is None else d)
    frequent = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    want = []
    for d, t in NASTY:
        lines = (t or "").split("\n")
        stay = [x for x in lines if frequent.get(lower(x.strip(BLANK)), d) == d]
        want.append((d, t, "\n".join(stay), len(lines), len(lines) - len(stay)))
    order = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)
    assert any(r["n_dropped"] for r in rows)


def test_line_runs_admit_each_line_once(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    lines = line_dedup.hashed_lines(nasty(spark).filter("doc_id >= 10 AND doc_id < 17"), 40)
    got = [runs.admit(lines.filter(f"doc_id = {d}")).count() for d in range(10, 15)]
    assert got == [2, 0, 0, 0, 0]  # the line stands twice in the first document
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.all().count() == 1


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_line_runs_hold_each_line_once_and_count_all_batches(spark, fanout):
    runs, want = line_dedup.LineRuns(spark, fanout=fanout), defaultdict(set)
    for batch in range(6):
        rows = [(10 * batch + i, (batch * i) % 7, i % 3) for i in range(10)] + [(None if batch == 2 else 99 + batch, 1, 1)]
        for d, a, b in rows:
            want[(a, b)].add(d)
        runs.add(spark.createDataFrame(rows + rows[:3], "doc_id long, h1 long, h2 long"))
    held = [(r["h1"], r["h2"]) for level in runs.levels for p in level for r in runs._read([p]).collect()]
    assert sorted(held) == sorted(want)
    got = {(r["h1"], r["h2"]): (r["n_docs"], r["max_doc"]) for r in runs.all().collect()}
    assert got == {k: (len(v), max(x for x in v if x is not None)) for k, v in want.items()}


def test_no_rows(spark):
    none = nasty(spark).limit(0)
    assert line_dedup.dedup_lines(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert sharding.balanced_shards(none).count() == 0
    assert fingerprint.fingerprints(none).count() == 0


def test_mix_on_odd_rows(spark):
    docs = nasty(spark)
    rows = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in NASTY)
    words = sum(len((t or "").encode().split()) for _, t in NASTY)
    assert sum(r["size"] for r in rows) == words
    assert sum(r["taken"] for r in rows) == int(1.5 * words)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.filter("trim(text) = ''").count() == 0


def test_targets_share_the_excess(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("é", 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals, (5, 2, 1), 1.5, 2).collect()}
    # a: 5, b: 2, é: 1, null: 5; caps 20, 2000, 180, 1000; budget 2400
    assert got == {"a": 20.0, None: 1000.0, "é": 180.0, "b": 1200.0}


def test_shards(spark):
    docs = nasty(spark).unionByName(nasty(spark).filter("doc_id = 3").crossJoin(spark.range(60).select("id")).drop("id"))
    rows = sharding.balanced_shards(docs, 4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    n = len(NASTY) + 60
    assert sorted(map(len, by.values())) == sorted([n // 4 + (i < n % 4) for i in range(4)])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in NASTY)
    want[(3, 19, zlib.crc32(b"one"))] += 60
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_equal_texts_share_a_shard(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', if(id % 4 = 0, id, id % 300)) AS text")
    rows = sharding.balanced_shards(docs, 8).collect()
    shards = defaultdict(set)
    for r in rows:
        if r["hub"] is not None:
            shards[r["text_crc32"]].add(r["shard"])
    assert sum(len(v) == 1 for v in shards.values()) >= 0.95 * len(shards)


def test_fingerprints(spark):
    rows = fingerprint.fingerprints(nasty(spark)).collect()
    order = sorted(NASTY, key=lambda x: (x[0] is not None, x[0] or 0))
    texts = [t or "" for _, t in order]
    want = Counter()
    for i, (d, t) in enumerate(order):
        t, after = t or "", texts[(i + 1) % len(texts)]
        half = len(t) // 2
        want[(d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    prints = defaultdict(set)
    text_of = dict(NASTY)
    for r in rows:
        prints[text_of[r["doc_id"]] or ""].add(r["fingerprint"])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert all(len(v) == 1 for v in prints.values())
    near = {r["doc_id"]: r for r in rows}
    assert near[3]["near_next"] == 1 and near[0]["near_next"] == 1
    assert near[20]["near_edited"] > 0.3 > near[24]["near_next"]


def test_peeling_recovers_the_difference(spark):
    """Sketches of two sets give what a plain comparison gives, whatever the share in common."""
    sets = [(list(range(0, a)), list(range(a - c, a - c + b))) for a, b, c in ((0, 0, 0), (5, 0, 0), (9, 9, 9), (40, 40, 38), (400, 380, 200), (3000, 2000, 10))]
    df = spark.createDataFrame(sets, "x array<long>, y array<long>").selectExpr("transform(x, v -> xxhash64(v)) AS x", "transform(y, v -> xxhash64(v)) AS y")
    df = df.withColumn("d", fingerprint.difference(df["x"], df["y"]))
    df = df.withColumn("near", fingerprint.likeness(df["x"], df["y"], df["d"]))
    for r in df.collect():
        assert sorted(k for k, n in r["d"] if n == 1) == sorted(set(r["x"]) - set(r["y"]))
        assert sorted(k for k, n in r["d"] if n == -1) == sorted(set(r["y"]) - set(r["x"]))
        assert r["near"] == (1 - len(set(r["x"]) ^ set(r["y"])) / (len(r["x"]) + len(r["y"])) if r["x"] or r["y"] else 1.0)


def test_line_of_the_fixture_is_long():
    assert len(LINE) >= 40
