"""Operators that work in Arrow batches: brute force, round trips and held-out accuracy."""

import io
import math
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from inciflow.llm import ann, lm_scoring, quality, simhash, warc
from tests.conftest import SF
from tests.llm.fixtures import NASTY, nasty


def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """The smallest id reachable, for a list of (id, fingerprint)."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for x, (d, _) in zip(label, prints, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [least.get(x) for x in label]


def test_simhash_on_odd_rows(spark):
    rows = simhash.near_duplicates(nasty(spark)).collect()
    short = [(d, brute_fingerprint(t)) for d, t in NASTY]
    want = Counter((d, f, c) for (d, f), c in zip(short, brute_components(short, 3), strict=True))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(nasty(spark).limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(nasty(spark)).collect()]
    assert set(kept) == {c for _, _, c in want if c is not None} | {d for d, _, c in want if c is None}


@pytest.mark.parametrize("chunk", [4096, 8])
def test_links_have_the_components_of_all_pairs(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).tolist()
    near = [b ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(6)]
    fps = sorted(set(base + near))
    signed = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    labels = {r["node"] % 2**64: r["label"] % 2**64 for r in simhash.components(simhash.links(signed, 3, 5, 16)).collect()}
    want = brute_components([(i, f) for i, f in enumerate(fps)], 3)
    groups = defaultdict(set)
    for f, c in zip(fps, want, strict=True):
        groups[c].add(labels.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_long_chains_have_one_label(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    labels = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert labels == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_lm_counts_and_base(spark):
    rows = lm_scoring.score_documents(nasty(spark)).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    texts = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in NASTY]
    counts = Counter(w for d, ws in texts if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, ws in texts:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[(d, held(d), len(ws), sum(w in counts for w in ws), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lm_scoring.score_documents(nasty(spark).limit(0)).count() == 0
    alone = lm_scoring.score_documents(nasty(spark).filter("doc_id = 2")).collect() + lm_scoring.score_documents(nasty(spark).filter("doc_id = 0")).collect()
    assert all(math.isfinite(r["score"]) for r in alone)


def test_lm_probabilities_add_up(spark):
    """Over every token of the vocabulary and one unseen token per class, after any context."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    counts = lm_scoring.token_counts(docs).cache()
    voc = lm_scoring.vocabulary(counts)
    p = lm_scoring.train_round(docs, voc, lm_scoring.Parameters.start(voc.noise()), 0.3)
    inside = defaultdict(float)
    short = list(voc.code)[: voc.shortlist]
    for r in counts.collect():
        t = bytes(r["token"])
        if t not in short:
            k = lm_scoring.class_of_rest(t)
            inside[k] += (r["c"] + 0.5) / (voc.class_total[k] + 0.5 * (voc.class_distinct[k] + 1))
    for k in range(lm_scoring.CLASSES):
        unseen = 0.5 / (voc.class_total[k] + 0.5 * (voc.class_distinct[k] + 1))
        assert inside[k] + unseen == pytest.approx(1)
    for context in ([voc.classes, voc.classes], [0, 5], [voc.classes - 1, 3]):
        log = lm_scoring.class_log10(p, np.array([context] * voc.classes), np.arange(voc.classes))
        assert (10**log).sum() == pytest.approx(1)


def test_lm_beats_counts_on_held_out_documents(spark):
    rows = lm_scoring.score_documents(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


def reader(data):
    return lambda at, n: data[at : at + n]


def test_directories_of_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(5):
            with z.open(zipfile.ZipInfo(f"a/{i}"), "w", force_zip64=i % 2 == 0) as f:
                f.write(bytes([i]) * i)
        z.comment = b"comment with PK\x05\x06 in it"
    data = out.getvalue()
    members = warc.directory(reader(data), len(data))
    assert list(members) == [f"a/{i}" for i in range(5)]
    for i, m in enumerate(members.values()):
        at = warc.data_offset(reader(data), m)
        assert data[at : at + m.size] == bytes([i]) * i
    # the same with a ZIP64 end record and values that stand in ZIP64 fields alone
    entries, length, offset = warc.end_of_directory(reader(data), len(data))
    body = data[: offset + length]
    end64 = struct.pack("<4sQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, entries, entries, length, offset)
    locator = struct.pack("<4sIQI", warc.LOCATOR64, 0, len(body), 1)
    end = struct.pack("<4sHHHHIIH", warc.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    large = body + end64 + locator + end
    assert warc.directory(reader(large), len(large)) == members
    for bad in (b"", b"PK", large[:-30], body):
        with pytest.raises((warc.BadPackage, struct.error)):
            warc.directory(reader(bad), len(bad))


def test_warc_round_trip_on_odd_pages(spark):
    long = "<p>" + "y" * 120
    pages = [(1, "http://a", long), (2, None, long), (3, "http://c\r\nx: y", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "é", "é" * 60), (8, "u", "é" * 60), (9, "u", "z" * 300_000), (None, "n", "none"), (9, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*p, "x", 0) for p in pages], "page_id long, url string, html string, digest string, n int")
    rows = warc.round_trip(spark, df).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in rows)
    first = {2: 1, 8: 7}
    want = Counter((i, len((h or "").encode()), "revisit" if i in first else "response", first.get(i), None if i in first else h or "") for i, _, h in pages)
    assert got == want
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_records_carry_what_the_format_asks_for(spark, tmp_path):
    long = "<p>" + "y" * 120
    df = spark.createDataFrame([(1, "http://a", long), (2, None, long), (3, "http://c", None)], "page_id long, url string, html string")
    listed = warc.write_packages(df.coalesce(1), f"file://{tmp_path}").collect()
    assert warc.write_packages(df.limit(0), f"file://{tmp_path}").count() == 0
    records = {}
    for r in listed:
        data = (tmp_path / r["path"]).read_bytes()
        for fields, block in warc.read_package(reader(data), len(data)):
            records[fields["warc-record-id"]] = (fields, block)
    assert len(records) == 3
    for fields, block in records.values():
        assert fields["warc-date"] == warc.DATE and fields["warc-target-uri"] and int(fields["content-length"]) == len(block)
    first, second, third = (records[f"<urn:page:{i}>"] for i in (1, 2, 3))
    assert first[0]["content-type"] == "application/http; msgtype=response"
    head, _, body = first[1].partition(b"\r\n\r\n")
    assert head.startswith(b"HTTP/1.1 200 ") and b"Content-Length: 123" in head and body.decode() == long
    assert second[0]["warc-profile"].endswith("/revisit/identical-payload-digest") and second[0]["warc-refers-to"] == "<urn:page:1>" and not second[1]
    assert warc.http_payload(third[1]) == b"" and third[0]["warc-type"] == "response"
    with pytest.raises(warc.BadPackage):
        warc.http_payload(b"<p>bare html")


def test_hilbert_neighbours_touch():
    axes, bits = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(8)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = ann.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = ann.search(docs).collect()
    all_rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in docs.collect()]
    hits = total = 0
    found = defaultdict(dict)
    for r in rows:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    for q, v in all_rows:
        if q % 20 == 0:
            best = sorted(((-float((v * x).sum()), i) for i, x in all_rows if i != q))[:20]
            got = found[q]
            assert sorted(got) == list(range(1, len(best) + 1))
            assert all(a[1] >= b[1] for a, b in zip(list(map(got.get, sorted(got))), list(map(got.get, sorted(got)))[1:], strict=False))
            hits += len({i for _, i in best} & {i for i, _ in got.values()})
            total += len(best)
    assert hits >= 0.9 * total


def test_neighbours_of_odd_vectors(spark):
    same = [(i, [1.0, 0.0]) for i in range(0, 60)]
    odd = [(100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0]), (120, [0.5, 0.5]), (None, [1.0, 1.0]), (120, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in same + odd], "vec_id long, embedding array<float>, label int, pos int")
    rows = ann.search(df).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [i for i, _ in by[40]] == list(range(20)) and [i for i, _ in by[0]] == list(range(1, 21))
    assert {len(v) for v in (by[0], by[20], by[40])} == {20} and len(by[120]) == 40  # two rows of 120 are two queries
    assert ann.search(df.filter("vec_id > 100 AND vec_id < 106")).count() == 0


@pytest.fixture(scope="module")
def labelled():
    con = duckdb.connect()
    at = SF.replace("0.001", "0.1")
    rows = con.execute(f"SELECT encode(text), CASE WHEN toxic > 0 THEN 0 ELSE quality + 1 END FROM read_parquet('{at}/documents.parquet') d JOIN read_parquet('{at}/labels.parquet') l USING (doc_id) ORDER BY doc_id").fetchall()
    return [bytes(r[0]) for r in rows], np.array([r[1] for r in rows])


def test_held_out_grades(labelled):
    texts, grade = labelled
    features = quality.Features()
    rows = [quality.as_array(features.of(t)) for t in texts]
    half = len(rows) // 2
    model = quality.fit(rows[:half], grade[:half])
    assert (np.diff(model.threshold) > 0).all()
    score = model.scorer()
    tails = model.tails(np.array([score(t) for t in texts[half:]]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    keep, g = tails[:, -1] >= 0.5, grade[half:]
    assert keep[g == 2].mean() > 0.98 and keep[g == 0].mean() < 0.08 and keep[g == 1].mean() < 0.25


def test_quality_on_odd_rows(spark):
    docs = nasty(spark)
    labels = spark.createDataFrame([(d, i % 2, int(i % 7 == 0), "x") for i, (d, _) in enumerate(NASTY)] + [(3, None, 0, "x"), (777, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    graded = quality.grade_documents(docs, quality.train(docs, labels)).collect()
    assert len(graded) == len(NASTY) and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in graded)
    assert quality.select_good(docs, labels.limit(0)).select(docs.columns).count() == len(NASTY)
    assert quality.select_good(docs.limit(0), labels).count() == 0


def test_repeats_of_one_id_do_not_push_out_other_neighbours(spark):
    # 40 rows of one id and nine other ids share a vector: queries of that id must find the others
    rows = [(0, [1.0, 0.0])] * 40 + [(i, [1.0, 0.0]) for i in range(1, 10)] + [(20 + i, [0.5, 0.1 * i]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(vectors, k=5).filter("query_id = 0").select("rank", "vec_id").collect()
    assert sorted({(r["rank"], r["vec_id"]) for r in found}) == [(i, i) for i in range(1, 6)]
    other = ann.search(vectors, k=5).filter("query_id = 20").select("rank", "vec_id").collect()
    assert len(other) == 5 and {r["vec_id"] for r in other} == {0}


def test_fit_does_not_depend_on_how_rows_are_dealt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.train(docs.repartition(n), labels.repartition(n)) for n in (3, 11))
    assert (a.weight == b.weight).all() and (a.threshold == b.threshold).all() and len(a.index)


def test_grades_stand_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "y", "z")], "doc_id long, text string, _text string, expected_grade string, tail_probability string")
    got = quality.grade_documents(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got.columns == ["doc_id", "text", "_text", "expected_grade", "tail_probability"] and got.first()["_text"] == "x"
