"""Alignment against a plain loop over bytes, and its corpus-wide counts against dictionaries."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inciflow.llm import alignment
from inciflow.llm.queries import vocabulary
from tests.conftest import SF
from tests.llm.fixtures import NASTY, nasty

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["", " a", "a ", "a  b c", "\n\n x", "▁ x", "a▁", "é́ ́x", "x" * 5000, "<|endoftext|> </s> <s> <0x41>", "a\x85b c\x1cd", "\x00 b", "  ", "中文 \U0001f600 b", "don't  stop 12.5%", "a\u00a0 b\u3000c"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


def plain(aligner, text):
    """n_a, n_b, n_groups, groups, links by comparing all byte ranges; None without tokens."""
    if not text:
        return None
    a, b = aligner.a.encode(f" {text}", add_special_tokens=False).ids, aligner.b.encode(text)
    ranges = []
    for ids, table in ((a, aligner.bytes_a), (b, aligner.bytes_b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(table[i])))
        ranges.append(out)
    joined = b"".join(aligner.bytes_a[i] for i in a), b"".join(aligner.bytes_b[i] for i in b)
    if joined != (f" {text}".encode(),) * 2:
        return None
    ra, rb = ranges
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    left, groups = [list(zip(a, ra, strict=True))[::-1], list(zip(b, rb, strict=True))[::-1]], []
    for cut in cuts:
        inside = [[], []]
        for side, out in zip(left, inside, strict=True):
            while side and side[-1][1][1] <= cut:
                out.append(str(side.pop()[0]))
        groups.append("|".join(map(",".join, inside)))
    links, j = Counter(), 0
    for i, (s, e) in zip(a, ra, strict=True):
        while rb[j][1] <= s:
            j += 1
        k = j
        while k < len(rb) and rb[k][0] < e:
            links[i, b[k]] += 1
            k += 1
    return len(a), len(b), len(cuts), ";".join(groups), links


def shown(found):
    return found and (*found[:4], Counter({divmod(p, alignment.PAIR): n for p, n in found[4].items()}))


def test_texts_are_aligned_as_a_loop_does(aligner, spark):
    assert aligner.short_a != aligner.long_a
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r["text"] and len(r["text"]) < 4000][:60] + ODD
    assert [shown(x) for x in aligner.texts(texts)] == [plain(aligner, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tab'.0é")), max_size=30))
def test_any_text_is_aligned_as_a_loop_does(aligner, text):
    assert [shown(x) for x in aligner.texts([text])] == [plain(aligner, text)]


def test_words_and_whole_texts_give_the_same(aligner, spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        by_words, whole = next(aligner.texts([r["text"]])), aligner.whole(r["text"]) if r["text"] else None
        assert (by_words and by_words[:4]) == (whole and (*whole[:3], whole[4]))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_groups_lie_between_all_shared_cuts(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    groups = alignment.cut_groups(a, b)
    assert [a[g[1] - 1] for g in groups] == sorted(set(a) & set(b)) == [b[g[3] - 1] for g in groups]
    assert [g[0] for g in groups] == [0, *[g[1] for g in groups[:-1]]] and [g[2] for g in groups] == [0, *[g[3] for g in groups[:-1]]]


def test_a_small_memory_gives_the_same(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_WORDS", 3)
    texts = ["one two three four five", "five four one", "two " * 9, "one two six " + "y" * 100]
    small = alignment.Aligner(*PATHS)
    assert [next(small.texts([t])) for t in texts * 2] == list(aligner.texts(texts * 2))


def brute(aligner, rows):
    found = [(d, plain(aligner, t)) for d, t in rows]
    counts = Counter(p for _, f in found if f for p in f[4])
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[4]
            best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
            out.append((d, f[0], f[1], f[2], links.total(), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(f[3].encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("heavy", [200_000, 20])
def test_counts_of_the_corpus(aligner, spark, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY_PAIRS", heavy)
    rows = NASTY + [(40 + i, t) for i, t in enumerate(ODD)]
    extra = ", ".join(f"{c} {t}" for c, t in [("pairs", "int"), ("pair", "int"), ("row", "long"), ("n", "long"), ("best", "int"), ("groups", "string"), ("times", "int")])
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4, 5, "g", 6) for d, t in rows], f"doc_id long, text string, {extra}")
    got = alignment.align(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(aligner, rows)


def test_nasty_and_empty_tables(spark):
    assert alignment.align(nasty(spark), *PATHS).count() == len(NASTY)
    assert alignment.align(nasty(spark).limit(0), *PATHS).count() == 0
