"""Ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector over hashed features of a text is shared by all
grades; ordered thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score). The expected grade and
the tail probability P(grade >= k) select documents. The model is fitted in numpy on a bounded sample of rated
documents; scoring is a map over all of them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inciflow.llm.common import small_batches

GRADES = 3
#: Hashed features.
DIM = 1 << 20
#: Rated documents that a fit reads at most, those with the smallest hash of their id.
SAMPLE = 20_000
#: Features that a model uses at most: those that tell the grades apart most surely.
FEATURES = 4096
#: Words whose features a task remembers at most; then it starts anew.
CACHE_WORDS = 100_000


def _index(name: bytes) -> int:
    return zlib.crc32(name) % DIM


class Features(dict):
    """word -> (features of the word, class of its shape); forgets all when it is full.

    With `only`, other features are left out.
    """

    def __init__(self, only: set[int] | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], str]:
        if len(self) > CACHE_WORDS:
            self.clear()
        text, shape = word.decode(errors="replace"), ""
        if text.isalpha():
            core = text.lower()
        else:
            core = text.lower().strip("".join(c for c in text if not c.isalnum()))
            tail = len(text) - len(text.rstrip(text[-1]))
            if not text[-1].isalnum() and (tail > 1 or not core):
                shape = text[-1] * min(tail, 3)
        if core:
            shape = ("U" if len(core) > 1 and text.isupper() else "a") + shape
        start = core[:5].encode()
        names = (b"w:" + core[:64].encode(), b"p:" + core[:4].encode(), b"q:" + start) if core else ()
        found = (self._wanted({_index(n) for n in names}), shape)
        self[word] = found
        return found

    def _wanted(self, found: set[int]) -> tuple[int, ...]:
        return tuple(found if self.only is None else found & self.only)

    def of(self, text: bytes) -> set[int]:
        """Distinct features of a whole text: its words and their beginnings, and how much of it has which shape."""
        words = Counter(text.split())
        total = sum(words.values())
        if not total:
            return set(self._wanted({_index(b"empty")}))
        found, shapes = set(), defaultdict(int)
        for word, n in words.items():
            of_word, shape = self[word]
            if of_word:
                found.update(of_word)
            shapes[shape] += n
        # parts of the text in powers of two, so that "much" is a feature of its own
        whole = [f"s:{s}:{int(log2(total / n))}" for s, n in shapes.items()] + [f"d:{8 * len(words) // total}:{int(log2(total))}", f"n:{int(log2(total))}"]
        found.update(self._wanted({_index(n.encode()) for n in whole}))
        return found


def as_array(found: set[int]) -> np.ndarray:
    return np.array(sorted(found), dtype=np.int32)


@dataclass
class OrdinalModel:
    """`index`: sorted features, `weight`: theirs, `threshold`: ascending, one less than there are grades."""

    index: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def scorer(self):
        """A function from UTF-8 texts to scores."""
        weights = dict(zip(self.index.tolist(), self.weight.tolist(), strict=True))
        features = Features(set(weights))
        return lambda text: sum(map(weights.__getitem__, sorted(features.of(text))))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.threshold[None, :] - np.asarray(score)[:, None], -500, 500)))


def informative(rows: Sequence[np.ndarray], grade: np.ndarray, most: int, least_docs: int = 5) -> np.ndarray:
    """Features with the largest chi-squared over the grades, those above 20 at most `most`."""
    seen = np.zeros((GRADES, DIM), dtype=np.float32)
    for f, g in zip(rows, grade, strict=True):
        seen[g, f] += 1
    docs = np.maximum(np.bincount(grade, minlength=GRADES), 1)[:, None]
    n = seen.sum(axis=0)
    ids = np.flatnonzero(n >= least_docs)
    seen, n = seen[:, ids], n[ids]
    expected = docs * n / docs.sum()
    chi = ((seen - expected) ** 2 / expected).sum(axis=0)
    best = ids[np.argsort(-chi, kind="stable")[:most]]
    return np.sort(best[np.isin(best, ids[chi > 20])])


def fit(rows: Sequence[np.ndarray], grade: np.ndarray, features: int = FEATURES, epochs: int = 40, batch: int = 64, rate: float = 0.3, ridge: float = 1e-5, seed: int = 7) -> OrdinalModel:
    """Maximum likelihood by AdaGrad. No rated rows: a model that gives every grade the same chance."""
    index = informative(rows, grade, features) if len(rows) else np.array([], dtype=np.int64)
    place = np.full(DIM, -1, dtype=np.int32)
    place[index] = np.arange(len(index))
    used = [x[x >= 0] for x in (place[f] for f in rows)]
    counts = np.bincount(grade, minlength=GRADES) + 1.0 if len(rows) else np.ones(GRADES)
    share = np.cumsum(counts / counts.sum())[:-1]
    low, gap = np.log(share / (1 - share)), None
    # thresholds are a first one and the logs of the gaps, so they stay in order
    free = np.concatenate([low[:1], np.log(np.maximum(np.diff(low), 1e-3))])
    weight, gw, gf = np.zeros(len(index)), np.full(len(index), 1e-6), np.full(GRADES - 1, 1e-6)
    rng = np.random.default_rng(seed)

    def thresholds():
        return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))

    for _ in range(epochs if len(index) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            cols, owner = np.concatenate([used[i] for i in some]), np.repeat(np.arange(len(some)), [len(used[i]) for i in some])
            score = np.bincount(owner, weights=weight[cols], minlength=len(some))
            cut = np.concatenate([[-np.inf], thresholds(), [np.inf]])
            g = grade[some]
            upper, lower = (1 / (1 + np.exp(np.clip(score - cut[g + k], -500, 500))) for k in (1, 0))
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # d log p by either threshold; by the score: dl - du
            grad = np.bincount(cols, weights=(dl - du)[owner], minlength=len(index)) / len(some) - ridge * weight
            cuts = np.array([du[g == k].sum() - dl[g == k + 1].sum() for k in range(GRADES - 1)]) / len(some)
            gap = np.exp(free[1:])
            ff = np.concatenate([[cuts.sum()], np.cumsum(cuts[::-1])[::-1][1:] * gap])
            gw += grad**2
            gf += ff**2
            weight += rate * grad / np.sqrt(gw)
            free += rate * ff / np.sqrt(gf)
    return OrdinalModel(index.astype(np.int32), weight, thresholds())


class Slices(Sequence):
    """Feature sets as slices of one array: a view is made when a row is asked for."""

    def __init__(self, column: pa.BinaryArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(self.column[i].as_buffer(), dtype=np.int32)


def rated(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[Sequence[np.ndarray], np.ndarray]:
    """Features and grades of a bounded sample: toxic is 0, else quality + 1. Rows with a null label don't count.

    The rows come in the order of a hash of their ids, so that a fit doesn't depend on how the tables are dealt.
    """
    grade = F.when(F.col("toxic") > 0, 0).otherwise(F.when(F.col("quality") > 0, 2).otherwise(1))
    some = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", grade.alias("grade"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)  # bounded: it can be broadcast
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([as_array(features.of(t)).tobytes() for t in b.column("t").to_pylist()], pa.binary()), b.column("grade")], ["doc_id", "f", "grade"])

    # repeated rows of a doc_id could exceed the sample: the limit holds for what comes to the driver too
    rows = text.select(F.col("doc_id").cast("long").alias("doc_id"), "t", "grade").mapInArrow(run, "doc_id long, f binary, grade int")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "f").limit(2 * sample).select("f", "grade").toArrow().combine_chunks()
    if not rows.num_rows:
        return [], np.array([], dtype=np.int64)
    return Slices(rows.column("f").chunk(0)), rows.column("grade").to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    return fit(*rated(docs, labels, sample))


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """`docs` with expected_grade and tail_probability (that of the best grade); all rows and other columns stay.

    Null and empty texts have a feature of their own and get its grade. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = model.scorer()
        for b in small_batches(batches):
            # the text comes first, then the columns that stay
            score = np.array([score_of(t) for t in b.column(0).to_pylist()], dtype=np.float64)
            tails = model.tails(score)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*b.schema.names[1:], "expected_grade", "tail_probability"])

    stay = [f for f in docs.schema if f.name not in ("expected_grade", "tail_probability")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stay)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text for the model")
    return docs.select(text, *[docs[f.name] for f in stay]).mapInArrow(run, f"{fields}, expected_grade double, tail_probability double")


def select_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents that are good with a probability of `least` or more, with their grades.

    Without any rated document nothing can be told and every document stays.
    """
    model = train(docs, labels, sample)
    graded = grade_documents(docs, model)
    return graded if not len(model.index) else graded.filter(F.col("tail_probability") >= least)
