"""Log-bilinear language model, trained by noise-contrastive estimation, that scores whole texts.

Counts of all training tokens are gathered with Spark. The most frequent tokens are classes of their own;
every other token belongs to one of a fixed number of classes by its first bytes. The log-bilinear model
predicts the class of a token from the two tokens before it: the vectors of the context, each turned by the
matrix of its place, add up to a predicted vector whose inner products with the vectors of all classes (plus
biases) are the scores. Training uses noise samples instead of the normaliser; scoring normalises exactly,
by a matrix product over the distinct contexts of a batch. A token inside a class of many has its smoothed
share of that class, with room for one unseen token, so the probabilities of all tokens add up to one.

Training runs in every partition on its own training documents from the same start; the weighted mean of the
partitions' parameters starts the next round.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inciflow.llm.common import small_batches, stored

#: The end of a text. It can't be a word, as it is white space.
END = b"\n"
#: Tokens that are classes of their own, and classes for all others.
SHORTLIST, CLASSES = 256, 64
#: Length of vectors, tokens of context, noise samples of a minibatch, tokens of a minibatch.
WIDTH, CONTEXT, NOISE, BATCH = 24, 2, 64, 2048
#: Tokens that hold at least one of so many training tokens are looked up in memory; there can't be more of them.
FREQUENT = 500_000
#: Distinct tokens that a counting task holds at most before it hands them on.
HELD_WORDS = 500_000
#: Tokens that a scoring task, and a training task, works on at once.
SCORED_TOKENS, TRAINED_TOKENS = 200_000, 1_000_000


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    found = text.lower().split()
    found.append(END)
    return found


def class_of_rest(token: bytes) -> int:
    return zlib.crc32(token[:3]) % CLASSES


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, t (UTF-8). A null doc_id counts as the text ''."""
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): counts of all training tokens, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in small_batches(batches):
            for t in b.column(0).to_pylist():
                counts.update(tokens(t))
            if len(counts) > HELD_WORDS:
                yield from out(counts)
                counts = Counter()
        yield from out(counts)

    def out(counts):
        words, numbers = list(counts), list(counts.values())
        for at in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 20_000], pa.binary()), pa.array(numbers[at : at + 20_000], pa.int64())], ["token", "c"])

    return prepared(docs).filter(~F.col("held_out")).select("t").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts as far as their size is bounded, and the totals of all.

    `code`: shortlist tokens, then other frequent tokens, each with its place in `cls` and `log_count`. `total` and
    `distinct` are over all training tokens, `class_total` and `class_distinct` over the classes of the rest.
    """

    code: dict
    cls: np.ndarray
    log_count: np.ndarray
    shortlist: int
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return self.shortlist + CLASSES

    def class_of_code(self) -> np.ndarray:
        """The class of each code; behind the frequent tokens stands one code per class of the rest."""
        return np.concatenate([self.cls, self.shortlist + np.arange(CLASSES)])

    def noise(self) -> np.ndarray:
        """Smoothed unigram probabilities of the classes."""
        short = np.maximum(10.0 ** self.log_count[: self.shortlist] - 0.5, 0)
        p = np.concatenate([short, self.class_total]) + 0.5
        return p / p.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("c").desc(), "token").limit(SHORTLIST).collect()
    # at most FREQUENT tokens can have this many occurrences
    often = counts.filter(F.col("c") * FREQUENT >= total).collect() if total else []
    short = {bytes(r["token"]): r["c"] for r in top}
    rest = {bytes(r["token"]): r["c"] for r in often if bytes(r["token"]) not in short}
    code = {t: i for i, t in enumerate([*short, *rest])}
    cls = np.array([*range(len(short)), *(len(short) + class_of_rest(t) for t in rest)], dtype=np.int64)
    n = np.array([*short.values(), *rest.values()], dtype=np.float64)
    # the classes of the rest, over all counts: totals less the shortlist
    of = F.crc32(F.substring("token", 1, 3)) % CLASSES
    by = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy(of.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    class_total, class_distinct = (np.array([by.get(k, (0, 0))[i] for k in range(CLASSES)], dtype=np.float64) for i in (0, 1))
    for t, c in short.items():
        class_total[class_of_rest(t)] -= c
        class_distinct[class_of_rest(t)] -= 1
    return Vocabulary(code, cls, np.log10(n + 0.5), len(short), int(total), int(distinct), class_total, class_distinct)


class Coder(dict):
    """token -> code; tokens outside the frequent ones get a code of their class and are not kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.code)
        self.base = len(vocabulary.code)

    def __missing__(self, token: bytes) -> int:
        return self.base + class_of_rest(token)

    def codes(self, text: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text), dtype=np.int64, count=len(text))


@dataclass
class Parameters:
    """r: class vectors (the last row is the place before a text), m: a matrix per place, b: biases."""

    r: np.ndarray
    m: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, noise: np.ndarray, seed: int = 11) -> Parameters:
        rng = np.random.default_rng(seed)
        r = rng.normal(0, 0.1, (len(noise) + 1, WIDTH))
        m = np.stack([np.eye(WIDTH) * 0.5] * CONTEXT)
        return cls(r, m, np.log(noise))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.m.ravel(), self.b])

    @classmethod
    def of(cls, flat: np.ndarray, classes: int) -> Parameters:
        n, k = (classes + 1) * WIDTH, CONTEXT * WIDTH * WIDTH
        return cls(flat[:n].reshape(classes + 1, WIDTH), flat[n : n + k].reshape(CONTEXT, WIDTH, WIDTH), flat[n + k :])


def contexts(classes: np.ndarray, begin: int) -> np.ndarray:
    """The CONTEXT classes before each token of one text, nearest first."""
    out = np.full((len(classes), CONTEXT), begin, dtype=np.int64)
    for k in range(CONTEXT):
        out[k + 1 :, k] = classes[: max(0, len(classes) - k - 1)]
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad on minibatches."""

    def __init__(self, start: Parameters, noise: np.ndarray, rate: float, seed: int):
        self.p = Parameters(start.r.astype(np.float32), start.m.astype(np.float32), start.b.astype(np.float32))
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.rate, self.rng = rate, np.random.default_rng(seed)
        self.g = Parameters(np.full_like(self.p.r, 1e-2), np.full_like(self.p.m, 1e-2), np.full_like(self.p.b, 1e-2))

    @staticmethod
    def _sum_rows(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of `rows` by `index`, as one product with the sorted ends of the groups."""
        order = np.argsort(index, kind="stable")
        sorted_index = index[order]
        starts = np.flatnonzero(np.r_[True, sorted_index[1:] != sorted_index[:-1]])
        out = np.zeros((n, rows.shape[1]), dtype=np.float32)
        out[sorted_index[starts]] = np.add.reduceat(rows[order], starts, axis=0)
        return out

    def step(self, context: np.ndarray, target: np.ndarray, times: np.ndarray) -> None:
        """`times`: how often each context has its target."""
        p, n = self.p, float(times.sum())
        times = times.astype(np.float32)
        noise = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]).clip(max=len(p.b) - 1)
        vectors = [p.r[context[:, k]] for k in range(CONTEXT)]
        q = sum(v @ p.m[k] for k, v in enumerate(vectors))
        rt, rn = p.r[target], p.r[noise]
        # how much more likely the data makes the token than the noise does
        dt = np.einsum("ij,ij->i", q, rt) + p.b[target] - self.log_noise[target]
        dn = q @ rn.T + p.b[noise] - self.log_noise[noise]
        et = times / (1 + np.exp(np.clip(dt, -30, 30)))  # 1 - P(data)
        en = -times[:, None] / (1 + np.exp(np.clip(-dn, -30, 30)))  # -P(data) of noise
        gq = et[:, None] * rt + en @ rn
        gr = self._sum_rows(target, et[:, None] * q, len(p.r))
        np.add.at(gr, noise, en.T @ q)
        gb = np.bincount(target, weights=et, minlength=len(p.b))
        np.add.at(gb, noise, en.sum(axis=0))
        gm = np.empty_like(p.m)
        for k, v in enumerate(vectors):
            gm[k] = v.T @ gq
            gr += self._sum_rows(context[:, k], gq @ p.m[k].T, len(p.r))
        for value, grad, seen in ((p.r, gr, self.g.r), (p.m, gm, self.g.m), (p.b, gb, self.g.b)):
            grad = (grad / n).astype(np.float32)
            seen += grad * grad
            value += self.rate * grad / np.sqrt(seen)


    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over the classes of some texts, in minibatches."""
        base = len(self.p.r)
        context, target = np.concatenate([contexts(x, base - 1) for x in texts]), np.concatenate(texts)
        # equal contexts with equal targets are one row that counts as often as it stands there
        keys, times = np.unique(context @ (base ** np.arange(1, CONTEXT + 1)) + target, return_counts=True)
        order = self.rng.permutation(len(keys))
        for at in range(0, len(order), BATCH):
            some = keys[order[at : at + BATCH]]
            before = np.stack([some // base**k % base for k in range(1, CONTEXT + 1)], axis=1)
            self.step(before, some % base, times[order[at : at + BATCH]])


@dataclass(frozen=True)
class Coded:
    """The rows of `coded`."""

    rows: DataFrame


def coded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """row_id, doc_id, held_out, codes (little-endian 32-bit numbers), rare, times: each text tokenised once for all passes.

    `rare` are the distinct tokens of the text outside the frequent ones, `times` how often they stand there.
    """
    names = ["row_id", "doc_id", "held_out", "codes", "rare", "times"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = Coder(voc), TaskContext.get().partitionId() << 33
        for b in small_batches(batches):
            out = [[] for _ in names]
            for doc_id, held, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = tokens(text)
                codes = coder.codes(words)
                rare = Counter([words[j] for j in np.flatnonzero(codes >= coder.base).tolist()])
                for col, v in zip(out, (number, doc_id, held, codes.astype("<i4").tobytes(), list(rare), list(rare.values())), strict=True):
                    col.append(v)
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return prepared(docs).mapInArrow(run, "row_id long, doc_id long, held_out boolean, codes binary, rare array<binary>, times array<long>")


def train_round(docs: DataFrame | Coded, voc: Vocabulary, start: Parameters, rate: float) -> Parameters:
    """One pass over all training documents; the mean of the partitions' parameters, weighted by their tokens."""
    texts = docs.rows if isinstance(docs, Coded) else coded(docs, voc)
    noise, classes, cls = voc.noise(), voc.classes, voc.class_of_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(start, noise, rate, 1 + TaskContext.get().partitionId()), 0
        ids, held = [], 0
        for b in small_batches(batches):
            ids += [cls[np.frombuffer(x, "<i4")] for x in b.column(0).to_pylist()]
            held = sum(map(len, ids))
            if held > TRAINED_TOKENS:
                trainer.learn(ids)
                ids, seen = [], seen + held
        if ids:
            trainer.learn(ids)
            seen += held
        if seen:
            flat = trainer.p.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], ["i", "v", "w"])

    parts = texts.filter(~F.col("held_out")).select("codes").mapInArrow(run, "i int, v double, w double")
    rows = parts.groupBy("i").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).select("i", (F.col("v") / F.col("w")).alias("v")).collect()
    if not rows:
        return start
    flat = np.empty(len(rows))
    flat[[r["i"] for r in rows]] = [r["v"] for r in rows]
    return Parameters.of(flat, classes)


def class_log10(p: Parameters, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of the classes `target`; each distinct context is normalised once."""
    base = len(p.r)
    keys, which = np.unique(context @ (base ** np.arange(CONTEXT)), return_inverse=True)
    out = np.empty(len(target))
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(0, len(keys) + 4096, 4096))
    for n, at in enumerate(range(0, len(keys), 4096)):
        some = keys[at : at + 4096]
        q = sum(p.r[(some // base**k) % base] @ p.m[k] for k in range(CONTEXT))
        s = q @ p.r[:-1].T + p.b
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        rows = order[ends[n] : ends[n + 1]]
        out[rows] = s[which[rows] - at, target[rows]]
    return out / np.log(10)


def partial_scores(texts: DataFrame, voc: Vocabulary, p: Parameters) -> DataFrame:
    """row_id, doc_id, held_out, n_tokens, known, base, score of the rows of `coded`, without the counts of rare tokens."""
    names = ["row_id", "doc_id", "held_out", "n_tokens", "known", "base", "score"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    single = Parameters(p.r.astype(np.float32), p.m.astype(np.float32), p.b.astype(np.float32))
    all_log = float(np.log10(voc.total + 0.5 * (voc.distinct + 1)))
    class_of, frequent, begin = voc.class_of_code(), len(voc.code), voc.classes
    log_count = np.concatenate([voc.log_count, np.zeros(CLASSES)])
    inside = -np.log10(voc.class_total + 0.5 * (voc.class_distinct + 1))
    within = np.where(class_of < voc.shortlist, 0.0, log_count + inside[np.maximum(class_of - voc.shortlist, 0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            codes = [np.frombuffer(c, "<i4") for _, _, _, c in rows]
            flat = np.concatenate(codes)
            cls = class_of[flat]
            at = np.cumsum([0, *map(len, codes)])
            logs = class_log10(single, np.concatenate([contexts(class_of[c], begin) for c in codes]), cls)
            known, base, score = (np.add.reduceat(x, at[:-1]) for x in ((flat < frequent).astype(np.int64), log_count[flat], logs + within[flat]))
            size = np.diff(at)
            heads = [list(c) for c in list(zip(*rows, strict=True))[:3]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*heads, size, known, base - size * all_log, score], types, strict=True)], names)

        for b in small_batches(batches, 4096):
            held, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += len(row[3]) // 4
                if size > SCORED_TOKENS:
                    yield solve(held)
                    held, size = [], 0
            if held:
                yield solve(held)

    return texts.select("row_id", "doc_id", "held_out", "codes").mapInArrow(run, "row_id long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")


def score_documents(docs: DataFrame, rounds: int = 2, rate: float = 0.3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`.

    Learns from the documents with crc32(doc_id) mod 5 other than 1 (all of them, in `rounds` passes). Null and
    empty texts are the end token alone. Repeated rows count and are scored each. Without training documents
    the model is its start and every token is unknown. An empty table gives no rows; other columns are ignored.
    """
    counts = stored(token_counts(docs), "lm-counts")
    voc = vocabulary(counts)
    texts = stored(coded(docs, voc), "lm-codes")
    p = Parameters.start(voc.noise())
    for i in range(rounds if voc.total else 0):
        p = train_round(Coded(texts), voc, p, rate / (1 + i))
    rare = texts.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id", F.col("x.rare").alias("token"), F.col("x.times").alias("n"))
    met = rare.join(counts.filter(F.col("c") * FREQUENT < voc.total), "token", "left")
    sums = met.groupBy("row_id").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log"),
    )
    log = F.coalesce("log", F.lit(0.0))
    found = partial_scores(texts, voc, p).join(sums, "row_id", "left")
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
