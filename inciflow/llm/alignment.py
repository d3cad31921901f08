"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

A cut is a byte offset where a token of both sides ends. `cut_groups` looks for a common end near the middle
of an interval by bisect and goes on in both halves; an interval without a cut inside is one group. Both
tokenizers keep the words of a text apart where one space stands between two other characters, so such words
are encoded and aligned once per worker and their groups are joined into those of the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inciflow.llm.common import small_batches, stored

#: Aligned words in each of the two generations that a worker remembers, and the longest word that it remembers.
CACHE_WORDS, CACHE_LENGTH = 250_000, 64
#: How byte-level models of this kind cut a text (a fixed value of theirs).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pair in more than a 200,000th of all links is "heavy"; there are 200,000 of them at most, so they can be broadcast.
HEAVY_PAIRS = 200_000
#: Both sides end a token where a single space stands between characters that are no white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: An id pair is one number: A's id times this, plus B's.
PAIR = 1 << 31


def cut_groups(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Groups (a0, a1, b0, b1) of token ranges between shared cuts, in order. Both lists rise to the same last end."""
    found, open_ = [], [(0, len(ends_a), 0, len(ends_b))] if ends_a else []
    while open_:
        a0, a1, b0, b1 = open_.pop()
        # the interval's own end is common; look for another one, from the middle outwards
        middle, last = (a0 + a1 - 1) // 2, a1 - 1
        for step in range(last - a0):
            at = middle - (step + 1) // 2 if step % 2 else middle + step // 2
            if not a0 <= at < last:  # one side of the middle has run out
                continue
            end = ends_a[at]
            to = bisect_left(ends_b, end, b0, b1)
            if to < b1 and ends_b[to] == end:
                open_ += [(at + 1, a1, to + 1, b1), (a0, at + 1, b0, to + 1)]
                break
        else:
            found.append((a0, a1, b0, b1))
    return found


def overlaps(group: tuple[int, int, int, int], ends_a: Sequence[int], ends_b: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Pairs of token positions of one group whose byte ranges overlap."""
    a, a1, b, b1 = group
    while a < a1 and b < b1:
        yield a, b
        if ends_a[a] < ends_b[b]:
            a += 1
        else:  # only the last ends of a group are equal
            b += 1
            a += ends_a[a] == ends_b[b - 1]


class Aligner:
    """Aligns texts by their words; `words` remembers (n_a, n_b, n_groups, pairs, groups) or None where bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        # byte-level models write printable bytes as themselves, all others as characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes_a = {i: bytes(byte.get(c, 0) for c in token) for token, i in self.a.get_vocab().items()}
        self.bytes_b = {i: self._bytes_b(i) for i in range(self.b.get_piece_size())}
        self.long_a, self.short_a = lambda text: self.a.encode(text, add_special_tokens=False).ids, self._ranks()
        self.words, self.older = {}, {}

    def _bytes_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ranks(self):
        """A's encoder for short texts: where the ids follow the order of the merges, ids are ranks and tiktoken is the same and faster."""
        import tiktoken

        model = json.loads(self.a.to_str())
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        first = len(vocab) - len(merges) - len([t for t in model["added_tokens"] if t["content"] in vocab])
        split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if model["normalizer"] or model["pre_tokenizer"] != split or any(vocab["".join(m)] != first + i for i, m in enumerate(merges)):
            return self.long_a
        special = {t["id"] for t in model["added_tokens"]}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in self.bytes_a.items() if i not in special}, special_tokens={}).encode_ordinary

    def _aligned(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if not b"".join(parts_a) == b"".join(parts_b) == f" {text}".encode():
            return None
        if len(a) == 1:  # no cut but the end
            return 1, len(b), 1, tuple([a[0] * PAIR + j for j in b]), f"{a[0]}|{str(b)[1:-1].replace(' ', '')}"
        if len(b) == 1:
            return len(a), 1, 1, tuple([i * PAIR + b[0] for i in a]), f"{str(a)[1:-1].replace(' ', '')}|{b[0]}"
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        groups = cut_groups(ends_a, ends_b)
        pairs = tuple([a[i] * PAIR + b[j] for g in groups for i, j in overlaps(g, ends_a, ends_b)])
        shown = [f"{str(a[a0:a1])[1:-1]}|{str(b[b0:b1])[1:-1]}" for a0, a1, b0, b1 in groups]
        return len(a), len(b), len(groups), pairs, ";".join(shown).replace(" ", "")

    def whole(self, text: str) -> tuple | None:
        """A text without use of its words."""
        return self._aligned(text, self.long_a(f" {text}"), self.b.encode(text))

    def look_up(self, words: set[str]) -> dict[str, tuple | None]:
        """Each word aligned, new ones all at once; only short words are remembered."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        known = self.words
        new = [w for w in words if w not in known]
        for w in new:
            if w in self.older:
                known[w] = self.older[w]
        new = [w for w in new if w not in known]
        a = [(self.short_a if len(w) <= CACHE_LENGTH else self.long_a)(f" {w}") for w in new]
        found = {w: self._aligned(w, x, y) for w, x, y in zip(new, a, self.b.encode(new) if new else [], strict=True)}
        known.update((w, x) for w, x in found.items() if len(w) <= CACHE_LENGTH)
        return {w: known[w] if w in known else found[w] for w in words}

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, dict] | None]:
        """n_a, n_b, n_groups, groups and the links with their numbers of each text; None without tokens."""
        split = [BETWEEN.split(t) if t else [] for t in texts]
        known = self.look_up({w for words in split for w in words})
        for words in split:
            found = [known[w] for w in words]
            if not found or None in found:
                yield None
                continue
            links: dict[int, int] = {}
            for w, n in Counter(words).items():
                for p in known[w][3]:
                    links[p] = links.get(p, 0) + n
            n_a, n_b, n_groups, _, groups = zip(*found, strict=True)
            yield sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), links


@lru_cache(maxsize=2)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker: the words that it remembers serve the worker's later tasks too."""
    return Aligner(path_a, path_b)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, the distinct id pairs linked in each row's text and how often.

    `groups` has the groups as text, or with `keep_groups` off their SHA-256. Rows without tokens have zeros, ''
    and empty arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        longs = pa.list_(pa.int64())
        schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("pairs", longs), ("times", longs)])
        for batch in small_batches(batches):
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), aligner.texts(batch.column(1).to_pylist()), strict=True):
                if found is None:
                    rows.append((doc_id, 0, 0, 0, "", [], []))
                else:
                    n_a, n_b, n_groups, groups, links = found
                    rows.append((doc_id, n_a, n_b, n_groups, groups if keep_groups else hashlib.sha256(groups.encode()).hexdigest(), list(links), list(links.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best: in how many rows' texts an id pair is linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    side = F.shiftright("pair", 31)
    most = counts.groupBy(side.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", side).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of `docs`.

    Null, empty and unlike texts give zeros and ''. Each row counts as a document, also where a doc_id is
    repeated or null. An empty table gives no rows; other columns are ignored. Counts of id pairs are joined to
    the rows' distinct pairs: the at most 200,000 heaviest pairs by broadcast, all others by a shuffle.
    """
    rows = stored(aligned_texts(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows), "pairs")
    limit = (rows.agg(F.sum(F.size("pairs"))).first()[0] or 0) / HEAVY_PAIRS
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    # heavy pairs are summed where their rows are; only the others are shuffled
    heavy, light = F.broadcast(counts.filter(F.col("n") > limit)), counts.filter(F.col("n") <= limit)
    met = links.join(heavy, "pair").unionByName(links.join(heavy, "pair", "left_anti").join(light, "pair"))
    sums = met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.join(sums, "row", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")], F.col("groups").alias("groups_sha256"))
