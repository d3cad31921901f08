"""Sum-of-squares online packing of tokenised documents into windows of one length.

N(h) is the number of open windows filled up to level h. A document of s tokens goes to the level h for which
the sum of N(h)^2 over all levels is smallest afterwards. Each Spark partition packs its own rows as they
come and holds only the open windows; nothing is shuffled. Documents longer than a window are cut into whole
windows and a rest. What is open at the end of a partition is cut freely into full windows, and its last
tokens into windows that are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 2
#: Words, and pieces of words, whose ids a worker remembers at most; then it starts anew.
CACHE_WORDS, CACHE_PIECES = 150_000, 300_000
SPECIAL = b"<|"
#: Words of printable Latin-1, on which lower case and Unicode classes are the same everywhere.
PLAIN = regex.compile(r"[!-~\u00a1-\u00ff]+")


class WordEncoder(dict):
    """UTF-8 word -> its ids as little-endian bytes, word by word: the tokenizer drops white space and no merge crosses it.

    Words end at ASCII white space only (as `bytes.split` has it); other white space stays in the word. Plain words
    are cut by the tokenizer's own pattern, so that "word", "word," and "word." share the ids of one piece. A-Z are
    put in lower case first, as the tokenizer does with all letters.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # byte-level models write printable bytes as themselves, all others as characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        text = word.decode()
        plain = text.isascii() and text.isprintable() or PLAIN.fullmatch(text)
        if plain and text.isalpha():  # letters alone are one piece
            low = text.lower()
            found = self.pieces.get(low) or self._piece(low)
        elif plain:
            found = b"".join([self.pieces.get(p) or self._piece(p) for p in self.pattern.findall(text.lower())])
        else:
            found = self.whole(word)
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        letters = piece.encode().decode("latin-1").translate(self.letters)
        ids = [x.id for x in self.model.tokenize(letters)]
        found = struct.pack(f"<{len(ids)}I", *ids)
        self.pieces[piece] = found
        return found

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: bytes) -> np.ndarray:
        # a special token may stand in a text; then it is encoded as it is
        raw = self.whole(text) if SPECIAL in text else b"".join(map(self.__getitem__, text.lower().split()))
        return np.frombuffer(raw, dtype="<u4")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker: what it remembers serves the worker's later tasks too."""
    return WordEncoder(path)


class SumOfSquares:
    """The open windows of one stream. `put` gives the pieces of windows that became full.

    A piece is (tag, start, ids); a window is a list of pieces.
    """

    def __init__(self, size: int):
        self.size, self.count, self.open = size, np.zeros(size + 1, dtype=np.int64), defaultdict(list)

    def level(self, length: int) -> int:
        """The level that `length` goes to; 0 is a new window, ties fall to the fullest."""
        count, size = self.count, self.size
        # moving a window from h to h + s changes the sum by 2 * (N(h + s) - N(h) + 1); levels 0 and `size` hold none
        change = 2 * (count[length : size + 1] - count[: size + 1 - length] + 1)
        change[0] = 2 * count[length] + 1 if length < size else 0
        if length < size:
            change[-1] = 1 - 2 * count[size - length]
        able = count[: size + 1 - length] > 0
        able[0] = True
        change = np.where(able, change, np.iinfo(np.int64).max)
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def put(self, tag, start: int, ids: np.ndarray) -> list | None:
        at = self.level(len(ids))
        window = self.open[at].pop() if at else []
        self.count[at] -= at > 0
        window.append((tag, start, ids))
        now = at + len(ids)
        if now == self.size:
            return window
        self.count[now] += 1
        self.open[now].append(window)
        return None

    def close(self) -> Iterator[list]:
        """The open windows, cut and joined: all full but the last ones, whose lengths are powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        rest = sum(len(p[2]) for p in pieces)
        window, room = [], 0
        for tag, start, ids in pieces:
            while len(ids):
                if not room:
                    room = self.size if rest >= self.size else 1 << (rest.bit_length() - 1)
                    rest -= room
                take = min(room, len(ids))
                window.append((tag, start, ids[:take]))
                start, ids, room = start + take, ids[take:], room - take
                if not room:
                    yield window
                    window = []


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_stream(batches: Iterator[tuple[list, list[bytes]]], encoder, size: int, part: int) -> Iterator[dict]:
    """Columns of pieces for batches of (doc_ids, texts)."""
    packer, number = SumOfSquares(size), 0
    rows = {n: [] for n in OUT}

    def emit(window):
        nonlocal number
        offset = 0
        for (doc_id, tokens), start, ids in window:
            for name, value in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, (part << 36) + number, offset), strict=True):
                rows[name].append(value)
            offset += len(ids)
        number += 1

    def flush():
        out = {k: list(v) for k, v in rows.items()}
        for v in rows.values():
            v.clear()
        return out

    for doc_ids, texts in batches:
        for doc_id, text in zip(doc_ids, texts, strict=True):
            ids = np.append(encoder.ids(text), np.array([END_ID], dtype="<u4"))
            tag, whole = (doc_id, len(ids)), len(ids) // size * size
            for at in range(0, whole, size):
                emit([(tag, at, ids[at : at + size])])
            if whole < len(ids):
                full = packer.put(tag, whole, ids[whole:].copy())
                if full:
                    emit(full)
        yield flush()
    for window in packer.close():
        emit(window)
    yield flush()


def pack(docs: DataFrame, tokenizer: str, size: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone. Rows with the same doc_id are packed each. Null doc_ids are
    kept. An empty table gives no rows; other columns are ignored. A task remembers the open windows of its
    partition; a repeated task packs the same rows of its file split in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()

        def columns():
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    yield some.column(0).to_pylist(), some.column(1).to_pylist()

        schema = pa.schema([(n, pa.int64()) for n in OUT])
        for rows in pack_stream(columns(), encoder, size, part):
            if rows["doc_id"]:
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, ", ".join(f"{n} long" for n in OUT))
