"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A piece of text starts as its bytes, one symbol each, linked to their neighbours. A heap holds every
adjacent pair that the vocabulary can merge, ordered by rank and then by place. Each pop that is still
current merges two symbols into one and offers the new neighbours. The count of a piece is its number of
bytes minus its number of merges. A piece of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, enter

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
OVER = 1024
#: Entries that a worker's memories of counted words and pieces may have before they are emptied.
REMEMBERED_WORDS, REMEMBERED_PIECES = 1_000_000, 300_000


class _Memory(dict):
    """Counts by key, worked out when first asked for; emptied when full, so memory stays bounded."""

    __slots__ = ("make", "most")

    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        n = self.make(key)
        if len(key) <= 64:
            self[key] = n
        return n


class BytePairCounter:
    """Counts tokens as the library does for a byte-level BPE file, special strings included."""

    def __init__(self, path: str):
        import json

        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._library_split = library.pre_tokenizer.pre_tokenize_str
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        letters = self._byte_letters()
        vocab = model["vocab"]
        self._start = [vocab[letters[b]] for b in range(256)]
        self._merge = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self._merge[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self._pieces = regex.compile(PATTERN).findall
        self._spaces = regex.compile(r" \s|\s |^ | $").search
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = special
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))).split if special else None
        self._of_piece = _Memory(self._merged, REMEMBERED_PIECES)
        self._of_chunk = _Memory(self._chunk, REMEMBERED_WORDS)

    @staticmethod
    def _byte_letters() -> list[str]:
        """The printable character that stands for each byte in byte-level vocabularies."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(others)) for b in range(256)]

    def _merged(self, piece: str) -> int:
        start = self._start
        symbols = [start[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        if n < 2:
            return n
        look = self._merge.get
        heap = []
        for i in range(n - 1):
            m = look(symbols[i] << 32 | symbols[i + 1])
            if m:
                heap.append((m[0], i, m[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            rank, i, made = pop(heap)
            if symbols[i] < 0 or (j := after[i]) >= n:
                continue
            m = look(symbols[i] << 32 | symbols[j])
            if not m or m[0] != rank:
                continue
            symbols[i], symbols[j] = made, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := look(made << 32 | symbols[k]):
                    push(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := look(symbols[h] << 32 | made)):
                push(heap, (m[0], h, m[1]))
        return n - merges

    def _split(self, text: str) -> list[str]:
        """The library's pieces. Characters that Python's tables don't know go to the library's splitter."""
        if not text or max(text) < "\u0530" or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._pieces(text)
        return [text[a:b] for _, (a, b) in self._library_split(text)]

    def _chunk(self, chunk: str) -> int:
        return sum(map(self._of_piece.__getitem__, self._split(chunk)))

    def _ordinary(self, text: str) -> int:
        """A single space between two other characters always begins a piece, so the words that follow
        such spaces are counted on their own and remembered. Other runs of white space take the whole way."""
        if not text:
            return 0
        if self._spaces(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        of = self._of_chunk.__getitem__
        return of(first) + sum(map(of, [" " + x for x in rest]))

    def count(self, text: str) -> int:
        if self._cut and any(s in text for s in self._special):
            parts = self._cut(text)
            return len(parts) - 1 + sum(map(self._ordinary, parts))
        return self._ordinary(text)


@lru_cache(maxsize=4)
def counter(path: str) -> BytePairCounter:
    return BytePairCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id", over: int = OVER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs.

    vocabulary is the path of a byte-level BPE .json file on every worker (None: the public 50k file).
    Null text counts as empty (0 bytes, 0 tokens). Null ids, repeated rows and very long texts are rows
    like any other; other columns are ignored.
    """

    def run(batches):
        import public_tokenizers

        enter("tokens", counter.cache_clear)
        count = counter(vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)).count
        for batch in batches:
            n = np.fromiter((count(t.as_py()) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > over)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    got = docs.select(F.col(doc_id).alias("doc_id"), as_text(text).alias("text"), F.octet_length(as_text(text)).cast("long").alias("n_bytes"))
    fields = [got.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return got.mapInArrow(run, T.StructType(fields))
