"""Token counts by a linear longest-match automaton.

The vocabulary's trie has a failure link at each node and the number of tokens that are popped on the way, so greedy longest-match
lengths come from one pass over a word's bytes and no piece is ever built."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 1_000_000


class Automaton(dict):
    """Counts of words (bytes, with a blank before them), remembered. The vocabulary must hold every single byte."""

    def __init__(self, vocabulary: Iterable[bytes]):
        super().__init__()
        tokens = set(vocabulary) - {b""}
        if missing := 256 - sum(len(t) == 1 for t in tokens):
            raise ValueError(f"the vocabulary lacks {missing} single bytes")
        self.goto: dict[int, int] = {}
        ends = [False]
        for token in tokens:
            node = 0
            for c in token:
                key = node << 8 | c
                if key not in self.goto:
                    self.goto[key] = len(ends)
                    ends.append(False)
                node = self.goto[key]
            ends[node] = True
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.goto.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        self.fail, self.popped, self.flush = [0] * len(ends), [0] * len(ends), [0] * len(ends)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for c, node in children.get(parent, ()):
                if ends[node]:
                    self.popped[node] = 1
                else:
                    z, n = self.fail[parent], self.popped[parent]
                    while z << 8 | c not in self.goto:
                        z, n = self.fail[z], n + self.popped[z]
                    self.fail[node], self.popped[node] = self.goto[z << 8 | c], n
                self.flush[node] = self.popped[node] + self.flush[self.fail[node]]
                todo.append(node)

    def count(self, data: bytes) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for c in data:
            while (next_node := goto.get(node << 8 | c)) is None:
                total += popped[node]
                node = fail[node]
            node = next_node
        return total + self.flush[node]

    def __missing__(self, word: bytes) -> int:
        n = self.count(b" " + word)
        if len(word) < 40:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One per worker process, from a file with a base64 token and a rank on each line."""
    if path not in _automata:
        with open(path, "rb") as lines:
            _automata[path] = Automaton(base64.b64decode(line.split()[0]) for line in lines)
    return _automata[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens per row of docs(doc_id, text). Words lie between white space (blank, tab, line ends, \\x0b, \\x0c).

    Null and empty texts have 0 of both; rows stay as they are, repeated or without doc_id; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = automaton(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                own = (text.as_py() or "").encode().split()
                words.append(len(own))
                tokens.append(sum(map(counts.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def brute_force(word: bytes, vocabulary: set[bytes]) -> int:
    data, n = b" " + word, 0
    while data:
        size = next(k for k in range(len(data), 0, -1) if data[:k] in vocabulary)
        data, n = data[size:], n + 1
    return n
