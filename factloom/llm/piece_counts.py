"""Operator 9: word-piece counts by a longest-match automaton that builds no pieces.

The vocabulary is a trie over bytes, with pieces that begin a word and pieces that continue one. A node's failure link
says where matching goes on when no longer piece fits: to the node of what is left after the greedy pieces of the
node's own string are taken off; how many pieces that takes is stored with the link. So a word is counted in one walk
over its bytes, without going back.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import _byte_letters

_automata: dict[tuple[str, int], PieceCounter] = {}


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word and pieces that continue one, from a byte-level vocabulary file: those with the
    space's letter in front begin words."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    back = {letter: byte for byte, letter in _byte_letters().items()}
    raw = [bytes(back[c] for c in piece) for piece in vocabulary if all(c in back for c in piece)]
    return [r[1:] for r in raw if r[:1] == b" " and len(r) > 1], [r for r in raw if r[:1] != b" "]


class PieceCounter:
    """count(word): pieces of the greedy longest match, or 0 if some byte of it fits no piece."""

    def __init__(self, begin: list[bytes], rest: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0: start of a word; 1: start of what continues it
        ends = [False, False]
        for root, pieces in ((0, begin), (1, rest)):
            for piece in pieces:
                at = root
                for byte in piece:
                    to = self.next[at].get(byte)
                    if to is None:
                        to = self.next[at][byte] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = to
                ends[at] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        todo = deque([0, 1])
        while todo:  # breadth first: links lead to shorter strings
            at = todo.popleft()
            for byte, to in self.next[at].items():
                if ends[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    back, pops = self.fail[at], self.popped[at]
                    while back >= 0 and byte not in self.next[back]:
                        pops += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[to], self.popped[to] = self.next[back][byte], pops
                todo.append(to)

    def count(self, word: bytes) -> int:
        nexts, fail, popped = self.next, self.fail, self.popped
        at, pieces = 0, 0
        for byte in word:
            while (to := nexts[at].get(byte)) is None:
                pieces += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at > 1:
            pieces += popped[at]
            at = fail[at]
        return pieces if at == 1 else 0


def automaton(path: str) -> PieceCounter:
    key = (path, os.getpid())
    if key not in _automata:
        _automata[key] = PieceCounter(*read_vocabulary(path))
    return _automata[key]


def piece_counts(documents: DataFrame, vocabulary: str, kept_words: int = 400_000) -> DataFrame:
    """One row a document: doc_id, n_words, n_pieces, n_unknown.

    Words are runs of characters other than space and U+0009 to U+000D, in whole texts. n_pieces sums the pieces of
    the greedy longest match of each word; a word that cannot be matched counts as one piece and in n_unknown. A null
    text has no words. Repeated rows stay.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = automaton(vocabulary), {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = list(map(known.get, words))
                if None in found:
                    if len(known) > kept_words:
                        known.clear()
                    for i, n in enumerate(found):
                        if n is None:
                            found[i] = known[words[i]] = counter.count(words[i])
                unknown = found.count(0)
                rows.append((len(words), sum(found) + unknown, unknown))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    common.ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.lean(count), "doc_id long, n_words long, n_pieces long, n_unknown long")
