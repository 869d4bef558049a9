"""Token counts (operator 1): greedy longest-match piece counts in linear time.

The vocabulary becomes a byte trie with failure links.  Each node knows how many pieces are popped when its
failure link is taken, so a word's number of pieces comes from one pass over its bytes: no piece is ever built
and no byte is read twice.  The automaton's size depends on the vocabulary only (checked against ``MAX_PIECES``)
and it is shipped once per executor as a broadcast.

Words are runs of non-space; a word is looked up as one space plus its bytes, so vocabulary entries that begin with
a space are word-initial pieces and the others continuation pieces.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import pieces, read_table, utf8

#: Bound on the vocabulary, hence on the broadcast automaton (about 100 bytes a trie node, few nodes a piece).
MAX_PIECES = 1_000_000
#: A worker forgets its word cache beyond this many words.
CACHE_WORDS = 500_000
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> list[bytes]:
    """Pieces of a base64 rank file, one ``piece rank`` a line."""
    with open(os.path.realpath(path), "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class PieceCounter:
    """Longest-match automaton over a piece vocabulary.

    ``count(word)`` is the number of greedy longest-match pieces of ``prefix + word``; a word that the vocabulary
    cannot spell is one unknown piece.
    """

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b" "):
        self.prefix = prefix
        self.edges: dict[int, int] = {}  # node << 8 | byte -> node
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                step = self.edges.get(key)
                if step is None:
                    step = self.edges[key] = len(final)
                    final.append(False)
                node = step
            if node:
                final[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, node in self.edges.items():
            children[key >> 8].append((key & 255, node))
        # fail[v]: where the unconsumed rest of v's string stands after popping; -1 if it cannot be spelled.
        fail, popped = [-1] * len(final), [0] * len(final)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for byte, node in children[parent]:
                todo.append(node)
                if final[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                at, count = fail[parent], popped[parent]
                while at >= 0 and (at << 8 | byte) not in self.edges:
                    count += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], popped[node] = self.edges[at << 8 | byte], count
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)

    def __getstate__(self) -> dict:
        keys = np.fromiter(self.edges, np.int64, len(self.edges))
        nodes = np.fromiter(self.edges.values(), np.int32, len(self.edges))
        return {"prefix": self.prefix, "keys": keys, "nodes": nodes, "fail": self.fail, "popped": self.popped}

    def __setstate__(self, state: dict) -> None:
        self.prefix, self.fail, self.popped = state["prefix"], state["fail"], state["popped"]
        self.edges = dict(zip(state["keys"].tolist(), state["nodes"].tolist(), strict=True))

    def counter(self):
        """A function from a word to its number of pieces."""
        edge, fail, popped, prefix = self.edges.get, self.fail.tolist(), self.popped.tolist(), self.prefix

        def count(word: bytes) -> int:
            node = total = 0
            for byte in prefix + word:
                while (step := edge(node << 8 | byte)) is None:
                    total += popped[node]
                    node = fail[node]
                    if node < 0:
                        return 1
                node = step
            while node:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            return total

        return count


class WordCache(dict):
    """Counts of words seen before; bounded, and filled by the automaton."""

    def __init__(self, count, limit: int = CACHE_WORDS):
        super().__init__()
        self.count, self.limit = count, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self.count(word)
        if len(word) <= 64:
            self[word] = found
        return found


def token_counts(df: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece counts of every whole text: ``doc_id, n_bytes, n_words, n_tokens``; a narrow map without a shuffle.

    Null and blank texts have no words and no tokens (``n_bytes`` of null is 0).  One row out for each row in, repeated
    rows and null ids included; texts of any length are counted whole; other columns are not read, whatever their names.  An empty table gives an empty result.
    """
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"vocabulary of {len(vocabulary)} pieces; at most {MAX_PIECES} can be broadcast")
    shipped = df.sparkSession.sparkContext.broadcast(PieceCounter(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(shipped.value.counter())
        look = cache.__getitem__
        for part in pieces(batches, "text"):
            sizes, words, tokens = [], [], []
            for text in utf8(part.column("text")):
                split = text.split()
                sizes.append(len(text))
                words.append(len(split))
                tokens.append(sum(map(look, split)))
            columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, words, tokens))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_words", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return narrow.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level piece counts of all ``documents``."""
    return token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), load_ranks(DEFAULT_VOCABULARY))
