"""Benchmark decontamination (operator 4): an FM-index per training shard.

Documents are cut into shards where they are read; nothing is shuffled.  Within a shard, words become numbers of the
benchmark's vocabulary, and only stretches in which every word pair occurs in some benchmark phrase can hold an
occurrence: these make the shard's text.  Its FM-index (Burrows-Wheeler transform in a wavelet matrix, sampled
suffix positions) is searched backwards for all phrases at once, occurrences are located by walking to the next sampled
position, and their spans are merged.

The phrases are broadcast in blocks of ``BLOCK_WORDS`` benchmark words, each searched in turn inside the same task.  At
most ``MAX_BLOCKS`` blocks are broadcast at a time.  With more, the documents are read once for every group of that many blocks; a pass
writes what it found of the texts that are hit, and its broadcast goes before the next one comes.  Findings are united by text
and joined back to the rows: by broadcast if the texts hit were counted and are few, by an ordinary join otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import maybe_broadcast, pieces, read_table, utf8
from cellweave.sources.shared import materialise

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Benchmark words a block; a block's phrases are held in memory by every worker (about 1 KB a word).
BLOCK_WORDS = 200_000
#: Blocks a worker holds at once: a million words, or as many items where those are longer than a block.
MAX_BLOCKS = 5
SAMPLE = 16
#: Shards hold up to about this many kept words.
SHARD_WORDS = 1 << 19

#: A task forgets which texts it has handed on beyond this many.
SEEN = 1 << 18
#: Texts that are hit are broadcast up to this many.
BROADCAST_TEXTS = 50_000

#: Everything but digits, letters and non-ASCII bytes separates words; A-Z are lower-cased.
_TO_WORDS = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ends once all suffixes are told apart."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2
        if step >= n:
            return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Rank over a sequence of small integers, one bit level at a time."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            below = np.concatenate(([0], np.cumsum(ones, dtype=np.int32))).astype(np.int32)
            self.levels.append((bit, ones, below, len(values) - int(below[-1])))
            values = np.concatenate((values[~ones], values[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol[i]`` before position ``at[i]``."""
        low = np.zeros_like(at)
        for bit, _, below, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = below[at], below[low]
            at = np.where(one, zeros + a, at - a)
            low = np.where(one, zeros + b, low - b)
        return at - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for bit, ones, below, zeros in self.levels:
            one = ones[at]
            symbol |= one.astype(at.dtype) << bit
            a, b = below[at], below[low]
            at = np.where(one, zeros + a, at - a)
            low = np.where(one, zeros + b, low - b)
        return symbol, at - low


class FMIndex:
    """FM-index of a text of integers in [1, size); 0 ends it."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.tree = WaveletMatrix(text[order - 1], max(1, int(size - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.sampled = order % sample == 0
        self.place = np.concatenate(([0], np.cumsum(self.sampled))).astype(np.int64)
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows, aligned left) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            open_ = np.flatnonzero((lengths > back) & (high > low))
            if not len(open_):
                break
            symbol = phrases[open_, lengths[open_] - 1 - back]
            low[open_] = self.first[symbol] + self.tree.rank(symbol, low[open_])
            high[open_] = self.first[symbol] + self.tree.rank(symbol, high[open_])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back until a sampled position."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            hit = self.sampled[at[open_]]
            done = open_[hit]
            out[done] = self.positions[self.place[at[done]]] + steps[done]
            open_ = open_[~hit]
            symbol, before = self.tree.access_rank(at[open_])
            at[open_] = self.first[symbol] + before
            steps[open_] += 1
        return out


class Phrases:
    """The windows of one block of items, ready for search."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 2) for w in words)  # 0 ends a text, 1 parts stretches
            for i in range(max(1, len(ids) - window + 1)):
                owners.setdefault(ids[i : i + window], set()).add(name)
        self.vocabulary, self.size = vocabulary, len(vocabulary) + 2
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.phrases = np.zeros((len(owners), window), np.int64)
        for row, ids in zip(self.phrases, owners, strict=True):
            row[: len(ids)] = ids
        self.shortest = int(self.lengths.min(initial=window))
        self.pairs = np.unique(np.array([a * self.size + b for ids in owners for a, b in zip(ids, ids[1:], strict=False)], np.int64))
        # A bit map of the pairs' hashes settles most look-ups; the sorted pairs settle the rest.
        self.hashed = np.zeros(1 << 20, bool)
        self.hashed[self._hash(self.pairs)] = True

    @staticmethod
    def _hash(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def linked(self, ids: np.ndarray) -> np.ndarray:
        """For each neighbouring two of ``ids``, whether some phrase has this pair."""
        key = ids[:-1] * self.size + ids[1:]
        out = self.hashed[self._hash(key)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.searchsorted(self.pairs, key[at])
            out[at] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == key[at]
        return out


def _stretches(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of linked words that are long enough for some phrase."""
    known = ids > 1
    joined = phrases.linked(ids) & known[:-1] & known[1:] if len(ids) > 1 else np.zeros(0, bool)
    starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
    ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
    long_ = ends - starts >= phrases.shortest
    return starts[long_], ends[long_]


def _search_shard(ids: np.ndarray, stretches: tuple[np.ndarray, np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(position in ids, phrase) of every occurrence in the shard's stretches."""
    starts, ends = stretches
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    text = np.ones(int(offsets[-1]), np.int64)
    source = np.zeros(len(text), np.int64)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    source_at = np.repeat(starts, lengths) + inside
    text_at = np.repeat(offsets[:-1], lengths) + inside
    text[text_at], source[text_at] = ids[source_at], source_at
    index = FMIndex(text, phrases.size)
    low, high = index.search(phrases.phrases, phrases.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    rows = np.repeat(low[found], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return source[index.locate(rows)], np.repeat(found, counts)


def _hits(words: list[list[bytes]], blocks: list[Phrases]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """For documents given as words: where each starts in their concatenation, which words are hit, and by what items."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    hit = np.zeros(int(begins[-1]) + 1, np.int64)
    items: list[set[str]] = [set() for _ in words]
    for phrases in blocks:
        if not len(phrases.lengths):
            continue
        ids = np.ones(int(begins[-1]) + len(words), np.int64)  # one part sign after each document
        get = phrases.vocabulary.get
        at = 0
        for each in words:
            ids[at : at + len(each)] = np.fromiter(map(get, each, repeat(1)), np.int64, len(each))
            at += len(each) + 1
        starts, ends = _stretches(ids, phrases)
        doc_of = lambda position: np.searchsorted(begins[:-1] + np.arange(len(words)), position, side="right") - 1
        filled = np.cumsum(ends - starts + 1)
        cut = 0
        while cut < len(starts):
            until = max(cut + 1, int(np.searchsorted(filled, (filled[cut - 1] if cut else 0) + SHARD_WORDS)))
            position, phrase = _search_shard(ids, (starts[cut:until], ends[cut:until]), phrases)
            cut = until
            doc = doc_of(position)
            first = position - doc
            np.add.at(hit, first, 1)
            np.add.at(hit, first + phrases.lengths[phrase], -1)
            for d, p in set(zip(doc.tolist(), phrase.tolist(), strict=True)):
                items[d].update(phrases.owners[p])
    return begins, np.cumsum(hit)[:-1] > 0, items


def _spans_of(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "spans array<struct<start: long, end: long>>, items array<string>"


def _hits_of_group(shipped: list[Broadcast]):
    """Of (k1, k2, _text): spans and items of the texts that windows of these blocks hit, a text once a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, seen = [b.value for b in shipped], set()
        for part in pieces(batches, "_text"):
            begins, hit, items = _hits([item_words(x) for x in utf8(part.column("_text"))], blocks)
            rows = []
            for d, key in enumerate(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=True)):
                if items[d] and key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    rows.append((*key, _spans_of(hit[begins[d] : begins[d + 1]]), sorted(items[d])))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), _SPANS, pa.list_(pa.string())), strict=True)], ["k1", "k2", "spans", "items"])

    return search


def _united(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows with the spans and items of all passes (or null): the result's columns."""
    for part in pieces(batches, "_text"):
        sizes = [len(item_words(x)) for x in utf8(part.column("_text"))]
        n_hit, spans, items = [], [], []
        for n, found, names in zip(sizes, part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True):
            hit = np.zeros(n, bool)
            for s in found or ():
                hit[s["start"] : s["end"]] = True
            n_hit.append(int(hit.sum()))
            spans.append(_spans_of(hit) if found else [])
            items.append(names or [])
        columns = [*(part.column(c) for c in others), pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)]
        yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "n_hit", "items", "spans"])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words (or one item), in item order."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for name, text in benchmark.toLocalIterator():
        words = item_words((text or "").encode())
        if not words:
            continue
        if held and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((name, words))
        held += len(words)
    if block:
        yield block


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` (and ``keep`` columns) for every row.

    ``items`` are the ids (as strings, sorted) of items with an occurring window; ``spans`` the merged word ranges
    [start, end) to remove.  Null texts have no words; items without words have no window, one shorter than the window is
    one window as a whole.  Items with equal ids are one item; a null item id reads as ``null``.  Repeated rows and
    null ids get a row each; texts of any length are searched whole; an empty table on either side gives no hits.  Columns not kept
    are not read, whatever their names.
    """
    context = df.sparkSession.sparkContext
    blocks = _blocks(benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("null")), benchmark[item_text_col].cast("string")))
    ship = lambda: [context.broadcast(Phrases(block, window)) for block in islice(blocks, MAX_BLOCKS)]
    shipped = ship()
    others = ["doc_id", *keep]
    narrow = df.select(df[id_col].alias("doc_id"), *keep, df[text_col].alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name != "_text") + "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.value for b in shipped]
        for part in pieces(batches, "_text"):
            begins, hit, items = _hits([item_words(x) for x in utf8(part.column("_text"))], held)
            upto = np.concatenate(([0], np.cumsum(hit)))
            n_hit = upto[begins[1:]] - upto[begins[:-1]]
            spans = [_spans_of(hit[begins[d] : begins[d + 1]]) if n else [] for d, n in enumerate(n_hit.tolist())]
            columns = [*(part.column(c) for c in others), pa.array(np.diff(begins)), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "n_hit", "items", "spans"])

    following = ship() if len(shipped) == MAX_BLOCKS else []
    if not following:
        return narrow.mapInArrow(search, schema)
    # Texts are told by two 64-bit hashes: what a text is hit by does not depend on its row.
    keys = {"k1": F.xxhash64("_text"), "k2": F.xxhash64(F.lit(1), F.col("_text"))}
    passes = []
    while shipped:
        passes.append(materialise(narrow.select(F.col("_text")).withColumns(keys).mapInArrow(_hits_of_group(shipped), f"k1 long, k2 long, {_FOUND}"), "hits"))
        for b in shipped:
            b.destroy()
        shipped, following = following, ship() if len(following) == MAX_BLOCKS else []
    every = reduce(DataFrame.unionByName, passes).groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    found = every.agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = maybe_broadcast(materialise(found, "found"), BROADCAST_TEXTS)
    joined = narrow.withColumns(keys).join(found, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select(*others, "_text", "spans", "items")
    return joined.mapInArrow(lambda batches: _united(batches, others), schema)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not contaminated, unchanged, with ``df``'s columns, whatever their names.

    Null texts and texts without words stay; repeated rows are judged each; texts of any length are searched whole; an empty table stays empty.
    """
    names = df.columns
    marked = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)])
    ident = f"c{names.index(text_col)}"
    found = find_contamination(marked, benchmark, ident, ident, item_col, item_text_col, keep=tuple(marked.columns))
    kept = found.where(~contaminated())
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all ``benchmark`` items in all ``documents``."""
    found = find_contamination(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    listed = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(words)) AS n, array_to_string(words[i:i + 12], ' ') AS phrase
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0)
), lengths AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, n, i, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n)
), found AS (
  SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
