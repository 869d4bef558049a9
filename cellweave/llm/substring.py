"""Substring dedup (operator 2): suffix automata over shards of repeated passages.

A window is ``threshold`` consecutive words of one document; a word goes if a window that covers it starts anywhere else,
too.  Streaming every document past an automaton of every shard of the corpus would cost shards times documents, so
documents are routed first, without losing a match:

* Each window has one anchor, the leftmost smallest hash of its ``anchor``-word grams; equal windows have equal anchors
  at equal offsets.  Neighbouring windows mostly share an anchor, so there is about one anchor for a dozen words.
* The windows of one anchor position form a context.  Contexts are counted by (anchor, context) with map-side
  aggregation, so a passage in a third of all documents costs a counter per task and one copy of its words.
* The words of an anchor's contexts (one copy of each) form a reference shard: its suffix automaton, with occurrence
  counts, is built, and each context is streamed through it for its matching statistics, which tell which of its windows
  occur again.  Every verdict comes from an automaton.
* Shards are bounded.  An anchor with more than ``SHARD_CONTEXTS`` different contexts (a common phrase in ever new
  surroundings) is dealt out again: inside its contexts, windows get anchors of longer grams, and what those have in
  common forms shards in turn.  Anchors that occur once drop out at every step.  With grams as long as a window, equal anchors
  are equal windows, so the steps end, whatever the number of contexts.  A context yields about four rows a step.

The verdicts, a bit for each window of a context, are joined to the contexts' documents, and the maximal spans that the
repeated windows cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import dealt_anew, pieces, read_table, utf8
from cellweave.llm.words import hash_words, mix
from cellweave.sources.shared import materialise

THRESHOLD = 35
ANCHOR = 12
#: Different contexts of one anchor that share an automaton; an anchor with more is dealt out by longer anchors.
SHARD_CONTEXTS = 64
#: Text bytes a step of finding anchors: each word takes some dozen numbers meanwhile.
STEP_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mixed polynomial hash of every ``n`` neighbouring values."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[i : i + len(out)]
    return mix(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def contexts_of(hashes: np.ndarray, sizes: np.ndarray, threshold: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of texts given as their words' hashes, one text after the other: for each anchor position its text, its hash, its
    context's first window (as a place in the text), the number of windows in it, and the context's hash (of its words and of
    the anchor's place in it)."""
    n = len(hashes) - threshold + 1
    if n <= 0:
        return tuple(np.empty(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    grams = _grams(hashes, anchor)
    width = threshold - anchor + 1
    # Sliding leftmost minimum by doubling: best[i] is the place of the least gram among ``span`` from i.
    best, span = np.arange(len(grams)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[a] <= grams[b], a, b)
        span += step
    best = best[:n]
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[:n] == text[threshold - 1 :]
    fresh = np.concatenate(([True], (best[1:] != best[:-1]) | (text[1:n] != text[: n - 1]) | ~inside[:-1]))
    first = np.flatnonzero(fresh & inside)
    edge = np.append(np.flatnonzero(fresh | ~inside), n)
    windows = edge[np.searchsorted(edge, first, side="right")] - first
    place = best[first]
    ends = first + windows + threshold - 1
    # Prefix hashes: the part [s, e) has (P[e] - P[s]) / base^s.
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64)))
    content = (prefix[ends] - prefix[first]) * _powers(_INVERSE, len(hashes))[first]
    shape = (place - first).astype(np.uint64) << np.uint64(32) | windows.astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    return text[first], grams[place], first - begins[text[first]], windows, mix(content ^ mix(shape + np.uint64(1)))


def _anchors(threshold: int, anchor: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", STEP_BYTES):
            text, h, first, windows, context = contexts_of(*hash_words(part.column("text")), threshold, anchor)
            rid = part.column("rid").to_numpy()[text]
            columns = [pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(rid), pa.array(first, pa.int32()), pa.array(windows, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "context", "rid", "first", "windows"])

    return find


class SuffixAutomaton:
    """Generalised suffix automaton of weighted sequences, with the number of occurrences of each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _extend(self, last: int, symbol) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(symbol)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, symbol, q)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.count.append(0)
        at = last
        while at >= 0 and symbol not in nexts[at]:
            nexts[at][symbol] = new
            at = link[at]
        if at >= 0:
            q = nexts[at][symbol]
            link[new] = q if length[q] == length[at] + 1 else self._clone(at, symbol, q)
        return new

    def _clone(self, at: int, symbol, q: int) -> int:
        nexts, link = self.next, self.link
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        self.length.append(self.length[at] + 1)
        self.count.append(0)
        link[q] = clone
        while at >= 0 and nexts[at].get(symbol) == q:
            nexts[at][symbol] = clone
            at = link[at]
        return clone

    def add(self, sequence, weight: int) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.count[last] += weight

    def finish(self) -> None:
        """Counts of all states: those that end in a state end in its suffix link's, too."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state] if self.link[state] > 0 else 0

    def repeated(self, sequence, threshold: int) -> list[int]:
        """Starts of the windows of ``sequence`` that occur twice or more among the added sequences."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for i, symbol in enumerate(sequence):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state, matched = nexts[state][symbol], matched + 1
            while length[link[state]] >= threshold if state else False:
                state = link[state]
                matched = length[state]
            if matched >= threshold and self.count[state] >= 2:
                out.append(i - threshold + 1)
        return out


def _shard_verdicts(threshold: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, context, n, words) sorted by h: an automaton for each anchor's contexts."""

        def close(group: list[tuple[int, int, bytes]], h: int) -> pa.RecordBatch:
            automaton = SuffixAutomaton()
            split = [(context, n, words.split()) for context, n, words in group]
            for _, n, words in split:
                automaton.add(words, n)
            automaton.finish()
            bits = [sum(1 << start for start in automaton.repeated(words, threshold)) for _, _, words in split]
            return pa.RecordBatch.from_arrays(
                [pa.array([h] * len(split), pa.int64()), pa.array([x[0] for x in split], pa.int64()), pa.array(bits, pa.int64())], ["h", "context", "bits"]
            )

        group: list[tuple[int, int, bytes]] = []
        last = None
        for batch in batches:
            for h, context, n, words in zip(*(batch.column(c).to_pylist() for c in ("h", "context", "n", "words")), strict=True):
                if h != last and group:
                    yield close(group, last)
                    group = []
                last = h
                if not group or group[-1][0] != context:  # else from an equal row
                    group.append((context, n, words))
        if group:
            yield close(group, last)

    return judge


def _passages(threshold: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the asked contexts of each document; of equal rows, a task takes one."""
        done: set[int] = set()
        for part in pieces(batches, "text"):
            rows: list[list] = [[], [], [], []]
            for rid, text, asked in zip(part.column("rid").to_pylist(), utf8(part.column("text")), part.column("asked").to_pylist(), strict=True):
                if rid in done:
                    continue
                done.add(rid)
                words = text.split()
                for a in asked:
                    for column, value in zip(rows, (a["h"], a["context"], a["n"], b" ".join(words[a["first"] : a["first"] + a["windows"] + threshold - 1])), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["h", "context", "n", "words"])

    return cut


def _deal_out(threshold: int, anchor: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The contexts inside contexts (h, context, n, words) by longer anchors, and where they are in them."""
        for part in pieces(batches, "words", STEP_BYTES):
            of, h, first, windows, context = contexts_of(*hash_words(part.column("words").cast(pa.string())), threshold, anchor)
            split = [x.split() for x in part.column("words").to_pylist()]
            words = [b" ".join(split[i][at : at + n + threshold - 1]) for i, at, n in zip(of.tolist(), first.tolist(), windows.tolist(), strict=True)]
            outer = (part.column(c).to_numpy()[of] for c in ("h", "context", "n"))
            columns = [*map(pa.array, outer), pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(first, pa.int32()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["outer_h", "outer_context", "n", "h", "context", "at", "words"])

    return deal


def _verdicts(contexts: DataFrame, threshold: int, anchor: int) -> DataFrame:
    """``h, context, bits`` of contexts (h, context, n, words), rows of which may be repeated: a bit for each window that occurs
    twice or more among those of its anchor."""
    kinds = contexts.select("h", "context").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > SHARD_CONTEXTS).select(dealt_anew(F.col("h")).alias("_h"))
    kinds = materialise(kinds, "common")
    alone = contexts if kinds.isEmpty() else contexts.join(kinds, F.col("h") == F.col("_h"), "left_anti")
    judged = alone.repartition("h").sortWithinPartitions("h", "context").mapInArrow(_shard_verdicts(threshold), "h long, context long, bits long")
    if kinds.isEmpty():
        return judged
    longer = min(threshold, anchor + max(1, (threshold - anchor + 1) // 2))
    common = contexts.join(kinds, F.col("h") == F.col("_h"), "left_semi").dropDuplicates(["h", "context"])
    dealt = common.mapInArrow(_deal_out(threshold, longer), "outer_h long, outer_context long, n long, h long, context long, at int, words binary")
    dealt = materialise(dealt, "dealt")
    again = dealt.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select(dealt_anew(F.col("h")).alias("_h"))
    shared = materialise(dealt.join(again, F.col("h") == F.col("_h"), "left_semi"), "shared")
    inner = _verdicts(materialise(shared.groupBy("h", "context").agg(F.sum("n").alias("n"), F.first("words").alias("words")), "inner"), threshold, longer)
    inner = inner.where("bits <> 0").select(dealt_anew(F.col("h")).alias("_h"), F.col("context").alias("_context"), "bits")
    met = shared.join(inner, (F.col("h") == F.col("_h")) & (F.col("context") == F.col("_context")))
    outer = met.groupBy("outer_h", "outer_context").agg(F.expr("bit_or(shiftleft(bits, at))").alias("bits"))
    return judged.unionByName(outer.select(F.col("outer_h").alias("h"), F.col("outer_context").alias("context"), "bits"))


def _removal(threshold: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, marks in zip(utf8(part.column("text")), part.column("marks").to_pylist(), strict=True):
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int64)
                for mark in marks or ():
                    bits = mark["bits"]
                    for i in range(mark["windows"]):
                        if bits >> i & 1:
                            cover[mark["first"] + i] += 1
                            cover[mark["first"] + i + threshold] -= 1
                gone = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False])).astype(np.int8)
                edge = np.diff(gone)
                starts, ends = np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()
                left, at = [], 0
                for a, b in zip(starts, ends, strict=True):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                spans.append([{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)])
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return remove


def dedup_substrings(df: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` for every row: the text that is left, and the word spans removed.

    Every occurrence of a repeated window goes, the first included, wherever its copies are (in the same document, too).
    Null texts have no words; texts of any length are taken whole.  Repeated rows are copies of each other like any documents,
    whatever their ids.  Columns of ``df`` other than the two named are not read, whatever their names.  An empty
    table gives an empty result.  ``threshold - anchor`` must be under 63 (a context's windows are bits of a long).
    """
    if not 0 < anchor <= threshold or threshold - anchor >= 63:
        raise ValueError("need 0 < anchor <= threshold < anchor + 63")
    docs = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    # Rows are named by their content, so the name outlives a lost executor; equal rows share a name and a verdict.
    docs = docs.withColumn("rid", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = docs.select("rid", "text").mapInArrow(_anchors(threshold, anchor), "h long, context long, rid long, first int, windows int")
    found = materialise(found, "anchors")
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(dealt_anew(F.col("h")).alias("_h"))
    places = materialise(found.join(again, F.col("h") == F.col("_h")).select("h", "context", "rid", "first", "windows"), "places")
    counted = places.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "windows")).alias("rep"))
    wanted = F.struct("h", "context", "n", F.col("rep.first").alias("first"), F.col("rep.windows").alias("windows"))
    asked = counted.groupBy(F.col("rep.rid").alias("_rid")).agg(F.collect_set(wanted).alias("asked"))
    texts = docs.join(asked.hint("shuffle_hash"), F.col("rid") == F.col("_rid")).select("rid", "text", "asked")
    contexts = texts.mapInArrow(_passages(threshold), "h long, context long, n long, words binary")
    verdicts = _verdicts(materialise(contexts, "contexts"), threshold, anchor).where("bits <> 0")
    verdicts = verdicts.select(dealt_anew(F.col("h")).alias("_h"), F.col("context").alias("_context"), "bits")
    hit = places.join(verdicts, (F.col("h") == F.col("_h")) & (F.col("context") == F.col("_context"))).select("rid", "first", "windows", "bits")
    marks = hit.groupBy(F.col("rid").alias("_rid")).agg(F.collect_set(F.struct("first", "windows", "bits")).alias("marks"))
    out = docs.join(marks.hint("shuffle_hash"), F.col("rid") == F.col("_rid"), "left").select("doc_id", "text", "rid", "marks")
    kind = df.schema[id_col].dataType.simpleString()
    return out.mapInArrow(_removal(threshold), f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows removed from all ``documents``."""
    found = dedup_substrings(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35
), w AS (
  SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS words35 FROM p
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY words35) AS n FROM w) WHERE n >= 2
), t AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), m AS (
  SELECT t.rid, t.i, word, coalesce(t.i - max(again.i) OVER (PARTITION BY t.rid ORDER BY t.i) < 35, false) AS gone
  FROM t LEFT JOIN again ON t.rid = again.rid AND t.i = again.i
), kept AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM m GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
