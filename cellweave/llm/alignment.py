"""Cross-tokenizer alignment (operator 13) by a group dictionary.

A text is encoded by two tokenizers where it is read, once.  The byte offsets at which tokens of both end cut it into groups, and
every A token of a group is linked with every B token of it.  Texts repeat the same groups over and over, so a task interns the
groups of a chunk of texts (numpy hashes of whole chunks, no Python object a token) and keeps numbers instead: for each document the
numbers of its groups, for each distinct group its text (``a1,a2|b1``), and for each linked id pair the number of documents
that hold it.  A pair of only one distinct group is held by that group's documents; only pairs of several groups are followed
document by document.

Chunks meet in three small shuffles: pair counts are summed; distinct groups are expanded into links once in the whole corpus and
joined with the counts, which gives each group what one occurrence adds; and these results go back, by group, to the chunks that
have it, where documents add them up by number.  A chunk is bounded by bytes (or is one text), and holds a group once, so a group
that makes a third of all text is a row a chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import maybe_broadcast, pieces, read_table
from cellweave.llm.words import mix
from cellweave.sources.shared import materialise

DEFAULT_A = "/opt/tokenizers/byte_bpe_50k.json"
DEFAULT_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes of a chunk.
CHUNK_BYTES = 4 << 20
#: Pair counts are broadcast up to this many rows (three longs each), and joined by a shuffle beyond.
BROADCAST_PAIRS = 200_000
#: Links of a group up to which groups are expanded together; a longer group is expanded over its distinct ids.
SMALL_GROUP = 4096
#: Fixed value: how byte-level BPE files of this kind cut a text into words.
BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_SPACE = re.compile(r"\s{1000}")


class Side(NamedTuple):
    """One tokenizer: texts to lists of ids, and each id's bytes."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]


def byte_level_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_side(content: str) -> Side:
    """Tokenizer A of a ``tokenizers`` JSON file.

    Its merges run in ``tiktoken`` where they are the vocabulary's own order (a third of the time, same ids: tested over all code
    points and vocabulary entries).  Other files, and texts with very long white space, which that library's patterns
    cannot hold, go through ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(content)
    plain.encode_special_tokens = True
    spec = json.loads(content)
    special = {t["id"] for t in spec["added_tokens"]}
    alphabet = byte_level_alphabet()
    vocabulary = spec["model"]["vocab"]
    tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        tokens[i] = token.encode() if i in special else bytes(map(alphabet.__getitem__, token))
    merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
    merged = [vocabulary["".join(pair)] for pair in merges]
    ranked = merged == sorted(merged) and len(vocabulary) - len(special & set(vocabulary.values())) == 256 + len(merged) and not spec.get("normalizer")
    slow = lambda texts: [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    if not ranked:
        return Side(slow, tokens)
    fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in special}, special_tokens={})
    return Side(lambda texts: [slow([t])[0] if _LONG_SPACE.search(t) else fast.encode_ordinary(t) for t in texts], tokens)


def piece_side(content: bytes) -> Side:
    """Tokenizer B of a ``sentencepiece`` model file, which puts a space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    tokens = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


@lru_cache(maxsize=1)
def _sides(a: str, b: bytes) -> tuple[Side, Side, np.ndarray, np.ndarray]:
    left, right = byte_level_side(a), piece_side(b)
    return left, right, *(np.array([len(t) for t in side.tokens], np.int64) for side in (left, right))


class Groups(NamedTuple):
    """The groups of some texts, one after the other."""

    a: np.ndarray  #: ids
    b: np.ndarray
    a_start: np.ndarray  #: first A token of each group, and the number of tokens at the end
    b_start: np.ndarray
    docs: np.ndarray  #: text of each group


def _cut(a_ids: list[list[int]], b_ids: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Groups:
    """The groups of texts whose A and B bytes are the same, text by text."""
    a, b = (np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in ids)]).astype(np.int64) for ids in (a_ids, b_ids))
    a_end, b_end = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    total = int(a_end[-1]) if len(a) else 0
    at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    at_a[a_end], at_b[b_end] = True, True
    a_start = np.concatenate(([0], np.flatnonzero(at_b[a_end]) + 1))
    b_start = np.concatenate(([0], np.flatnonzero(at_a[b_end]) + 1))
    last = np.cumsum([len(x) for x in a_ids])  # a text's end is an end of both
    return Groups(a, b, a_start, b_start, np.searchsorted(last, a_start[:-1], side="right"))


def _hashes(ids: np.ndarray, start: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each group's ids in order."""
    place = np.arange(len(ids)) - np.repeat(start[:-1], np.diff(start))
    return np.add.reduceat(mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)), start[:-1])


def _expand(a: np.ndarray, b: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct links of each group: group, pair (A id << 32 | B id) and how often."""
    n_a, n_b = np.diff(a_start), np.diff(b_start)
    links = n_a * n_b
    small = np.flatnonzero(links <= SMALL_GROUP)
    owner = np.repeat(small, links[small])
    place = np.arange(len(owner)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    pair = a[a_start[owner] + place // n_b[owner]] << 32 | b[b_start[owner] + place % n_b[owner]]
    several = links[owner] > 1  # a single link needs no search for equals
    order = np.lexsort((pair[several], owner[several]))
    o, p = owner[several][order], pair[several][order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (p[1:] != p[:-1])))[: len(o)]
    first = np.flatnonzero(new)
    parts = [(owner[~several], pair[~several], np.ones(int((~several).sum()), np.int64)), (o[first], p[first], np.diff(np.append(first, len(o))))]
    for g in np.flatnonzero(links > SMALL_GROUP):
        (x, n), (y, m) = (np.unique(ids[s[g] : s[g + 1]], return_counts=True) for ids, s in ((a, a_start), (b, b_start)))
        parts.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), np.outer(n, m).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pair_documents(docs: np.ndarray, groups: np.ndarray, owner: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their numbers of documents, from distinct (document, group) and distinct (group, pair)."""
    pairs, which, held = np.unique(pair, return_inverse=True, return_counts=True)
    count = np.zeros(len(pairs), np.int64)
    alone = held[which] == 1
    count[which[alone]] = np.bincount(groups, minlength=int(owner.max(initial=-1)) + 1)[owner[alone]]
    # Pairs of several groups: each document counts once.
    order = np.argsort(owner[~alone], kind="stable")
    o, w = owner[~alone][order], which[~alone][order]
    low, high = np.searchsorted(o, groups), np.searchsorted(o, groups, side="right")
    n = high - low
    take = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    seen = np.unique(np.repeat(docs, n) * len(pairs) + w[take])
    return pairs, count + np.bincount(seen % max(1, len(pairs)), minlength=len(pairs))


def _split(ids: np.ndarray, start: np.ndarray) -> list[str]:
    text = list(map(str, ids.tolist()))
    return [",".join(text[x:y]) for x, y in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _picked(ids: np.ndarray, start: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and starts of some of the groups."""
    n = np.diff(start)[groups]
    to = np.concatenate(([0], np.cumsum(n)))
    return ids[np.repeat(start[:-1][groups] - to[:-1], n) + np.arange(to[-1])], to


FIELDS = [
    ("kind", "int"), ("chunk", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"),
    ("ids", "array<int>"), ("times", "array<int>"), ("local", "int"), ("grp", "string"), ("pair", "long"), ("docs", "long"),
]
DOCUMENT, GROUP, PAIR = range(3)


def _encode(df: DataFrame, a_content: str, b_content: bytes) -> DataFrame:
    """Of (doc_id, text): a row a document, a row a distinct group and a row a linked pair of each chunk."""
    shipped = df.sparkSession.sparkContext.broadcast((a_content, b_content))
    kind = df.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, a_sizes, b_sizes = _sides(*shipped.value)
        task = TaskContext.get().partitionId() << 32
        types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        for ordinal, part in enumerate(pieces(batches, "text", CHUNK_BYTES)):
            texts = part.column("text").to_pylist()
            a_all, b_all, fit = [], [], []
            for i, text in enumerate(texts):
                if not text:
                    continue
                (a,), (b,) = left.encode([f" {text}"]), right.encode([text])
                data = f" {text}".encode()
                a, b = np.array(a, np.int32), np.array(b, np.int32)
                # A's pieces are cuts of the text's own bytes, B's are of what it made of the text.
                if len(a) and len(b) and a_sizes[a].sum() == len(data) == b_sizes[b].sum() and b"".join(map(right.tokens.__getitem__, b.tolist())) == data:
                    fit.append(i)
                    a_all.append(a)
                    b_all.append(b)
            cut = _cut(a_all, b_all, a_sizes, b_sizes)
            rows = len(texts)
            columns = {"n_a": np.zeros(rows, np.int64), "n_b": np.zeros(rows, np.int64), "n_groups": np.zeros(rows, np.int64), "n_links": np.zeros(rows, np.int64)}
            digests, ids, times, start = [""] * rows, np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(rows + 1, np.int32)
            names, pairs, counts = [], np.empty(0, np.int64), np.empty(0, np.int64)
            if fit:
                place = np.array(fit)
                columns["n_a"][place], columns["n_b"][place] = [len(x) for x in a_all], [len(x) for x in b_all]
                columns["n_groups"][place] = per = np.bincount(cut.docs, minlength=len(fit))
                columns["n_links"][place] = np.add.reduceat(np.diff(cut.a_start) * np.diff(cut.b_start), np.cumsum(per) - per)
                key = mix(_hashes(cut.a, cut.a_start, 1) ^ mix(_hashes(cut.b, cut.b_start, 1 << 40)))
                _, first, number = np.unique(key, return_index=True, return_inverse=True)
                a_own, a_start = _picked(cut.a, cut.a_start, first)
                b_own, b_start = _picked(cut.b, cut.b_start, first)
                names = [f"{x}|{y}" for x, y in zip(_split(a_own, a_start), _split(b_own, b_start), strict=True)]
                at = np.cumsum(per) - per
                for i, x, n in zip(fit, at.tolist(), per.tolist(), strict=True):
                    digests[i] = hashlib.sha256(";".join([names[k] for k in number[x : x + n].tolist()]).encode()).hexdigest()
                held, times = np.unique(cut.docs * len(first) + number, return_counts=True)
                docs, ids = held // len(first), held % len(first)
                start[1:][place] = np.bincount(docs, minlength=len(fit))
                start = np.cumsum(start, dtype=np.int32)
                owner, pair, _ = _expand(a_own, b_own, a_start, b_start)
                pairs, counts = _pair_documents(docs, ids, owner, pair)
            columns |= {"ids": pa.ListArray.from_arrays(pa.array(start), pa.array(ids.astype(np.int32))), "times": pa.ListArray.from_arrays(pa.array(start), pa.array(times.astype(np.int32))), "groups_sha256": digests}
            sets = [(DOCUMENT, rows, columns | {"doc_id": part.column("doc_id")}), (GROUP, len(names), {"local": np.arange(len(names), dtype=np.int32), "grp": names}), (PAIR, len(pairs), {"pair": pairs, "docs": counts})]
            for what, n, own in sets:
                own |= {"kind": np.full(n, what, np.int32), "chunk": np.full(n, task | ordinal, np.int64)}
                made = [x if isinstance(x := own[name], pa.Array) else pa.array(x, types[t]) for name, t in FIELDS if name in own]
                have = [name for name, _ in FIELDS if name in own]
                by = dict(zip(have, made, strict=True))
                yield pa.RecordBatch.from_arrays([own.get("doc_id", pa.nulls(n, part.schema.field("doc_id").type)), *(by[name] if name in by else pa.nulls(n, types[t]) for name, t in FIELDS)], ["doc_id", *(name for name, _ in FIELDS)])

    return df.mapInArrow(encode, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in FIELDS))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct links of groups in their text form."""
    for part in pieces(batches, "grp", 1 << 20):
        names = part.column("grp")
        sides = [[np.array(x.split(","), np.int64) for x in side] for side in zip(*(x.split("|") for x in names.to_pylist()), strict=True)]
        a_start, b_start = (np.concatenate(([0], np.cumsum([len(x) for x in side]))) for side in sides)
        owner, pair, times = _expand(np.concatenate(sides[0]), np.concatenate(sides[1]), a_start, b_start)
        for at in range(0, len(owner), 1 << 17):
            cut = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owner[cut])), pa.array(pair[cut]), pa.array(times[cut])], ["grp", "pair", "times"])


def align(df: DataFrame, a_path: str = DEFAULT_A, b_path: str = DEFAULT_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: a row for each document.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have no tokens: zeros and an empty
    digest.  Repeated rows are documents of their own, in counts too; null ids stay.  Pairs that tie for an A id's highest count
    are all best.  A very long text is a chunk of its own, and its groups are expanded over distinct ids.  An empty table
    gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    with open(os.path.realpath(a_path), encoding="utf-8") as a, open(os.path.realpath(b_path), "rb") as b:
        a_content, b_content = a.read(), b.read()
    encoded = materialise(_encode(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), a_content, b_content), "aligned")
    counts = encoded.where(F.col("kind") == PAIR).groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = materialise(counts, "pairs").select("pair", "n", F.shiftright("pair", 32).alias("a"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(maybe_broadcast(highest, BROADCAST_PAIRS), "a").select(F.col("pair").alias("_pair"), "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    groups = encoded.where(F.col("kind") == GROUP).select("chunk", "local", "grp")
    links = groups.select("grp").distinct().mapInArrow(_links, "grp string, pair long, times long")
    adds = links.join(maybe_broadcast(counts, BROADCAST_PAIRS), F.col("pair") == F.col("_pair")).groupBy("grp").agg(F.sum(F.col("times") * F.col("best")).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    back = groups.join(adds.withColumnRenamed("grp", "_grp"), F.col("grp") == F.col("_grp")).select(F.col("chunk").alias("_chunk"), "local", "best", "total")
    documents = encoded.where(F.col("kind") == DOCUMENT).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "times")
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add_up(docs: pa.Table, results: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        local = results.column("local").to_numpy()
        sums = []
        flat = [np.concatenate([np.empty(0, np.int64), *(c.flatten().to_numpy() for c in docs.column(n).chunks)]).astype(np.int64) for n in ("ids", "times")]
        ends = np.cumsum([0, *(int(x or 0) for c in docs.column("ids").chunks for x in c.value_lengths().to_pylist())])
        for name in ("best", "total"):
            by = np.zeros(len(local), np.int64)
            by[local] = results.column(name).to_numpy()
            upto = np.concatenate(([0], np.cumsum(by[flat[0]] * flat[1])))
            sums.append(pa.array(upto[ends[1:]] - upto[ends[:-1]]))
        kept = [docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*kept, *sums, docs.column("groups_sha256")], names)

    return documents.groupBy("chunk").cogroup(back.groupBy("_chunk")).applyInArrow(add_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public tokenizers align in all ``documents``."""
    return align(read_table(spark, sf_dir, "documents", "doc_id", "text"))
