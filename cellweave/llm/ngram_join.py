"""N-gram Jaccard join (operator 12) by vertical partitioning of the global n-gram order.

Every n-gram is a 64-bit hash, and all n-grams have one global order: those seldom met come first, by hash, and the ones that tasks
meet again and again come last, by how often.  Any order gives the same links; this one makes candidates few.

* The head of the order decides who can link: two texts within the threshold share an n-gram among the first ``n - ceil(t n) + 1``
  of each (prefix filter).  One shuffle of those n-grams finds texts that meet; most n-grams meet nobody and end there.
* Texts that meet carry a parity sketch (a bit for each hash residue).  Differing bits never exceed differing n-grams, so a
  pair whose sketches differ in more bits than the threshold allows is no candidate; this loses none.  A group hands
  on a spanning forest of its candidates, never its pairs; a group beyond ``HOT_GROUP`` texts hands on a star.
* Texts connected by candidates form clusters.  Each set moves to its cluster once; a cluster beyond a block's size is dealt out over
  pairs of blocks.  There the order is cut into fragments of ``FRAGMENT`` n-grams, the overlaps of all pairs are counted for
  each fragment on its own, by bit rows and population counts, and summed by pair.  A tile hands on a spanning forest of its links.

Equal sets are one node from the first shuffle on, whatever their number.  Texts are read three times and moved only if more than
``BROADCAST_ROWS`` of them are in clusters; sets are never written but for those.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import dealt_anew, maybe_broadcast, pieces, read_table
from cellweave.llm.components import components, local_components
from cellweave.llm.words import hash_words, mix
from cellweave.sources.shared import materialise

SHINGLE = 5
#: Links are at this percentage of the union.
PERCENT = 80
#: N-grams of a chunk of texts, within which n-grams of several texts are counted.
CHUNK_GRAMS = 1 << 21
#: At most so many of the commonest n-grams have a place of their own in the order (16 bytes each, broadcast); others go by hash.
LISTED = 1 << 19
#: Texts under one n-gram beyond which they are a star instead of being compared.
HOT_GROUP = 2048
#: Cluster members, and texts, are broadcast up to this many.
BROADCAST_ROWS = 200_000
#: Texts and n-grams of a block, and n-grams of a fragment of the order.
BLOCK_ROWS, BLOCK_GRAMS, FRAGMENT = 2048, 1 << 20, 2048
#: A task forgets which sets it has handed on beyond this many; they are then handed on again.
SEEN = 1 << 20

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _step(k: int) -> np.uint64:
    return mix(_STEP[:1] + np.uint64(k))[0] | np.uint64(1)


def gram_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct n-grams of each text as rising hashes: the whole sequence where words are fewer, none without words."""
    hashes, sizes = hash_words(texts, lower=True)
    grams = np.zeros(len(hashes), np.uint64)
    whole = max(0, len(hashes) - shingle + 1)
    for k in range(shingle):
        grams[:whole] += mix(hashes[k : k + whole] * _step(k))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= shingle:
            out.append(np.unique(grams[at : at + n - shingle + 1]))
        else:
            own = hashes[at : at + n]
            out.append(np.array([sum(int(mix(own[k : k + 1] * _step(k))[0]) for k in range(n)) + n & (1 << 64) - 1] if n else [], np.uint64))
        at += n
    return out


def set_name(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(mix(grams ^ _STEP[0]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the hashes' residues modulo a power of two of at least half the set's size."""
    bits = max(64, 1 << max(0, (len(grams) // 2 - 1)).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + percent * n // -100 + 1


class Order(NamedTuple):
    """The common n-grams, rising, and how often they were met; all others come before them, by hash."""

    grams: np.ndarray
    counts: np.ndarray

    def prefix(self, grams: np.ndarray, percent: int) -> np.ndarray:
        """The first n-grams of a set (rising hashes) in the order."""
        size = prefix_size(len(grams), percent)
        if not len(self.grams):
            return grams[:size]
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        listed = self.grams[at] == grams
        rare = grams[~listed]
        if len(rare) >= size:
            return rare[:size]
        common = grams[listed][np.argsort(self.counts[at[listed]], kind="stable")]
        return np.concatenate([rare, common[: size - len(rare)]])


def _described(texts: DataFrame, shingle: int) -> DataFrame:
    """Of (doc_id, tkey, text): a row a document (kind 0), and the n-grams that several different sets of a chunk hold (kind 1)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def common() -> pa.RecordBatch:
            every = np.sort(np.concatenate([np.empty(0, np.uint64), *held.values()]))
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))[: len(every)])
            n = np.diff(np.append(first, len(every)))
            grams, n = every[first][n > 1].view(np.int64), n[n > 1]
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), kind), none, none, none, pa.nulls(len(n), pa.binary()), pa.array(grams), pa.array(n)], names)

        kind, names = None, ["doc_id", "tkey", "n", "name", "sketch", "gram", "docs"]
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in pieces(iter([batch]), "text"):
                sets = gram_sets(part.column("text"), shingle)
                own = [set_name(g) if len(g) else None for g in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), pa.array([len(g) for g in sets], pa.int64()), pa.array(own, pa.int64()), pa.array([sketch(g) if len(g) else None for g in sets], pa.binary()), none, none], names)
                for name, grams in zip(own, sets, strict=True):
                    if name is not None and name not in held:
                        held[name] = grams
                        size += len(grams)
                        if size >= CHUNK_GRAMS:
                            yield common()
                            held, size = {}, 0
        if held:
            yield common()

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(describe, f"doc_id {kind}, tkey long, n long, name long, sketch binary, gram long, docs long")


def _order(counted: DataFrame) -> Order:
    """The common n-grams of rows (gram, docs): the most often met that are at most ``LISTED``."""
    total = materialise(counted.groupBy("gram").agg(F.sum("docs").alias("docs")), "grams")
    level = F.floor(F.log2("docs")).cast("int")
    least, room = 63, LISTED
    for r in sorted(total.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    table = total.where(level >= least).toArrow()
    grams = table.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return Order(grams[order], table.column("docs").to_numpy()[order].astype(np.int32))


def _prefixes(texts: DataFrame, order: Order, shingle: int, percent: int) -> DataFrame:
    """Rows (gram, name, n): the n-grams under which a set can meet others."""
    shipped = texts.sparkSession.sparkContext.broadcast(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = Order(*shipped.value), set()
        for part in pieces(batches, "text"):
            grams, names, sizes = [], [], []
            for own in gram_sets(part.column("text"), shingle):
                if not len(own) or (name := set_name(own)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                grams.append(held.prefix(own, percent))
                names.append(name)
                sizes.append(len(own))
            each = [len(g) for g in grams]
            rows = [np.concatenate([np.empty(0, np.uint64), *grams]).view(np.int64), np.repeat(np.array(names, np.int64), each), np.repeat(np.array(sizes, np.int64), each)]
            for at in range(0, len(rows[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in rows], ["gram", "name", "n"])

    return texts.select("text").mapInArrow(cut, "gram long, name long, n long")


def _meeting(prefixes: DataFrame) -> DataFrame:
    """The distinct rows (gram, name, n) of n-grams under which different sets meet."""
    by = Window.partitionBy("gram").orderBy("name")
    marked = prefixes.select("gram", "name", "n", F.lead("name").over(by).alias("_next"), F.first("name").over(by).alias("_first"))
    # Of equal rows the last stays, if another name comes after it or came before it.
    return marked.where("_next <> name OR (_next IS NULL AND _first <> name)").select("gram", "name", "n")


def _candidates(sketches: list[bytes], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes and sketches do not rule out a link."""
    left, right = [], []
    order = np.argsort(sizes, kind="stable")
    widths = np.array([len(s) for s in sketches])[order]
    n = sizes[order]
    bounds = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(n)]
    runs = [(a, b, np.frombuffer(b"".join(sketches[i] for i in order[a:b].tolist()), np.uint64).reshape(b - a, -1)) for a, b in zip(bounds, bounds[1:], strict=False)]
    for i, (a, b, x) in enumerate(runs):
        for c, d, y in runs[i : i + 2]:
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            for at in range(a, b, 256):
                rows = slice(at, min(at + 256, b))
                differ = np.zeros((rows.stop - at, d - c), np.int32)
                for w in range(x.shape[1]):
                    differ += np.bitwise_count(x[at - a : rows.stop - a, w, None] ^ y[None, :, w])
                both = n[rows, None] + n[None, c:d]
                near = ((100 + percent) * differ <= (100 - percent) * both) & (100 * n[rows, None] >= percent * n[None, c:d])
                p, q = np.nonzero(near)
                p, q = p + at, q + c
                keep = p < q
                left.append(order[p[keep]])
                right.append(order[q[keep]])
    return np.concatenate(left), np.concatenate(right)


def _group_edges(percent: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (gram, name, n, sketch) sorted by gram, at most ``HOT_GROUP`` a gram: candidate edges (u, v)."""
        seen: set[tuple[int, int]] = set()
        found: list[tuple[int, int]] = []

        def compare(rows: list[tuple]) -> None:
            if len(rows) > 8:
                a, b = _candidates([r[3] for r in rows], np.array([r[2] for r in rows]), percent)
                root = local_components(len(rows), a, b).tolist()
                pairs = [(rows[i], rows[j]) for i, j in enumerate(root) if i != j]
            else:
                pairs = []
                for i, x in enumerate(rows):
                    for y in rows[i + 1 :]:
                        (_, _, n, s), (_, _, m, t) = (x, y) if len(x[3]) <= len(y[3]) else (y, x)
                        if len(t) > 2 * len(s):
                            continue
                        p, q = int.from_bytes(s, "little"), int.from_bytes(t, "little")
                        if len(t) > len(s):
                            q = (q >> 8 * len(s)) ^ (q & (1 << 8 * len(s)) - 1)
                        if (100 + percent) * (p ^ q).bit_count() <= (100 - percent) * (n + m) and 100 * min(n, m) >= percent * max(n, m):
                            pairs.append((x, y))
            for x, y in pairs:
                pair = (x[1], y[1])
                if pair not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(pair)
                    found.append(pair)

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "name", "n", "sketch")), strict=True):
                if group and row[0] != group[0][0]:
                    compare(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])
            found.clear()
        if group:
            compare(group)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return edges


def _candidate_edges(meeting: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect at least what links connect."""
    hot = meeting.groupBy("gram").agg(F.count(F.lit(1)).alias("count"), F.min("name").alias("v")).where(F.col("count") > HOT_GROUP).select(F.col("gram").alias("_gram"), "v")
    hot = maybe_broadcast(materialise(hot, "hot"), BROADCAST_ROWS)
    stars = meeting.join(hot, F.col("gram") == F.col("_gram")).select(F.col("name").alias("u"), "v")
    small = meeting.join(hot, F.col("gram") == F.col("_gram"), "left_anti")
    sketches = described.where("name IS NOT NULL").join(meeting.select(F.col("name").alias("_name")).distinct(), F.col("name") == F.col("_name"), "left_semi").groupBy("name").agg(F.first("sketch").alias("sketch"))
    sketches = sketches.select(dealt_anew(F.col("name")).alias("_name"), "sketch")
    rows = small.join(sketches, F.col("name") == F.col("_name")).select("gram", "name", "n", "sketch")
    edges = rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(_group_edges(percent), "u long, v long")
    return edges.unionByName(stars)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Overlap sizes of all pairs (of ``left`` with itself, or with ``right``): counted for each fragment of the order, and summed."""
    sides = [left] if right is None else [left, right]
    every = np.sort(np.concatenate([np.empty(0, np.uint64), *(g for side in sides for g in side)]))
    again = every[1:][every[1:] == every[:-1]]
    shared = again[np.concatenate(([True], again[1:] != again[:-1]))[: len(again)]]  # what one set holds alone adds nothing
    placed = []
    for side in sides:
        owner = np.repeat(np.arange(len(side)), [len(g) for g in side])
        flat = np.concatenate([np.empty(0, np.uint64), *side])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((owner[hit][order], at[hit][order]))
    total = np.zeros((len(sides[0]), len(sides[-1])), np.int32)
    for low in range(0, len(shared), FRAGMENT):
        active, bits = [], []
        for owner, at in placed:
            a, b = np.searchsorted(at, (low, low + FRAGMENT))
            rows, place = np.unique(owner[a:b], return_inverse=True)
            grid = np.zeros((len(rows), FRAGMENT), bool)
            grid[place, at[a:b] - low] = True
            active.append(rows)
            bits.append(np.packbits(grid, axis=1).view(np.uint64))
        x, y = bits[0], bits[-1]
        partial = np.zeros((len(x), len(y)), np.int32)
        for w in range(x.shape[1]):
            partial += np.bitwise_count(x[:, w, None] & y[None, :, w])
        total[np.ix_(active[0], active[-1])] += partial
    return total


def _tile_links(percent: int):
    def links(table: pa.Table) -> pa.Table:
        """A spanning forest of the links among the sets of one block, or between two blocks."""
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        names, block = table.column("name").to_numpy(), table.column("block").to_numpy()
        _, first = np.unique(names, return_index=True)
        grams = table.column("grams").to_pylist()
        sets = [np.frombuffer(grams[k], np.uint64) for k in first.tolist()]
        own = block[first]
        rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
        pick = lambda at: [sets[k] for k in at.tolist()]
        size = np.array([len(s) for s in sets], np.int64)
        both = overlaps(pick(rows)) if i == j else overlaps(pick(rows), pick(columns))
        union = size[rows][:, None] + size[columns][None] - both
        x, y = np.nonzero(100 * both.astype(np.int64) >= percent * union)
        root = local_components(len(sets), rows[x], columns[y])
        linked = np.flatnonzero(root != np.arange(len(sets)))
        return pa.table({"u": names[first][linked], "v": names[first][root[linked]]})

    return links


def _links(texts: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (u, v) that connect what links connect, of texts (tkey, text) and members (name, n, tkey, cluster)."""
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    sizes = sizes.select(dealt_anew(F.col("cluster")).alias("_cluster"), "blocks")
    dealt = members.join(maybe_broadcast(sizes, BROADCAST_ROWS), F.col("cluster") == F.col("_cluster"))
    dealt = dealt.select("name", F.col("tkey").alias("_tkey"), "cluster", "blocks", F.pmod(F.xxhash64(F.lit(3), "name"), F.col("blocks")).cast("int").alias("block"))
    dealt = maybe_broadcast(materialise(dealt, "dealt"), BROADCAST_ROWS)
    rows = texts.join(dealt, F.col("tkey") == F.col("_tkey")).select("name", "cluster", "blocks", "block", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in pieces(batches, "text"):
            keep, grams = [], []
            for k, (name, own) in enumerate(zip(part.column("name").to_pylist(), gram_sets(part.column("text"), shingle), strict=True)):
                if name not in seen and len(own) and set_name(own) == name:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    keep.append(k)
                    grams.append(own.tobytes())
            columns = [part.column(c).take(pa.array(keep, pa.int64())) for c in ("name", "cluster", "blocks", "block")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(grams, pa.binary())], ["name", "cluster", "blocks", "block", "grams"])

    found = rows.mapInArrow(sets, "name long, cluster long, blocks int, block int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = found.withColumn("_o", other).select("cluster", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "name", "grams")
    return tiles.groupBy("cluster", "i", "j").applyInArrow(_tile_links(percent), "u long, v long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: texts link where their n-gram sets overlap in ``percent`` of the union or more.

    Null texts and texts without words have no n-grams and link with nothing: their component is their own id.  Repeated rows each get a
    row.  A null id gets its component's smallest id, or null where it has none.  Texts of any length are compared
    whole; an overlap of exactly the threshold links.  An empty table gives an empty result.  Other columns are not read.
    """
    texts = df.select(df[id_col].alias("doc_id"), F.xxhash64(df[text_col]).alias("tkey"), df[text_col].alias("text"))
    described = materialise(_described(texts, shingle), "described")
    documents = described.where("n IS NOT NULL").select("doc_id", "tkey", "n", "name", "sketch")
    order = _order(described.where("gram IS NOT NULL").select("gram", "docs"))
    meeting = materialise(_meeting(_prefixes(texts, order, shingle, percent)), "meeting")
    clusters = components(_candidate_edges(meeting, documents, percent))
    classes = documents.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.min("tkey").alias("tkey"), F.max("n").alias("n"))
    classes = materialise(classes, "classes")
    nodes = clusters.select(F.col("node").alias("_node"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("_node"), F.col("root").alias("cluster")).distinct())
    members = classes.join(nodes, F.col("name") == F.col("_node")).select("name", "n", "tkey", "cluster")
    roots = components(_links(texts, materialise(members, "members"), shingle, percent))
    named = classes.select("name", "first_id").join(roots, F.col("name") == F.col("node"), "left").select("name", "first_id", F.coalesce("root", "name").alias("root"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id")).select(dealt_anew(F.col("root")).alias("_root"), "component_id")
    least = named.join(least, F.col("root") == F.col("_root")).select(F.col("name").alias("_name"), "component_id")
    out = documents.where("name IS NOT NULL").select("doc_id", "n", "name").join(least, F.col("name") == F.col("_name")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(documents.where("name IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` whose 5-word shingles agree in 80 % or more."""
    return jaccard_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS grams FROM d
), x AS (
  SELECT rid, unnest(grams) AS gram FROM g
), shared AS (
  SELECT a.rid AS u, b.rid AS v, count(*) AS n FROM x a JOIN x b ON a.gram = b.gram AND a.rid < b.rid GROUP BY ALL
), near AS (
  SELECT u, v FROM shared JOIN g a ON u = a.rid JOIN g b ON v = b.rid WHERE 100 * n >= 80 * (len(a.grams) + len(b.grams) - n)
), e AS (
  SELECT u, v FROM near UNION SELECT v, u FROM near
), r AS (
  SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u
)
SELECT g.doc_id, len(g.grams)::BIGINT AS n_shingles, c.component_id
FROM g JOIN (SELECT r.a, min(doc_id) AS component_id FROM r JOIN d ON r.b = d.rid GROUP BY r.a) c ON g.rid = c.a
"""
