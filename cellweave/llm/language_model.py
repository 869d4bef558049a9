"""LM scoring (operator 6): a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are 64-bit hashes of lower-cased words (``words``).  The training fold is counted once, map-side combined.  Every
token with at least ``MODEL_TOKENS`` training occurrences is a class of the model with embeddings of its own, so the vocabulary
follows the corpus; the least count doubles only where more than ``MAX_CLASSES`` tokens would be broadcast.  All other tokens are
one class, inside which a token has its smoothed corpus frequency.  Classes, by frequency, form clusters, and
clusters form regions, about as many as the cube root of the number of classes at each of the three levels.

Texts are tokenised to class numbers once, and those are written.  Training shards are cut by a hash of the row, one for every
``SHARD_TOKENS`` training tokens, and read in the hash's order, so the model depends on the rows and not on files,
partitions or executors.  Each shard runs noise-contrastive estimation in numpy over all its tokens from one common start: the
context vector is a position-wise weighted sum of the embeddings of the two classes before, a score is its product with an
output vector plus a bias, at each level.  Shards hand on the rows they changed; changes are averaged row by row, weighted by
how often a shard met the row, after a shuffle by row.  Scoring normalises by batched matrix products over all regions, the
clusters of the target's region and the classes of its cluster, so log-probabilities add up to one over all tokens.

Broadcast are the classes' hashes (12 bytes each) and parameters (66 bytes each): some 80 MB at ``MAX_CLASSES``.  Rare tokens
meet their counts by a shuffle join on the hash, which no frequent token takes part in.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import dealt_anew, pieces, read_table
from cellweave.llm.words import hash_words
from cellweave.sources.shared import materialise

#: Training occurrences that make a token one of the model's: each has its own embeddings.
MODEL_TOKENS = 5
#: Bound of what is broadcast: with more such tokens the least count doubles until no more than this are left.
MAX_CLASSES = 1 << 20
DIMENSIONS = 16
CONTEXT = 2
NOISE = 12
BATCH = 4096
RATE = 0.05
FIRST_SQUARE = 1e-3
SEED = 11
#: Different starts of embeddings; a class takes the one of its number modulo this.
STARTS = 4093
#: Training tokens for each shard (a task each).
SHARD_TOKENS = 4_000_000
#: Bytes of text a step of counting and numbering, and of class numbers a step of scoring.
STEP_BYTES = 4 << 20
NUMBER_BYTES = 2 << 20
#: Rows of a matrix product when texts are scored: one panel of any kernel.  Kernels for AVX2 sum the rows of a higher tile in different orders.
TILE_ROWS = 8
#: Rows of parameters a batch that tasks hand on.
ROWS = 20_000
#: A task hands on its partial counts beyond this many.
COUNTED = 2_000_000

#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x5851F42D4C957F2D)
WIDTH = 2 * DIMENSIONS + 1


def held_out(doc_id) -> bool:
    """Whether a document is in the test fold: crc32 of the id as text, modulo 5, is 1.  A null id reads as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _ragged(sizes: np.ndarray, extra: int) -> np.ndarray:
    """Places of rows' values, one after the other, if ``extra`` places come before each row."""
    return np.arange(int(sizes.sum())) + np.repeat(extra * np.arange(1, len(sizes) + 1), sizes)


def _token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, each text's end included, and the tokens of each text."""
    words, sizes = hash_words(texts, lower=True)
    out = np.full(len(words) + len(sizes), END, np.uint64)
    out[_ragged(sizes, 1) - 1] = words
    return out, sizes + 1


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values[order], first)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list) -> pa.RecordBatch:
        h, c = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    held, waiting = [], 0
    for part in pieces(batches, "text", STEP_BYTES):
        h, c = np.unique(_token_hashes(part.column("text"))[0], return_counts=True)
        held.append((h, c))
        waiting += len(h)
        if waiting > COUNTED:
            yield out(held)
            held, waiting = [], 0
    if held:
        yield out(held)


def _bounds(weights: np.ndarray, parts: int) -> np.ndarray:
    """Begins of about ``parts`` neighbourhoods of equal weight, and the end."""
    upto = np.cumsum(weights)
    number = np.minimum(np.concatenate(([0.0], upto[:-1])) / upto[-1] * parts, parts - 1).astype(np.int64)
    return np.concatenate((np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))), [len(weights)]))


class Level(NamedTuple):
    """One level of the output: every class's group there, the groups' first members one level below, and their log-priors."""

    of_class: np.ndarray
    begins: np.ndarray
    log_prior: np.ndarray


def _levels(frequency: np.ndarray) -> list[Level]:
    """Regions, clusters and classes.  Class 0 (all other tokens) is alone in its cluster, and that in its region."""
    k = len(frequency) - 1
    prior = frequency / frequency.sum()
    classes = Level(np.arange(k + 1, dtype=np.int32), np.arange(k + 2), np.log(prior))
    if not k:
        alone = Level(np.zeros(1, np.int32), np.array([0, 1]), np.zeros(1))
        return [alone, alone, classes]
    clusters = np.concatenate(([0], 1 + _bounds(np.sqrt(prior[1:]), math.ceil(k ** (2 / 3)))))
    cluster_prior = np.add.reduceat(prior, clusters[:-1])
    regions = np.concatenate(([0], 1 + _bounds(np.sqrt(cluster_prior[1:]), math.ceil(k ** (1 / 3)))))
    cluster_of = np.repeat(np.arange(len(clusters) - 1, dtype=np.int32), np.diff(clusters))
    region_of = np.repeat(np.arange(len(regions) - 1, dtype=np.int32), np.diff(regions))
    return [
        Level(region_of[cluster_of], regions, np.log(np.add.reduceat(cluster_prior, regions[:-1]))),
        Level(cluster_of, clusters, np.log(cluster_prior)),
        classes,
    ]


class Model:
    """Parameters: input embeddings, position weights, and output embeddings with biases at three levels, over classes 0 to K.

    Tables of classes hold the changes from the start, so that memory is taken for rows which training meets.
    """

    def __init__(self, frequency: np.ndarray):
        random = np.random.default_rng(SEED)
        self.levels = _levels(frequency)
        self.classes = len(frequency)
        self.start_inputs = random.normal(0, 0.1, (STARTS, DIMENSIONS)).astype(np.float32)
        self.start_outputs = random.normal(0, 0.1, (STARTS, DIMENSIONS)).astype(np.float32)
        self.inputs = np.zeros((self.classes, DIMENSIONS), np.float32)
        self.weights = np.ones((CONTEXT, DIMENSIONS), np.float32)
        sizes = [len(x.log_prior) for x in self.levels]
        self.outputs = [np.zeros((n, DIMENSIONS), np.float32) for n in sizes]
        self.biases = [np.zeros(n, np.float32) for n in sizes]
        # AdaGrad's, for as long as training goes on.
        self.input_squares = np.zeros(self.classes, np.float32)
        self.squares = [(np.zeros(n, np.float32), np.zeros(n, np.float32)) for n in sizes]
        self.met = [np.zeros(n, np.float32) for n in sizes]
        self.upto = [np.cumsum(np.exp(x.log_prior)) for x in self.levels]
        self.random = random

    def input_of(self, rows: np.ndarray) -> np.ndarray:
        return self.inputs.take(rows, axis=0) + self.start_inputs.take(rows % STARTS, axis=0)

    def output_of(self, level: int, rows: np.ndarray) -> np.ndarray:
        found = self.outputs[level].take(rows, axis=0)
        return found + self.start_outputs.take(rows % STARTS, axis=0) if level == 2 else found

    def pack(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers, weights and changes of the rows met: classes, then clusters, regions and position weights."""
        at = 0
        for level in (2, 1, 0):
            met = self.met[level]
            rows = np.flatnonzero(met)
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                x = np.zeros((len(part), WIDTH), np.float32)
                x[:, DIMENSIONS:-1], x[:, -1] = self.outputs[level][part], self.biases[level][part]
                if level == 2:
                    x[:, :DIMENSIONS] = self.inputs[part]
                yield at + part, met[part].astype(np.float64), x
            at += len(met)
        x = np.zeros((CONTEXT, WIDTH), np.float32)
        x[:, :DIMENSIONS] = self.weights - 1
        yield at + np.arange(CONTEXT), np.full(CONTEXT, max(1.0, float(self.met[0].sum()))), x

    def rows(self) -> int:
        return sum(map(len, self.biases)) + CONTEXT

    def unpack(self, rows: np.ndarray) -> None:
        at = 0
        rows = rows.astype(np.float32)
        self.inputs = rows[: self.classes, :DIMENSIONS]
        for level in (2, 1, 0):
            part = rows[at : at + len(self.biases[level])]
            self.outputs[level], self.biases[level] = np.ascontiguousarray(part[:, DIMENSIONS:-1]), part[:, -1].copy()
            at += len(part)
        self.weights = 1 + rows[at:, :DIMENSIONS]

    def train(self, ids: np.ndarray, is_target: np.ndarray) -> None:
        """One step of noise-contrastive estimation over successive classes; those of ``is_target`` are predicted from the two before.

        At every level the normaliser is held at one, as usual, and the noise samples are shared by the batch.  Steps are
        AdaGrad's, by row.
        """
        order = np.argsort(ids, kind="stable")
        ordered = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rows = ordered[first]
        place = np.empty(len(ids), np.int64)
        place[order] = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(ids))))
        embedded = self.input_of(rows).take(place, axis=0)
        targets = order[is_target[order]]  # sorted by class, and so by cluster and region
        if not len(targets):
            return
        before, earlier = embedded.take(targets - 1, axis=0), embedded.take(targets - 2, axis=0)
        hidden = before * self.weights[0] + earlier * self.weights[1]
        classes = ids[targets]
        to_hidden = np.zeros_like(hidden)
        for level in range(3):
            self._contrast(level, hidden, self.levels[level].of_class[classes], to_hidden)
        gradient = np.zeros((len(ids), DIMENSIONS), np.float32)
        gradient[targets - 1] = to_hidden * self.weights[0]
        gradient[targets - 2] += to_hidden * self.weights[1]
        self._step(self.inputs, self.input_squares, rows, np.add.reduceat(gradient.take(order, axis=0), first, axis=0))
        n = len(targets)
        self.weights += RATE / 10 / n * np.vstack((np.einsum("ij,ij->j", to_hidden, before), np.einsum("ij,ij->j", to_hidden, earlier)))

    def _contrast(self, level: int, hidden: np.ndarray, groups: np.ndarray, to_hidden: np.ndarray) -> None:
        """Steps of one level's outputs and biases (changes from its log-prior); adds the gradient of the hidden vectors."""
        upto, bias = self.upto[level], self.biases[level]
        drawn = np.minimum(np.searchsorted(upto, self.random.random(NOISE) * upto[-1]), len(upto) - 1)
        noise, times = np.unique(drawn, return_counts=True)
        first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        counts = np.diff(np.append(first, len(groups)))
        rows = groups[first]
        own, other = self.output_of(level, rows).take(np.repeat(np.arange(len(rows)), counts), axis=0), self.output_of(level, noise)
        # Score minus log-prior: the prior is the start of the bias.
        shift = np.float32(math.log(NOISE))
        data = np.einsum("ij,ij->i", hidden, own)
        data += np.repeat(bias[rows] - shift, counts)
        fake = hidden @ other.T
        fake += bias[noise] - shift
        # Gradients of the log-likelihood "data or noise".
        gd = 1 / (1 + np.exp(np.minimum(data, 30)))
        gf = -times.astype(np.float32) / (1 + np.exp(np.minimum(-fake, 30)))
        to_hidden += gd[:, None] * own
        to_hidden += gf @ other
        outputs, (squares, bias_squares), met = self.outputs[level], self.squares[level], self.met[level]
        self._step(outputs, squares, rows, np.add.reduceat(gd[:, None] * hidden, first, axis=0))
        self._step(bias[:, None], bias_squares, rows, np.add.reduceat(gd, first)[:, None])
        self._step(outputs, squares, noise, gf.T @ hidden)
        self._step(bias[:, None], bias_squares, noise, gf.sum(0)[:, None])
        met[rows] += counts
        met[noise] += times

    @staticmethod
    def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
        squares[rows] += np.einsum("ij,ij->i", total, total) / total.shape[1]
        table[rows] += total * (RATE / np.sqrt(FIRST_SQUARE + squares[rows]))[:, None]

    def finish(self) -> None:
        """Add the starts to the tables of classes; after that the model scores and no longer trains."""
        rows = np.arange(self.classes)
        self.inputs, self.outputs[2] = self.input_of(rows), self.output_of(2, rows)

    def log_probabilities(self, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the classes at ``targets``, normalised over all classes: of the region, of the cluster in
        it, and of the class in that."""
        order = np.argsort(ids[targets], kind="stable")
        at = targets[order]
        classes = ids[at]
        hidden = self.inputs.take(ids[at - 1], axis=0) * self.weights[0] + self.inputs.take(ids[at - 2], axis=0) * self.weights[1]
        out = np.zeros(len(at), np.float64)
        ends = np.array([len(at)])
        above = np.array([0, len(self.biases[0])])
        for level in range(3):
            groups = self.levels[level].of_class[classes]
            begin = 0
            for parent, end in enumerate(ends.tolist()):
                low, high = int(above[parent]), int(above[parent + 1])
                if end > begin and high - low > 1:
                    bias = self.biases[level][low:high] + self.levels[level].log_prior[low:high].astype(np.float32)
                    _add_log_softmax(out, hidden, groups, begin, end, low, self.outputs[level][low:high], bias)
                begin = end
            ends = np.cumsum(np.bincount(groups, minlength=len(self.biases[level])))
            above = self.levels[level].begins
        back = np.empty_like(out)
        back[order] = out
        return back


def _add_log_softmax(out: np.ndarray, hidden: np.ndarray, groups: np.ndarray, begin: int, end: int, low: int, table: np.ndarray, bias: np.ndarray) -> None:
    """Add the log-softmax of rows [begin, end) for their groups, over the groups of ``table`` from number ``low`` on.

    A row's result does not depend on the rows it is computed with: all products are of tiles of ``TILE_ROWS`` rows, the last one
    filled up, since a matrix product sums in another order for another height; and sums run along rows.
    """
    step = max(1, (1 << 18) // len(bias) // TILE_ROWS) * TILE_ROWS
    turned = np.ascontiguousarray(table.T)
    for i in range(begin, end, step):
        part = slice(i, min(end, i + step))
        height = part.stop - part.start
        rows = np.zeros((-(-height // TILE_ROWS) * TILE_ROWS, hidden.shape[1]), hidden.dtype)
        rows[:height] = hidden[part]
        scores = np.matmul(rows.reshape(-1, TILE_ROWS, hidden.shape[1]), turned).reshape(len(rows), -1)[:height]
        scores += bias
        own = scores[np.arange(len(scores)), groups[part] - low]
        top = np.float32(0)
        if max(scores.max(), -own.min()) > 60:  # some row is beyond single precision's exponents
            top = scores.max(axis=1)
            top[(top <= 60) & (own >= -60)] = 0
            scores -= top[:, None]
        out[part] += own - top - np.log(np.einsum("ij->i", np.exp(scores, out=scores)))


def _sharded(model_of):
    """Train a model on each shard of rows (ids, shard) that are sorted by shard; the rows that it changed.

    A shard's texts form one sequence of classes, each text after ``CONTEXT`` ends, that is cut at every ``BATCH`` places however
    the rows come in.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shard, held, waiting = None, None, [], 0

        def steps(last: bool) -> None:
            nonlocal held, waiting
            ids, is_target = (np.concatenate(x) for x in zip(*held, strict=True))
            at = CONTEXT
            while at < len(ids) and (last or at + BATCH <= len(ids)):
                part = slice(at - CONTEXT, min(len(ids), at + BATCH))
                wanted = is_target[part].copy()
                wanted[:CONTEXT] = False
                model.train(ids[part], wanted)
                at += BATCH
            held, waiting = [(ids[at - CONTEXT :], is_target[at - CONTEXT :])], max(0, len(ids) - at)

        def close() -> Iterator[pa.RecordBatch]:
            if model is not None:
                steps(True)
                for each in model.pack():
                    yield _rows(*each)

        for part in pieces(batches, "ids", NUMBER_BYTES):
            shards = part.column("shard").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if shards[a] != shard:
                    yield from close()
                    (model, end), shard, held, waiting = model_of(), shards[a], [], 0
                ids, sizes = _ids(part.column("ids").slice(a, b - a))
                places = _ragged(sizes, CONTEXT)
                flat, is_target = np.full(len(ids) + CONTEXT * len(sizes), end, np.int32), np.zeros(len(ids) + CONTEXT * len(sizes), bool)
                flat[places], is_target[places] = ids, True
                held.append((flat, is_target))
                waiting += len(flat)
                if waiting >= 16 * BATCH:
                    steps(False)
        yield from close()

    return train


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' classes, and the tokens of each text."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int32), np.diff(offsets).astype(np.int64) // 4


PARAMETER_SCHEMA = "row long, weight double, x binary"


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` bytes, one after the other in ``data``."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _rows(rows: np.ndarray, weights: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows of ``PARAMETER_SCHEMA``: numbers in half precision."""
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(weights), _binary(x.astype(np.float16), np.full(len(rows), 2 * WIDTH))], ["row", "weight", "x"])


def _parameters(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), WIDTH)


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means by row; all of a row's changes come to one task."""

    def merged(held):
        rows, weights, x = (np.concatenate(c) for c in zip(*held, strict=True))
        # In an order that does not depend on which shard's changes came first.
        order = np.lexsort((x[:, -1], weights, rows))
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        return [(rows[first], np.add.reduceat(weights[order], first), np.add.reduceat(x[order], first, axis=0))]

    held, waiting = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        weights = batch.column("weight").to_numpy()
        held.append((batch.column("row").to_numpy(), weights, _parameters(batch.column("x")) * weights[:, None]))
        waiting += batch.num_rows
        if waiting > max(5 * ROWS, len(held[0][0])):
            held, waiting = merged(held), 0
    if held:
        rows, weights, x = merged(held)[0]
        for at in range(0, len(rows), ROWS):
            part = slice(at, at + ROWS)
            yield _rows(rows[part], weights[part], x[part] / weights[part, None])


class Vocabulary(NamedTuple):
    """The model's tokens: sorted hashes with their classes; occurrences of every class, and of class 0 its kinds."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray  #: of classes 0 (all other tokens) to K
    kinds: int

    def classes_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0).astype(np.int32)

    def frequency(self) -> np.ndarray:
        out = self.counts.astype(np.float64)
        out[0] += 0.5 * (self.kinds + 1)
        return out

    def end(self) -> int:
        return int(self.classes_of(np.array([END]))[0])


def _vocabulary(counts: DataFrame, total: int, distinct: int) -> Vocabulary:
    """All tokens with at least ``MODEL_TOKENS`` occurrences, or twice, four times ... as many where they are too many to broadcast."""
    least = [MODEL_TOKENS << k for k in range(48)]
    above = counts.agg(*[F.count_if(F.col("c") >= n).alias(f"n{n}") for n in least]).first()
    found = counts.where(F.col("c") >= next(n for n in least if above[f"n{n}"] <= MAX_CLASSES)).toArrow()
    hashes, c = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.lexsort((hashes, -c))
    hashes, c = hashes[order], c[order]
    by_hash = np.argsort(hashes, kind="stable")
    return Vocabulary(hashes[by_hash], (by_hash + 1).astype(np.int32), np.concatenate(([total - int(c.sum())], c)), distinct - len(c))


def _number(shipped):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's classes, and the hashes of its tokens outside the model."""
        vocabulary: Vocabulary = shipped.value
        logs = np.log10(vocabulary.counts + 0.5)
        logs[0] = 0
        for part in pieces(batches, "text", STEP_BYTES):
            hashes, sizes = _token_hashes(part.column("text"))
            ids = vocabulary.classes_of(hashes)
            begins = np.cumsum(sizes) - sizes
            other = ids == 0
            n_other = np.add.reduceat(other, begins, dtype=np.int64)
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_other))), pa.int32()), pa.array(hashes[other].view(np.int64)))
            columns = [part.column("doc_id"), part.column("held_out"), part.column("key"), pa.array(sizes), pa.array(n_other), pa.array(np.add.reduceat(logs[ids], begins)), _binary(ids, 4 * sizes), rare]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "key", "n_tokens", "n_other", "logs", "ids", "rare"])

    return number


def _score(shipped):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, end, parameters = shipped.value
        model = Model(frequency)
        if parameters is not None:
            model.unpack(parameters)
        model.finish()
        others = ["doc_id", "held_out", "rid", "n_tokens", "n_other", "logs"]
        for part in pieces(batches, "ids", NUMBER_BYTES):
            ids, sizes = _ids(part.column("ids"))
            places = _ragged(sizes, CONTEXT)
            flat = np.full(len(ids) + CONTEXT * len(sizes), end, np.int32)
            flat[places] = ids
            # A text longer than a step is scored in several.
            natural = np.concatenate([model.log_probabilities(flat, places[at : at + NUMBER_BYTES // 4]) for at in range(0, len(places), NUMBER_BYTES // 4)])
            neural = np.add.reduceat(natural, np.cumsum(sizes) - sizes) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(neural)], [*others, "neural"])

    return score


def fit_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from the rows that are not held out, scores all.  Null and blank texts are one end token; texts of any length are
    taken whole.  Repeated rows count and are scored each; a null id is text "" for the fold.  Without any training rows every
    token is unknown (N = V = 0) and the model is uniform over its single class.  An empty table gives an empty result.  Other
    columns of ``df``, whatever their names, are not read.  ``score`` is normalised over the known tokens and one unknown.
    """
    context = df.sparkSession.sparkContext
    ident = F.coalesce(df[id_col].cast("string"), F.lit(""))
    docs = df.select(
        df[id_col].alias("doc_id"),
        (F.pmod(F.crc32(ident), F.lit(5)) == 1).alias("held_out"),
        F.xxhash64(ident, df[text_col]).alias("key"),
        df[text_col].alias("text"),
    )
    counts = docs.where("not held_out").select("text").mapInArrow(_count_tokens, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = materialise(counts, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    vocabulary = _vocabulary(counts, total, distinct)
    frequency, end = vocabulary.frequency(), vocabulary.end()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, key long, n_tokens long, n_other long, logs double, ids binary, rare array<long>"
    numbered = docs.mapInArrow(_number(context.broadcast(vocabulary)), schema).withColumn("rid", F.monotonically_increasing_id())
    numbered = materialise(numbered, "numbered")

    shards = max(1, math.ceil(total / SHARD_TOKENS))
    started = context.broadcast(frequency)
    learning = numbered.where("not held_out").select("ids", F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key")
    learning = learning.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key").select("ids", "shard")
    changes = learning.mapInArrow(_sharded(lambda: (Model(started.value), end)), PARAMETER_SCHEMA)
    averaged = changes.repartition("row").mapInArrow(_average, PARAMETER_SCHEMA).select("row", "x").toArrow()  # as many rows as classes met
    parameters = None
    if averaged.num_rows:
        parameters = np.zeros((Model(frequency).rows(), WIDTH), np.float16)
        for batch in averaged.to_batches():
            parameters[batch.column("row").to_numpy()] = _parameters(batch.column("x"))
    del averaged

    scored = numbered.select("doc_id", "held_out", "rid", "n_tokens", "n_other", "logs", "ids").mapInArrow(
        _score(context.broadcast((frequency, end, parameters))), f"doc_id {kind}, held_out boolean, rid long, n_tokens long, n_other long, logs double, neural double"
    )
    rare = numbered.select("rid", F.explode("rare").alias("_h"))
    c = F.coalesce("c", F.lit(0))
    met = rare.join(counts.withColumn("h", dealt_anew(F.col("h"))), F.col("_h") == F.col("h"), "left")
    sums = met.groupBy(F.col("rid").alias("_rid")).agg(F.sum(F.log10(c + 0.5)).alias("more"), F.count_if(c > 0).alias("rare_known"))
    width = math.log10(total + 0.5 * (distinct + 1))
    inside = math.log10(float(frequency[0]))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(sums, F.col("rid") == F.col("_rid"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("n_other") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * width).alias("base_score"),
        (F.col("neural") + more - F.col("n_other") * inside).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return fit_and_score(read_table(spark, sf_dir, "documents", "doc_id", "text"))
