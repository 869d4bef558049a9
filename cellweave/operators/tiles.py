"""Grids too large for a row, as tiles: a row per block of cells, a bit a cell.

``grid_id long, tz int, ty int, tx int, cells binary``: tile (tz, ty, tx) holds the cells from its number times the edge on, as
packed bits in the order z, y, x; the last tile of an axis may be smaller, and 2D grids have tz 0.  A tile that is
absent is dead, so a sparse grid costs its live tiles.

``run`` goes in rounds of ``halo`` generations: every tile is sent to itself and to the tiles around it as far as their
halo reaches into it, a tile with its halo is advanced by numpy, and a ring of cells is used up with each generation.  A
round is one shuffle of about a bit a cell (a cell relation sends 9 or 27 rows a cell and generation), is
written into the shared folder, and no task holds more than a tile and its halo, or a stack of small ones, at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.rules import COUNTS, Rule, validate_rule
from cellweave.functions.workload import whole
from cellweave.operators.grids import axes, full_shape
from cellweave.operators.simulate import STACK_CELLS, rule_tables
from cellweave.sources.shared import materialise

TILES = "grid_id long, tz int, ty int, tx int, cells binary"
KEY = ["grid_id", "tz", "ty", "tx"]
#: Cells along a tile's edge (at most) and generations a round by default.
EDGE = {2: 1024, 3: 128}
HALO = 8
#: Bytes of bits, or rows of cells, that a task hands on at once.
HANDED_ON = 4 << 20


class _Tiling:
    """Where the tiles of a shape begin, and how large they are."""

    def __init__(self, shape: tuple[int, ...], edge: int):
        self.dims, self.shape = len(shape), full_shape(shape)
        self.edges = tuple(min(edge, n) if axis >= 3 - self.dims else 1 for axis, n in enumerate(self.shape))
        self.tiles = tuple(ceil(n / e) for n, e in zip(self.shape, self.edges, strict=True))

    def size(self, tile: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(min(e, n - t * e) for t, e, n in zip(tile, self.edges, self.shape, strict=True))

    def block(self, tile: tuple[int, ...], cells: bytes | None) -> np.ndarray:
        size = self.size(tile)
        if not cells:
            return np.zeros(size, np.uint8)
        return _unpacked(cells, size)

    def shares(self, axis: int, halo: int) -> dict[int, list[tuple[int, int, int, int]]]:
        """For each tile along an axis what it gives to which: (taker, begin, end, place in the taker's block with halo)."""
        n, edge = self.shape[axis], self.edges[axis]
        halo = halo if axis >= 3 - self.dims else 0
        out = defaultdict(list)
        for taker in range(self.tiles[axis]):
            place, full = 0, min(edge, n - taker * edge) + 2 * halo
            while place < full:
                at = (taker * edge + place - halo) % n
                giver = at // edge
                length = min(min((giver + 1) * edge, n) - at, full - place)
                out[giver].append((taker, at - giver * edge, at - giver * edge + length, place))
                place += length
        return out


def _unpacked(cells: bytes, size: tuple[int, ...]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(cells, np.uint8), count=int(np.prod(size))).reshape(size)


def _rows(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose last value is binary, handed on by its bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > HANDED_ON:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _tiles_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """(grid_id, tile, value of the column), one row after the other."""
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
        for (grid_id, *tile), value in zip(keys, batch.column(column), strict=True):
            yield grid_id, tuple(tile), value.as_py()


_TILE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def from_cells(cells: DataFrame, shape: tuple[int, ...], edge: int | None = None) -> DataFrame:
    """Tiles of a cell relation (``grid_id``, axes, ``alive``); places are taken on the torus, cells that are absent are dead, and a
    cell given twice is alive if one of them is.  Tiles without live cells are absent."""
    tiling = _Tiling(shape, edge or EDGE[len(shape)])
    place = [F.pmod(F.col(a), F.lit(n)).cast("int") if a in axes(tiling.dims) else F.lit(0) for a, n in zip(("z", "y", "x"), tiling.shape, strict=True)]
    numbers = [F.floor(p / e).cast("int").alias(f"t{a}") for p, e, a in zip(place, tiling.edges, "zyx", strict=True)]
    inside = [F.pmod(p, F.lit(e)).cast("int") for p, e in zip(place, tiling.edges, strict=True)]
    _, height, width = tiling.edges
    live = cells.where("alive <> 0").select(F.col("grid_id").cast("long").alias("grid_id"), *numbers, ((inside[0] * height + inside[1]) * width + inside[2]).alias("at"))
    found = live.groupBy(*KEY).agg(F.collect_set("at").alias("live"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, live = batch.column("grid_id").to_numpy(), batch.column("live")
            for number, found in _groups(_numbers(batch)):
                tile = tuple(number.tolist())
                for some in _pieces(found, int(np.prod(tiling.edges))):
                    own = live.take(pa.array(some))
                    stack = np.zeros((len(some), *tiling.edges), np.uint8)
                    stack.reshape(len(some), -1)[np.array(pc.list_parent_indices(own)), own.flatten().to_numpy()] = 1
                    block = stack[(slice(None), *map(slice, tiling.size(tile)))]
                    keys = [pa.array(idents[some]), *(pa.array(np.full(len(some), t, np.int32)) for t in tile)]
                    yield pa.RecordBatch.from_arrays([*keys, _binary(block)], [*KEY, "cells"])

    return found.mapInArrow(fill, TILES)


def to_cells(tiles: DataFrame, shape: tuple[int, ...], edge: int | None = None) -> DataFrame:
    """The live cells (``grid_id``, axes) of tiles."""
    tiling = _Tiling(shape, edge or EDGE[len(shape)])
    names = axes(tiling.dims)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, cells = batch.column("grid_id").to_numpy(), batch.column("cells")
            for number, held in _groups(_numbers(batch)):
                tile = tuple(number.tolist())
                for some in _pieces(held, int(np.prod(tiling.size(tile)))):
                    which, *places = np.nonzero(_stack(cells.take(pa.array(some)), tiling.size(tile)))
                    for at in range(0, len(which), HANDED_ON):
                        part = slice(at, at + HANDED_ON)
                        own = [pa.array((places[axis][part] + tile[axis] * tiling.edges[axis]).astype(np.int32)) for axis in range(3 - len(names), 3)]
                        yield pa.RecordBatch.from_arrays([pa.array(idents[some][which[part]]), *own], ["grid_id", *names])

    return tiles.select(*KEY, "cells").mapInArrow(spread, ", ".join(["grid_id long", *[f"{a} int" for a in names]]))


def _every_tile(tiles: DataFrame, tiling: _Tiling) -> DataFrame:
    """The tiles with those that are absent, whose cells are null."""
    every = tiles.select("grid_id").distinct()
    for name, n in zip(KEY[1:], tiling.tiles, strict=True):
        every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    return every.join(tiles, KEY, "left").select(*KEY, "cells")


def _groups(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct rows of ``keys`` and the places of each."""
    if not len(keys):
        return
    order = np.lexsort(keys.T[::-1])
    ends = np.flatnonzero((keys[order][1:] != keys[order][:-1]).any(axis=1)) + 1
    for places in np.split(order, ends):
        yield keys[places[0]], places


def _stack(cells: pa.Array, size: tuple[int, ...]) -> np.ndarray:
    """The blocks of a column of bits, all of one size; null and empty ones are dead."""
    n, width = int(np.prod(size)), ceil(int(np.prod(size)) / 8)
    bits = np.zeros((len(cells), width), np.uint8)
    held = np.array(pc.fill_null(pc.greater(pc.binary_length(cells), 0), False))
    bits[held] = np.frombuffer(b"".join(cells.filter(pa.array(held)).to_pylist()), np.uint8).reshape(-1, width)
    return np.unpackbits(bits, axis=1, count=n).reshape(-1, *size)


def _binary(stack: np.ndarray) -> pa.Array:
    """A column of the packed bits of a stack's blocks."""
    bits = np.packbits(stack.reshape(len(stack), -1), axis=1)
    offsets = np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bits))])


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in KEY[1:]], axis=1)


def _pieces(places: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """``places`` in pieces of at most ``STACK_CELLS`` cells, each place having so many; at least one a piece."""
    fit = max(1, STACK_CELLS // max(1, cells))
    for at in range(0, len(places), fit):
        yield places[at : at + fit]


def _between(shares: dict[int, list[tuple[int, int, int, int]]]) -> dict[int, dict[int, tuple[int, int, list[tuple[int, int, int]]]]]:
    """By giver and taker along an axis: what is sent (begin, end), and where its runs (begin, end, place) go.

    On a small torus a halo goes round many times; what a tile gives to another is sent once all the same.
    """
    out: dict = {}
    for giver, each in shares.items():
        for taker, begin, end, place in each:
            low, high, runs = out.setdefault(giver, {}).get(taker, (begin, end, []))
            out[giver][taker] = (min(low, begin), max(high, end), [*runs, (begin, end, place)])
    return out


def parts(tiles: DataFrame, tiling: _Tiling, rule: Rule, steps: int) -> DataFrame:
    """What every tile gives to the tiles (KEY) that need it for ``steps`` generations: a block of bits, and the giver's number (z, y, x)."""
    between = [_between(tiling.shares(axis, steps)) for axis in range(3)]
    keep_dead = bool(rule.birth[0])
    names, types = [*KEY, "z", "y", "x", "bits"], [pa.int64(), *[pa.int32()] * 6, pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, cells = batch.column("grid_id").to_numpy(), batch.column("cells")
            for tile, found in _groups(_numbers(batch)):
                size = tiling.size(tuple(tile))
                for some in _pieces(found, int(np.prod(size))):
                    stack = _stack(cells.take(pa.array(some)), size)
                    for each in product(*(by[t].items() for by, t in zip(between, tile.tolist(), strict=True))):
                        sent = stack[(slice(None), *(slice(low, high) for _, (low, high, _) in each))]
                        live = np.arange(len(sent)) if keep_dead else np.flatnonzero(sent.any(axis=(1, 2, 3)))
                        if len(live):
                            numbers = [pa.array(np.full(len(live), n, np.int32)) for n in (*(taker for taker, _ in each), *tile)]
                            yield pa.RecordBatch.from_arrays([pa.array(idents[some][live]), *numbers, _binary(sent[live])], schema=pa.schema(list(zip(names, types, strict=True))))

    return tiles.select(*KEY, "cells").mapInArrow(cut, "grid_id long, tz int, ty int, tx int, z int, y int, x int, bits binary")


def advance(sent: DataFrame, tiling: _Tiling, rule: Rule, steps: int, counted: bool = False) -> DataFrame:
    """The tiles ``steps`` generations on, from their parts.

    With ``counted`` also ``counts`` (alive, changed, births and deaths of the tile's own cells for each generation) and ``moved``
    (whether the last generation changed it); tiles that died come out too then, without cells.
    """
    dims = tiling.dims
    table = rule_tables(np.array([rule.code]), dims)[0]
    rings = tuple(steps if axis >= 3 - dims else 0 for axis in range(3))
    keep_dead = bool(rule.birth[0])

    between = [_between(tiling.shares(axis, steps)) for axis in range(3)]

    def filled(given: pa.Array, tile: tuple[int, ...]) -> np.ndarray:
        """The blocks with halo of one tile number, from the lists of their parts."""
        stack = np.zeros((len(given), *(n + 2 * r for n, r in zip(tiling.size(tile), rings, strict=True))), np.uint8)
        owner, flat = np.array(pc.list_parent_indices(given)), given.flatten()
        bits = flat.field("bits")
        for giver, found in _groups(np.stack([flat.field(c).to_numpy() for c in "zyx"], axis=1)):
            spans = [by[g][t] for by, g, t in zip(between, giver.tolist(), tile, strict=True)]
            sent = _stack(bits.take(pa.array(found)), tuple(high - low for low, high, _ in spans))
            for runs in product(*(runs for _, _, runs in spans)):
                source = (slice(None), *(slice(begin - low, end - low) for (begin, end, _), (low, _, _) in zip(runs, spans, strict=True)))
                stack[(owner[found], *(slice(place, place + end - begin) for begin, end, place in runs))] = sent[source]
        return stack

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, given = batch.column("grid_id").to_numpy(), batch.column("parts")
            for number, found in _groups(_numbers(batch)):
                tile = tuple(number.tolist())
                for some in _pieces(found, int(np.prod([n + 2 * r for n, r in zip(tiling.size(tile), rings, strict=True)]))):
                    stack, counts = filled(given.take(pa.array(some)), tile), []
                    for left in range(steps - 1, -1, -1):
                        after = _shrunk(stack, table, dims)
                        if counted:
                            counts += _own_counts(stack, after, left, dims)
                        stack = after
                    live = np.ones(len(stack), bool) if keep_dead else stack.any(axis=(1, 2, 3))
                    keys = lambda chosen, some=some, tile=tile: [pa.array(idents[some][chosen]), *(pa.array(np.full(len(chosen), t, np.int32)) for t in tile)]
                    if counted:
                        table_of = np.stack(counts, axis=1)
                        # Tiles that died come out without cells.
                        for chosen, cells in ((np.flatnonzero(live), None), (np.flatnonzero(~live), b"")):
                            if len(chosen):
                                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * table_of.shape[1]), pa.array(table_of[chosen].ravel()))
                                bits = _binary(stack[chosen]) if cells is None else pa.array([cells] * len(chosen), pa.binary())
                                yield pa.RecordBatch.from_arrays([*keys(chosen), lists, pa.array(table_of[chosen, -3] > 0), bits], [*KEY, "counts", "moved", "cells"])
                    elif live.any():
                        chosen = np.flatnonzero(live)
                        yield pa.RecordBatch.from_arrays([*keys(chosen), _binary(stack[chosen])], [*KEY, "cells"])

    met = sent.groupBy(*KEY).agg(F.collect_list(F.struct("z", "y", "x", "bits")).alias("parts"))
    return met.mapInArrow(forward, "grid_id long, tz int, ty int, tx int, counts array<long>, moved boolean, cells binary" if counted else TILES)


def _own_counts(before: np.ndarray, after: np.ndarray, ring: int, dims: int) -> list[np.ndarray]:
    """alive, changed, births, deaths of each block of a stack inside the ring that ``after`` has around the tile; ``before`` has one ring more."""
    inner = lambda stack, r: stack[(slice(None), *(slice(r, n - r) if axis >= 3 - dims else slice(None) for axis, n in enumerate(stack.shape[1:])))]
    old, new, each = inner(before, ring + 1), inner(after, ring), (1, 2, 3)
    alive, births = new.sum(each, dtype=np.int64), (new > old).sum(each)
    deaths = births + old.sum(each, dtype=np.int64) - alive
    return [alive, births + deaths, births, deaths]


def _round(tiles: DataFrame, tiling: _Tiling, rule: Rule, steps: int) -> DataFrame:
    return advance(parts(tiles, tiling, rule, steps), tiling, rule, steps)


def _shrunk(stack: np.ndarray, table: np.ndarray, dims: int) -> np.ndarray:
    """The next generation of the blocks of a stack without their outermost ring."""
    total, centre = stack, stack
    for axis in range(4 - dims, 4):
        n = stack.shape[axis]
        take = lambda a, begin, axis=axis, n=n: a[(slice(None),) * axis + (slice(begin, begin + n - 2),)]
        total = take(total, 0) + take(total, 1) + take(total, 2)
        centre = take(centre, 1)
    return table[total - centre + centre * np.uint8(COUNTS[dims])]


def run(tiles: DataFrame, rule: Rule, shape: tuple[int, ...], steps: int, edge: int | None = None, halo: int = HALO) -> DataFrame:
    """The tiles after ``steps`` generations, ``halo`` of them a round.

    Tiles without live cells are left out unless the rule gives birth on 0, where every tile comes out.  An empty table stays
    empty.  ``edge`` must be that of ``from_cells``.
    """
    steps, halo = whole(steps, "steps", 0), whole(halo, "halo")
    rule = validate_rule(rule, len(shape))
    tiling = _Tiling(shape, whole(edge or EDGE[len(shape)], "edge"))
    if rule.birth[0]:
        tiles = _every_tile(tiles, tiling)
    for done in range(0, steps, halo):
        tiles = _round(tiles, tiling, rule, min(halo, steps - done))
        if done + halo < steps:
            tiles = materialise(tiles, "round")
    return tiles
