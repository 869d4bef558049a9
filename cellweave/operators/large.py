"""Metrics, fixed points, samples and edits of grids too large for a row: everything by tile (see ``tiles``).

* ``run_metrics``: the transition counts of every generation, from inside the rounds of several generations; each cell is counted
  by its own tile, so a round stays one shuffle.
* ``run_until_stable``: delta iteration.  After the first round only tiles that changed in the last generation, and those
  within their reach, are computed; the rest keep what they have.  The end is an empty frontier.
* ``sample_live``: an even sample of the live cells in order of place, by rank and select: live cells are counted by line, prefix
  sums over bands of lines give each line's first rank, each line knows which ranks of the sample are its own, and only
  these are looked up in their tiles.  Nothing is sorted as a whole.
* ``edit_cells``, ``place_pattern``: edits meet their tiles by a join and are scattered into them, in time linear in cells and edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.rules import Rule, validate_rule
from cellweave.functions.workload import whole
from cellweave.operators.grids import axes
from cellweave.operators.tiles import _TILE_TYPES, EDGE, HALO, KEY, TILES, _every_tile, _groups, _numbers, _rows, _Tiling, _tiles_of, advance, parts
from cellweave.sources.shared import broadcast_if_small, materialise

#: Rows of tile keys, or of picked cells, that are broadcast at most.
BROADCAST_KEYS = 500_000
#: Lines of cells in a band of prefix sums.
BAND = 4096
COUNTS = ["alive", "changed", "births", "deaths"]


def _ready(rule: Rule, shape: tuple[int, ...], edge: int | None) -> tuple[Rule, _Tiling]:
    return validate_rule(rule, len(shape)), _Tiling(shape, whole(edge or EDGE[len(shape)], "edge"))


def _by_generation(advanced: DataFrame, done: int) -> DataFrame:
    """``grid_id, generation`` and the counts of a round that began after ``done`` generations, summed over tiles."""
    flat = advanced.select("grid_id", F.posexplode("counts").alias("i", "n"))
    named = [F.sum(F.when(F.col("i") % 4 == k, F.col("n"))).alias(name) for k, name in enumerate(COUNTS)]
    return flat.groupBy("grid_id", (F.floor(F.col("i") / 4) + done + 1).cast("int").alias("generation")).agg(*named)


def _live(tiles: DataFrame) -> DataFrame:
    return tiles.where(F.length("cells") > 0).select(*KEY, "cells")


def run_metrics(tiles: DataFrame, rule: Rule, shape: tuple[int, ...], steps: int, edge: int | None = None, halo: int = HALO) -> tuple[DataFrame, DataFrame]:
    """The tiles after ``steps`` generations, and ``grid_id, generation, alive, changed, births, deaths`` for every generation.

    A grid without live cells from some generation on has zeros there; one without tiles at the start is not there (but under
    rules that give birth on 0, see ``tiles.run``).  ``edge`` must be that of ``from_cells``.
    """
    steps, halo = whole(steps, "steps", 0), whole(halo, "halo")
    rule, tiling = _ready(rule, shape, edge)
    if rule.birth[0]:
        tiles = _every_tile(tiles, tiling)
    grids, found = tiles.select("grid_id").distinct(), []
    for done in range(0, steps, halo):
        n = min(halo, steps - done)
        advanced = materialise(advance(parts(tiles, tiling, rule, n), tiling, rule, n, counted=True), "round")
        found.append(_by_generation(advanced, done))
        tiles = _live(advanced)
    every = grids.select("grid_id", F.explode(F.sequence(F.lit(1), F.lit(steps)) if steps else F.array().cast("array<int>")).alias("generation"))
    if not found:
        return tiles, every.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    sums = reduce(DataFrame.unionByName, found)
    return tiles, every.join(sums, ["grid_id", "generation"], "left").select("grid_id", "generation", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def _related(keys: DataFrame, by_axis: list[dict[int, list[int]]]) -> DataFrame:
    """The distinct tiles that stand in a relation, given axis by axis, to some of the keys."""

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents = batch.column("grid_id").to_numpy()
            for tile, places in _groups(_numbers(batch)):
                for found in product(*(by[t] for by, t in zip(by_axis, tile.tolist(), strict=True))):
                    yield pa.RecordBatch.from_arrays([pa.array(idents[places]), *(pa.array(np.full(len(places), n, np.int32)) for n in found)], KEY)

    return keys.select(*KEY).mapInArrow(relate, "grid_id long, tz int, ty int, tx int").distinct()


class _State:
    """All tiles as two tables: as they were at some round, and those computed since.  Tables of the second kind stay small or become
    part of the first, so a round writes in proportion to what it computes."""

    def __init__(self, tiles: DataFrame):
        self.base = materialise(tiles.select(*KEY, "cells"), "base")
        self.size = self.base.count()
        self.delta: DataFrame | None = None

    def of(self, keys: DataFrame) -> DataFrame:
        """The tiles of these keys."""
        keys = broadcast_if_small(keys, BROADCAST_KEYS)
        if self.delta is None:
            return self.base.join(keys, KEY, "left_semi")
        known = broadcast_if_small(self.delta.select(*KEY), BROADCAST_KEYS)
        return self.base.join(keys, KEY, "left_semi").join(known, KEY, "left_anti").unionByName(self.delta.join(keys, KEY, "left_semi"))

    def take(self, advanced: DataFrame) -> None:
        new = advanced.select(*KEY, "cells")
        if self.delta is not None:
            new = new.unionByName(self.delta.join(broadcast_if_small(advanced.select(*KEY), BROADCAST_KEYS), KEY, "left_anti"))
        self.delta = materialise(new, "delta")
        if 2 * self.delta.count() > self.size:
            self.base, self.delta = materialise(self.all(), "base"), None
            self.size = self.base.count()

    def all(self) -> DataFrame:
        if self.delta is None:
            return _live(self.base)
        known = broadcast_if_small(self.delta.select(*KEY), BROADCAST_KEYS)
        return _live(self.base.join(known, KEY, "left_anti").unionByName(self.delta))


def run_until_stable(tiles: DataFrame, rule: Rule, shape: tuple[int, ...], max_steps: int = 1000, edge: int | None = None, halo: int = HALO, computed: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Every grid until a generation changes nothing: the final tiles, and ``grid_id, steps_taken, settled, alive, changed, births,
    deaths`` with the counts of the last generation taken.

    The confirming generation counts; a limit of 0 leaves all as they are, not settled.  Grids without tiles are not there (but
    under rules that give birth on 0).  ``computed`` is given the number of tiles that each round computed.
    """
    max_steps, halo = whole(max_steps, "max_steps", 0), whole(halo, "halo")
    rule, tiling = _ready(rule, shape, edge)
    if rule.birth[0]:
        tiles = _every_tile(tiles, tiling)
    state, found = _State(tiles), []
    start = state.base.mapInArrow(_bits, "grid_id long, n long").groupBy("grid_id").agg(F.sum("n").alias("first"))
    moved = state.base
    for done in range(0, max_steps, halo):
        n = min(halo, max_steps - done)
        takers = [{giver: sorted({x[0] for x in each}) for giver, each in tiling.shares(axis, n).items()} for axis in range(3)]
        givers = [{t: sorted(g for g in by if t in by[g]) for t in range(count)} for by, count in zip(takers, tiling.tiles, strict=True)]
        frontier = materialise(_related(moved, takers), "frontier")
        size = frontier.count()
        if not size:
            break
        if computed is not None:
            computed.append(size)
        sent = parts(state.of(_related(frontier, givers)), tiling, rule, n).join(broadcast_if_small(frontier, BROADCAST_KEYS), KEY, "left_semi")
        advanced = materialise(advance(sent, tiling, rule, n, counted=True), "round")
        found.append(_by_generation(advanced, done))
        state.take(advanced)
        moved = advanced.where("moved")
    if not found:
        summary = start.select("grid_id", F.lit(0).alias("steps_taken"), F.lit(False).alias("settled"), F.col("first").alias("alive"), *[F.lit(0).cast("long").alias(c) for c in COUNTS[1:]])
        return state.all(), summary
    sums = materialise(reduce(DataFrame.unionByName, found), "generations")
    # A generation without a row changed nothing: no tile of the grid was in the frontier, or all were dead.
    first = sums.groupBy("grid_id").agg(F.least(F.min(F.when(F.col("changed") == 0, F.col("generation"))), F.max("generation") + 1).alias("still"))
    ends = start.join(first, "grid_id", "left").select("grid_id", "first", F.coalesce("still", F.lit(1)).alias("still"))
    ends = ends.select("grid_id", "first", F.least("still", F.lit(max_steps)).alias("steps_taken"), (F.col("still") <= max_steps).alias("settled"))
    last = F.col("generation") == F.col("steps_taken")
    joined = ends.join(sums.drop("alive").withColumnRenamed("grid_id", "_id"), (F.col("grid_id") == F.col("_id")) & (F.col("generation") <= F.col("steps_taken")), "left")
    at_end = [F.coalesce(F.sum(F.when(last, F.col(c))), F.lit(0)).alias(c) for c in COUNTS[1:]]
    grown = F.coalesce(F.sum(F.col("births") - F.col("deaths")), F.lit(0))
    summary = joined.groupBy("grid_id", "first", "steps_taken", "settled").agg(grown.alias("grown"), *at_end)
    return state.all(), summary.select("grid_id", "steps_taken", "settled", (F.col("first") + F.col("grown")).alias("alive"), *COUNTS[1:])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [int(np.bitwise_count(np.frombuffer(c or b"", np.uint8)).sum()) for c in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grid_id"), pa.array(counts, pa.int64())], ["grid_id", "n"])


def _lines(tiles: DataFrame, tiling: _Tiling) -> DataFrame:
    """Live cells of each line of each tile: the line's number in the grid (``line``) and in the tile (``own``)."""
    height = tiling.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grid_id, tile, cells in _tiles_of(batches, "cells"):
            n = tiling.block(tile, cells).sum(2, dtype=np.int64)
            z, y = np.nonzero(n)
            line = (z + tile[0] * tiling.edges[0]) * height + y + tile[1] * tiling.edges[1]
            keys = [pa.array(np.full(len(z), k), t) for k, t in zip((grid_id, *tile), _TILE_TYPES, strict=False)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(line), pa.array((z * n.shape[1] + y).astype(np.int32)), pa.array(n[z, y])], [*KEY, "line", "own", "n"])

    return tiles.select(*KEY, "cells").mapInArrow(count, "grid_id long, tz int, ty int, tx int, line long, own int, n long")


def _picks(total: Column, begin: Column, count: Column, limit: int) -> Column:
    """(i, rank) of an even sample of ``limit`` out of ``total`` whose ranks lie among the ``count`` from ``begin`` on."""
    last = (total - 1).cast("double")
    if limit == 1:
        rank = lambda i: F.lit(0).cast("long")
        low = high = F.lit(0).cast("long")
    else:
        step = last / F.lit(float(limit - 1))
        rank = lambda i: F.when(i == limit - 1, total - 1).otherwise(F.floor(i.cast("double") * step))
        low = F.greatest(F.lit(0).cast("long"), F.floor(begin / step) - 1)
        high = F.least(F.lit(limit - 1).cast("long"), F.ceil((begin + count) / step) + 1)
    some = F.filter(F.transform(F.sequence(low, F.greatest(low, high)), lambda i: F.struct(i.alias("i"), rank(i).alias("rank"))), lambda p: (p["rank"] >= begin) & (p["rank"] < begin + count))
    every = F.transform(F.sequence(begin, begin + count - 1), lambda r: F.struct(r.alias("i"), r.alias("rank")))
    return F.when(total <= limit, every).otherwise(some)


def sample_live(tiles: DataFrame, shape: tuple[int, ...], limit: int = 75_000, edge: int | None = None) -> DataFrame:
    """An even sample of each grid's live cells in order of place: ``grid_id, live, sampled, i`` and the axes; all if they are no more than ``limit``.

    The same cells as of ``render.voxels``.  Grids without live cells have no rows.
    """
    limit = whole(limit, "limit")
    tiling = _Tiling(shape, whole(edge or EDGE[len(shape)], "edge"))
    lines = materialise(_lines(tiles, tiling), "lines").withColumn("band", F.floor(F.col("line") / BAND))
    sums = lines.groupBy("grid_id", "band").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("grid_id").orderBy("band")
    bands = sums.select("grid_id", "band", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("grid_id")).alias("live"))
    inside = Window.partitionBy("grid_id", "band").orderBy("line", "tx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.select("*", (F.sum("n").over(inside) - F.col("n")).alias("within")).join(bands, ["grid_id", "band"])
    begin = F.col("before") + F.col("within")
    picked = placed.select(*KEY, "own", "live", begin.alias("begin"), F.explode(_picks(F.col("live"), begin, F.col("n"), limit)).alias("p"))
    by_tile = picked.groupBy(*KEY, "live").agg(F.collect_list(F.struct("own", (F.col("p.rank") - F.col("begin")).cast("int").alias("k"), F.col("p.i").alias("i"))).alias("picks"))
    names = axes(tiling.dims)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (*KEY, "live", "cells")), strict=True)
            for (grid_id, *tile, live, cells), picks in zip(keys, batch.column("picks"), strict=True):
                block = tiling.block(tuple(tile), cells)
                flat = block.reshape(-1, block.shape[2])
                own, k, i = (np.array([p[c] for p in picks.as_py()], np.int64) for c in ("own", "k", "i"))
                # Live cells of the asked lines, one after the other: the k-th of a line is at the line's first plus k.
                asked, which = np.unique(own, return_inverse=True)
                row, x = np.nonzero(flat[asked])
                at = x[np.searchsorted(row, which) + k]
                place = (own // block.shape[1] + tile[0] * tiling.edges[0], own % block.shape[1] + tile[1] * tiling.edges[1], at + tile[2] * tiling.edges[2])
                n = len(own)
                columns = [pa.array(np.full(n, grid_id)), pa.array(np.full(n, live)), pa.array(np.full(n, live > limit)), pa.array(i), *(pa.array(p.astype(np.int32)) for p in place[3 - len(names) :])]
                yield pa.RecordBatch.from_arrays(columns, ["grid_id", "live", "sampled", "i", *names])

    found = tiles.select(*KEY, "cells").join(broadcast_if_small(by_tile, BROADCAST_KEYS // 100), KEY)
    return found.select(*KEY, "live", "cells", "picks").mapInArrow(look_up, "grid_id long, live long, sampled boolean, i long, " + ", ".join(f"{a} int" for a in names))


def edit_cells(tiles: DataFrame, edits: DataFrame, shape: tuple[int, ...], edge: int | None = None) -> DataFrame:
    """Tiles after a stroke of edits (``grid_id``, axes, ``place``, ``mode``): ``paint``, ``erase`` or, else, ``toggle`` a cell.

    A stroke meets a cell once: of several edits of a cell the one with the least ``place`` (then mode) counts.  Cells outside the grid
    change nothing.  A tile that is absent is dead, so edits may bring it (and its grid) to life; tiles left dead go.
    """
    tiling = _Tiling(shape, whole(edge or EDGE[len(shape)], "edge"))
    names = axes(tiling.dims)
    place = {a: F.col(a) if a in names else F.lit(0) for a in "zyx"}
    fits = reduce(Column.__and__, [(place[a] >= 0) & (place[a] < n) for a, n in zip("zyx", tiling.shape, strict=True)])
    first = edits.where(fits).groupBy("grid_id", *names).agg(F.min(F.struct("place", "mode"))["mode"].alias("mode"))
    numbers = [F.floor(place[a] / e).cast("int").alias(f"t{a}") for a, e in zip("zyx", tiling.edges, strict=True)]
    inside = F.struct(*[F.pmod(place[a], F.lit(e)).cast("int").alias(a) for a, e in zip("zyx", tiling.edges, strict=True)])
    mode = F.when(F.col("mode") == "paint", 1).when(F.col("mode") == "erase", 0).otherwise(2)
    by_tile = first.select(F.col("grid_id").cast("long").alias("grid_id"), *numbers, F.struct(inside.alias("at"), mode.alias("mode")).alias("e")).groupBy(*KEY).agg(F.collect_list("e").alias("edits"))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in (*KEY, "cells")), strict=True)
                for (grid_id, *tile, cells), own in zip(keys, batch.column("edits"), strict=True):
                    block = tiling.block(tuple(tile), cells)
                    if own.is_valid:
                        flat = own.values.flatten()
                        at = tuple(x.to_numpy() for x in flat[0].flatten())
                        modes = flat[1].to_numpy()
                        block[at] = np.where(modes == 2, 1 - block[at], modes)
                    if block.any():
                        yield grid_id, *tile, np.packbits(block).tobytes()

        return _rows(rows(), [*KEY, "cells"], _TILE_TYPES)

    return tiles.select(*KEY, "cells").join(by_tile, KEY, "full").select(*KEY, "cells", "edits").mapInArrow(scatter, TILES)


def place_pattern(tiles: DataFrame, pattern: DataFrame, shape: tuple[int, ...], row: int, column: int, edge: int | None = None) -> DataFrame:
    """2D tiles of the grids that are there, with a pattern (rows ``y, x, alive``) written over the place at (row, column), its dead cells
    included.  The pattern must fit: no wrapping."""
    row, column = whole(row, "row", 0), whole(column, "column", 0)
    size = pattern.agg(F.max("y"), F.max("x")).first()
    if size[0] is None:
        return tiles
    if row + size[0] >= shape[0] or column + size[1] >= shape[1]:
        raise ValueError(f"a pattern of {size[0] + 1}x{size[1] + 1} does not fit at ({row}, {column})")
    mode = F.when(F.col("alive") != 0, "paint").otherwise("erase")
    cells = pattern.select((F.col("y") + row).alias("y"), (F.col("x") + column).alias("x"), F.lit(0).alias("place"), mode.alias("mode"))
    return edit_cells(tiles, tiles.select("grid_id").distinct().join(broadcast_if_small(cells, BROADCAST_KEYS)), shape, edge)
