import numpy as np
import pytest
from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE, parse_rule, parse_rule_3d
from cellweave.operators import grids, tiles


def rolled(grid, rule, steps):
    axes = tuple(range(grid.ndim))
    for _ in range(steps):
        n = sum(np.roll(grid, tuple(o - 1 for o in offset), axes).astype(int) for offset in np.ndindex(*(3,) * grid.ndim)) - grid
        grid = np.where(grid == 1, np.array(rule.survival)[n], np.array(rule.birth)[n]).astype(np.uint8)
    return grid


def tiled(spark, stack, rule, steps, edge, halo):
    shape = stack[0].shape
    relation = grids.to_cells(grids.grids_from_arrays(spark, stack), len(shape))
    out = [np.zeros(shape, np.uint8) for _ in stack]
    for row in tiles.to_cells(tiles.run(tiles.from_cells(relation, shape, edge), rule, shape, steps, edge, halo), shape, edge).collect():
        out[row[0]][tuple(row[1:])] = 1
    return out


@pytest.mark.parametrize("shape,edge,halo", [((23, 17), 5, 3), ((16, 16), 8, 8), ((7, 30), 64, 4), ((1, 3), 1, 5), ((2, 5), 2, 4), ((9, 8, 7), 4, 2), ((1, 2, 3), 2, 3), ((5, 5, 5), 3, 1)])
def test_tiles_agree_with_rolls(spark, shape, edge, halo):
    random = np.random.default_rng(sum(shape) + edge)
    stack = [random.integers(0, 2, shape).astype(np.uint8) for _ in range(2)] + [np.zeros(shape, np.uint8)]
    stack[2][(0,) * len(shape)] = 1
    flat = len(shape) == 2
    for rule in (CONWAY if flat else DEFAULT_3D_RULE, parse_rule("B013/S24") if flat else parse_rule_3d("B0,5/S3,4,9")):
        for got, start in zip(tiled(spark, stack, rule, 5, edge, halo), stack, strict=True):
            assert (got == rolled(start, rule, 5)).all()


def test_sparse_tiles(spark):
    """A glider far out costs the tiles it touches, whatever the grid's size."""
    shape, glider = (1 << 20, 1 << 20), [(0, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    far = (1 << 20) - 2
    rows = [(7, far + y, far + x, 1) for y, x in glider] + [(7, far, far + 1, 1), (7, 5, 5, 0)]
    start = tiles.from_cells(spark.createDataFrame(rows, "grid_id long, y int, x int, alive int"), shape)
    end = tiles.run(start, CONWAY, shape, 12).persist()
    assert 1 <= end.count() <= 4
    assert {tuple(r) for r in tiles.to_cells(end, shape).collect()} == {(7, (far + y + 3) % (1 << 20), (far + x + 3) % (1 << 20)) for y, x in glider}
    assert tiles.run(start.limit(0), CONWAY, shape, 2).count() == 0
    for bad in ({"steps": -1}, {"steps": 1, "halo": 0}):
        with pytest.raises(ValueError):
            tiles.run(start, CONWAY, shape, **bad)


def test_halo_round_a_small_torus_is_sent_once(spark):
    """A halo that goes round the torus several times takes each tile once: eight tiles give to eight, not a part a lap."""
    tiling = tiles._Tiling((4, 4, 4), 3)
    full = grids.to_cells(grids.grids_from_arrays(spark, [np.ones((4, 4, 4), np.uint8)]), 3)
    assert tiles.parts(tiles.from_cells(full, (4, 4, 4), 3), tiling, DEFAULT_3D_RULE, 5).count() == 64


def test_grid_ids_of_other_types(spark):
    """Cells whose grid ids are no longs become tiles and grids, whose ids are."""
    rows = spark.createDataFrame([(3, 0, 1, 1), (3, 1, 1, 1), (3, 2, 1, 1), (-4, 5, 5, 1)], "grid_id int, y int, x int, alive int")
    for kind in ("byte", "short", "int", "long"):
        cells = rows.withColumn("grid_id", rows["grid_id"].cast(kind))
        end = tiles.to_cells(tiles.run(tiles.from_cells(cells, (6, 6), 4), CONWAY, (6, 6), 1, 4), (6, 6), 4)
        assert {tuple(r) for r in end.collect()} == {(3, 1, 0), (3, 1, 1), (3, 1, 2)}
        packed = grids.grids_to_arrays(grids.from_cells(cells, (6, 6)))
        assert sorted(packed) == [-4, 3] and packed[3].sum() == 3 and packed[-4][5, 5] == 1
