import numpy as np
import pytest
from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE, HIGHLIFE, int_to_rule, parse_rule, parse_rule_3d
from cellweave.functions.metrics import cell_counts, transition_counts
from cellweave.operators import cells, grids, native, render, simulate
from cellweave.sources.patterns import get_pattern, pattern_from_text
from pyspark.sql import functions as F


def brute(grid, rule, steps=1):
    """One generation by summed rolls."""
    axes = tuple(range(grid.ndim))
    for _ in range(steps):
        n = -grid.astype(int)
        for offset in np.ndindex(*(3,) * grid.ndim):
            n = n + np.roll(grid, tuple(o - 1 for o in offset), axes)
        grid = np.where(grid == 1, np.array(rule.survival)[n], np.array(rule.birth)[n]).astype(np.uint8)
    return grid


def after(spark, grid, rule, steps):
    packed = simulate.with_rule(grids.grids_from_arrays(spark, [grid]), rule)
    return grids.grids_to_arrays(simulate.run_steps(packed, steps, np.ndim(grid)), np.ndim(grid))[0]


def placed(shape, points):
    grid = np.zeros(shape, np.uint8)
    for p in points:
        grid[p] = 1
    return grid


GLIDER = [(0, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_still_life_and_oscillator(spark):
    block = placed((4, 4), [(1, 1), (1, 2), (2, 1), (2, 2)])
    assert (after(spark, block, CONWAY, 20) == block).all()
    blinker = placed((5, 5), [(2, 1), (2, 2), (2, 3)])
    assert (after(spark, blinker, CONWAY, 1) == placed((5, 5), [(1, 2), (2, 2), (3, 2)])).all()
    assert (after(spark, blinker, CONWAY, 2) == blinker).all()


def test_glider_moves(spark):
    start = placed((10, 10), [(y + 1, x + 1) for y, x in GLIDER])
    assert (after(spark, start, CONWAY, 4) == placed((10, 10), [(y + 2, x + 2) for y, x in GLIDER])).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 3), (3, 1), (2, 2), (2, 5), (5, 7), (1, 1, 1), (2, 2, 2), (1, 2, 3), (3, 1, 2), (4, 3, 5)])
def test_all_forms_agree_with_rolls(spark, shape):
    random = np.random.default_rng(sum(shape))
    dims = len(shape)
    stack = [random.integers(0, 2, shape).astype(np.uint8) for _ in range(3)]
    for rule in (int_to_rule(int(random.integers(1 << 18 if dims == 2 else 1 << 54)) | 1, dims), CONWAY if dims == 2 else DEFAULT_3D_RULE):
        packed = simulate.with_rule(grids.grids_from_arrays(spark, stack), rule)
        want = [brute(g, rule, 3) for g in stack]
        got = grids.grids_to_arrays(simulate.run_steps(packed, 3, dims), dims)
        one = grids.grids_to_arrays(native.run_steps(packed, 1, dims), dims)
        relation = cells.run(grids.to_cells(packed.drop("rule_id"), dims), rule, shape, 1)
        two = grids.grids_to_arrays(grids.from_cells(relation, shape), dims)
        for i, g in enumerate(stack):
            assert (got[i] == want[i]).all()
            assert (one[i] == brute(g, rule)).all()
            assert (two[i] == brute(g, rule)).all()


def test_neighbours_wrap(spark):
    counts = grids.grids_to_arrays(simulate.neighbour_counts(grids.grids_from_arrays(spark, [placed((6, 6), [(0, 0)])])))[0]
    assert counts[0, 1] == counts[5, 5] == 1 and counts[3, 3] == 0
    full = grids.grids_from_arrays(spark, [np.ones((3, 3, 3))])
    assert grids.grids_to_arrays(simulate.neighbour_counts(full, 3), 3)[0][1, 1, 1] == 26


def test_small_grids_stay_whole_in_tasks(spark, monkeypatch):
    """Generations of small grids follow without a shuffle, and more grids are more tasks, not larger ones."""
    monkeypatch.setattr(cells, "TASK_CELLS", 160)
    random = np.random.default_rng(5)
    stack = [random.integers(0, 2, (4, 5)).astype(np.uint8) for _ in range(80)]
    start = grids.to_cells(cells.by_grid(grids.grids_from_arrays(spark, stack), (4, 5)))
    plan = cells.run(start, CONWAY, (4, 5), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(grid_id" in plan
    last = cells.run(start, CONWAY, (4, 5), 6)
    assert last.rdd.getNumPartitions() == 10
    got = grids.grids_to_arrays(grids.from_cells(last, (4, 5)))
    assert len(got) == 80 and all((got[i] == brute(g, CONWAY, 6)).all() for i, g in enumerate(stack))
    large = spark.range(3).selectExpr("id AS grid_id", "0 AS y", "0 AS x", "1 AS alive")
    assert cells.by_grid(large, (4096, 4096)) is large


def test_sparse_equals_dense(spark):
    grid = placed((12, 9), GLIDER)
    dense = grids.to_cells(grids.grids_from_arrays(spark, [grid]))
    sparse = cells.run(dense.where("alive = 1"), HIGHLIFE, (12, 9), 5, live_only=True)
    assert {(r["y"], r["x"]) for r in sparse.collect()} == set(map(tuple, np.argwhere(brute(grid, HIGHLIFE, 5)).tolist()))
    with pytest.raises(ValueError):
        cells.step(dense, parse_rule("B0/S"), (12, 9), live_only=True)


def test_birth_in_3d(spark):
    packed = simulate.with_rule(grids.grids_from_arrays(spark, [placed((5, 5, 5), [(2, 2, 2)])]), parse_rule_3d("B1/S"))
    row = simulate.run_metrics(packed, 1, 3).first()
    assert (row["births"], row["deaths"], row["alive"]) == (26, 1, 26)


def test_metrics(spark):
    blinker = simulate.with_rule(grids.grids_from_arrays(spark, [placed((5, 5), [(2, 1), (2, 2), (2, 3)])]), CONWAY)
    rows = simulate.run_metrics(blinker, 2).orderBy("generation").collect()
    assert [(r["alive"], r["changed"], r["births"], r["deaths"]) for r in rows] == [(3, 4, 2, 2)] * 2
    last = simulate.run_last_metrics(blinker, 0).first()
    assert (last["alive"], last["changed"]) == (0, 0)
    pair = spark.createDataFrame([([1, 0, 0, 0], [0, 1, 1, 0])], "a array<tinyint>, b array<tinyint>")
    found = pair.select(transition_counts(F.col("a"), F.col("b")).alias("t")).first()["t"]
    assert tuple(found) == (2, 3, 2, 1)
    relation = lambda c: grids.to_cells(grids.grids_from_arrays(spark, [np.array(c).reshape(2, 2)]))
    assert tuple(cell_counts(relation([1, 0, 0, 0]), relation([0, 1, 1, 0]), ["grid_id", "y", "x"]).first()) == (0, 2, 3, 2, 1)


def test_until_stable(spark):
    block, lone = placed((5, 5), [(1, 1), (1, 2), (2, 1), (2, 2)]), placed((5, 5), [(0, 0)])
    blinker = placed((5, 5), [(2, 1), (2, 2), (2, 3)])
    packed = simulate.with_rule(grids.grids_from_arrays(spark, [block, lone, blinker]), CONWAY)
    rows = {r["grid_id"]: (r["steps_taken"], r["settled"]) for r in simulate.run_until_stable(packed, 9).collect()}
    assert rows == {0: (1, True), 1: (2, True), 2: (9, False)}
    assert {(r["steps_taken"], r["settled"]) for r in simulate.run_until_stable(packed, 0).collect()} == {(0, False)}


def test_trajectory(spark):
    grid = simulate.with_rule(grids.grids_from_arrays(spark, [placed((4, 4, 4), [(0, 0, 0)])]), parse_rule_3d("B1/S"))
    assert sorted(r["generation"] for r in simulate.trajectory(grid, 5, 3, 2).collect()) == [0, 2, 4, 5]
    with pytest.raises(ValueError):
        simulate.trajectory(grid, 5, 3, 0)
    with pytest.raises(ValueError):
        simulate.run_steps(grid, -1, 3)


def test_many_rules(spark):
    both = simulate.with_rules(grids.random_grids(spark, 3, (8, 8), 0.4, 3), [CONWAY, HIGHLIFE])
    assert simulate.run_steps(both, 2).count() == 6
    assert simulate.trajectory(both, 3).groupBy("rule_index", "grid_id").count().where("count = 4").count() == 6
    with pytest.raises(ValueError):
        simulate.with_rules(both, [])


def test_mixed_shapes_in_one_batch(spark):
    a, b = placed((6, 6), GLIDER), placed((9, 4), GLIDER)
    packed = simulate.with_rule(grids.grids_from_arrays(spark, [a, b, a]), CONWAY).coalesce(1)
    got = grids.grids_to_arrays(simulate.run_steps(packed, 3))
    assert (got[1] == brute(b, CONWAY, 3)).all() and (got[2] == brute(a, CONWAY, 3)).all()


def test_random_is_seeded_and_exact_at_the_ends(spark):
    same = [grids.grids_to_arrays(grids.random_grids(spark, s, (4, 5, 6), 0.5, 2).repartition(3), 3) for s in (1, 1, 2)]
    assert (same[0][1] == same[1][1]).all() and (same[0][1] != same[2][1]).any() and (same[0][0] != same[0][1]).any()
    assert grids.grids_to_arrays(grids.random_grids(spark, 1, (4, 5), 0))[0].sum() == 0
    assert grids.grids_to_arrays(grids.random_grids(spark, 1, (4, 5), 1))[0].sum() == 20
    with pytest.raises(ValueError):
        grids.random_grids(spark, 1, (4, 5), 1.1)
    with pytest.raises(TypeError):
        grids.random_grids(spark, "1", (4, 5), 0.1)
    with pytest.raises(ValueError):
        grids.empty_grids(spark, (0, 3))


def test_patterns(spark):
    text = pattern_from_text(spark, ".#.\n\n ..#\n###\n")
    key = lambda df: sorted(map(tuple, df.select("y", "x", "alive").collect()))
    assert key(text) == key(get_pattern(spark, "GLIDER"))
    full = grids.grids_from_arrays(spark, [np.ones((6, 6))])
    done = grids.grids_to_arrays(grids.place_pattern(full, text, 1, 2))[0]
    assert (done[1:4, 2:5] == [[0, 1, 0], [0, 0, 1], [1, 1, 1]]).all() and done.sum() == 36 - 4
    with pytest.raises(ValueError):
        grids.place_pattern(grids.empty_grids(spark, (3, 3)), text, 1, 1)
    with pytest.raises(KeyError):
        get_pattern(spark, "gun")
    for bad in ("", "#\n##", "#a"):
        with pytest.raises(ValueError):
            pattern_from_text(spark, bad)


def test_render(spark):
    packed = render.pack_bits(grids.grids_from_arrays(spark, [placed((8, 8), [(0, 0), (1, 3)])]))
    row = packed.first()
    assert len(row["content"]) == 8 and row["content"][0] == 1 and row["content"][1] == 8
    odd = np.random.default_rng(0).integers(0, 2, (5, 3)).astype(np.uint8)
    content = render.pack_bits(grids.grids_from_arrays(spark, [odd]))
    assert bytes(content.first()["content"]) == np.packbits(odd.ravel(), bitorder="little").tobytes()
    assert (grids.grids_to_arrays(render.unpack_bits(content))[0] == odd).all()
    shown = render.voxel_bytes(render.voxels(grids.grids_from_arrays(spark, [np.ones((8, 8, 8))]), 10)).first()
    assert len(shown["content"]) == 30 and shown["sampled"] and shown["live"] == 512


@pytest.mark.parametrize("n,m", [(1, 1), (5, 1), (10, 3), (512, 10), (7, 7), (1000, 999), (3, 9)])
def test_even_sample(spark, n, m):
    got = spark.range(1).select(render.sample_positions(F.lit(n), m).alias("p")).first()["p"]
    assert got == (list(range(n)) if n <= m else np.linspace(0, n - 1, m, dtype=np.int64).tolist())


def test_slices(spark):
    grid = placed((3, 4, 5), [(1, 2, 3), (2, 0, 4)])
    packed = grids.grids_from_arrays(spark, [grid])
    for axis, index, want in (("z", 1, grid[1]), ("y", 2, grid[:, 2]), ("x", 4, grid[:, :, 4])):
        row = grids.slice_grids(packed, axis, index).first()
        assert (row["height"], row["width"], row["alive"]) == (*want.shape, want.sum())
        assert row["cells"] == want.ravel().tolist()
    for axis, index in (("z", 3), ("w", 0), ("x", -1)):
        with pytest.raises(ValueError):
            grids.slice_grids(packed, axis, index)
