import numpy as np
import pytest
from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE, parse_rule, parse_rule_3d
from cellweave.operators import grids, large, render, tiles
from test_tiles import rolled

def started(spark, shape, edge, density=0.4):
    random = np.random.default_rng(sum(shape) + edge)
    stack = [(random.random(shape) < density).astype(np.uint8) for _ in range(2)] + [np.zeros(shape, np.uint8)]
    stack[2][(0,) * len(shape)] = 1
    return stack, tiles.from_cells(grids.to_cells(grids.grids_from_arrays(spark, stack), len(shape)), shape, edge)


def arrays(found, shape, edge, count):
    out = [np.zeros(shape, np.uint8) for _ in range(count)]
    for row in tiles.to_cells(found, shape, edge).collect():
        out[row[0]][tuple(row[1:])] = 1
    return out


def counts(before, after):
    births, deaths = int((after > before).sum()), int((after < before).sum())
    return int(after.sum()), births + deaths, births, deaths


def rules(shape):
    flat = len(shape) == 2
    return [CONWAY if flat else DEFAULT_3D_RULE, parse_rule("B/S23") if flat else parse_rule_3d("B/S2,3,4,5,6"), parse_rule("B013/S24") if flat else parse_rule_3d("B0,5/S3,4,9")]


@pytest.mark.parametrize("shape,edge,halo", [((23, 17), 5, 3), ((2, 5), 2, 4), ((9, 8, 7), 4, 4)])
def test_metrics(spark, shape, edge, halo):
    stack, start = started(spark, shape, edge)
    for rule in rules(shape):
        end, metrics = large.run_metrics(start, rule, shape, 7, edge, halo)
        got = {(r["grid_id"], r["generation"]): tuple(r[c] for c in large.COUNTS) for r in metrics.collect()}
        want = {(i, g): counts(rolled(s, rule, g - 1), rolled(s, rule, g)) for i, s in enumerate(stack) for g in range(1, 8)}
        assert got == want
        assert all((a == rolled(s, rule, 7)).all() for a, s in zip(arrays(end, shape, edge, 3), stack, strict=True))
    assert large.run_metrics(start, CONWAY if len(shape) == 2 else DEFAULT_3D_RULE, shape, 0, edge)[1].count() == 0


@pytest.mark.parametrize("shape,edge,halo,most", [((23, 17), 5, 3, 5), ((16, 16), 8, 8, 30), ((9, 8, 7), 4, 2, 8), ((1, 2, 3), 2, 3, 0)])
def test_until_stable(spark, shape, edge, halo, most):
    stack, start = started(spark, shape, edge)
    for rule in rules(shape):
        end, summary = large.run_until_stable(start, rule, shape, most, edge, halo)
        want = {}
        for i, s in enumerate(stack):
            before, taken, settled, last = s, 0, False, (int(s.sum()), 0, 0, 0)
            while taken < most and not settled:
                after = rolled(before, rule, 1)
                taken, last = taken + 1, counts(before, after)
                settled, before = last[1] == 0, after
            want[i] = (taken, settled, *last)
            stack[i] = s
        got = {r["grid_id"]: (r["steps_taken"], r["settled"], *(r[c] for c in large.COUNTS)) for r in summary.collect()}
        assert got == want
        for a, s, i in zip(arrays(end, shape, edge, 3), stack, range(3), strict=True):
            assert (a == rolled(s, rule, want[i][0])).all()


def test_work_follows_the_frontier(spark):
    """A glider among many still blocks: after the first round only the tiles around it are computed."""
    shape, edge = (1024, 1024), 32
    blocks = [(0, y * 64 + dy + 40, x * 64 + dx + 40, 1) for y in range(15) for x in range(15) for dy in (0, 1) for dx in (0, 1)]
    glider = [(0, y, x, 1) for y, x in ((0, 1), (1, 2), (2, 0), (2, 1), (2, 2))]
    start = tiles.from_cells(spark.createDataFrame(blocks + glider, "grid_id long, y int, x int, alive int"), shape, edge)
    computed: list[int] = []
    _, summary = large.run_until_stable(start, CONWAY, shape, 40, edge, 8, computed)
    assert computed[0] > 200 and max(computed[1:]) <= 16 and len(computed) == 5
    row = summary.first()
    assert (row["steps_taken"], row["settled"], row["alive"]) == (40, False, 15 * 15 * 4 + 5)


@pytest.mark.parametrize("limit", [1, 10, 57, 10_000])
def test_sample(spark, limit, monkeypatch):
    monkeypatch.setattr(large, "BAND", 7)
    shape, edge = (9, 8, 7), 4
    random = np.random.default_rng(limit)
    stack = [(random.random(shape) < d).astype(np.uint8) for d in (0.5, 0.02, 1.0)]
    packed = grids.grids_from_arrays(spark, stack)
    start = tiles.from_cells(grids.to_cells(packed, 3), shape, edge)
    got = {}
    for r in large.sample_live(start, shape, limit, edge).orderBy("grid_id", "i").collect():
        got.setdefault(r["grid_id"], []).append((r["live"], r["sampled"], r["z"], r["y"], r["x"]))
    want = {r["grid_id"]: [(r["live"], r["sampled"], *v) for v in r["voxels"]] for r in render.voxels(packed, limit).collect() if r["live"]}
    assert got == want


def test_edits(spark):
    shape, edge = (23, 17), 5
    stack, start = started(spark, shape, edge)
    random = np.random.default_rng(3)
    rows = [(int(random.integers(0, 3)), int(random.integers(-2, 25)), int(random.integers(-2, 19)), i, ["paint", "erase", "toggle"][i % 3]) for i in range(900)]
    got = arrays(large.edit_cells(start, spark.createDataFrame(rows, "grid_id long, y int, x int, place int, mode string"), shape, edge), shape, edge, 3)
    met = set()
    for g, y, x, _, mode in rows:
        if 0 <= y < 23 and 0 <= x < 17 and (g, y, x) not in met:
            met.add((g, y, x))
            stack[g][y, x] = {"paint": 1, "erase": 0, "toggle": 1 - stack[g][y, x]}[mode]
    assert all((a == b).all() for a, b in zip(got, stack, strict=True))
    none = start.limit(0)
    assert tiles.to_cells(large.edit_cells(none, spark.createDataFrame([(9, 1, 1, 0, "toggle"), (9, 2, 2, 0, "erase")], "grid_id long, y int, x int, place int, mode string"), shape, edge), shape, edge).collect() == [(9, 1, 1)]


def test_pattern(spark):
    shape, edge = (23, 17), 5
    stack, start = started(spark, shape, edge)
    pattern = spark.createDataFrame([(y, x, (y + x) % 2) for y in range(6) for x in range(7)], "y int, x int, alive int")
    got = arrays(large.place_pattern(start, pattern, shape, 3, 4, edge), shape, edge, 3)
    for a, b in zip(got, stack, strict=True):
        b[3:9, 4:11] = np.add.outer(np.arange(6), np.arange(7)) % 2
        assert (a == b).all()
    with pytest.raises(ValueError):
        large.place_pattern(start, pattern, shape, 20, 4, edge)
