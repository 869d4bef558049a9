import csv
import json
from collections import Counter
from itertools import product

import numpy as np
import pytest
from cellweave.functions import workload
from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE
from cellweave.plans import benchmarks, experiments
from cellweave.sources import states


@pytest.mark.parametrize("dims", [2, 3])
def test_sweeps_are_repeatable(spark, tmp_path, dims):
    request = {"rules": 3, "initial_conditions": 5, "size": 6, "steps": 3, "density": 0.35, "seed": 1234}
    kind = f"random_{dims}d"
    run = getattr(experiments, f"{kind}_experiment")
    rows, manifest = run(spark, **request)
    told = []
    again, _ = run(spark, **request, progress=lambda *x: told.append(x))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(rows) == key(again) and rows.count() == 15 and told == [(1, 3), (2, 3), (3, 3)]
    assert key(run(spark, **request | {"seed": 1235})[0]) != key(rows)
    target = experiments.save_experiment(rows, manifest, kind, tmp_path / kind)
    held = json.loads(open(f"{target}/manifest.json").read())
    assert held["grid_size"] == [6] * dims and held["seed"] == 1234
    assert len(list(csv.DictReader(open(f"{target}/results.csv")))) == 15
    experiments.write_results(rows, f"file://{tmp_path}/csv")
    quoted = [line for p in (tmp_path / "csv").glob("*.csv") for line in p.read_text().splitlines()]
    assert sum(line.startswith(f'"{dims}","B') for line in quoted) == 15
    summary = experiments.browse(experiments.summary_by_rule(rows), "/s", "changed", True).collect()
    assert sum(r["runs"] for r in summary) == 15 and [r["changed"] for r in summary] == sorted((r["changed"] for r in summary), reverse=True)


def test_no_steps(spark):
    rows, _ = experiments.random_2d_experiment(spark, rules=2, initial_conditions=1, size=5, steps=0)
    assert all(r["fixed_point"] and r["mean_changed_fraction"] == 0 and r["initial_alive_fraction"] == r["final_alive_fraction"] for r in rows.collect())
    for bad in ({"rules": 0}, {"size": 0}, {"initial_conditions": -1}, {"steps": -2}, {"density": 1.5}, {"steps": 2.5}):
        with pytest.raises(ValueError):
            experiments.random_2d_experiment(spark, **bad)


def test_comparison(spark):
    rows, manifest = experiments.compare_dimensions(spark, rules=2, initial_conditions=3, size_2d=7, size_3d=5, steps=2)
    assert Counter(r["dimensions"] for r in rows.collect()) == {2: 6, 3: 6}
    assert (manifest["grid_size_2d"], manifest["grid_size_3d"]) == ([7, 7], [5, 5, 5])


def test_workload():
    """Estimates are products; limits are met exactly and not passed."""
    for dims in (2, 3):
        for rules, conditions, size, steps in product((1, 7), (1, 9), (3, 11), (0, 1, 13)):
            assert workload.estimate_cell_updates(dimensions=dims, rules=rules, initial_conditions=conditions, size=size, steps=steps) == rules * conditions * size**dims * steps
            assert workload.estimate_interactive_cell_updates(dimensions=dims, cells=size, steps=steps) == size * steps * (3**dims - 1)
    most = {"dimensions": 2, "rules": 100, "initial_conditions": 100, "size": 10}
    assert workload.validate_sweep_workload(**most, steps=100) == workload.MAX_SWEEP_CELL_UPDATES
    assert workload.validate_interactive_workload(dimensions=2, cells=12_500, steps=1000) == workload.MAX_INTERACTIVE_CELL_UPDATES
    for refused in (lambda: workload.validate_sweep_workload(**most, steps=101), lambda: workload.validate_interactive_workload(dimensions=2, cells=12_501, steps=1000), lambda: workload.estimate_cell_updates(**most | {"dimensions": 4}, steps=1), lambda: workload.whole(True, "n")):
        with pytest.raises(ValueError):
            refused()


def test_benchmark_report(spark, tmp_path):
    assert benchmarks.benchmark_sizes(spark, 50) == [16, 32, 48, 50] and benchmarks.benchmark_sizes(spark, 400) == [*benchmarks.EDGES, 320, 384, 400]
    table, full = benchmarks.write_report([{"size": 16, "ms": 1.5}, {"size": 32, "ms": 4.0}], {"steps": 10}, tmp_path / "b")
    assert [r["ms"] for r in csv.DictReader(open(table))] == ["1.5", "4.0"] and json.loads(full.read_text())["sizes"] == [16, 32]


@pytest.mark.parametrize("dims", [2, 3])
def test_state_files(spark, tmp_path, dims):
    grid = np.random.default_rng(dims).integers(0, 2, (3, 4, 5)[3 - dims :]).astype(np.uint8)
    rule = CONWAY if dims == 2 else DEFAULT_3D_RULE
    for suffix in ("json", "npz"):
        states.save_state(tmp_path / f"s.{suffix}", grid, rule, seed=7, density=0.5, generation=3)
        state = states.load_state(tmp_path / f"s.{suffix}")
        assert (state.grid == grid).all() and state.rule == rule and (state.seed, state.density, state.generation) == (7, 0.5, 3)
    folder = tmp_path / "grids"
    folder.mkdir()
    for suffix in ("npy", "npz"):
        states.save_grid(folder / f"g.{suffix}", grid * 5)
        assert (states.load_grid(folder / f"g.{suffix}", dims) == grid).all()
    assert [r["cells"] for r in states.read_arrays(spark, str(folder)).collect()] == [grid.ravel().tolist()] * 2
    (tmp_path / "json").mkdir()
    states.save_state(tmp_path / "json/s.json", grid, rule, seed=7)
    read = states.read_states(spark, str(tmp_path / "json"), dims)
    assert read.first()["cells"] == grid.ravel().tolist() and read.first()["seed"] == 7
    back = states.import_state_json(states.state_json(read).first()["json"])
    assert (back.grid == grid).all() and back.rule == rule and back.density is None


def test_bad_states(tmp_path):
    with pytest.raises(ValueError):
        states.import_state_json('{"rule": "B3/S23"}')
    with pytest.raises(ValueError):
        states.import_state_json('{"dimensions": 3, "rule": "B/S", "depth": 2, "grid": [[[1]]]}')
    with pytest.raises(ValueError):
        states.save_grid(tmp_path / "g.txt", np.ones((2, 2)))
    with pytest.raises(ValueError):
        states.state_to_dict(np.ones((2, 2)), CONWAY, generation=-1)
