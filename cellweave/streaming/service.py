"""The service façade: one method for each request a client can make, with the requests' limits.

No web server is part of this: bind the methods to one, or call them.  Bad requests raise ``ValueError``, unknown sessions
``KeyError``, and a sweep while another runs ``Busy``.
"""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

from cellweave.functions.workload import MAX_INTERACTIVE_CELL_UPDATES, MAX_SWEEP_CELL_UPDATES, validate_interactive_workload, validate_sweep_workload, whole
from cellweave.plans.experiments import random_experiment
from cellweave.streaming.sessions import DEFAULTS, SessionStore

#: Least and most of what a request may ask for.
LIMITS = {
    "size_2d": (8, 1024),
    "size_3d": (8, 128),
    "steps": (1, 100_000),
    "max_steps": (0, 100_000),
    "max_voxels": (1, 200_000),
    "rules": (1, 100),
    "initial_conditions": (1, 100),
    "sweep_size_2d": (8, 256),
    "sweep_size_3d": (8, 96),
    "sweep_steps": (1, 2000),
}


class Busy(RuntimeError):
    """Another sweep is running."""


def status(error: Exception) -> int:
    """The HTTP status of a request that ended with ``error``."""
    if isinstance(error, Busy):
        return 429
    return 404 if isinstance(error, KeyError) else 400 if isinstance(error, (ValueError, TypeError)) else 500


def within(name: str, value: int) -> int:
    least, most = LIMITS[name]
    if not least <= whole(value, name, least) <= most:
        raise ValueError(f"{name} must be between {least} and {most}")
    return value


class Service:
    def __init__(self, spark: SparkSession | None, store_2d: SessionStore | None = None, store_3d: SessionStore | None = None):
        self.spark = spark
        self.stores = {2: store_2d or SessionStore(2), 3: store_3d or SessionStore(3)}
        self._sweeping = threading.Lock()
        for store in self.stores.values():
            store.ensure_default()

    def health(self) -> dict:
        return {"status": "ok", "device": f"spark:{self.spark.sparkContext.master}"}

    def create(self, dims: int, shape: tuple[int, ...] | None = None, **request) -> dict:
        shape = tuple(within(f"size_{dims}d", n) for n in shape or DEFAULTS[dims]["shape"])
        return self.stores[dims].payload(self.stores[dims].create(shape, **request).session_id)

    def state(self, dims: int, session_id: str | None = None, include_grid: bool = False) -> dict:
        return self.stores[dims].payload(session_id, include_grid=include_grid)

    def render(self, dims: int, session_id: str | None = None, max_voxels: int = 75_000):
        if dims == 2:
            return self.stores[2].render_bits(session_id)
        return self.stores[3].render_voxels(session_id, max_voxels=within("max_voxels", max_voxels))

    def reset(self, dims: int, session_id: str | None = None) -> dict:
        return self.stores[dims].payload(self.stores[dims].reset(session_id).session_id)

    def clear(self, dims: int, session_id: str | None = None) -> dict:
        return self.stores[dims].payload(self.stores[dims].clear(session_id).session_id)

    def randomize(self, dims: int, session_id: str | None = None, **request) -> dict:
        return self.stores[dims].payload(self.stores[dims].randomize(session_id, **request).session_id)

    def step(self, dims: int, session_id: str | None = None, steps: int = 1, collect_metrics: bool = False) -> dict:
        store = self.stores[dims]
        validate_interactive_workload(dimensions=dims, cells=store.get(session_id).grid.size, steps=within("steps", steps))
        metrics = store.step(session_id, steps=steps, collect_metrics=collect_metrics)
        return store.payload(session_id) | ({"metrics": metrics} if collect_metrics else {})

    def rule(self, dims: int, rule: str, session_id: str | None = None) -> dict:
        return self.stores[dims].payload(self.stores[dims].set_rule(rule, session_id).session_id)

    def random_rule(self, dims: int, session_id: str | None = None, seed: int | None = None) -> dict:
        return self.stores[dims].payload(self.stores[dims].random_rule(session_id, seed=seed).session_id)

    def run_until_stable(self, dims: int, session_id: str | None = None, max_steps: int = 100) -> dict:
        store = self.stores[dims]
        validate_interactive_workload(dimensions=dims, cells=store.get(session_id).grid.size, steps=within("max_steps", max_steps))
        taken, settled = store.run_until_stable(session_id, max_steps=max_steps)
        return store.payload(session_id) | {"steps_taken": taken, "settled": settled}

    def put_state(self, grid, session_id: str | None = None, **request) -> dict:
        return self.stores[2].payload(self.stores[2].set_state(grid, session_id, **request).session_id, include_grid=True)

    def export(self, dims: int, session_id: str | None = None):
        return self.stores[2].payload(session_id, include_grid=True) if dims == 2 else self.stores[3].export_npz(session_id)

    def export_view(self, session_id: str | None = None, max_voxels: int = 75_000) -> dict:
        return self.stores[3].render_view(session_id, max_voxels=within("max_voxels", max_voxels))

    def slice(self, session_id: str | None = None, axis: str = "z", index: int = 0) -> dict:
        return self.stores[3].slice(session_id, axis=axis, index=index)

    def step_both(self, session_2d: str, session_3d: str, steps: int = 1) -> tuple[dict, dict]:
        """A 2D and a 3D session side by side, by as many generations."""
        return self.step(2, session_2d, steps), self.step(3, session_3d, steps)

    def sweep_limits(self) -> dict:
        return {"max_cell_updates": MAX_SWEEP_CELL_UPDATES, "max_interactive_cell_updates": MAX_INTERACTIVE_CELL_UPDATES}

    def sweep(self, dims: int, *, rules: int, initial_conditions: int, size: int, steps: int, density: float = 0.10, seed: int = 42) -> dict:
        request = {"rules": within("rules", rules), "initial_conditions": within("initial_conditions", initial_conditions), "size": within(f"sweep_size_{dims}d", size), "steps": within("sweep_steps", steps)}
        validate_sweep_workload(dimensions=dims, **request)
        if not self._sweeping.acquire(blocking=False):
            raise Busy("a sweep is running")
        try:
            rows, manifest = random_experiment(self.spark, dims, **request, density=density, seed=seed)
            return {"manifest": manifest, "rows": [r.asDict() for r in rows.orderBy("rule", "initial_condition").collect()]}
        finally:
            self._sweeping.release()
