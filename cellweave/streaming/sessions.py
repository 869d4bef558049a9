"""Interactive sessions: one grid each, held by the driver, expired by age and number.

A session is a single small grid (see ``service.LIMITS``), so its generations run in the driver with the same kernel that the
batch operators use on the executors; many sessions at once belong in ``commands.session_stream``.
"""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE, Rule, int_to_rule, parse_rule, parse_rule_3d, validate_rule
from cellweave.functions.seeds import check_density, check_seed
from cellweave.functions.workload import whole
from cellweave.operators.simulate import next_generation, rule_tables, transition
from cellweave.sources.states import state_to_npz_bytes

MAX_SESSIONS, TTL_SECONDS = 256, 3600.0
#: Defaults of a new session by dimensions.
DEFAULTS = {
    2: {"id": "default", "shape": (128, 128), "density": 0.20, "rule": CONWAY},
    3: {"id": "3d-default", "shape": (32, 32, 32), "density": 0.04, "rule": DEFAULT_3D_RULE},
}
DEFAULT_SEED = 42


def resolve_seed(seed: int | None) -> int:
    """The given seed, or a random one of 32 bits."""
    return secrets.randbits(32) if seed is None else check_seed(seed)


def seeded_grid(seed: int, shape: tuple[int, ...], density: float) -> np.ndarray:
    random = np.random.Generator(np.random.Philox(key=seed & (1 << 64) - 1))
    return (random.random(shape) < check_density(density)).astype(np.uint8)


def seeded_rule(seed: int, dims: int) -> Rule:
    bits = 18 if dims == 2 else 54
    return int_to_rule(int(np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, 1])).integers(1 << bits)), dims)


@dataclass
class Session:
    session_id: str
    grid: np.ndarray
    rule: Rule
    seed: int
    density: float
    first: np.ndarray = field(default=None)  # type: ignore[assignment]
    generation: int = 0
    changed: int = 0
    births: int = 0
    deaths: int = 0
    last_access: float = 0.0

    def __post_init__(self) -> None:
        if self.first is None:
            self.first = self.grid

    def settle(self, counts=(0, 0, 0, 0)) -> None:
        _, self.changed, self.births, self.deaths = map(int, counts)


class SessionStore:
    """Sessions of one number of dimensions.  ``clock`` gives seconds; sessions unused for ``ttl`` go, and beyond
    ``max_sessions`` the longest unused, never the one just made."""

    def __init__(self, dims: int = 2, *, max_sessions: int = MAX_SESSIONS, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.dims, self.max_sessions, self.ttl, self.clock = dims, whole(max_sessions, "max_sessions"), ttl, clock
        if ttl <= 0:
            raise ValueError("ttl must be positive")
        self.sessions: dict[str, Session] = {}
        self.defaults = DEFAULTS[dims]

    # Life cycle.

    def prune(self, protect: str | None = None) -> None:
        """``sessions`` is kept in the order of access, so what has to go stands in front."""
        latest = self.clock() - self.ttl
        for name, session in list(self.sessions.items()):
            stale = session.last_access <= latest
            if not stale and len(self.sessions) <= self.max_sessions:
                break
            if stale or name != protect:
                del self.sessions[name]

    @property
    def count(self) -> int:
        self.prune()
        return len(self.sessions)

    def _parse(self, rule: Rule | str | None) -> Rule:
        if rule is None:
            return self.defaults["rule"]
        return validate_rule(rule if isinstance(rule, Rule) else (parse_rule if self.dims == 2 else parse_rule_3d)(rule), self.dims)

    def create(self, shape: tuple[int, ...] | None = None, *, session_id: str | None = None, rule: Rule | str | None = None, seed: int | None = DEFAULT_SEED, density: float | None = None) -> Session:
        shape = tuple(whole(n, "each dimension") for n in shape or self.defaults["shape"])
        if len(shape) != self.dims:
            raise ValueError(f"a session's grid has {self.dims} dimensions")
        seed, density = resolve_seed(seed), check_density(self.defaults["density"] if density is None else density)
        session = Session(session_id or secrets.token_hex(16), seeded_grid(seed, shape, density), self._parse(rule), seed, density, last_access=self.clock())
        self.sessions.pop(session.session_id, None)
        self.sessions[session.session_id] = session
        self.prune(session.session_id)
        return session

    def ensure_default(self) -> Session:
        name = self.defaults["id"]
        self.prune()
        return self.get(name) if name in self.sessions else self.create(session_id=name)

    def get(self, session_id: str | None = None) -> Session:
        session_id = session_id or self.defaults["id"]
        self.prune()
        if session_id not in self.sessions:
            raise KeyError(f"no session {session_id!r}")
        session = self.sessions[session_id] = self.sessions.pop(session_id)
        session.last_access = self.clock()
        return session

    # Actions.

    def reset(self, session_id: str | None = None) -> Session:
        session = self.get(session_id)
        session.grid, session.generation = session.first, 0
        session.settle()
        return session

    def clear(self, session_id: str | None = None) -> Session:
        """All cells die; ``reset`` still leads back to the grid before."""
        session = self.get(session_id)
        session.grid, session.generation = np.zeros_like(session.grid), 0
        session.settle()
        return session

    def randomize(self, session_id: str | None = None, *, seed: int | None = None, density: float | None = None) -> Session:
        session = self.get(session_id)
        session.density = check_density(session.density if density is None else density)
        session.seed = resolve_seed(seed)
        session.grid = session.first = seeded_grid(session.seed, session.grid.shape, session.density)
        session.generation = 0
        session.settle()
        return session

    def set_rule(self, rule: Rule | str, session_id: str | None = None) -> Session:
        session = self.get(session_id)
        session.rule = self._parse(rule)
        return session

    def random_rule(self, session_id: str | None = None, *, seed: int | None = None) -> Session:
        session = self.get(session_id)
        session.rule = seeded_rule(session.seed if seed is None else check_seed(seed), self.dims)
        return session

    def set_state(self, grid, session_id: str | None = None, *, rule: Rule | str | None = None, seed: int | None = None, density: float | None = None, generation: int = 0) -> Session:
        """Replace the grid by one of equal shape, which ``reset`` then leads back to; edits are no transitions."""
        session = self.get(session_id)
        values = (np.asarray(grid) != 0).astype(np.uint8)
        if values.shape != session.grid.shape:
            raise ValueError(f"the grid's shape is {session.grid.shape}, not {values.shape}")
        session.grid = session.first = values
        session.rule = session.rule if rule is None else self._parse(rule)
        session.seed = session.seed if seed is None else check_seed(seed)
        session.density = session.density if density is None else check_density(density)
        session.generation = whole(generation, "generation", 0)
        session.settle()
        return session

    def _stack(self, grid: np.ndarray) -> np.ndarray:
        return grid.reshape(1, *((1,) * (3 - self.dims)), *grid.shape)

    def _advance(self, session: Session, steps: int, until_stable: bool):
        tables = rule_tables(np.array([session.rule.code]), self.dims)
        stack = self._stack(session.grid)
        for _ in range(steps):
            after = next_generation(stack, tables, self.dims)
            counts = transition(stack, after)[0]
            stack = after
            session.grid, session.generation = after.reshape(session.grid.shape), session.generation + 1
            session.settle(counts)
            yield session.generation, counts
            if until_stable and counts[1] == 0:
                return

    def step(self, session_id: str | None = None, *, steps: int = 1, collect_metrics: bool = False) -> list[dict]:
        session = self.get(session_id)
        total, metrics, moved = session.grid.size, [], False
        for generation, counts in self._advance(session, whole(steps, "steps", 0), False):
            moved = True
            if collect_metrics:
                metrics.append(metric_payload(counts, generation, total))
        if not moved and not collect_metrics:
            session.settle()
        return metrics

    def run_until_stable(self, session_id: str | None = None, *, max_steps: int = 1000) -> tuple[int, bool]:
        session = self.get(session_id)
        taken, settled = 0, False
        last = (0, 0, 0, 0)
        for _, last in self._advance(session, whole(max_steps, "max_steps", 0), True):
            taken, settled = taken + 1, bool(last[1] == 0)
        session.settle(last)
        return taken, settled

    # Views.

    def payload(self, session_id: str | None = None, *, include_grid: bool = False) -> dict:
        session = self.get(session_id)
        total, alive = session.grid.size, int(session.grid.sum())
        names = ("depth", "height", "width")[3 - self.dims :]
        out = {"session_id": session.session_id, "dimensions": self.dims, "rule": session.rule.text, **dict(zip(names, session.grid.shape, strict=True)), "grid_shape": list(session.grid.shape)}
        out |= {"seed": session.seed, "initial_density": session.density, "total_cells": total}
        out |= metric_payload((alive, session.changed, session.births, session.deaths), session.generation, total)
        return out | ({"grid": session.grid.tolist()} if include_grid else {})

    def render_bits(self, session_id: str | None = None) -> bytes:
        """A 2D grid, eight cells a byte, lowest bit first."""
        return np.packbits(self.get(session_id).grid.ravel(), bitorder="little").tobytes()

    def render_voxels(self, session_id: str | None = None, *, max_voxels: int = 75_000) -> tuple[bytes, dict]:
        """Live voxels of a 3D grid as bytes z, y, x; an even sample where they are more than ``max_voxels``."""
        limit, session = whole(max_voxels, "max_voxels"), self.get(session_id)
        live = np.flatnonzero(session.grid)
        sampled = len(live) > limit
        shown = live[np.linspace(0, len(live) - 1, limit, dtype=np.int64)] if sampled else live
        places = np.stack(np.unravel_index(shown, session.grid.shape), axis=1).astype(np.uint8)
        about = dict(zip(("depth", "height", "width"), session.grid.shape, strict=True)) | {"generation": session.generation, "rendered_voxels": len(shown), "render_sampled": sampled, "render_limit": limit}
        return places.tobytes(), about

    def render_view(self, session_id: str | None = None, *, max_voxels: int = 75_000) -> dict:
        content, about = self.render_voxels(session_id, max_voxels=max_voxels)
        return self.payload(session_id) | about | {"voxels": np.frombuffer(content, np.uint8).reshape(-1, 3).tolist()}

    def slice(self, session_id: str | None = None, *, axis: str = "z", index: int = 0) -> dict:
        session = self.get(session_id)
        if axis not in ("z", "y", "x"):
            raise ValueError("axis must be x, y or z")
        number = "zyx".index(axis)
        if not 0 <= index < session.grid.shape[number]:
            raise ValueError("the slice index is outside the grid")
        plane = session.grid.take(index, number)
        return {"session_id": session.session_id, "axis": axis, "index": index, "height": plane.shape[0], "width": plane.shape[1], "alive": int(plane.sum()), "grid": plane.tolist()}

    def export_npz(self, session_id: str | None = None) -> tuple[bytes, int]:
        session = self.get(session_id)
        return state_to_npz_bytes(session.grid, session.rule, seed=session.seed, density=session.density, generation=session.generation), session.generation


def metric_payload(counts, generation: int, total: int) -> dict:
    alive, changed, births, deaths = map(int, counts)
    return {
        "generation": generation, "alive": alive, "alive_fraction": alive / total, "changed_cells": changed, "changed_fraction": changed / total,
        "births": births, "birth_fraction": births / total, "deaths": deaths, "death_fraction": deaths / total,
    }


def surviving_sessions(accesses: DataFrame, session: str, at: str, *, max_sessions: int = MAX_SESSIONS, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """The sessions of an access log that are alive at its last moment: ``session, last_access``, at most ``max_sessions``,
    none unused for ``ttl_seconds``; of equally old ones the smaller name stays.

    Last accesses are map-side maxima; the newest are a top-k, not a global sort.
    """
    last = accesses.where(F.col(at).isNotNull()).groupBy(F.col(session).alias("session")).agg(F.max(at).alias("last_access"))
    now = last.agg(F.max("last_access").alias("now"))
    young = last.join(F.broadcast(now)).where(F.timestamp_diff("MICROSECOND", F.col("last_access"), F.col("now")) < round(ttl_seconds * 1_000_000))
    return young.select("session", "last_access").orderBy(F.desc("last_access"), "session").limit(max_sessions)
