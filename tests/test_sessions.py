import datetime
import time

import numpy as np
import pandas as pd
import pytest
from cellweave.functions.rules import CONWAY
from cellweave.operators.simulate import next_generation, rule_tables, transition
from cellweave.streaming import commands
from cellweave.streaming.commands import COMMANDS, session_stream
from cellweave.streaming.service import Service, within
from cellweave.streaming.sessions import SessionStore, seeded_grid, surviving_sessions


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_expiry_and_eviction():
    clock = Clock()
    store = SessionStore(2, max_sessions=2, ttl=10, clock=clock)
    for i, name in enumerate("abc"):
        clock.now = i
        store.create((8, 8), session_id=name)
    assert sorted(store.sessions) == ["b", "c"]
    clock.now = 5
    store.get("b")
    clock.now = 12
    assert store.count == 1
    with pytest.raises(KeyError):
        store.get("c")
    clock.now = 15
    assert store.count == 0


def test_actions():
    store = SessionStore(2)
    store.create((8, 8), session_id="s")
    full = np.ones((8, 8))
    store.set_state(full, "s")
    assert store.run_until_stable("s", max_steps=10) == (2, True)
    view = store.payload("s")
    assert (view["generation"], view["alive"], view["changed_cells"]) == (2, 0, 0)
    assert store.reset("s").grid.sum() == 64
    assert store.clear("s").grid.sum() == 0 and store.reset("s").grid.sum() == 64
    metrics = store.step("s", steps=2, collect_metrics=True)
    assert [m["deaths"] for m in metrics] == [64, 0] and [m["generation"] for m in metrics] == [1, 2]
    with pytest.raises(ValueError):
        store.set_state(np.ones((4, 4)), "s")
    a = store.randomize("s", seed=5, density=0.5).grid
    assert (a == store.randomize("s", seed=5).grid).all()
    assert store.random_rule("s").rule == store.random_rule("s").rule
    store.set_state(np.eye(8), "s")
    assert store.render_bits("s")[:2] == b"\x01\x02"


def test_3d_views():
    store = SessionStore(3)
    store.create((8, 8, 8), session_id="s", density=1.0, rule="B/S2,6")
    content, about = store.render_voxels("s", max_voxels=10)
    assert len(content) == 30 and about["render_sampled"]
    assert store.slice("s", axis="y", index=3)["alive"] == 64
    store.step("s")
    assert store.payload("s")["deaths"] == 512
    assert store.export_npz("s")[1] == 1


def test_service(spark):
    service = Service(spark)
    assert service.step(2, steps=3, collect_metrics=True)["metrics"][-1]["generation"] == 3
    assert service.state(3)["grid_shape"] == [32, 32, 32]
    with pytest.raises(ValueError):
        service.create(3, (129, 8, 8))
    with pytest.raises(ValueError):
        service.step(2, steps=100_000)
    with pytest.raises(KeyError):
        service.reset(2, "nobody")
    with pytest.raises(ValueError):
        within("rules", 101)
    assert len(service.sweep(2, rules=1, initial_conditions=2, size=8, steps=1)["rows"]) == 2


def test_surviving_sessions(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    log = spark.createDataFrame([("a", at(0)), ("a", at(95)), ("b", at(10)), ("c", at(99)), ("d", at(100)), ("e", None)], "user string, ts timestamp")
    alive = surviving_sessions(log, "user", "ts", max_sessions=2, ttl_seconds=50)
    assert [r["session"] for r in alive.collect()] == ["d", "c"]


def test_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("s", at(1), "create", "B3/S23", 8, 1, 1.0, None), ("s", at(2), "step", None, None, None, None, 2), ("t", at(3), "step", None, None, None, None, 1), ("s", at(4), "reset", None, None, None, None, None), ("s", at(5), "until_stable", None, None, None, None, 9)]
    spark.createDataFrame(rows, COMMANDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = session_stream(spark.readStream.schema(COMMANDS).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    got = {(r["session_id"], r["action"]): r for r in spark.table("answers").collect()}
    assert got["s", "create"]["alive"] == 64 and got["s", "step"]["alive"] == 0 and got["s", "step"]["generation"] == 2
    assert got["t", "step"]["error"] and got["s", "until_stable"]["generation"] == 2


@pytest.mark.parametrize("size", [1, 2, 3, 8, 9, 16, 67])
def test_bits_agree_with_stacks(size):
    random = np.random.default_rng(size)
    for code in (CONWAY.code, 0, (1 << 18) - 1, *(int(c) for c in random.integers(1 << 18, size=20))):
        grid = random.integers(0, 2, (1, 1, size, size)).astype(np.uint8)
        bits = commands._packed(grid.tobytes())
        assert commands._unpacked(bits, size) == grid.tobytes()
        for _ in range(4):
            grid, bits = next_generation(grid, rule_tables(np.array([code]), 2), 2), commands.next_bits(bits, size, code)
            assert commands._unpacked(bits, size) == grid.tobytes()


class _Group:
    """A new session's state."""

    exists = hasTimedOut = False

    def update(self, held):
        self.held = held

    def setTimeoutTimestamp(self, at):
        pass

    def getCurrentWatermarkMs(self):
        return 0


def test_commands_cost_less_than_stacked_generations():
    """A session's generations are the numpy kernel's, in less than half of its time (a tenth was measured)."""

    class Keyed:
        withWatermark = groupBy = lambda self, *_: self
        applyInPandasWithState = lambda self, serve, *_: serve

    steps, grid, tables = 2000, seeded_grid(5, (16, 16), 0.3).reshape(1, 1, 16, 16), rule_tables(np.array([CONWAY.code]), 2)
    at = pd.to_datetime(["2024-01-02", "2024-01-01"])
    asked = pd.DataFrame({"session_id": "s", "ts": at, "action": ["step", "create"], "rule": "B3/S23", "size": 16, "seed": 5, "density": 0.3, "steps": steps})
    state, start = _Group(), time.perf_counter()
    (told,) = session_stream(Keyed())(("s",), iter([asked]), state)
    taken, start = time.perf_counter() - start, time.perf_counter()
    for _ in range(steps):
        before, grid = grid, next_generation(grid, tables, 2)
        counts = transition(before, grid)[0]
    assert told["action"].tolist() == ["create", "step"] and told.iloc[1][["generation", "alive", "changed", "births", "deaths"]].tolist() == [steps, *counts]
    assert state.held[:3] == (16, CONWAY.code, steps) and state.held[3] == grid.tobytes()
    assert taken < (time.perf_counter() - start) / 2


def test_answers_of_errors(spark, tmp_path):
    """What fails has an error and no counts; the session stays as it was."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("s", at(1), "step", None, None, None, None, 1), ("s", at(2), "create", "B3/S23", 4, 1, 0.5, None), ("s", at(3), "create", "B3/S23", 8, 1, 1.0, None), ("s", at(4), "rule", "nothing", None, None, None, None), ("s", at(5), "fly", None, None, None, None, None), ("s", at(6), "step", None, None, None, None, None)]
    spark.createDataFrame(rows, COMMANDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = session_stream(spark.readStream.schema(COMMANDS).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("errors").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    got = [(r["generation"], r["alive"], r["deaths"], r["error"] is not None) for r in spark.table("errors").orderBy("ts").collect()]
    assert got == [(None, None, None, True), (None, None, None, True), (0, 64, 0, False), (0, None, None, True), (0, None, None, True), (1, 0, 64, False)]
