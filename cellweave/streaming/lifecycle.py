"""Sessions of two and three dimensions as a stream with keyed state in RocksDB: created, changed, looked at and expired.

Commands are rows (``COMMANDS``); a session is a key.  Its grid, its first grid and what is known about it are value states, so a
command that leaves the first grid alone does not write it.  Every command is answered (``ANSWERS``).  A session without commands for
longer than the time to live is gone: the next command finds it so by event time, and a timer clears its state once the watermark
has passed, so neither answers nor what is stored depend on how rows fall into batches.  Within a batch a session's commands are taken in the
order of time and number; one older than the session's last is answered with an error, since that order is over.

A command's work is bounded (``service.LIMITS`` and the limit of an interactive request): no row can hold a task.  Random grids are
drawn by counter (``functions.threefry``), so a restart, or a task run again, gives the same answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cellweave.functions import threefry
from cellweave.functions.rules import parse_rule, parse_rule_3d
from cellweave.functions.seeds import check_density
from cellweave.functions.workload import validate_interactive_workload
from cellweave.operators.simulate import next_generation, rule_tables, transition
from cellweave.sources.shared import fresh_path, remove_at_exit
from cellweave.streaming.service import within
from cellweave.streaming.sessions import TTL_SECONDS

COMMANDS = "session_id string, ts timestamp, command_id long, action string, dims int, rule string, size int, seed long, density double, steps int"
ANSWERS = "session_id string, ts timestamp, command_id long, action string, dims int, generation int, alive long, changed long, births long, deaths long, settled boolean, error string"
ABOUT = "dims int, size int, code long, generation int, last_us long"
Answer = Row(*(field.split()[0] for field in ANSWERS.split(", ")))
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = ("create", "step", "until_stable", "clear", "reset", "rule", "randomize", "random_rule", "look")


class Held(NamedTuple):
    """A session between two commands; ``first`` is None where it is as stored."""

    dims: int
    size: int
    code: int
    generation: int
    grid: np.ndarray
    first: np.ndarray


def drawn_grid(seed: int, shape: tuple[int, ...], density: float) -> np.ndarray:
    """The grid that a seed's key draws."""
    key = np.array([(seed & (1 << 64) - 1) >> 32]), np.array([seed & threefry.WORD])
    return threefry.alive(*key, int(np.prod(shape)), density).astype(np.uint8).reshape(shape)


def drawn_rule(seed: int, dims: int) -> int:
    a, b = threefry.words((seed & (1 << 64) - 1) >> 32, seed & threefry.WORD, 0, np.arange(2))
    low, high = (int(x) for x in a ^ b)
    return low & (1 << 18) - 1 if dims == 2 else low | (high & (1 << 22) - 1) << 32


def _shape(dims: int, size: int) -> tuple[int, ...]:
    return (1, 1, size, size) if dims == 2 else (1, size, size, size)


def perform(held: Held | None, command: Row) -> tuple[Held, tuple[int, int, int, int], bool | None]:
    """A session after a command, the last transition's counts, and whether it settled (if that was asked)."""
    if command.action == "create":
        dims = command.dims
        if dims not in (2, 3):
            raise ValueError("dims must be 2 or 3")
        size = within(f"size_{dims}d", command.size)
        grid = drawn_grid(command.seed or 0, _shape(dims, size), check_density(command.density))
        held = Held(dims, size, (parse_rule if dims == 2 else parse_rule_3d)(command.rule).code, 0, grid, grid)
        return held, (int(grid.sum()), 0, 0, 0), None
    if held is None:
        raise KeyError("no such session")
    if command.action in ("step", "until_stable"):
        steps = within("steps" if command.action == "step" else "max_steps", 1 if command.steps is None else command.steps)
        validate_interactive_workload(dimensions=held.dims, cells=held.grid.size, steps=steps)
        grid, taken, settled, counts = held.grid, 0, False, (int(held.grid.sum()), 0, 0, 0)
        tables = rule_tables(np.array([held.code]), held.dims)
        while taken < steps and not settled:
            after = next_generation(grid, tables, held.dims)
            counts, grid, taken = tuple(map(int, transition(grid, after)[0])), after, taken + 1
            settled = command.action == "until_stable" and counts[1] == 0
        return held._replace(grid=grid, generation=held.generation + taken), counts, settled if command.action == "until_stable" else None
    if command.action == "rule":
        held = held._replace(code=(parse_rule if held.dims == 2 else parse_rule_3d)(command.rule).code)
    elif command.action == "random_rule":
        held = held._replace(code=drawn_rule(command.seed or 0, held.dims))
    elif command.action == "clear":
        held = held._replace(grid=np.zeros_like(held.grid), generation=0)
    elif command.action == "reset":
        held = held._replace(grid=held.first, generation=0)
    elif command.action == "randomize":
        grid = drawn_grid(command.seed or 0, held.grid.shape, check_density(command.density))
        held = held._replace(grid=grid, first=grid, generation=0)
    elif command.action != "look":
        raise ValueError("no such action")
    return held, (int(held.grid.sum()), 0, 0, 0), None


class SessionProcessor(StatefulProcessor):
    def __init__(self, ttl_seconds: float = TTL_SECONDS):
        if ttl_seconds <= 0:
            raise ValueError("ttl must be positive")
        self.ttl_us = int(ttl_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", ABOUT)
        self.cells = handle.getValueState("cells", "cells binary")
        self.first = handle.getValueState("first", "cells binary")

    def _load(self) -> tuple[Held | None, int | None]:
        if not self.about.exists():
            return None, None
        dims, size, code, generation, last = self.about.get()
        grid, first = (np.frombuffer(bytes(state.get()[0]), np.uint8) for state in (self.cells, self.first))
        shape = _shape(dims, size)
        unpack = lambda bits: np.unpackbits(bits, count=int(np.prod(shape))).reshape(shape)
        return Held(dims, size, code, generation, unpack(grid), unpack(first)), last

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, last = self._load()
        before = held
        # A batch's commands of one session, small rows, in the order of time; what they do is done one by one.
        for command in sorted(rows, key=lambda r: (r.ts, r.command_id)):
            now = int(command.ts.timestamp() * 1e6)
            counts, settled, error = (None,) * 4, None, None
            if last is not None and now < last:
                error = "late command"
            else:
                if last is not None and now - last > self.ttl_us:
                    held = None
                try:
                    held, counts, settled = perform(held, command)
                except KeyError as problem:
                    error = problem.args[0]
                except (ValueError, TypeError) as problem:
                    error = str(problem)
                last = now if held is not None else None
            told = held if error is None else None
            yield Answer(command.session_id, command.ts, command.command_id, command.action, told.dims if told else None, told.generation if told else None, *counts, settled, error)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self._clear()
            return
        self.about.update((held.dims, held.size, held.code, held.generation, last))
        if before is None or held.grid is not before.grid:
            self.cells.update((np.packbits(held.grid).tobytes(),))
        if before is None or held.first is not before.first:
            self.first.update((np.packbits(held.first).tobytes(),))
        self.handle.registerTimer((last + self.ttl_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._clear()
        return iter([])

    def _clear(self) -> None:
        for state in (self.about, self.cells, self.first):
            state.clear()

    def close(self) -> None:
        pass


def session_answers(commands: DataFrame, ttl_seconds: float = TTL_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Answers (``ANSWERS``) to a stream of commands (``COMMANDS``); those without a time or session have no order and are left out."""
    ready = commands.where("ts IS NOT NULL AND session_id IS NOT NULL").withWatermark("ts", lateness)
    return ready.groupBy("session_id").transformWithState(SessionProcessor(ttl_seconds), ANSWERS, "Append", "EventTime")


def answer_all(commands: DataFrame, target: str | None = None, ttl_seconds: float = TTL_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Run the stream over all that is there now and return all answers so far.

    With a ``target`` folder (answers and checkpoint) a later call goes on where the last one stopped, whatever became of it.
    """
    spark: SparkSession = commands.sparkSession
    path = target or fresh_path(spark, "sessions")
    setting = "spark.sql.streaming.stateStore.providerClass"
    known = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        writer = session_answers(commands, ttl_seconds, lateness).writeStream.format("parquet").option("path", f"{path}/answers").option("checkpointLocation", f"{path}/checkpoint")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if known is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, known)
    if target is None:
        remove_at_exit(spark, path)
    return spark.read.schema(ANSWERS).parquet(f"{path}/answers")
