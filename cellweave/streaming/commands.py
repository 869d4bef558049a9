"""Many sessions as a stream: keyed state on the executors, expired by event time.

Commands are rows (session_id, ts, action, rule, size, seed, density, steps).  Actions: ``create`` (a 2D grid of size x
size), ``step``, ``until_stable``, ``clear``, ``reset``, ``rule``, ``randomize``; anything else, and actions on a session
that is not there, answer with an error.  A session without commands for the time to live is dropped when the
watermark passes it.

A session's commands come one after the other, so in a task its grid is one whole number, a bit a cell: a generation is a few dozen operations on
it, whatever the size.  The state keeps a byte a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellweave.functions.rules import parse_rule
from cellweave.streaming.service import within
from cellweave.streaming.sessions import TTL_SECONDS, seeded_grid

COMMANDS = "session_id string, ts timestamp, action string, rule string, size int, seed long, density double, steps int"
ANSWERS = "session_id string, ts timestamp, action string, generation int, alive int, changed int, births int, deaths int, error string"
STATE = "size int, code long, generation int, cells binary, first binary"


class Command(NamedTuple):
    action: str
    rule: str
    size: int
    seed: int
    density: float
    steps: int


@lru_cache(1024)
def _code(rule: str) -> int:
    return parse_rule(rule).code


def _packed(cells: bytes) -> int:
    return int.from_bytes(np.packbits(np.frombuffer(cells, np.uint8), bitorder="little").tobytes(), "little")


def _unpacked(grid: int, size: int) -> bytes:
    return np.unpackbits(np.frombuffer(grid.to_bytes((size * size + 7) // 8, "little"), np.uint8), count=size * size, bitorder="little").tobytes()


@lru_cache(64)
def _edges(size: int) -> tuple[int, int, int]:
    """All cells of a grid, those of its first column and those of its last."""
    everything = (1 << size * size) - 1
    first = everything // ((1 << size) - 1)
    return everything, first, first << size - 1


def _added(a: int, b: int, c: int) -> tuple[int, int]:
    """Sum and carry of three bits of each cell."""
    return a ^ b ^ c, a & b | c & (a | b)


def next_bits(grid: int, size: int, code: int) -> int:
    """The next generation of a square torus whose cell (y, x) is the bit y * size + x."""
    everything, first, last = _edges(size)
    left = (grid & ~last) << 1 | (grid & last) >> size - 1
    right = (grid & ~first) >> 1 | (grid & first) << size - 1
    up = lambda row: row >> size | row << size * (size - 1) & everything
    down = lambda row: row << size & everything | row >> size * (size - 1)
    low, high = _added(left, grid, right)
    ones, carry = _added(low, up(low), down(low))
    twos, fours = _added(high, up(high), down(high))
    over = twos & carry
    # The sum over a cell and its neighbours, from 0 to 9, and its bits' complements.
    bits = (ones, twos ^ carry, fours ^ over, fours & over)
    pairs = [(everything ^ bit, bit) for bit in bits]
    after, dead = 0, everything ^ grid
    for total in range(10):
        own = (dead if code >> total & 1 and total < 9 else 0) | (grid if total and code >> total + 8 & 1 else 0)
        if own:
            for at, pair in enumerate(pairs):
                own &= pair[total >> at & 1]
            after |= own
    return after


def _perform(held, command):
    """The session after a command, and the last transition's counts."""
    size, code, generation, grid, first = held
    births = deaths = 0
    steps = 1 if pd.isna(command.steps) else int(command.steps)
    if command.action in ("step", "until_stable"):
        for _ in range(max(0, steps)):
            before, grid, generation = grid, next_bits(grid, size, code), generation + 1
            births, deaths = grid & ~before, before & ~grid
            if command.action == "until_stable" and grid == before:
                break
    elif command.action == "rule":
        code = _code(command.rule)
    else:
        generation = 0
        if command.action == "clear":
            grid = 0
        elif command.action == "reset":
            grid = first
        else:
            grid = first = _packed(seeded_grid(int(command.seed), (size, size), float(command.density)))
    births, deaths = births.bit_count(), deaths.bit_count()
    return (size, code, generation, grid, first), (grid.bit_count(), births + deaths, births, deaths)


def session_stream(commands: DataFrame, ttl_seconds: float = TTL_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Answers (ANSWERS) to a stream of commands, in order of time within each session and batch."""

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = None
        if state.exists:
            size, code, generation, cells, first = state.get
            held = (size, code, generation, _packed(cells), _packed(first))
        rows, errors = [], []
        frame = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for command in map(Command, *(frame[c].tolist() for c in Command._fields)):
            error, counts = None, (None,) * 4
            try:
                if command.action == "create":
                    within("size_2d", int(command.size))
                    grid = _packed(seeded_grid(int(command.seed), (int(command.size),) * 2, float(command.density)))
                    held, counts = (int(command.size), _code(command.rule), 0, grid, grid), (grid.bit_count(), 0, 0, 0)
                elif held is None:
                    error = "no such session"
                elif command.action in ("step", "until_stable", "rule", "clear", "reset", "randomize"):
                    held, counts = _perform(held, command)
                else:
                    error = "no such action"
            except (ValueError, TypeError) as problem:
                error = str(problem)
            rows.append((held[2] if held else None, *counts))
            errors.append(error)
        if held is not None:
            state.update((*held[:3], _unpacked(held[3], held[0]), _unpacked(held[4], held[0])))
            newest = int(frame["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + int(ttl_seconds * 1000))
        # Numbers with a mask: taking None by None costs more than the commands.
        given = np.array([[n is not None for n in row] for row in rows]).T
        numbers = np.array([[n or 0 for n in row] for row in rows], np.int32).T
        told = {c: pd.arrays.IntegerArray(n, ~known) for c, n, known in zip(("generation", "alive", "changed", "births", "deaths"), numbers, given, strict=True)}
        yield pd.DataFrame({"session_id": key[0], "ts": frame["ts"].array, "action": frame["action"].array, **told, "error": np.array(errors, object)})

    keyed = commands.withWatermark("ts", lateness).groupBy("session_id")
    return keyed.applyInPandasWithState(serve, ANSWERS, STATE, "append", GroupStateTimeout.EventTimeTimeout)



