import datetime
import random

import pytest
from cellweave.streaming import lifecycle
from pyspark.sql import Row

START = datetime.datetime(2024, 1, 1)
NAMES = [x.split()[0] for x in lifecycle.COMMANDS.split(", ")]


def command(session, second, number, action, dims=2, rule="B3/S23", size=8, seed=1, density=0.4, steps=2):
    return (session, START + datetime.timedelta(seconds=second), number, action, dims, rule, size, seed, density, steps)


def fold(rows, ttl):
    """The answers by a plain loop over each session's commands in order."""
    out, held, last = [], {}, {}
    for r in sorted((Row(*NAMES)(*r) for r in rows), key=lambda r: (r.session_id, r.ts, r.command_id)):
        s = r.session_id
        if s in last and (r.ts - last[s]).total_seconds() > ttl:
            held.pop(s, None)
        counts, error, settled = (None,) * 4, None, None
        try:
            held[s], counts, settled = lifecycle.perform(held.get(s), r)
        except KeyError as problem:
            error = problem.args[0]
        except (ValueError, TypeError) as problem:
            error = str(problem)
        last[s] = r.ts
        told = held.get(s) if error is None else None
        out.append((s, r.command_id, r.action, told.dims if told else None, told.generation if told else None, *counts, settled, error))
    return sorted(out, key=str)


def key(df):
    return sorted(((r["session_id"], *tuple(r)[2:]) for r in df.collect()), key=str)


def commands(seed, count, span):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        session = f"s{rng.randrange(5)}"
        dims = 3 if session in "s0s1" else 2
        action = rng.choice(["create", "step", "step", "until_stable", "clear", "reset", "rule", "randomize", "random_rule", "look", "odd"])
        rule = rng.choice(["B3/S23", "B36/S125", "no rule"]) if dims == 2 else rng.choice(["B6/S5,6,7", "B4/S4", "B33/S"])
        rows.append(command(session, rng.uniform(0, span), i, action, dims, rule, rng.choice([8, 9, 8, 2000]), i, rng.choice([0.2, 0.5, 1.5]), rng.choice([1, 3, None, 10**7])))
    return rows


def test_answers_are_the_fold(spark, tmp_path):
    rows = commands(3, 120, 3000)
    spark.createDataFrame(rows, lifecycle.COMMANDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = lifecycle.answer_all(spark.readStream.schema(lifecycle.COMMANDS).parquet(str(tmp_path / "in")), ttl_seconds=200)
    want = fold(rows, 200)
    assert key(got) == want
    assert {r[-1] for r in want} >= {None, "no such session", "no such action"} and any("limit" in (r[-1] or "") or "between" in (r[-1] or "") for r in want)


def test_restart_gives_the_same_answers(spark, tmp_path):
    """Three runs over files that come one after the other, on one checkpoint: state is taken up from the store; late commands are told so."""
    rows = sorted(commands(4, 90, 3000), key=lambda r: r[1])
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, lifecycle.COMMANDS).coalesce(1).write.mode("append").parquet(source)
        got = lifecycle.answer_all(spark.readStream.schema(lifecycle.COMMANDS).parquet(source), target, ttl_seconds=400, lateness="2 hours")
    assert key(got) == fold(rows, 400)
    for row in (command("s2", 2999, 998, "create"), command("s2", 0, 999, "look")):
        spark.createDataFrame([row], lifecycle.COMMANDS).coalesce(1).write.mode("append").parquet(source)
        got = lifecycle.answer_all(spark.readStream.schema(lifecycle.COMMANDS).parquet(source), target, ttl_seconds=400, lateness="2 hours")
    assert [r["error"] for r in got.where("command_id = 999").collect()] == ["late command"]


def test_timers_clear_the_state(spark, tmp_path):
    source = str(tmp_path / "in")
    first = [command(f"t{i}", i, i, "create") for i in range(20)]
    later = [command("x", 100_000 + i, 100 + i, "create") for i in range(2)] + [command("y", 200_000, 200, "create")]
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, lifecycle.ROCKSDB)
    try:
        held = []
        for part in (first, later):
            spark.createDataFrame(part, lifecycle.COMMANDS).coalesce(1).write.mode("append").parquet(source)
            stream = lifecycle.session_answers(spark.readStream.schema(lifecycle.COMMANDS).parquet(source), 60, "1 second")
            query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            held.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    finally:
        spark.conf.unset(setting)
    assert held[0] >= 60 and held[1] < 20


def test_bounds():
    row = lambda **x: Row(*NAMES)(*command("s", 0, 0, "create")).asDict() | x
    make = lambda **x: lifecycle.perform(None, Row(**row(**x)))
    for bad in ({"dims": 4}, {"size": 4}, {"size": 129, "dims": 3, "rule": "B4/S4"}, {"density": -0.1}, {"rule": "B9/S"}):
        with pytest.raises(ValueError):
            make(**bad)
    held, counts, _ = make(dims=3, size=16, rule="B4/S4", density=1.0)
    assert counts == (4096, 0, 0, 0)
    with pytest.raises(ValueError):
        lifecycle.perform(held, Row(**row(action="step", steps=1000)))
    with pytest.raises(KeyError):
        lifecycle.perform(None, Row(**row(action="look")))


def test_seeds_of_the_log_are_one_word(spark):
    """The query's seeds are words, as its SQL has them, where event numbers times a factor are longer."""
    from cellweave.plans.session_queries import _commands

    log = spark.sql("SELECT id AS event_id, 1L AS user_id, TIMESTAMP '2024-01-01' AS ts FROM VALUES (3L), (542367L), (5999999L) t(id)")
    assert [r["seed"] for r in _commands(log).orderBy("command_id").collect()] == [n * 7919 % (1 << 32) for n in (3, 542367, 5999999)]
