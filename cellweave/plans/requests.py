"""Registered queries of what surrounds the runs: files, admission, cell edits, sessions and the service, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import metrics as measures
from cellweave.functions import rules, seeds, workload
from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE, HIGHLIFE, Rule, parse_rule_3d
from cellweave.operators import grids, render, simulate
from cellweave.plans import benchmarks, experiments
from cellweave.plans import oracles as sql
from cellweave.sources import states
from cellweave.sources.shared import fresh_path, remove_at_exit, write_files
from cellweave.streaming import service
from cellweave.streaming.sessions import SessionStore, resolve_seed

SHAPE, RULE, SEED = sql.DIMS, {2: CONWAY, 3: DEFAULT_3D_RULE}, 42
OTHER = {2: HIGHLIFE, 3: parse_rule_3d("B5,6/S4,5")}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, oracle: str):
    def add(query):
        QUERIES[name], ORACLE_SQL[name] = query, oracle
        return query

    return add


def _vectors(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    return grids.grids_from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", F.col("embedding"), SHAPE[dims])


def _text(cells: str = "cells"):
    return F.array_join(F.transform(cells, lambda c: c.cast("string")), "").alias("cells")


def _written(spark: SparkSession, files: DataFrame, name: str) -> str:
    path = fresh_path(spark, name)
    write_files(files, path)
    remove_at_exit(spark, path)
    return path


def _number(path) -> F.Column:
    """The number in a file's name."""
    return F.regexp_extract(path, r"-(\d+)\.\w+$", 1).cast("long").alias("grid_id")


# Files: every embedding grid is written to a file of its own and read again.


def _files(dims: int) -> None:
    d = f"{dims}d"
    plain = f"SELECT grid_id, {sql.grid_text(dims)} FROM ({sql.vectors(dims)}) GROUP BY grid_id"

    for suffix in (".npy", ".npz"):

        @_register(f"grid_files_{suffix[1:]}_{d}", plain)
        def grid_files(spark, sf_dir, suffix=suffix):
            path = _written(spark, states.grid_files(_vectors(spark, sf_dir, dims), suffix, dims), "grids")
            return states.read_arrays(spark, path).select(_number("path"), _text())

    about = "grid_id AS seed, (grid_id % 10) / 10.0::DOUBLE AS density, (grid_id % 7)::BIGINT AS generation"
    size = ", ".join(f"{n}::BIGINT AS {a}" for a, n in zip(("depth", "height", "width"), grids.full_shape(SHAPE[dims]), strict=True))
    for suffix in (".json", ".npz"):

        @_register(f"state_files_{suffix[1:]}_{d}", f"SELECT *, {about}, {dims}::BIGINT AS dimensions, {size}, '{RULE[dims].text}' AS rule FROM ({plain})")
        def state_files(spark, sf_dir, suffix=suffix):
            held = _vectors(spark, sf_dir, dims).withColumns({"dimensions": F.lit(dims), "rule": F.lit(RULE[dims].text), "seed": F.col("grid_id"), "density": F.pmod("grid_id", F.lit(10)) / 10.0, "generation": F.pmod("grid_id", F.lit(7)).cast("int")})
            path = _written(spark, states.state_files(held, suffix, "grid_id"), "states")
            longs = [F.col(c).cast("long").alias(c) for c in ("dimensions", "depth", "height", "width", "generation")]
            return states.read_state_files(spark, path).select(_number("path"), _text(), "seed", "density", "rule", *longs)

    @_register(f"as_grid_{d}", f"SELECT vec_id AS grid_id, array_to_string(list_transform(embedding, lambda v: (trunc(v * 3) <> 0)::INT), '') AS cells FROM embeddings")
    def as_grid(spark, sf_dir):
        """Whole numbers read as cells: what is not zero is alive."""
        packed = _vectors(spark, sf_dir, dims)
        values = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("_id"), F.transform("embedding", lambda v: (v * F.lit(3).cast("float")).cast("tinyint")).alias("_v"))
        return grids.as_grids(packed.join(values, F.col("grid_id") == F.col("_id")).withColumn("cells", F.col("_v"))).select("grid_id", _text())

    n = 5 * 4 if dims == 2 else 3 * 5 * 4

    @_register(f"empty_grid_{d}", f"SELECT i AS grid_id, repeat('0', {n}) AS cells FROM range(7) r(i)")
    def empty(spark, sf_dir):
        return grids.empty_grids(spark, (5, 4) if dims == 2 else (3, 5, 4), 7).select("grid_id", _text())

    run = sql.run(sql.vectors(dims), RULE[dims], dims, SHAPE[dims], 5)
    shares = "alive / 64.0::DOUBLE AS alive_fraction, changed AS changed_cells, changed / 64.0::DOUBLE AS changed_fraction, births, births / 64.0::DOUBLE AS birth_fraction, deaths, deaths / 64.0::DOUBLE AS death_fraction"

    @_register(f"metric_payload_{d}", f"{run}, {sql.transitions(dims)} SELECT grid_id, gen AS generation, alive, {shares} FROM m")
    def payload(spark, sf_dir):
        runs = simulate.run_metrics(simulate.with_rule(_vectors(spark, sf_dir, dims), RULE[dims]), 5, dims).select("grid_id", "generation", "alive", "changed", "births", "deaths")
        out = measures.with_fractions(runs, F.lit(64))
        return out.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() == "int" else F.col(f.name) for f in out.schema])


# Sessions: each executor serves its grids as a service does, one session after the other.

SESSION_ROWS = "grid_id long, request string, generation long, alive long, changed_cells long, births long, deaths long, alive_fraction double, rule string, content string"


def _serve(dims: int):
    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = {2: SessionStore(2), 3: SessionStore(3)}
        served = service.Service(None, stores[2], stores[3])
        kinds = pa.schema([("grid_id", pa.int64()), ("request", pa.string()), *[(c, pa.int64()) for c in ("generation", "alive", "changed_cells", "births", "deaths")], ("alive_fraction", pa.float64()), ("rule", pa.string()), ("content", pa.string())])
        for batch in batches:
            rows = []
            for ident, cells in zip(batch.column("grid_id").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                name = f"s{ident}"

                def note(request, state, content="", ident=ident):
                    rows.append({"grid_id": ident, "request": request, "content": content} | {k: state[k] for k in kinds.names if k in state})

                stores[dims].create(SHAPE[dims], session_id=name, rule=RULE[dims], seed=ident)
                grid = [cells[i : i + 8] for i in range(0, 64, 8)] if dims == 2 else [[cells[z * 16 + y * 4 : z * 16 + y * 4 + 4] for y in range(4)] for z in range(4)]
                if dims == 2:
                    note("put", served.put_state(grid, name))
                else:
                    stores[3].set_state(grid, name)
                    note("put", served.state(3, name))
                content = served.render(dims, name)
                note("render", served.state(dims, name), (content if dims == 2 else content[0]).hex())
                state = served.step(dims, name, 3, collect_metrics=True)
                note("step", state, ",".join(str(m["changed_cells"]) for m in state["metrics"]))
                note("export", served.state(dims, name), str(sum(map(sum, served.export(2, name)["grid"])) if dims == 2 else int(states.state_from_npz_bytes(served.export(3, name)[0]).grid.sum())))
                note("reset", served.reset(dims, name))
                state = served.run_until_stable(dims, name, 24)
                note("until_stable", state, f"{state['steps_taken']} {str(state['settled']).lower()}")
                served.reset(dims, name)
                note("rule", served.rule(dims, OTHER[dims].text, name))
                note("step_other", served.step(dims, name, 1))
                if dims == 3:
                    served.reset(3, name)
                    note("slice", served.state(3, name), str(served.slice(name, "y", 2)["alive"]))
                    note("view", served.state(3, name), str(served.export_view(name, 5)["rendered_voxels"]))
                note("clear", served.clear(dims, name))
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return act


def _sessions(dims: int) -> None:
    axes = ", ".join(sql.AXES[dims])
    own, other = RULE[dims].text, OTHER[dims].text
    row = lambda request, source, rule=own, content="''", counts="alive, changed AS changed_cells, births, deaths", generation="gen": f"SELECT grid_id, '{request}' AS request, {generation} AS generation, {counts}, '{rule}' AS rule, {content} AS content FROM {source}"
    start, dead = "alive, 0 AS changed_cells, 0 AS births, 0 AS deaths", "0 AS alive, 0 AS changed_cells, 0 AS births, 0 AS deaths"
    if dims == 2:
        shown = f"(SELECT grid_id, sum(alive)::BIGINT AS alive, string_agg(byte, '' ORDER BY y) AS content FROM (SELECT grid_id, y, sum(alive) AS alive, lower(printf('%02x', sum(alive << x::INT)::INT)) AS byte FROM g GROUP BY grid_id, y) GROUP BY grid_id)"
    else:
        shown = "(SELECT grid_id, sum(alive)::BIGINT AS alive, coalesce(string_agg(printf('%02x%02x%02x', z::INT, y::INT, x::INT), '' ORDER BY z, y, x) FILTER (alive = 1), '') AS content FROM g GROUP BY grid_id)"
    parts = [
        row("put", "f", counts=start, generation="0"),
        row("render", "shown", counts=start, generation="0", content="content"),
        row("step", "m JOIN (SELECT grid_id, string_agg(changed::VARCHAR, ',' ORDER BY gen) AS content FROM m WHERE gen <= 3 GROUP BY grid_id) USING (grid_id) WHERE gen = 3", content="content"),
        row("export", "m WHERE gen = 3", content="alive::VARCHAR"),
        row("reset", "f", counts=start, generation="0"),
        row("until_stable", "e JOIN m USING (grid_id) WHERE gen = steps_taken", content="steps_taken::VARCHAR || ' ' || settled::VARCHAR"),
        row("rule", "f", other, counts=start, generation="0"),
        row("step_other", "second", other, generation="1"),
        row("clear", "f", other, counts=dead, generation="0"),
    ]
    if dims == 3:
        parts += [
            row("slice", "f JOIN (SELECT grid_id, sum(alive)::VARCHAR AS content FROM g WHERE y = 2 GROUP BY grid_id) USING (grid_id)", other, counts=start, generation="0", content="content"),
            row("view", "f", other, counts=start, generation="0", content="least(alive, 5)::VARCHAR"),
        ]
    after = f"SELECT grid_id, {axes}, {sql.successor(OTHER[dims], dims)} AS after, s // {sql.CENTRE[dims]} AS before FROM ({sql.sums('g', dims, SHAPE[dims], 'grid_id')})"
    oracle = f"""{sql.run(sql.vectors(dims), RULE[dims], dims, SHAPE[dims], 24)}, {sql.transitions(dims)},
      f AS (SELECT grid_id, sum(alive)::BIGINT AS alive FROM g GROUP BY grid_id), shown AS {shown},
      e AS (SELECT grid_id, coalesce(min(gen) FILTER (changed = 0), 24) AS steps_taken, count(*) FILTER (changed = 0) > 0 AS settled FROM m GROUP BY grid_id),
      second AS (SELECT grid_id, sum(after)::BIGINT AS alive, sum((after <> before)::INT)::BIGINT AS changed, sum((after > before)::INT)::BIGINT AS births, sum((after < before)::INT)::BIGINT AS deaths FROM ({after}) GROUP BY grid_id)
      SELECT grid_id, request, generation::BIGINT AS generation, alive::BIGINT AS alive, changed_cells::BIGINT AS changed_cells, births::BIGINT AS births, deaths::BIGINT AS deaths, alive / 64.0::DOUBLE AS alive_fraction, rule, content FROM ({' UNION ALL '.join(parts)})"""

    @_register(f"session_requests_{dims}d", oracle)
    def requests(spark, sf_dir):
        """The service's answers to a script of requests on every embedding grid."""
        return _vectors(spark, sf_dir, dims).select("grid_id", "cells").mapInArrow(_serve(dims), SESSION_ROWS)


for _dims in (2, 3):
    _files(_dims)
    _sessions(_dims)


# Admission: which arguments are taken.


def _accepted(spark: SparkSession, check: Callable, names: str, cases) -> DataFrame:
    def taken(case) -> bool:
        try:
            check(*case)
        except (ValueError, TypeError):
            return False
        return True

    return spark.createDataFrame([(*case, taken(case)) for case in cases], f"{names}, accepted boolean")


_SIZES = [-3, -1, 0, 1, 2, 7, 64]


@_register("accepts_dimensions", "SELECT d, h, w, d >= 1 AND h >= 1 AND w >= 1 AS accepted FROM (SELECT unnest([-3, -1, 0, 1, 2, 7, 64])::BIGINT AS d), (SELECT unnest([-3, -1, 0, 1, 2, 7, 64])::BIGINT AS h), (SELECT unnest([-3, -1, 0, 1, 2, 7, 64])::BIGINT AS w)")
def accepts_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, lambda d, h, w: grids.full_shape((d, h, w)), "d long, h long, w long", product(_SIZES, repeat=3))


@_register("accepts_density", "SELECT i / 10.0::DOUBLE AS density, i BETWEEN 0 AND 10 AS accepted FROM range(-5, 16) r(i)")
def accepts_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, seeds.check_density, "density double", [(i / 10,) for i in range(-5, 16)])


@_register("accepts_steps", "SELECT i AS steps, i >= 0 AS accepted, i >= 1 AS every_accepted FROM range(-4, 5) r(i)")
def accepts_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _accepted(spark, lambda n: workload.whole(n, "record_every"), "steps long", [(i,) for i in range(-4, 5)]).withColumnRenamed("accepted", "every_accepted")
    return _accepted(spark, lambda n: workload.whole(n, "steps", 0), "steps long", [(i,) for i in range(-4, 5)]).join(every, "steps")


@_register("accepts_masks", "SELECT dims, n, value, n = CASE dims WHEN 2 THEN 9 ELSE 27 END AND value IN (0, 1) AS accepted FROM (SELECT unnest([2, 3])::BIGINT AS dims), range(7, 29) r(n), (SELECT unnest([-1, 0, 1, 2])::BIGINT AS value)")
def accepts_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = lambda dims, n, value: rules.masks_to_rule([value] * n, [value] * n, dims)
    return _accepted(spark, check, "dims long, n long, value long", product((2, 3), range(7, 29), (-1, 0, 1, 2)))


@_register("accepts_rules", "SELECT dims, wanted, dims = wanted AS accepted FROM (SELECT unnest([2, 3])::BIGINT AS dims), (SELECT unnest([2, 3])::BIGINT AS wanted)")
def accepts_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = lambda dims, wanted: rules.validate_rule(Rule(*[(False,) * rules.COUNTS[dims]] * 2, dims=dims), wanted)
    return _accepted(spark, check, "dims long, wanted long", product((2, 3), repeat=2))


@_register(
    "accepts_requests",
    "SELECT name, value, value BETWEEN low AND high AS accepted FROM (VALUES ('size_2d', 8, 1024), ('size_3d', 8, 128), ('steps', 1, 100000), ('max_steps', 0, 100000), ('max_voxels', 1, 200000), ('rules', 1, 100), ('initial_conditions', 1, 100), ('sweep_size_2d', 8, 256), ('sweep_size_3d', 8, 96), ('sweep_steps', 1, 2000)) v(name, low, high), (SELECT unnest([-1, 0, 1, 7, 8, 96, 97, 100, 101, 128, 129, 256, 257, 1024, 1025, 2000, 2001, 100000, 100001, 200000, 200001])::BIGINT AS value)",
)
def accepts_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [-1, 0, 1, 7, 8, 96, 97, 100, 101, 128, 129, 256, 257, 1024, 1025, 2000, 2001, 100_000, 100_001, 200_000, 200_001]
    return _accepted(spark, service.within, "name string, value long", product(service.LIMITS, values))


@_register("accepts_workloads", "SELECT s_suppkey, dims, (s_suppkey % 60 + 8) * 20 AS steps, pow(s_suppkey % 89 + 8, dims) * ((s_suppkey % 60 + 8) * 20) * CASE dims WHEN 2 THEN 8 ELSE 26 END <= 100000000 AS interactive, pow(s_suppkey % 89 + 8, dims) * ((s_suppkey % 60 + 8) * 20) * (s_suppkey % 9 + 1) <= 100000000 AS sweep FROM supplier, (SELECT unnest([2, 3])::BIGINT AS dims)")
def accepts_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which interactive requests and sweeps are admitted: the driver's checks, over every supplier's numbers."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken(check, **request) -> bool:
            try:
                return bool(check(**request))
            except ValueError:
                return False

        for batch in batches:
            rows = []
            for key, dims in product(batch.column("s_suppkey").to_pylist(), (2, 3)):
                size, steps = key % 89 + 8, (key % 60 + 8) * 20
                rows.append({"s_suppkey": key, "dims": dims, "steps": steps, "interactive": taken(workload.validate_interactive_workload, dimensions=dims, cells=size**dims, steps=steps), "sweep": taken(workload.validate_sweep_workload, dimensions=dims, rules=key % 9 + 1, initial_conditions=1, size=size, steps=steps)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("s_suppkey", pa.int64()), ("dims", pa.int64()), ("steps", pa.int64()), ("interactive", pa.bool_()), ("sweep", pa.bool_())]))

    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").mapInArrow(judge, "s_suppkey long, dims long, steps long, interactive boolean, sweep boolean")


@_register("accepts_states", "SELECT * FROM (VALUES ('whole', true), ('no rule', false), ('no grid', false), ('wrong width', false), ('wrong depth', false), ('flat 3D', false), ('bad rule', false), ('3D', true)) v(state, accepted)")
def accepts_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which saved states are read: fields required, and those that must fit the grid."""
    whole, solid = {"rule": "B2/S3", "grid": [[0, 1], [1, 0]]}, {"dimensions": 3, "rule": "B4/S5,6", "grid": [[[0, 1]], [[1, 0]]]}
    cases = {
        "whole": whole, "no rule": {"grid": [[1]]}, "no grid": {"rule": "B2/S3"}, "wrong width": whole | {"width": 3}, "wrong depth": solid | {"depth": 1},
        "flat 3D": solid | {"grid": [[1]]}, "bad rule": whole | {"rule": "B9"}, "3D": solid | {"depth": 2, "width": 2},
    }
    return _accepted(spark, lambda state: states.dict_to_state(cases[state]), "state string", [(c,) for c in cases])


@_register("error_statuses", "SELECT * FROM (VALUES ('unknown session', 404), ('bad rule', 400), ('bad size', 400), ('too much work', 400), ('busy', 429), ('unknown slice', 400)) v(request, status)")
def error_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of requests that fail."""
    served = service.Service(None)

    def busy() -> None:
        raise service.Busy("a sweep is running")

    failing = {
        "unknown session": lambda: served.state(2, "nobody"), "bad rule": lambda: served.rule(2, "B3S23"), "bad size": lambda: served.create(2, (4, 4)),
        "too much work": lambda: served.step(3, steps=100_000), "busy": busy, "unknown slice": lambda: served.slice(axis="w"),
    }
    rows = []
    for name, request in failing.items():
        try:
            request()
        except Exception as problem:
            rows.append((name, service.status(problem)))
    return spark.createDataFrame(rows, "request string, status int")


@_register("resolved_seeds", "SELECT i::VARCHAR AS given, i AS seed FROM range(5) r(i) UNION ALL SELECT 'none', -1")
def resolved_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given seed stays; without one, some number of 32 bits comes (shown as -1)."""
    drawn = resolve_seed(None)
    return spark.createDataFrame([*((str(i), resolve_seed(i)) for i in range(5)), ("none", -1 if 0 <= drawn < 1 << 32 else 0)], "given string, seed long")


# Views and reports.

_edits = "SELECT l_orderkey % 500 AS grid_id, l_partkey % 10 AS y, l_suppkey % 10 AS x, min_by(CASE l_linenumber % 3 WHEN 0 THEN 'paint' WHEN 1 THEN 'erase' ELSE 'toggle' END, l_orderkey * 100 + l_linenumber) AS mode FROM lineitem GROUP BY ALL"


@_register("edit_cells", f"SELECT grid_id, {sql.grid_text(2)} FROM (SELECT g.grid_id, g.y, g.x, CASE mode WHEN 'paint' THEN 1 WHEN 'erase' THEN 0 WHEN 'toggle' THEN 1 - g.alive ELSE g.alive END AS alive FROM ({sql.vectors(2)}) g LEFT JOIN ({_edits}) e ON g.grid_id = e.grid_id AND g.y = e.y AND g.x = e.x) GROUP BY grid_id")
def edit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stroke of edits on every embedding grid, taken from line items; some lie outside the grids."""
    mode = F.element_at(F.array(F.lit("paint"), F.lit("erase"), F.lit("toggle")), F.pmod("l_linenumber", F.lit(3)) + 1)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edits = items.select(F.pmod("l_orderkey", F.lit(500)).alias("grid_id"), F.pmod("l_partkey", F.lit(10)).alias("y"), F.pmod("l_suppkey", F.lit(10)).alias("x"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("place"), mode.alias("mode"))
    return grids.edit_cells(_vectors(spark, sf_dir, 2), edits).select("grid_id", _text())


_swept = {"rules": 6, "initial_conditions": 3, "size": 8, "steps": 5, "density": 0.2, "seed": SEED}
_rows = sql.sweep_rows(2, sql.seeded(SEED, "sweep2", (8, 8), 0.2, 3), sql.rule_codes(SEED, 2, 6), (8, 8), 5)


@_register("browse", f"{_rows} SELECT rule, runs, row_number() OVER (ORDER BY final DESC, dimensions, rule) - 1 AS place FROM (SELECT dimensions, rule, count(*) AS runs, avg(final_alive_fraction) AS final FROM rows GROUP BY dimensions, rule) WHERE contains(lower(rule), 's1')")
def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that contain a text, and their places in the table ordered by the last live share."""
    found = experiments.browse(experiments.summary_by_rule(experiments.random_2d_experiment(spark, **_swept)[0]), "S1", "final", True)
    return found.coalesce(1).select("rule", "runs", F.monotonically_increasing_id().alias("place"))


@_register("sweep_csv", f"{_rows} SELECT rule, initial_condition, final_alive_fraction, fixed_point FROM rows")
def sweep_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep that reports each rule it is done with, written as quoted CSV and read again."""
    done = []
    rows, manifest = experiments.random_2d_experiment(spark, **_swept, progress=lambda n, of: done.append((n, of)))
    if done != [(i + 1, manifest["rules"]) for i in range(manifest["rules"])]:
        raise RuntimeError(f"progress was {done}")
    path = fresh_path(spark, "results")
    experiments.write_results(rows, path)
    remove_at_exit(spark, path)
    back = spark.read.option("header", True).csv(path)
    return back.select("rule", F.col("initial_condition").cast("long").alias("initial_condition"), F.col("final_alive_fraction").cast("double").alias("final_alive_fraction"), F.col("fixed_point").cast("boolean").alias("fixed_point"))


@_register("point_values", "SELECT event_id, greatest(0.0, least(1.0, coalesce(CASE WHEN event_id % 3 > 0 THEN value / 100 - 0.2 END, (event_id % 90) / 64.0::DOUBLE)))::DOUBLE AS shown FROM events")
def point_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of a chart: a share where there is one, else a count of 64 cells."""
    share = F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("value") / 100 - F.lit(0.2))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", measures.point_value(share, F.pmod("event_id", F.lit(90)), F.lit(64.0)).alias("shown"))


@_register("voxel_bytes", f"SELECT grid_id, coalesce(string_agg(printf('%02x%02x%02x', z::INT, y::INT, x::INT), '' ORDER BY z, y, x) FILTER (alive = 1), '') AS content FROM ({sql.vectors(3)}) GROUP BY grid_id")
def voxel_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.voxel_bytes(render.voxels(_vectors(spark, sf_dir, 3))).select("grid_id", F.lower(F.hex("content")).alias("content"))


@_register("rule_editor", f"SELECT p_partkey, p_partkey % 4 > 0 AS valid, CASE WHEN p_partkey % 4 > 0 THEN {sql.rule_text('k', 2)} END AS rule, CASE WHEN p_partkey % 4 > 0 THEN array_to_string(list_transform(range(9), lambda i: (k >> i::INT) & 1), '') END AS birth FROM (SELECT p_partkey, p_partkey * 7919 % 262144 AS k FROM part)")
def rule_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the editor shows for typed rules, every fourth of which is spoilt."""
    code = F.pmod(F.col("p_partkey") * 7919, F.lit(1 << 18).cast("long"))
    typed = F.concat(F.lit(" "), F.lower(rules.rule_text(code, 2)), F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.lit("9")).otherwise(F.lit(" ")))
    shown = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", rules.editor_state(typed, 2).alias("e"))
    return shown.select("p_partkey", "e.valid", "e.rule", F.array_join(F.col("e.birth").cast("array<string>"), "").alias("birth"))


@_register("playback_steps", "SELECT event_id, least(floor(value * 40), 2000)::BIGINT AS steps_2d, least(floor(value * 40), 800)::BIGINT AS steps_3d FROM events")
def playback_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    owed = F.col("value") * 40
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", workload.playback_steps(owed, 2).alias("steps_2d"), workload.playback_steps(owed, 3).alias("steps_3d"))


@_register("benchmark_sizes", "SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_concat(list_filter([16, 32, 48, 64, 96, 128, 160, 192, 256], lambda e: e <= most), list_filter(list_transform(range(1, 20), lambda i: 256 + 64 * i), lambda e: e <= most), [most]))), ',') AS sizes FROM (SELECT s_suppkey, s_suppkey * 37 % 700 + 1 AS most FROM supplier)")
def benchmark_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.pmod(F.col("s_suppkey") * 37, F.lit(700)) + 1
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.array_join(benchmarks.benchmark_edges(most).cast("array<string>"), ",").alias("sizes"))


@_register("benchmark_means", "SELECT user_id % 9 AS size, count(*) AS repeats, round(avg(value), 6) AS milliseconds FROM events GROUP BY user_id % 9")
def benchmark_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.pmod("user_id", F.lit(9)).alias("size"), F.col("value").alias("milliseconds"))
    return benchmarks.mean_times(runs, "size", "milliseconds").withColumn("milliseconds", F.round("milliseconds", 6))


@_register("compared_sessions", "SELECT 2::BIGINT AS dimensions, 4::BIGINT AS generation, '8x8' AS grid_shape UNION ALL SELECT 3, 4, '8x8x8'")
def compared_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2D and a 3D session, stepped side by side."""
    served = service.Service(None)
    served.create(2, (8, 8), session_id="a", seed=SEED)
    served.create(3, (8, 8, 8), session_id="b", seed=SEED)
    served.step_both("a", "b", 3)
    rows = [(s["dimensions"], s["generation"], "x".join(map(str, s["grid_shape"]))) for s in served.step_both("a", "b")]
    return spark.createDataFrame(rows, "dimensions long, generation long, grid_shape string")


@_register("service_limits", "SELECT 100000000::BIGINT AS max_cell_updates, 100000000::BIGINT AS max_interactive_cell_updates, 'ok' AS status")
def service_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = service.Service(spark)
    limits = served.sweep_limits()
    return spark.createDataFrame([(limits["max_cell_updates"], limits["max_interactive_cell_updates"], served.health()["status"])], "max_cell_updates long, max_interactive_cell_updates long, status string")


@_register("service_sweep", f"{sql.sweep_rows(2, sql.seeded(7, 'sweep2', (8, 8), 0.3, 2), sql.rule_codes(7, 2, 3), (8, 8), 4)} SELECT rule, initial_condition, final_alive_fraction, mean_changed_fraction FROM rows")
def service_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep by request, admitted and answered by the service."""
    rows = service.Service(spark).sweep(2, rules=3, initial_conditions=2, size=8, steps=4, density=0.3, seed=7)["rows"]
    return spark.createDataFrame([(r["rule"], r["initial_condition"], r["final_alive_fraction"], r["mean_changed_fraction"]) for r in rows], "rule string, initial_condition long, final_alive_fraction double, mean_changed_fraction double")
