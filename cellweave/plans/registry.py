"""The engine's registered queries over the standard tables, and their SQL oracles.

Embedding vectors serve as grids (8 x 8, or 4 x 4 x 4: positive is alive); line items, as points of one large sparse torus;
events, as an access log and as metric points; parts, as rule codes.  Counts come out as long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import metrics as measures
from cellweave.functions import workload
from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE, HIGHLIFE, Rule, parse_rule, parse_rule_3d, rule_code, rule_masks, rule_text
from cellweave.operators import cells, grids, native, render, simulate, tiles
from cellweave.plans import oracles as sql
from cellweave.plans.experiments import compare_dimensions, random_experiment, random_rules, summary_by_rule
from cellweave.sources import states
from cellweave.sources.patterns import PATTERNS, all_patterns, get_pattern
from cellweave.sources.shared import fresh_path, remove_at_exit
from cellweave.streaming.commands import ANSWERS, session_stream
from cellweave.streaming.sessions import surviving_sessions

STEPS, STABLE_STEPS, SEED, TORUS = 10, 24, 42, (4096, 4096)
SHAPE = sql.DIMS
RULE = {2: CONWAY, 3: DEFAULT_3D_RULE}
BORN_ON_NOTHING = parse_rule("B02/S1357")
CROSSED = {2: [CONWAY, HIGHLIFE, parse_rule("B2/S")], 3: [DEFAULT_3D_RULE, parse_rule_3d("B5,6/S4,5")]}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, oracle: str | None = None):
    def add(query):
        QUERIES[name] = query
        if oracle:
            ORACLE_SQL[name] = oracle
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    return grids.grids_from_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), SHAPE[dims])


def _relation(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    """The grids' cells, each grid in one task."""
    return grids.to_cells(cells.by_grid(_vectors(spark, sf_dir, dims), SHAPE[dims]), dims)


def _ruled(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    return simulate.with_rule(_vectors(spark, sf_dir, dims), RULE[dims])


def _longs(df: DataFrame) -> DataFrame:
    """Whole numbers as long."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("tinyint", "smallint", "int") else F.col(f.name) for f in df.schema])


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("cells", F.array_join(F.transform("cells", lambda c: c.cast("string")), ""))


def _run(dims: int, steps: int = STEPS) -> str:
    return sql.run(sql.vectors(dims), RULE[dims], dims, SHAPE[dims], steps)


@_register("flagship", f"{_run(2)}, {sql.transitions(2)} SELECT grid_id AS vec_id, alive, changed, births, deaths FROM m WHERE gen = {STEPS}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conway generations of every embedding grid, with the last transition's counts."""
    out = simulate.run_last_metrics(_ruled(spark, sf_dir, 2), STEPS)
    return _longs(out.select(F.col("grid_id").alias("vec_id"), "alive", "changed", "births", "deaths"))


def _per_dimension(dims: int) -> None:
    axes, shape, d = ", ".join(sql.AXES[dims]), SHAPE[dims], f"{dims}d"
    keys = ", ".join(f"{a}::BIGINT AS {a}" for a in sql.AXES[dims])

    @_register(f"grid_binarise_{d}", f"SELECT grid_id, {keys}, alive::BIGINT AS alive FROM ({sql.vectors(dims)})")
    def binarise(spark, sf_dir):
        return _longs(grids.to_cells(_vectors(spark, sf_dir, dims), dims))

    centre = sql.CENTRE[dims]

    @_register(f"neighbor_count_{d}", f"WITH g AS ({sql.vectors(dims)}), o AS ({sql.offsets(dims)}) SELECT grid_id, {axes}, s // {centre} AS alive, s % {centre} AS n FROM ({sql.sums('g', dims, shape, 'grid_id')})")
    def neighbours(spark, sf_dir):
        return _longs(cells.neighbour_counts(_relation(spark, sf_dir, dims), shape))

    @_register(f"neighbor_count_packed_{d}", f"WITH g AS ({sql.vectors(dims)}), o AS ({sql.offsets(dims)}) SELECT grid_id, string_agg((s % {centre})::VARCHAR, ',' ORDER BY {axes}) AS counts FROM ({sql.sums('g', dims, shape, 'grid_id')}) GROUP BY grid_id")
    def packed_neighbours(spark, sf_dir):
        out = simulate.neighbour_counts(_vectors(spark, sf_dir, dims), dims)
        return out.select("grid_id", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("counts"))

    one = sql.run(sql.vectors(dims), RULE[dims], dims, shape, 1)

    @_register(f"measurements_{d}", f"{one}, {sql.transitions(dims)}, f AS (SELECT grid_id, sum(alive)::BIGINT AS before FROM g GROUP BY grid_id) SELECT grid_id, before, before / 64.0::DOUBLE AS before_fraction, changed > 0 AS has_changed, alive, changed, births, deaths FROM m JOIN f USING (grid_id)")
    def measurements(spark, sf_dir):
        """Column measures of every grid and of its first transition."""
        first = _ruled(spark, sf_dir, dims).withColumn("before", F.col("cells"))
        pair = simulate.run_steps(first, 1, dims)
        counts = measures.transition_counts(F.col("before"), F.col("cells"))
        return _longs(pair.select("grid_id", measures.alive_count(F.col("before")).alias("before"), measures.alive_fraction(F.col("before")).alias("before_fraction"), measures.has_changed(F.col("before"), F.col("cells")).alias("has_changed"), counts.alias("t")).select("grid_id", "before", "before_fraction", "has_changed", "t.*"))

    @_register(f"cell_transitions_{d}", f"{one}, {sql.transitions(dims)} SELECT grid_id, alive, changed, births, deaths FROM m")
    def cell_transitions(spark, sf_dir):
        """The same counts from two cell relations that are joined by cell."""
        before = _relation(spark, sf_dir, dims)
        return _longs(measures.cell_counts(before, cells.step(before, RULE[dims], shape), ["grid_id", *sql.AXES[dims]]))

    @_register(f"repacked_{d}", f"SELECT grid_id, {sql.grid_text(dims)} FROM ({sql.vectors(dims)}) GROUP BY grid_id")
    def repacked(spark, sf_dir):
        """Packed grids to live cells and back."""
        live = grids.to_cells(_vectors(spark, sf_dir, dims), dims)
        return _text(grids.from_cells(live, shape).select("grid_id", "cells"))

    @_register(f"state_json_{d}", f"SELECT grid_id, '{RULE[dims].text}' AS rule, {sql.grid_text(dims)} FROM ({sql.vectors(dims)}) GROUP BY grid_id")
    def state_json(spark, sf_dir):
        """Every grid written as a JSON state and parsed again."""
        packed = _vectors(spark, sf_dir, dims)
        saved = states.state_json(packed.select("grid_id", F.lit(dims).alias("dimensions"), F.lit(RULE[dims].text).alias("rule"), "depth", "height", "width", F.lit(None).cast("long").alias("seed"), F.lit(None).cast("double").alias("density"), F.lit(0).alias("generation"), "cells"))
        nested = "array<" * dims + "tinyint" + ">" * dims
        parsed = saved.select("grid_id", F.from_json("json", f"rule string, grid {nested}").alias("s"))
        flat = F.flatten("s.grid") if dims == 2 else F.flatten(F.flatten("s.grid"))
        return _text(parsed.select("grid_id", "s.rule", flat.alias("cells")))

    @_register(f"run_steps_{d}", f"{_run(dims)} SELECT grid_id, {sql.grid_text(dims)} FROM t WHERE gen = {STEPS} GROUP BY grid_id")
    def run_steps(spark, sf_dir):
        return _text(simulate.run_steps(_ruled(spark, sf_dir, dims), STEPS, dims).select("grid_id", "cells"))

    @_register(f"run_steps_native_{d}", f"{_run(dims, 2)} SELECT grid_id, {sql.grid_text(dims)} FROM t WHERE gen = 2 GROUP BY grid_id")
    def run_native(spark, sf_dir):
        return _text(native.run_steps(_ruled(spark, sf_dir, dims), 2, dims).select("grid_id", "cells"))

    @_register(f"run_steps_cells_{d}", f"{_run(dims, 3)} SELECT grid_id, {keys}, alive::BIGINT AS alive FROM t WHERE gen = 3")
    def run_cells(spark, sf_dir):
        return _longs(cells.run(_relation(spark, sf_dir, dims), RULE[dims], shape, 3))

    @_register(f"run_tiles_{d}", f"{_run(dims)} SELECT grid_id, {keys} FROM t WHERE gen = {STEPS} AND alive = 1")
    def run_tiles(spark, sf_dir):
        start = tiles.from_cells(grids.to_cells(_vectors(spark, sf_dir, dims), dims), shape, 3)
        return _longs(tiles.to_cells(tiles.run(start, RULE[dims], shape, STEPS, 3, 4), shape, 3))

    @_register(f"metrics_{d}", f"{_run(dims)}, {sql.transitions(dims)} SELECT grid_id, gen AS generation, alive, changed, births, deaths FROM m")
    def metrics(spark, sf_dir):
        return _longs(simulate.run_metrics(_ruled(spark, sf_dir, dims), STEPS, dims).select("grid_id", "generation", "alive", "changed", "births", "deaths"))

    @_register(f"last_metrics_{d}", f"{_run(dims)}, {sql.transitions(dims)} SELECT m.*, {sql.grid_text(dims).replace(' AS cells', '')} AS cells FROM (SELECT grid_id, alive AS n_alive, changed, births, deaths FROM m WHERE gen = {STEPS}) m JOIN (SELECT * FROM t WHERE gen = {STEPS}) t USING (grid_id) GROUP BY ALL")
    def last_metrics(spark, sf_dir):
        out = simulate.run_last_metrics(_ruled(spark, sf_dir, dims), STEPS, dims)
        return _longs(_text(out.select("grid_id", F.col("alive").alias("n_alive"), "changed", "births", "deaths", "cells")))

    every = 1 if dims == 2 else 3

    @_register(f"trajectory_{d}" + ("" if every == 1 else f"_every_{every}"), f"{_run(dims)} SELECT grid_id, gen AS generation, {sql.grid_text(dims)} FROM t WHERE gen % {every} = 0 OR gen = {STEPS} GROUP BY grid_id, gen")
    def trajectory(spark, sf_dir):
        return _longs(_text(simulate.trajectory(_ruled(spark, sf_dir, dims), STEPS, dims, every).select("grid_id", "generation", "cells")))

    stable = f"""{_run(dims, STABLE_STEPS)}, {sql.transitions(dims)}, e AS (
      SELECT grid_id, coalesce(min(gen) FILTER (changed = 0), {STABLE_STEPS}) AS steps_taken, count(*) FILTER (changed = 0) > 0 AS settled FROM m GROUP BY grid_id)
      SELECT e.grid_id, steps_taken, settled, alive, changed, births, deaths FROM e JOIN m ON m.grid_id = e.grid_id AND m.gen = steps_taken"""

    @_register(f"until_stable_{d}", stable)
    def until_stable(spark, sf_dir):
        out = simulate.run_until_stable(_ruled(spark, sf_dir, dims), STABLE_STEPS, dims)
        return _longs(out.select("grid_id", "steps_taken", "settled", "alive", "changed", "births", "deaths"))

    codes = " UNION ALL ".join(f"SELECT {i} AS rule_index, {r.code} AS code" for i, r in enumerate(CROSSED[dims]))
    crossed = sql.run(f"SELECT * FROM ({sql.vectors(dims)}), ({codes})", None, dims, shape, 4, ", code, rule_index")

    @_register(f"rules_cross_grids_{d}", f"{crossed} SELECT rule_index::BIGINT AS rule_index, grid_id, {sql.grid_text(dims)} FROM t WHERE gen = 4 GROUP BY rule_index, grid_id")
    def cross(spark, sf_dir):
        both = simulate.with_rules(_vectors(spark, sf_dir, dims), CROSSED[dims], dims)
        return _longs(_text(simulate.run_steps(both, 4, dims).select("rule_index", "grid_id", "cells")))

    @_register(f"rule_trajectories_{d}", f"{crossed} SELECT rule_index::BIGINT AS rule_index, grid_id, gen AS generation, {sql.grid_text(dims)} FROM t GROUP BY rule_index, grid_id, gen")
    def rule_trajectories(spark, sf_dir):
        both = simulate.with_rules(_vectors(spark, sf_dir, dims), CROSSED[dims], dims)
        return _longs(_text(simulate.trajectory(both, 4, dims).select("rule_index", "grid_id", "generation", "cells")))

    bits = 2 * sql.COUNTS[dims]
    code = f"((p_partkey * 1234567891011) % {1 << bits})"
    flags = "array_to_string(list_transform(range({0}, {1}), lambda i: (({2} >> i::INT) & 1)::VARCHAR), '')"

    @_register(f"rule_roundtrip_{d}", f"SELECT p_partkey, {code} AS rule_id, {sql.rule_text(code, dims)} AS rule, {code} AS parsed, {flags.format(0, bits // 2, code)} AS birth, {flags.format(bits // 2, bits, code)} AS survival FROM part")
    def roundtrip(spark, sf_dir):
        part = _table(spark, sf_dir, "part").select("p_partkey", F.pmod(F.col("p_partkey") * F.lit(1234567891011), F.lit(1 << bits).cast("long")).alias("rule_id"))
        named = part.withColumn("rule", rule_text(F.col("rule_id"), dims))
        birth, survival = rule_masks(F.col("rule_id"), dims)
        return named.select("p_partkey", "rule_id", "rule", rule_code(F.col("rule"), dims).alias("parsed"), F.array_join(birth.cast("array<string>"), "").alias("birth"), F.array_join(survival.cast("array<string>"), "").alias("survival"))

    small = {2: (12, 10), 3: (5, 6, 4)}[dims]

    @_register(f"random_grid_{d}", f"SELECT grid_id, {sql.grid_text(dims)} FROM ({sql.seeded(SEED, 'grid', small, 0.3, 40)}) GROUP BY grid_id")
    def random_grid(spark, sf_dir):
        return _text(grids.random_grids(spark, SEED, small, 0.3, 40).select("grid_id", "cells"))

    @_register(f"random_rules_{d}", f"SELECT rule_index, code AS rule_id, {sql.rule_text('code', dims)} AS rule FROM ({sql.rule_codes(SEED, dims, 100)})")
    def rules(spark, sf_dir):
        return _longs(random_rules(spark, SEED, 100, dims))

    sweep_shape = (8,) * 2 if dims == 2 else (4,) * 3
    request = {"rules": 4, "initial_conditions": 3, "size": sweep_shape[0], "steps": 6, "density": 0.2, "seed": SEED}
    rows = sql.sweep_rows(dims, sql.seeded(SEED, f"sweep{dims}", sweep_shape, 0.2, 3), sql.rule_codes(SEED, dims, 4), sweep_shape, 6)
    ident = "rule_index AS rule_id" if dims == 2 else "code AS rule_id"

    @_register(f"sweep_{d}", f"{rows} SELECT * EXCLUDE (rule_index, code), {ident} FROM rows")
    def sweep(spark, sf_dir):
        return _longs(random_experiment(spark, dims, **request)[0])

    @_register(f"sweep_summary_{d}", f"{rows} SELECT dimensions, rule, count(*) AS runs, round(avg(final_alive_fraction), 9) AS final, round(avg(mean_changed_fraction), 9) AS changed, count(*) FILTER (fixed_point) AS fixed FROM rows GROUP BY dimensions, rule")
    def summary(spark, sf_dir):
        found = summary_by_rule(random_experiment(spark, dims, **request)[0])
        return _longs(found.withColumns({"final": F.round("final", 9), "changed": F.round("changed", 9)}))


for _dims in (2, 3):
    _per_dimension(_dims)


def _one_step(name: str, rule: Rule, dims: int) -> None:
    keys = ", ".join(f"{a}::BIGINT AS {a}" for a in sql.AXES[dims])

    @_register(name, f"WITH g AS ({sql.vectors(dims)}), o AS ({sql.offsets(dims)}) SELECT grid_id, {keys}, {sql.successor(rule, dims)}::BIGINT AS alive FROM ({sql.sums('g', dims, SHAPE[dims], 'grid_id')})")
    def one(spark, sf_dir):
        return _longs(cells.step(_relation(spark, sf_dir, dims), rule, SHAPE[dims]))


_one_step("step_conway", CONWAY, 2)
_one_step("step_highlife", HIGHLIFE, 2)
_one_step("step_b0", BORN_ON_NOTHING, 2)
_one_step("step_3d_default", DEFAULT_3D_RULE, 3)

_points = f"SELECT DISTINCT 0 AS grid_id, l_orderkey % {TORUS[0]} AS y, (l_partkey * 31 + l_suppkey) % {TORUS[1]} AS x, 1 AS alive FROM lineitem"


def _torus_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.pmod("l_orderkey", F.lit(TORUS[0])), F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey"), F.lit(TORUS[1]))
    return _table(spark, sf_dir, "lineitem").select(F.lit(0).alias("grid_id"), y.alias("y"), x.alias("x"), F.lit(1).alias("alive")).distinct()


@_register("step_sparse_torus", f"WITH g AS ({_points}), o AS ({sql.offsets(2)}) SELECT y, x FROM ({sql.sums('g', 2, TORUS, 'grid_id')}) WHERE {sql.successor(CONWAY, 2)} = 1")
def step_sparse_torus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation of one large grid that holds live cells only."""
    return _longs(cells.step(_torus_points(spark, sf_dir), CONWAY, TORUS, live_only=True).select("y", "x"))


_torus_steps = ", ".join(f"g{i + 1} AS (SELECT grid_id, y, x, 1 AS alive FROM ({sql.sums(f'g{i}', 2, TORUS, 'grid_id')}) WHERE {sql.successor(CONWAY, 2)} = 1)" for i in range(STEPS))


@_register("run_tiles_torus", f"WITH g0 AS ({_points}), o AS ({sql.offsets(2)}), {_torus_steps} SELECT y, x FROM g{STEPS}")
def run_tiles_torus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten generations of the large grid as tiles."""
    start = tiles.from_cells(_torus_points(spark, sf_dir), TORUS)
    return _longs(tiles.to_cells(tiles.run(start, CONWAY, TORUS, STEPS, halo=STEPS), TORUS).select("y", "x"))


_compared = {"rules": 1, "initial_conditions": 3, "size_2d": 8, "size_3d": 4, "steps": 5, "density": 0.2, "seed": SEED}


def _comparison(dims: int) -> str:
    shape = (8, 8) if dims == 2 else (4, 4, 4)
    rows = sql.sweep_rows(dims, sql.seeded(SEED, f"compare{dims}", shape, 0.2, 3), f"SELECT 0 AS rule_index, {RULE[dims].code} AS code", shape, 5)
    return f"SELECT * FROM ({rows} SELECT dimensions, rule, rule_index, initial_condition, '{'x'.join(map(str, shape))}' AS grid_shape, steps_executed AS steps, initial_alive_fraction, final_alive_fraction, mean_changed_fraction FROM rows)"


@_register("compare_dimensions", f"{_comparison(2)} UNION ALL {_comparison(3)}")
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(compare_dimensions(spark, **_compared)[0])


_glider = ", ".join(f"({y}, {x}, {int(c == '#')})" for y, row in enumerate(PATTERNS["glider"].split("\n")) for x, c in enumerate(row))


@_register("place_pattern", f"SELECT g.grid_id, string_agg(coalesce(p.alive, g.alive)::VARCHAR, '' ORDER BY g.y, g.x) AS cells FROM ({sql.vectors(2)}) g LEFT JOIN (VALUES {_glider}) p(y, x, alive) ON g.y = p.y + 2 AND g.x = p.x + 3 GROUP BY g.grid_id")
def place_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = grids.place_pattern(_vectors(spark, sf_dir, 2), get_pattern(spark, "Glider"), 2, 3)
    return _text(placed.select("grid_id", "cells"))


_named = ", ".join(f"('{name}', '{text}')" for name, text in sorted(PATTERNS.items()))


@_register("pattern_cells", f"SELECT name, y - 1 AS y, x - 1 AS x, (substr(line, x::INT, 1) = '#')::BIGINT AS alive FROM (SELECT name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS y FROM (VALUES {_named}) v(name, text)), range(1, 4) r(x) WHERE x <= length(line)")
def pattern_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(all_patterns(spark))


def _slice(axis: str, index: int) -> None:
    others = [a for a in sql.AXES[3] if a != axis]

    @_register(f"slice_{axis}", f"SELECT grid_id, 4::BIGINT AS height, 4::BIGINT AS width, sum(alive)::BIGINT AS alive, string_agg(alive::VARCHAR, '' ORDER BY {', '.join(others)}) AS cells FROM ({sql.vectors(3)}) WHERE {axis} = {index} GROUP BY grid_id")
    def plane(spark, sf_dir):
        return _longs(_text(grids.slice_grids(_vectors(spark, sf_dir, 3), axis, index)))


for _axis, _index in (("z", 1), ("y", 2), ("x", 3)):
    _slice(_axis, _index)


@_register("render_packbits", f"SELECT grid_id, string_agg(v::VARCHAR, ',' ORDER BY y) AS bytes FROM (SELECT grid_id, y, sum(alive << x::INT)::BIGINT AS v FROM ({sql.vectors(2)}) GROUP BY grid_id, y) GROUP BY grid_id")
def packbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = render.pack_bits(_vectors(spark, sf_dir, 2))
    return packed.select("grid_id", F.array_join(packed["bytes"].cast("array<string>"), ",").alias("bytes"))


_sampled = f"""
WITH live AS (SELECT grid_id, z, y, x, row_number() OVER (PARTITION BY grid_id ORDER BY z, y, x) - 1 AS r, count(*) OVER (PARTITION BY grid_id) AS n FROM ({sql.vectors(3)}) WHERE alive = 1),
picked AS (SELECT DISTINCT grid_id, i, CASE WHEN n <= 10 THEN i WHEN i = 9 THEN n - 1 ELSE floor(i * ((n - 1) / 9.0::DOUBLE))::BIGINT END AS r, n FROM live, range(64) q(i) WHERE i < least(n, 10))
SELECT grid_id, n AS live, n > 10 AS sampled, string_agg(z || '.' || y || '.' || x, ' ' ORDER BY i) AS voxels FROM picked JOIN live USING (grid_id, r, n) GROUP BY grid_id, n"""


@_register("render_voxels_sampled", _sampled)
def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even sample of ten live voxels a grid: the sample is the feature."""
    shown = render.voxels(_vectors(spark, sf_dir, 3), 10).where("live > 0")
    point = lambda v: F.concat_ws(".", v["z"].cast("string"), v["y"].cast("string"), v["x"].cast("string"))
    return _longs(shown.select("grid_id", "live", "sampled", F.array_join(F.transform("voxels", point), " ").alias("voxels")))


@_register("workload_estimate", "SELECT s_suppkey, (rules * conditions * size * size * steps)::BIGINT AS updates_2d, (rules * conditions * size * size * size * steps)::BIGINT AS updates_3d, (size * size * steps * 8)::BIGINT AS interactive_2d, (size * size * size * steps * 26)::BIGINT AS interactive_3d, rules * conditions * size * size * size * steps <= 100000000 AS admitted_3d FROM (SELECT s_suppkey, s_suppkey % 100 + 1 AS rules, s_suppkey % 7 + 1 AS conditions, s_suppkey % 89 + 8 AS size, s_suppkey % 50 AS steps FROM supplier)")
def workload_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    asked = _table(spark, sf_dir, "supplier").select("s_suppkey", (key % 100 + 1).alias("rules"), (key % 7 + 1).alias("conditions"), (key % 89 + 8).alias("size"), (key % 50).alias("steps"))
    each = F.col("rules") * F.col("conditions") * F.col("steps")
    size = F.col("size")
    return asked.select("s_suppkey", (each * size * size).alias("updates_2d"), (each * size * size * size).alias("updates_3d"), (size * size * F.col("steps") * workload.NEIGHBOURS[2]).alias("interactive_2d"), (size * size * size * F.col("steps") * workload.NEIGHBOURS[3]).alias("interactive_3d"), (each * size * size * size <= workload.MAX_SWEEP_CELL_UPDATES).alias("admitted_3d"))


@_register("session_prune", "WITH l AS (SELECT user_id AS session, max(ts) AS last_access FROM events GROUP BY user_id), n AS (SELECT max(last_access) AS now FROM l) SELECT session, epoch_us(last_access) AS last_us FROM (SELECT session, last_access FROM l, n WHERE epoch_us(now) - epoch_us(last_access) < 86400000000 * 30 ORDER BY last_access DESC, session LIMIT 256)")
def session_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the event log as sessions: unused ones expire, then the 256 latest stay (the limit is the feature)."""
    alive = surviving_sessions(_table(spark, sf_dir, "events"), "user_id", "ts", max_sessions=256, ttl_seconds=86400.0 * 30)
    return alive.select("session", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', last_access)").alias("last_us"))


@_register("metric_history", "WITH p AS (SELECT user_id % 5 AS session, event_id // 3 AS generation, event_id, value FROM events), newest AS (SELECT session, generation, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM p GROUP BY session, generation) SELECT session, generation, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY generation DESC) AS r FROM newest) WHERE r <= 180")
def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 180 metric points of each session (the limit is the feature)."""
    events = _table(spark, sf_dir, "events")
    points = events.select((F.col("user_id") % 5).alias("session"), F.floor(F.col("event_id") / 3).alias("generation"), "event_id", "value")
    return render.metric_history(points, "session", "generation", "event_id", 180)


@_register("packbits_roundtrip", f"SELECT grid_id, {sql.grid_text(2)} FROM ({sql.vectors(2)}) GROUP BY grid_id")
def packbits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(render.unpack_bits(render.pack_bits(_vectors(spark, sf_dir, 2))).select("grid_id", "cells"))


@_register("session_stream")
def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream of session commands, by user; the answers.  Stateful, so beyond SQL."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    action = F.element_at(F.array(*[F.lit(a) for a in ("create", "step", "step", "until_stable", "rule", "clear", "reset", "randomize")]), F.pmod("event_id", F.lit(8)).cast("int") + 1)
    commands = events.where("ts IS NOT NULL").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), F.lit("B3/S23").alias("rule"), F.lit(16).alias("size"),
        F.col("event_id").alias("seed"), F.lit(0.3).alias("density"), F.pmod("event_id", F.lit(5)).cast("int").alias("steps"),
    )
    target = fresh_path(spark, "stream")
    query = session_stream(commands).writeStream.format("parquet").option("path", f"{target}/answers").option("checkpointLocation", f"{target}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    remove_at_exit(spark, target)
    return spark.read.schema(ANSWERS).parquet(f"{target}/answers")


_texts = {
    2: ["B3678/S34678", " b1357 / s1357", "B/S012345678", "B4/S4567x", "B88/S", "B25", "3/23", "B-1/S2", "S23/B3", "B3/S23/", "B0/S9", "B36 /S 125", "b/s", "B 2/S"],
    3: ["B4/S4", " b5,7 / s6", "B14,19/S13", "B26/S0", "B 0 , 26 / S ", "B8,08/S1", "B12/S3,27", "B,5/S", "B5,/S6", "B5;6/S7", "B100/S1", "S4/B4", "B4/S4,4", "B9 9/S", "B/S"],
}


def _parse_query(dims: int) -> None:
    def expected(text: str) -> str:
        try:
            return str((parse_rule if dims == 2 else parse_rule_3d)(text).code)
        except ValueError:
            return "NULL"

    values = ", ".join(f"('{t}', {expected(t)}::BIGINT)" for t in _texts[dims])

    @_register(f"rule_parse_{dims}d", f"SELECT text, coalesce(rule_id, -1) AS rule_id FROM (VALUES {values}) v(text, rule_id)")
    def parse(spark, sf_dir):
        texts = spark.createDataFrame([(t,) for t in _texts[dims]], "text string")
        return texts.select("text", F.coalesce(rule_code(F.col("text"), dims), F.lit(-1).cast("long")).alias("rule_id"))


_parse_query(2)
_parse_query(3)
