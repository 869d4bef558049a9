"""Registered queries over grids too large for a row, and over grids, rules and sweeps drawn from keys of a table; with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import checks, threefry
from cellweave.functions.rules import CONWAY, DEFAULT_3D_RULE, parse_rule, parse_rule_3d
from cellweave.operators import grids, keyed, large, tiles
from cellweave.plans import oracles as sql
from cellweave.plans.experiments import compare_requests, summary_by_rule, sweep_requests
from cellweave.sources.patterns import PATTERNS, get_pattern

STEPS, STABLE_STEPS, TORUS = 10, 24, (4096, 4096)
RULE = {2: CONWAY, 3: DEFAULT_3D_RULE}
#: Rules without births: every grid comes to rest.
DYING = {2: parse_rule("B/S23"), 3: parse_rule_3d("B/S9,10,11,12,13,14")}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, oracle: str):
    def add(query):
        QUERIES[name] = query
        ORACLE_SQL[name] = oracle
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("tinyint", "smallint", "int") else F.col(f.name) for f in df.schema])


def _line_items(spark: SparkSession, sf_dir: str, grid: str, **places: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return items.select(F.expr(grid).cast("long").alias("grid_id"), *[F.expr(p).cast("int").alias(a) for a, p in places.items()], F.lit(1).alias("alive"))


# Tiles.

_POINTS = {"y": f"l_orderkey % {TORUS[0]}", "x": f"(l_partkey * 31 + l_suppkey) % {TORUS[1]}"}
_points = f"SELECT DISTINCT 0 AS grid_id, {_POINTS['y']} AS y, {_POINTS['x']} AS x, 1 AS alive FROM lineitem"
_generations = ", ".join(f"g{i + 1} AS MATERIALIZED (SELECT grid_id, y, x, 1 AS alive FROM ({sql.sums(f'g{i}', 2, TORUS, 'grid_id')}) WHERE {sql.successor(CONWAY, 2)} = 1)" for i in range(STEPS))
_counted = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS generation, (SELECT count(*) FROM g{i}) AS alive, b + d AS changed, b AS births, d AS deaths FROM (SELECT (SELECT count(*) FROM g{i} ANTI JOIN g{i - 1} USING (y, x)) AS b, (SELECT count(*) FROM g{i - 1} ANTI JOIN g{i} USING (y, x)) AS d)" for i in range(1, STEPS + 1)
)


@_register("tiles_metrics_torus", f"WITH g0 AS MATERIALIZED ({_points}), o AS ({sql.offsets(2)}), {_generations} {_counted}")
def metrics_torus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition counts of ten generations of one large grid: two shuffles."""
    start = tiles.from_cells(_line_items(spark, sf_dir, "0", **_POINTS), TORUS)
    return _longs(large.run_metrics(start, CONWAY, TORUS, STEPS, halo=5)[1].drop("grid_id"))


# Seven grids of 128 x 128, three quarters dead: a line item is a live cell of its line number's grid.
_SEVEN = {"y": "l_orderkey % 128", "x": "(l_partkey * 31 + l_suppkey) % 128"}
_seven = f"""SELECT grid_id, y, x, (p.grid_id IS NOT NULL)::INT AS alive FROM (SELECT k AS grid_id, y, x FROM (SELECT DISTINCT l_linenumber AS k FROM lineitem), range(128) a(y), range(128) b(x))
  LEFT JOIN (SELECT DISTINCT l_linenumber AS grid_id, {_SEVEN['y']} AS y, {_SEVEN['x']} AS x FROM lineitem) p USING (grid_id, y, x)"""


def _seven_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.from_cells(_line_items(spark, sf_dir, "l_linenumber", **_SEVEN), (128, 128), 32)


def _stable(cells: str, dims: int, shape: tuple[int, ...]) -> str:
    return f"""{sql.run(cells, DYING[dims], dims, shape, STABLE_STEPS)}, {sql.transitions(dims)}, e AS (
      SELECT grid_id, coalesce(min(gen) FILTER (changed = 0), {STABLE_STEPS}) AS steps_taken, count(*) FILTER (changed = 0) > 0 AS settled FROM m GROUP BY grid_id)
      SELECT e.grid_id::BIGINT AS grid_id, steps_taken, settled, alive, changed, births, deaths FROM e JOIN m ON m.grid_id = e.grid_id AND m.gen = steps_taken"""


@_register("tiles_until_stable_torus", _stable(_seven, 2, (128, 128)))
def until_stable_torus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven grids until nothing changes; only tiles near a change are computed."""
    return _longs(large.run_until_stable(_seven_tiles(spark, sf_dir), DYING[2], (128, 128), STABLE_STEPS, 32, 4)[1])


def _embedded(dims: int) -> None:
    shape, d = sql.DIMS[dims], f"{dims}d"

    def start(spark, sf_dir):
        vectors = grids.grids_from_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", F.slice("embedding", 1, 64), shape)
        return tiles.from_cells(grids.to_cells(vectors, dims), shape, 3)

    live = f"WITH lived AS (SELECT DISTINCT grid_id FROM ({sql.vectors(dims)}) WHERE alive = 1) SELECT * FROM"

    @_register(f"tiles_metrics_{d}", f"{live} ({sql.run(sql.vectors(dims), RULE[dims], dims, shape, STEPS)}, {sql.transitions(dims)} SELECT grid_id, gen AS generation, alive, changed, births, deaths FROM m) WHERE grid_id IN (SELECT grid_id FROM lived)")
    def metrics(spark, sf_dir):
        return _longs(large.run_metrics(start(spark, sf_dir), RULE[dims], shape, STEPS, 3, STEPS // 2)[1])

    @_register(f"tiles_until_stable_{d}", f"{live} ({_stable(sql.vectors(dims), dims, shape)}) WHERE grid_id IN (SELECT grid_id FROM lived)")
    def until_stable(spark, sf_dir):
        return _longs(large.run_until_stable(start(spark, sf_dir), DYING[dims], shape, STABLE_STEPS, 3, 3)[1])


for _dims in (2, 3):
    _embedded(_dims)

_CUBE = {"z": "l_orderkey % 64", "y": "l_partkey % 64", "x": "(l_suppkey * 7 + l_linenumber) % 64"}
_cube = f"SELECT DISTINCT l_linenumber::BIGINT AS grid_id, {', '.join(f'{p} AS {a}' for a, p in _CUBE.items())} FROM lineitem"


@_register(
    "tiles_voxels_sampled",
    f"""WITH live AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY z, y, x) - 1 AS r, count(*) OVER (PARTITION BY grid_id) AS live FROM ({_cube})),
    picked AS (SELECT DISTINCT grid_id, i, CASE WHEN live <= 500 THEN i WHEN i = 499 THEN live - 1 ELSE floor(i * ((live - 1) / 499.0::DOUBLE))::BIGINT END AS r FROM live, range(500) q(i) WHERE i < live)
    SELECT grid_id, live, live > 500 AS sampled, i, z, y, x FROM picked JOIN live USING (grid_id, r)""",
)
def voxels_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even sample of 500 live voxels of each of seven cubes (the sample is the feature)."""
    start = tiles.from_cells(_line_items(spark, sf_dir, "l_linenumber", **_CUBE), (64, 64, 64), 32)
    return _longs(large.sample_live(start, (64, 64, 64), 500, 32))


_mode = "CASE o_orderkey % 3 WHEN 0 THEN 'paint' WHEN 1 THEN 'erase' ELSE 'toggle' END"


@_register(
    "tiles_edit_cells",
    f"""WITH g AS ({_seven}), e AS (SELECT grid_id, y, x, arg_min(mode, place) AS mode FROM (SELECT o_custkey % 7 + 1 AS grid_id, o_orderkey % 130 AS y, o_custkey * 31 % 130 AS x, o_orderkey AS place, {_mode} AS mode FROM orders) WHERE y < 128 AND x < 128 GROUP BY ALL)
    SELECT grid_id::BIGINT AS grid_id, y, x FROM (SELECT g.grid_id, g.y, g.x, CASE mode WHEN 'paint' THEN 1 WHEN 'erase' THEN 0 WHEN 'toggle' THEN 1 - g.alive ELSE g.alive END AS alive FROM g LEFT JOIN e ON g.grid_id = e.grid_id AND g.y = e.y AND g.x = e.x) WHERE alive = 1""",
)
def edit_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stroke of an edit for each order over seven grids; some lie outside."""
    edits = _table(spark, sf_dir, "orders").selectExpr("o_custkey % 7 + 1 AS grid_id", "o_orderkey % 130 AS y", "o_custkey * 31 % 130 AS x", "o_orderkey AS place", f"{_mode} AS mode")
    return _longs(tiles.to_cells(large.edit_cells(_seven_tiles(spark, sf_dir), edits, (128, 128), 32), (128, 128), 32))


_glider = ", ".join(f"({y}, {x}, {int(c == '#')})" for y, row in enumerate(PATTERNS["glider"].split("\n")) for x, c in enumerate(row))


@_register("tiles_place_pattern", f"SELECT g.grid_id::BIGINT AS grid_id, g.y, g.x FROM ({_seven}) g LEFT JOIN (VALUES {_glider}) p(y, x, alive) ON g.y = p.y + 31 AND g.x = p.x + 62 WHERE coalesce(p.alive, g.alive) = 1")
def place_on_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glider over the corner of four tiles of each of seven grids."""
    placed = large.place_pattern(_seven_tiles(spark, sf_dir), get_pattern(spark, "glider"), (128, 128), 31, 62, 32)
    return _longs(tiles.to_cells(placed, (128, 128), 32))


# Keys.


def _word_pair(source: str, a: str = "a", b: str = "b") -> str:
    """The words ``a`` and ``b`` of ``source``'s keys (k0, k1) and counters (c0, c1), round by round."""
    cut = lambda x: f"(({x}) & {threefry.WORD})"
    out = f"SELECT *, {cut('c0 + k0')} AS {a}, {cut('c1 + k1')} AS {b}, xor(xor(k0, k1), {threefry.PARITY}::BIGINT) AS k2 FROM ({source})"
    for i in range(threefry.ROUNDS):
        r, total = threefry.ROTATIONS[i % 8], cut(f"{a} + {b}")
        out = f"SELECT * REPLACE ({total} AS {a}, xor({cut(f'({b} << {r}) | ({b} >> {32 - r})')}, {total}) AS {b}) FROM ({out})"
        if i % 4 == 3:
            n = i // 4 + 1
            out = f"SELECT * REPLACE ({cut(f'{a} + k{n % 3}')} AS {a}, {cut(f'{b} + k{(n + 1) % 3} + {n}')} AS {b}) FROM ({out})"
    return f"SELECT * EXCLUDE (k2) FROM ({out})"


def _split(source: str, index: str) -> str:
    """``source`` with its keys replaced by the ones split off at an index."""
    return f"SELECT * EXCLUDE (k0, k1, a, b, c0, c1), a AS k0, b AS k1 FROM (SELECT * FROM ({_word_pair(f'SELECT *, 0::BIGINT AS c0, {index}::BIGINT AS c1 FROM ({source})')}))"


def _drawn(source: str, index: str, name: str) -> str:
    return f"SELECT * EXCLUDE (a, b, c0, c1), xor(a, b) AS {name} FROM ({_word_pair(f'SELECT *, 0::BIGINT AS c0, {index}::BIGINT AS c1 FROM ({source})')})"


def _code(source: str, dims: int) -> str:
    if dims == 2:
        return f"SELECT * EXCLUDE (low), low & 262143 AS code FROM ({_drawn(source, '0', 'low')})"
    return f"SELECT * EXCLUDE (low, high), low + (high & 4194303) * 4294967296 AS code FROM ({_drawn(_drawn(source, '0', 'low'), '1', 'high')})"


_seed = "({0} * 6364136223846793005 % 4611686018427387904)"


def _keys(table: str, ident: str, name: str) -> str:
    seed = _seed.format(f"{ident}::HUGEINT") + "::BIGINT"
    return f"SELECT {name}, seed >> 32 AS k0, seed & {threefry.WORD} AS k1 FROM (SELECT {ident} AS {name}, {seed} AS seed FROM {table})"


def _seeded(df: DataFrame, ident: str, name: str) -> DataFrame:
    seed: Column = F.expr(_seed.format(f"CAST({ident} AS DECIMAL(20,0))")).cast("long")
    return df.select(F.col(ident).alias(name), seed.alias("seed"))


def _place(shape: tuple[int, ...]) -> str:
    if len(shape) == 2:
        return f"i // {shape[1]} AS y, i % {shape[1]} AS x"
    return f"i // {shape[1] * shape[2]} AS z, (i // {shape[2]}) % {shape[1]} AS y, i % {shape[2]} AS x"


def _cells(source: str, shape: tuple[int, ...], density: float) -> str:
    """Cells of a grid for each key of ``source``, whose other columns stay."""
    n = 1
    for size in shape:
        n *= size
    return f"SELECT * EXCLUDE (k0, k1, word, i), {_place(shape)}, ((word >> 9) / 8388608.0::DOUBLE < {density}::DOUBLE)::INT AS alive FROM ({_drawn(f'SELECT * FROM ({source}), range({n}) r(i)', 'i', 'word')})"


def _keyed(dims: int) -> None:
    d = f"{dims}d"
    shape = {2: (6, 5), 3: (3, 4, 2)}[dims]

    @_register(f"random_grid_keyed_{d}", f"SELECT grid_id, {sql.grid_text(dims)} FROM ({_cells(_keys('part', 'p_partkey', 'grid_id'), shape, 0.3)}) GROUP BY grid_id")
    def random_grid(spark, sf_dir):
        """A random grid for each part, from its own key."""
        keyed_parts = _seeded(_table(spark, sf_dir, "part"), "p_partkey", "grid_id").select("grid_id", threefry.key_from_seed(F.col("seed")).alias("key"))
        drawn = keyed.random_grids(keyed_parts, "key", shape, 0.3)
        return drawn.select("grid_id", F.array_join(F.transform("cells", lambda c: c.cast("string")), "").alias("cells"))

    many_rules = f"SELECT * FROM ({_keys('part', 'p_partkey', 'p_partkey')}), range(2) r(rule_index)"

    @_register(f"random_rules_keyed_{d}", f"SELECT p_partkey, rule_index, code AS rule_id, {sql.rule_text('code', dims)} AS rule FROM ({_code(_split(many_rules, 'rule_index'), dims)})")
    def random_rules(spark, sf_dir):
        """Two random rules for each part, from keys split off its own."""
        keyed_parts = _seeded(_table(spark, sf_dir, "part"), "p_partkey", "p_partkey").select("p_partkey", threefry.key_from_seed(F.col("seed")).alias("key"))
        many = keyed.split_keys(keyed_parts, "key", 2, "rule_index", "own")
        return _longs(keyed.random_rules(many, "own", dims).select("p_partkey", "rule_index", "rule_id", "rule"))

    size, steps = {2: 6, 3: 4}[dims], 5
    asked = _keys("supplier", "s_suppkey", "request")
    codes = _code(_split(f"SELECT * FROM ({_split(asked, '0')}), range(2) r(rule_index)", "rule_index"), dims)
    started = _cells(_split(f"SELECT * FROM ({_split(asked, '1')}), range(3) r(grid_id)", "grid_id"), (size,) * dims, 0.3)
    keys = ", code, rule_index, request"
    total = size**dims

    @_register(
        f"sweep_keyed_{d}",
        f"""{sql.run(f"SELECT s.*, code, rule_index FROM ({started}) s JOIN ({codes}) c USING (request)", None, dims, (size,) * dims, steps, keys)}, {sql.transitions(dims, keys)}, f AS (
          SELECT grid_id{keys}, sum(alive) / {total}::DOUBLE AS first FROM g GROUP BY ALL)
        SELECT request, rule_index::BIGINT AS rule_index, code::BIGINT AS rule_id, {sql.rule_text("code", dims)} AS rule, grid_id::BIGINT AS initial_condition, first AS initial_alive_fraction, arg_max(alive, gen) / {total}::DOUBLE AS final_alive_fraction,
          sum(changed) / ({total}::DOUBLE * {steps}::DOUBLE) AS mean_changed_fraction, sum(births) / ({total}::DOUBLE * {steps}::DOUBLE) AS mean_birth_fraction, arg_max(changed, gen) = 0 AS fixed_point
        FROM m JOIN f USING (grid_id, code, rule_index, request) GROUP BY grid_id, code, rule_index, request, first""",
    )
    def sweep(spark, sf_dir):
        """A sweep of two rules over three grids for each supplier."""
        rows = sweep_requests(_seeded(_table(spark, sf_dir, "supplier"), "s_suppkey", "request"), dims, rules=2, initial_conditions=3, size=size, steps=steps, density=0.3)
        return _longs(rows.select("request", "rule_index", "rule_id", "rule", "initial_condition", "initial_alive_fraction", "final_alive_fraction", "mean_changed_fraction", "mean_birth_fraction", "fixed_point"))


    @_register(f"sweep_summary_keyed_{d}", f"SELECT {dims}::BIGINT AS dimensions, rule, count(*) AS runs, round(avg(final_alive_fraction), 9) AS final, round(avg(mean_changed_fraction), 9) AS changed, count(*) FILTER (fixed_point) AS fixed FROM ({ORACLE_SQL[f'sweep_keyed_{d}']}) GROUP BY rule")
    def summary(spark, sf_dir):
        """Means by rule over the sweeps of all suppliers."""
        rows = sweep_requests(_seeded(_table(spark, sf_dir, "supplier"), "s_suppkey", "request"), dims, rules=2, initial_conditions=3, size=size, steps=steps, density=0.3)
        return _longs(summary_by_rule(rows).withColumns({"final": F.round("final", 9), "changed": F.round("changed", 9)}))


for _dims in (2, 3):
    _keyed(_dims)


_sides = " UNION ALL ".join(f"SELECT {dims}::BIGINT AS dimensions, request, rule, rule_index, initial_condition, '{shape}' AS grid_shape, initial_alive_fraction, final_alive_fraction, mean_changed_fraction FROM ({ORACLE_SQL[f'sweep_keyed_{dims}d']})" for dims, shape in ((2, "6x6"), (3, "4x4x4")))


@_register("compare_keyed", _sides)
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dimensions side by side for every supplier."""
    asked = _seeded(_table(spark, sf_dir, "supplier"), "s_suppkey", "request")
    return _longs(compare_requests(asked, rules=2, initial_conditions=3, size_2d=6, size_3d=4, steps=5, density=0.3))


_asked = "p_partkey, p_partkey % 9 - 2 AS height, p_size - 3 AS width, p_partkey % 5 - 1 AS depth, p_retailprice / 1000 - 0.7 AS density, p_partkey % 7 - 2 AS steps, p_size % 4 - 1 AS every, p_partkey % 3 + 8 AS n, p_partkey % 2 + 26 AS n_3d, p_size % 3 AS most"


@_register(
    "checked_requests",
    f"SELECT p_partkey, height >= 1 AND width >= 1 AS shape_2d, depth >= 1 AND height >= 1 AND width >= 1 AS shape_3d, density BETWEEN 0 AND 1 AS density, steps >= 0 AS steps, every >= 1 AS every, n = 9 AND most <= 1 AS mask_2d, n_3d = 27 AND most <= 1 AS mask_3d FROM (SELECT {_asked} FROM part)",
)
def checked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is accepted of a request for each part: shapes, density, steps, recording and masks, as expressions."""
    asked = _table(spark, sf_dir, "part").selectExpr(*_asked.split(", "))
    mask = lambda n: F.transform(F.sequence(F.lit(1), F.col(n).cast("int")), lambda i: F.when(i == 4, F.col("most")).otherwise(i % 2))
    return asked.select(
        "p_partkey", checks.dimensions(F.col("height"), F.col("width")).alias("shape_2d"), checks.dimensions(F.col("depth"), F.col("height"), F.col("width")).alias("shape_3d"),
        checks.density(F.col("density")).alias("density"), checks.at_least(F.col("steps"), 0).alias("steps"), checks.at_least(F.col("every"), 1).alias("every"),
        checks.mask(mask("n"), 2).alias("mask_2d"), checks.mask(mask("n_3d"), 3).alias("mask_3d"),
    )
