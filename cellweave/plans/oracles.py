"""SQL for DuckDB that states what the registered queries compute, written independently of the engine's plans."""

from __future__ import annotations

from cellweave.functions.rules import Rule

DIMS = {2: (8, 8), 3: (4, 4, 4)}
AXES = {2: ("y", "x"), 3: ("z", "y", "x")}
CENTRE = {2: 10, 3: 32}
COUNTS = {2: 9, 3: 27}


def vectors(dims: int) -> str:
    """Cells of the embedding grids: the sign of the first 64 numbers."""
    place = "i // 8 AS y, i % 8 AS x" if dims == 2 else "i // 16 AS z, (i // 4) % 4 AS y, i % 4 AS x"
    return f"SELECT vec_id AS grid_id, {place}, coalesce(embedding[i + 1] > 0, false)::INT AS alive FROM embeddings, range(64) r(i)"


def seeded(seed: int, stream: str, shape: tuple[int, ...], density: float, count: int) -> str:
    """Cells of the seeded random grids."""
    n = 1
    for size in shape:
        n *= size
    if len(shape) == 2:
        place = f"i // {shape[1]} AS y, i % {shape[1]} AS x"
    else:
        place = f"i // {shape[1] * shape[2]} AS z, (i // {shape[2]}) % {shape[1]} AS y, i % {shape[2]} AS x"
    return f"SELECT grid_id, {place}, ({word(seed, stream, 'grid_id', 'i')} / 4294967296.0::DOUBLE < {density}::DOUBLE)::INT AS alive FROM range({count}) g(grid_id), range({n}) r(i)"


def word(seed: int, stream: str, item: str, index: str) -> str:
    return f"('0x' || substr(md5('{seed}:{stream}:' || {item} || ':' || {index}), 1, 8))::BIGINT"


def offsets(dims: int) -> str:
    axes = AXES[dims]
    ranges = ", ".join(f"range(-1, 2) r{a}(d{a})" for a in axes)
    centre = " AND ".join(f"d{a} = 0" for a in axes)
    return f"SELECT *, CASE WHEN {centre} THEN {CENTRE[dims]} ELSE 1 END AS w FROM {ranges}"


def sums(source: str, dims: int, shape: tuple[int, ...], keys: str, where: str = "true") -> str:
    """Weighted neighbour sums: the centre weighs more than all neighbours."""
    axes = AXES[dims]
    places = [f"({a} + d{a} + {n}) % {n}" for a, n in zip(axes, shape, strict=True)]
    named = ", ".join(f"{p} AS {a}" for p, a in zip(places, axes, strict=True))
    return f"SELECT {keys}, {named}, sum(alive * w)::BIGINT AS s FROM {source}, o WHERE {where} GROUP BY {keys}, {', '.join(places)}"


def successor(rule: Rule | None, dims: int, code: str = "code") -> str:
    value = str(rule.code) if rule else code
    return f"(({value}::BIGINT >> (s % {CENTRE[dims]} + {COUNTS[dims]} * (s // {CENTRE[dims]}))::INT) & 1)::INT"


def run(cells: str, rule: Rule | None, dims: int, shape: tuple[int, ...], steps: int, extra: str = "") -> str:
    """Common tables up to ``t``: all generations of all cells.  ``extra`` names further key columns (a rule's code first)."""
    axes = ", ".join(AXES[dims])
    keys = f"gen, grid_id{extra}"
    return f"""WITH RECURSIVE g AS ({cells}), o AS ({offsets(dims)}), t AS (
      SELECT 0::BIGINT AS gen, grid_id{extra}, {axes}, alive FROM g
      UNION ALL
      SELECT gen + 1, grid_id{extra}, {axes}, {successor(rule, dims)} FROM ({sums("t", dims, shape, keys, f"gen < {steps}")})
    )"""


def grid_text(dims: int, keys: str = "grid_id") -> str:
    return f"string_agg(alive::VARCHAR, '' ORDER BY {', '.join(AXES[dims])}) AS cells"


def transitions(dims: int, extra: str = "") -> str:
    """Common table ``m``: transition counts of each generation after the first."""
    axes = ", ".join(AXES[dims])
    return f"""m AS (
      SELECT grid_id{extra}, gen, sum(alive)::BIGINT AS alive, sum((alive <> before)::INT)::BIGINT AS changed,
             sum((alive > before)::INT)::BIGINT AS births, sum((alive < before)::INT)::BIGINT AS deaths
      FROM (SELECT *, lag(alive) OVER (PARTITION BY grid_id{extra}, {axes} ORDER BY gen) AS before FROM t)
      WHERE gen > 0 GROUP BY grid_id{extra}, gen)"""


def rule_text(code: str, dims: int) -> str:
    n, joint = COUNTS[dims], "" if dims == 2 else ","
    part = lambda shift: f"coalesce(array_to_string(list_filter(range({n}), lambda c: (({code}) >> (c + {shift})::INT) & 1 = 1), '{joint}'), '')"
    return f"('B' || {part(0)} || '/S' || {part(n)})"


def sweep_rows(dims: int, cells: str, codes: str, shape: tuple[int, ...], steps: int) -> str:
    """Common tables up to ``rows`` of a sweep over grids ``cells`` and rules (rule_index, code) ``codes``."""
    total = 1
    for size in shape:
        total *= size
    crossed = f"SELECT * FROM ({cells}), ({codes})"
    return f"""{run(crossed, None, dims, shape, steps, ", code, rule_index")}, {transitions(dims, ", code, rule_index")}, f AS (
      SELECT grid_id, code, rule_index, sum(alive) / {total}::DOUBLE AS first FROM g GROUP BY ALL
    ), rows AS (
      SELECT {dims}::BIGINT AS dimensions, {rule_text("code", dims)} AS rule, rule_index::BIGINT AS rule_index, code::BIGINT AS code, grid_id::BIGINT AS initial_condition,
             {steps}::BIGINT AS steps_executed, first AS initial_alive_fraction, arg_max(alive, gen) / {total}::DOUBLE AS final_alive_fraction,
             arg_max(changed, gen) / {total}::DOUBLE AS final_changed_fraction, sum(changed) / ({total}::DOUBLE * {steps}::DOUBLE) AS mean_changed_fraction,
             sum(births) / ({total}::DOUBLE * {steps}::DOUBLE) AS mean_birth_fraction, sum(deaths) / ({total}::DOUBLE * {steps}::DOUBLE) AS mean_death_fraction,
             arg_max(changed, gen) = 0 AS fixed_point
      FROM m JOIN f USING (grid_id, code, rule_index) GROUP BY grid_id, code, rule_index, first
    )"""


def rule_codes(seed: int, dims: int, count: int, stream: str = "rule") -> str:
    low = word(seed, f"{stream}{dims}", "rule_index", "'0'")
    code = f"{low} & 262143" if dims == 2 else f"{low} + ({word(seed, f'{stream}{dims}', 'rule_index', chr(39) + '1' + chr(39))} & 4194303) * 4294967296"
    return f"SELECT rule_index, {code} AS code FROM range({count}) r(rule_index)"
