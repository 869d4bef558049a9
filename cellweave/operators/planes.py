"""2D grids as bit planes: a row of cells is the bits of one long (cell x is bit x), so a grid of any height is an array of longs.

A generation adds the eight neighbours of all cells of a row at once: shifted words go through carry-save adders, whose bits select
the rule's counts.  Everything is SQL text made of built-in functions, so it runs without Python, in any number of
generations from one expression (a fold), as SQL functions (``register``), or with every generation kept (``recursive_run``).  Rows
have at most ``WIDEST`` cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.workload import whole

WIDEST = 62
#: Lines of cells that a row of ``recursive_run`` holds at once.
HELD = 1 << 14


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _majority(a: str, b: str, c: str) -> str:
    return f"(({a} & {b}) | ({c} & ({a} ^ {b})))"


def terms_sql(code: str) -> str:
    """The counts under which a rule's cells live, as masks: ``x0`` to ``x3`` turn a count's bits to ones, ``b`` is birth and ``s`` survival."""
    wanted = lambda bit: f"0L - (shiftright(coded, {bit}) & 1L)"
    every = [f"named_struct({', '.join(f"'x{k}', {0 if n >> k & 1 else -1}L" for k in range(4))}, 'b', {wanted(n)}, 's', {wanted(9 + n)})" for n in range(9)]
    return _let(code, "coded", f"CASE WHEN coded IS NOT NULL THEN filter(array({', '.join(every)}), t -> t.b <> 0L OR t.s <> 0L) END")


def step_sql(rows: str, width: str, terms: str) -> str:
    """The rows one generation on.  ``width`` is an int, ``terms`` the rule's (``terms_sql``)."""
    mask = f"(shiftleft(1L, {width}) - 1L)"
    west, east = f"(((shiftleft(r, 1)) | shiftright(r, {width} - 1)) & {mask})", f"(shiftright(r, 1) | shiftleft(r & 1L, {width} - 1))"
    # Of each row the sum of its two side cells (bits s2, c2), and of all three (s, c).
    sides = f"transform({rows}, r -> named_struct('m', r, 's', {west} ^ {east}, 'c', {west} & {east}))"
    threes = f"transform({sides}, q -> named_struct('m', q.m, 's2', q.s, 'c2', q.c, 's', q.s ^ q.m, 'c', q.c | (q.m & q.s)))"
    up, down = "element_at(h, 1 + pmod(i - 1, size(h)))", "element_at(h, 1 + pmod(i + 1, size(h)))"
    ones, twos = ("u.s", "q.s2", "d.s"), ("u.c", "q.c2", "d.c")
    added = f"named_struct('m', q.m, 'b0', {' ^ '.join(ones)}, 'k', {_majority(*ones)}, 't', {' ^ '.join(twos)}, 'f', {_majority(*twos)})"
    sums = _let(threes, "h", f"transform(h, (q, i) -> {_let(up, 'u', _let(down, 'd', added))})")
    bits = f"transform({sums}, v -> named_struct('m', v.m, 'b0', v.b0, 'b1', v.t ^ v.k, 'b2', v.f ^ (v.t & v.k), 'b3', v.f & v.t & v.k))"
    same = " & ".join(f"(v.b{k} ^ t.x{k})" for k in range(4))
    return f"transform({bits}, v -> aggregate({terms}, 0L, (a, t) -> a | ({same} & ((t.b & ~v.m) | (t.s & v.m)))) & {mask})"


def run_sql(rows: str, width: str, code: str, steps: str) -> str:
    """The rows ``steps`` generations on: one expression, whatever the number."""
    folded = _let(terms_sql(code), "terms", f"aggregate(sequence(1, {steps}), {rows}, (g, unused) -> {step_sql('g', width, 'terms')})")
    return f"CASE WHEN {steps} <= 0 THEN {rows} ELSE {folded} END"


def pack_sql(cells: str, height: str, width: str) -> str:
    line = f"aggregate(transform(sequence(0, {width} - 1), x -> shiftleft(CAST(get(given, y * {width} + x) <> 0 AS BIGINT), x)), 0L, (a, b) -> a | b)"
    return _let(cells, "given", f"transform(sequence(0, {height} - 1), y -> {line})")


def unpack_sql(rows: str, width: str) -> str:
    return _let(rows, "given", f"transform(sequence(0, size(given) * {width} - 1), i -> CAST(shiftright(get(given, i div {width}), pmod(i, {width})) & 1L AS TINYINT))")


def alive_sql(rows: str) -> str:
    return f"aggregate({rows}, 0L, (a, r) -> a + bit_count(r))"


def _code_sql(text: str, dims: int) -> str:
    """The code of a rule's text, null where it is none, as ``functions.rules`` reads it."""
    blank = r"[\\t-\\r ]"
    counts = "[0-8]*" if dims == 2 else r"[0-9, \\t]*?"
    pattern = f"^{blank}*[Bb]({counts}){blank}*/{blank}*[Ss]({counts}){blank}*$"
    n = 9 if dims == 2 else 27
    parts = "filter(split(s, ''), x -> x <> '')" if dims == 2 else "CASE WHEN trim(s) = '' THEN array() ELSE transform(split(s, ','), x -> trim(BOTH ' \\t' FROM x)) END"
    valid = "size(array_distinct(c)) = size(c) AND forall(c, i -> coalesce(i < {n}, false))".format(n=n)
    if dims == 3:
        valid += " AND (contains(s, ',') OR length(s) <= 2) AND forall(p, x -> x RLIKE '^[0-9]+$')"
    total = f"CASE WHEN {valid} THEN aggregate(c, 0L, (a, i) -> a + shiftleft(1L, i)) END"
    read = _let(parts, "p", _let("transform(p, x -> try_cast(x AS INT))", "c", total))
    codes = f"transform(array(regexp_extract(t, '{pattern}', 1), regexp_extract(t, '{pattern}', 2)), s -> {read})"
    both = _let(codes, "k", f"k[0] + shiftleft(k[1], {n})")
    return _let(text, "t", f"CASE WHEN t RLIKE '{pattern}' THEN {both} END")


def _text_sql(code: str, dims: int) -> str:
    n, joint = (9, "") if dims == 2 else (27, ",")
    part = lambda shift: f"array_join(transform(filter(sequence(0, {n - 1}), i -> (shiftright(coded, i + {shift}) & 1L) = 1L), i -> CAST(i AS STRING)), '{joint}')"
    return _let(code, "coded", f"concat('B', {part(0)}, '/S', {part(n)})")


#: The SQL functions by name: parameters, result and body.
FUNCTIONS = {
    "ca_rule_code": ("text STRING", "BIGINT", _code_sql("text", 2)),
    "ca_rule_code_3d": ("text STRING", "BIGINT", _code_sql("text", 3)),
    "ca_rule_text": ("code BIGINT", "STRING", _text_sql("code", 2)),
    "ca_rule_text_3d": ("code BIGINT", "STRING", _text_sql("code", 3)),
    "ca_pack": ("cells ARRAY<TINYINT>, height INT, width INT", "ARRAY<BIGINT>", pack_sql("cells", "height", "width")),
    "ca_unpack": ("grid ARRAY<BIGINT>, width INT", "ARRAY<TINYINT>", unpack_sql("grid", "width")),
    "ca_step": ("grid ARRAY<BIGINT>, width INT, code BIGINT", "ARRAY<BIGINT>", _let(terms_sql("code"), "terms", step_sql("grid", "width", "terms"))),
    "ca_run": ("grid ARRAY<BIGINT>, width INT, code BIGINT, steps INT", "ARRAY<BIGINT>", run_sql("grid", "width", "code", "steps")),
    "ca_alive": ("grid ARRAY<BIGINT>", "BIGINT", alive_sql("grid")),
}
#: Table functions, for use behind ``LATERAL``; Spark wants their arguments computed before, not by SQL functions in place.  A body is one
#: generator from one row: Spark then spreads the outer rows as they are, where other bodies are joined back by the distinct grids, computed anew.
_CELLS = "transform(ca_cells.grid, (line, i) -> transform(sequence(0, ca_cells.width - 1), j -> named_struct('y', i, 'x', j, 'alive', CAST(shiftright(line, j) & 1L AS INT))))"
TABLES = {"ca_cells": ("grid ARRAY<BIGINT>, width INT", "y INT, x INT, alive INT", f"SELECT * FROM inline(flatten({_CELLS}))")}


def register(spark: SparkSession) -> None:
    """Make the engine usable from SQL text: temporary functions for rules, bit planes, generations and cells."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    for name, (takes, gives, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")


def _fits(grids: DataFrame) -> DataFrame:
    return grids.withColumn("width", F.when(F.col("width") <= WIDEST, F.col("width")).otherwise(F.raise_error(F.format_string(f"rows of %d cells are over {WIDEST}", F.col("width")))))


def to_planes(grids: DataFrame) -> DataFrame:
    """2D packed grids with ``planes`` in place of ``cells``."""
    return _fits(grids).withColumn("planes", F.expr(pack_sql("cells", "height", "width"))).drop("cells")


def from_planes(grids: DataFrame) -> DataFrame:
    return grids.withColumn("cells", F.expr(unpack_sql("planes", "width"))).drop("planes")


def run_steps(grids: DataFrame, steps: int) -> DataFrame:
    """As ``simulate.run_steps`` of 2D grids with ``rule_id``, without Python."""
    after = to_planes(grids).withColumn("planes", F.expr(run_sql("planes", "width", "rule_id", str(whole(steps, "steps", 0)))))
    return from_planes(after).select(*grids.columns)


def _states_sql(steps: str, after: str) -> str:
    """The column ``planes`` and what ``after`` makes of it (the last of ``h0``), ``steps`` times: an array of grids."""
    return f"CASE WHEN {steps} <= 0 THEN array(planes) ELSE {_let(terms_sql('rule_id'), 'terms', f"aggregate(sequence(1, {steps}), array(planes), (h0, unused) -> concat(h0, array({after})))")} END"


def recursive_run(grids: DataFrame, steps: int) -> DataFrame:
    """All generations 0 to ``steps`` of 2D grids (``grid_id, generation, planes, width``), each made of the one before.

    Two nested folds a row: the first generation of every block of generations, then a block's own, so a row holds about
    ``HELD`` lines of cells at once besides the blocks' beginnings, and runs that fit one block are computed once.  Spark's
    own recursive queries count all rows of all levels against a limit (a million by default), which any table of grids passes.
    """
    steps = whole(steps, "steps", 0)
    # Every row is much work, and a small file would be one task.
    start = to_planes(grids).select("grid_id", "width", "rule_id", "planes").repartition(3 * grids.sparkSession.sparkContext.defaultParallelism, "grid_id")
    sized = start.withColumn("block", F.expr(f"CAST(least({steps + 1}, greatest(1, {HELD} div greatest(1, size(planes)))) AS INT)"))
    blocks = sized.select("grid_id", "width", "rule_id", "block", F.posexplode(F.expr(_states_sql(f"({steps} div block)", run_sql("element_at(h0, -1)", "width", "rule_id", "block")))).alias("number", "planes"))
    own = F.expr(_states_sql(f"least(block - 1, {steps} - number * block)", step_sql("element_at(h0, -1)", "width", "terms")))
    each = blocks.select("grid_id", "width", (F.col("number") * F.col("block")).alias("begin"), F.posexplode(own).alias("at", "planes"))
    return each.select("grid_id", (F.col("begin") + F.col("at")).alias("generation"), "planes", "width")
