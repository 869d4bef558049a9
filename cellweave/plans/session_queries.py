"""The registered query over the event log as a stream of session commands, with the same as a fold in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import threefry
from cellweave.plans.large_grids import _cells
from cellweave.streaming.lifecycle import answer_all

DAYS = 2
ACTIONS = ("create", "step", "step", "clear", "step", "reset", "rule", "randomize", "look", "step")
#: Rules by dimensions and parity of the event's number: counts of birth and of survival.
RULES = {2: (((3,), (2, 3)), ((3, 6), (1, 2, 5))), 3: (((6,), (5, 6, 7)), ((4, 5), (5, 6)))}
DENSITY = 0.3


def _text(dims: int, parity: int) -> str:
    birth, survival = RULES[dims][parity]
    joint = "" if dims == 2 else ","
    return f"B{joint.join(map(str, birth))}/S{joint.join(map(str, survival))}"


def _code(dims: int, parity: int) -> int:
    birth, survival = RULES[dims][parity]
    return sum(1 << b for b in birth) + sum(1 << (s + (9 if dims == 2 else 27)) for s in survival)


def _commands(events: DataFrame) -> DataFrame:
    number, dims = F.col("event_id"), F.when(F.col("user_id") % 5 == 0, 3).otherwise(2)
    odd = number % 2 == 1
    rule = F.when(dims == 3, F.when(odd, _text(3, 1)).otherwise(_text(3, 0))).otherwise(F.when(odd, _text(2, 1)).otherwise(_text(2, 0)))
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.pmod(number, F.lit(len(ACTIONS))).cast("int") + 1)
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), number.alias("command_id"), action.alias("action"), dims.alias("dims"), rule.alias("rule"),
        F.lit(8).alias("size"), (number * 7919).bitwiseAND(F.lit(threefry.WORD).cast("long")).alias("seed"), F.lit(DENSITY).alias("density"), (1 + F.pmod(number, F.lit(3))).cast("int").alias("steps"),
    )


def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as commands to 2D and 3D sessions, a session a user, through the stateful stream; every answer.

    Events without a time have no place in the order and are left out (the log has none)."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    answers = answer_all(_commands(events), ttl_seconds=DAYS * 86400.0)
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(c)
    return answers.select("session_id", "command_id", "action", *[known(c) for c in ("dims", "generation", "alive", "changed", "births", "deaths")], F.coalesce("error", F.lit("")).alias("error"))


_action = "[" + ", ".join(f"'{a}'" for a in ACTIONS) + f"][event_id % {len(ACTIONS)} + 1]"
_seeds = f"SELECT event_id, 0::BIGINT AS k0, event_id * 7919 & {threefry.WORD} AS k1 FROM cmd WHERE dims = {{0}} AND action IN ('create', 'randomize')"

ORACLE = f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, ts, {_action} AS action, CASE WHEN user_id % 5 = 0 THEN 3 ELSE 2 END AS dims FROM events WHERE ts IS NOT NULL
), gaps AS (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM e
), cmd AS (
  SELECT user_id, event_id, action, dims, sub = most AS answered, CASE WHEN sub = 1 THEN coalesce(gap, 0) ELSE 0 END AS gap,
    CASE dims WHEN 2 THEN CASE event_id % 2 WHEN 0 THEN {_code(2, 0)} ELSE {_code(2, 1)} END ELSE CASE event_id % 2 WHEN 0 THEN {_code(3, 0)} ELSE {_code(3, 1)} END END::BIGINT AS code,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, sub) AS k
  FROM (SELECT *, unnest(range(1, most + 1)) AS sub FROM (SELECT *, CASE action WHEN 'step' THEN 1 + event_id % 3 ELSE 1 END AS most FROM gaps))
), rnd AS (
  SELECT event_id, 0 AS z, y, x, alive FROM ({_cells(_seeds.format(2), (8, 8), DENSITY)}) UNION ALL SELECT event_id, z, y, x, alive FROM ({_cells(_seeds.format(3), (8, 8, 8), DENSITY)})
), o AS (
  SELECT d.dims, dz, dy, dx, dz = 0 AND dy = 0 AND dx = 0 AS mid FROM (VALUES (2), (3)) d(dims), range(-1, 2) a(dz), range(-1, 2) b(dy), range(-1, 2) c(dx) WHERE d.dims = 3 OR dz = 0
), t AS (
  SELECT user_id, dims, 0::BIGINT AS k, z, y, x, 0 AS alive, 0 AS before, 0 AS first, 0::BIGINT AS code, 0::BIGINT AS gen, false AS up
  FROM (SELECT DISTINCT user_id, dims FROM e), range(8) a(z), range(8) b(y), range(8) c(x) WHERE dims = 3 OR z = 0
  UNION ALL
  SELECT user_id, dims, k, z, y, x,
    CASE WHEN NOT up THEN 0 WHEN action IN ('create', 'randomize') THEN drawn WHEN action = 'step' THEN stepped WHEN action = 'clear' THEN 0 WHEN action = 'reset' THEN f ELSE a END,
    CASE WHEN up AND action = 'step' THEN a ELSE -1 END,
    CASE WHEN NOT up THEN 0 WHEN action IN ('create', 'randomize') THEN drawn ELSE f END,
    CASE WHEN action IN ('create', 'rule') THEN given ELSE code END,
    CASE WHEN action = 'step' THEN gen + 1 WHEN action IN ('rule', 'look') THEN gen ELSE 0 END, up
  FROM (
    SELECT s.user_id, s.dims, c.k, s.z, s.y, s.x, s.code, s.gen, a, f, c.action, c.code AS given, coalesce(r.alive, 0) AS drawn,
      ((s.code >> (n + a * CASE s.dims WHEN 2 THEN 9 ELSE 27 END)::INT) & 1)::INT AS stepped, c.action = 'create' OR s.up AND c.gap <= {DAYS * 86_400_000_000} AS up
    FROM (
      SELECT user_id, t.dims, k, (z + dz + 8) % 8 AS z, (y + dy + 8) % 8 AS y, (x + dx + 8) % 8 AS x, code, gen, up,
        sum(CASE WHEN mid THEN 0 ELSE alive END) AS n, max(CASE WHEN mid THEN alive END) AS a, max(CASE WHEN mid THEN first END) AS f
      FROM t JOIN o ON t.dims = o.dims GROUP BY ALL
    ) s JOIN cmd c ON c.user_id = s.user_id AND c.k = s.k + 1 LEFT JOIN rnd r ON r.event_id = c.event_id AND r.z = s.z AND r.y = s.y AND r.x = s.x
  )
)
SELECT c.user_id::VARCHAR AS session_id, c.event_id AS command_id, c.action, CASE WHEN up THEN m.dims ELSE -1 END::BIGINT AS dims, CASE WHEN up THEN gen ELSE -1 END::BIGINT AS generation,
  CASE WHEN up THEN n ELSE -1 END::BIGINT AS alive, CASE WHEN up THEN b + d ELSE -1 END::BIGINT AS changed, CASE WHEN up THEN b ELSE -1 END::BIGINT AS births, CASE WHEN up THEN d ELSE -1 END::BIGINT AS deaths,
  CASE WHEN up THEN '' ELSE 'no such session' END AS error
FROM (SELECT user_id, dims, k, gen, up, sum(alive) AS n, count(*) FILTER (before = 0 AND alive = 1) AS b, count(*) FILTER (before = 1 AND alive = 0) AS d FROM t WHERE k > 0 GROUP BY ALL) m
JOIN cmd c ON c.user_id = m.user_id AND c.k = m.k WHERE c.answered
"""

QUERIES = {"session_lifecycle": session_lifecycle}
ORACLE_SQL = {"session_lifecycle": ORACLE}
