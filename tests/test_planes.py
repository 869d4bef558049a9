import time

import duckdb
import numpy as np
import pytest
from cellweave.functions import rules
from cellweave.functions.rules import CONWAY, HIGHLIFE, parse_rule
from cellweave.operators import grids, native, planes, simulate
from cellweave.plans import trajectories
from pyspark.sql import functions as F
from test_tiles import rolled

import __spark_entry__ as entry


@pytest.mark.parametrize("shape", [(8, 8), (1, 3), (5, 2), (3, 62), (70, 33), (1, 1), (2, 2)])
def test_planes_agree_with_rolls(spark, shape):
    random = np.random.default_rng(sum(shape))
    stack = [(random.random(shape) < d).astype(np.uint8) for d in (0.2, 0.5, 0.9)]
    for rule in (CONWAY, HIGHLIFE, parse_rule("B0147/S0258"), parse_rule("B/S012345678")):
        packed = simulate.with_rule(grids.grids_from_arrays(spark, stack), rule)
        for steps in (0, 1, 4):
            got = grids.grids_to_arrays(planes.run_steps(packed, steps))
            assert all((got[i] == rolled(s, rule, steps)).all() for i, s in enumerate(stack))


def test_plan_is_native_and_faster(spark):
    packed = simulate.with_rule(grids.random_grids(spark, 3, (32, 32), 0.3, 60), CONWAY).repartition(4).cache()
    packed.count()
    plan = planes.run_steps(packed, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]

    def timed(run) -> float:
        run()
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    # Ten times the generations in less than twice the time.
    fast = timed(lambda: planes.run_steps(packed, 20).write.format("noop").mode("overwrite").save())
    slow = timed(lambda: native.run_steps(packed, 2).write.format("noop").mode("overwrite").save())
    assert fast < 2 * slow
    packed.unpersist()


def test_wide_rows_are_refused(spark):
    wide = simulate.with_rule(grids.empty_grids(spark, (2, 63)), CONWAY)
    with pytest.raises(Exception, match="over 62"):
        planes.run_steps(wide, 1).collect()


def test_recursion(spark):
    stack = [(np.random.default_rng(i).random((7, 9)) < 0.4).astype(np.uint8) for i in range(3)]
    found = planes.recursive_run(simulate.with_rule(grids.grids_from_arrays(spark, stack), CONWAY), 120)
    rows = {(r["grid_id"], r["generation"]): r["cells"] for r in planes.from_planes(found).collect()}
    assert len(rows) == 3 * 121
    for i, s in enumerate(stack):
        for g in (0, 1, 60, 120):
            assert rows[i, g] == rolled(s, CONWAY, g).ravel().tolist()


def test_kept_generations_have_no_limit_of_rows(spark, monkeypatch):
    """More rows than Spark lets a recursive query have; and blocks of generations give what one block gives."""
    stack = [(np.random.default_rng(i).random((5, 6)) < 0.4).astype(np.uint8) for i in range(4)]
    packed = simulate.with_rule(grids.grids_from_arrays(spark, stack), CONWAY)
    rows = lambda: sorted((r["grid_id"], r["generation"], tuple(r["planes"])) for r in planes.recursive_run(packed, 23).collect())
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        whole = rows()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(whole) == 4 * 24 and [r[:2] for r in whole] == [(i, g) for i in range(4) for g in range(24)]
    for held in (1, 5 * 7, 5 * 12):
        monkeypatch.setattr(planes, "HELD", held)
        assert rows() == whole
    assert len(planes.recursive_run(packed, 0).collect()) == 4


def test_arguments_are_computed_once():
    """A pack of an expression, and a run under a parsed rule, do that work once, not for each cell."""
    assert planes.pack_sql("GIVEN", "8", "8").count("GIVEN") == 1 and planes.pack_sql("GIVEN", "8", "8").index("GIVEN") < planes.pack_sql("GIVEN", "8", "8").index("->")
    assert planes.run_sql("g0", "8", "CODE", "5").count("CODE") == 1
    assert planes._code_sql("TEXT", 2).count("TEXT") == planes._code_sql("TEXT", 3).count("TEXT") == 1
    assert planes._text_sql("CODE", 2).count("CODE") == 1


def test_sql_functions(spark):
    planes.register(spark)
    texts = ["B3/S23", " b36 / s125 ", "B/S", "B33/S", "B9/S", "life", "", None, "B3/S23x", "B012345678/S8"]
    texts_3d = ["B6/S5,6,7", "b 10 , 3/S", "B/S26", "B27/S", "B1,1/S", "B100/S", "B1,,2/S", "B/S", None, "x", "B14,19/S13"]
    for dims, given, suffix in ((2, texts, ""), (3, texts_3d, "_3d")):
        rows = spark.createDataFrame([(t,) for t in given], "text string").select("text", F.expr(f"ca_rule_code{suffix}(text)").alias("a"), rules.rule_code(F.col("text"), dims).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows) and sum(r["a"] is not None for r in rows) >= 4
        codes = [r["a"] for r in rows if r["a"] is not None]
        named = spark.createDataFrame([(c,) for c in codes], "code long").select("code", F.expr(f"ca_rule_text{suffix}(code)").alias("t")).collect()
        assert [r["t"] for r in named] == [rules.int_to_rule(c, dims).text for c in codes]
    blinker = spark.sql("SELECT ca_pack(array(0,0,0,0,0, 0,0,1,0,0, 0,0,1,0,0, 0,0,1,0,0, 0,0,0,0,0), 5, 5) AS g")
    blinker.createOrReplaceTempView("blinker")
    assert spark.sql("SELECT c.y, c.x FROM (SELECT ca_step(g, 5, ca_rule_code('B3/S23')) AS after FROM blinker), LATERAL ca_cells(after, 5) c WHERE c.alive = 1 ORDER BY c.y, c.x").collect() == [(2, 1), (2, 2), (2, 3)]
    assert spark.sql("SELECT ca_alive(ca_run(g, 5, ca_rule_code('B3/S23'), 7)) AS n, ca_unpack(ca_run(g, 5, ca_rule_code('B3/S23'), 8), 5) = ca_unpack(g, 5) AS same FROM blinker").collect() == [(3, True)]


def test_cells_come_without_a_join(spark):
    """The table function spreads the outer rows as they are; null and empty grids have no cells, equal grids keep their own."""
    planes.register(spark)
    spark.sql("SELECT * FROM VALUES (1, array(5L, 2L)), (2, array(5L, 2L)), (3, NULL), (4, CAST(array() AS ARRAY<BIGINT>)), (5, array(NULL, 1L)) t(id, g)").createOrReplaceTempView("held")
    found = spark.sql("SELECT id, c.y, c.x, c.alive FROM held, LATERAL ca_cells(g, 3) c")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    lines = {(1, 0): (1, 0, 1), (1, 1): (0, 1, 0), (2, 0): (1, 0, 1), (2, 1): (0, 1, 0), (5, 0): (None,) * 3, (5, 1): (1, 0, 0)}
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:3]) == [(i, y, x, alive) for (i, y), line in lines.items() for x, alive in enumerate(line)]


def test_sql_text_on_odd_vectors_without_broadcasts(spark, tmp_path):
    """Null, short and empty vectors are dead where they have no number; however small the tables, the driver holds neither."""
    vectors = [(0, None), (1, [1.0] * 64), (2, [1.0, -1.0, 2.0]), (3, []), (4, [None, float("nan")] * 32), (5, [(-1.0) ** (i * i // 3) for i in range(80)]), (None, [1.0] * 64), (90, [1.0] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k,) for k in [*range(9), None]], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()["sql_text_2d"](spark, str(tmp_path))
    rows = sorted(map(tuple, found.select("p_partkey", "rule", "y", "alive").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("FileScan") == 2 * (1 + plan.count("== Initial Plan =="))
    con = duckdb.connect()
    for t in ("embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT p_partkey, rule, y, alive FROM ({entry.oracle_sql()['sql_text_2d']})").fetchall()
    assert rows == sorted(want) and len(rows) == 6 * 8


def test_stored_trajectory(spark, tmp_path):
    stack = [(np.random.default_rng(i).random((6, 5)) < 0.4).astype(np.uint8) for i in range(4)]
    packed = simulate.with_rule(grids.grids_from_arrays(spark, stack), CONWAY).repartition(2)
    path = trajectories.store(packed, 6, path=str(tmp_path / "t"))
    one = trajectories.generation(spark, path, 4)
    assert {r[0].split("generation=")[1].split("/")[0] for r in one.select(F.input_file_name()).collect()} == {"4"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(generation" in plan
    assert {r["grid_id"]: r["cells"] for r in one.collect()} == {i: rolled(s, CONWAY, 4).ravel().tolist() for i, s in enumerate(stack)}
    key = lambda df: sorted((r["grid_id"], r["generation"], r["alive"], r["changed"], r["births"], r["deaths"]) for r in df.collect())
    assert key(trajectories.metrics(spark, path)) == key(simulate.run_metrics(packed, 6))
