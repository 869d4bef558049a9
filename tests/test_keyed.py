import numpy as np
import pytest
from cellweave.functions import checks, threefry
from cellweave.operators import keyed
from cellweave.plans.experiments import sweep_requests
from pyspark.sql import functions as F

#: The generator's published test vectors (key, counter, words) for 20 rounds.
VECTORS = [
    ((0x00000000, 0x00000000), (0x00000000, 0x00000000), (0x6B200159, 0x99BA4EFE)),
    ((0xFFFFFFFF, 0xFFFFFFFF), (0xFFFFFFFF, 0xFFFFFFFF), (0x1CB996FC, 0xBB002BE7)),
    ((0x13198A2E, 0x03707344), (0x243F6A88, 0x85A308D3), (0xC4923A9C, 0x483DF7A0)),
]


def test_published_vectors(spark):
    for key, counter, want in VECTORS:
        assert tuple(int(x) for x in threefry.words(*key, *counter)) == want
    rows = spark.createDataFrame([(*k, *c) for k, c, _ in VECTORS], "k0 long, k1 long, c0 long, c1 long")
    got = rows.select("k0", threefry.word_pair(*map(F.col, ("k0", "k1", "c0", "c1"))).alias("p")).collect()
    assert {(r["k0"], *r["p"]) for r in got} == {(k[0], *w) for k, _, w in VECTORS}


def test_columns_and_arrays_agree(spark):
    seeds = [0, 1, -1, 42, 1 << 40, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(s,) for s in seeds], "seed long").withColumn("key", threefry.key_from_seed(F.col("seed")))
    for r in rows.select("seed", "key", threefry.split(F.col("key"), F.lit(5)).alias("s"), threefry.draw(F.col("key"), F.lit((1 << 33) + 7)).alias("w"), threefry.rule_bits(F.col("key"), 3).alias("r")).collect():
        unsigned = r["seed"] & (1 << 64) - 1
        k = np.array([unsigned >> 32]), np.array([unsigned & threefry.WORD])
        assert tuple(r["key"]) == (unsigned >> 32, unsigned & threefry.WORD)
        assert tuple(r["s"]) == tuple(int(x[0]) for x in threefry.words(*k, 0, 5))
        a, b = threefry.words(*k, 2, 7)
        assert r["w"] == int((a ^ b)[0]) and 0 <= r["r"] < 1 << 54


def test_grids_from_keys(spark):
    rows = spark.range(300).withColumn("key", threefry.key_from_seed(F.col("id") * 977))
    out = {r["id"]: r for r in keyed.random_grids(rows, "key", (20, 30), 0.25).collect()}
    share = np.array([out[i]["cells"] for i in range(300)])
    assert share.shape == (300, 600) and abs(share.mean() - 0.25) < 0.01 and len({tuple(c) for c in share.tolist()}) == 300
    again = {r["id"]: r["cells"] for r in keyed.random_grids(rows.repartition(7), "key", (20, 30), 0.25).collect()}
    assert all(again[i] == out[i]["cells"] for i in range(300))
    for density, total in ((0, 0), (1, 24)):
        assert {sum(r["cells"]) for r in keyed.random_grids(rows, "key", (2, 3, 4), density).collect()} == {total}
    none = spark.sql("SELECT 1 AS id, CAST(NULL AS STRUCT<k0: BIGINT, k1: BIGINT>) AS key")
    assert keyed.random_grids(none, "key", (2, 2), 0.5).first()["cells"] is None
    with pytest.raises(ValueError):
        keyed.random_grids(rows, "key", (2, 2), 1.5)


def test_requests_are_their_own(spark):
    """A request's sweep is the same alone and among others; split keys do not meet."""
    asked = spark.createDataFrame([(i, i * 31) for i in range(6)] + [(9, None)], "request long, seed long")
    ask = lambda df: sorted(map(tuple, sweep_requests(df, 2, rules=2, initial_conditions=2, size=6, steps=4, density=0.4).collect()))
    every = ask(asked)
    assert len(every) == 24 and [r for r in every if r[0] == 3] == ask(asked.where("request = 3"))
    keys = keyed.split_keys(asked.where("seed IS NOT NULL").select("request", threefry.key_from_seed(F.col("seed")).alias("key")), "key", 50, "i", "own")
    assert keys.select("own").distinct().count() == 300


def test_keys_are_drawn_once(spark):
    """A key of a key's words: three folds in 3D, however often the rounds name their keys; requests go to all cores."""
    keyed_rows = spark.range(3).withColumn("key", threefry.key_from_seed(F.col("id")))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(keyed_rows.select(threefry.rule_bits(threefry.split(F.col("key"), F.lit(1)), 3))).count("aggregate(") <= 3
    asked = spark.range(40).selectExpr("id AS request", "id * 31 AS seed").coalesce(1)
    rows = sweep_requests(asked, 2, rules=1, initial_conditions=1, size=4, steps=1)
    assert "RepartitionByExpression [request" in plan(rows)


def test_checks(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 2.0, 0.5, array(0, 1)), (0, 1.5, -0.1, null), (null, 3.0, double('NaN'), array(0, 2)), (-1, 0.0, 1.0, array(null, 1)) t(a, b, c, m)")
    got = rows.select(checks.at_least(F.col("a"), 0), checks.dimensions(F.col("a"), F.col("b")), checks.density(F.col("c")), checks.mask(F.concat(F.col("m"), F.array_repeat(F.lit(1), 7)), 2)).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (True, False, False, False), (False, False, False, False), (False, False, True, False)]
