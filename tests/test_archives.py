import os

import numpy as np
import pytest
from cellweave.operators import grids
from cellweave.sources import archives
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def source(spark):
    archives.register(spark)
    return spark


def rows(df):
    return sorted(tuple(r[c] for c in ("grid_id", "depth", "height", "width", "cells")) for r in df.collect())


def test_round_trip_by_range(source, tmp_path):
    """Thousands of grids in a few archives, read in many ranges; shapes are mixed."""
    flat, deep = grids.random_grids(source, 1, (6, 7), 0.4, 1500), grids.random_grids(source, 2, (3, 4, 5), 0.4, 1500)
    every = flat.unionByName(deep.withColumn("grid_id", F.col("grid_id") + 10_000)).repartition(3)
    path = str(tmp_path / "a")
    every.write.format("grid-archive").mode("append").option("cells", 40_000).save(path)
    files = [f for f in os.listdir(path) if f.endswith(".npz")]
    assert 3 <= len(files) <= 12 and os.listdir(path) == files
    back = source.read.format("grid-archive").option("cells", 5000).load(path)
    assert back.rdd.getNumPartitions() >= 25
    assert rows(back) == rows(every)
    with np.load(f"{path}/{files[0]}") as opened:
        assert set(opened.files) == {"grid_id", "shape", "offsets", "cells"} and opened["offsets"][-1] == len(opened["cells"])
    flat.write.format("grid-archive").mode("append").save(path)
    assert source.read.format("grid-archive").load(path).count() == 4500
    flat.write.format("grid-archive").mode("overwrite").save(path)
    assert rows(source.read.format("grid-archive").load(path)) == rows(flat)


def test_aborted_writes_leave_nothing(source, tmp_path):
    path = str(tmp_path / "a")
    good = grids.random_grids(source, 1, (4, 4), 0.4, 50).repartition(4, "grid_id")
    good.write.format("grid-archive").mode("append").save(path)
    before = sorted(os.listdir(path))
    bad = good.withColumn("cells", F.when(F.col("grid_id") == 33, F.array(F.lit(1).cast("tinyint"))).otherwise(F.col("cells")))
    none = good.withColumn("cells", F.when(F.col("grid_id") == 33, F.lit(None)).otherwise(F.col("cells")))
    for df, said in ((bad, "do not fill"), (none, "has an id and cells"), (good.drop("depth"), "needs the columns")):
        with pytest.raises(Exception, match=said):
            df.write.format("grid-archive").mode("append").save(path)
        assert sorted(os.listdir(path)) == before
    assert rows(source.read.format("grid-archive").load(path)) == rows(good)


def test_empty(source, tmp_path):
    path = str(tmp_path / "a")
    assert source.read.format("grid-archive").load(path).count() == 0
    grids.random_grids(source, 1, (4, 4), 0.4, 5).limit(0).write.format("grid-archive").mode("append").save(path)
    assert source.read.format("grid-archive").load(path).count() == 0 and os.listdir(path) == []
