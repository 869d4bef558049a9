"""The registered corpus queries against their SQL, on supplied tables and on the awkward corpus."""

import duckdb
import pytest
from cellweave.llm.registry import ORACLE_SQL, QUERIES
from corpora import corpus

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages")


@pytest.fixture(scope="module")
def awkward(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    long = max((r[1] for r in corpus() if r[1]), key=len).split()
    items = [("a", " ".join(long[10:40])), ("b", "one"), ("c", None), ("d", ""), ("e", corpus()[1][1]), ("e2", corpus()[1][1]), (None, "two words")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("tables", ["supplied", "awkward"])
def test_sql(spark, awkward, name, tables):
    folder = DATA if tables == "supplied" else awkward
    con = duckdb.connect()
    for t in TABLES[: 3 if tables == "supplied" else 2]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if tables == 'supplied' else '/*.parquet'}'")
    # Numbers as text before pandas, which would make doubles of nullable longs.
    got = QUERIES[name](spark, folder)
    got = got.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in got.columns]).toPandas()
    want = con.execute(f"SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({ORACLE_SQL[name]})").df()
    assert rows(got) == rows(want)
