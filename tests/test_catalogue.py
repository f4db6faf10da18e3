"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomwork.plans import catalogue, extended, families, roundtrips

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
NAMES = list(catalogue.QUERIES)
assert families.query is extended.query is roundtrips.query is catalogue.query  # all register in one place
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


def rows(data, columns):
    return sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    table = duck.execute(catalogue.ORACLES[name]).to_arrow_table()
    assert sorted(df.columns) == sorted(table.column_names)
    assert rows(got, df.columns) == rows(table.to_pylist(), df.columns)


def test_odd_cells(spark, tmp_path):
    """Cells that end in a line separator other than a newline, and documents without a length or a text, as the SQL has them."""
    texts = [f"12{c} -3{c} 1.5{c} INF{c} 7 {c}8" for c in ("\u0085", "\u2028", "\u2029", "\x1c")]
    docs = [(k, t, n) for k, (t, n) in enumerate(zip([*texts, None, ""], [4, 5, 6, -1, 7, None], strict=True))]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES["coerce_cell"](spark, str(tmp_path))
    want = rows(own.execute(catalogue.ORACLES["coerce_cell"]).to_arrow_table().to_pylist(), df.columns)
    assert rows([r.asDict() for r in df.collect()], df.columns) == want and len(want) == 30


def test_odd_parts(spark, tmp_path):
    """Parts that share a key, wholly equal ones among them, and parts without a key or a size or of size 0: each is a lens of its own."""
    parts = [(1, 5), (1, 7), (2, 30), (2, 30), (2, 30), (3, None), (4, 9), (5, 0), (None, 8), (None, 8), (None, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SF}/region.parquet").write.parquet(f"{tmp_path}/region.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = catalogue.QUERIES["lens_surfaces"](spark, str(tmp_path))
    want = rows(own.execute(catalogue.ORACLES["lens_surfaces"]).to_arrow_table().to_pylist(), df.columns)
    assert rows([r.asDict() for r in df.collect()], df.columns) == want and len(want) == 3 * len(parts)
    assert not any("lens" in x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastExchange" in x)
