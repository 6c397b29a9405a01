"""Each query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    text = frame[columns].astype(str).replace({"None": "null", "nan": "null", "<NA>": "null"})
    return text.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    got, want = plain(entry.queries()[name](spark, SF).toPandas()), plain(tables.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    assert (got == want).all().all()


def test_parents_where_ids_repeat(spark, tmp_path):
    """Diagrams in which an id comes again are judged too; of the nodes with an id the first is the parent."""
    con = duckdb.connect()
    lines = f"SELECT * REPLACE (o AS l_orderkey, CAST(i AS INTEGER) AS l_linenumber) FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1), range(1, 23) AS r(i), (VALUES (1, 7), (10, 7), (2, 22)) AS t(o, n) WHERE i <= n"
    con.execute(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    out = entry.queries()["schematic_parent_findings"](spark, str(tmp_path)).toPandas()
    found = {d: sorted(zip(rows["pos"], rows["rule"], strict=True)) for d, rows in out.groupby("diagram_id")}
    deep, own = "containment_depth", "self_parent"
    assert found["o1"] == [(1, deep), (2, deep), (5, deep), (5, own), (6, deep), (7, "missing_parent")]
    assert found["o10"] == [(1, deep), (5, deep), (5, own), (6, deep)]
    assert [rule for pos, rule in found["o2"] if pos == 22] == [deep, "parent_type"]
    assert (plain(out) == plain(con.execute(entry.oracle_sql()["schematic_parent_findings"]).df())).all().all()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
