"""Queries against their SQL where larger tables differ in kind: other key ranges, several files a table."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import SF, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


def same_as_sql(spark, name, folder, **tables):
    """``tables``: DuckDB relations that stand for the table's files."""
    df = entry.queries()[name](spark, str(folder))
    got = rows(df.columns, df.collect())
    con = duckdb.connect()
    for table, files in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    cur = con.execute(entry.oracle_sql()[name])
    assert got and got == rows([d[0] for d in cur.description], cur.fetchall())


def test_sync_summaries_of_part_keys_beyond_a_million(spark, tmp_path):
    """The SQL orders by line number x 1,000,000 + part key, so a large part key overtakes the next line."""
    path = tmp_path / "lineitem.parquet"
    duckdb.sql(f"""COPY (SELECT 1 + i // 7 AS l_orderkey, (i * 700001) % 3000000 AS l_partkey, i % 5 AS l_suppkey, (1 + i % 7)::INTEGER AS l_linenumber,
        'R' AS l_returnflag FROM range(700) r(i)) TO '{path}' (FORMAT parquet)""")
    same_as_sql(spark, "sync_summaries", tmp_path, lineitem=path)


def test_streamed_ingest_of_a_folder_of_files(spark, tmp_path):
    path = tmp_path / "conversations.parquet"
    spark.read.parquet(f"{SF}/conversations.parquet").repartition(3).write.parquet(str(path))
    same_as_sql(spark, "streamed_ingest", tmp_path, conversations=f"{path}/*.parquet")


@pytest.mark.parametrize("name", ["project_reports", "report_ledger"])
def test_reports_repeat_no_claim_per_project(spark, tmp_path, name):
    """300 projects of one owner share 300 claims, which meet them as one row: no list is ranked again per project."""
    sql = {
        "customer": "SELECT i AS c_custkey, 7 AS c_nationkey, 'C' || i AS c_name, CASE WHEN i % 10 < 9 THEN 'MACHINERY' ELSE 'OTHER' END AS c_mktsegment FROM range(333) r(i)",
        "orders": """SELECT i AS o_orderkey, (i * 7) % 333 AS o_custkey, CASE WHEN i % 3 THEN 300000.0 ELSE 1.0 END AS o_totalprice, 'O' AS o_orderstatus,
            (['1-URGENT', '2-HIGH', '3-MEDIUM'])[1 + i % 3] AS o_orderpriority, TIMESTAMP '1997-01-01' + to_days((i % 50)::INT) AS o_orderdate FROM range(900) r(i)""",
        "lineitem": "SELECT i % 900 AS l_orderkey, i AS l_partkey, i % 40 AS l_suppkey, DATE '1997-01-01' AS l_shipdate FROM range(2700) r(i)",
        "supplier": "SELECT i AS s_suppkey, 7 AS s_nationkey, 'S' || i AS s_name, 1.0 AS s_acctbal FROM range(40) r(i)"}
    for table, q in sql.items():
        duckdb.sql(f"COPY ({q}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    same_as_sql(spark, name, tmp_path, **{t: tmp_path / f"{t}.parquet" for t in sql})
    plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_spans_of_proposals_without_or_with_a_repeated_id(spark, tmp_path):
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        duckdb.sql(f"""COPY (SELECT * FROM '{SF}/{table}.parquet' UNION ALL SELECT * REPLACE (CASE WHEN {key} % 2 = 0 THEN {key} END AS {key})
            FROM '{SF}/{table}.parquet' WHERE {key} < 9) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)""")
    same_as_sql(spark, "proposals_with_evidence", tmp_path, orders=tmp_path / "orders.parquet", lineitem=tmp_path / "lineitem.parquet")
