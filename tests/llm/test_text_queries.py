import duckdb

from ruleframe.llm import queries

DATA = "/root/testdata/sf0.001"


def test_every_query_runs(spark):
    for name, f in queries.QUERIES.items():
        assert f(spark, DATA).columns, name


def test_leaks_as_sql_finds_them(spark):
    con = duckdb.connect()
    for t in ("documents", "eval_item"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLE["p7_found"]).fetchall())
    assert sorted((r.doc_id, r.item_id) for r in queries.p7_found(spark, DATA).collect()) == want


def test_found_once(spark):
    for name, keys in (("p2_found", ["upload_id", "field_name"]), ("p9_found", ["doc_id"])):
        df = queries.QUERIES[name](spark, DATA)
        assert df.count() == df.select(*keys).distinct().count()
