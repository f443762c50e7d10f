"""Registered queries against their SQL in DuckDB, and the parts that SQL does not show."""

import duckdb
import pytest

from runweave.plans import readonly
from runweave.queries import QUERIES
from runweave.sources import event_log
from runweave.sources.fixtures import TABLES
from runweave.sqls import ORACLE_SQL


def rounded(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = [tuple(rounded(r[c]) for c in names) for r in df.collect()]
    cur = duck.execute(ORACLE_SQL[name])
    found = [d[0] for d in cur.description]
    assert sorted(found) == names
    want = [tuple(rounded(r[found.index(c)]) for c in names) for r in cur.fetchall()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=order) == sorted(want, key=order)


REFUSED = [
    "DROP TABLE orders", "CREATE TABLE x AS SELECT 1", "INSERT INTO orders SELECT * FROM orders", "SET a = 1", "SHOW TABLES", "EXPLAIN SELECT 1", "CACHE TABLE orders", "DESCRIBE orders",
    "SELECT TRANSFORM(o_orderkey) USING 'cat' AS x FROM orders", "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM (SELECT reflect('java.util.UUID', 'randomUUID') AS x)", "SELECT 1 WHERE EXISTS (SELECT * FROM json.`/etc/passwd`)", "SELECT (SELECT max(reflect('a', 'b')) FROM orders)", "SELECT * FROM nowhere",
    "SELECT * FROM read_files('/etc/passwd')", "WITH x AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM x", "SELECT o_orderkey FROM orders ORDER BY reflect('a', 'b')", "SELECT * FROM range(10)",
]


@pytest.mark.parametrize("text", REFUSED)
def test_read_only_sql_refuses(spark, small, text):
    with pytest.raises(readonly.ReadOnlyError):
        readonly.query(spark, small, text)


def test_read_only_sql_leaves_no_views(spark, small):
    text = "WITH big AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) SELECT n_name, count(*) AS n FROM big JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name IN (SELECT n_name FROM nation) GROUP BY n_name HAVING count(*) > 1 ORDER BY n DESC LIMIT 3"
    assert readonly.checked(spark, text) == {"orders", "customer", "nation"}
    assert readonly.query(spark, small, text).count() == 3
    assert not {t.name for t in spark.catalog.listTables()} & set(TABLES)


def test_append_and_replay(spark, tmp_path):
    rows = [("2024-01-01", r, s, f"{r}-{s}", "t", "run.created", 1, "{}") for r in ("a", "b") for s in (1, 2, 3, 4, 5)]
    log = spark.createDataFrame(rows, "partition_key string, run_id string, seq long, event_id string, tenant_id string, event_type string, payload_version int, payload string")
    log = log.selectExpr("cast(partition_key as date) as partition_key", "run_id", "seq", "event_id", "tenant_id", "event_type", "payload_version", "payload")
    event_log.append(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r["seq"] for r in event_log.replay(back.where("run_id = 'a'"), 1, 3).collect()) == [2, 3]
    assert event_log.conflicts(log.where("seq = 2"), back).count() == 2
    assert event_log.of_tenant(back, None).count() == 0 and event_log.of_tenant(back, "t").count() == 10
