"""The driver's entry points, the analogues against DuckDB on a small data folder, and streamed lookups."""

import glob
import importlib
import random
import sys
import time

import duckdb
import pytest

from accolade import analogues_rounds  # noqa: F401
from accolade.analogues import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Small tables of the driver's shapes, with nulls and ties."""
    folder, r, c = tmp_path_factory.mktemp("data"), random.Random(4), duckdb.connect()
    c.sql("SELECT setseed(0.5)")
    c.sql("CREATE TABLE region AS SELECT i::INT AS r_regionkey, 'R' || i AS r_name FROM range(5) t(i)")
    c.sql("CREATE TABLE nation AS SELECT i::INT AS n_nationkey, 'N' || i AS n_name, (i % 5)::INT AS n_regionkey FROM range(25) t(i)")
    c.sql("CREATE TABLE customer AS SELECT i AS c_custkey FROM range(30) t(i)")
    c.sql("CREATE TABLE supplier AS SELECT i AS s_suppkey, 'S' || i AS s_name FROM range(40) t(i)")
    c.sql("CREATE TABLE part AS SELECT i AS p_partkey, ['red ring', 'blue box', 'old: pin'][i % 3 + 1] AS p_name, 'Brand#' || (i % 25 + 1) AS p_brand, ['ECONOMY', 'STANDARD', 'PROMO'][i % 7 % 3 + 1] AS p_type, (i * 7 % 50 + 1)::INT AS p_size FROM range(120) t(i)")
    c.sql("CREATE TABLE orders AS SELECT i AS o_orderkey, i * 13 % 30 AS o_custkey, ['O', 'F', 'P'][i % 3 + 1] AS o_orderstatus, TIMESTAMP '1995-01-01' + to_days((i * 37 % 2400)::INT) AS o_orderdate, (i % 5) || '-X' AS o_orderpriority FROM range(400) t(i)")
    c.sql("CREATE TABLE lineitem AS SELECT i // 3 AS l_orderkey, i * 11 % 120 AS l_partkey, i * 17 % 40 AS l_suppkey, (i % 3 + 1)::INT AS l_linenumber, (i * 31 % 1000) / 4.0 AS l_extendedprice, ['A', 'R', 'N'][i % 5 % 3 + 1] AS l_returnflag, TIMESTAMP '1996-01-01' + to_days((i * 7 % 2000)::INT) AS l_shipdate, ['O', 'F'][i % 2 + 1] AS l_linestatus FROM range(1200) t(i)")
    c.sql("CREATE TABLE events AS SELECT i AS event_id, i * 7 % 12 AS user_id, ['click', 'View', 'error'][i % 3 + 1] AS event_type, '{\"k\": ' || i || '}' AS props FROM range(200) t(i)")
    c.sql("CREATE TABLE documents AS SELECT i AS doc_id, ['a  B', 'a b', 'c\nd', ' C D '][i % 4 + 1] || (i // 8) AS text, CASE WHEN i % 3 > 0 THEN 'en' END AS lang FROM range(60) t(i)")
    c.sql("CREATE TABLE pages AS SELECT i AS page_id, 'http' || CASE WHEN i % 2 = 0 THEN 's' ELSE '' END || '://H' || (i % 9) || '.example.com/x?q=' || i AS url, '<h1>T' || (i % 2) || '</h1><h2 class=\"a\">U</h2><a href=\"/a\">x</a><a href=\"/' || i || '\">y</a>' AS html FROM range(40) t(i)")
    c.sql("CREATE TABLE labels AS SELECT i * 2 AS doc_id, (i % 2)::INT AS quality FROM range(20) t(i)")
    c.sql("CREATE TABLE conversations AS SELECT i // 4 AS conv_id, i % 4 AS turn, ['system', 'user', 'assistant', 'assistant'][i % 4 + 1] AS role, CASE WHEN i % 13 > 0 THEN repeat('x', (i * 5 % 23)::INT) END AS text FROM range(40) t(i)")
    for t in TABLES:
        c.sql(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder), c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_analogue(spark, data, name):
    folder, c = data
    got = QUERIES[name](spark, folder)
    want = c.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda it: sorted([tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r) for r in it], key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("accolade.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "accolade.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)


def test_streamed_lookups(spark, tmp_path):
    from accolade.sources import fixed
    from accolade.sources.snapshots import SNAPSHOT, snapshot_of
    from accolade.streaming.lookups import REQUEST, stream_lookups

    there = lambda: glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/rounds/archives-*")
    before = set(there())
    page = '<a href="/prize-winners-by-year/1990">1990</a><h2>Low Tide, by Ann Ode (Press)</h2>'
    snapshots = spark.createDataFrame([snapshot_of("pulitzer", "category", c, 0, u, page) for c, u in fixed.PULITZER_CATEGORIES], SNAPSHOT)
    spark.createDataFrame([(1, "Low Tide", "Ann Ode", None), (2, "Other", "Ann Ode", None), (3, " ", "Ann Ode", None)], REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in")
    query = stream_lookups(stream, snapshots, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out/results").collect()
    assert sorted((r["query_id"], r["category"], r["award_year"], r["decision"]) for r in got) == [(1, "Fiction", 1990, "QUALIFIES"), (1, "Novel", 1990, "QUALIFIES")]
    failures = spark.read.parquet(f"{tmp_path}/out/failures").collect()
    assert [f["message"] for f in failures if f["query_id"] == 3] == [fixed.BLANK_FIELD.format(field="title")]
    # The archives that the stream opened for itself are deleted when it has ended.
    for _ in range(100):
        if set(there()) <= before:
            break
        time.sleep(0.2)
    assert set(there()) <= before
    assert sorted(f["source_name"] for f in failures if f["query_id"] == 1) == sorted(n for k, n in fixed.SOURCES if k != "pulitzer")
