"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLE:
        assert df.columns
        return
    cur = db.execute(ORACLE[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == cols
    at = [heads.index(c) for c in cols]
    assert got == sorted(repr([_plain(r[i]) for i in at]) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rejoined_units_take_every_line_item(spark):
    made = entry.queries()["rejoined_units"](spark, FOLDER).agg({"n_pages": "sum"}).collect()
    assert made[0][0] == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


#: What tables of a larger scale hold: keys of parts, and of suppliers, that small ones never reach.
SHIFTED = """SELECT * REPLACE (l_partkey + {parts} * (l_suppkey % 2) AS l_partkey,
  l_suppkey + 1900 AS l_suppkey) FROM read_parquet('{folder}/lineitem.parquet')"""


@pytest.mark.parametrize("name", ["table_rows", "rating_totals", "casefile_years"])
def test_keys_of_large_tables(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"copy ({SHIFTED.format(parts=1_300_000, folder=FOLDER)}) to '{tmp_path}/lineitem.parquet'")
    con.execute(f"copy (select * from read_parquet('{FOLDER}/orders.parquet')) to '{tmp_path}/orders.parquet'")
    for table in ("lineitem", "orders"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet')")
    df = entry.queries()[name](spark, str(tmp_path))
    cur = con.execute(ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in sorted(df.columns)]
    want = sorted(repr([_plain(r[i]) for i in at]) for r in cur.fetchall())
    assert sorted(repr([_plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want
