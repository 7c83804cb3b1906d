"""Every query of the engine against its SQL, on the smallest data."""

import duckdb
import pandas as pd
import pytest

from inkveil.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pdf_files_takes_every_order(spark, tmp_path):
    import hashlib

    from inkveil.sinks.export import build_pdf

    lines = [(order, n, mode) for order in (1, 2999, 3000, 7_000_000_000) for n, mode in ((2, "AIR"), (1, "RAIL"))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipmode string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["pdf_sha256"]) for r in QUERIES["pdf_files"](spark, str(tmp_path)).collect()}
    want = {}
    for order in {o for o, _, _ in lines}:
        pages = sorted((n, mode) for o, n, mode in lines if o == order)
        pdf = build_pdf([("\xff\xd8".encode() + mode.encode() * 20, 1000, 500 + n * 100) for n, mode in pages])
        want[order] = (len(pdf), hashlib.sha256(pdf).hexdigest())
    assert got == want
