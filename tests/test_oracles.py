"""Every query with SQL gives the rows that SQL gives."""

import datetime
import math
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return float(x) if hasattr(x, "as_tuple") else x


@pytest.fixture(scope="module")
def results(request, spark, sf):
    """Rows of the queries that are tested, a few at a time: most of a small query's time goes to its planning."""
    known = entry.queries()
    names = [n for n in sorted(known) if any(f"[{n}]" in i.name for i in request.session.items)]

    def run(name):
        df = known[name](spark, sf)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(run, n) for n in names}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(results, duck, name):
    got_names, got = results[name].result()
    want = duck.execute(ORACLES[name])
    want_names = [d[0] for d in want.description]
    assert sorted(got_names) == sorted(want_names)
    order = sorted(got_names)
    rows = Counter(tuple(plain(r[c]) for c in order) for r in got)
    at = [want_names.index(c) for c in order]
    wanted = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert rows == wanted, (list((rows - wanted).items())[:3], list((wanted - rows).items())[:3])


#: Queries that SQL does not express, or only at too great length; test_operators.py holds them against plain Python.
WITHOUT_SQL = {"dd_by_address", "ml_train_trees", "sc_ceiling"}


def test_all_core_queries_have_sql_or_a_test():
    assert {n for n in entry.queries() if n not in ORACLES and not n.startswith("op") and n != "pipeline"} == WITHOUT_SQL
