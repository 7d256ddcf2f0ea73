"""Compare a registered query with its DuckDB statement."""

import duckdb

from gridwork.llm.oracles import ORACLE
from gridwork.llm.queries import QUERIES
from gridwork.session import TABLES

SMALL = "/root/testdata/sf0.001"


def _canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def check(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    wanted = con.execute(ORACLE[name])
    columns = [d[0] for d in wanted.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.collect()]
    assert _canon(rows, got.columns) == _canon(wanted.fetchall(), columns)
    return rows
