import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from gridwork.session import TABLES


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "table_id", "r", "c", "sentence", "cell_id", "data"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_rows_only():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if k != "pipeline" and not k.startswith("op")}
    assert own - set(o) == {"nfkc_documents", "page_text_blocks"}


@pytest.mark.parametrize("name", ["report_sentences", "carry_per_file", "rules_file", "json_round_trip", "tsv_round_trip", "table_status", "extract_tables", "context_above",
                                  "qa_pairs", "split_accuracy", "text_normalize"])
def test_matches_duckdb_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    df = entry.queries()[name](spark, SMALL)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert sorted(df.columns) == sorted(cols)
    assert got == want
