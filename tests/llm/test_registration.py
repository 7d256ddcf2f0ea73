"""The registered queries of the subpackage."""

import re

import __spark_entry__ as entry


def test_one_query_for_each_operator_and_the_pipeline():
    found = entry.queries()
    numbers = [int(m[1]) for k in found if (m := re.match(r"op(\d+)_", k))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in found
    assert {k for k in entry.oracle_sql() if re.match(r"op\d+_", k)} <= set(found)
