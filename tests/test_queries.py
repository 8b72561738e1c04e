"""Every registered query against SQL that takes another path to the same rows."""

import pathlib
import subprocess
import sys

import pytest

import __spark_entry__ as spark_entry
from millrace.plans.oracles import ORACLES
from millrace.plans.queries import QUERIES
from tests.oracle import TESTDATA, actual, expected


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= spark_entry.queries().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    sf_dir = f"{TESTDATA}/sf0.01"
    columns, rows = actual(QUERIES[name](spark, sf_dir))
    expected_columns, expected_rows = expected(sf_dir, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows


@pytest.mark.parametrize("module", ["xxhash", "public_tokenizers", "tokenizers", "millrace.llm.queries"])
def test_core_queries_need_no_other_modules(module):
    """Nothing that only the training-data operators use takes the core queries along."""
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60, cwd=pathlib.Path(__file__).resolve().parents[1])
    assert int(done.stdout.split()[0]) >= len(QUERIES) and int(done.stdout.split()[1]) >= len(ORACLES), done.stderr


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 600
