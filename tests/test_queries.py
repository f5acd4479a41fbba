"""Every query with SQL against DuckDB; the others for rows."""

import subprocess
import sys

import pytest
from conftest import ROOT, same_rows, views

import __spark_entry__ as entry

OWN = [n for n in entry.queries_of_tables]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql:
        same_rows(df, views(sf_dir).sql(sql))
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_corpus_operators():
    """The corpus operators may be absent: the rest still imports."""
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tessella.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "star_join" in e.queries() and "pipeline" not in e.queries()
assert not any(n.startswith("op1_") for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("missing, works", [("xxhash", True), ("tessella.llm.simhash", False)])
def test_entry_without_a_package(missing, works):
    """A package that the corpus operators need may be absent, a module of their own may not."""
    code = f"""
import importlib.util, sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name, name=name)
there = importlib.util.find_spec("tessella.llm") is not None
sys.meta_path.insert(0, Absent())
try:
    import __spark_entry__ as e
    assert "star_join" in e.queries() and ({works} or not there)
except ImportError:
    assert there and not {works}
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
