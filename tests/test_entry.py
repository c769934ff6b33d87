"""The entry points, with and without the corpus operators."""

import os
import subprocess
import sys

import __spark_entry__ as entry
from lanecraft.plans import catalog

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['lanecraft.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
