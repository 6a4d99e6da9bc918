"""The queries are listed before there is a session, as a driver does that makes its own."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def without_session(code):
    """What code prints in a process of its own, in which no session is made."""
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    return said.stdout.split()


def test_queries_without_session():
    names = without_session("import __spark_entry__ as e; print(*e.queries())")
    assert {"archive_stats", "rational_ops", "varint_round_trip", "murmur3_128"} <= set(names)
    with_sql = without_session("import __spark_entry__ as e; print(*e.oracle_sql())")
    assert with_sql and set(with_sql) <= set(names)


def test_modules_without_session():
    code = """
import importlib, pkgutil, siltbed
from pyspark import SparkContext
for m in pkgutil.walk_packages(siltbed.__path__, "siltbed."):
    importlib.import_module(m.name)
    print(m.name)
assert SparkContext._active_spark_context is None
"""
    assert {"siltbed.functions.media", "siltbed.functions.binary", "siltbed.plans.catalog"} <= set(without_session(code))
