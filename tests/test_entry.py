from __future__ import annotations

import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_the_subpackage():
    code = "import sys, gaugeflow.queries, gaugeflow.streaming.online, gaugeflow.sources.readers; sys.exit(any(m.startswith('gaugeflow.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_without_the_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "_there", lambda name: False)
    names = set(entry.queries())
    assert names == set(importlib.import_module("gaugeflow.queries").queries())
    assert set(entry.oracle_sql()) <= names
