"""Every core query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, duck

SF = "sf0.001"
HAVE = os.path.isdir(f"{DATA}/{SF}")
entry._load()
NAMES = sorted(entry.plans.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not HAVE, reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    why, _ = compare(spark, con, name, entry.plans.QUERIES[name], entry.plans.SQL.get(name), SF)
    assert not why


def test_core_runs_without_the_llm_folder(monkeypatch):
    real = entry.importlib.import_module

    def without(name, *a):
        if name.startswith("graphloom.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", without)
    assert set(entry.queries()) == set(NAMES)
