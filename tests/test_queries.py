"""Every registered core query against its SQL."""

import pytest

from sievework import queries as core
from tests.conftest import canonical, duck

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, name):
    df = core.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = duck(SF).execute(core.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(got, df.columns) == canonical(rel.fetchall(), columns)


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sampling(spark):
    df = core.sample_fraction(spark, SF)
    assert 300 < df.count() < 700


def test_without_the_optional_modules(monkeypatch):
    """Whatever keeps the llm subpackage from being imported, the core queries stay."""
    import importlib

    import __spark_entry__

    def missing(name, real=importlib.import_module):
        if name.startswith("sievework.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="something_it_needs")
        return real(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="left out"):
        assert set(__spark_entry__.queries()) == set(core.queries())
