"""Every core query against its SQL in DuckDB, on whole tables."""

import importlib.abc
import sys
import zlib

import pytest
from compare import connect, oracle_rows, rows_of

import __spark_entry__ as e
from siltstone.operators.runs import record_checksums

from siltstone.plans.oracle import ORACLE
from siltstone.plans.queries import QUERIES
from siltstone.sources.tables import SCHEMAS, shared_dir


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_equals_sql(spark, data, con, name):
    assert rows_of(QUERIES[name](spark, data)) == oracle_rows(con, ORACLE[name])


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_files_are_whole(spark, data):
    rows = QUERIES["p3_files"](spark, data).collect()
    assert rows and all(r["whole"] for r in rows)
    assert all(r["files_after"] <= r["files_before"] for r in rows)


def test_fragments_say_how_they_were_cut(spark, data):
    rows = QUERIES["wal_fragment"](spark, data).collect()
    assert rows and all(r["n_fragments"] >= r["n_split"] >= 0 and r["payload_bytes"] > 8 for r in rows)


def test_checksums_change_with_a_byte(spark):
    rows = [(1, 1, 0, b, bytearray(b"k%d" % i), bytearray(b"value%d" % i), 0, i + 1) for b in (0, 1) for i in range(5)]
    sums = lambda rs: {r["block_no"]: r["crc_sum"] for r in record_checksums(spark.createDataFrame(rs, SCHEMAS["run_records"])).collect()}
    good = sums(rows)
    assert good[0] == good[1] == sum(zlib.crc32(b"k%dvalue%d" % (i, i)) for i in range(5))
    for at in (4, 5):  # a byte of the key, of the value
        bad = list(rows[2])
        bad[at] = bytearray(bad[at][:-1] + b"!")
        changed = sums([*rows[:2], tuple(bad), *rows[3:]])
        assert changed[0] != good[0] and changed[1] == good[1]


def _without_llm(monkeypatch, error):
    class Finder(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name.startswith("siltstone.llm"):
                raise error(name)

    for name in [n for n in sys.modules if n.startswith("siltstone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import siltstone

    monkeypatch.delattr(siltstone, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Finder(), *sys.meta_path])


def test_entry_runs_without_the_llm_subpackage(monkeypatch):
    _without_llm(monkeypatch, lambda name: ModuleNotFoundError(f"No module named {name!r}", name=name))
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE)


def test_a_broken_dependency_of_llm_is_not_hidden(monkeypatch):
    _without_llm(monkeypatch, lambda name: ModuleNotFoundError("No module named 'xxhash'", name="xxhash"))
    with pytest.raises(ModuleNotFoundError):
        e.queries()


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "local-cluster[3,2,3000]"})

    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "siltstone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "siltstone.llm" not in p.read_text()
