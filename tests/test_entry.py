"""The entry points, and a sample of queries at the smallest scale."""

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "score"] and df.count() == 10


@pytest.mark.parametrize("name", ["label_filters", "lsh_stats", "ppr_dominant", "subject_top3", "gini_best_split", "label_threshold_inference"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(FOLDER).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = entry.queries()[name](spark, FOLDER).select(*[f"`{n}`" for n in names]).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_other_queries_do_without_the_llm_folder(monkeypatch):
    import importlib

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("vectrail.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith(("vectrail.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    import vectrail

    monkeypatch.delattr(vectrail, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    alone = importlib.import_module("__spark_entry__")
    assert "knn_l2" in alone.queries() and not any(n.startswith("op") and n[2].isdigit() for n in alone.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
