"""Queries that have no SQL take all rows and whole vectors."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from vectrail.operators import classify
from vectrail.plans import classify_queries
from vectrail.sources.embeddings import images

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")


def test_one_class_machine_is_fitted_on_all_rows(spark, monkeypatch):
    fitted = []
    fit = classify.fit_one_class
    monkeypatch.setattr(classify, "fit_one_class", lambda rows: fitted.append(rows.count()) or fit(rows))
    found = entry.queries()["oneclass_svm"](spark, FOLDER).collect()
    rows = images(spark, FOLDER)
    assert fitted == [rows.where("aspect_of_hand like '%palmar%' or image_id = 3").count()] and len(found) == 1


def test_training_and_test_rows_hold_whole_vectors(spark):
    whole = {r.image_id: r.features for r in images(spark, FOLDER).collect()}
    train, test = classify_queries._halves(spark, FOLDER)
    assert {r.image_id: r.features for r in train.unionByName(test).collect()} == whole


@pytest.mark.parametrize("name", ["classifier_accuracy", "tree_training_accuracy", "tree_classify"])
def test_plans_do_not_grow_with_the_model(spark, name):
    """A tree in the plan took more than the driver's memory at 1 GB."""
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().analyzed().toString()
    assert plan.count(" >= ") == 0
