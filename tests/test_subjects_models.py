import json

import pytest
from pyspark.ml.classification import NaiveBayesModel
from pyspark.sql import functions as F

from topicloom.operators import models as m
from topicloom.operators import subjects as s
from topicloom.session import fresh_dir
from topicloom.sources.files import read_libsvm

SUBJECTS = [("a", 1, 1, "j1", None), ("a", 2, 3, "j2", "FULL"), ("b", 1, 2, "j", None),
            ("a-value", 1, 4, "j", None), ("k-key", 1, 5, "j", None), ("x.df_meta", 1, 6, "j", None)]
SCHEMA = "subject string, version long, schema_id long, schema_json string, compatibility string"


@pytest.fixture
def subjects(spark):
    return spark.createDataFrame(SUBJECTS, SCHEMA)


def test_latest_and_listing(subjects):
    got = {r["subject"]: (r["version"], r["schema_id"], r["compatibility"])
           for r in s.list_subjects(subjects).collect()}
    assert got == {"a": (2, 3, "FULL"), "b": (1, 2, "NONE")}
    assert s.schema_of(subjects, "a").first()["schema_json"] == "j2"
    assert s.schema_of(subjects, "a", 1).first()["schema_json"] == "j1"
    assert s.latest_schema_id(subjects, "a") == 3
    with pytest.raises(LookupError):
        s.latest_schema_id(subjects, "zzz")


@pytest.mark.parametrize("hot_rows", [2, None])
def test_register_absent(spark, subjects, hot_rows):
    new = spark.createDataFrame([("a", "n"), ("c", "n"), ("c", "n"), ("d", "n")],
                                "subject string, schema_json string")
    out = s.register_absent(subjects, new, hot_rows=hot_rows)
    added = out.where("schema_json = 'n'").collect()
    assert {r["subject"] for r in added} == {"c", "c-value", "d", "d-value"}
    assert sorted(r["schema_id"] for r in added) == [7, 8, 9, 10]
    assert out.count() == len(SUBJECTS) + 4


def test_upsert_and_delete(spark, subjects):
    changes = spark.createDataFrame(
        [("a", "j3", "NONE"), ("e", "j", "FULL"), (None, '{"name":"f"}', None)],
        "subject string, schema_json string, compatibility string")
    latest = {r["subject"]: (r["version"], r["schema_json"])
              for r in s.latest_schemas(s.upsert_schemas(subjects, changes)).collect()}
    assert latest["a"] == (3, "j3") and latest["e"] == (1, "j") and latest["f"][0] == 1
    gone = spark.createDataFrame([("a",)], "subject string")
    assert s.delete_subjects(subjects, gone).count() == 4


def test_several_changes_of_a_subject(spark):
    subjects = spark.createDataFrame([("a", 1, 5, "j1", None), ("b", 3, 6, "k", "NONE")],
                                     "subject string, version long, schema_id long, schema_json string, "
                                     "compatibility string")
    changes = spark.createDataFrame(
        [("a", "j1", "FULL", 1), ("a", "j2", None, 2), ("a", "j2", "BACKWARD", 3), ("a", "j1", None, 4),
         ("b", "k", None, 1), ("c", "n", None, 1), ("c", "n", "FULL", 2)],
        "subject string, schema_json string, compatibility string, at long")
    after = s.upsert_schemas(subjects, changes, ["at"]).collect()
    got = sorted((r["subject"], r["version"], r["schema_json"], r["compatibility"]) for r in after)
    assert got == [("a", 1, "j1", "FULL"), ("a", 2, "j2", "BACKWARD"), ("a", 3, "j1", None), ("b", 3, "k", "NONE"),
                   ("c", 1, "n", "FULL")]
    ids = [r["schema_id"] for r in after]
    assert len(set(ids)) == len(ids) and sorted(ids)[:2] == [5, 6] and max(ids) == 9


def test_compat_check():
    def record(*fields):
        return json.dumps({"type": "record", "name": "r", "fields": list(fields)})

    a, b = {"name": "a", "type": "int"}, {"name": "b", "type": "int"}
    filled = {"name": "b", "type": "int", "default": 0}
    assert s.compat_check(record(a), record(a, b)) == ["b added without default"]
    assert s.compat_check(record(a), record(a, filled)) == []
    assert s.compat_check(record(a, b), record(a), "FORWARD") == ["b removed without default"]
    assert s.compat_check(record(a), record({"name": "a", "type": "long"}), "FULL") == [
        "type of a changed"]
    assert s.compat_check(record(a), record(b), "NONE") == []


@pytest.fixture(scope="module")
def svm(spark):
    path = fresh_dir(spark, "svm")
    lines = spark.range(400).select(F.when(F.col("id") % 2 == 0, "0 1:9 2:1").otherwise(
        "1 1:1 2:9").alias("value"))
    lines.write.text(path)
    return read_libsvm(spark, path, 2)


def test_training_recipe(svm):
    # A share below 100 must leave training rows, and scores are taken on held-out rows.
    model, scored = m.train_naive_bayes(svm, sample=70)
    assert isinstance(model, NaiveBayesModel)
    assert 0 < scored.count() < 400
    assert scored.where("label = prediction").count() == scored.count()
    assert m.train_naive_bayes(svm, sample=50, score="all")[1].count() == 400
    with pytest.raises(ValueError):
        m.split_sample(svm, 0)


def test_model_table(spark):
    df = spark.createDataFrame([("a", 9.0, 1.0), ("b", 1.0, 9.0)] * 20, "l string, x double, y double")
    models = m.Models(spark, fresh_dir(spark, "models"))
    assert models.list().count() == 0
    fitted = m.train_program(df, lambda d: m.naive_bayes_pipeline("l", ["x", "y"], 100, d))
    models.save("nb", fitted, udf="score_nb", inputs=["x", "y"], type="classifier", category="nb")
    models.save("nb", fitted, udf="score_nb2")
    assert [r["udf"] for r in models.list().collect()] == ["score_nb2"]
    scored = models.score(df, "nb")
    assert scored.where("predicted = l").count() == 40
    models.delete("nb")
    assert models.list().count() == 0
    with pytest.raises(LookupError):
        models.load("nb")
