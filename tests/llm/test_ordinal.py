"""Ordinal regression on ratings made by rule, on held-out labels, and on odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gatelens.llm import ordinal
from gatelens.llm.common import documents


def test_thresholds_are_ordered_and_grades_found():
    rng = np.random.default_rng(1)
    words = ["bad", "fair", "good", "fine"]
    texts, grades = [], []
    for _ in range(600):
        grade = int(rng.integers(0, 4))
        texts.append(" ".join(rng.choice(["x", "y", "z", *[words[grade]] * 2]) for _ in range(20)))
        grades.append(grade)
    model = ordinal.fit_ordinal([ordinal.features(t) for t in texts], np.array(grades, float))
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2, 3]
    found = [model.grades[0] + model.tails(t).sum() for t in texts]
    assert np.abs(np.array(found) - grades).mean() < 0.25
    assert all((np.diff(model.tails(t)) <= 0).all() for t in texts)


def test_shapes():
    assert ordinal.shapes("Abc DEF,, x9 \n éÉ!! ".encode()) == [b"Aa", b"A,", b"a0", b"a!"]
    numbers, values = ordinal.features("a a b")
    assert len(set(numbers.tolist())) == len(numbers) and (values > 0).sum() >= 4


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = ordinal.fit(docs, ordinal.label_grades(labels.filter(seen)))
    found = ordinal.graded(docs, model, "found").join(labels.filter(~seen), "doc_id").collect()
    share = lambda good: np.mean([r.found.tails[0] >= 0.5 for r in found if r.quality == good])
    assert share(1) >= 0.995 and share(0) <= 0.1


def test_odd_rows(spark):
    rows = [(i, f"some plain words {i}", "k") for i in range(40)] + [(100 + i, f"### {i} ###", "k") for i in range(40)]
    more = [(500, None, "k"), (500, None, "k"), (None, "### ###", None), (501, "plain words " * 20000, "k")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, grade string")
    labels = spark.createDataFrame(
        [(i, int(i < 100), 0, "x") for i, *_ in rows] + [(None, 1, 0, "x"), (500, None, 0, "x"), (7, 1, None, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    kept = ordinal.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(40)) | {501} <= set(ids) and not {None, *range(100, 140)} & set(ids)
    assert ids.count(500) in (0, 2)
    assert ordinal.accepted(docs.limit(0), labels).collect() == []
    assert ordinal.accepted(docs, labels.limit(0)).count() == docs.count()


def test_an_id_on_many_documents_is_one_example(spark, monkeypatch):
    rows = [(1, f"one id on many texts {i}") for i in range(300)] + [(2, "another text"), (3, None), (3, "a third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ratings = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(ordinal, "fit_ordinal", lambda rows, grades, buckets: seen.append(grades.tolist()))
    ordinal.fit(docs, ratings)
    assert seen == [[0.0, 1.0, 1.0]]
