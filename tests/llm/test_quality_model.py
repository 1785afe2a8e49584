import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablekeep.llm import quality_model as qm
from tests.llm.samples import documents, frame, prose


def pairwise(model, rows):
    """The machine's score by its definition: every pair of features."""
    out = []
    for i in range(len(rows)):
        x = np.zeros(qm.BUCKETS + rows.structure.shape[1])
        for f, v in zip(rows.feature[rows.row == i], rows.value[rows.row == i]):
            x[f] += v
        x[qm.BUCKETS :] = model.scaled(rows)[i]
        used = np.flatnonzero(x)
        total = model.bias + model.linear @ x
        for a, p in enumerate(used):
            for q in used[a + 1 :]:
                total += model.factors[p] @ model.factors[q] * x[p] * x[q]
        out.append(total)
    return np.array(out)


def test_sum_of_squares_identity():
    rows = qm.features(pa.array(["one two two", "", prose(1, 30), "A B c! 12"]))
    pick = np.random.default_rng(1)
    size = qm.BUCKETS + rows.structure.shape[1]
    model = qm.FactorisationMachine(
        0.3, pick.normal(size=size), pick.normal(size=(size, 5)),
        pick.normal(size=rows.structure.shape[1]), np.ones(rows.structure.shape[1]),
    )
    assert np.allclose(model.raw(rows), pairwise(model, rows))


def labelled(n, seed=0):
    """Good prose, and junk of capitals and signs; ids are spread over all remainders."""
    pick = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, good = prose(i + seed, pick.randint(20, 60)), pick.random() < 0.7
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else text.replace(" ", "%%% ")
        docs.append((i, text, "en", "s", 0))
        labels.append((i, int(good)))
    return docs, labels


def test_learns_what_is_held_out(spark):
    docs, labels = labelled(600)
    df = frame(spark, docs)
    truth = dict(labels)
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    model = qm.train(df, marked)
    rows = qm.score(df, model).withColumn("out", qm.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in rows if r.out} == {
        i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2
    }
    out = [r for r in rows if r.out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(200)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    models = [
        qm.train(frame(spark, docs), spark.createDataFrame(x, "doc_id long, quality int"))
        for x in (labels, flipped)
    ]
    assert models[0].bias == models[1].bias and (models[0].factors == models[1].factors).all()


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = labelled(200)
    model = qm.train(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    text = docs[0][1]
    rows = [(1, text, "en", "a", 1), (None, text, None, None, None), (-5, text, "de", "b", 10**6)]
    assert len({r.score for r in qm.score(frame(spark, rows), model).collect()}) == 1


def test_sample_is_bounded(spark):
    docs, labels = labelled(300)
    df, marked = frame(spark, docs + docs), spark.createDataFrame(labels * 2, "doc_id long, quality int")
    small = qm.train(df, marked, sample=20)
    assert small.bias == qm.train(df, marked, sample=20).bias


@pytest.mark.parametrize("labels", [[], [(6, 1)], [(None, 1), (6, None), (9, 7)], [(6, 0), (6, 1)]])
def test_few_or_contradicting_labels(spark, labels):
    model = qm.train(frame(spark), spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = qm.score(frame(spark), model).collect()
    assert len(rows) == len(documents()) and all(0 <= r.score <= 1 for r in rows)


def test_empty_and_clashing_names(spark):
    model = qm.fit(qm.features(pa.array([], pa.string())), np.empty(0))
    assert qm.score(frame(spark, []), model).collect() == []
    docs = frame(spark).withColumnRenamed("lang", "score").withColumnRenamed("source", "Predicted")
    assert qm.score(docs, model).columns == ["doc_id", "text", "n_chars", "score", "predicted"]
