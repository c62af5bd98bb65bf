import zlib

import numpy as np

from seriescope.llm import quality_gam
from seriescope.llm.textstats import RATIOS

from .cases import TEXTS, frame


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.train(x[:4000], y[:4000], ("a", "b", "c"))
    assert (0, 1) in model.pairs
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.95
    b = model.bins(x[:5])
    by_hand = [model.intercept + sum(t[b[r, k]] for k, t in enumerate(model.tables)) + sum(t[b[r, i], b[r, j]] for (i, j), t in zip(model.pairs, model.pair_tables)) for r in range(5)]
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(-np.array(by_hand))))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality_gam.fit(docs, labels)
    rows = quality_gam.judged(docs, model).where("held_out").join(labels, "doc_id").collect()
    right = {q: [r.predicted == q for r in rows if r.quality == q] for q in (0, 1)}
    assert np.mean(right[1]) > 0.97 and np.mean(right[0]) > 0.75
    assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_edge_cases(spark):
    docs = frame(spark, extra=("score", "w"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_gam.fit(docs, none)
    out = quality_gam.judged(docs, model).collect()
    assert len(out) == len(TEXTS) and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert quality_gam.judged(docs.limit(0), model).count() == 0
    assert len(model.features) == len(RATIOS)
